"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of ``window`` bytes, from
both ends, labels every byte with a distribution over the learned languages,
and a document's probabilities are the mean over all its bytes.  It is trained
in numpy by backpropagation through time on a bounded sample: ``train_docs``
labelled documents (those with the smallest hash of doc_id among
``learn_from``), one piece of ``train_chars`` characters of each.

Gates are piecewise linear and the candidate is a softsign, which need no
exponentials.  Weights are a few kilobytes and go to the tasks with the
function; prediction is one pass over the documents without a shuffle.

Defined results: ``und`` with score 0 for null texts, texts without a letter,
and for all texts if no row is labelled; repeated rows and null ids each keep
their own row; only text is read in prediction; other columns are ignored;
an empty table gives no rows.  Texts of any length are read whole, in windows
that each start afresh.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded_sample, spans_of, task, unused

UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


@dataclass
class ByteNet:
    """Weights by direction (0 forward, 1 backward); gates are stacked as update, reset, candidate."""

    labels: list[str]
    units: int = 16
    window: int = 96
    seed: int = 7
    weights: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.weights:
            rng = np.random.default_rng(self.seed)
            h, k = self.units, len(self.labels)
            for d in (0, 1):
                self.weights[f"E{d}"] = rng.normal(0, 0.5, (256, 3 * h)).astype(np.float32)
                self.weights[f"U{d}"] = rng.normal(0, 1 / np.sqrt(h), (3 * h, h)).astype(np.float32)
                self.weights[f"O{d}"] = rng.normal(0, 1 / np.sqrt(h), (k, h)).astype(np.float32)
            self.weights["b"] = np.zeros((k, 1), np.float32)

    def _step(self, d: int, x: np.ndarray, h: np.ndarray):
        """One byte for every window: gates, candidate and the part the reset gate scales."""
        n = self.units
        e = self.weights[f"E{d}"][x].T
        g = self.weights[f"U{d}"] @ h
        gates = e[: 2 * n] + g[: 2 * n]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        c = g[2 * n :] * gates[n:]
        c += e[2 * n :]
        c /= 1 + np.abs(c)
        return gates, c, g[2 * n :]

    def position_logits(self, x: np.ndarray) -> np.ndarray:
        """x: bytes as (steps, windows).  Logits as (steps, labels, windows)."""
        steps, n = x.shape
        out = np.empty((steps, len(self.labels), n), np.float32)
        out[:] = self.weights["b"]
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            h = np.zeros((self.units, n), np.float32)
            o = self.weights[f"O{d}"]
            for s in order:
                gates, c, _ = self._step(d, x[s], h)
                c -= h
                c *= gates[: self.units]
                h += c
                out[s] += o @ h
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = self.position_logits(x)
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict:
        """Backpropagation through time of the mean cross-entropy over all bytes."""
        steps, n = x.shape
        u = self.units
        kept = {}
        for d in (0, 1):
            order = range(steps) if d == 0 else range(steps - 1, -1, -1)
            h, trace = np.zeros((u, n), np.float32), {}
            for s in order:
                gates, c, g = self._step(d, x[s], h)
                new = h + gates[:u] * (c - h)
                trace[s] = (h, gates, c, g, new)
                h = new
            kept[d] = trace
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        total = max(mask.sum(), 1)
        dlogits = {}
        for s in range(steps):
            logits = self.weights["b"] + sum(self.weights[f"O{d}"] @ kept[d][s][4] for d in (0, 1))
            p = np.exp(logits - logits.max(axis=0))
            p /= p.sum(axis=0)
            p[y, np.arange(n)] -= 1
            p *= mask[s] / total
            dlogits[s] = p
            grads["b"] += p.sum(axis=1, keepdims=True)
        for d in (0, 1):
            order = range(steps - 1, -1, -1) if d == 0 else range(steps)
            carry = np.zeros((u, n), np.float32)
            inputs = np.empty((steps, n, 3 * u), np.float32)
            for s in order:
                h, gates, c, g, new = kept[d][s]
                grads[f"O{d}"] += dlogits[s] @ new.T
                dh = carry + self.weights[f"O{d}"].T @ dlogits[s]
                z, r = gates[:u], gates[u:]
                dc = dh * z * (1 - np.abs(c)) ** 2
                inner = 0.25 * ((gates > 0) & (gates < 1))
                dgates = np.concatenate([dh * (c - h), dc * g]) * inner
                dg = np.concatenate([dgates, dc * r])
                inputs[s] = np.concatenate([dgates, dc]).T
                grads[f"U{d}"] += dg @ h.T
                carry = dh * (1 - z) + self.weights[f"U{d}"].T @ dg
            by_byte = np.argsort(x.reshape(-1), kind="stable")
            byte, first = np.unique(x.reshape(-1)[by_byte], return_index=True)
            grads[f"E{d}"][byte] = np.add.reduceat(inputs.reshape(-1, 3 * u)[by_byte], first, axis=0)
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int = 120, batch: int = 256, rate: float = 0.01):
        """Adam over windows x (windows, bytes) with labels y, ``steps`` times; the rate falls to zero."""
        rng = np.random.default_rng(self.seed)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(w) for k, w in self.weights.items()}
        order, t = np.zeros(0, np.int64), 0
        while t < steps:
            order = np.concatenate([order, rng.permutation(len(x))])
            while len(order) >= min(batch, len(x)) and t < steps:
                pick, order = order[:batch], order[batch:]
                grads = self.gradients(np.ascontiguousarray(x[pick].T), y[pick], np.ascontiguousarray(mask[pick].T))
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                t += 1
                step = rate * (1 - (t - 1) / steps)
                for k, g in grads.items():
                    g = g * min(1.0, 1 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    fixed = m[k] / (1 - 0.9**t), v[k] / (1 - 0.99**t)
                    self.weights[k] -= (step * fixed[0] / (np.sqrt(fixed[1]) + 1e-8)).astype(np.float32)
        return self


def windows_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as (windows, steps), the bytes in use of each window, and the text of each window."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = -(-lengths // window)
    owner, place = spans_of(counts)
    out = np.zeros((int(counts.sum()), window), np.uint8)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    row, col = spans_of(lengths)
    first = np.cumsum(counts) - counts
    out.reshape(-1)[np.repeat(first * window, lengths) + col] = flat
    used = np.minimum(window, lengths[owner] - place * window)
    return out, used, owner


def train(docs: DataFrame, learn_from: Column, train_docs: int = 3000, train_chars: int = 192, steps: int = 120, **net) -> ByteNet | None:
    """The network fitted to a bounded sample of labelled rows; None without any."""
    room = F.greatest(F.length("text") - train_chars, F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id"), room).cast("int") + 1
    piece = F.substring("text", start, F.lit(train_chars)).alias("piece")
    labelled = docs.filter(learn_from & F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "lang", piece)
    rows = bounded_sample(labelled, "doc_id", train_docs).select("lang", "piece").collect()
    labels = sorted({r.lang for r in rows})
    if not labels:
        return None
    model = ByteNet(labels, **net)
    x, used, owner = windows_of([r.piece.encode() for r in rows], model.window)
    y = np.array([labels.index(r.lang) for r in rows])[owner]
    mask = (np.arange(model.window) < used[:, None]).astype(np.float32)
    return model.fit(x, y, mask, steps)


def pooled(model: ByteNet, texts: list[bytes], chunk: int = 4096, held: int = 1 << 20) -> np.ndarray:
    """Mean label probabilities over all bytes of each text: (texts, labels); about ``held`` bytes are laid out at once."""
    sums = np.zeros((len(texts), len(model.labels)))
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - lengths[first] + held, side="right")))
        x, used, owner = windows_of(texts[first:last], model.window)
        # windows of like fill together, so that short ones need few steps
        order = np.argsort(used, kind="stable")
        for a in range(0, len(x), chunk):
            pick = order[a : a + chunk]
            steps = int(used[pick].max())
            p = model.probabilities(np.ascontiguousarray(x[pick, :steps].T))
            p *= (np.arange(steps)[:, None] < used[pick])[:, None, :]
            np.add.at(sums, first + owner[pick], p.sum(axis=0).T)
        first = last
    return sums / np.maximum(lengths, 1)[:, None]


def with_language(docs: DataFrame, model: ByteNet | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and two new ones, ``lang`` and ``score``; only text is read."""
    if model is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0)})
    names, lettered = np.array(model.labels, dtype=object), unused(docs, "has_letter")

    def run(batches):
        for batch in batches:
            known = batch.column(lettered).fill_null(False).to_numpy(zero_copy_only=False)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            p = pooled(model, [t if k else b"" for t, k in zip(texts, known)])
            best = p.argmax(axis=1)
            sure = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            kept = [c for c in batch.schema.names if c != lettered]
            new = [pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(sure)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, lang, score])

    out = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    return docs.withColumn(lettered, F.col("text").rlike(r"\p{L}")).mapInArrow(task(run, 1000), out)


def predict(docs: DataFrame, model: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    return with_language(docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents that are not held out, predict all."""
    return predict(docs, train(docs, ~held_out(F.col("doc_id")), **options))
