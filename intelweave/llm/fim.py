"""Fill-in-middle by displacement scatter.

Two cuts split a text into prefix, middle and suffix; the output reorders the
three and puts a marker before each.  A batch of texts is one byte array, and
so is the batch of outputs:

1. The scan for code point starts turns cuts, which count code points, into
   byte places of the batch.
2. Every piece moves as a whole, so a byte's displacement is that of its piece.
   A difference array holds, at the first byte of each piece, the change against
   the piece before; its cumulative sum is every byte's displacement.
3. One scatter writes all bytes of the batch to their places, three more write
   the markers.
4. Restoring scans outputs for markers, lays out the displacements by the same
   difference arrays, and gathers every byte of the texts from its place.  It
   sees output and form only.

Cuts and form come from the sha256 of ``<seed>:<doc_id>`` and are column
expressions.  A text that is empty, holds a marker, or falls outside the rate
stays plain.

Defined results: a null text is empty; a null doc_id is hashed as the empty
string; repeated rows (same doc_id and text) have equal results, one for each
row; an empty table gives an empty one; other columns are ignored, whatever
their names.  Texts of any length are moved whole; a batch of texts is worked
on in slices of about ``SLICE_BYTES``, and a longer text is a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, task, text_or_empty

SEED = 1
RATE = 90  # of 100 documents are split
SPM = 20  # of 100 split documents start with the suffix
#: markers, and the order of the pieces (0 prefix, 1 middle, 2 suffix) by form
MARKERS = (b"<P>", b"<M>", b"<S>")
ORDERS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
SLICE_BYTES = 4_000_000

OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def hash_group(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th group (from 0) of eight hexadecimal digits of the sha256 of ``seed:doc_id``, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def with_cuts(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, text, n, form, first and second: the cuts in code points, 0 and 0 where the form is plain."""
    h = [hash_group(F.col("doc_id"), seed, i) for i in range(4)]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    text = text.withColumn("n", F.char_length("text").cast("long"))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.col("text").contains(m.decode())
    plain = (F.col("n") == 0) | marked | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    cuts = [F.when(F.col("form") == "plain", 0).otherwise(x % (F.col("n") + 1)) for x in h[:2]]
    text = text.withColumn("form", form)
    return text.select("*", F.least(*cuts).alias("first"), F.greatest(*cuts).alias("second"))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (no nulls), end to end, and where each string starts (one more for the end)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings_of(flat: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(flat)])


def sliced(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES):
    """Slices of a batch whose strings hold about ``most`` bytes, or one string."""
    _, starts = bytes_of(batch.column(name))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def displacement(total: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The shift of each of ``total`` bytes; piece i starts at starts[i] (ascending, empty pieces allowed) and moves by shifts[i]."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, starts, np.diff(shifts, prepend=0))
    return np.cumsum(change[:-1])


def code_point_bytes(flat: np.ndarray, starts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The byte place in ``flat`` of the code point ``places[i]`` (its end, if it has as many) of string i."""
    heads = np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat))
    return heads[np.searchsorted(heads, starts[:-1]) + places]


def scatter(flat, starts, first, second, form) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of all outputs; first and second are byte places in flat, form is 0 plain, 1 psm, 2 spm."""
    n = len(starts) - 1
    cuts = np.stack([starts[:-1], first, second, starts[1:]], axis=1)
    sizes = np.diff(cuts, axis=1)
    split = form > 0
    mark = np.where(split, 3, 0)
    out_starts = np.zeros(n + 1, np.int64)
    np.cumsum(sizes.sum(axis=1) + 3 * mark, out=out_starts[1:])
    # where each piece goes: after the pieces before it in its form's order and their markers
    goes = np.empty((n, 3), np.int64)
    for f, order in enumerate([(0, 1, 2), *ORDERS.values()]):
        rows = form == f
        at = out_starts[:-1][rows].copy()
        for piece in order:
            at += mark[rows]
            goes[rows, piece] = at
            at += sizes[rows, piece]
    shift = displacement(len(flat), cuts[:, :3].reshape(-1), (goes - cuts[:, :3]).reshape(-1))
    out = np.empty(int(out_starts[-1]), np.uint8)
    out[np.arange(len(flat)) + shift] = flat
    for piece, marker in enumerate(MARKERS):
        at = goes[split, piece] - len(marker)
        for k, byte in enumerate(marker):
            out[at + k] = byte
    return out, out_starts


def gather(flat, starts, form) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of the texts, from the bytes and starts of all outputs and their forms."""
    n = len(starts) - 1
    split = np.flatnonzero(form > 0)
    # the markers of split outputs: each is there once, as such a text holds none
    found = np.full((n, 3), -1, np.int64)
    for piece, marker in enumerate(MARKERS):
        hit = np.ones(max(len(flat) - len(marker) + 1, 0), bool)
        for k, byte in enumerate(marker):
            hit &= flat[k : k + len(hit)] == byte
        at = np.flatnonzero(hit)
        owner = np.searchsorted(starts, at, "right") - 1
        inside = (form[owner] > 0) & (at + len(marker) <= starts[owner + 1])
        found[owner[inside], piece] = at[inside]
    if (found[split] < 0).any():
        raise ValueError("an output lacks a marker of its form")
    # pieces in the order of the text: where each begins and how long it is in the output
    begins = np.where(form[:, None] > 0, found + 3, np.stack([starts[:-1], starts[1:], starts[1:]], axis=1))
    sizes = np.zeros((n, 3), np.int64)
    sizes[:, 0] = starts[1:] - starts[:-1]
    for f, order in enumerate(ORDERS.values(), 1):
        rows = form == f
        for piece, after in zip(order, [*order[1:], None]):
            end = starts[1:][rows] if after is None else found[rows, after]
            sizes[rows, piece] = end - begins[rows, piece]
    text_starts = np.zeros(n + 1, np.int64)
    np.cumsum(sizes.sum(axis=1), out=text_starts[1:])
    lands = text_starts[:-1, None] + np.cumsum(sizes, axis=1) - sizes
    total = int(text_starts[-1])
    shift = displacement(total, lands.reshape(-1), (begins - lands).reshape(-1))
    return flat[np.arange(total) + shift], text_starts


def _forms(batch) -> np.ndarray:
    forms = pa.array(["plain", *ORDERS])
    return pa.compute.index_in(batch.column("form"), forms).to_numpy(zero_copy_only=False).astype(np.int64)


def _transform(batches):
    schema = arrow_schema(OUTPUT)
    for whole in batches:
        for batch in sliced(whole, "text"):
            flat, starts = bytes_of(batch.column("text"))
            form = _forms(batch)
            first, second = (batch.column(c).to_numpy() for c in ("first", "second"))
            cuts = [code_point_bytes(flat, starts, x) for x in (first, second)]
            out, out_starts = scatter(flat, starts, *cuts, form)
            chars = [pa.array(x, mask=form == 0) for x in (first, second - first)]
            yield as_batch(
                {
                    "doc_id": batch.column("doc_id"), "n": batch.column("n"), "form": batch.column("form"),
                    "prefix_chars": chars[0], "middle_chars": chars[1], "output": strings_of(out, out_starts),
                },
                schema,
            )


def _restore(kept: list[str], schema: pa.Schema):
    def run(batches):
        for whole in batches:
            for batch in sliced(whole, "output"):
                flat, starts = bytes_of(batch.column("output"))
                text = strings_of(*gather(flat, starts, _forms(batch)))
                yield as_batch({**{c: batch.column(c) for c in kept}, "restored": text}, schema)

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    return with_cuts(docs, seed, rate, spm).mapInArrow(task(_transform), OUTPUT)


def restore(outputs: DataFrame) -> DataFrame:
    """``outputs`` (of fill_in_middle) with the column ``restored``: the text, from output and form alone."""
    schema = OUTPUT + ", restored string"
    return outputs.mapInArrow(task(_restore(outputs.columns, arrow_schema(schema))), schema)
