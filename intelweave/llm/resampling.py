"""Importance resampling towards a target by hashed features.

A document's features are its runs of 1 to ``n`` consecutive words; each falls
into one of ``buckets`` buckets by the CRC of its bytes.  How often a bucket is
met in the target against the source gives its gain, a document's weight is the
sum of its features' gains, and the documents with the highest weight plus a
Gumbel noise of their own are a sample without replacement by weight.

The work on texts is done by Arrow kernels, a slice of a batch at a time:

1. ``ascii_lower`` and ``split_pattern_regex`` cut texts into words,
   ``list_flatten`` lays them end to end, ``dictionary_encode`` numbers them.
2. Pairs of these numbers and the numbers one place on, both of one document,
   are the runs of two words; each distinct pair gets a number, and so on for
   longer runs.
3. The CRC is taken once for each distinct run; ``take`` carries buckets, or
   gains, to all places, and a segmented reduction sums them by document.

Source and target are counted on all rows: a task adds up a histogram of
``buckets`` numbers, Spark sums them by bucket, and the driver sees that many
rows.  Ranks come from one sort by range of small rows (no texts) and the number
of rows in the ranges before, so no task sees more than its range.

Defined results: a null or empty text has no features and the weight 0; a null
doc_id is hashed as the empty string and comes after others of its score;
repeated rows (same doc_id and text) are judged each for itself and stand next
to each other; equal scores go by doc_id; an empty table of documents gives an
empty result, an empty target the gains of an empty histogram; other columns are
ignored, whatever their names.  Texts of any length are read whole.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, materialize, shared_in_stage, spans_of, task, text_or_empty
from .fim import hash_group, sliced

NGRAMS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WEIGHTS = "doc_id long, n_words long, n_features long, weight long, score long"
_KEPT_WORDS = 500_000  # CRCs that a worker keeps; more are taken anew


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """A number for every word of all texts, the number of words of each text, and the distinct words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=NOT_WORD)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)  # text may begin and end between words
    flat, owner = flat.filter(real), owner.filter(real)
    coded = flat.dictionary_encode()
    counts = np.bincount(owner.to_numpy(), minlength=len(texts)).astype(np.int64)
    return coded.indices.to_numpy().astype(np.int64), counts, coded.dictionary


def crc_buckets(features: pa.Array, buckets: int) -> np.ndarray:
    known = shared_in_stage("crc")
    if len(known) > _KEPT_WORDS:
        known.clear()
    out = np.empty(len(features), np.int64)
    for i, x in enumerate(features.to_pylist()):
        b = known.get(x)
        if b is None:
            b = known[x] = zlib.crc32(x.encode()) % buckets
        out[i] = b
    return out


def feature_buckets(texts: pa.Array, n: int, buckets: int):
    """For runs of 1, 2 ... n words: the bucket of every run of all texts, end to end, and the runs of each text."""
    codes, counts, runs = word_numbers(texts)
    words, lengths = codes, counts
    yield pc.take(pa.array(crc_buckets(runs, buckets)), pa.array(codes)).to_numpy(), counts
    heads, alphabet = codes, runs
    for size in range(2, n + 1):
        # the places where a run of this size begins: all but the last size - 1 of a text
        owner, place = spans_of(lengths)
        begins = np.flatnonzero(place <= lengths[owner] - size)
        shorter = np.flatnonzero(place <= lengths[owner] - size + 1)
        head = heads[np.searchsorted(shorter, begins)]
        pairs, codes = np.unique(head * len(runs) + words[begins + size - 1], return_inverse=True)
        left, right = pa.array(pairs // max(len(runs), 1)), pa.array(pairs % max(len(runs), 1))
        alphabet = pc.binary_join_element_wise(alphabet.take(left), runs.take(right), " ")
        counts = np.maximum(lengths - size + 1, 0)
        yield pc.take(pa.array(crc_buckets(alphabet, buckets)), pa.array(codes)).to_numpy(), counts
        heads = codes


def bucket_counts(docs: DataFrame, n: int = NGRAMS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in sliced(whole, "text"):
                for found, _ in feature_buckets(batch.column("text"), n, buckets):
                    counts += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(counts)
        yield as_batch({"bucket": met, "met": counts[met]}, arrow_schema("bucket long, met long"))

    met = docs.select(text_or_empty().alias("text")).mapInArrow(task(run), "bucket long, met long")
    total = np.zeros(buckets, np.int64)
    for bucket, count in met.groupBy("bucket").agg(F.sum("met")).collect():  # one row for each bucket at most
        total[bucket] = count
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the target's share of a bucket over the source's, each count raised by one."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    up, down = float(s_all + k), float(t_all + k)
    return np.array(
        [math.floor(1000 * math.log((float(t + 1) * up) / (float(s + 1) * down))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def gumbel(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, n: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""

    def run(batches):
        schema = arrow_schema(WEIGHTS)
        for whole in batches:
            for batch in sliced(whole, "text"):
                weight = np.zeros(batch.num_rows, np.int64)
                features = np.zeros(batch.num_rows, np.int64)
                words = None
                for found, counts in feature_buckets(batch.column("text"), n, len(gain)):
                    words = counts if words is None else words
                    features += counts
                    some = np.flatnonzero(counts)
                    if len(some):
                        weight[some] += np.add.reduceat(gain[found], (np.cumsum(counts) - counts)[some])
                noise = np.array([gumbel(h) for h in batch.column("h").to_pylist()], np.int64)
                yield as_batch(
                    {"doc_id": batch.column("doc_id"), "n_words": words, "n_features": features,
                     "weight": weight, "score": weight + noise},
                    schema,
                )

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_or_empty().alias("text"), hash_group(doc_id, seed, 0).alias("h"))
    return rows.mapInArrow(task(run), WEIGHTS)


def in_order(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``nth``, their place (from 1) by ``order``: sorted by range, written, and counted by range."""
    # the sort reads its rows twice, so they are written first
    placed = materialize(rows, "to-order").orderBy(*order).withColumn("nth", F.monotonically_increasing_id())
    placed = materialize(placed, "in-order")
    placed = placed.withColumn("part", F.shiftright("nth", 33)).withColumn("nth", F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)))
    # as many rows as the sort has ranges
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    starts = sizes.select("part", before.alias("before"))
    return placed.join(starts, "part").withColumn("nth", F.col("before") + F.col("nth") + 1).drop("part", "before")


def resample(
    docs: DataFrame, target: DataFrame, n: int = NGRAMS, buckets: int = BUCKETS, seed: int = SEED,
    min_words: int = MIN_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the rank of those not drawn is null."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    rows = weigh(docs, gain, n, seed).withColumn("eligible", F.col("n_words") >= min_words)
    ranked = in_order(rows, F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = percent * ranked.filter("eligible").count() // 100
    rank = F.when(F.col("eligible") & (F.col("nth") <= drawn), F.col("nth"))
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The documents that ``resample`` draws, without those it leaves; rows of one doc_id are drawn together."""
    chosen = resample(docs, target, **settings).filter("rank is not null").select("doc_id").distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["doc_id"]), "leftsemi")
