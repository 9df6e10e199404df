"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into three fields.  Two fingerprints within
``threshold`` bits differ by ``threshold // 3`` at most in one field.  In each
field the anchors are a covering code: the perfect (15, 11) Hamming code on 15
bits, which covers every value within radius 1, times all values of the other
bits.  A fingerprint has one home anchor per field, within the radius; it is
replicated to every anchor within radius plus field threshold.  If two
fingerprints agree up to the field threshold, the second one is therefore a
replica at the first one's home, so comparing homes with replicas, anchor by
anchor, finds every link.

Copies are merged first (one row per distinct fingerprint).  Anchors with many
homes are cut into blocks of ``block`` homes, and replicas go to each block;
within a block homes are held and replicas stream past.  Only a spanning forest
of the links of a batch leaves a task.  Components over distinct fingerprints
are then found in Spark, and documents get the smallest doc_id of theirs.

Defined results: texts without words (null, empty, only white space) have
fingerprint zero and are linked like any other; shorter texts than a shingle
are one shingle; null ids are members but never name a component unless all
its ids are null; repeated rows each keep their own row; extra columns are
ignored; an empty table gives no rows.  Texts of any length are read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, materialize, task, unused
from .components import connected_components, local_roots

THRESHOLD = 4
SHINGLE = 4
SEED = 42
FIELDS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
CODED = 15  # bits of a field under the Hamming code
BLOCK = 4096  # homes compared at once


def fingerprint(text: bytes | None) -> int:
    """One text, as bytes: the reference form of :func:`fingerprints`."""
    return int(fingerprints([text])[0])


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        words = (t or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        if len(words) <= SHINGLE:
            hashes = [xxh64_intdigest(flat, SEED)]
        else:
            starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
            hashes = [xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]
        counts = np.zeros(64, np.int64)
        for a in range(0, len(hashes), 65536):
            bits = np.unpackbits(np.array(hashes[a : a + 65536], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * counts > len(hashes)).view(">u8")[0]
    return out


def _hamming_syndrome(x: np.ndarray) -> np.ndarray:
    """Positions 1..15 of set bits, xored: 0 for codewords, else the position to flip."""
    s = np.zeros(len(x), np.int64)
    for p in range(1, CODED + 1):
        s ^= np.where((x >> np.uint64(p - 1)) & np.uint64(1), p, 0)
    return s


def _flip(x: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Flip the bit at a position 1..15; 0 flips nothing."""
    return x ^ np.where(position > 0, np.uint64(1) << np.maximum(position - 1, 0).astype(np.uint64), np.uint64(0))


def anchors(values: np.ndarray, bits: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of field values as (index of value, anchor, is home).

    An anchor is a codeword and the other bits.  Replicas cover all anchors
    within 1 + e of the coded bits after flipping f of the others, e + f <= reach.
    """
    coded, other = values & np.uint64((1 << CODED) - 1), values >> np.uint64(CODED)
    rows, codes = [], []
    for f in range(reach + 1):
        radius = 1 + reach - f
        for flips in combinations(range(bits - CODED), f):
            shifted = other
            for p in flips:
                shifted = shifted ^ np.uint64(1 << p)
            # codewords within the radius: the nearest to the value changed in radius - 1 places or fewer
            for n in range(radius):
                for places in combinations(range(1, CODED + 1), n):
                    x = coded
                    for p in places:
                        x = x ^ np.uint64(1 << (p - 1))
                    codes.append(_flip(x, _hamming_syndrome(x)) | (shifted << np.uint64(CODED)))
                    rows.append(np.arange(len(values)))
    row, code = np.concatenate(rows), np.concatenate(codes)
    pairs = np.unique((row.astype(np.uint64) << np.uint64(bits)) | code)
    row, code = (pairs >> np.uint64(bits)).astype(np.int64), pairs & np.uint64((1 << bits) - 1)
    home = _flip(coded, _hamming_syndrome(coded)) | (other << np.uint64(CODED))
    return row, code, home


REPLICAS = "anchor long, home boolean, print long"


def _replicate(threshold: int):
    reach = threshold // len(FIELDS)

    def run(batches):
        schema = arrow_schema(REPLICAS)
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            for a in range(0, len(prints), 20_000):
                part = prints[a : a + 20_000]
                for field, (first, bits) in enumerate(FIELDS):
                    values = (part >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                    row, code, home = anchors(values, bits, reach)
                    mark = np.int64(field << 60)
                    yield as_batch(
                        {
                            "anchor": np.concatenate([code, home]).view(np.int64) | mark,
                            "home": np.concatenate([np.zeros(len(row), bool), np.ones(len(part), bool)]),
                            "print": np.concatenate([part[row], part]).view(np.int64),
                        },
                        schema,
                    )

    return run


def _compare(threshold: int, budget: int = 4_000_000):
    """Rows come sorted by (anchor, block), homes before replicas."""
    columns = "a long, b long"

    def forest(links: list[np.ndarray], schema):
        pairs = np.concatenate(links, axis=1)
        nodes, at = np.unique(pairs, return_inverse=True)
        at = at.reshape(pairs.shape)
        root = local_roots(at[0], at[1], len(nodes))
        child = np.flatnonzero(root != np.arange(len(nodes)))
        return as_batch({"a": nodes[child].view(np.int64), "b": nodes[root[child]].view(np.int64)}, schema)

    def run(batches):
        schema = arrow_schema(columns)
        held_key, held = None, np.zeros(0, np.uint64)  # homes of the anchor the last batch ended in
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = np.stack([batch.column("anchor").to_numpy(), batch.column("block").to_numpy()])
            home = batch.column("home").to_numpy(zero_copy_only=False)
            prints = batch.column("print").to_numpy().view(np.uint64)
            new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])
            group = np.cumsum(new) - 1
            homes = prints[home]
            home_group = group[home]
            if held_key is not None and (key[:, 0] == held_key).all():
                homes = np.concatenate([held, homes])
                home_group = np.concatenate([np.zeros(len(held), np.int64), home_group])
            per_group = np.bincount(home_group, minlength=group[-1] + 1)
            starts = np.cumsum(per_group) - per_group
            replica = np.flatnonzero(~home)
            sizes = per_group[group[replica]]
            links, filled = [], 0
            cum = np.cumsum(sizes)
            a = 0
            while a < len(replica):
                b = max(a + 1, int(np.searchsorted(cum, (cum[a - 1] if a else 0) + budget, side="right")))
                some, size = replica[a:b], sizes[a:b]
                left = np.repeat(prints[some], size)
                offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                right = homes[np.repeat(starts[group[some]], size) + offset]
                close = (np.bitwise_count(left ^ right) <= threshold) & (left < right)
                if close.any():
                    links.append(np.stack([left[close], right[close]]))
                    filled += int(close.sum())
                    if filled > budget:
                        yield forest(links, schema)
                        links, filled = [], 0
                a = b
            if links:
                yield forest(links, schema)
            last = group[-1]
            held_key, held = key[:, -1], homes[home_group == last]

    return run


def link_fingerprints(prints: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (column print)."""
    rows = prints.select("print").mapInArrow(task(_replicate(threshold)), REPLICAS)
    crowded = (
        rows.filter("home").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > block)
        .select("anchor", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    rows = rows.join(crowded, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    where = F.when(F.col("home"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("anchor", F.explode(where).alias("block"), "home", "print")
    rows = rows.repartition("anchor", "block").sortWithinPartitions("anchor", "block", F.desc("home"))
    return rows.mapInArrow(task(_compare(threshold)), "a long, b long").distinct()


def fingerprint_table(docs: DataFrame) -> DataFrame:
    def run(batches):
        schema = arrow_schema("doc_id long, print long")
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield as_batch({"doc_id": batch.column("doc_id"), "print": fingerprints(texts).view(np.int64)}, schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task(run, 1000), "doc_id long, print long")


def simhash_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    if not 0 <= threshold <= 5:
        raise ValueError("three fields and radius 1 serve thresholds up to 5")
    marked = materialize(fingerprint_table(docs), "fingerprints")
    distinct = materialize(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = materialize(connected_components(link_fingerprints(distinct, threshold)), "fingerprint-roots")
    named = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("print", "component_id")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return marked.join(named, "print").select("doc_id", hexed.alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, then the smallest hash of the row.

    Rows that repeat a document (same doc_id and text) are one document; one row of it stays.
    """
    row, key = F.xxhash64("doc_id", "text"), unused(docs, "row_key")
    groups = simhash_groups(docs.select(row.alias("doc_id"), "text"), threshold)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key)
    rows = docs.select("doc_id", row.alias(key)).distinct()
    first = (
        groups.select(F.col("doc_id").alias(key), "component_id").distinct().join(rows, key)
        .groupBy("component_id").agg(F.min(place)[key].alias(key)).select(key)
    )
    kept = docs.withColumn(key, row).join(first, key, "leftsemi")
    return kept.dropDuplicates([key]).select(*docs.columns)
