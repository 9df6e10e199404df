"""Fuzzy line deduplication by MinHash.

Lines are compared in lower case without white space at their ends; blank lines
are not compared.  Equal lines are one line from the start (a 64-bit hash).

1. A line's set of ``SHINGLE``-character shingles (a shorter line is one
   shingle) gives BANDS x ROWS MinHash values, and each band one key.  Two
   lines with Jaccard similarity s share a band with probability
   1 - (1 - s^ROWS)^BANDS: 0.98 at s = 0.8, 0.9996 at s = 0.88.
2. Lines meet by band key.  Keys with one line drop out in the stream that
   numbers the lines of a key; keys with the very same lines are one group; a
   group of more than ``block`` lines is compared as pairs of blocks.  Only
   lines that met another bring their text.
3. The exact Jaccard similarity of all pairs of a block (or two) comes from a
   product of incidence matrices; the pairs at ``threshold`` or more are links,
   and only a spanning forest of a block's links leaves its task.
4. Components of the links by distributed union-find; the first line of each
   (by doc_id, then place) is kept.

Defined results: null and empty texts have no lines; repeated rows (same doc_id
and text) are one document, whose lines are judged alike; of equal lines the
one with the smallest doc_id and then the smallest place is kept, null doc_ids
coming last; extra columns are ignored; an empty table gives no rows.  Lines of
any length are compared whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, grouped, list_array, materialize, spans_of, task, unused
from .components import connected_components, local_roots

SHINGLE = 7
ROWS, BANDS = 5, 10
THRESHOLD = 0.8
BLOCK = 512
SMALL = 8  # lines of a group that is compared together with others
_SEED = 20240229


def normalised(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\r\x0b\x0c")))


def line_table(docs: DataFrame) -> DataFrame:
    """doc (hash of the row), doc_id, line_no, id, line of every line that is not blank."""
    lines = docs.select(
        F.xxhash64("doc_id", "text").alias("doc"),
        F.col("doc_id").cast("long"),
        F.posexplode(F.transform(F.split("text", "\n"), normalised)).alias("line_no", "line"),
    ).filter(F.col("line") != "")
    return lines.withColumn("id", F.xxhash64("line"))


def shingle_hashes(lines: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, end to end, and how many each line has."""
    lines = [x if len(x) >= k else x + "\0" * (k - len(x)) for x in lines]
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in lines], np.int64)
    if not len(chars):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(len(chars) - k + 1, np.uint64)
    for j in range(k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += chars[j : len(chars) - k + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    counts = lengths - k + 1
    owner, place = spans_of(counts)
    return h[(np.cumsum(lengths) - lengths)[owner] + place], counts


def band_keys(lines: list[str], rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """(lines, bands) keys; lines share one where the MinHash values of a band agree."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(0, 2**32, rows * bands, dtype=np.uint32) | np.uint32(1)
    offsets = rng.integers(0, 2**32, rows * bands, dtype=np.uint32)
    hashes, counts = shingle_hashes(lines)
    base = (hashes >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(counts) - counts
    keys = np.empty((len(lines), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(lines), band + 1, np.uint64)
        for row in range(band * rows, (band + 1) * rows):
            low = np.minimum.reduceat(base * factors[row] + offsets[row], starts)
            key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        keys[:, band] = key
    return keys.view(np.int64)


def _keys(batches):
    schema = arrow_schema("id long, keys array<long>")
    for batch in batches:
        ids = batch.column("id").to_numpy()
        _, first = np.unique(ids, return_index=True)
        lines = batch.column("line").take(pa.array(first)).to_pylist()
        for a in range(0, len(lines), 2000):
            part = lines[a : a + 2000]
            keys = band_keys(part)
            yield as_batch({"id": ids[first[a : a + 2000]], "keys": list_array(keys.reshape(-1), np.full(len(part), BANDS))}, schema)


def _meet(batches):
    """Rows sorted by (key, id): each key's distinct lines are numbered; keys with one line are left out."""
    schema = arrow_schema("key long, id long, nth long")
    last_key, last_id, last_nth = None, None, 0
    for batch in batches:
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        if not len(key):
            continue
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
        if last_key is not None and key[0] == last_key and ids[0] == last_id:
            fresh[0] = False
        key, ids = key[fresh], ids[fresh]
        if not len(key):
            continue
        n = len(key)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        carried = last_key is not None and key[0] == last_key
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        nth = np.arange(n) - start
        if carried:
            nth[start == 0] += last_nth + 1
        out = nth > 0
        leads = np.flatnonzero(nth == 0)
        leads = leads[leads + 1 < n]
        out[leads] = key[leads + 1] == key[leads]
        pieces = [(key[out], ids[out], nth[out])]
        if carried and last_nth == 0:  # the first of its key was held back until a second came
            pieces.insert(0, (np.array([last_key]), np.array([last_id]), np.zeros(1, np.int64)))
        yield as_batch(dict(zip(schema.names, (np.concatenate(x) for x in zip(*pieces)))), schema)
        last_key, last_id, last_nth = key[-1], ids[-1], int(nth[-1])


def jaccard_links(lines: list[str], threshold: float, side: np.ndarray | None = None, chunk: int = 4096):
    """Pairs (i, j), i < j, with exact Jaccard similarity of threshold or more; with ``side``, only across sides."""
    hashes, counts = shingle_hashes(lines)
    owner = np.repeat(np.arange(len(lines)), counts)
    shingles, at = np.unique(hashes, return_inverse=True)
    cells = np.unique(at.astype(np.int64) * len(lines) + owner)
    at, owner = cells // len(lines), cells % len(lines)
    sizes = np.bincount(owner, minlength=len(lines))
    common = np.bincount(at)[at] > 1  # shingles of one line meet nothing
    at, owner = np.unique(at[common], return_inverse=True)[1], owner[common]
    both = np.zeros((len(lines), len(lines)), np.float32)
    for a in range(0, int(at.max()) + 1 if len(at) else 0, chunk):
        x, y = np.searchsorted(at, [a, a + chunk])  # at is sorted
        m = np.zeros((len(lines), min(chunk, int(at.max()) + 1 - a)), np.float32)
        m[owner[x:y], at[x:y] - a] = 1
        both += m @ m.T
    union = sizes[:, None] + sizes[None, :] - both
    hit = np.triu(both >= threshold * union, 1)
    if side is not None:
        hit &= side[:, None] != side[None, :]
    return np.nonzero(hit)


def links_of_small_groups(lines: list[str], group: np.ndarray, threshold: float):
    """Pairs (i, j) within groups of SMALL lines at most, with exact Jaccard similarity of threshold or more, all at once."""
    mix = lambda x: (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    hashes, counts = shingle_hashes(lines)
    owner = np.repeat(np.arange(len(lines)), counts)
    # each shingle of a line once
    key = hashes ^ mix(owner)
    order = np.argsort(key)
    once = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
    hashes, owner = hashes[once], owner[once]
    sizes = np.bincount(owner, minlength=len(lines))
    # lines of a group that share a shingle stand side by side
    key = hashes ^ mix(group[owner])
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    met = [np.zeros(0, np.int64)]
    for d in range(1, SMALL):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        x, y = owner[:-d][same], owner[d:][same]
        met.append(np.minimum(x, y) * len(lines) + np.maximum(x, y))
    pairs, common = np.unique(np.concatenate(met), return_counts=True)
    i, j = pairs // len(lines), pairs % len(lines)
    hit = common >= threshold * (sizes[i] + sizes[j] - common)
    return i[hit], j[hit]


def _verify(threshold: float, at_once: int = 4000):
    def run(batches):
        schema = arrow_schema("a long, b long")
        for rows in grouped(batches, "part"):
            part, ids = rows.column("part").to_numpy(), rows.column("id").to_numpy()
            block, lines = rows.column("block").to_numpy(), rows.column("line")
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            sizes = np.diff(cuts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            small = np.flatnonzero(np.repeat(sizes <= SMALL, sizes))
            i, j = [], []
            a = 0
            while a < len(small):
                b = min(len(small), a + at_once)
                while b < len(small) and group[small[b]] == group[small[b - 1]]:
                    b += 1
                some = small[a:b]
                x, y = links_of_small_groups(lines.take(pa.array(some)).to_pylist(), group[some], threshold)
                i.append(some[x])
                j.append(some[y])
                a = b
            for g in np.flatnonzero(sizes > SMALL):
                x, y = int(cuts[g]), int(cuts[g + 1])
                side = block[x:y] if block[x:y].min() != block[x:y].max() else None
                p, q = jaccard_links(lines.slice(x, y - x).to_pylist(), threshold, side)
                i.append(x + p)
                j.append(x + q)
            i, j = np.concatenate(i), np.concatenate(j)
            root = local_roots(i, j, len(ids))
            child = np.flatnonzero(root != np.arange(len(ids)))
            if len(child):
                yield as_batch({"a": ids[child], "b": ids[root[child]]}, schema)

    return run


def line_links(lines: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct lines; lines has id and line."""
    keys = lines.select("id", "line").mapInArrow(task(_keys), "id long, keys array<long>")
    met = keys.select(F.explode("keys").alias("key"), "id").repartition("key").sortWithinPartitions("key", "id")
    met = materialize(met.mapInArrow(task(_meet), "key long, id long, nth long"), "line-bands")
    # near copies agree in many bands: keys with the very same lines are compared once
    keyed = met.groupBy("key").agg(
        (F.floor(F.max("nth") / block) + 1).cast("int").alias("blocks"),
        F.xxhash64(F.count("*"), F.expr("bit_xor(xxhash64(id))"), F.expr("bit_xor(xxhash64(id, 1))")).alias("same"),
    )
    # a line's place among equal sets is the same, as lines are numbered in the order of their ids
    met = met.join(keyed, "key").select("same", "id", F.floor(F.col("nth") / block).cast("int").alias("block"), "blocks").distinct()
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("same", "id", "block", other.alias("other"))
    part = F.xxhash64("same", F.least("block", "other"), F.greatest("block", "other"))
    met = met.select("id", "block", part.alias("part"))
    texts = lines.select("id", "line").join(met.select("id").distinct(), "id", "leftsemi").dropDuplicates(["id"])
    rows = met.join(texts, "id").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(task(_verify(threshold)), "a long, b long").distinct()


def line_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, doc_id, line_no, class_id and kept of every line that is not blank."""
    lines = line_table(docs)
    roots = materialize(connected_components(line_links(lines, threshold)), "line-roots")
    places = lines.select("doc", "doc_id", "line_no", "id")
    places = places.join(roots, places["id"] == roots["node"], "left").select(
        "doc", "doc_id", "line_no", F.coalesce("root", "id").alias("class_id")
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "doc", "line_no")
    first = places.groupBy("class_id").agg(F.min(place).alias("first"))
    return places.join(first, "class_id").select(
        "doc", "doc_id", "line_no", "class_id",
        ((F.col("doc") == F.col("first.doc")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without the lines that are not kept; one left without any line goes."""
    doc, gone = unused(docs, "doc_key"), unused(docs, "gone_lines")
    dropped = line_groups(docs, threshold).filter(~F.col("kept"))
    # as many numbers as the document has lines
    dropped = dropped.groupBy(F.col("doc").alias(doc)).agg(F.collect_set("line_no").alias(gone))
    marked = docs.withColumn(doc, F.xxhash64("doc_id", "text")).join(dropped, doc, "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i))
    empty = F.size(F.filter(left, lambda x: normalised(x) != "")) == 0
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return marked.filter(F.col(gone).isNull() | ~empty).withColumn("text", text).select(*docs.columns)
