"""Benchmark decontamination by greedy string tiling.

A document holds a benchmark item if tiles, maximal runs of MIN_MATCH words or
more that the two share, each word used once, cover ``threshold`` of the item's
words.  Tiles may come in any order, so reordered passages count in full.

1. Seeds are the MIN_MATCH-word windows.  The items' seeds set bits of a filter
   of fixed size, built by aggregation; it is all that is sent to every task.
2. Documents are read once.  Words in windows that pass the filter are all that
   tiles can use; documents with any keep those words (as hashes, a gap
   between runs) and their seeds.
3. Seeds are joined.  A pair goes on if the item's shared windows are as many
   as ``threshold`` needs at the least: a tile of L words has L - MIN_MATCH + 1
   windows, never less than a MIN_MATCH-th of its words.
4. Each pair is tiled: rounds of running Karp-Rabin search mark the longest
   matches first, with the search length halved until MIN_MATCH.

Words are runs of letters, digits and underscores, in lower case.  Defined
results: null and empty texts and items with fewer than MIN_MATCH words match
nothing; repeated rows give one result each; a null id is carried; extra
columns are ignored; an empty benchmark or an empty table gives no rows.  Texts
of any length are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, codes_of, list_array, materialize, spans_of, task, unused

MIN_MATCH = 5
THRESHOLD = 0.8
FILTER_BITS = 1 << 22
WORD = re.compile(r"\w+")
GAP = 0  # stands for words that no tile can use; no word has this hash


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, end to end, and how many each text has."""
    from xxhash import xxh64_intdigest

    words, lengths = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = WORD.findall(t.lower()) if t else []
        lengths[i] = len(w)
        words += w
    codes, distinct = codes_of(words)
    table = np.array([xxh64_intdigest(w) or 1 for w in distinct.to_pylist()], np.uint64)
    return (table[codes] if len(codes) else np.zeros(0, np.uint64)), lengths


def seed_hashes(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the window that starts at each word, and whether it ends within the text."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))
    padded = np.concatenate([words, np.zeros(MIN_MATCH, np.uint64)])
    h = np.zeros(len(words), np.uint64)
    for k in range(MIN_MATCH):
        h = (h ^ padded[k : k + len(words)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h, left >= MIN_MATCH


def tiles(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, words) of non-overlapping matches, longest first."""
    free_item, free_text = np.ones(len(item), bool), text != GAP
    found: list[tuple[int, int, int]] = []
    length = max(min_match, min(len(item), 64))
    while True:
        longest, matches = _search(item, text, free_item, free_text, length)
        if longest > 2 * length:  # far longer ones are there: look for those first
            length = longest
            continue
        # mark longest first; what an earlier tile has taken is cut off and may still count
        by_length = defaultdict(list)
        for a, b, n in matches:
            by_length[n].append((a, b))
        for n in range(longest, length - 1, -1):
            for a, b in by_length.pop(n, ()):
                free = free_item[a : a + n] & free_text[b : b + n]
                if free.all():
                    free_item[a : a + n] = False
                    free_text[b : b + n] = False
                    found.append((a, b, n))
                    continue
                for x, y in _runs(free):
                    if y - x >= length:
                        by_length[y - x].append((a + x, b + x))
        if length == min_match:
            # matches cut short in the last round may leave others of this length
            if not matches:
                return found
            continue
        length = max(min_match, length // 2)


def _runs(flags: np.ndarray):
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def _rolling(values: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the windows that are wholly free, and where they start."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, power = values.copy(), 1  # windows of ``power`` words, doubled up to the length
    base = 0x9E3779B97F4A7C15
    done, out = 0, np.zeros(n, np.uint64)
    rest = length
    while rest:
        if rest & 1:
            out = out * np.uint64(pow(base, power, 1 << 64)) + h[done : done + n]
            done += power
        rest >>= 1
        if rest:
            h = h[: len(h) - power] * np.uint64(pow(base, power, 1 << 64)) + h[power:]
            power *= 2
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[length:] == taken[:-length])
    return out[starts], starts


def _search(item, text, free_item, free_text, length):
    """Maximal matches of ``length`` words or more over free words, and the longest of them."""
    hashes, starts = _rolling(item, free_item, length)
    if not len(starts):
        return 0, []
    where = defaultdict(list)
    for h, a in zip(hashes.tolist(), starts.tolist()):
        where[h].append(a)
    hashes, starts = _rolling(text, free_text, length)
    hits = np.flatnonzero(np.isin(hashes, np.fromiter(where, np.uint64, len(where))))
    longest, matches, seen = 0, [], set()
    for h, b in zip(hashes[hits].tolist(), starts[hits].tolist()):
        for a in where[h]:
            if a and b and (a - 1, b - 1) in seen:
                seen.add((a, b))  # inside the match that began one word before
                continue
            if not np.array_equal(item[a : a + length], text[b : b + length]):
                continue
            seen.add((a, b))
            n, most = length, min(len(item) - a, len(text) - b)
            while n < most and item[a + n] == text[b + n] and free_item[a + n] and free_text[b + n]:
                n += 1
            matches.append((a, b, n))
            longest = max(longest, n)
            if n > 2 * length:
                return n, matches
    return longest, matches


def coverage(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Share of the item's words under tiles, the number of tiles, and the longest."""
    got = tiles(item, text)
    return sum(n for _, _, n in got) / max(len(item), 1), len(got), max((n for _, _, n in got), default=0)


def item_table(benchmark: DataFrame) -> DataFrame:
    """item (hash of the row), item_id, words and seeds of every item that has a window."""
    columns = "item long, item_id long, words array<long>, seeds array<long>"

    def run(batches):
        schema = arrow_schema(columns)
        for batch in batches:
            words, lengths = word_hashes(batch.column("text").to_pylist())
            seeds, whole = seed_hashes(words, lengths)
            owner, _ = spans_of(lengths)
            yield as_batch(
                {
                    "item": batch.column("item"), "item_id": batch.column("item_id"),
                    "words": list_array(words.view(np.int64), lengths),
                    "seeds": list_array(seeds[whole].view(np.int64), np.bincount(owner[whole], minlength=len(lengths))),
                },
                schema,
            )

    rows = benchmark.select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long"), "text").distinct()
    return rows.mapInArrow(task(run), columns).filter(F.size("seeds") > 0)


def seed_filter(items: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bits set by the items' seeds, as bytes; ``bits / 64`` rows at most come from the cluster, however many items there are."""
    bit = F.pmod(F.col("seed"), F.lit(bits))
    words = (
        items.select(F.explode("seeds").alias("seed"))
        .select(F.floor(bit / 64).cast("int").alias("at"), (bit % 64).cast("int").alias("bit"))
        .groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("value")).collect()
    )
    out = np.zeros(bits // 64, np.int64)
    for r in words:
        out[r["at"]] = r["value"]
    return out.astype("<i8").view(np.uint8)


def documents_with_seeds(docs: DataFrame, passing: np.ndarray) -> DataFrame:
    """doc (hash of the row), doc_id, words that tiles can use, and distinct seeds, of documents with any."""
    columns = "doc long, doc_id long, words array<long>, seeds array<long>"
    bits = np.uint64(len(passing) * 8)

    def run(batches):
        schema = arrow_schema(columns)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 1000):
                words, lengths = word_hashes(texts[a : a + 1000])
                seeds, whole = seed_hashes(words, lengths)
                at = (seeds.view(np.int64) % np.int64(bits)).astype(np.int64)
                hit = whole & ((passing[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                if not hit.any():
                    continue
                owner, _ = spans_of(lengths)
                usable = np.zeros(len(words), bool)
                for k in range(MIN_MATCH):
                    usable[np.flatnonzero(hit) + k] = True
                # a gap before each run, so that no match goes over it
                kept = np.flatnonzero(usable)
                lead = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(owner[kept]) > 0)])
                values = np.insert(words[kept], np.flatnonzero(lead), GAP)
                owners = np.insert(owner[kept], np.flatnonzero(lead), owner[kept][lead])
                pairs = np.unique(np.stack([owner[hit].astype(np.uint64), seeds[hit]]), axis=1)
                have = np.unique(owners)
                yield as_batch(
                    {
                        "doc": batch.column("doc").take(pa.array(a + have)),
                        "doc_id": batch.column("doc_id").take(pa.array(a + have)),
                        "words": list_array(values.view(np.int64), np.bincount(owners, minlength=len(lengths))[have]),
                        "seeds": list_array(
                            pairs[1].view(np.int64), np.bincount(pairs[0].astype(np.int64), minlength=len(lengths))[have]
                        ),
                    },
                    schema,
                )

    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(task(run, 1000), columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc, doc_id, item_id, coverage, n_tiles, longest_tile of every pair at the threshold or above."""
    items = materialize(item_table(benchmark), "items")
    hits = materialize(documents_with_seeds(docs, seed_filter(items)), "seed-hits")
    windows = items.select("item", F.size("words").alias("n"), F.explode("seeds").alias("seed"))
    windows = windows.groupBy("seed", "item").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    found = hits.select("doc", "doc_id", F.explode("seeds").alias("seed")).distinct()
    pairs = (
        found.join(windows, "seed").groupBy("doc", "doc_id", "item")
        .agg(F.sum("times").alias("shared"), F.first("n").alias("n"))
        .filter(F.col("shared") * MIN_MATCH >= threshold * F.col("n")).select("doc", "item")
    )
    rows = (
        pairs.join(hits.select("doc", "doc_id", F.col("words").alias("text")), "doc")
        .join(items.select("item", "item_id", "words"), "item")
        .select("doc", "doc_id", "item_id", "words", "text")
    )
    columns = "doc long, doc_id long, item_id long, coverage double, n_tiles long, longest_tile long"

    def run(batches):
        schema = arrow_schema(columns)
        for batch in batches:
            item, text = batch.column("words"), batch.column("text")
            got = [
                coverage(item[i].values.to_numpy().view(np.uint64), text[i].values.to_numpy().view(np.uint64))
                for i in range(batch.num_rows)
            ]
            out = {k: batch.column(k) for k in ("doc", "doc_id", "item_id")}
            yield as_batch(out | {k: [g[j] for g in got] for j, k in enumerate(("coverage", "n_tiles", "longest_tile"))}, schema)

    return rows.mapInArrow(task(run), columns).filter(F.col("coverage") >= threshold)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no benchmark item."""
    doc = unused(docs, "doc_key")
    bad = contaminated(docs, benchmark, threshold).select(F.col("doc").alias(doc)).distinct()
    return docs.withColumn(doc, F.xxhash64("doc_id", "text")).join(bad, doc, "left_anti").select(*docs.columns)
