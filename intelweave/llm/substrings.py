"""Removal of repeated byte strings, by a transform built column by column.

A byte goes if a string of ``SPAN`` bytes that covers it also begins at another
place, in the same text or another.  Texts are UTF-8 bytes.

1. Every window of SPAN bytes has an anchor: the one of its strings of
   ``GRAMS[0]`` bytes with the least hash, the leftmost of equal ones.  Windows
   that follow each other and have one anchor are a piece of text; equal windows
   have equal anchors, so pieces can share a window only if they share their
   anchor's key.  A first pass over the texts counts keys; a second one lists
   the pieces whose key was met twice, as places without text.
2. Equal pieces become one string with a weight, on the map side first.  One
   place of each brings its text.
3. Strings meet by key.  A task's strings, a few thousand at a time, are a
   collection that ``bwt`` builds column by column, aligned at their anchors:
   a window is repeated if the common prefix with a neighbour in the order of
   suffixes is SPAN bytes or more, or if its string's weight is two or more.
4. A key with more than ``CROWD`` different strings is not brought into one
   task: its strings are cut anew by longer grams, which tell more of them
   apart, up to grams of SPAN bytes, where a key has one window.
5. Repeated windows go back to the places of their pieces, are gathered by text
   (equal texts once), and their union is cut out.

Texts are told apart by 80 bits and pieces by 128 bits of hashes.

Defined results: a null text is empty; a text shorter than SPAN stays whole;
each of two repeated rows (same doc_id and text) is a text of its own, so both
lose all that a window covers; doc_id may be null or repeated and is only passed
on; an empty table gives an empty one; other columns are ignored, whatever their
names.  Texts of any length are read whole, ``CHUNK`` windows at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bwt import shared_windows
from .common import arrow_schema, as_batch, flat_list, grouped, list_array, materialize, spans_of, task, text_or_empty
from .fim import bytes_of

SPAN = 200
GRAMS = (64, 128, 176, 200)
CROWD = 1000
CHUNK = 1 << 17
COLLECTION = 4000  # strings of a task's collection, about
ROWS = 500  # texts passed to a worker at a time

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_ONE = np.ones(1, np.uint64)
_LOW = np.uint64((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` values from each place that has as many; the width doubles from step to step."""
    out, done = None, 0
    part, width = values, 1
    while True:
        if k & width:
            if out is None:
                out = part
            else:
                n = len(values) - done - width + 1
                out = out[:n] * np.uint64(pow(_BASE, width, 2**64)) + part[done : done + n]
            done += width
        if 2 * width > k:
            return out
        n = len(part) - width
        part = part[:n] * np.uint64(pow(_BASE, width, 2**64)) + part[width : width + n]
        width *= 2


def sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of the ``w`` values from each place that has as many."""
    width = 1
    while 2 * width <= w:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (w - width)], values[w - width :]) if w > width else values


def cut(flat: np.ndarray, starts: np.ndarray, gram: int, span: int):
    """Pieces of strings that lie end to end: string, place in it, windows, anchor's distance, key, mark; arrays by chunk.

    ``mark`` is a hash of the piece's bytes, ``key`` one of its anchor's.
    """
    low, most = np.uint64(pow(_BASE, -1, 2**64)), CHUNK + span - 1
    powers, back = (np.cumprod(np.concatenate([_ONE, np.full(most, x, np.uint64)])) for x in (_BASE, low))
    for a in range(0, len(flat) - span + 1, CHUNK):
        bytes_here = flat[a : a + most]
        values = _BYTE[bytes_here]
        hashes = mixed(gram_hashes(values, gram))
        anchors = sliding_least((hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64), span - gram + 1)
        n = len(anchors)
        # the string of each window, and whether it ends within it
        i, j = np.searchsorted(starts, [a, a + n], "left")
        inner = starts[i:j] - a
        change = np.zeros(n, bool)
        change[inner] = True
        new = change.copy()
        new[0] = True
        new[1:] |= anchors[1:] != anchors[:-1]
        begin = np.flatnonzero(new)
        owner = np.searchsorted(starts, begin + a, "right") - 1
        stop = np.minimum(np.append(begin[1:], n), starts[owner + 1] - a - span + 1)
        real = stop > begin
        begin, stop, owner = begin[real], stop[real], owner[real]
        if not len(begin):
            continue
        anchor = (anchors[begin] & _LOW).astype(np.int64)
        sums = np.concatenate([_ONE, np.cumsum(values * powers[: len(values)]) + _ONE])
        mark = (sums[stop + span - 1] - sums[begin]) * back[begin]
        mark = mixed(mark + mixed((stop - begin).astype(np.uint64) * np.uint64(256) + (anchor - begin).astype(np.uint64)))
        yield owner, begin + a - starts[owner], stop - begin, anchor - begin, hashes[anchor].view(np.int64), mark.view(np.int64)


#: a piece's place in its text: start (bits 32 on), windows (24 on), anchor's distance (16 on), bits of the text's second hash
PIECES = "key long, mark long, text_id long, place long"


def text_id() -> Column:
    return F.xxhash64("text")


def check_bits() -> Column:
    return F.hash("text").bitwiseAND(F.lit(0xFFFF)).cast("long")


def place_of(start, windows, before):
    return (start << 32) | (windows << 24) | (before << 16)


def unpacked(place: np.ndarray):
    return place >> 32, (place >> 24) & 0xFF, (place >> 16) & 0xFF, place & 0xFFFF


def texts_of(docs: DataFrame) -> DataFrame:
    texts = docs.select(text_or_empty().alias("text"))
    return texts.select(text_id().alias("text_id"), check_bits().alias("check"), "text")


def _cut_texts(gram: int, span: int, schema: str):
    fields = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            flat, starts = bytes_of(batch.column("text"))
            for owner, start, windows, before, key, mark in cut(flat, starts, gram, span):
                out = {"key": key, "mark": mark}
                if len(fields) > 1:
                    out["text_id"] = batch.column("text_id").to_numpy()[owner]
                    out["place"] = place_of(start, windows, before) | batch.column("check").to_numpy()[owner]
                yield as_batch({f.name: out[f.name] for f in fields}, fields)

    return run


def pieces(docs: DataFrame, gram: int, span: int) -> DataFrame:
    """Pieces whose key is met at least twice: key, mark, text_id, place, copies (how many equal texts)."""
    texts = texts_of(docs)
    keys = texts.select("text").mapInArrow(task(_cut_texts(gram, span, "key long"), ROWS), "key long")
    met = keys.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1").select("key")
    all_pieces = texts.mapInArrow(task(_cut_texts(gram, span, PIECES), ROWS), PIECES)
    listed = all_pieces.join(met, "key", "leftsemi")
    return listed.groupBy("key", "mark", "text_id", "place").agg(F.count("*").alias("copies"))


STRINGS = "key long, mark long, weight long, before int, bytes binary"


def _byte_strings(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte ranges of ``flat`` as a binary column."""
    owner, place = spans_of(lengths)
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    data = flat[begin[owner] + place]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bring(span: int):
    def run(batches):
        schema = arrow_schema(STRINGS)
        for batch in batches:
            flat, starts = bytes_of(batch.column("text"))
            key, counts = flat_list(batch.column("keys"))
            mark, weight, place = (flat_list(batch.column(c))[0] for c in ("marks", "weights", "places"))
            row = np.repeat(np.arange(batch.num_rows), counts)
            start, windows, before, _ = unpacked(place)
            for a in range(0, len(key), COLLECTION):
                s = slice(a, a + COLLECTION)
                texts = _byte_strings(flat, starts[row[s]] + start[s], windows[s] + span - 1)
                yield as_batch({"key": key[s], "mark": mark[s], "weight": weight[s], "before": before[s], "bytes": texts}, schema)

    return run


def strings(listed: DataFrame, docs: DataFrame, span: int) -> DataFrame:
    """The different pieces with their bytes: key, mark, weight, before (the anchor's distance), bytes."""
    check = F.col("place").bitwiseAND(F.lit(0xFFFF)).alias("check")
    one = listed.groupBy("key", "mark").agg(F.sum("copies").alias("weight"), F.min(F.struct("text_id", "place")).alias("at"))
    one = one.select("key", "mark", "weight", "at.*").select("*", check)
    wanted = one.groupBy("text_id", "check").agg(F.collect_list(F.struct("key", "mark", "weight", "place")).alias("p"))
    columns = [F.col(f"p.{c}").alias(f"{c}s") for c in ("key", "mark", "weight", "place")]
    texts = texts_of(docs).dropDuplicates(["text_id", "check"])
    with_text = texts.join(wanted, ["text_id", "check"]).select("text", *columns)
    return with_text.mapInArrow(task(_bring(span), ROWS), STRINGS)


FOUND = "key long, mark long, begin int, stop int"


def runs(flags: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags of strings that lie end to end: string, first place, place after the last."""
    owner, place = spans_of(lengths)
    fresh = place == 0
    begin = flags & (fresh | ~np.concatenate([[False], flags[:-1]]))
    after = np.append(fresh[1:], True) if len(flags) else fresh
    end = flags & (after | ~np.append(flags[1:], False))
    return owner[begin], place[begin], place[end] + 1


def _compare(span: int):
    def judged(rows: pa.Table, schema):
        flat, starts = bytes_of(rows.column("bytes").combine_chunks())
        lengths = np.diff(starts)
        before, weight = rows.column("before").to_numpy().astype(np.int64), rows.column("weight").to_numpy()
        hit = shared_windows(flat, lengths, before, span)
        owner, place = spans_of(lengths)
        hit |= (weight[owner] > 1) & (place <= lengths[owner] - span)
        string, begin, stop = runs(hit, lengths)
        at = pa.array(string)
        return as_batch({"key": rows.column("key").take(at), "mark": rows.column("mark").take(at), "begin": begin, "stop": stop}, schema)

    def run(batches):
        schema = arrow_schema(FOUND)
        held, n = [], 0
        for rows in grouped(batches, "key"):
            held.append(rows)
            n += rows.num_rows
            if n >= COLLECTION:
                yield judged(pa.concat_tables(held), schema)
                held, n = [], 0
        if held:
            yield judged(pa.concat_tables(held), schema)

    return run


CHILDREN = "parent_key long, parent_mark long, at int, key long, mark long, weight long, before int, bytes binary"


def _cut_strings(gram: int, span: int):
    def run(batches):
        schema = arrow_schema(CHILDREN)
        for batch in batches:
            flat, starts = bytes_of(batch.column("bytes"))
            for arrays in cut(flat, starts, gram, span):
                for a in range(0, len(arrays[0]), COLLECTION):
                    owner, start, windows, before, key, mark = (x[a : a + COLLECTION] for x in arrays)
                    of = pa.array(owner)
                    yield as_batch(
                        {
                            "parent_key": batch.column("key").take(of), "parent_mark": batch.column("mark").take(of), "at": start,
                            "key": key, "mark": mark, "weight": batch.column("weight").take(of), "before": before,
                            "bytes": _byte_strings(flat, starts[owner] + start, windows + span - 1),
                        },
                        schema,
                    )

    return run


def repeated(some: DataFrame, span: int, grams: tuple[int, ...], crowd: int) -> DataFrame:
    """key, mark, begin, stop of the runs of repeated windows of ``some`` (written; columns of STRINGS, cut by grams[0])."""
    last = len(grams) == 1  # grams of a whole window: a key has one string
    sizes = some.groupBy("key").agg(F.count("*").alias("n"))
    crowded = materialize(sizes.filter(F.lit(not last) & (F.col("n") > crowd)).select("key"), "crowded-keys")
    none = crowded.isEmpty()
    few = some if none else some.join(crowded, "key", "left_anti")
    found = few.repartition("key").sortWithinPartitions("key").mapInArrow(task(_compare(span)), FOUND)
    if none:
        return found
    many = some.join(crowded, "key", "leftsemi")
    children = materialize(many.mapInArrow(task(_cut_strings(grams[1], span), ROWS), CHILDREN), "cut-again")
    alike = children.groupBy("key", "mark").agg(F.sum("weight").alias("weight"), F.min("before").alias("before"), F.min("bytes").alias("bytes"))
    # a key met once has no window in common with another
    alike = materialize(alike, "alike")
    met = alike.groupBy("key").agg(F.sum("weight").alias("w")).filter("w > 1").select("key")
    below = repeated(materialize(alike.join(met, "key", "leftsemi"), "strings-again"), span, grams[1:], crowd)
    parents = children.select("parent_key", "parent_mark", "at", "key", "mark")
    above = parents.join(below, ["key", "mark"]).select(
        F.col("parent_key").alias("key"), F.col("parent_mark").alias("mark"),
        (F.col("at") + F.col("begin")).cast("int").alias("begin"), (F.col("at") + F.col("stop")).cast("int").alias("stop"),
    )
    return found.unionByName(above)


def repeats(docs: DataFrame, span: int = SPAN, grams: tuple[int, ...] = GRAMS, crowd: int = CROWD) -> DataFrame:
    """text_id, check and the runs of repeated windows (begins, stops) of every text that has any."""
    if grams[-1] != span or span - grams[0] >= 256:
        raise ValueError("the last grams must be as long as the span, the first at most 255 bytes shorter")
    listed = materialize(pieces(docs, grams[0], span), "pieces")
    found = repeated(materialize(strings(listed, docs, span), "strings"), span, grams, crowd)
    found = materialize(found, "repeated")
    start = F.shiftright("place", 32)
    back = listed.join(found, ["key", "mark"]).select(
        "text_id", F.col("place").bitwiseAND(F.lit(0xFFFF)).alias("check"),
        (start + F.col("begin")).alias("begin"), (start + F.col("stop")).alias("stop"),
    )
    runs_of = back.groupBy("text_id", "check").agg(F.collect_list(F.struct("begin", "stop")).alias("r"))
    return runs_of.select("text_id", "check", F.col("r.begin").alias("begins"), F.col("r.stop").alias("stops"))


def union_of(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in order that do not touch."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], begins[1:] > ends[:-1]])
    return begins[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, span_begins array<long>, span_ends array<long>, kept binary"


def _remove(span: int):
    def run(batches):
        schema = arrow_schema(REMOVED)
        for batch in batches:
            flat, starts = bytes_of(batch.column("text"))
            begins, counts = flat_list(batch.column("begins"))
            stops, _ = flat_list(batch.column("stops"))
            cuts = np.cumsum(counts) - counts
            kept, spans = [], []
            for i in range(batch.num_rows):
                text = flat[starts[i] : starts[i + 1]]
                if not counts[i]:
                    kept.append(text.tobytes())
                    spans.append((np.zeros(0, np.int64),) * 2)
                    continue
                s = slice(cuts[i], cuts[i] + counts[i])
                a, b = union_of(begins[s].astype(np.int64), stops[s].astype(np.int64) + span - 1)
                edges = [0, *np.stack([a, b], 1).reshape(-1).tolist(), len(text)]
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])))
                spans.append((a, b))
            number = np.array([len(a) for a, _ in spans], np.int64)
            a, b = (np.concatenate([x[k] for x in spans]) if spans else np.zeros(0, np.int64) for k in (0, 1))
            gone = np.add.reduceat(np.append(b - a, 0), np.minimum(np.cumsum(number) - number, len(a))) * (number > 0) if len(number) else number
            yield as_batch(
                {
                    "doc_id": batch.column("doc_id"), "n_bytes": np.diff(starts), "n_removed": gone, "n_spans": number,
                    "span_begins": list_array(a, number), "span_ends": list_array(b, number), "kept": pa.array(kept, pa.binary()),
                },
                schema,
            )

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, grams: tuple[int, ...] = GRAMS, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, span_begins, span_ends and kept (the bytes that stay) of every document."""
    gone = materialize(repeats(docs, span, grams, crowd), "repeats")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.select("doc_id", "text", text_id().alias("text_id"), check_bits().alias("check"))
    empty = F.array().cast("array<bigint>")
    rows = texts.join(gone, ["text_id", "check"], "left").select(
        "doc_id", "text", F.coalesce("begins", empty).alias("begins"), F.coalesce("stops", empty).alias("stops")
    )
    return rows.mapInArrow(task(_remove(span), ROWS), REMOVED)
