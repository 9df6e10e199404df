"""Token counts: each distinct pre-token is counted once, documents add up their pre-tokens.

The vocabulary has no piece with a space after another character and none with
a line feed, so a merge never crosses the start of a run of spaces or a line
feed.  Cut there, a text's count is the sum over its pre-tokens.

1. Blocks of documents (one Arrow batch each) become an inverted index: one row
   per block and distinct pre-token, with the documents of the block that hold
   it and how often.  This is the map-side combine: a pre-token that every
   document uses leaves a block as one row.
2. Rows meet by pre-token, sorted; every distinct pre-token is encoded once and
   its count joined to the frequencies.  Each task sums by document before it
   sends anything on.
3. Sums meet by block and become one row per document.

No ids are kept anywhere.  Blocks are told apart by partition and batch number
of the scan, which a recomputed task repeats.

Defined results: null and empty texts have zero bytes and tokens; repeated rows
and null ids each keep their own row; columns other than doc_id and text are
ignored; an empty table gives no rows.  Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, codes_of, spans_of, task

MODEL = "piece_bpe_32k.model"
#: sums held per task before they are sent on
HELD_SUMS = 4_000_000

PRE_TOKEN = re.compile(r" +[^ \n]*|[^ \n]+|\n")
#: documents of a block, at most; their numbers fit two bytes
BLOCK_DOCS = 32_768
#: token null: the block's side row, with its ids and sizes
INDEX = "token string, block long, posts binary"
SUMS = "block long, side boolean, posts binary"
COUNTED = np.uint16(0xFFFF)


def binary_column(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Rows of ``lengths`` items of a flat array, as binary."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * flat.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def binary_items(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The items of all rows end to end, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    return data.view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize


def write_posts(docs: np.ndarray, counts: np.ndarray, per_row: np.ndarray) -> pa.Array:
    """Postings, two bytes a number: documents alone where all counts are one, else a mark, documents, counts."""
    starts = np.cumsum(per_row) - per_row
    counted = np.maximum.reduceat(counts, starts) > 1
    lengths = np.where(counted, 2 * per_row + 1, per_row)
    first = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.uint16)
    owner, place = spans_of(per_row)
    at = first[owner] + place + counted[owner]
    flat[first[counted]] = COUNTED
    flat[at] = docs
    also = counted[owner]
    flat[at[also] + per_row[owner[also]]] = counts[also]
    return binary_column(flat, lengths)


def read_posts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, counts and the postings of each row."""
    flat, lengths = binary_items(column, np.uint16)
    first = np.cumsum(lengths) - lengths
    counted = flat[first] == COUNTED
    per_row = np.where(counted, (lengths - 1) // 2, lengths)
    owner, place = spans_of(per_row)
    at = first[owner] + place + counted[owner]
    also = counted[owner]
    counts = np.ones(len(owner), np.int64)
    counts[also] = flat[at[also] + per_row[owner[also]]]
    return flat[at].astype(np.int64), counts, per_row


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_model(path: str) -> None:
    """Raise unless the cuts are exact for this model."""
    sp = processor(path)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if re.search("[^▁]▁|\n", piece):
            raise ValueError(f"piece {piece!r} crosses a pre-token border")


def pre_tokens(text: str) -> list[str]:
    """The model reads a space before the text; the space mark itself is a space to it."""
    return PRE_TOKEN.findall(" " + text.replace("▁", " ")) if text else []


def count_pieces(tokens: list[str], path: str) -> np.ndarray:
    """Pieces of each pre-token as part of a text.

    The library puts a space before whatever it reads.  A pre-token that starts
    with spaces gives one of them away for it; any other is read after a line
    feed, whose two pieces (the space and the line feed) are taken off.
    """
    sp = processor(path)
    spaced = [t[0] == " " for t in tokens]
    ids = sp.encode([t[1:] if s else "\n" + t for t, s in zip(tokens, spaced)], num_threads=1)
    # a lone space is the empty text to the library
    return np.array([(len(x) if t != " " else 1) if s else len(x) - 2 for x, s, t in zip(ids, spaced, tokens)], np.int64)


def _numbered(column, at_once: int = 500):
    """A number for each pre-token of all texts, its text, and the distinct pre-tokens; strings of few texts at a time."""
    codes, owners, tables, known = [], [], [], 0
    for a in range(0, len(column), at_once):
        words, lengths = [], []
        for t in column.slice(a, at_once).to_pylist():
            w = pre_tokens(t) if t else []
            lengths.append(len(w))
            words += w
        some, table = codes_of(words)
        codes.append((some + known).astype(np.int32))
        owners.append(np.repeat(np.arange(a, a + len(lengths), dtype=np.int32), lengths))
        tables.append(table)
        known += len(table)
    if not known:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    merged = pa.concat_arrays(tables).dictionary_encode()
    codes = merged.indices.to_numpy().astype(np.int64)[np.concatenate(codes)]
    return codes, np.concatenate(owners), merged.dictionary


def _index(batches):
    schema = arrow_schema(INDEX)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    number = 0
    for whole in batches:
        for cut in range(0, whole.num_rows, BLOCK_DOCS):
            batch = whole.slice(cut, BLOCK_DOCS)
            n, block, number = batch.num_rows, (part << 32) + number, number + 1
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            ids = batch.column("doc_id")
            side = np.concatenate([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(False), sizes.to_numpy()]).astype(np.int64)
            yield as_batch({"token": pa.nulls(1, pa.string()), "block": [block], "posts": [side.tobytes()]}, schema)
            codes, owner, distinct = _numbered(batch.column("text"))
            if not len(codes):
                continue
            cells, counts = np.unique(codes * n + owner, return_counts=True)
            del codes, owner
            # a count beyond two bytes is several postings
            more = -(-counts // 65535)
            cells, nth = np.repeat(cells, more), spans_of(more)[1]
            counts = np.minimum(np.repeat(counts, more) - 65535 * nth, 65535)
            per_token = np.bincount(cells // n, minlength=len(distinct))
            yield as_batch(
                {
                    "token": distinct, "block": np.full(len(distinct), block),
                    "posts": write_posts(cells % n, counts, per_token),
                },
                schema,
            )


def _count(path: str):
    def run(batches):
        schema = arrow_schema(SUMS)
        held: dict[int, np.ndarray] = {}
        size = 0

        def sums():
            for block, totals in held.items():
                docs = np.flatnonzero(totals)
                posts = docs.astype(np.uint16).tobytes() + totals[docs].astype(np.uint64).tobytes()
                yield as_batch({"block": [block], "side": [False], "posts": [posts]}, schema)

        last, last_n = None, 0
        for batch in batches:
            tokens = batch.column("token")
            sides = batch.filter(pc.is_null(tokens))
            if sides.num_rows:
                yield as_batch({"block": sides.column("block"), "side": [True] * sides.num_rows, "posts": sides.column("posts")}, schema)
            batch = batch.filter(pc.is_valid(tokens))
            if not batch.num_rows:
                continue
            # rows are sorted by token: each run of equal tokens is encoded once
            run_ends = pc.run_end_encode(batch.column("token"))
            runs = run_ends.values.to_pylist()
            ends = run_ends.run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
            known = runs[0] == last
            pieces = count_pieces(runs[known:], path)
            if known:
                pieces = np.concatenate([[last_n], pieces])
            last, last_n = runs[-1], pieces[-1]
            per_row = np.repeat(pieces, np.diff(ends, prepend=0))
            docs, counts, lengths = read_posts(batch.column("posts"))
            weighted = counts * np.repeat(per_row, lengths)
            blocks = np.repeat(batch.column("block").to_numpy(), lengths)
            order = np.argsort(blocks, kind="stable")
            blocks, docs, weighted = blocks[order], docs[order], weighted[order]
            cuts = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1))
            for a, b in zip(cuts, [*cuts[1:], len(blocks)]):
                got = np.bincount(docs[a:b], weights=weighted[a:b]).astype(np.int64)
                old = held.get(int(blocks[a]))
                if old is None or len(old) < len(got):
                    size += len(got) - (0 if old is None else len(old))
                    if old is not None:
                        got[: len(old)] += old
                    held[int(blocks[a])] = got
                else:
                    old[: len(got)] += got
            if size > HELD_SUMS:
                yield from sums()
                held, size = {}, 0
        yield from sums()

    return run


def _gather(limit: int, columns: str):
    def block_rows(side: bytes, parts: list[bytes], schema):
        n = len(side) // 24
        ids, null, sizes = np.frombuffer(side, np.int64).reshape(3, n)
        totals = np.zeros(n, np.int64)
        for x in parts:
            k = len(x) // 10
            docs = np.frombuffer(x, np.uint16, k)
            totals[docs] += np.frombuffer(x[2 * k :], np.uint64, k).astype(np.int64)
        out = {"doc_id": pa.array(ids, mask=null.astype(bool)), "n_bytes": sizes, "n_tokens": totals}
        return as_batch(out | {"over_limit": totals > limit}, schema)

    def run(batches):
        schema = arrow_schema(columns)
        block, side, parts = None, None, []
        for batch in batches:
            for b, is_side, posts in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "posts"))):
                if b != block:
                    if block is not None:
                        yield block_rows(side, parts, schema)
                    block, side, parts = b, None, []
                if is_side:
                    side = posts
                else:
                    parts.append(posts)
        if block is not None:
            yield block_rows(side, parts, schema)

    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    path = path or model_path()
    check_model(path)
    index = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task(_index), INDEX)
    # a block's side row has no token; it is dealt out by its block instead
    meet = F.coalesce("token", F.concat(F.lit("\n"), F.col("block").cast("string")))
    sums = index.repartition(meet).sortWithinPartitions("token").mapInArrow(task(_count(path)), SUMS)
    columns = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return sums.repartition("block").sortWithinPartitions("block").mapInArrow(task(_gather(limit, columns)), columns)
