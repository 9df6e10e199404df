"""Best-fit packing of documents into sequences by linear grouping.

1. Every text is tokenized once; longer documents are cut into pieces of one
   sequence.  Pieces (ids only as checksums) are written to the shared folder.
2. The histogram of piece lengths, at most ``capacity`` rows whatever the
   corpus, goes to the driver.  There:
   a. large lengths are sorted and cut into groups of equal cardinality, and
      each is rounded up to the largest of its group;
   b. configurations of these few sizes are optimised: column generation on
      the covering linear program, with a knapsack over the sizes;
   c. actual lengths take the places of the rounded ones, so that space comes
      back; and small lengths go, largest first, each into the sequence with
      the least room that holds it, new sequences being opened when none does.
   Sequences of one kind are handled as one run, so that the work depends on
   the capacity and the groups, not on the number of documents.
3. The result is a list of runs (length, first rank, number, sequence, offset).
   Pieces of a length are ranked in Spark: a count by length and salt, then a
   row number inside each salt, so no length is sorted by one task.  A piece's
   sequence and offset follow from its rank.

Defined results: a null text counts as empty (one separator token); repeated
rows and null ids are pieces of their own; an empty table gives no rows;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, materialize, shared_in_stage, task

MODEL = "word_bpe_49k.json"
SEPARATOR = 0
CAPACITY = 2048
GROUPS = 64  # sizes that configurations are made of
LARGE = (0.25, 0.45)  # of the capacity: shorter pieces are packed by best fit; the plan with fewer sequences is used
SALTS = 1024
CACHE = 1_000_000  # distinct strings a worker keeps the ids of, while it works on one stage
MARK = "\ue000"  # stands between strings that are encoded together; one that holds it is encoded alone
#: letters that stay one letter in NFC and lower case
PLAIN = re.compile("[a-zA-ZÀ-ÖØ-öø-įı-ɏ]+").fullmatch
APART = re.compile("(?<=[a-zA-ZÀ-ÖØ-öø-ÿ])([.,])(?=[ \n]|$(?!\n))")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check_tokenizer(path: str) -> None:
    """Raise unless the cuts of ``encoder`` are exact for this tokenizer.

    It must normalise by NFC, white space to one space and lower case, in this
    order, take runs of letters as words and drop white space, and mark the end
    of a word in its last token; no token may hold white space.
    """
    parts = json.loads(tokenizer(path).to_str())
    steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
    cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = cuts[0] if cuts and cuts[0]["type"] == "Split" else {}
    model = parts["model"]
    held = [
        steps == ["NFC", "Replace", "Lowercase"],
        split.get("invert") is True and split.get("behavior") == "Removed" and r"[\p{L}]+" in split["pattern"].get("Regex", ""),
        model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout"),
        not any(c.isspace() for t in (*model["vocab"], *(a["content"] for a in parts["added_tokens"])) for c in t),
        not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in parts["added_tokens"]),
        parts["truncation"] is None and parts["padding"] is None,
    ]
    if not all(held):
        raise ValueError(f"texts cannot be cut at spaces for the tokenizer at {path}")


def encoder(path: str):
    """Texts to ids as little-endian bytes.

    No token and no normalisation of this tokenizer reaches across a space or a
    line feed, so a text's ids are those of the strings between them; each
    distinct one is encoded once while the cache holds it.  To have fewer
    distinct ones, ASCII texts are put in lower case, as the tokenizer does,
    and a full stop or comma between a Latin letter and a space is set apart:
    the tokenizer splits there as well.  A text that holds an added token in
    other letters keeps its case, as the tokenizer looks for those before.
    """
    tok, known = tokenizer(path), shared_in_stage("ids")
    added = re.compile("|".join(re.escape(t.content) for t in tok.get_added_tokens_decoder().values()) or "(?!)")
    mark = np.array(tok.encode(MARK, add_special_tokens=False).ids, "<u4")
    ends_word = np.zeros(tok.get_vocab_size(), bool)
    ends_word[[i for piece, i in tok.get_vocab().items() if piece.endswith("</w>")]] = True

    def cut(flat: bytes, strings, starts, stops) -> None:
        for c, x, y in zip(strings, starts, stops, strict=True):
            known[c] = flat[4 * x : 4 * y]

    def learn(new: list[str]) -> None:
        # one run of letters is one word of the tokenizer, and its last token says so
        plain, marked = [], []
        for c in new:
            if MARK in c:
                known[c] = np.array(tok.encode(c, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                (plain if c.isalpha() and (c.isascii() or PLAIN(c)) else marked).append(c)
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = np.array(tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(ends_word[ids]) + 1
            cut(ids.tobytes(), some, [0, *stops[:-1]], stops)
        for a in range(0, len(marked), 2000):
            some = marked[a : a + 2000]
            ids = np.array(tok.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, "<u4")
            hit = np.ones(max(len(ids) - len(mark) + 1, 0), bool)
            for k, m in enumerate(mark):
                hit &= ids[k : k + len(hit)] == m
            at = np.flatnonzero(hit)
            cut(ids.tobytes(), some, [0, *(at + len(mark))], [*at, len(ids)])

    def lowered(text: str) -> str:
        low = text.lower() if text.isascii() else text
        return text if added.search(low) else low

    def encode(texts: list[str]) -> list[bytes]:
        chunks = [APART.sub(r" \1", lowered(t)).replace("\n", " ").split(" ") for t in texts]
        wanted = set().union(*chunks)
        if len(known) + len(wanted) > CACHE:
            known.clear()
        learn([c for c in wanted if c not in known])
        return [b"".join([known[c] for c in cs]) for cs in chunks]

    return encode


def cut_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    def run(batches):
        schema = arrow_schema(PIECES)
        encode = encoder(path)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = batch.column("row").to_pylist()
            out = {k: [] for k in schema.names}
            for a in range(0, len(texts), 512):
                ids = encode([t or "" for t in texts[a : a + 512]])
                for doc_id, row, got in zip(doc_ids[a : a + 512], rows[a : a + 512], ids):
                    got += SEPARATOR.to_bytes(4, "little")
                    for k, start in enumerate(range(0, len(got), 4 * capacity)):
                        part = got[start : start + 4 * capacity]
                        values = (doc_id, k, start // 4, len(part) // 4, zlib.crc32(part), row)
                        for name, v in zip(schema.names, values):
                            out[name].append(v)
            yield as_batch(out, schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row"))
    return rows.mapInArrow(task(run, 1000), PIECES)


# The plan: everything below works on the histogram alone.


def equal_groups(hist: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths, longest first, in groups of equal cardinality: (size of the group, its lengths and counts)."""
    total = sum(hist.values())
    each = max(1, -(-total // groups))
    out, room = [], 0
    for length in sorted(hist, reverse=True):
        count = hist[length]
        while count:
            if not room:
                out.append((length, []))
                room = each
            take = min(room, count)
            out[-1][1].append((length, take))
            room -= take
            count -= take
    return out


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Unbounded knapsack: the most valuable multiset of sizes that fits."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.array(sizes)
    smallest = min(sizes)
    for room in range(smallest, capacity + 1):
        fits = np.flatnonzero(order <= room)
        got = best[room - order[fits]] + values[fits]
        k = int(np.argmax(got))
        if got[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = got[k], fits[k]
        else:
            best[room] = best[room - 1]
    counts, room = [0] * len(sizes), capacity
    while room >= smallest:
        if choice[room] < 0:
            room -= 1
            continue
        counts[choice[room]] += 1
        room -= sizes[choice[room]]
    return float(best[capacity]), counts


def solve_cover(columns: np.ndarray, demand: np.ndarray, basis: list[int]):
    """Primal simplex for min sum x, columns @ x = demand, x >= 0, from a feasible basis."""
    for _ in range(20 * len(demand) + 200):
        inverse = np.linalg.inv(columns[:, basis])
        x, price = inverse @ demand, np.ones(len(basis)) @ inverse
        gain = price @ columns - 1
        enter = int(np.argmax(gain))
        if gain[enter] <= 1e-9:
            break
        direction = inverse @ columns[:, enter]
        ratio = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[leave] = enter
    return basis, x, price


def configurations(groups, capacity: int) -> list[tuple[list[int], int]]:
    """(pieces of each group in a sequence, number of such sequences); together they hold every large piece."""
    sizes = [g[0] for g in groups]
    merged = sorted(set(sizes), reverse=True)  # groups of one size are one size to the program
    demand = np.array([float(sum(n for s, rows in groups if s == size for _, n in rows)) for size in merged])
    columns = np.diag([float(capacity // s) for s in merged])
    basis = list(range(len(merged)))
    for _ in range(12 * len(merged)):
        basis, x, price = solve_cover(columns, demand, basis)
        value, counts = best_configuration(merged, price, capacity)
        if value <= 1 + 1e-6:
            break
        columns = np.column_stack([columns, counts])
    left = demand.astype(np.int64).copy()
    out = []
    for k, amount in sorted(zip(basis, x), key=lambda kx: -kx[1]):
        column = columns[:, k].astype(np.int64)
        n = min([int(np.floor(amount + 1e-7)), *(int(left[i] // column[i]) for i in np.flatnonzero(column))])
        if n > 0:
            out.append(([int(c) for c in column], n))
            left -= column * n
    # what rounding down left over: filled greedily, a few sequences at most for each size
    while left.any():
        room, column = capacity, np.zeros(len(merged), np.int64)
        for i, s in enumerate(merged):
            column[i] = min(left[i], room // s)
            room -= column[i] * s
        n = max(1, min(int(left[i] // column[i]) for i in np.flatnonzero(column)))
        out.append(([int(c) for c in column], n))
        left -= column * n
    # back from sizes to actual lengths: those of one size are handed out longest first
    return merged, out


class Runs:
    """Runs of like sequences (first sequence, number) by the room they have left."""

    def __init__(self):
        self.rooms: list[int] = []  # sorted
        self.by_room: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, number: int) -> None:
        if not number:
            return
        if room not in self.by_room:
            bisect.insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append((first, number))

    def least(self, length: int) -> tuple[int, int, int] | None:
        """Take out a run with the least room that holds ``length``."""
        i = bisect.bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        runs = self.by_room[room]
        first, number = runs.pop()
        if not runs:
            del self.by_room[room]
            self.rooms.pop(i)
        return room, first, number


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE[0]) -> list[tuple]:
    """(length, first rank, number, first sequence, offset, in each sequence) of runs that hold every piece once."""
    placed: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(hist, 0)
    runs, sequences = Runs(), 0

    def put(length: int, number: int, first: int, offset: int) -> None:
        placed.append((length, ranks[length], number, first, offset))
        ranks[length] += number

    big = {s: n for s, n in hist.items() if s >= max(2, large * capacity)}
    small = {s: n for s, n in hist.items() if s not in big}
    if big:
        grouped = equal_groups(big, groups)
        merged, configs = configurations(grouped, capacity)
        supply = {s: [] for s in merged}  # actual lengths of each size, longest last
        for size, rows in grouped:
            supply[size] += rows
        for size in supply:
            supply[size] = [list(r) for r in sorted(supply[size])]
        for counts, number in configs:
            slots = [s for s, c in zip(merged, counts) for _ in range(c)]
            # each place of the configuration is a strip over its sequences, cut where the actual length changes
            strips = []
            for size in slots:
                strip, need = [], number
                while need:
                    length, have = supply[size][-1]
                    take = min(need, have)
                    strip.append((length, take))
                    need -= take
                    supply[size][-1][1] -= take
                    if not supply[size][-1][1]:
                        supply[size].pop()
                strips.append(strip)
            cuts = sorted({int(c) for strip in strips for c in np.cumsum([n for _, n in strip])})
            at, heads = 0, [[0, 0] for _ in strips]  # the strip's row, and how much of it is used
            for cut in cuts:
                n, offset = cut - at, 0
                for strip, head in zip(strips, heads):
                    length, have = strip[head[0]]
                    put(length, n, sequences + at, offset)
                    offset += length
                    head[1] += n
                    if head[1] == have:
                        head[0], head[1] = head[0] + 1, 0
                runs.add(capacity - offset, sequences + at, n)
                at = cut
            sequences += number
    for length in sorted(small, reverse=True):
        left = small[length]
        while left:
            got = runs.least(length)
            if got is None:
                each = capacity // length
                got = capacity, sequences, -(-left // each)
                sequences += got[2]
            room, first, number = got
            each = min(room // length, left)
            use = min(number, left // each)
            for k in range(each):
                put(length, use, first, capacity - room + k * length)
            left -= use * each
            runs.add(room - each * length, first, use)
            runs.add(room, first + use, number - use)
    return placed


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, salts: int = SALTS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    path = path or model_path()
    check_tokenizer(path)
    pieces = materialize(cut_pieces(docs, path, capacity), "pieces")
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = materialize(counts, "piece-counts")  # at most capacity x salts rows
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plans = [plan(hist, capacity, groups, large) for large in LARGE]
    placed = min(plans, key=lambda p: max((first + number for _, _, number, first, _ in p), default=0))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("row", "doc_id", "piece")
    ranked = pieces.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    # runs by length and first rank; a piece belongs to the last one that starts at or before its rank
    placed.sort()
    table = np.array(placed, np.int64).reshape(-1, 5)
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def run(batches):
        schema = arrow_schema(columns)
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            out = {k: batch.column(k) for k in schema.names[:5]}
            out["sequence_id"] = table[at, 3] + rank - table[at, 1]
            out["offset"] = table[at, 4]
            yield as_batch(out, schema)

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(task(run), columns)
