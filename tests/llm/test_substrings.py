"""Repeated byte strings and the transform built column by column, against counts of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intelweave.llm import bwt, queries, substrings
from test_edges import CLASH, ROWS


def flat_of(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=18).map(lambda x: bytes(c % 3 for c in x)), st.integers(0, 4)), max_size=12), st.integers(2, 7), st.data())
def test_shared_windows_against_counts(items, span, data):
    band = data.draw(st.integers(1, span - 1))
    items += items[:2]
    items = [(x, min(b, len(x) - 1)) for x, b in items]
    counts = Counter((i - b, x[i : i + span]) for x, b in items for i in range(len(x) - span + 1))
    want = [i + span <= len(x) and counts[i - b, x[i : i + span]] > 1 for x, b in items for i in range(len(x))]
    got = bwt.shared_windows(*flat_of([x for x, _ in items]), np.array([b for _, b in items], np.int64), span, band)
    assert got.tolist() == want


def test_transform_and_prefixes_of_a_band():
    """One band over whole strings is the transform of all their suffixes, with the common prefixes of neighbours."""
    rng = random.Random(5)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 9))) for _ in range(7)]
    m = len(words)
    last = np.array([w[-1] - 96 for w in words], np.uint8)
    band = bwt.Band(m, last, np.zeros(m, np.uint8), 100)
    places = np.arange(m)
    for k in range(1, 9):
        on = np.array([i for i, w in enumerate(words) if len(w) >= k])
        if len(on):
            left = np.array([words[i][-k - 1] - 96 if len(words[i]) > k else 0 for i in on], np.uint8)
            places[on] = band.insert(places[on], left)
    # rank 0, 1, ... of the end marks before all symbols
    suffixes = sorted(([c - 96 + 100 for c in w[len(w) - k :]] + [i], len(w) - k, w) for i, w in enumerate(words) for k in range(len(w) + 1))
    assert band.symbols.tolist() == [w[at - 1] - 96 if at else 0 for _, at, w in suffixes]
    common = lambda a, b: next(i for i in range(99) if a[i] != b[i])
    assert band.prefixes[1:].tolist() == [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]


def windows_of(texts, span):
    counts = Counter()
    for x in texts:
        for i in range(len(x) - span + 1):
            counts[x[i : i + span]] += 1
    return counts


def plain(rows, span):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = windows_of([t for _, t in texts], span)
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - span + 1):
            if counts[t[a : a + span]] > 1:
                gone[a : a + span] = True
        runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)


SMALL = {"span": 20, "grams": (6, 12, 16, 20)}


def made_up(n=120):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    common = [" ".join(word() for _ in range(rng.randrange(3, 20))) for _ in range(8)]
    rows = [(i, " ".join(rng.choice([word(), word(), rng.choice(common)]) for _ in range(rng.randrange(0, 25)))) for i in range(n)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(30)]  # copies
    rows += [(2000 + i, rows[7][1][: 40 + i] + word() + rows[7][1][40 + i :]) for i in range(40)]  # near copies
    rows += [(3000, "a" * 300), (3001, "ab" * 150), (3002, "aab" * 90 + "x" + "aab" * 90), (3003, "é" * 40)]
    return rows


@pytest.mark.parametrize("crowd", [1000, 3])
def test_removed_bytes_against_all_windows(spark, crowd):
    rows = made_up() + ROWS[:5] + [r for r in ROWS if r[0] in (5, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(df, crowd=crowd, **SMALL).collect()
    assert digest(got) == plain(rows, 20)
    for r in got:
        assert sum(b - a for a, b in zip(r.span_begins, r.span_ends)) == r.n_removed and len(r.span_begins) == r.n_spans


def test_chunks_of_a_long_text_do_not_change_windows(spark, monkeypatch):
    rows = made_up(40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flat, starts = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8), np.array([0, *np.cumsum([len(t.encode()) for _, t in rows])])
    def windows():
        return {(o, s + w) for part in substrings.cut(flat, starts, 6, 20) for o, s, n in zip(*part[:3]) for w in range(n)}
    whole = windows()
    monkeypatch.setattr(substrings, "CHUNK", 37)
    assert windows() == whole == {(o, s) for o, (_, t) in enumerate(rows) for s in range(len(t.encode()) - 19)}


def test_production_span_on_the_given_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert digest(substrings.remove_repeats(df).collect()) == plain([tuple(r) for r in df.collect()], 200)
    got = queries.QUERIES["op11_suffix_array_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain([tuple(r) for r in df.collect()], 200)


def test_edges(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.select("*", *(F.lit("z").alias(c) for c in CLASH + ["mark", "place", "check", "begins", "kept", "weight"])).repartition(3)
    got = {(r.doc_id, r.n_bytes): r for r in substrings.remove_repeats(df).collect()}
    assert len(got) == len(ROWS) - 1  # the repeated row
    assert got[4, len(ROWS[5][1])].n_removed == len(ROWS[5][1]) and got[6, 20000].kept == b""
    assert got[1, 0].n_removed == got[2, 0].n_removed == 0 and got[8, 16].kept == b"One line of text"
    assert substrings.remove_repeats(df.limit(0)).count() == 0
