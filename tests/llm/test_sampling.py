"""Importance resampling and fill-in-middle against plain Python, text by text."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intelweave.llm import fim, queries, resampling

from test_edges import CLASH, ROWS

MORE = [(20, "ÀB word <P x <S> y"), (21, "a <M> b"), (22, "<"), (23, "é" * 7), (24, "<P"), (25, "P> S> <S <M"), (None, "twice"), (None, "twice")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS + MORE, "doc_id long, text string")
    return df.select("*", *(F.lit("z").alias(c) for c in CLASH + ["n", "form", "first", "second", "h", "nth", "part", "word"])).repartition(3)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features_of(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, n, buckets, min_words, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features_of(x, n)) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(S + buckets) / (float(s[b] + 1) * float(T + buckets))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features_of(x, n)
        weight = sum(gain(bucket(k)) for k in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None, len(words_of(x)) >= min_words])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("n, min_words, percent", [(1, 1, 100), (2, 2, 50), (3, 1, 40)])
def test_resampling_against_plain_counts(spark, docs, n, min_words, percent):
    target = [None, "", "The cat sat", "word one line of text é漢字"]
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(docs, bench, n=n, buckets=50, min_words=min_words, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(ROWS + MORE, target, n, 50, min_words, percent)


def test_resampling_on_the_given_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = plain_resample([tuple(r) for r in rows.collect()], [r.text for r in bench.collect()], 2, 10_000, 20, 10)
    got = resampling.resample(rows.repartition(5), bench, n=2).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_resampling_of_empty_tables(spark, docs):
    bench = spark.createDataFrame([("a b c",)], "text string")
    assert resampling.resample(docs.limit(0), bench).count() == 0
    got = resampling.resample(docs, bench.limit(0), min_words=1).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(ROWS + MORE, [], 1, 10_000, 1, 10)
    out = resampling.draw(docs, bench, min_words=1, percent=100)
    assert out.columns == docs.columns and out.count() == sum(bool(words_of(x)) or i is None for i, x in ROWS + MORE)


def test_slices_of_a_batch_do_not_change_runs(monkeypatch, spark, docs):
    bench = spark.createDataFrame([("the cat",)], "text string")
    whole = sorted(map(tuple, resampling.resample(docs, bench, n=2).collect()), key=repr)
    monkeypatch.setattr(resampling, "sliced", lambda batch, name: fim.sliced(batch, name, 5))
    assert sorted(map(tuple, resampling.resample(docs, bench, n=2).collect()), key=repr) == whole


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fim_against_slices(spark, docs):
    got = fim.restore(fim.fill_in_middle(docs)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((plain_fim(*r) for r in ROWS + MORE), key=repr)
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.restored) for r in got), key=key) == sorted(((i, t or "") for i, t in ROWS + MORE), key=key)
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_fim_takes_every_form(spark):
    rows = [(i, f"näme {i} <P <S <M> >"[: i % 17]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.restore(fim.fill_in_middle(df)).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(plain_fim(*r) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(dict(rows)[r.doc_id] == r.restored for r in got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("<PSM>é漢a", max_size=9), st.integers(0, 9), st.integers(0, 9), st.integers(0, 2)), max_size=6))
def test_scatter_and_gather_are_inverse(items):
    items = [(t, *sorted((a % (len(t) + 1), b % (len(t) + 1))), 0 if any(m in t for m in ("<P>", "<S>", "<M>")) else f) for t, a, b, f in items]
    flat, starts = fim.bytes_of(pa.array([t for t, *_ in items], pa.string()))
    cuts = [fim.code_point_bytes(flat, starts, np.array([x[k] for x in items], np.int64)) for k in (1, 2)]
    form = np.array([x[3] for x in items], np.int64)
    out, out_starts = fim.scatter(flat, starts, *cuts, form)
    want = [t if f == 0 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" if f == 1 else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" for t, a, b, f in items]
    assert fim.strings_of(out, out_starts).to_pylist() == want
    assert fim.strings_of(*fim.gather(out, out_starts, form)).to_pylist() == [t for t, *_ in items]


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_fill_in_middle"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())
