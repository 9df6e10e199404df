"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from intelweave.llm import chat, langid, lines, packing, pages, pii, repetition, simhash, tiling, tokens

LONG = "the cat sat on the mat, and then it went away again. " * 3000
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (None, "no id here at all"), (None, None),
    (4, LONG), (5, "one line of text\nanother line of text"), (5, "one line of text\nanother line of text"),
    (6, "x" * 20000), (7, "a\x00b ﻿ é漢字🙂"), (8, "One line of text"),
]
CLASH = (
    "lang source n_chars id key line doc doc_key gone_lines row_key row salt length piece token block word has_letter lang_pred lang_score score "
    "component_id fingerprint print kept held_out"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit("en" if c == "lang" else "z").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "and then it went away again the cat sat"), (2, None), (3, ""), (None, "one two")]
    return spark.createDataFrame(rows, "item_id long, text string")


def model(docs):
    return langid.train(docs, F.lit(True), steps=3)


PER_ROW = {
    "langid": lambda d: langid.predict(d, model(d)),
    "repetition": repetition.repetition_rules,
    "tokens": tokens.count_tokens,
    "simhash": simhash.simhash_groups,
    "pii": pii.personal_data,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_a_result(docs, name):
    got = PER_ROW[name](docs).collect()
    key = lambda x: (x is None, x)
    assert sorted((r.doc_id for r in got), key=key) == sorted((i for i, _ in ROWS), key=key)
    assert PER_ROW[name](docs.limit(0)).count() == 0


def test_language_without_letters_or_labels(docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[8][0] == "en"
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(blank).collect()} == {"und"}


def test_packing(docs):
    got = packing.pack(docs).collect()
    assert sorted(r.length for r in got if r.doc_id in (1, 2, 3)) == [1, 1, 1]
    assert sum(r.doc_id == 5 for r in got) == 2
    assert max(r.length for r in got) == packing.CAPACITY
    assert packing.pack(docs.limit(0)).count() == 0


def test_lines(docs):
    got = lines.line_groups(docs).collect()
    assert not [r for r in got if r.doc_id in (1, 2, 3)]
    # of equal lines the first stays; a repeated row is one document
    assert {(r.doc_id, r.line_no): r.kept for r in got if r.doc_id in (5, 8)} == {(5, 0): True, (5, 1): True, (8, 0): False}
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(i) for i, _ in ROWS if i != 8)
    assert out.filter("doc_id = 5").first().doc_key == "z"
    assert lines.line_groups(docs.limit(0)).count() == 0


def test_simhash_groups_and_first(docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(docs).collect()}
    zero = "0" * 16
    assert got[1, zero] == got[2, zero] == got[3, zero] == got[None, zero] == 1
    out = simhash.first_of_groups(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "5", "6", "7", "8", "None"]


def test_tiling(docs, bench):
    got = tiling.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.coverage) for r in got] == [(4, 1, 1.0)]
    assert tiling.decontaminate(docs, bench).count() == len(ROWS) - 1
    assert tiling.contaminated(docs, bench.limit(0)).count() == 0
    assert tiling.contaminated(docs.limit(0), bench).count() == 0


def test_pages(spark):
    page = "<html><body><nav>Menu</nav><article><h1>T &amp;\n t</h1><p>Text</article><footer>f</footer>"
    rows = [(1, "http://a.b/x/1", page), (1, "http://a.b/x/1", page), (2, None, page), (3, "http://a.b/x/2", None),
            (None, "http://a.b/x/3", ""), (4, "nonsense", "<p>a</p><" + "b" * 9), (5, "http://a.b/x/4", "<div>" * 5000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shared", F.lit(1)).withColumn("page", F.lit(2))
    got = pages.main_text(df).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == sorted(
        [("1", "T & t Text", 10)] * 2 + [("2", "T & t Text", 10), ("3", "", 0), ("None", "", 0), ("4", "a <bbbbbbbbb", 12), ("5", "deep", 4)]
    )
    assert pages.main_text(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (None, None, "assistant", "y"), (2, 0, "user", "q"), (2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(1))
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(df)).collect()}
    assert (got[1].n_turns, got[None].n_turns, got[2].n_turns) == (2, 1, 2)
    assert got[None].loss_chars == 1 and not any(r.valid for r in got.values())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_pipeline_on_edges(spark, docs, bench, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {5, 6, 7, None}
    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df.limit(0), str(tmp_path))
        assert df.columns == docs.columns and df.count() == 0


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op") and q[2:3].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_packing_reads_added_tokens_as_the_tokenizer_does():
    tok, encode = packing.tokenizer(packing.model_path()), packing.encoder(packing.model_path())
    rng = random.Random(4)
    parts = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|StartOfText|>", "a", "B", " ", ".", ",", "\n", "Hello", "don't", "'S", "12", "É", "<|", "|>", "x.", " the"]
    for _ in range(1000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        assert np.frombuffer(encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_packing_refuses_a_tokenizer_that_cannot_be_cut_at_spaces():
    path = packing.model_path()
    packing.check_tokenizer(path)
    with pytest.raises(ValueError, match="cannot be cut"):
        packing.check_tokenizer(path.replace("word_bpe_49k", "byte_bpe_50k"))
