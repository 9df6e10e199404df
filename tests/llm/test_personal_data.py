"""The span field on planted hidden data that it was not trained on, and on long texts that are all candidates."""

import random
import time

import pytest

from intelweave.llm import pii
from intelweave.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(table(spark, SF, "documents"))


def texts_of(field, text):
    return [(k, text[a:b]) for k, a, b in pii.found_spans(text, field)]


def test_planted_spans_of_words_never_seen(field):
    """Recall and precision by kind: other words, endings and numbers than in training, half of the lines with look-alikes."""
    rng = random.Random(99)
    words = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    hit, missed, wrong = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for text, gold in pii.made_up_lines(words, 2000, 77):
        base = pii.base_spans(text)
        gold = {x for x in gold if not any(a < x[2] and x[1] < b for _, a, b in base)}
        got = set(pii.found_spans(text, field))
        for count, spans in ((hit, got & gold), (missed, gold - got), (wrong, got - gold)):
            for kind, _, _ in spans:
                count[kind] += 1
    for kind in pii.KINDS:
        assert hit[kind] > 100
        assert hit[kind] >= 0.9 * (hit[kind] + missed[kind]), (kind, hit, missed)
        assert hit[kind] >= 0.98 * (hit[kind] + wrong[kind]), (kind, hit, wrong)


@pytest.mark.parametrize(
    "kind,form",
    [
        ("email", "carla at bank dot it"), ("email", "bob at uni dot edu dot sg"), ("email", "anna dot smith at firm dot museum"),
        ("phone", "555-123-4567"), ("phone", "(555) 123 4567"), ("ip", "10 dot 0 dot 0 dot 5"), ("ip", "10[.]0[.]0[.]5"),
        ("card", "4111.1111.1111.1111"), ("card", "4111 - 1111 - 1111 - 1111"),
    ],
)
def test_hidden_forms_of_all_kinds(field, kind, form):
    assert texts_of(field, f"{form}") == [(kind, form)]
    assert texts_of(field, f"write or call: {form}, any day") == [(kind, form)]


@pytest.mark.parametrize(
    "plain", ["4111.1111.1111.1112", "300 dot 1 dot 2 dot 3", "2024-05-06 10:20:30", "isbn 978-0-123-45678-9", "pages 100-123", "1,234,567", "version 1.2.3"]
)
def test_look_alikes_stay(field, plain):
    assert texts_of(field, f"see {plain} there") == []


def test_long_texts_of_numbers_are_read_in_time(field):
    for line, n in (("555-123-4567\n", 15384), ("(555) 123 4567 ", 13333), ("joe at example dot com, ", 8333)):
        text = line * n  # 200 KB
        start = time.perf_counter()
        found = pii.found_spans(text, field)
        assert time.perf_counter() - start < 30
        assert len(found) == n
    text = "7 " * 20_000 + "at dot " * 5_000 + "10.0.0.5 " * 5_000
    assert pii.found_spans(text, field) == []


def test_check_sums_of_candidates_are_those_of_whole_numbers():
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join("".join(rng.choice("0123456789") for _ in range(rng.randint(1, 7))) for _ in range(6))
        tokens = [m.span() for m in pii.TOKEN.finditer(text)]
        for (i, j), features in pii.candidates(text, tokens).items():
            digits = "".join(text[a:b] for a, b in tokens[i:j])
            if 13 <= len(digits) <= 19:
                assert f"check=luhn-{pii.luhn(digits)}" in features


def test_empty_table_null_and_long_texts(spark, field):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "call 555-123-4567", 7)], "doc_id long, text string, spans long")
    rows = pii.personal_data(docs, field).orderBy("doc_id", "spans").collect()
    assert [(r.doc_id, r.spans, r.n_added) for r in rows] == [(None, "phone:5:17", 1), (1, "", 0), (1, "", 0)]
    assert pii.personal_data(docs.limit(0), field).collect() == []
