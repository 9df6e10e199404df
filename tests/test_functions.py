"""Column expressions against plain Python."""

import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intelweave.functions import dates, ioc, labels, text

NOW = "2024-05-01T00:00:00"


def values(spark, rows, expr, kind="string"):
    data = [(i, v) for i, v in enumerate(rows)]
    df = spark.createDataFrame(data, f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


SAMPLES = ["  a  b\t\nc ", "", "they're e-commerce x", "ÉCOLE de l'été", "a_b-c/d", "x" * 90, "one two-three four"]


def test_white_space_and_case(spark):
    assert values(spark, SAMPLES, text.squash_ws) == [" ".join(s.split()) for s in SAMPLES]
    assert values(spark, SAMPLES, text.strip) == [s.strip() for s in SAMPLES]
    assert values(spark, SAMPLES, text.title_case) == [s.title() for s in SAMPLES]


def test_shorten_matches_textwrap(spark):
    lines = ["alpha beta gamma delta", "a well-known long-standing name", "short", "x" * 50, "  many   blanks in here  "]
    for width in (8, 15, 21):
        want = [textwrap.shorten(s, width, placeholder="…") for s in lines]
        assert values(spark, lines, lambda c: text.shorten(c, width)) == want


def test_truncate_and_links(spark):
    assert values(spark, ["abc def", "abc"], lambda c: text.truncate(c, 4)) == ["abc…", "abc"]
    got = values(spark, [" (https://x.y) see [A b](http://z) now "], text.strip_md_links)
    assert got == ["see A b now"]
    assert values(spark, ["<p>a&amp;b</p>\n<i>c</i>"], text.strip_html) == ["a&amp;b c"]


def test_clean_list(spark):
    rows = [[" A", "a ", "", "B"], [], None]
    assert values(spark, rows, text.clean_list, "array<string>") == [["A", "B"], [], []]


def test_string_or_list(spark):
    rows = ['"x"', '["a","","b"]', '{"k":1}', '""', "null", "3"]
    assert values(spark, rows, text.string_or_list) == [["x"], ["a", "b"], [], [], [], []]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("2024-03-01T10:00:00Z", "2024-03-01T10:00:00+00:00"),
        ("03/04/2024", "2024-03-04T00:00:00+00:00"),
        ("Mon, 05 Feb 2024 08:30:00 +0200", "2024-02-05T06:30:00+00:00"),
        ("5 February 2024", "2024-02-05T00:00:00+00:00"),
        ("not a date", "2024-05-01T00:00:00+00:00"),
        ("", "2024-05-01T00:00:00+00:00"),
        (None, "2024-05-01T00:00:00+00:00"),
    ],
)
def test_parse_ts(spark, raw, want):
    assert values(spark, [raw], lambda c: dates.iso_ts(dates.parse_ts(c, NOW))) == [want]


def test_lenient_ts_keeps_bare_year(spark):
    got = values(spark, ["2009", "", None, "2015-06-07"], lambda c: dates.parse_ts_lenient(c, NOW))
    assert got == ["2009", "", "", "2015-06-07T00:00:00+00:00"]


def test_article_date(spark):
    rows = ["Tue, 02 Jan 2024 23:30:00 -0500", "2024-01-03T01:00:00Z", "on 2024-01-04, late", "next week maybe", "", None]
    assert values(spark, rows, dates.article_date) == ["2024-01-02", "2024-01-03", "2024-01-04", "next week ", "", ""]


def test_first_year_is_the_whole_year(spark):
    assert values(spark, ["from 2014, maybe 1998; 20231", "no year"], dates.first_year) == ["1998", ""]


def test_freshness(spark):
    rows = [("2024-04-20", None), ("", "2024-02-15"), ("2023-01-01", ""), ("soon", "2024-04-30"), (None, None), ("2025-01-01", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, f string")
    got = df.select("i", dates.freshness(F.col("l"), F.col("f"), NOW).alias("s"), dates.freshness(F.col("l"), F.col("f"), NOW, unknown="STALE").alias("p"))
    got = [(r.s, r.p) for r in got.orderBy("i").collect()]
    assert got == [("FRESH", "FRESH"), ("AGING", "AGING"), ("STALE", "STALE"), (None, "STALE"), (None, "STALE"), ("FRESH", "FRESH")]


def test_lookback_keeps_undated(spark):
    rows = ["2024-04-01", "2020-01-01", "", "soon", None]
    assert values(spark, rows, lambda c: dates.within_lookback(c, NOW, 365)) == [True, False, True, True, True]


def test_defang(spark):
    cases = [
        ("url", "https://1.2.3.4/path.php", "hxxps://1[.]2[.]3[.]4/path.php"), ("url", "http://a.b", "hxxp://a[.]b"),
        ("domain", "a.b.c", "a[.]b[.]c"), ("ip", "1.2.3.4", "1[.]2[.]3[.]4"), ("email", "x@a.b", "x@a.b"), ("url", "ftp://a.b/c.d", "ftp://a[.]b/c.d"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, v string, w string")
    for r in df.select("w", ioc.defang(F.col("t"), F.col("v")).alias("o")).collect():
        assert r.o == r.w


def test_indicator_extraction_types(spark):
    body = f"see http://e.org/x?y=1, mail bob.x@mail.e.org or 10.0.0.1; {'a' * 32} {'b' * 40} {'c' * 64} é1.2.3.4 x1.2.3.4"
    got = [(x["type"], x["value"]) for x in values(spark, [body], ioc.indicators_in)[0]]
    assert got == [
        ("url", "http://e.org/x?y=1,"), ("email", "bob.x@mail.e.org"), ("ip", "10.0.0.1"), ("hash_md5", "a" * 32),
        ("hash_sha1", "b" * 40), ("hash_sha256", "c" * 64), ("ip", "1.2.3.4"),
    ]


def test_patterns(spark):
    df = spark.createDataFrame([("ip", "1.2.3.4"), ("ip", "::1"), ("url", "http://a'b"), ("mutex", "m")], "t string, v string")
    got = [r[0] for r in df.select(ioc.stix_pattern(F.col("t"), F.col("v"))).collect()]
    assert got == ["[ipv4-addr:value = '1.2.3.4']", "[ipv6-addr:value = '::1']", "[url:value = 'http://a\\'b']", None]


def test_labels(spark):
    assert values(spark, [" t1059.001", "T10", "T1059.01", None], labels.technique_id) == ["T1059.001", None, None, None]
    assert values(spark, ["bank", "E-SPORTS arena"], labels.canonical_sector) == ["Finance", "E-Sports Arena"]
    assert values(spark, ["win.x_agent", "apk.a"], labels.display_slug) == ["X Agent", "A"]
    assert values(spark, ["command and control", "new tactic"], labels.tactic_label) == ["Command and Control", "New Tactic"]
    assert values(spark, [["MITRE", "x"], ["mitre_attack"], ["x"], []], lambda c: labels.confidence_label(c, ("mitre_attack",)), "array<string>") == ["HIGH", "MEDIUM", "LOW", "LOW"]
    ids = values(spark, ["T1059.001 T1059 T1059.001 XT1234 T99999"], labels.technique_ids_in)
    assert ids == [["T1059.001", "T1059"]]


def test_stable_ids_repeat(spark):
    a = values(spark, ["x", "y"], lambda c: labels.stable_id("malware", c))
    b = values(spark, ["x", "y"], lambda c: labels.stable_id("malware", c))
    assert a == b and a[0] != a[1] and a[0].startswith("malware--") and len(a[0].split("--")[1]) == 36


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab .", max_size=12), min_size=1, max_size=5), st.sampled_from(["a", "aa", "aba", "b a"]))
def test_occurrences_equal_str_count(spark, rows, term):
    assert values(spark, rows, lambda c: text.occurrences(c, F.lit(term))) == [s.count(term) for s in rows]
