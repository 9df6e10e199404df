"""Operators on small fixtures."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from intelweave.config import DEFAULTS
from intelweave.operators import aliases as al
from intelweave.operators import articles as art
from intelweave.operators import families as fam
from intelweave.operators import mentions as men
from intelweave.operators import merge as m
from intelweave.operators import normalize as nz
from intelweave.operators import ordering as od
from intelweave.operators import profile as prof
from intelweave.operators import pulses as pul
from intelweave.operators import repos as rep
from intelweave.operators import rules as rul
from intelweave.operators import termscan

TECH = "actor string, source_id string, source_rank int, pos int, technique_id string, name string, tactic string, description string, detection string, detection_recs array<string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def techniques(spark):
    return spark.createDataFrame(
        [
            ("A", "mitre_attack", 0, 0, "T1", "", "Impact", "", "", ["r1", "r2"]),
            ("A", "alienvault_otx", 2, 0, "T1", "late", "", "text", "d", ["r2", "r3"]),
            ("A", "mitre_attack", 0, 1, "T2", "two", "", "", "", []),
            ("A", "alienvault_otx", 2, 5, "T3", "three", "", "", "", []),
            ("B", "alienvault_otx", 2, 1, "T1", "b", "", "", "", []),
            ("A", "alienvault_otx", 2, 9, "", "no id", "", "", "", []),
        ],
        TECH,
    )


def test_merge_techniques_fills_and_labels(spark):
    got = {(r.actor, r.technique_id): r for r in m.merge_techniques(techniques(spark)).collect()}
    one = got["A", "T1"]
    assert (one["name"], one.tactic, one.description, one.detection) == ("late", "Impact", "text", "d")
    assert one.sources == ["mitre_attack", "alienvault_otx"] and one.confidence == "HIGH"
    assert got["A", "T2"].confidence == "MEDIUM" and got["A", "T3"].confidence == "LOW"
    assert len(got) == 4
    recs = m.technique_recommendations(techniques(spark)).filter("actor = 'A' and technique_id = 'T1'")
    assert [r.recommendation for r in recs.orderBy("source_rank", "pos", "rec_pos").collect()] == ["r1", "r2", "r3"]


def test_official_advisory_source_counts_under_both_ids(spark):
    df = spark.createDataFrame([(["cisa"],), (["cisa_advisories"],), (["vendor"],)], "sources array<string>")
    assert [r.confidence for r in m.with_confidence(df).collect()] == ["MEDIUM", "MEDIUM", "LOW"]


IND = "actor string, source_id string, source_rank int, pos int, type string, value string, sources array<string>"


def test_merge_indicators(spark):
    df = spark.createDataFrame(
        [
            ("A", "s2", 1, 0, "domain", "X.org", ["own2"]),
            ("A", "s1", 0, 3, "domain", "x.ORG", ["own1", "s1"]),
            ("A", "s1", 0, 4, "url", "x.org", None),
        ],
        IND,
    )
    got = {r.type: r for r in m.merge_indicators(df).collect()}
    assert got["domain"].value == "x.ORG" and got["domain"].sources == ["own1", "s1", "s2"] and got["domain"].confidence == "HIGH"
    assert got["url"].sources == ["s1"] and got["url"].confidence == "LOW"


def test_merges_do_not_depend_on_row_order(spark):
    random.seed(3)
    data = [
        (f"A{random.randint(0, 2)}", f"s{s}", s, i, f"T{random.randint(0, 5)}", random.choice(["", f"n{i}"]), "", random.choice(["", f"d{i}"]), "", [f"r{random.randint(0, 9)}"])
        for i in range(300) for s in [random.randint(0, 3)]
    ]
    want = rows(m.merge_techniques(spark.createDataFrame(data, TECH)))
    for seed in (1, 2):
        random.seed(seed)
        random.shuffle(data)
        assert rows(m.merge_techniques(spark.createDataFrame(data, TECH).repartition(7))) == want


def test_hot_key_is_collapsed_before_the_shuffle(spark):
    n = 20000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("value"),
        F.lit("A").alias("actor"), F.lit("domain").alias("type"), (F.col("id") % 5).cast("int").alias("source_rank"),
        F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source_id"), F.col("id").alias("pos"),
    )
    hot = m.merge_indicators(df).filter("value = 'hot'").collect()
    assert len(hot) == 1 and hot[0].sources == ["s0", "s1", "s2", "s3", "s4"]


def test_merge_campaign_names_keep_case(spark):
    df = spark.createDataFrame(
        [("A", "s", 0, 0, "Op", "", "u"), ("A", "s", 0, 1, "OP", "x", ""), ("A", "t", 1, 0, " Op ", "later", "v")],
        "actor string, source_id string, source_rank int, pos int, name string, description string, url string",
    )
    got = {r["name"]: (r.description, r.url) for r in m.merge_campaigns(df).collect()}
    assert got == {"Op": ("later", "u"), "OP": ("x", None)}


def test_new_rows_and_union(spark):
    a = spark.createDataFrame([("A", "domain", "x.org")], "actor string, type string, value string")
    b = spark.createDataFrame([("A", "domain", "X.ORG"), ("A", "url", "x.org"), ("B", "domain", "x.org")], a.schema)
    assert rows(m.new_rows(a, b)) == [("A", "url", "x.org"), ("B", "domain", "x.org")]
    assert m.append_new(a, b).count() == 3


def actors(spark):
    return spark.createDataFrame(
        [(0, "APT28", ["Fancy Bear ", "g0007", ""], "Russia", "espionage"), (1, "Lead", ["apt28x", "Fancy Bear"], "", "")],
        "actor_pos bigint, canonical string, aliases array<string>, origin string, motivation string",
    )


def test_alias_resolution(spark):
    table = al.alias_rows(actors(spark))
    index = al.resolution_index(table)
    names = spark.createDataFrame([(" fancy BEAR",), ("G0007",), ("apt28",), (" Nobody ",)], "name string")
    got = {r["name"]: r.canonical for r in al.resolve_canonical(names, index, "name").collect()}
    assert got == {" fancy BEAR": "Lead", "G0007": "APT28", "apt28": "APT28", " Nobody ": "Nobody"}
    assert [r.alias for r in al.alias_conflicts(table).collect()] == ["fancy bear"]
    full = {r["name"]: r for r in al.search_set(names, table, index, "name").collect()}
    assert full["G0007"].search_set == ["fancy bear", "g0007"] and full["G0007"].reported == ["fancy bear", "g0007"]
    assert full[" Nobody "].aliases == [" nobody "]


def brute(texts, terms):
    return {(i, t, x.lower().count(t)) for i, x in texts for t in terms if t in x.lower()}


def test_mentions_equal_brute_force(spark):
    random.seed(5)
    texts = [(i, "".join(random.choice("abAB .é\n") for _ in range(random.randint(0, 60)))) for i in range(200)]
    terms = ["a", "ab", "aba", "b a", "abab", "é.", "ba", "b.", "a\nb", " a"]
    df = spark.createDataFrame(texts, "id int, t string")
    td = spark.createDataFrame([("x", t) for t in terms], "actor string, term string")
    for strategy in (None, "pattern", "grams"):
        got = {(r.id, r.term, r.n) for r in men.term_hits(df, "id", "t", td, strategy=strategy).collect()}
        assert got == brute(texts, terms), strategy


def test_term_scan_counts_like_text_search():
    rng = random.Random(3)
    for _ in range(300):
        alphabet = rng.choice(["ab", "abc é", "xyzß漢🙂 "])
        word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, n)))
        texts = ["".join(word(30) for _ in range(rng.randrange(0, 3))) for _ in range(rng.randrange(0, 9))]
        terms = sorted({word(9) for _ in range(rng.randrange(1, 9))} | {"a", "aa", "aba"})
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(termscan, "CHUNK", rng.choice([3, 17, 1 << 20]))
            row, term, n = termscan.TermScan(terms).count(pa.array(texts, pa.string()))
        want = {(i, t): x.count(t) for i, x in enumerate(texts) for t in terms if t in x}
        assert {(i, terms[t]): c for i, t, c in zip(row.tolist(), term.tolist(), n.tolist())} == want


def test_term_scan_takes_no_step_per_hit():
    texts = pa.array(["a" * 200_000, "ab" * 100_000] * 3, pa.string())
    start = time.perf_counter()
    row, term, n = termscan.TermScan(["a", "aa", "aba", "b"]).count(texts)
    assert time.perf_counter() - start < 20
    assert list(zip(row[:6].tolist(), term[:6].tolist(), n[:6].tolist())) == [(0, 0, 200_000), (0, 1, 100_000), (1, 0, 100_000), (1, 2, 50_000), (1, 3, 100_000), (2, 0, 200_000)]


def test_term_scan_is_given_little_at_a_time(monkeypatch):
    """Slices of an Arrow batch hold a bounded number of bytes, or one row, and count as the whole batch does."""
    texts = pa.array(["ab" * 50, None, "", "b" * 300, *["aab"] * 200], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["k", "t"])
    scan = termscan.TermScan(["a", "ab", "b" * 7])
    whole = sorted(zip(*(x.tolist() for x in scan.count(texts))))
    got, at = [], 0
    for part in termscan.slices_of(batch, 1, 64):
        assert part.num_rows == 1 or sum(len(x or "") for x in part.column(1).to_pylist()) <= 64
        row, term, n = scan.count(part.column(1))
        got += zip((row + at).tolist(), term.tolist(), n.tolist())
        at += part.num_rows
    assert at == len(texts) and sorted(got) == whole
    monkeypatch.setattr(termscan, "CHUNK", 16)  # pairs are compared in runs, too
    assert sorted(zip(*(x.tolist() for x in scan.count(texts)))) == whole


def test_a_term_of_common_grams_is_dealt_out(spark):
    """Every text holds all grams of the term; its pairs go to many parts of about equal size."""
    texts = spark.range(4000).select("id", F.concat(F.lit("the and then "), F.col("id").cast("string")).alias("t"))
    terms = spark.createDataFrame([("x", "the and"), ("y", "then 39")], "actor string, term string")
    hits = men._grams(texts, ["id"], "t", terms, "term", part=100)
    assert hits.groupBy("term").count().collect() and hits.filter("term = 'the and'").count() == 4000
    assert hits.filter("term = 'then 39'").count() == texts.filter("t like '%then 39%'").count()
    key = F.pmod(F.xxhash64("id"), F.lit(41)) + 1  # as the operator deals 4,000 texts into parts of 100
    sizes = sorted(r["count"] for r in texts.groupBy(key.alias("part")).count().collect())
    assert len(sizes) == 41 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_many_terms_are_not_collected(spark):
    td = spark.range(50).select(F.lit("x").alias("actor"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("term"))
    assert men.small_term_list(td, limit=10) is None
    assert men.small_term_list(td, size=20) is None
    assert len(men.small_term_list(td)) == 50


def test_token_mentions_respect_words(spark):
    df = spark.createDataFrame([(1, "leading a fancy-BEAR on one two three four five"), (2, "take the lead")], "id int, t string")
    td = spark.createDataFrame(
        [("L", "lead"), ("F", "fancy bear"), ("N", "one two three four five"), ("M", "one two three four six")], "actor string, term string"
    )
    assert rows(men.token_mentions(df, "id", "t", td)) == [(1, "F"), (1, "N"), (2, "L")]


def test_relevance(spark):
    df = spark.createDataFrame([(2, 5, True), (1, 1, False), (0, 3, True), (0, 0, True), (0, 2, False)], "t int, b int, f boolean")
    got = [r[0] for r in df.select(art.relevance_score(F.col("t"), F.col("b"), F.col("f"))).collect()]
    assert got == [100, 50, 35, 0, 18]


def test_mention_late_in_the_body_counts(spark):
    articles = spark.createDataFrame([(1, "t", "x " * 3000 + "fancy bear")], "article_id int, title string, summary string")
    terms = spark.createDataFrame([("A", "fancy bear")], "actor string, term string")
    assert art.score_articles(articles, terms).first().body_hits == 1
    assert art.score_articles(articles, terms, settings=DEFAULTS.with_(score_chars=2000)).count() == 0


def test_articles_without_url_do_not_collapse(spark):
    df = spark.createDataFrame(
        [("A", 0, 50, 0, "", "one"), ("A", 0, 50, 1, "", "two"), ("A", 1, 90, 0, "u", "x"), ("A", 0, 20, 3, "u", "y")],
        "actor string, feed_pos int, relevance int, pos int, url string, title string",
    )
    assert sorted(r.title for r in art.unique_articles(df).collect()) == ["one", "two", "y"]


def test_feed_health(spark):
    feeds = spark.createDataFrame([("a", None), ("b", True), ("c", False), ("d", True)], "name string, enabled boolean")
    # an article that concerns two actors is one article of its feed
    kept = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "source string, article_id int")
    health = art.feed_health(feeds, kept, spark.createDataFrame([("d",)], "name string"))
    assert rows(health) == [("a", 2, "hits"), ("b", 0, "zero"), ("d", 0, "failed")]
    assert tuple(art.feed_health_totals(health).first()) == (3, 1, 1, 1, 2)


RULE = "path string, title string, level string, tags array<string>, logsource string, url string, condition_summary string, status string"


def test_rules_are_exact_and_capped(spark):
    data = [(f"p{i:02}", f"rule {i:02}", "low", ["attack.t1059"], "x", "u", "c", "s") for i in range(30)]
    data += [("q", "worst", "critical", ["attack.t1059", "attack.t1059"], "x", "u", "c", "s"), ("r", "sub", "high", ["attack.t1059.001"], "x", "u", "c", "s")]
    rules = spark.createDataFrame(data, RULE)
    tech = spark.createDataFrame([("A", "T1059"), ("A", "T1059.001"), ("A", "T1"), ("B", "T1059")], "actor string, technique_id string")
    hit = rul.rules_for_techniques(tech, rules)
    first = hit.filter("actor = 'A' and technique_id = 'T1059'").orderBy("rule_rank").collect()
    assert [r.path for r in first] == ["q", *[f"p{i:02}" for i in range(9)]]
    lead = {(r.actor, r.technique_id): (r.rule_count, r.summary) for r in rul.lead_rules(hit).collect()}
    assert lead["A", "T1059"] == (31, "worst (+30 more)") and lead["A", "T1059.001"] == (1, "sub")
    assert {r.actor: r.rule_count for r in rul.rule_total(hit).collect()} == {"A": 32, "B": 31}


def test_coverage_modes(spark):
    corpus = spark.createDataFrame([("tags: attack.t1059.001 xt10035 t1003x004",)], "content string")
    tech = spark.createDataFrame([("A", t) for t in ("T1059", "T1059.001", "T1003", "T1003.004", "T9999")], "actor string, technique_id string")
    exact, mention = rul.corpus_ids(corpus), rul.corpus_ids(corpus, mode="mention")
    assert sorted(r.technique_id for r in rul.covered(tech, exact).collect()) == ["T1059.001"]
    assert sorted(r.technique_id for r in rul.covered(tech, mention).collect()) == ["T1003", "T1003.004", "T1059", "T1059.001"]
    assert rul.covered(tech, mention).count() + rul.gaps(tech, mention).count() == 5


def test_percentage_rounds_half_to_even(spark):
    df = spark.createDataFrame([("A", i < 5) for i in range(8)], "actor string, covered boolean")
    assert rul.coverage_pct(df).first().pct == 62


FEED = "family string, pos int, ioc string, ioc_type string, threat_type string, confidence_level int, first_seen string, last_seen string, malware string, malware_printable string"


def family_feed(spark):
    return fam.parse_family_ioc(
        spark.createDataFrame(
            [
                ("Zed", 0, " 1.2.3.4:443 ", "IP:PORT", "botnet_cc", 100, "2024-01-02 03:04:05", None, "win.zed", None),
                ("Zed", 1, "A.org", "domain", "payload", 75, "2024-01-01", None, None, "Zed"),
                ("Zed", 2, "x", "sha3", "cc", 50, "", None, None, None),
                ("Zed", 3, "  ", "url", "cc", 50, "", None, None, None),
                ("Yam", 0, "a.ORG", "domain", "new_kind", None, None, None, None, None),
            ],
            FEED,
        )
    )


def test_family_iocs(spark):
    feed = family_feed(spark)
    got = {(r.family, r.value): (r.type, r.confidence_score, r.threat_label, r.description, r.first_seen) for r in feed.collect()}
    assert got == {
        ("Zed", "1.2.3.4"): ("ip", 100, "Botnet C2", "Botnet C2 — win.zed", "2024-01-02"),
        ("Zed", "A.org"): ("domain", 75, "Payload Delivery", "Payload Delivery — Zed", "2024-01-01"),
        ("Yam", "a.ORG"): ("domain", 0, "New Kind", "New Kind", ""),
    }
    malware = spark.createDataFrame([("A", "Yam", 0), ("A", "Zed", 1), ("A", "None", 2)], "actor string, name string, pos int")
    owned = {(r.type, r.malware_family) for r in fam.family_iocs(malware, feed).collect()}
    assert owned == {("domain", "Yam"), ("ip", "Zed")}
    assert rows(fam.family_hits(malware, feed).select("family", "hits")) == [("Yam", 1), ("Zed", 2)]


def test_a_feed_that_is_derived_is_not_derived_over_and_over(spark):
    """Expressions below the parser are in its plan once for the filter and once for the row, not once per mention."""
    df = spark.createDataFrame([("f", 0, "x", "md5_hash", "odd_kind", 1, "", "", "", "p"), ("f", 1, "x", "ip:port", "cc", 1, "", "", "m", "p"),
                                ("f", 2, " : 7", "IP:PORT", "cc", 1, "", "", "", ""), ("f", 3, None, "url", "cc", 1, "", "", "", "")], FEED)
    made = fam.parse_family_ioc(df.withColumn("ioc", F.when(F.col("pos") < 2, F.md5("ioc")).otherwise(F.col("ioc"))))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") <= 2 and plan.count("regexp_extract_all(") == 1
    got = {(r.type, len(r.value), r.threat_label, r.description) for r in made.collect()}
    assert got == {("hash_md5", 32, "Odd Kind", "Odd Kind — p"), ("ip", 32, "Command & Control", "Command & Control — m")}


def test_pulse_iocs_are_unique_by_value(spark):
    ind = lambda *pairs: [{"type": t, "indicator": v} for t, v in pairs]
    df = spark.createDataFrame(
        [("A", 0, ind(("domain", "x"), ("URL", "x"), ("IPv4", " 1.1.1.1 "), ("odd", "z"))), ("A", 1, ind(*[("domain", f"d{i}") for i in range(20)]))],
        "actor string, pulse_pos int, indicators array<struct<type:string,indicator:string>>",
    )
    got = rows(pul.pulse_iocs(df).select("type", "value"))
    assert got == sorted([*[("domain", f"d{i}") for i in range(20)], ("domain", "x"), ("ip", "1.1.1.1")])
    few = rows(pul.pulse_iocs(df, 10).select("type", "value"))
    assert few == [*[("domain", f"d{i}") for i in range(9)], ("domain", "x"), ("ip", "1.1.1.1")]


def test_repo_matching_equals_scoring_every_pair(spark):
    random.seed(9)
    pool = ["a", "b", "c", "d", "universal"]
    repos = [(i, f"r{i}", "u", "p", random.sample(pool, random.randint(0, 3)), random.randint(1, 3)) for i in range(25)]
    df = spark.createDataFrame(repos, "pos int, name string, url string, platform string, tags array<string>, tier int")
    tags = {"A": {"a", "universal"}, "B": {"universal"}, "C": {"c", "d", "b", "universal"}}
    td = spark.createDataFrame([(a, t) for a, ts in tags.items() for t in ts], "actor string, tag string")
    got = {a: [] for a in tags}
    for r in rep.match_repos(td, df).orderBy("repo_rank").collect():
        got[r.actor].append((r["name"], r.score))
    for actor, mine in tags.items():
        scored = [(len(mine & set(r[4])) + (2 if r[5] == 1 else 0), r) for r in repos]
        best = sorted([x for x in scored if x[0] > 0], key=lambda x: (-x[0], x[1][0]))[:6]
        assert got[actor] == [(r[1], s) for s, r in best]


def test_quarantine(spark):
    df = spark.createDataFrame([("a", "s"), ("", "s"), ("b", None)], "actor_name string, source_id string")
    good, bad = nz.require_identity(df)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["actor_name", "source_id"]


def test_profiles_have_one_layout_at_any_size(spark):
    items = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").otherwise("cold").alias("actor"), F.lit("techniques").alias("section"),
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("item_key"), F.concat(F.lit('{"i":'), F.col("id").cast("string"), F.lit("}")).alias("item"),
    )
    header = spark.createDataFrame([("hot", "x"), ("cold", None), ("none", "y")], "actor string, origin string")
    out = prof.assemble_profiles(header, items).groupBy("actor", "section").count().collect()
    assert {(r.actor, r.section): r["count"] for r in out} == {
        ("hot", "header"): 1, ("cold", "header"): 1, ("none", "header"): 1, ("hot", "techniques"): 900, ("cold", "techniques"): 100,
    }


def test_rule_totals_count_what_is_not_listed(spark):
    rules = spark.createDataFrame([(f"p{i:02}", f"t{i:02}", "high", ["attack.t1059"]) for i in range(25)], "path string, title string, level string, tags array<string>")
    rules = rules.withColumns({"logsource": F.lit(""), "url": F.lit("")})
    tech = spark.createDataFrame([("A", "T1059")], "actor string, technique_id string")
    hit = rul.rules_for_techniques(tech, rules, 10)
    assert hit.count() == 10 and rul.rule_counts(hit).first().rule_count == 25 and rul.rule_total(hit).first().rule_count == 25
    assert rul.lead_rules(hit).first().summary == "t00 (+24 more)"


def test_advisory_bodies_join_last(spark):
    rows = [("A", 0, 1, "u", "t", "first"), ("A", 0, 2, "u", "t2", "second"), ("A", 1, 1, "", "x", "third")]
    df = spark.createDataFrame(rows, "actor string, source_rank int, pos int, url string, title string, body string")
    assert "body" not in m.merge_advisories(df).columns
    assert sorted(r.body for r in m.merge_advisories(df, texts=True).collect()) == ["first", "third"]


def test_no_cut_by_default(spark):
    feed = spark.createDataFrame([("f", i, "ip", f"1.1.1.{i % 250}", 0) for i in range(500)], "family string, pos int, type string, value string, confidence_score int")
    used = spark.createDataFrame([("A", "f", 0)], "actor string, name string, pos int")
    assert fam.family_iocs(used, feed).count() == 250 and fam.family_hits(used, feed).first().hits == 500
    assert fam.family_hits(used, feed, 45).first().hits == 45


def test_keep_first_and_latest(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert rows(od.keep_first(df, ["k"], ["o"])) == [("a", 1, "y"), ("b", 1, "z")]
    assert rows(od.latest_by(df, ["k"], ["o"])) == [("a", 2, "x"), ("b", 1, "z")]


def test_changed_settings_reach_the_operators(spark):
    from dataclasses import FrozenInstanceError

    from intelweave.operators import freshness
    from intelweave.operators.merge import merge_indicators

    data = [("A", "s1", 0, i, "ip", f"1.1.1.{i}", f"2024-04-{30 - i:02d}", "") for i in range(20)]
    columns = "actor string, source_id string, source_rank int, pos int, type string, value string, last_seen string, first_seen string"
    raw = spark.createDataFrame(data, columns)
    labels = lambda s: {r.confidence for r in merge_indicators(raw, settings=s).collect()}
    assert labels(DEFAULTS) == {"LOW"} and labels(DEFAULTS.with_(high_provenance=("s1",))) == {"MEDIUM"}
    tuned = DEFAULTS.with_(fresh_days=5, aging_days=10, playbook_rows=3)
    got = freshness.blocklist(raw, "2024-05-01", tuned).groupBy("bucket").count()
    assert sorted(map(tuple, got.collect())) == [("AGING", 3), ("FRESH", 3)]
    assert sorted(r["count"] for r in freshness.bucket_counts(freshness.with_bucket(raw, "2024-05-01", None, tuned)).withColumnRenamed("indicators", "count").collect()) == [5, 5, 10]
    with pytest.raises(FrozenInstanceError):
        DEFAULTS.fresh_days = 1


def test_grams_of_texts_are_found_by_array_arithmetic():
    """Grams that overlap themselves, letters of several bytes, and runs of places cut anywhere."""
    from intelweave.operators import grams

    rng = random.Random(9)
    for chunk in (5, 64, 1 << 20):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(grams, "CHUNK", chunk)
            texts = ["".join(rng.choice("abé 漢") for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "aaaa"]
            column, flags = pa.array(texts, pa.string()), np.ones(1 << grams.BITS, bool)
            row, width, code, _, n = grams.grams_met(column, [1, 2, 8], flags)
            got = {(r, int(c).to_bytes(8, "little", signed=True)[:w]): k for r, w, c, k in zip(row.tolist(), width.tolist(), code.tolist(), n.tolist())}
            data = [(t or "").encode() for t in texts]
            want = {(i, d[a : a + w]) for i, d in enumerate(data) for w in (1, 2, 8) for a in range(len(d) - w + 1)}
            assert set(got) == want and all(k in (0, data[i].count(g)) for (i, g), k in got.items())
            assert got[42, b"aa"] == 0 and got[42, b"a"] == 4


def test_word_runs_are_held_against_a_sketch_before_the_exchange(spark):
    """Only runs of words that a term begins with are paired; other runs of a text leave no row."""
    from intelweave.operators import grams

    heads = pa.array(["fancy bear", "é", "one two three four"])
    flags = np.zeros(1 << grams.BITS, bool)
    flags[grams.whole_counters(heads, 4)] = True
    texts = pa.array(["a fancy bear fancy bear", None, "", "one two three four five é", "fancy bears é"])
    row, head = grams.heads_met(texts, 4, flags)
    found = [(r, h) for r, h in zip(row.tolist(), head.to_pylist()) if h in heads.to_pylist()]
    assert sorted(found) == [(0, "fancy bear"), (3, "one two three four"), (3, "é"), (4, "é")] and len(row) < 8
