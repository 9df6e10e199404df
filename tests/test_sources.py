"""Readers over landed files."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from intelweave.catalog.readers import write_rule_files
from intelweave.operators import graph as g
from intelweave.operators import rules as rul
from intelweave.sources import documents as doc
from intelweave.sources import rulefiles, tables
from intelweave.sources.registry import Registry

RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>
<item><title>Grey &lt;b&gt;Heron&lt;/b&gt; returns</title><link>http://n/1</link><pubDate>Wed, 03 Jan 2024 10:00:00 GMT</pubDate>
<description>short</description><content:encoded><![CDATA[<p>long <i>body</i></p>]]></content:encoded><category>energy</category></item>
<item><title></title><description>nobody</description></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Second</title><link href="http://n/2"/>
<updated>2024-02-03T04:05:06Z</updated><summary>sum</summary></entry></feed>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "feeds").mkdir()
    (tmp_path / "feeds" / "one.xml").write_text(RSS)
    (tmp_path / "feeds" / "two.xml").write_text(ATOM)
    (tmp_path / "feeds" / "bad.xml").write_text("<rss><channel><item>")
    return tmp_path


def test_articles_from_files(spark, folder):
    got = {r.feed: (r.title, r.url, r.date, r.summary) for r in doc.read_articles(spark, str(folder / "feeds")).collect()}
    assert got == {
        "one": ("Grey Heron returns", "http://n/1", "2024-01-03", "long body"),
        "two": ("Second", "http://n/2", "2024-02-03", "sum"),
    }


def test_advisories_use_atom_only_without_items(spark, folder):
    rows = doc.read_advisory_feed(spark, str(folder / "feeds")).collect()
    assert sorted((r.title, r.tags) for r in rows) == [("", ""), ("Grey <b>Heron</b> returns", "energy"), ("Second", "")]


def bundle():
    return {
        "objects": [
            {"type": "intrusion-set", "id": "g1", "name": "Grey Heron", "aliases": ["Heron"], "description": "Old", "external_references": [{"source_name": "mitre-attack", "external_id": "G0032"}]},
            {"type": "intrusion-set", "id": "g1", "name": "Grey Heron", "aliases": ["Heron", "Grey Heron"], "description": "Since 2011, from the PRC", "external_references": [{"source_name": "mitre-attack", "external_id": "G0999"}], "primary_motivation": "money"},
            {"type": "attack-pattern", "id": "t1", "name": "Phish", "kill_chain_phases": [{"phase_name": "initial-access"}], "external_references": [{"external_id": "T1566.001"}]},
            {"type": "attack-pattern", "id": "t2", "name": "Gone", "revoked": True, "external_references": [{"external_id": "T1000"}]},
            {"type": "malware", "id": "m1", "name": "Zed", "labels": ["rat"], "description": "[Zed](http://z) bites"},
            {"type": "campaign", "id": "c1", "name": "Spring"},
            {"type": "relationship", "id": "r1", "relationship_type": "uses", "source_ref": "g1", "target_ref": "t1"},
            {"type": "relationship", "id": "r2", "relationship_type": "uses", "source_ref": "g1", "target_ref": "t2"},
            {"type": "relationship", "id": "r3", "relationship_type": "uses", "source_ref": "g1", "target_ref": "m1"},
            {"type": "relationship", "id": "r4", "relationship_type": "attributed-to", "source_ref": "c1", "target_ref": "g1"},
        ]
    }


@pytest.mark.parametrize("lines", [False, True])
def test_graph(spark, tmp_path, lines):
    path = tmp_path / "graph.json"
    path.write_text("\n".join(json.dumps(o) for o in bundle()["objects"]) if lines else json.dumps(bundle(), indent=1))
    objects, edges = doc.read_graph_bundle(spark, str(path), lines=lines)
    assert objects.count() == 5 and edges.count() == 4
    names = spark.createDataFrame([("HERON ",), ("nobody",)], "name string")
    groups = g.resolve_group(names, objects).select("group_id")
    assert [r.group_id for r in groups.collect()] == ["g1"]
    tech = g.technique_from_object(g.related(groups, objects, edges, "uses", ["attack-pattern"])).collect()
    assert [(r.technique_id, r.tactic) for r in tech] == [("T1566.001", "Initial Access")]
    soft = g.software_from_object(g.related(groups, objects, edges, "uses", ["malware", "tool"])).collect()
    assert [(r["name"], r.type, r.description) for r in soft] == [("Zed", "rat", "Zed bites")]
    assert [r["name"] for r in g.related_reverse(groups, objects, edges, "attributed-to", ["campaign"]).collect()] == ["Spring"]
    record = g.group_records(objects.filter("id = 'g1'"), g.group_supplement(spark)).first()
    assert (record.origin, record.first_seen, record.motivations, record.aliases) == ("China", "2011", ["money"], ["Heron"])


def test_kev_and_tables(spark, tmp_path):
    kev = {"vulnerabilities": [{"cveID": "CVE-1", "vendorProject": "V", "notes": "Used by Grey Heron", "vulnerabilityName": "Hole"}]}
    (tmp_path / "kev.json").write_text(json.dumps(kev, indent=1))
    row = doc.read_kev(spark, str(tmp_path / "kev.json")).first()
    assert (row.cve_id, row.vendor, row.product, row.search_text) == ("CVE-1", "V", "", "used by grey heron hole")
    (tmp_path / "actors.json").write_text(json.dumps({"actor_pos": 0, "canonical": "Grey Heron", "aliases": ["Heron ", "heron"], "origin": "X"}))
    got = {(r.alias, r.listed) for r in tables.read_aliases(spark, str(tmp_path / "actors.json")).collect()}
    assert got == {("heron", True), ("grey heron", False)}
    (tmp_path / "feeds.json").write_text(json.dumps({"feed_pos": 0, "name": "a", "tags": ["x"]}))
    (tmp_path / "mine.json").write_text(json.dumps({"feed_pos": 0, "name": "b", "enabled": False}))
    feeds = tables.read_feeds(spark, str(tmp_path / "feeds.json"), str(tmp_path / "mine.json"))
    assert sorted((r["name"], r.origin) for r in feeds.collect()) == [("a", 0), ("b", 1)]
    (tmp_path / "repos.json").write_text(json.dumps({"pos": 0, "name": "r", "tags": ["siem"], "tier": 1}))
    assert tables.read_detection_repos(spark, str(tmp_path / "repos.json")).first().tags == ["siem"]
    (tmp_path / "pulses.json").write_text(json.dumps({"pulse_id": "p", "tags": ["a"], "indicators": [{"type": "IPv4", "indicator": "1.1.1.1"}]}))
    assert doc.read_pulses(spark, str(tmp_path / "pulses.json")).first().indicators[0].indicator == "1.1.1.1"


def test_rules_and_corpus(spark, tmp_path):
    root = tmp_path / "sigma"
    (root / "win").mkdir(parents=True)
    (root / "win" / "a.yml").write_text(
        "title: 'Odd Shell'\nstatus: Test\ntags:\n- attack.t1059.001\n- attack.Execution\nlogsource:\n  category: process_creation\n  product: windows\n"
        "detection:\n  sel:\n    x: 1\n  condition: sel  and not f\nlevel: Critical\n"
    )
    (root / "b.yml").write_text("status: test\n")
    (root / "c.yaml").write_text("title: other t1003\n")
    rule = doc.read_rules(spark, str(root), "https://r/").collect()
    assert len(rule) == 1
    r = rule[0]
    assert (r.path, r.title, r.level, r.status, r.logsource, r.condition_summary, r.url) == (
        "win/a.yml", "Odd Shell", "critical", "test", "process_creation / windows", "sel and not f", "https://r/win/a.yml",
    )
    assert r.tags == ["attack.t1059.001", "attack.execution"]
    assert doc.read_rule_corpus(spark, str(root)).count() == 3


def test_rule_spellings(spark):
    body = (
        "title: It's \"odd\"  # note\r\nlevel: 'High' # c\ntags: [attack.T1003, \"x.y\", ]\nlogsource:\n    service: sysmon # s\n"
        "detection:\n    a: 1\n    condition: |\n        one of a*\n        and not b\n    timeframe: 5m\n"
    )
    r = doc.parse_rules(spark.createDataFrame([("p.yml", body)], "path string, content string")).first()
    assert (r.title, r.level, r.tags, r.logsource) == ("It's \"odd\"", "high", ["attack.t1003", "x.y"], "sysmon")
    assert r.condition_summary == "one of a* and not b"


def test_rule_values_beyond_one_line(spark):
    files = {
        "folded": "title: >-\n    A folded\n    title\nlevel: high\ntags:\n  - attack.t1003\ndetection:\n    a: 1\n    condition:\n        - a\n        - b and c\n",
        "quoted": "\"title\": \"Say \\\"hi\\\"\"\n'level': 'low'\n'detection':\n    'condition': [a, 'b']\n\"logsource\":\n    \"product\": linux\n",
        "plain": "title: starts here\n    and goes on\nlevel: low\ndetection:\n  condition: a\n",
        "single": "title: 'It''s'\ndetection:\n  condition: a\n",
        "none": "level: low\n", "open": "title: 'x\nlevel: low\n", "brackets": "title: x\ntags: [a, {b: c]\n",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    got = {r.path: r for r in doc.parse_rules(df).collect()}
    assert {p: r.title for p, r in got.items()} == {"folded": "A folded title", "quoted": 'Say "hi"', "plain": "starts here and goes on", "single": "It's"}
    assert got["folded"].condition_summary == "a | b and c" and got["folded"].tags == ["attack.t1003"]
    assert (got["quoted"].level, got["quoted"].condition_summary, got["quoted"].logsource) == ("low", "a | b", "linux")
    assert {(r.path, r.reason) for r in doc.unread_rules(df).collect()} == {("open", "yaml"), ("brackets", "yaml"), ("none", "title")}


def test_rule_anchors_and_flow_mappings(spark):
    files = {
        "anchor": "title: &t Odd\nlevel: *t\nstatus: !!str test\ndetection:\n  condition: a\n",
        "merge": "base: &base\n  product: linux\n  service: cron\nlogsource:\n  <<: *base\n  category: file\n  product: windows\ntitle: x\n",
        "top": "base: &b\n  level: low\n<<: [*b]\ntitle: x\n",
        "flow": "title: x: y\nlogsource: {category: a, product: \"b, c\",\n  service: d}  # s\ntags: [a,\n  b, # c\n  'it''s']\ndetection: {sel: {Image: ['*\\a', 2]}, condition: 'sel'}\n",
        "nested": "title: x\ndetection:\n  sel:\n    - Image|endswith: '\\cmd.exe'\n      b: 2\n    - foo\n  filter:\n    x:\n    - '*'\n    - \"a # b\"\n  condition: sel and not filter\nlevel: low\n",
        "unknown": "title: x\nlogsource:\n  <<: *gone\n  product: p\n  definition: 'a: b'\n", "two": "---\ntitle: a\n---\ntitle: b\nlevel: low\n...\n",
        "tabs": "title:\tx\nlogsource:\n\tproduct:\twindows\ndetection:\n\tcondition:\tsel\n",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    got = {r.path: r for r in doc.parse_rules(df).collect()}
    assert set(got) == set(files)
    assert (got["anchor"].title, got["anchor"].level, got["anchor"].status) == ("Odd", "odd", "test")
    assert got["merge"].logsource == "windows / cron / file" and got["top"].level == "low"
    flow = got["flow"]
    assert (flow.title, flow.logsource, flow.tags, flow.condition_summary) == ("x: y", "a / b, c / d", ["a", "b", "it's"], "sel")
    assert (got["nested"].condition_summary, got["nested"].level) == ("sel and not filter", "low")
    assert (got["unknown"].logsource, got["two"].title, got["two"].level) == ("p", "a", "low")
    assert (got["tabs"].title, got["tabs"].logsource, got["tabs"].condition_summary) == ("x", "windows", "sel")
    empty = spark.createDataFrame([("p", None)], "path string, content string")
    assert doc.unread_rules(empty).collect()[0].reason == "title" and doc.parse_rules(empty.limit(0)).count() == 0


def test_rule_reader_is_linear_and_never_fails():
    rng = random.Random(1)
    parts = ["title: ", "level: ", "  ", "- ", "'", '"', "[", "]", "{", "}", ":", " #c", "&a ", "*a ", "x", "\n", "\n", "tags:", "detection:", "condition: ", "<<: ", "|\n", "!t ", "\t"]
    for _ in range(3000):
        rulefiles.read_rule("".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))))
    long = ["[" * 50000, "[a" * 50000, '"' + "x\n" * 20000, "[a,\n" + "b,\n" * 20000, "&a " * 50000, "a" + " " * 50000, "x\n" + "  a:\n" * 50000, "x\n" + "".join(" " * i + "a:\n" for i in range(2000))]
    for text in long:
        start = time.perf_counter()
        rulefiles.read_rule("title: " + text)
        rulefiles.read_rule("detection:\n  condition: " + text)
        assert time.perf_counter() - start < 5


def test_folders_meet_actors(spark):
    from intelweave.operators.aliases import search_terms
    from intelweave.operators.articles import historical_reports

    reports = spark.createDataFrame([("The Grey Heron files", "a"), ("apt", "b"), ("grey heron", "c")], "folder string, path string")
    names = spark.createDataFrame([("Grey Heron", ["apt1"]), ("Other", ["files", "apt"])], "actor string, aliases array<string>")
    got = {(r.actor, r.path) for r in historical_reports(reports, search_terms(names, "folder")).collect()}
    assert got == {("Grey Heron", "a"), ("Grey Heron", "c"), ("Other", "a")}


def test_shared_folder_must_be_named(spark):
    from types import SimpleNamespace

    from intelweave.session import shared_folder

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None)))


def test_campaign_reports(spark, tmp_path):
    (tmp_path / "Grey Heron").mkdir()
    (tmp_path / "Grey Heron" / "first_look-1.md").write_text("no heading\n" * 6 + "# late heading\n")
    (tmp_path / "Grey Heron" / "b.md").write_text("intro\n## The title \nbody")
    got = {r.title: r.summary for r in doc.read_campaign_reports(spark, str(tmp_path)).collect()}
    assert set(got) == {"first look 1", "The title"} and got["The title"].startswith("intro")


def test_snapshots(spark):
    df = spark.createDataFrame(
        [("a", "2024-01-01 00:00:00", "old"), ("a", "2024-01-02 00:00:00", "new"), ("b", "2023-12-01 00:00:00", "stale")],
        "key string, fetched_at string, payload string",
    ).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = tables.latest_snapshot(df, "key", 24, "2024-01-02T12:00:00").collect()
    assert [(r.key, r.payload) for r in got] == [("a", "new")]
    assert sorted(r.payload for r in tables.newest_snapshot(df, "key").collect()) == ["new", "stale"]


def test_registry(spark):
    reg = Registry()
    reg.register("graph", 0, lambda s: s.createDataFrame([("A", "mitre_attack")], "actor_name string, source_id string"))
    reg.register("vendor", 9, lambda s: s.range(1), enrich_only=True)
    reg.register("feed", 1, lambda s: s.createDataFrame([("A", "x", 1)], "n string, source_id string, k int"), lambda df: df.withColumnRenamed("n", "actor_name"))
    reg.register("broken", 2, lambda s: s.range(1))
    got = reg.records(spark, ["feed", "vendor", "graph"]).collect()
    assert sorted((r.source_id, r.source_rank, r.k) for r in got if r.k) == [("x", 0, 1)] and len(got) == 2
    with pytest.raises(ValueError):
        reg.select(["nope"])
    with pytest.raises(ValueError):
        reg.records(spark, ["broken"])
    with pytest.raises(ValueError):
        reg.register("graph", 3, lambda s: s.range(1))


def test_rule_tables_are_dealt_out_before_they_are_read(spark):
    """A table of few splits is read by as many tasks as there are, and written in files of bounded size."""
    files = spark.range(400).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("path"), F.lit("title: a\nlevel: low\n").alias("content")).coalesce(1)
    plan = doc.parse_rules(files)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(xxhash64(path" in plan and plan.index("MapInArrow") < plan.index("hashpartitioning(xxhash64(path")
    assert doc.parse_rules(files).count() == 400


def test_corpus_files_are_of_bounded_size(spark, tmp_path):
    files = spark.range(400).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("tags: [attack.t"), (1000 + F.col("id")).cast("string"), F.lit("]")).alias("content")).coalesce(1)
    write_rule_files(files, str(tmp_path / "corpus"), 50)
    sizes = [len(p.read_text().splitlines()) for p in (tmp_path / "corpus").glob("*.txt")]
    assert sum(sizes) == 400 and max(sizes) <= 50
    assert rul.corpus_ids(doc.read_rule_corpus(spark, str(tmp_path / "corpus"), "*.txt")).count() == 400
