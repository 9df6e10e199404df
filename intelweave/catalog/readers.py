"""Payload parsers over payload texts that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as rul
from ..operators.aliases import search_terms
from ..operators.articles import historical_reports
from ..session import scratch_path
from ..sources import documents as doc
from ..sources import tables
from ..sources.registry import Registry
from . import common as k
from .registry import query

c = F.col


def _xml(e):
    for plain, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        e = F.replace(e, F.lit(plain), F.lit(ref))
    return e


def _concat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# characters XML does not allow; documents with one are unreadable feeds
_BAD = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def rss(t):
    """Each document is an RSS feed of two items."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 300).cast("int"))
    body = _xml(c("text"))
    content = _concat(
        '<?xml version="1.0"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>f</title>',
        "<item><title>", _xml(F.lit("&lt;b&gt;")), "First ", c("source"), "</title><link> https://f.example/", c("doc_id").cast("string"),
        "</link><guid isPermaLink=\"false\">g1</guid><pubDate>Mon, ", F.date_format(day, "dd MMM yyyy"), " 10:00:00 GMT</pubDate><description>",
        body, "</description><category>energy</category><category>x</category></item>",
        "<item><title></title><guid>g", c("doc_id").cast("string"), "</guid><dc:date>", day.cast("string"), "T01:02:03Z</dc:date><description>short</description><content:encoded>long ",
        body, "</content:encoded></item><item><title/><description>nothing</description></item></channel></rss>",
    )
    return t.documents.select(c("doc_id").cast("string").alias("feed"), content.alias("content"))


def atom(t):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (c("doc_id") % 300).cast("int"))
    content = _concat(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">Entry ', c("source"),
        '</title><link href="https://a.example/', c("doc_id").cast("string"), '" rel="alternate"/><link href="https://other"/>',
        "<updated>", day.cast("string"), "T01:02:03Z</updated>",
        F.when(c("doc_id") % 2 == 0, _concat("<published>2023-02-03T00:00:00+02:00</published>")).otherwise(""),
        '<summary type="html">', _xml(c("text")), "</summary></entry></feed>",
    )
    return t.documents.select(c("doc_id").cast("string").alias("feed"), content.alias("content"))


_clean = lambda x: k.squash_sql(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
# an XML reader turns CR and CRLF into LF, which white-space clean-up hides
_readable = f"NOT regexp_matches(text, '{_BAD}')"


@query(
    "read_articles_rss",
    f"""SELECT doc_id::VARCHAR AS feed, 'First ' || source AS title, 'https://f.example/' || doc_id AS url, CAST(date '2024-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) AS date, md5({_clean('text')}) AS summary FROM documents WHERE {_readable}
        UNION ALL SELECT doc_id::VARCHAR, '', 'g' || doc_id, CAST(date '2024-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR), md5({_clean("'long ' || text")}) FROM documents WHERE {_readable}""",
)
def _(t):
    # the marked-up title arrives escaped, so the tag itself is what gets stripped
    rows = doc.parse_articles(rss(t))
    title = F.regexp_replace("title", "^&lt;b&gt; ?", "")
    return rows.select("feed", title.alias("title"), "url", "date", F.md5("summary").alias("summary"))


@query(
    "read_articles_atom",
    f"""SELECT doc_id::VARCHAR AS feed, 'Entry ' || source AS title, 'https://a.example/' || doc_id AS url,
          CASE WHEN doc_id % 2 = 0 THEN '2023-02-03' ELSE CAST(date '2024-01-01' + CAST(doc_id % 300 AS INT) AS VARCHAR) END AS date, md5({_clean('text')}) AS summary FROM documents WHERE {_readable}""",
)
def _(t):
    return doc.parse_articles(atom(t)).select("feed", "title", "url", "date", F.md5("summary").alias("summary"))


@query(
    "read_advisory_feed",
    f"""SELECT doc_id::VARCHAR AS feed, 'https://f.example/' || doc_id AS url, 'energy' AS tags, false AS from_atom FROM documents WHERE doc_id % 2 = 0 AND {_readable}
        UNION ALL SELECT doc_id::VARCHAR, '', '', false FROM documents WHERE doc_id % 2 = 0 AND {_readable}
        UNION ALL SELECT doc_id::VARCHAR, '', '', false FROM documents WHERE doc_id % 2 = 0 AND {_readable}
        UNION ALL SELECT doc_id::VARCHAR, 'https://a.example/' || doc_id, '', true FROM documents WHERE doc_id % 2 = 1 AND {_readable}""",
)
def _(t):
    both = rss(t).filter("feed % 2 = 0").unionByName(atom(t).filter("feed % 2 = 1"))
    rows = doc.parse_advisories(both)
    return rows.select("feed", "url", "tags", F.startswith("title", F.lit("Entry")).alias("from_atom"))


@query(
    "read_kev",
    """SELECT 'CVE-' || c_custkey AS cve_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS product, c_mktsegment AS vendor, lower('Seen with ' || c_name || ' Flaw ' || c_mktsegment) AS search_text FROM customer""",
)
def _(t):
    entry = F.to_json(
        F.struct(
            _concat("CVE-", c("c_custkey").cast("string")).alias("cveID"), c("c_mktsegment").alias("vendorProject"),
            F.when(c("c_custkey") % 3 != 0, c("c_name")).alias("product"), _concat("Flaw ", c("c_mktsegment")).alias("vulnerabilityName"),
            _concat("Seen with ", c("c_name")).alias("notes"),
        )
    )
    payloads = t.customer.select(_concat('{"vulnerabilities":[', entry, "]}").alias("p"))
    from ..schemas import VULNERABILITIES

    rows = payloads.select(F.posexplode(F.from_json("p", VULNERABILITIES)["vulnerabilities"]).alias("pos", "v")).select("v.*")
    return doc.kev_rows(rows).select("cve_id", "product", "vendor", "search_text")


@query(
    "read_actor_families",
    """SELECT actor, pos, slug FROM (
         SELECT s_name AS actor, unnest(['win.' || s_suppkey, 'elf.b', 'win.c']) AS slug, unnest([0, 1, 2]) AS pos FROM supplier WHERE s_suppkey % 3 = 0
         UNION ALL SELECT s_name, unnest(['x ' || s_suppkey, 'y']), unnest([0, 1]) FROM supplier WHERE s_suppkey % 3 = 1) x""",
)
def _(t):
    key = c("s_suppkey").cast("string")
    payload = (
        F.when(c("s_suppkey") % 3 == 0, _concat('{"families":{"win.', key, '":{"urls":[]},"elf.b":{},"win.c":{"uuid":"1"}},"meta":{}}'))
        .when(c("s_suppkey") % 3 == 1, _concat('{"families":["x ', key, '","y"]}')).otherwise('{"detail":"Not found."}')
    )
    return doc.parse_actor_families(t.supplier.select(c("s_name").alias("actor"), payload.alias("payload")))


@query(
    "read_actor_meta",
    """SELECT s_name AS actor, CASE WHEN s_suppkey % 2 = 0 THEN 'Russia' ELSE 'X' || s_nationkey END AS origin, CASE WHEN s_suppkey % 2 = 0 THEN 'spying' ELSE 'a|b' END AS motivations,
          CASE WHEN s_suppkey % 2 = 0 THEN 'Gov' ELSE 'Private' END AS sectors, 's ' || s_suppkey AS aliases, CASE WHEN s_suppkey % 2 = 0 THEN '2004' ELSE '' END AS first_seen FROM supplier""",
)
def _(t):
    key, even = c("s_suppkey").cast("string"), c("s_suppkey") % 2 == 0
    payload = _concat(
        '{"families":{},"meta":{"synonyms":["s ', key, '",""],', F.when(even, '"country":"ru","motivation":"spying","cfr-target-category":["Gov"],"since":2004').otherwise(
            _concat('"country":"X', c("s_nationkey").cast("string"), '","motivation":["a","b"],"cfr_target_category":"Private"')), "}}",
    )
    rows = doc.actor_meta(t.supplier.select(c("s_name").alias("actor"), payload.alias("payload")))
    return rows.select("actor", "origin", k.joined("motivations").alias("motivations"), k.joined("sectors").alias("sectors"), k.joined("aliases").alias("aliases"), "first_seen")


@query(
    "read_family_iocs",
    """SELECT p_brand || ' ' || p_partkey AS family, 'h' || p_partkey || '.example.com' AS ioc, 'domain' AS ioc_type, CAST(p_size AS VARCHAR) AS confidence_level FROM part WHERE p_size % 3 = 0""",
)
def _(t):
    item = _concat('[{"ioc":"h', c("p_partkey").cast("string"), '.example.com","ioc_type":"domain","confidence_level":', c("p_size").cast("string"), ',"tags":null}]')
    payload = (
        F.when(c("p_size") % 3 == 0, _concat('{"query_status":"ok","data":', item, "}"))
        .when(c("p_size") % 3 == 1, _concat('{"query_status":"no_results","data":', item, "}"))
        .otherwise('{"query_status":"ok","data":"nothing here"}')
    )
    rows = t.part.select(F.concat_ws(" ", "p_brand", c("p_partkey").cast("string")).alias("family"), payload.alias("payload"))
    return doc.parse_family_feed(rows).select("family", "ioc", "ioc_type", "confidence_level")


_cond = k.squash_sql("condition")


@query(
    "read_rules",
    f"""SELECT path, title, level, status, 'attack.execution|attack.' || tag_id AS tags,
          CASE WHEN category <> '' AND product <> '' THEN category || ' / ' || product WHEN category <> '' THEN category WHEN product <> '' THEN product ELSE 'unknown' END AS logsource,
          CASE WHEN length({_cond}) > 80 THEN ({_cond})[1:77] || '...' ELSE {_cond} END AS condition_summary, 'https://r.example/' || path AS url FROM rules WHERE title <> ''""",
    uses=["rules"],
)
def _(t):
    return doc.parse_rules(t.rule_files, "https://r.example/").withColumn("tags", k.joined("tags"))


@query(
    "read_reports",
    f"""SELECT lang AS folder, CASE WHEN doc_id % 2 = 0 THEN 'Report on ' || source ELSE 'rep ' || doc_id || ' x' END AS title,
          trim(regexp_replace((CASE WHEN doc_id % 2 = 0 THEN 'intro' || chr(10) || '## Report on ' || source || chr(10) ELSE '' END || replace(text, '#', ' ')), '^{k.WS}+|{k.WS}+$', '', 'g')) AS summary FROM documents""",
)
def _(t):
    body = F.replace("text", F.lit("#"), F.lit(" "))
    head = F.when(c("doc_id") % 2 == 0, _concat("intro\n## Report on ", c("source"), "\n")).otherwise("")
    files = t.documents.select(
        _concat("reports/", c("lang"), "/rep_", c("doc_id").cast("string"), "-x.md").alias("path"), F.concat(head, body).alias("content")
    )
    return doc.parse_reports(files).select("folder", "title", "summary")


@query(
    "latest_snapshot",
    """SELECT key, event_id FROM snapshots WHERE fetched_at >= timestamp '2024-01-20 00:00:00' - INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC) = 1""",
    uses=["snapshots"],
)
def _(t):
    return tables.latest_snapshot(t.snapshots, "key", 24, "2024-01-20T00:00:00").select("key", "event_id")


@query(
    "newest_snapshot",
    """SELECT key, event_id FROM snapshots QUALIFY row_number() OVER (PARTITION BY key ORDER BY fetched_at DESC, event_id DESC) = 1""",
    uses=["snapshots"],
)
def _(t):
    return tables.newest_snapshot(t.snapshots, "key", tie=("event_id",)).select("key", "event_id")



# --- readers over files that Spark wrote from the given tables ---------------------------


@query(
    "read_pulses",
    """SELECT pulse_id, name, created, subscriber_count, array_to_string(tags, '|') AS tags, attack_id, family_name FROM pulses""",
    uses=["pulses"],
)
def _(t):
    from .aggregates import pulses

    path = scratch_path(t.spark, "pulse-files")
    pulses(t).drop("actor", "pulse_pos").write.json(path)
    return doc.read_pulses(t.spark, path).select(
        "pulse_id", "name", "created", "subscriber_count", k.joined("tags").alias("tags"),
        c("attack_ids")[0]["external_id"].alias("attack_id"), c("malware_families")[0]["display_name"].alias("family_name"),
    )


@query(
    "read_detection_repos",
    "SELECT pos, name, url, platform, array_to_string(tags, '|') AS tags, tier FROM repos",
    uses=["repos"],
)
def _(t):
    path = scratch_path(t.spark, "repo-files")
    t.repos.write.json(path)
    return tables.read_detection_repos(t.spark, path).withColumn("tags", k.joined("tags"))


#: rules of one corpus file; a file is read whole by one task
RULES_A_FILE = 2000


def write_rule_files(files, path, rules_a_file: int = RULES_A_FILE) -> None:
    """Rule texts as corpus files of bounded size, written by as many tasks as the texts ask for."""
    dealt = files.repartition(F.xxhash64("path", "content")).select("content")
    dealt.write.option("maxRecordsPerFile", rules_a_file).text(path)


@query(
    "read_rule_corpus",
    "SELECT DISTINCT upper(tag_id) AS technique_id FROM rules",
    uses=["rules"],
)
def _(t):
    path = scratch_path(t.spark, "rule-files")
    write_rule_files(t.rule_files, path)
    corpus = doc.read_rule_corpus(t.spark, path, "*.txt")
    return rul.corpus_ids(corpus.withColumn("content", F.lower("content")))


@query(
    "unread_rules",
    "SELECT 'bad ' || path AS path, 'yaml' AS reason FROM rules UNION ALL SELECT path, 'title' FROM rules WHERE title = ''",
    uses=["rules"],
)
def _(t):
    # each file once more with an anchored text whose quote nothing closes
    odd = t.rule_files.select(_concat("bad ", c("path")).alias("path"), _concat(c("content"), "base: &base 'open\n").alias("content"))
    return doc.unread_rules(t.rule_files.unionByName(odd))


@query(
    "read_rules_anchored",
    """SELECT path, title, level, 'sysmon' || CASE WHEN category <> '' THEN ' / ' || category ELSE '' END || CASE WHEN product <> '' THEN ' / ' || product ELSE '' END AS logsource,
         'a | b' AS condition_summary FROM rules WHERE title <> ''""",
    uses=["rules"],
)
def _(t):
    """Anchored levels, a merged log source and a braced detection, read through."""
    content = F.regexp_replace("content", r"(?m)^level: (.*)$", "severity: &level $1\nlevel: *level")
    content = F.regexp_replace(content, r"(?m)^logsource:$", "base: &base {service: sysmon}\nlogsource:\n    <<: *base")
    content = F.regexp_replace(content, r"(?s)detection:\n.*?condition: [^\n]*\n", "detection: {sel: {Image: ['x', \"y\"]},\n  condition: [a, 'b']}\n")
    return doc.parse_rules(t.rule_files.withColumn("content", content)).select("path", "title", "level", "logsource", "condition_summary")


@query(
    "folder_reports",
    """SELECT DISTINCT n.actor, r.path FROM (SELECT 'ops of ' || lower(n_name) || ' and others' AS folder, 'reports/ops of ' || lower(n_name) || ' and others/rep_' || doc_id || '-x.md' AS path
         FROM documents JOIN nation ON n_nationkey = doc_id % 25) r
       JOIN (SELECT canonical AS actor, lower(canonical) AS term FROM actors
             UNION SELECT canonical, trim(lower(a)) FROM (SELECT canonical, unnest(aliases) AS a FROM actors) x WHERE length(trim(a)) > 4) n ON contains(r.folder, n.term)""",
    uses=["actors"],
)
def _(t):
    named = t.documents.join(t.nation, c("doc_id") % 25 == c("n_nationkey"))
    folder = _concat("ops of ", F.lower("n_name"), " and others")
    files = named.select(_concat("reports/", folder, "/rep_", c("doc_id").cast("string"), "-x.md").alias("path"), c("text").alias("content"))
    terms = search_terms(t.actors.select(c("canonical").alias("actor"), "aliases"), "folder")
    return historical_reports(doc.parse_reports(files), terms).select("actor", "path")


@query(
    "registry_records",
    """SELECT actor_name, source_id, 1 AS source_rank FROM records UNION ALL SELECT s_name, 'supplier', 0 FROM supplier""",
    uses=["records"],
)
def _(t):
    sources = Registry()
    sources.register("records", 0, lambda s: t.records.select("actor_name", "source_id"))
    # a plug-in: its own reader, and a mapper to the common columns
    sources.register(
        "supplier", 1, lambda s: t.supplier, lambda df: df.select(c("s_name").alias("actor_name"), F.lit("supplier").alias("source_id"))
    )
    sources.register("vendor", 2, lambda s: t.part, enrich_only=True)
    return sources.records(t.spark, ["supplier", "vendor", "records"]).select("actor_name", "source_id", "source_rank")
