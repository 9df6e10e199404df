"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, ioc, labels
from ..operators import normalize as nz
from ..operators import rules as rul
from ..operators.articles import has_article_identity
from ..operators.ordering import ranked_sources
from ..plans import stix
from . import common as k
from .registry import query

c = F.col


@query(
    "require_identity",
    """SELECT pos, CASE WHEN coalesce(actor_name, '') = '' THEN 'actor_name' WHEN coalesce(source_id, '') = '' THEN 'source_id' ELSE '' END AS reason FROM records""",
    uses=["records"],
)
def _(t):
    good, bad = nz.require_identity(t.records)
    return good.select("pos", F.lit("").alias("reason")).unionByName(bad.select("pos", "reason"))


@query(
    "valid_techniques",
    """SELECT technique_id, count(*) AS n FROM (SELECT upper(trim(technique_id || CASE WHEN length(name) % 5 = 1 THEN 'x' ELSE ' ' END)) AS technique_id FROM techniques) x
       WHERE regexp_full_match(technique_id, 'T\\d{4}(\\.\\d{3})?') GROUP BY technique_id""",
    uses=["techniques"],
)
def _(t):
    odd = F.concat(F.lower("technique_id"), F.when(F.length("name") % 5 == 1, "x").otherwise(" "))
    return nz.normalize_techniques(t.techniques.withColumn("technique_id", odd)).groupBy("technique_id").agg(F.count("*").alias("n"))


@query(
    "valid_indicators",
    """SELECT type, value, count(*) AS n FROM (SELECT CASE WHEN type = 'ip' THEN 'ip' WHEN type = 'hash_sha1' THEN 'hash_sha1' ELSE type END AS type, value, doc FROM indicators) x
       WHERE doc % 4 <> 0 AND doc % 7 <> 0 GROUP BY ALL""",
    uses=["indicators"],
)
def _(t):
    spelled = F.when(c("type") == "ip", "IPv4").when(c("type") == "hash_sha1", " FileHash-SHA1").otherwise(c("type"))
    rows = t.indicators.withColumns(
        {
            "value": F.when(c("pos.doc") % 7 == 0, "  ").otherwise(F.concat(c("value"), F.lit(" "))),
            "type": F.when(c("pos.doc") % 4 == 0, "mutex").otherwise(spelled),
            "context": F.lit(None).cast("string"),
        }
    )
    return nz.normalize_indicators(rows, k.NOW).groupBy("type", "value").agg(F.count("*").alias("n"))


@query(
    "valid_malware",
    "SELECT trim(name) AS name, count(*) AS n FROM malware WHERE yara_count <> 3 GROUP BY ALL",
    uses=["malware"],
)
def _(t):
    rows = t.malware.withColumn("name", F.when(c("yara_count") == 3, " ").otherwise(c("name")))
    return nz.normalize_malware(rows).groupBy("name").agg(F.count("*").alias("n"))


@query(
    "valid_campaigns",
    """SELECT actor, pos, description, reference, CASE WHEN first_seen = '' THEN '' ELSE first_seen || 'T00:00:00+00:00' END AS date FROM campaigns WHERE description <> '' OR reference <> ''""",
    uses=["campaigns"],
)
def _(t):
    rows = nz.normalize_campaigns(t.campaigns.withColumn("date", c("first_seen")), k.NOW)
    return rows.select("actor", "pos", "description", "reference", "date")


@query(
    "within_lookback",
    """SELECT article_id, date FROM articles WHERE date IN ('', 'soon') OR (date <> 'soon' AND date <> '' AND TRY_CAST(date AS DATE) >= date '2024-05-01' - 365)""",
    uses=["articles"],
)
def _(t):
    return t.articles.filter(dates.within_lookback(c("date"), k.NOW, 365)).select("article_id", "date")


@query(
    "exportable_types",
    "SELECT type, count(*) AS n FROM (SELECT CASE WHEN doc % 3 = 0 THEN 'cve' WHEN doc % 3 = 1 THEN 'mutex' ELSE type END AS type FROM indicators) x WHERE type <> 'cve' GROUP BY type",
    uses=["indicators"],
)
def _(t):
    kind = F.when(c("pos.doc") % 3 == 0, "cve").when(c("pos.doc") % 3 == 1, "mutex").otherwise(c("type"))
    return t.indicators.select(kind.alias("type")).filter(ioc.is_exportable(c("type"))).groupBy("type").agg(F.count("*").alias("n"))


@query(
    "search_term_filter",
    """SELECT c_custkey, length(x) > 4 AND NOT regexp_full_match(x, '[gt]\\d+') AS pulse, length(x) > 4 AND NOT regexp_full_match(x, '[gtu][a-z]?\\d+') AS article,
          length(x) > 4 AS folder, length(x) > 4 AND NOT regexp_full_match(x, '[a-z]{1,3}[0-9]+') AS strict
       FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'g' || lpad(c_custkey::VARCHAR, 4, '0') WHEN 1 THEN 'ta' || (c_custkey + 100) WHEN 2 THEN 'unc' || (c_custkey + 100) WHEN 3 THEN lower(c_mktsegment) ELSE 'b' || (c_custkey % 100) END AS x FROM customer) y""",
)
def _(t):
    m5, num = c("c_custkey") % 5, lambda e: e.cast("string")
    name = (
        F.when(m5 == 0, F.concat(F.lit("G"), F.lpad(num(c("c_custkey")), 4, "0")))
        .when(m5 == 1, F.concat(F.lit("TA"), num(c("c_custkey") + 100))).when(m5 == 2, F.concat(F.lit("unc"), num(c("c_custkey") + 100)))
        .when(m5 == 3, c("c_mktsegment")).otherwise(F.concat(F.lit("B"), num(c("c_custkey") % 100)))
    )
    return t.customer.select(
        "c_custkey", *[labels.is_search_term(name, r).alias(r) for r in ("pulse", "article", "folder")],
        labels.is_search_term(name, "article", strict_ids=True).alias("strict"),
    )


@query(
    "select_sources",
    """SELECT source_id, CASE source_id WHEN 'alienvault_otx' THEN 0 WHEN 'mitre_attack' THEN 1 END AS source_rank, count(*) AS n FROM techniques WHERE source_id IN ('alienvault_otx', 'mitre_attack') GROUP BY ALL""",
    uses=["techniques"],
)
def _(t):
    rows = ranked_sources(t.techniques, ["alienvault_otx", "mitre_attack"])
    return rows.groupBy("source_id", "source_rank").agg(F.count("*").alias("n"))


@query(
    "rule_covers_exactly",
    """SELECT path, upper(tag_id) = 'T' || (1000 + length(path) % 150) AS covers FROM rules WHERE title <> ''""",
    uses=["rules"],
)
def _(t):
    from ..sources.documents import parse_rules

    tid = F.concat(F.lit("T"), (1000 + F.length("path") % 150).cast("string"))
    return parse_rules(t.rule_files).select("path", rul.covers_exactly(c("tags"), tid).alias("covers"))


@query(
    "patternable_iocs",
    """SELECT actor, type, count(DISTINCT value) AS n FROM (SELECT actor, CASE WHEN doc % 4 = 0 THEN 'mutex' ELSE type END AS type, value FROM indicators WHERE value <> '') x WHERE type <> 'mutex' GROUP BY ALL""",
    uses=["indicators"],
)
def _(t):
    rows = t.indicators.withColumn("type", F.when(c("pos.doc") % 4 == 0, "mutex").otherwise(c("type")))
    return stix.indicator_rows(rows, order=("source_rank", "pos")).groupBy("actor", "type").agg(F.count("*").alias("n"))


@query(
    "article_identity_filter",
    """SELECT article_id FROM articles WHERE title <> '' OR url <> ''""",
    uses=["articles"],
)
def _(t):
    return has_article_identity(t.articles).select("article_id")
