"""Top-k, first-wins and orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import ioc
from ..operators import families as fam
from ..operators import freshness as fresh
from ..operators import ordering as od
from ..operators import profile as prof
from ..operators import pulses as pul
from ..operators import rules as rul
from ..plans import indicators as ind
from ..plans import reports as rep
from . import common as k
from .aggregates import COVERED_SQL, FEED_USES, PARSED_FEED, RULES_SQL, feed, flagged, matched_rules
from .registry import query

c = F.col



@query(
    "cap_per_type",
    """SELECT actor, type, value FROM indicators QUALIFY row_number() OVER (PARTITION BY actor, type ORDER BY source_rank, doc, item) <= 10""",
    uses=["indicators"],
)
def _(t):
    return pul.cap_per_type(t.indicators, 10, order=("source_rank", "pos")).select("actor", "type", "value")


@query(
    "top_rules",
    f", {RULES_SQL} SELECT technique_id, path, level, rule_rank FROM best",
    uses=["techniques", "rules"],
)
def _(t):
    from ..sources.documents import parse_rules

    return rul.top_rules(parse_rules(t.rule_files)).select("technique_id", "path", "level", "rule_rank")


@query(
    "reports_per_folder",
    """SELECT lang AS folder, 'r' || lpad(doc_id::VARCHAR, 9, '0') || '.md' AS path FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 10""",
)
def _(t):
    from ..operators.articles import reports_per_folder

    name = F.concat(F.lit("r"), F.lpad(c("doc_id").cast("string"), 9, "0"), F.lit(".md"))
    return reports_per_folder(t.documents.select(c("lang").alias("folder"), name.alias("path")), 10)


@query(
    "keep_first",
    """SELECT actor, type, lower(value) AS vk, source_id, value FROM indicators QUALIFY row_number() OVER (PARTITION BY actor, type, lower(value) ORDER BY source_rank, doc, item) = 1""",
    uses=["indicators"],
)
def _(t):
    rows = od.keep_first(t.indicators, ["actor", "type", F.lower("value")])
    return rows.select("actor", "type", F.lower("value").alias("vk"), "source_id", "value")


@query(
    "latest_by",
    """SELECT key, event_id, event_type, payload FROM snapshots QUALIFY row_number() OVER (PARTITION BY key, event_type ORDER BY fetched_at DESC, event_id DESC) = 1""",
    uses=["snapshots"],
)
def _(t):
    return od.latest_by(t.snapshots, ["key", "event_type"], ["fetched_at", "event_id"]).select(
        "key", "event_id", "event_type", "payload"
    )


@query(
    "cap_per_family",
    f", {PARSED_FEED} SELECT family, type, value FROM feed QUALIFY row_number() OVER (PARTITION BY family ORDER BY pos) <= 45",
    uses=FEED_USES,
)
def _(t):
    return fam.cap_per_family(feed(t), 45).select("family", "type", "value")


_AGE = """
aged AS (SELECT actor, type, value, CASE WHEN date '2024-05-01' - d <= 30 THEN 'FRESH' WHEN date '2024-05-01' - d <= 90 THEN 'AGING' WHEN date '2024-05-01' - d > 90 THEN 'STALE' END AS bucket
  FROM (SELECT *, CAST(nullif(coalesce(nullif(last_seen, ''), first_seen), '') AS DATE) AS d FROM merged_i) x)"""
_AGE_RANK = k.case_sql("type", vocab.BLOCKLIST_TYPE_ORDER, "9")
_PAGE_RANK = k.case_sql("type", vocab.PAGE_TYPE_ORDER, "9")


@query(
    "cap_per_bucket",
    f""", {k.MERGED_INDICATORS}, {_AGE}
    SELECT actor, bucket, type, value, row_number() OVER (PARTITION BY actor, bucket ORDER BY {_AGE_RANK}, value) AS row_no FROM aged WHERE bucket <> 'STALE' QUALIFY row_no <= 50""",
    uses=["indicators"],
)
def _(t):
    return fresh.blocklist(k.merged_indicators(t), k.NOW).select("actor", "bucket", "type", "value", "row_no")


@query(
    "page_blocks",
    f""", {k.MERGED_INDICATORS}, {_AGE}
    SELECT actor, coalesce(bucket, 'STALE') AS bucket, type, value, row_number() OVER (PARTITION BY actor, coalesce(bucket, 'STALE') ORDER BY {_PAGE_RANK}, value) AS row_no FROM aged QUALIFY row_no <= 100""",
    uses=["indicators"],
)
def _(t):
    return fresh.page_rows(k.merged_indicators(t), k.NOW).select("actor", "bucket", "type", "value", "row_no")


@query(
    "bucket_counts",
    f""", {k.MERGED_INDICATORS}, {_AGE} SELECT actor, bucket, count(*) AS indicators FROM aged WHERE bucket IS NOT NULL GROUP BY ALL""",
    uses=["indicators"],
)
def _(t):
    return fresh.bucket_counts(fresh.with_bucket(k.merged_indicators(t), k.NOW))


@query(
    "tuned_blocks",
    f""", {k.MERGED_INDICATORS}, {_AGE.replace("<= 30", "<= 12").replace("<= 90", "<= 240").replace("> 90", "> 240")}
    SELECT actor, bucket, type, value, row_number() OVER (PARTITION BY actor, bucket ORDER BY {_AGE_RANK}, value) AS row_no FROM aged WHERE bucket <> 'STALE' QUALIFY row_no <= 7""",
    uses=["indicators"],
)
def _(t):
    tuned = k.settings(fresh_days=12, aging_days=240, playbook_rows=7)
    return fresh.blocklist(k.merged_indicators(t), k.NOW, tuned).select("actor", "bucket", "type", "value", "row_no")


@query(
    "tuned_confidence",
    f""", {k.MERGED_INDICATORS}
    SELECT actor, type, value, CASE WHEN len(sources) >= 2 THEN 'HIGH' WHEN list_has_any(sources, ['pages', 'src10']) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM merged_i""",
    uses=["indicators"],
)
def _(t):
    return k.merged_indicators(t, high_provenance=("pages", "src10")).select("actor", "type", "value", "confidence")


@query(
    "cap_pulses",
    """SELECT actor, pulse_id FROM pulses QUALIFY row_number() OVER (PARTITION BY actor ORDER BY pulse_pos) <= 15""",
    uses=["pulses"],
)
def _(t):
    return pul.cap_pulses(t.pulses, 15).select("actor", "pulse_id")


@query(
    "cap_families",
    """SELECT actor, name FROM families_used QUALIFY row_number() OVER (PARTITION BY actor ORDER BY pos) <= 12""",
    uses=["families_used"],
)
def _(t):
    return fam.cap_families(t.families_used, 12).select("actor", "name")


@query(
    "checklist",
    f""", {k.MERGED_TECHNIQUES}, {RULES_SQL}, lead AS (SELECT actor, technique_id, max(technique_rules) AS n, first(title ORDER BY rule_rank) AS title FROM hit GROUP BY actor, technique_id)
    SELECT actor, coalesce(nullif(tactic, ''), 'Unknown') AS tactic, technique_id, coalesce(m.name, '') AS name, confidence,
           coalesce(l.title || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ' more)' ELSE '' END, detection, '') AS hint
    FROM merged_t m LEFT JOIN lead l USING (actor, technique_id)""",
    uses=["techniques", "rules"],
)
def _(t):
    out = rep.checklist(k.merged_techniques(t), rul.lead_rules(matched_rules(t)))
    return out.select("actor", "tactic", "technique_id", "name", "confidence", "hint")


@query(
    "lead_rules",
    f""", {RULES_SQL} SELECT actor, technique_id, max(technique_rules) AS rule_count, first(title ORDER BY rule_rank) || CASE WHEN max(technique_rules) > 1 THEN ' (+' || (max(technique_rules) - 1) || ' more)' ELSE '' END AS summary FROM hit GROUP BY actor, technique_id""",
    uses=["techniques", "rules"],
)
def _(t):
    return rul.lead_rules(matched_rules(t)).select("actor", "technique_id", "rule_count", "summary")


@query(
    "merge_order",
    """SELECT source_id, CASE source_id WHEN 'malpedia' THEN 0 ELSE 1 END AS source_rank, i - 1 AS pos, a AS alias, count(*) AS n FROM (
         SELECT source_id, unnest(aliases) AS a, generate_subscripts(aliases, 1) AS i FROM records WHERE source_id IN ('malpedia', 'cisa')) x GROUP BY ALL""",
    uses=["records"],
)
def _(t):
    rows = od.ranked_sources(t.records.select("source_id", "aliases"), ["malpedia", "cisa"])
    out = od.positions(rows, "aliases", "alias")
    return out.groupBy("source_id", "source_rank", "pos", "alias").agg(F.count("*").alias("n"))


# --- orders -----------------------------------------------------------------------------


@query(
    "family_ioc_order",
    f""", {PARSED_FEED} SELECT family, type, value, row_number() OVER (PARTITION BY family ORDER BY confidence_score DESC, CASE threat_type WHEN 'botnet_cc' THEN 0 WHEN 'payload' THEN 1 ELSE 99 END, first_seen, type, value, pos) AS place
    FROM feed""",
    uses=FEED_USES,
)
def _(t):
    rows = od.top_n(feed(t), None, ["family"], [*fam.family_ioc_order(), c("type"), c("value"), c("pos")], rank="place")
    return rows.select("family", "type", "value", "place")


_EXPORT_RANK = k.case_sql("type", {t: i for i, t in enumerate(vocab.EXPORT_TYPE_ORDER)}, "99")


@query(
    "export_order",
    f""", {k.MERGED_INDICATORS} SELECT actor, type, value, row_number() OVER (PARTITION BY actor ORDER BY {_EXPORT_RANK}, value) AS place FROM merged_i""",
    uses=["indicators"],
)
def _(t):
    return od.top_n(k.merged_indicators(t), None, ["actor"], ind.export_order(), rank="place").select("actor", "type", "value", "place")


@query(
    "gap_order",
    f""", {COVERED_SQL} SELECT actor, technique_id, confidence, row_number() OVER (PARTITION BY actor ORDER BY CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END, technique_id) AS place FROM flagged WHERE NOT covered""",
    uses=["techniques", "rules"],
)
def _(t):
    rows = flagged(t).filter("not covered")
    return od.top_n(rows, None, ["actor"], rul.gap_order(), rank="place").select("actor", "technique_id", "confidence", "place")


@query(
    "techniques_by_id",
    f""", {k.MERGED_TECHNIQUES} SELECT technique_id, count(*) AS actors FROM merged_t GROUP BY technique_id ORDER BY technique_id""",
    uses=["techniques"],
)
def _(t):
    return k.merged_techniques(t).groupBy("technique_id").agg(F.count("*").alias("actors")).orderBy("technique_id")


@query(
    "top_families",
    f""", {PARSED_FEED} SELECT actor, family, hits FROM hits QUALIFY row_number() OVER (PARTITION BY actor ORDER BY hits DESC, family_pos) <= 5""",
    uses=FEED_USES,
)
def _(t):
    return fam.top_families(fam.family_hits(t.families_used, feed(t)), 5).select("actor", "family", "hits")


@query(
    "freshness_order",
    f""", {k.MERGED_INDICATORS} SELECT type, {_AGE_RANK} AS playbook_rank, {_PAGE_RANK} AS page_rank, count(*) AS n FROM merged_i GROUP BY type""",
    uses=["indicators"],
)
def _(t):
    rows = k.merged_indicators(t).groupBy("type").agg(F.count("*").alias("n"))
    return rows.select(
        "type", ioc.type_rank(c("type"), vocab.BLOCKLIST_TYPE_ORDER, 9).alias("playbook_rank"),
        ioc.type_rank(c("type"), vocab.PAGE_TYPE_ORDER, 9).alias("page_rank"), "n",
    )


@query(
    "list_caps",
    """SELECT actor, string_agg(v, ', ' ORDER BY o) AS aliases FROM (SELECT * FROM (
         SELECT actor, first(v ORDER BY source_rank, pos, i) AS v, min(row(source_rank, pos, i)) AS o FROM (SELECT actor, source_rank, pos, unnest(aliases) AS v, generate_subscripts(aliases, 1) AS i FROM records) x
         WHERE trim(v) <> '' GROUP BY actor, lower(trim(v))) y QUALIFY row_number() OVER (PARTITION BY actor ORDER BY o) <= 10) z GROUP BY actor""",
    uses=["records"],
)
def _(t):
    from .mapping import aliases_long

    return prof.top_list(aliases_long(t), c("value"), 10, "aliases")


@query(
    "high_confidence",
    f""", {k.MERGED_TECHNIQUES}, twice AS (SELECT actor, technique_id, confidence, first_at FROM merged_t UNION ALL SELECT 'low ' || actor, technique_id, 'LOW', first_at FROM merged_t)
    SELECT actor, technique_id FROM twice WHERE confidence = 'HIGH' QUALIFY row_number() OVER (PARTITION BY actor ORDER BY first_at) <= 10
    UNION ALL SELECT actor, technique_id FROM twice WHERE actor NOT IN (SELECT actor FROM twice WHERE confidence = 'HIGH') QUALIFY row_number() OVER (PARTITION BY actor ORDER BY first_at) <= 5""",
    uses=["techniques"],
)
def _(t):
    rows = k.merged_techniques(t)
    # the same techniques once more for actors that have no HIGH one
    low = rows.withColumns({"actor": F.concat(F.lit("low "), "actor"), "confidence": F.lit("LOW")})
    return prof.high_confidence(rows.unionByName(low), 10, 5).select("actor", "technique_id")
