"""Merges and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import families as fam
from ..operators import merge as m
from ..operators import profile as prof
from ..operators import pulses as pul
from ..operators import rules as rul
from ..operators.ordering import first_present, first_value_in_order
from . import common as k
from .registry import query


@query(
    "merge_techniques",
    f""", {k.MERGED_TECHNIQUES}
    SELECT actor, technique_id, name, tactic, description, detection, array_to_string(sources, '|') AS sources, confidence FROM merged_t""",
    uses=["techniques"],
)
def _(t):
    return k.merged_techniques(t).drop("first_at").withColumn("sources", k.joined("sources"))


@query(
    "technique_recommendations",
    """SELECT actor, technique_id, string_agg(rec, '|' ORDER BY o) AS recommendations FROM (
        SELECT actor, technique_id, rec, min(row(source_rank, pos, i)) AS o FROM (
            SELECT actor, technique_id, source_rank, pos, unnest(detection_recs) AS rec, generate_subscripts(detection_recs, 1) AS i FROM techniques) x
        GROUP BY actor, technique_id, rec) y GROUP BY actor, technique_id""",
    uses=["techniques"],
)
def _(t):
    from ..operators.ordering import gathered

    rows = m.technique_recommendations(t.techniques)
    # the binding has nine different recommendations, so a list is small here
    listed = gathered(F.col("recommendation"), F.struct("source_rank", "pos", "rec_pos"))
    return rows.groupBy("actor", "technique_id").agg(k.joined(listed).alias("recommendations"))


@query(
    "merge_indicators",
    f""", {k.MERGED_INDICATORS}
    SELECT actor, type, value, first_seen, last_seen, array_to_string(sources, '|') AS sources, confidence FROM merged_i""",
    uses=["indicators"],
)
def _(t):
    rows = k.merged_indicators(t)
    return rows.select("actor", "type", "value", "first_seen", "last_seen", k.joined("sources").alias("sources"), "confidence")


@query(
    "merge_indicators_own_sources",
    """SELECT type, lower(value) AS value_key, first(value ORDER BY source_rank, doc, item) AS value,
          array_to_string(list_distinct_ordered, '|') AS sources FROM (
       SELECT *, list_filter(all_s, lambda x, i: list_position(all_s, x) = i) AS list_distinct_ordered FROM (
         SELECT a.type, a.value, a.source_rank, a.doc, a.item, list_concat(o.own, s.srcs) AS all_s FROM indicators a
         JOIN (SELECT type, lower(value) AS vk, first(['feed ' || (doc % 3), source_id] ORDER BY source_rank, doc, item) AS own FROM indicators GROUP BY type, lower(value)) o ON a.type = o.type AND lower(a.value) = o.vk
         JOIN (SELECT type, vk, list(source_id ORDER BY source_rank) AS srcs FROM (SELECT DISTINCT type, lower(value) AS vk, source_id, source_rank FROM indicators) d GROUP BY type, vk) s ON a.type = s.type AND lower(a.value) = s.vk) j) l
       GROUP BY type, lower(value), list_distinct_ordered""",
    uses=["indicators"],
)
def _(t):
    own = F.array(F.concat(F.lit("feed "), (F.col("pos.doc") % 3).cast("string")), F.col("source_id"))
    rows = m.merge_indicators(t.indicators.drop("actor").withColumn("sources", own), by=())
    return rows.select("type", "value_key", "value", k.joined("sources").alias("sources"))


@query(
    "merge_malware",
    f""", {k.MERGED_MALWARE}
    SELECT actor, name_key, name, description, type, array_to_string(aliases, '|') AS aliases, yara_count FROM merged_m""",
    uses=["malware"],
)
def _(t):
    rows = k.merged_malware(t)
    return rows.select("actor", "name_key", "name", "description", "type", k.joined("aliases").alias("aliases"), "yara_count")


@query(
    "merge_cves",
    """SELECT actor, cve_id, first(product ORDER BY source_rank, pos) AS product, first(vendor ORDER BY source_rank, pos) AS vendor,
          first(date_added ORDER BY source_rank, pos) AS date_added FROM cves WHERE cve_id <> '' GROUP BY actor, cve_id""",
    uses=["cves"],
)
def _(t):
    return m.merge_cves(t.cves).select("actor", "cve_id", "product", "vendor", "date_added")


@query(
    "merge_advisories",
    """SELECT actor, coalesce(nullif(url, ''), title) AS key, first(title ORDER BY source_rank, pos) AS title, first(date ORDER BY source_rank, pos) AS date
       FROM advisories WHERE coalesce(nullif(url, ''), title) <> '' GROUP BY actor, coalesce(nullif(url, ''), title)""",
    uses=["advisories"],
)
def _(t):
    return m.merge_advisories(t.advisories).select("actor", m.article_identity().alias("key"), "title", "date")


@query(
    "merge_campaigns",
    f""", {k.MERGED_CAMPAIGNS}
    SELECT actor, name, description, url, first_seen, last_seen FROM merged_c""",
    uses=["campaigns"],
)
def _(t):
    return k.merged_campaigns(t).select("actor", "name", "description", "url", "first_seen", "last_seen")


@query(
    "merge_scalars",
    """SELECT actor, first(actor_name ORDER BY source_rank, pos) FILTER (WHERE actor_name <> '') AS actor_name,
          first(mitre_group_id ORDER BY source_rank, pos) FILTER (WHERE mitre_group_id <> '') AS mitre_group_id,
          first(origin ORDER BY source_rank, pos) FILTER (WHERE origin <> '') AS origin,
          first(first_seen ORDER BY source_rank, pos) FILTER (WHERE first_seen <> '') AS first_seen,
          first(description ORDER BY source_rank, pos) FILTER (WHERE description <> '') AS description
       FROM records GROUP BY actor""",
    uses=["records"],
)
def _(t):
    return m.merge_scalars(t.records, ["actor_name", "mitre_group_id", "origin", "first_seen", "description"])


@query(
    "merge_string_lists",
    """SELECT actor, string_agg(v, '|' ORDER BY o) AS aliases FROM (
        SELECT actor, first(v ORDER BY source_rank, pos, i) AS v, min(row(source_rank, pos, i)) AS o FROM (
            SELECT actor, source_rank, pos, unnest(aliases) AS v, generate_subscripts(aliases, 1) AS i FROM records) x
        WHERE trim(v) <> '' GROUP BY actor, lower(trim(v))) y GROUP BY actor""",
    uses=["records"],
)
def _(t):
    from ..operators.ordering import gathered

    rows = m.merge_strings(t.records, "aliases")
    # the binding has 21 different aliases, so a list is small here
    return rows.groupBy("actor").agg(k.joined(gathered(F.col("value"), F.col("first_at"))).alias("aliases"))


@query(
    "merge_string_fields",
    """SELECT actor, first(v ORDER BY f, source_rank, pos, i) AS value FROM (
          SELECT actor, 0 AS f, source_rank, pos, unnest(sectors) AS v, generate_subscripts(sectors, 1) AS i FROM records
          UNION ALL SELECT actor, 1, source_rank, pos, unnest(motivations), generate_subscripts(motivations, 1) FROM records) x
       WHERE trim(v) <> '' GROUP BY actor, lower(trim(v))""",
    uses=["records"],
)
def _(t):
    return m.merge_string_fields(t.records, ["sectors", "motivations"]).select("actor", "value")


@query(
    "sources_cited",
    """SELECT actor, string_agg(s, '|' ORDER BY s) AS sources_cited FROM (
         SELECT DISTINCT actor, unnest([source_id, 'agg ' || (pos % 2)]) AS s FROM records) x WHERE s <> '' GROUP BY actor""",
    uses=["records"],
)
def _(t):
    rows = t.records.withColumn("listed", F.array(F.concat(F.lit("agg "), (F.col("pos") % 2).cast("string"))))
    return m.sources_cited(rows, extra="listed").withColumn("sources_cited", k.joined("sources_cited"))


@query(
    "source_ledger",
    "SELECT actor, source_id, source_citation, source_url, retrieved_at FROM records WHERE source_id <> ''",
    uses=["records"],
)
def _(t):
    return m.source_ledger(t.records)


@query(
    "confidence_labels",
    f""", {k.MERGED_INDICATORS}
    SELECT type, confidence, count(*) AS n FROM merged_i GROUP BY type, confidence""",
    uses=["indicators"],
)
def _(t):
    return k.merged_indicators(t).groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query(
    "confidence_summary",
    f""", {k.MERGED_TECHNIQUES}
    SELECT actor, count(*) FILTER (WHERE confidence = 'HIGH') AS high, count(*) FILTER (WHERE confidence = 'MEDIUM') AS medium,
           count(*) FILTER (WHERE confidence = 'LOW') AS low FROM merged_t GROUP BY actor""",
    uses=["techniques"],
)
def _(t):
    return m.confidence_summary(k.merged_techniques(t))


PARSED_FEED = """
parsed AS (
  SELECT family, pos, CASE lower(ioc_type) WHEN 'ip:port' THEN 'ip' WHEN 'domain' THEN 'domain' WHEN 'url' THEN 'url' WHEN 'md5_hash' THEN 'hash_md5' WHEN 'sha256_hash' THEN 'hash_sha256' END AS type,
    nullif(CASE WHEN lower(ioc_type) = 'ip:port' THEN trim(split_part(trim(ioc), ':', 1)) ELSE trim(ioc) END, '') AS value,
    coalesce(CAST(confidence_level AS INT), 0) AS confidence_score, threat_type,
    CASE threat_type WHEN 'botnet_cc' THEN 'Botnet C2' WHEN 'payload' THEN 'Payload Delivery' ELSE 'Odd Kind' END AS threat_label,
    substr(first_seen, 1, 10) AS first_seen, coalesce(substr(last_seen, 1, 10), '') AS last_seen,
    coalesce(nullif(malware, ''), nullif(malware_printable, ''), '') AS malware
  FROM family_feed_raw),
feed AS (SELECT *, threat_label || CASE WHEN malware <> '' THEN ' — ' || malware ELSE '' END AS description FROM parsed WHERE type IS NOT NULL AND value IS NOT NULL),
matched AS (SELECT u.actor, u.pos AS family_pos, c.* FROM families_used u JOIN feed c ON u.name = c.family),
hits AS (SELECT actor, family, count(*) AS hits, min(family_pos) AS family_pos FROM matched GROUP BY actor, family)"""
FEED_USES = ["family_feed_raw", "families_used"]


def feed(t):
    return fam.parse_family_ioc(t.family_feed_raw)


@query("family_hits", f""", {PARSED_FEED} SELECT actor, family, hits FROM hits""", uses=FEED_USES)
def _(t):
    return fam.family_hits(t.families_used, feed(t)).select("actor", "family", "hits")


RULES_SQL = """
tagged AS (SELECT upper(tag_id) AS technique_id, path, title, level, CASE level WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'informational' THEN 4 ELSE 99 END AS lr FROM rules WHERE title <> ''),
best AS (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY lr, title, path) AS rule_rank, count(*) OVER (PARTITION BY technique_id) AS technique_rules FROM tagged QUALIFY rule_rank <= 10),
wanted AS (SELECT DISTINCT actor, technique_id FROM techniques),
hit AS (SELECT w.actor, b.* FROM wanted w JOIN best b USING (technique_id))"""


def matched_rules(t):
    from ..sources.documents import parse_rules

    return rul.rules_for_techniques(t.techniques, parse_rules(t.rule_files))


@query(
    "rule_counts",
    f""", {RULES_SQL} SELECT actor, technique_id, max(technique_rules) AS rule_count FROM hit GROUP BY actor, technique_id""",
    uses=["techniques", "rules"],
)
def _(t):
    return rul.rule_counts(matched_rules(t))


@query(
    "rule_total",
    f""", {RULES_SQL} SELECT actor, CAST(sum(technique_rules) AS BIGINT) AS rule_count FROM hit WHERE rule_rank = 1 GROUP BY actor""",
    uses=["techniques", "rules"],
)
def _(t):
    return rul.rule_total(matched_rules(t))


COVERED_SQL = f"""{k.MERGED_TECHNIQUES},
corpus AS (SELECT DISTINCT upper(unnest(regexp_extract_all(lower(tag_id), 't\\d{{4}}(?:\\.\\d{{3}})?'))) AS technique_id FROM rules),
flagged AS (SELECT *, technique_id IN (SELECT technique_id FROM corpus) AS covered FROM merged_t)"""


def flagged(t):
    lowered = t.rule_files.withColumn("content", F.lower("content"))
    return rul.coverage(k.merged_techniques(t), rul.corpus_ids(lowered))


@query(
    "coverage_pct",
    f""", {COVERED_SQL} SELECT actor, count(*) FILTER (WHERE covered) AS covered, count(*) AS total,
    CAST(round_even(100.0 * count(*) FILTER (WHERE covered) / count(*), 0) AS INT) AS pct FROM flagged GROUP BY actor""",
    uses=["techniques", "rules"],
)
def _(t):
    return rul.coverage_pct(flagged(t))


@query(
    "tactic_frequency",
    f""", {k.MERGED_TECHNIQUES}
    SELECT actor, tactic, techniques, row_number() OVER (PARTITION BY actor ORDER BY techniques DESC, o) AS tactic_rank FROM (
      SELECT actor, tactic, count(*) AS techniques, min(first_at) AS o FROM merged_t WHERE coalesce(tactic, '') <> '' GROUP BY actor, tactic) x
    QUALIFY tactic_rank <= 5""",
    uses=["techniques"],
)
def _(t):
    return prof.tactic_frequency(k.merged_techniques(t))


@query(
    "distinct_tactics",
    f""", {k.MERGED_TECHNIQUES}
    SELECT actor, string_agg(DISTINCT tactic, '|' ORDER BY tactic) AS tactics FROM merged_t WHERE tactic <> '' GROUP BY actor""",
    uses=["techniques"],
)
def _(t):
    return prof.distinct_tactics(k.merged_techniques(t)).withColumn("tactics", k.joined("tactics"))


PULSE_SPELLING = {
    "ip": "IPv4", "email": "email", "hash_sha1": "FileHash-SHA1", "url": "URL", "hash_md5": "FileHash-MD5"
}


def pulses(t):
    """Pulse rows with their nested fields."""
    c = F.col
    from ..functions.ioc import indicators_in

    found = F.transform(
        indicators_in(c("description")),
        lambda x: F.struct(
            text.lookup(x["type"], PULSE_SPELLING, F.lit("other")).alias("type"),
            F.concat(F.lit(" "), x["value"]).alias("indicator"),
        ),
    )
    return t.pulses.select(
        "actor", "pulse_pos", "pulse_id", "name", "description", "created", "subscriber_count", "tags",
        F.array(
            F.struct(F.lit("").alias("id"), c("attack_id").alias("external_id"), c("attack_name").alias("display_name"))
        ).alias("attack_ids"),
        F.array(F.struct(c("family_id").alias("id"), c("family_name").alias("display_name"))).alias("malware_families"),
        found.alias("indicators"),
    )


@query(
    "pulse_stats",
    """SELECT actor, count(*) AS pulse_count, coalesce(min(nullif(regexp_extract(created, '^(\\d{4})', 1), '')), '') AS first_seen FROM pulses GROUP BY actor""",
    uses=["pulses"],
)
def _(t):
    return pul.pulse_stats(pulses(t))


@query(
    "best_description",
    "SELECT actor, first(description ORDER BY subscriber_count DESC, pulse_pos) AS description FROM pulses GROUP BY actor",
    uses=["pulses"],
)
def _(t):
    return pul.best_description(pulses(t))


@query(
    "pulse_techniques",
    """SELECT actor, technique_id, first(nm ORDER BY phase, pulse_pos, i) AS technique_name FROM (
         SELECT actor, 0 AS phase, pulse_pos, unnest(ids) AS technique_id, generate_subscripts(ids, 1) AS i, '' AS nm FROM (
            SELECT actor, pulse_pos, regexp_extract_all(description || ' ' || array_to_string(tags, ' ') || ' ' || attack_id, '\\b(T\\d{4}(?:\\.\\d{3})?)\\b', 1) AS ids FROM pulses) a
         UNION ALL SELECT actor, 1, pulse_pos, upper(trim(attack_id)), 0, attack_name FROM pulses WHERE regexp_full_match(upper(trim(attack_id)), 'T\\d{4}(\\.\\d{3})?')) x
       GROUP BY actor, technique_id""",
    uses=["pulses"],
)
def _(t):
    return pul.pulse_techniques(pulses(t)).select("actor", "technique_id", "technique_name")


@query(
    "pulse_sectors",
    """SELECT DISTINCT actor, sector FROM (
         SELECT actor, unnest(CASE WHEN tags[2] = 'Oil and Gas' THEN ['Energy'] WHEN tags[2] = 'government' THEN ['Government'] WHEN tags[2] = 'banking' THEN ['Financial Services'] ELSE [] END) AS sector FROM pulses) x""",
    uses=["pulses"],
)
def _(t):
    return pul.pulse_sectors(pulses(t)).select("actor", "sector")


@query(
    "pulse_malware",
    """SELECT actor, first(nm ORDER BY pulse_pos) AS name FROM (SELECT actor, pulse_pos, trim(coalesce(nullif(family_name, ''), family_id)) AS nm FROM pulses) x
       WHERE nm <> '' GROUP BY actor, lower(nm)""",
    uses=["pulses"],
)
def _(t):
    return pul.pulse_malware(pulses(t)).select("actor", "name")


_UNIQUE_PULSE_IOCS = """
found AS (SELECT actor, doc, item, type, value FROM indicators WHERE source_id <> 'pages' AND type <> 'hash_sha256'),
uniq AS (SELECT actor, value, first(type ORDER BY doc, item) AS type, min(row(doc, item)) AS o FROM found GROUP BY actor, value)"""


@query(
    "pulse_iocs",
    f""", {_UNIQUE_PULSE_IOCS}
    SELECT actor, type, value FROM uniq""",
    uses=["indicators"],
)
def _(t):
    return pul.pulse_iocs(pulses(t)).select("actor", "type", "value")


@query(
    "ioc_counts",
    f""", {k.MERGED_INDICATORS}
    SELECT actor, type, count(*) AS total, count(*) FILTER (WHERE list_contains(sources, 'pages')) AS added,
           count(*) FILTER (WHERE NOT list_contains(sources, 'pages')) AS other FROM merged_i GROUP BY actor, type""",
    uses=["indicators"],
)
def _(t):
    return fam.ioc_counts(k.merged_indicators(t), F.array_contains("sources", "pages"))


@query(
    "advisory_techniques",
    """SELECT actor, technique_id, min(pos) AS first_pos FROM (SELECT actor, pos, unnest(ids) AS technique_id, generate_subscripts(ids, 1) AS i FROM (
         SELECT actor, pos, regexp_extract_all(body || ' ' || summary, '\\b(T\\d{4}(?:\\.\\d{3})?)\\b', 1) AS ids FROM advisories) a) x GROUP BY actor, technique_id""",
    uses=["advisories"],
)
def _(t):
    from ..operators.advisories import advisory_techniques, normalize_advisory

    rows = advisory_techniques(normalize_advisory(t.advisories), order=("pos",))
    return rows.select("actor", "technique_id", F.col("pos").alias("first_pos"))


_SECTORS = (
    "list_filter([CASE WHEN contains(x, 'energy') OR contains(x, 'electric') OR contains(x, 'oil') OR contains(x, 'gas') THEN 'Energy' END, "
    "CASE WHEN contains(x, 'financial') OR contains(x, 'bank') THEN 'Financial Services' END, "
    "CASE WHEN contains(x, 'water') THEN 'Water' END, CASE WHEN contains(x, 'critical infra') THEN 'Critical Infrastructure' END], lambda s: s IS NOT NULL)"
)


@query(
    "advisory_sectors",
    f"""SELECT DISTINCT actor, unnest({_SECTORS}) AS sector FROM (SELECT actor, lower(tags || ' ' || summary) AS x FROM advisories) a""",
    uses=["advisories"],
)
def _(t):
    from ..operators.advisories import advisory_sectors, normalize_advisory

    return advisory_sectors(normalize_advisory(t.advisories), order=("pos",)).select("actor", "sector")


@query(
    "raw_passthrough",
    """SELECT actor, type, first(value ORDER BY source_rank, doc, item) AS value, first(source_id ORDER BY source_rank, doc, item) AS source_id
       FROM indicators WHERE type <> 'cve' GROUP BY actor, type, lower(value)""",
    uses=["indicators"],
)
def _(t):
    return prof.raw_passthrough(t.indicators).select("actor", "type", "value", "source_id")


@query(
    "attribution_backfill",
    """SELECT b.actor, coalesce(nullif(b.origin, ''), r.origin) AS origin, array_to_string(coalesce(b.motivations, r.motivations), '|') AS motivations FROM (
          SELECT actor, CASE WHEN actor LIKE '%1' THEN '' ELSE 'known' END AS origin, CASE WHEN actor LIKE '%2' THEN NULL ELSE ['kept'] END AS motivations FROM (SELECT DISTINCT actor FROM records) d) b
       LEFT JOIN (SELECT actor, first(origin ORDER BY source_rank, pos) FILTER (WHERE origin <> '') AS origin,
                  first(motivations ORDER BY source_rank, pos) FILTER (WHERE len(motivations) > 0) AS motivations FROM records GROUP BY actor) r USING (actor)""",
    uses=["records"],
)
def _(t):
    profiles = t.records.select("actor").distinct().select(
        "actor",
        F.when(F.endswith("actor", F.lit("1")), "").otherwise("known").alias("origin"),
        F.when(F.endswith("actor", F.lit("2")), F.array().cast("array<string>")).otherwise(F.array(F.lit("kept"))).alias("motivations"),
    )
    return prof.backfill_attribution(profiles, t.records).withColumn("motivations", k.joined("motivations"))


@query(
    "first_present_field",
    """SELECT actor, first(source_url ORDER BY source_rank, pos) FILTER (WHERE source_url IS NOT NULL) AS source_url,
          first(source_citation ORDER BY source_rank, pos) FILTER (WHERE pos % 3 = 1) AS citation_any,
          first(source_citation ORDER BY source_rank, pos) FILTER (WHERE source_citation <> '') AS citation FROM records GROUP BY actor""",
    uses=["records"],
)
def _(t):
    r = t.records
    return r.groupBy("actor").agg(
        first_value_in_order("source_url", F.col("source_url").isNotNull()).alias("source_url"),
        first_value_in_order("source_citation", F.col("pos") % 3 == 1).alias("citation_any"),
        first_present(r, "source_citation").alias("citation"),
    )
