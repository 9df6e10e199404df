"""Projections to the common record and its entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import families as fam
from ..operators import graph as g
from ..operators import merge as m
from ..operators import normalize as nz
from ..operators import profile as prof
from . import common as k
from .aggregates import FEED_USES, PARSED_FEED, feed
from .graphs import arsenal_objects, campaign_objects, group_objects
from .registry import query

c = F.col
_relabel = k.case_sql("tactic", {t.lower(): t for t in vocab.TACTICS}, "''")


@query(
    "map_graph_source",
    f"""SELECT actor, technique_id, {_relabel} AS tactic, description, detection, source_id, count(*) AS n FROM (
          SELECT * REPLACE (CASE WHEN description = '' THEN '' ELSE description END AS description) FROM techniques) x
        GROUP BY ALL""",
    uses=["techniques"],
)
def _(t):
    rows = t.techniques.withColumn("technique_id", F.concat(F.lit(" "), F.lower("technique_id"))).withColumn(
        "source_id", F.when(F.col("source_id") != "mitre_attack", F.col("source_id"))
    )
    out = nz.map_techniques(rows, "mitre_attack")
    return out.groupBy("actor", "technique_id", "tactic", "description", "detection", "source_id").agg(F.count("*").alias("n"))


@query(
    "map_advisory_source",
    """SELECT actor, technique_id, tactic, count(*) AS n FROM techniques WHERE description <> '' GROUP BY ALL""",
    uses=["techniques"],
)
def _(t):
    rows = t.techniques.withColumn("technique_id", F.when(c("description") == "", " ").otherwise(F.lower("technique_id")))
    return nz.map_passthrough_techniques(rows, "cisa").groupBy("actor", "technique_id", "tactic").agg(F.count("*").alias("n"))


@query(
    "map_family_source",
    """SELECT actor, name, coalesce(nullif(type, ''), 'malware') AS type, array_to_string(aliases, '|') AS aliases, yara_count, count(*) AS n FROM malware GROUP BY ALL""",
    uses=["malware"],
)
def _(t):
    rows = nz.map_malware(t.malware.withColumn("type", F.nullif("type", F.lit(""))))
    return rows.groupBy("actor", "name", "type", k.joined("aliases").alias("aliases"), "yara_count").agg(F.count("*").alias("n"))


@query(
    "map_pulse_source",
    """SELECT actor, type, value, count(*) AS n FROM indicators WHERE doc % 3 <> 0 AND doc % 5 <> 0 GROUP BY ALL""",
    uses=["indicators"],
)
def _(t):
    rows = t.indicators.withColumns(
        {"value": F.when(c("pos.doc") % 5 != 0, c("value")), "type": F.when(c("pos.doc") % 3 == 0, "").otherwise(c("type"))}
    )
    return nz.map_indicators(rows).groupBy("actor", "type", "value").agg(F.count("*").alias("n"))


@query(
    "map_campaigns",
    """SELECT actor, trim(name) AS name, first_seen, last_seen, count(*) AS n FROM campaigns GROUP BY ALL""",
    uses=["campaigns"],
)
def _(t):
    return nz.map_campaigns(t.campaigns).groupBy("actor", "name", "first_seen", "last_seen").agg(F.count("*").alias("n"))


@query(
    "normalize_record",
    """SELECT pos, trim(regexp_replace(actor_name, '\\s+', ' ', 'g')) AS actor_name, source_id, coalesce(source_url, '') AS source_url,
          CASE pos % 5 WHEN 0 THEN '2024-03-01T10:00:00+00:00' WHEN 1 THEN '2024-03-04T00:00:00+00:00' WHEN 2 THEN '2024-02-05T08:30:00+00:00' ELSE '2024-05-01T00:00:00+00:00' END AS retrieved_at,
          coalesce(origin, '') AS origin, CASE pos % 4 WHEN 0 THEN '2009' WHEN 2 THEN '2015-06-07T00:00:00+00:00' ELSE '' END AS first_seen,
          'us|de' AS countries, coalesce(nullif(source_citation, ''), source_id) AS source_citation
       FROM records WHERE coalesce(actor_name, '') <> '' AND coalesce(source_id, '') <> ''""",
    uses=["records"],
)
def _(t):
    out = nz.normalize_record(t.records, k.NOW)
    return out.select(
        "pos", "actor_name", "source_id", "source_url", "retrieved_at", "origin", "first_seen",
        k.joined("countries").alias("countries"), "source_citation",
    )


@query(
    "normalize_advisory",
    """SELECT pos, title, CASE WHEN url = '' THEN 'https://fallback.example/' || pos ELSE url END AS url, date, summary FROM advisories""",
    uses=["advisories"],
)
def _(t):
    from ..operators.advisories import normalize_advisory

    rows = t.advisories.withColumnRenamed("date", "published").withColumnRenamed("summary", "description")
    rows = rows.withColumn("link", F.concat(F.lit("https://fallback.example/"), c("pos").cast("string")))
    return normalize_advisory(rows).select("pos", "title", "url", "date", "summary")


@query(
    "parse_family_ioc",
    f""", {PARSED_FEED} SELECT family, type, value, confidence_score, threat_type, threat_label, first_seen, last_seen, malware, description, count(*) AS n FROM feed GROUP BY ALL""",
    uses=FEED_USES,
)
def _(t):
    cols = ["family", "type", "value", "confidence_score", "threat_type", "threat_label", "first_seen", "last_seen", "malware", "description"]
    return feed(t).groupBy(*cols).agg(F.count("*").alias("n"))


def family_details(t):
    """One detail payload per part."""
    return t.part.select(
        c("p_partkey").alias("pos"),
        F.concat(F.lit("win."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), c("p_partkey").cast("string")).alias("slug"),
        F.when(c("p_size") % 3 == 0, "").otherwise(c("p_name")).alias("common_name"),
        F.concat(F.lit("see [the page](https://e.org) "), F.repeat(F.concat("p_name", F.lit(" ")), c("p_size"))).alias("description"),
        F.array(F.when(c("p_size") % 4 == 0, "Dropper").when(c("p_size") % 4 == 1, "wiper").otherwise("misc")).alias("tags"),
        F.when(c("p_size") % 2 == 0, F.array(c("p_brand"))).alias("alt_names"),
        F.when(c("p_size") % 5 == 0, F.lit(None)).otherwise(F.array_repeat(c("p_name"), c("p_size") % 3)).alias("yara"),
    )


@query(
    "normalize_family",
    f"""SELECT pos, slug, name, type, d AS description, aliases, yara_count FROM (
         SELECT p_partkey AS pos, 'win.' || replace(p_name, ' ', '_') || '_' || p_partkey AS slug,
           CASE WHEN p_size % 3 = 0 THEN {k.title_sql("p_name || ' ' || p_partkey")} ELSE p_name END AS name,
           CASE p_size % 4 WHEN 0 THEN 'loader' WHEN 1 THEN 'wiper' ELSE 'malware' END AS type,
           'see the page ' || repeat(p_name || ' ', p_size) AS d, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS aliases,
           CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size % 3 END AS yara_count FROM part) x""",
)
def _(t):
    rows = fam.normalize_family(family_details(t))
    return rows.select("pos", "slug", "name", "type", "description", k.joined("aliases").alias("aliases"), "yara_count")


@query(
    "group_record",
    """SELECT id, name AS actor_name, mitre_id,
          array_to_string(list_filter(coalesce(aliases, []), lambda a: lower(a) <> lower(name)), '|') AS aliases,
          trim(regexp_replace(description, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')) AS description,
          CASE WHEN mitre_id = 'G0032' THEN 'North Korea' WHEN mitre_id IN ('G0007', 'G0016', 'G0034', 'G0010') THEN 'Russia' WHEN mitre_id IN ('G0045', 'G0096', 'G1017') THEN 'China'
               WHEN mitre_id IN ('G0064', 'G0049') THEN 'Iran' WHEN mitre_id = 'G0094' THEN 'North Korea' WHEN mitre_id = 'G0046' THEN 'Eastern Europe'
               WHEN pos % 5 = 0 THEN 'Iran' WHEN pos % 6 = 0 THEN 'Russia' WHEN pos % 6 = 1 THEN 'China' WHEN pos % 6 = 2 THEN 'North Korea' ELSE '' END AS origin
       FROM (SELECT *, CASE WHEN regexp_full_match(gid, 'G\\d{4}') THEN gid ELSE '' END AS mitre_id FROM groups) g""",
    uses=["groups"],
)
def _(t):
    groups = group_objects(t)
    return g.group_records(groups, g.group_supplement(t.spark), keep=("id",)).select(
        "id", "actor_name", "mitre_id", k.joined("aliases").alias("aliases"), "description", "origin"
    )


@query(
    "technique_from_graph",
    f"""SELECT id, tid AS technique_id, name, CASE WHEN phase = '' THEN 'Impact' ELSE {k.title_sql("replace(phase, '-', ' ')")} END AS tactic,
          trim(description) AS description,
          CASE WHEN x_mitre_detection = '' THEN detection ELSE x_mitre_detection END AS detection
        FROM arsenal WHERE tid IS NOT NULL AND type = 'attack-pattern'""",
    uses=["arsenal"],
)
def _(t):
    rows = g.technique_from_object(arsenal_objects(t).filter("type = 'attack-pattern'"))
    return rows.select("id", "technique_id", "name", "tactic", "description", "detection")


@query(
    "software_from_graph",
    """SELECT id, name, coalesce(label, 'malware') AS type, regexp_replace(description, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g') AS description
       FROM arsenal WHERE name <> '' AND type IN ('malware', 'tool')""",
    uses=["arsenal"],
)
def _(t):
    rows = g.software_from_object(arsenal_objects(t).filter("type in ('malware', 'tool')"))
    return rows.select("id", "name", "type", "description")


@query(
    "campaign_from_graph",
    """SELECT id, name, regexp_replace(description, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g') AS description,
          CASE WHEN ref_source = 'mitre-attack' THEN ref_url ELSE '' END AS url FROM campaign_objects""",
    uses=["campaign_objects"],
)
def _(t):
    return g.campaign_from_object(campaign_objects(t)).select("id", "name", "description", "url")


@query(
    "display_fields",
    f""", {k.MERGED_TECHNIQUES}
    SELECT actor, technique_id, coalesce(name, '') AS technique_name, tactic,
       (SELECT 1) AS one, first_rec AS detection FROM merged_t JOIN (
         SELECT actor, technique_id, first(detection_recs[1] ORDER BY source_rank, pos) AS first_rec FROM techniques GROUP BY actor, technique_id) r USING (actor, technique_id)""",
    uses=["techniques"],
)
def _(t):
    merged = k.merged_techniques(t).withColumns({"name": F.lit(None).cast("string"), "tactic": F.lit("")})
    out = nz.display_fields(merged, m.technique_meta(t.techniques), m.technique_recommendations(t.techniques))
    return out.select("actor", "technique_id", "technique_name", "tactic", F.lit(1).alias("one"), "detection")


HEADER = "SELECT actor, min(origin) AS origin FROM records GROUP BY actor"


def sectors_long(t):
    return m.merge_string_fields(t.records, ["sectors"])


def aliases_long(t):
    return m.merge_strings(t.records, "aliases")


def actor_articles(t):
    """Documents as articles of the actors."""
    return t.articles.withColumn("actor", F.concat(F.lit("NATION_"), (c("pos") % 25).cast("string"))).withColumn(
        "relevance", (c("pos") * 7 % 100).cast("int")
    )


_FIRST = """
mal8 AS (SELECT actor, string_agg(name, ', ' ORDER BY first_at) AS top_malware FROM (SELECT * FROM merged_m QUALIFY row_number() OVER (PARTITION BY actor ORDER BY first_at) <= {mal}) x GROUP BY actor),
camp AS (SELECT actor, string_agg(name, ', ' ORDER BY first_at) AS campaigns FROM (SELECT * FROM merged_c QUALIFY row_number() OVER (PARTITION BY actor ORDER BY first_at) <= {camp}) x GROUP BY actor),
al AS (SELECT actor, string_agg(v, ', ' ORDER BY o) AS aliases FROM (SELECT * FROM (
    SELECT actor, first(v ORDER BY source_rank, pos, i) AS v, min(row(source_rank, pos, i)) AS o FROM (SELECT actor, source_rank, pos, unnest(aliases) AS v, generate_subscripts(aliases, 1) AS i FROM records) x
    WHERE trim(v) <> '' GROUP BY actor, lower(trim(v))) y QUALIFY row_number() OVER (PARTITION BY actor ORDER BY o) <= {alias}) z GROUP BY actor),
art AS (SELECT actor, string_agg('- [' || source || '] ' || title, chr(10) ORDER BY rel DESC, pos) AS recent FROM (
    SELECT 'NATION_' || (pos % 25) AS actor, pos, source, title, pos * 7 % 100 AS rel FROM articles QUALIFY row_number() OVER (PARTITION BY pos % 25 ORDER BY pos * 7 % 100 DESC, pos) <= {art}) x GROUP BY actor)"""


def _facts(t, executive):
    header = t.records.groupBy("actor").agg(F.min("origin").alias("origin"))
    return prof.brief_facts(
        header, k.merged_techniques(t), k.merged_malware(t), k.merged_campaigns(t), sectors_long(t), aliases_long(t),
        actor_articles(t), executive=executive,
    )


@query(
    "brief_facts",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {_FIRST.format(mal=8, camp=5, alias=8, art=6)},
    tac AS (SELECT actor, string_agg(tactic, ', ' ORDER BY n DESC, o) AS top_tactics FROM (SELECT actor, tactic, count(*) AS n, min(first_at) AS o FROM merged_t WHERE tactic <> '' GROUP BY actor, tactic
       QUALIFY row_number() OVER (PARTITION BY actor ORDER BY count(*) DESC, min(first_at)) <= 5) x GROUP BY actor)
    SELECT actor, coalesce(origin, '') AS origin, coalesce(top_malware, '') AS top_malware, coalesce(campaigns, '') AS campaigns, coalesce(aliases, '') AS aliases, coalesce(recent, '') AS recent, coalesce(top_tactics, '') AS top_tactics
    FROM ({HEADER}) h LEFT JOIN mal8 USING (actor) LEFT JOIN camp USING (actor) LEFT JOIN al USING (actor) LEFT JOIN art USING (actor) LEFT JOIN tac USING (actor)""",
    uses=["techniques", "malware", "campaigns", "records", "articles"],
)
def _(t):
    return _facts(t, False).drop("sectors")


@query(
    "executive_facts",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {_FIRST.format(mal=6, camp=4, alias=6, art=4)},
    hi AS (SELECT actor, string_agg(name, ', ' ORDER BY first_at) AS high_techniques FROM (SELECT * FROM merged_t WHERE confidence = 'HIGH' AND name <> '' QUALIFY row_number() OVER (PARTITION BY actor ORDER BY first_at) <= 8) x GROUP BY actor)
    SELECT actor, coalesce(origin, '') AS origin, coalesce(top_malware, '') AS top_malware, coalesce(campaigns, '') AS campaigns, coalesce(aliases, '') AS aliases, coalesce(recent, '') AS recent, coalesce(high_techniques, '') AS high_techniques
    FROM ({HEADER}) h LEFT JOIN mal8 USING (actor) LEFT JOIN camp USING (actor) LEFT JOIN al USING (actor) LEFT JOIN art USING (actor) LEFT JOIN hi USING (actor)""",
    uses=["techniques", "malware", "campaigns", "records", "articles"],
)
def _(t):
    return _facts(t, True).drop("sectors")
