"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advisories as adv
from ..operators import aliases as al
from ..operators import families as fam
from ..operators import mentions as men
from ..operators import merge as m
from ..operators import pulses as pul
from ..operators import repos as rep
from ..operators import rules as rul
from ..plans import stix
from . import common as k
from .aggregates import COVERED_SQL, FEED_USES, PARSED_FEED, RULES_SQL, feed, flagged, matched_rules
from .registry import query

c = F.col

ALIAS_SQL = """
ar AS (SELECT DISTINCT actor_pos, canonical, lower(trim(a)) AS alias, true AS listed FROM (SELECT actor_pos, canonical, unnest(aliases) AS a FROM actors) x WHERE trim(a) <> ''
       UNION ALL SELECT actor_pos, canonical, lower(canonical), false FROM actors),
idx AS (SELECT alias, arg_max(canonical, actor_pos * 2 + CASE WHEN listed THEN 0 ELSE 1 END) AS canonical FROM ar GROUP BY alias),
sets AS (SELECT canonical, list(DISTINCT alias ORDER BY alias) FILTER (WHERE listed) AS aliases FROM ar GROUP BY canonical),
res AS (SELECT n.pos, n.name, coalesce(i.canonical, trim(n.name)) AS canonical FROM names n LEFT JOIN idx i ON lower(trim(n.name)) = i.alias)"""
ALIAS_USES = ["actors", "names"]


def alias_tables(t):
    rows = al.alias_rows(t.actors)
    return rows, al.resolution_index(rows)


@query("alias_rows", f", {ALIAS_SQL} SELECT canonical, alias, listed FROM ar", uses=ALIAS_USES)
def _(t):
    return alias_tables(t)[0].select("canonical", "alias", "listed")


@query("resolve_canonical", f", {ALIAS_SQL} SELECT pos, name, canonical FROM res", uses=ALIAS_USES)
def _(t):
    return al.resolve_canonical(t.names, alias_tables(t)[1], "name").select("pos", "name", "canonical")


@query(
    "aliases_for",
    f", {ALIAS_SQL} SELECT r.pos, array_to_string(coalesce(s.aliases, [lower(r.name)]), '|') AS aliases FROM res r LEFT JOIN sets s USING (canonical)",
    uses=ALIAS_USES,
)
def _(t):
    rows, index = alias_tables(t)
    return al.aliases_for(t.names, rows, index, "name").select("pos", k.joined("aliases").alias("aliases"))


@query(
    "search_set",
    f""", {ALIAS_SQL}, full_set AS (SELECT r.pos, r.canonical, list_sort(list_distinct(list_append(coalesce(s.aliases, [lower(r.name)]), lower(r.name)))) AS l FROM res r LEFT JOIN sets s USING (canonical))
    SELECT pos, array_to_string(l, '|') AS search_set, array_to_string(list_filter(l, lambda a: a <> lower(canonical)), '|') AS reported FROM full_set""",
    uses=ALIAS_USES,
)
def _(t):
    rows, index = alias_tables(t)
    return al.search_set(t.names, rows, index, "name").select(
        "pos", k.joined("search_set").alias("search_set"), k.joined("reported").alias("reported")
    )


@query(
    "alias_stats",
    f""", {ALIAS_SQL} SELECT canonical, CAST(len(aliases) AS BIGINT) AS alias_count, array_to_string(aliases[1:4], ', ') || CASE WHEN len(aliases) > 4 THEN ' +' || (len(aliases) - 4) || ' more' ELSE '' END AS sample FROM sets""",
    uses=ALIAS_USES,
)
def _(t):
    return al.alias_stats(alias_tables(t)[0])


@query(
    "list_actors",
    f""", {ALIAS_SQL} SELECT canonical, CAST(len(aliases) AS BIGINT) AS alias_count FROM sets ORDER BY canonical""",
    uses=ALIAS_USES,
)
def _(t):
    return al.list_actors(alias_tables(t)[0]).select("canonical", "alias_count")


@query(
    "alias_conflicts",
    f""", {ALIAS_SQL} SELECT alias, string_agg(DISTINCT canonical, '|' ORDER BY canonical) AS claimed_by FROM ar GROUP BY alias HAVING count(DISTINCT canonical) > 1""",
    uses=ALIAS_USES,
)
def _(t):
    return al.alias_conflicts(alias_tables(t)[0]).withColumn("claimed_by", k.joined("claimed_by"))


@query(
    "user_actors",
    """SELECT canonical, count(*) AS aliases FROM (
         SELECT canonical, unnest(aliases) AS a FROM actors UNION ALL SELECT 'mine ' || s_suppkey, 'my ' || s_name FROM supplier) x WHERE trim(a) <> '' GROUP BY canonical""",
    uses=["actors"],
)
def _(t):
    mine = t.supplier.select(
        c("s_suppkey").alias("actor_pos"), F.concat(F.lit("mine "), c("s_suppkey").cast("string")).alias("canonical"),
        F.array(F.concat(F.lit("my "), c("s_name"))).alias("aliases"), F.lit("").alias("origin"), F.lit("").alias("motivation"),
    )
    rows = al.alias_rows(al.extend_actors(t.actors, mine))
    return rows.filter("listed").groupBy("canonical").agg(F.count("*").alias("aliases"))


# --- mentions --------------------------------------------------------------------

_HITS = """hits AS (SELECT d.doc_id, w.term, (length(lower(d.text)) - length(replace(lower(d.text), w.term, ''))) // length(w.term) AS n
  FROM documents d JOIN (SELECT DISTINCT term FROM terms) w ON contains(lower(d.text), w.term))"""


@query("term_hits", f", {_HITS} SELECT doc_id, md5(term) AS term, CAST(n AS INT) AS n FROM hits", uses=["terms"])
def _(t):
    return men.term_hits(t.documents, "doc_id", "text", t.terms).withColumn("term", F.md5("term"))


@query("term_hits_by_grams", f", {_HITS} SELECT doc_id, md5(term) AS term, CAST(n AS INT) AS n FROM hits", uses=["terms"])
def _(t):
    return men.term_hits(t.documents, "doc_id", "text", t.terms, strategy="grams").withColumn("term", F.md5("term"))


@query(
    "text_mentions",
    f", {_HITS} SELECT DISTINCT h.doc_id, t.actor FROM hits h JOIN terms t USING (term)",
    uses=["terms"],
)
def _(t):
    return men.text_mentions(t.documents, "doc_id", "text", t.terms)


_WORDS = "array_to_string(regexp_extract_all(lower({x}), '([\\p{{L}}\\p{{N}}]+)', 1), ' ')"


@query(
    "token_mentions",
    f"""SELECT DISTINCT d.doc_id, w.actor FROM (SELECT doc_id, ' ' || {_WORDS.format(x='text')} || ' ' AS x FROM documents) d
        JOIN (SELECT DISTINCT actor, {_WORDS.format(x='term')} AS term FROM terms) w ON contains(d.x, ' ' || w.term || ' ') WHERE w.term <> ''""",
    uses=["terms"],
)
def _(t):
    return men.token_mentions(t.documents, "doc_id", "text", t.terms)


def kev(t):
    from ..sources.documents import kev_rows

    return kev_rows(
        t.articles.select(
            c("article_id"), F.concat(F.lit("CVE-2024-"), c("article_id").cast("string")).alias("cveID"), c("source").alias("vendorProject"),
            F.lit("suite").alias("product"), c("title").alias("vulnerabilityName"), F.lit(None).cast("string").alias("shortDescription"),
            c("summary").alias("notes"), c("date").alias("dateAdded"), F.lit("").alias("dueDate"),
        )
    )


@query(
    "kev_for_actor",
    """SELECT DISTINCT w.actor, 'CVE-2024-' || a.article_id AS cve_id, a.source AS vendor FROM articles a JOIN terms w ON contains(lower(a.summary || ' ' || a.title), w.term)""",
    uses=["articles", "terms"],
)
def _(t):
    return adv.mentioned(kev(t), t.terms, "article_id").select("actor", "cve_id", "vendor")


@query(
    "advisory_for_actor",
    """SELECT DISTINCT w.actor, a.pos, a.date FROM advisories a JOIN terms w ON contains(lower(a.title || ' ' || a.summary || ' ' || a.tags || ' ' || a.body), w.term)""",
    uses=["advisories", "terms"],
)
def _(t):
    return adv.mentioned(adv.advisory_text(t.advisories), t.terms, "pos").select("actor", "pos", "date")


# --- rules and coverage --------------------------------------------------------------


@query(
    "rules_for_techniques",
    f", {RULES_SQL} SELECT actor, technique_id, path, title, rule_rank FROM hit",
    uses=["techniques", "rules"],
)
def _(t):
    return matched_rules(t).select("actor", "technique_id", "path", "title", "rule_rank")


@query(
    "coverage",
    f", {COVERED_SQL} SELECT actor, technique_id, covered FROM flagged",
    uses=["techniques", "rules"],
)
def _(t):
    return flagged(t).select("actor", "technique_id", "covered")


@query(
    "coverage_mention",
    f""", corpus AS (SELECT DISTINCT lower(tag_id) AS id FROM rules), seen AS (SELECT id FROM corpus UNION SELECT substr(id, 1, 5) FROM corpus),
    w AS (SELECT DISTINCT actor, technique_id FROM techniques)
    SELECT actor, technique_id, lower(technique_id) IN (SELECT id FROM seen) AS covered FROM w""",
    uses=["techniques", "rules"],
)
def _(t):
    ids = rul.corpus_ids(t.rule_files.withColumn("content", F.lower("content")), mode="mention")
    return rul.coverage(t.techniques.select("actor", "technique_id").distinct(), ids)


@query(
    "covered_techniques",
    f", {COVERED_SQL} SELECT actor, technique_id FROM flagged WHERE covered",
    uses=["techniques", "rules"],
)
def _(t):
    ids = rul.corpus_ids(t.rule_files.withColumn("content", F.lower("content")))
    return rul.covered(k.merged_techniques(t), ids).select("actor", "technique_id")


@query(
    "coverage_gaps",
    f", {COVERED_SQL} SELECT actor, technique_id, confidence FROM flagged WHERE NOT covered",
    uses=["techniques", "rules"],
)
def _(t):
    ids = rul.corpus_ids(t.rule_files.withColumn("content", F.lower("content")))
    return rul.gaps(k.merged_techniques(t), ids).select("actor", "technique_id", "confidence")


# --- families and indicators -----------------------------------------------------------


@query(
    "family_iocs",
    f""", {PARSED_FEED} SELECT actor, type, value, family AS malware_family, threat_label FROM matched
    QUALIFY row_number() OVER (PARTITION BY actor, type, lower(value) ORDER BY family_pos, pos) = 1""",
    uses=FEED_USES,
)
def _(t):
    from .exports import family_indicators

    return family_indicators(t).select("actor", "type", "value", "malware_family", "threat_label")


_NEW = """
known AS (SELECT DISTINCT actor, type, lower(value) AS vk FROM indicators WHERE source_id <> 'pages'),
cand AS (SELECT actor, type, upper(value) AS value FROM indicators WHERE source_id = 'pages'),
fresh AS (SELECT c.* FROM cand c ANTI JOIN known q ON c.actor = q.actor AND c.type = q.type AND lower(c.value) = q.vk)"""


def _split(t):
    known = t.indicators.filter("source_id <> 'pages'").select("actor", "type", "value")
    cand = t.indicators.filter("source_id = 'pages'").select("actor", "type", F.upper("value").alias("value"))
    return known, cand


@query("new_iocs", f", {_NEW} SELECT actor, type, value FROM fresh", uses=["indicators"])
def _(t):
    known, cand = _split(t)
    return m.new_rows(known, cand)


@query(
    "append_enrichment",
    f", {_NEW} SELECT actor, type, value FROM indicators WHERE source_id <> 'pages' UNION ALL SELECT actor, type, value FROM fresh",
    uses=["indicators"],
)
def _(t):
    known, cand = _split(t)
    return m.append_new(known, cand)


@query(
    "malware_meta",
    f""", {k.MERGED_MALWARE}, meta AS (SELECT actor, lower(name) AS name_key, arg_max(description, row(source_rank, pos)) AS d, arg_max(yara_count, row(source_rank, pos)) AS y FROM malware GROUP BY actor, lower(name))
    SELECT m.actor, m.name_key, coalesce(m.description, x.d) AS description, coalesce(m.yara_count, x.y) AS yara_count FROM merged_m m LEFT JOIN meta x USING (actor, name_key)""",
    uses=["malware"],
)
def _(t):
    meta = m.malware_meta(t.malware)
    out = m.fill_from(k.merged_malware(t), meta, ["actor", "name_key"], ["description", "yara_count"])
    return out.select("actor", "name_key", "description", "yara_count")


@query(
    "technique_meta",
    """SELECT actor, technique_id, first(name ORDER BY source_rank, pos) FILTER (WHERE name <> '') AS name, first(detection ORDER BY source_rank, pos) FILTER (WHERE detection <> '') AS detection,
          first(tactic ORDER BY source_rank, pos) FILTER (WHERE tactic <> '') AS tactic, first(name ORDER BY source_rank, pos) AS first_name FROM techniques GROUP BY actor, technique_id""",
    uses=["techniques"],
)
def _(t):
    first = m.technique_meta(t.techniques, per_field=False).select("actor", "technique_id", c("name").alias("first_name"))
    return m.technique_meta(t.techniques).join(first, ["actor", "technique_id"])


@query(
    "ioc_to_malware",
    f""", {PARSED_FEED}, fi AS (SELECT actor, type, value, family FROM matched QUALIFY row_number() OVER (PARTITION BY actor, type, lower(value) ORDER BY family_pos, pos) = 1)
    SELECT f.actor, f.value, lower(f.family) AS malware_key FROM fi f JOIN families_used u ON f.actor = u.actor AND f.family = u.name""",
    uses=FEED_USES,
)
def _(t):
    used = t.base.once("families", lambda: t.families_used)
    iocs = fam.family_iocs(used, feed(t), once=t.base.once)
    known = used.withColumn("name", F.concat(F.lit(" "), F.upper("name")))
    # indicators of families that nobody knows stay unlinked
    iocs = iocs.unionByName(iocs.withColumn("malware_family", F.concat(F.lit("no "), "malware_family")))
    return stix.ioc_to_malware(iocs, known).select("actor", "value", "malware_key")


_REPO = """
tags AS (SELECT DISTINCT actor, tag FROM (
   SELECT actor, replace(lower(unnest(sectors)), ' ', '-') AS tag FROM records
   UNION ALL SELECT actor, replace(lower(tactic), ' ', '-') FROM merged_t
   UNION ALL SELECT actor, lower(type) FROM merged_m) x WHERE coalesce(tag, '') <> ''),
prof AS (SELECT actor, list(tag) || ['universal'] AS tags FROM tags GROUP BY actor),
scored AS (SELECT p.actor, r.name, r.pos, len(list_intersect(p.tags, r.tags)) + CASE WHEN r.tier = 1 THEN 2 ELSE 0 END AS score FROM prof p CROSS JOIN repos r)"""


def matched_repos(t):
    sectors = t.records.select("actor", F.explode("sectors").alias("sector"))
    tags = rep.profile_tags(sectors, k.merged_techniques(t), k.merged_malware(t))
    return rep.match_repos(tags, t.repos)


@query(
    "match_repos",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {_REPO}
    SELECT actor, name, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY actor ORDER BY score DESC, pos) AS repo_rank FROM scored WHERE score > 0 QUALIFY repo_rank <= 6""",
    uses=["records", "techniques", "malware", "repos"],
)
def _(t):
    return matched_repos(t).select("actor", "name", "score", "repo_rank")


@query(
    "tag_overlap",
    "SELECT pos, CAST(len(list_intersect(tags, ['siem', 'universal', 'impact', 'small'])) AS INT) AS shared FROM repos",
    uses=["repos"],
)
def _(t):
    mine = F.array(*[F.lit(x) for x in ("siem", "universal", "impact", "small")])
    return t.repos.select("pos", rep.tag_overlap(c("tags"), mine).alias("shared"))


# --- pulses and families: stubs and details ------------------------------------------------


@query(
    "pulse_details",
    """, stubs AS (SELECT actor, pulse_id, 0 AS search_pos, pulse_pos FROM pulses UNION ALL SELECT actor, pulse_id, 1, pulse_pos FROM pulses UNION ALL SELECT actor, 'gone ' || pulse_id, 1, pulse_pos FROM pulses),
    uniq AS (SELECT actor, pulse_id, min(row(search_pos, pulse_pos)) AS o FROM stubs GROUP BY actor, pulse_id)
    SELECT u.actor, u.pulse_id, p.name FROM uniq u JOIN pulses p USING (pulse_id)""",
    uses=["pulses"],
)
def _(t):
    p = t.pulses
    # two searches find every pulse; the second also finds ids that have no details
    stubs = p.select("actor", "pulse_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("search_pos"), "pulse_pos")
    gone = p.select("actor", F.concat(F.lit("gone "), "pulse_id").alias("pulse_id"), F.lit(1).alias("search_pos"), "pulse_pos")
    stubs, details = stubs.unionByName(gone), p.select("pulse_id", "name")
    return pul.pulse_details(stubs, details).select("actor", "pulse_id", "name")


@query(
    "pulse_fallback",
    """SELECT actor, pulse_id, 'adversary' AS via FROM pulses
       UNION ALL SELECT 'other ' || actor, pulse_id, 'search' FROM pulses""",
    uses=["pulses"],
)
def _(t):
    primary = t.pulses.select("actor", "pulse_id", F.lit("adversary").alias("via"))
    # the fallback knows the same actors, and others that the first search does not know
    both = F.explode(F.array("actor", F.concat(F.lit("other "), "actor"))).alias("actor")
    fallback = t.pulses.select(both, "pulse_id", F.lit("search").alias("via"))
    return pul.with_fallback(primary, fallback)


@query(
    "family_details",
    """SELECT u.actor, u.name, p.p_partkey FROM families_used u JOIN part p ON p.p_brand = u.name""",
    uses=["families_used"],
)
def _(t):
    details = t.part.select(c("p_brand").alias("slug"), "p_partkey")
    used = t.families_used.withColumnRenamed("name", "slug")
    missing = used.withColumn("slug", F.concat(F.lit("gone "), "slug"))  # families without a detail row
    return fam.family_details(used.unionByName(missing), details).select(
        "actor", c("slug").alias("name"), "p_partkey"
    )


@query(
    "union_records",
    """SELECT source_id, count(*) AS n, count(url) AS urls, count(value) AS vals FROM (
         SELECT source_id, NULL AS url, value FROM indicators UNION ALL SELECT source_id, url, NULL FROM campaigns) x GROUP BY source_id""",
    uses=["indicators", "campaigns"],
)
def _(t):
    rows = m.union_records(t.indicators.select("source_id", "value"), t.campaigns.select("source_id", "url"))
    return rows.groupBy("source_id").agg(F.count("*").alias("n"), F.count("url").alias("urls"), F.count("value").alias("vals"))


@query(
    "distinct_technique_ids",
    "SELECT actor, string_agg(technique_id, '|' ORDER BY o) AS ids FROM (SELECT actor, technique_id, min(row(source_rank, pos)) AS o FROM techniques GROUP BY actor, technique_id) x GROUP BY actor",
    uses=["techniques"],
)
def _(t):
    from ..operators.ordering import distinct_values, gathered

    ids = distinct_values(t.techniques, c("technique_id"), fold=False)
    # ids are a bounded vocabulary, so the list of one actor is small
    return ids.groupBy("actor").agg(k.joined(gathered(c("value"), c("first_at"))).alias("ids"))


