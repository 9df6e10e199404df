"""Exports: indicator list, graph, matrix layer, report, playbook, profiles.

Those that write also read their files back, so the files are what is compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import merge as m
from ..operators import rules as rul
from ..plans import indicators as ind
from ..plans import layers, profiles, reports, stix
from ..plans.run import ProfileRun
from ..session import scratch_path
from . import common as k
from .aggregates import COVERED_SQL, FEED_USES, PARSED_FEED, RULES_SQL, feed, flagged, matched_rules
from .joins import _REPO, matched_repos
from .registry import query

c = F.col
_FI = "fi AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY actor, type, lower(value) ORDER BY family_pos, pos) = 1)"


def _named(rows):
    return rows.withColumn("sources", F.array(F.lit("family_feed"), F.lit(""), F.lit("x")))


def family_indicators(t):
    """Indicators of the families."""
    run = profile_run(t)
    # nothing else of the run is asked for, so its joins are not written
    run.landed["families"] = lambda: t.families_used
    run.prepare("families", "family_feed")
    return _named(run.indicators)


def _folder_sizes(run, lines: int = 1):
    """(actor_slug, rows): about how many rows an export of all indicators writes to each folder, so many lines for each."""
    slug = labels.file_slug(c("actor")).alias("actor_slug")
    return run.indicator_counts().groupBy(slug).agg((F.sum("indicators") * lines).alias("rows"))


def profile_run(t):
    """A run over the bound tables; the joins that several of them start from are written first."""
    from ..sources.documents import parse_rules
    from .mapping import actor_articles

    # the order lines come out of a join by order, well dealt, and are written as they are
    landed = {
        "records": lambda: t.records, "techniques": lambda: t.write_once(placed=["o_orderkey"], intel=()).techniques,
        "malware": lambda: t.write_once(placed=["o_orderkey"], intel=()).malware,
        "families": lambda: t.write_once(placed=["o_orderkey"], intel=()).families_used,
        "family_feed": lambda: feed(t), "campaigns": lambda: t.write_once(placed=["o_orderkey"]).campaigns,
        "cves": lambda: t.write_once(placed=["o_orderkey"]).cves, "advisories": lambda: t.advisories,
        "articles": lambda: actor_articles(t), "rules": lambda: parse_rules(t.rule_files), "repos": lambda: t.repos,
    }
    return ProfileRun(landed, t.base, k.settings())


@query(
    "ioc_csv",
    f""", {PARSED_FEED}, {_FI}
    SELECT regexp_replace(lower(actor), '[^a-z0-9]', '_', 'g') AS actor_slug, type, value, CAST(confidence_score AS VARCHAR) AS confidence, threat_type, family AS malware_family, first_seen, 'family_feed|x' AS sources FROM fi""",
    uses=FEED_USES,
)
def _(t):
    run = profile_run(t)
    run.landed["families"] = lambda: t.families_used
    run.prepare("families", "family_feed")
    listed = run.indicators_as(lambda rows, by: ind.ioc_list(_named(rows), by=by), "listed_indicators")
    path = scratch_path(t.spark, "ioc-csv")
    ind.write_ioc_csv(listed.withColumn("actor_slug", labels.file_slug(c("actor"))), path, sizes=_folder_sizes(run), compression="gzip")
    schema = ", ".join(f"{n} string" for n in [*ind.COLUMNS, "actor_slug"])
    return t.spark.read.schema(schema).option("header", True).csv(path)


@query(
    "ioc_list",
    f""", {k.MERGED_INDICATORS}
    SELECT actor, type, value, confidence, '' AS threat_type, '' AS malware_family, first_seen, array_to_string(sources, '|') AS sources FROM merged_i""",
    uses=["indicators"],
)
def _(t):
    return ind.ioc_list(k.merged_indicators(t))


def _actors(t):
    from ..operators.ordering import gathered
    from .mapping import aliases_long

    facts = m.merge_scalars(t.records, ["actor_name", "mitre_group_id", "origin", "first_seen", "description", "motivations"])
    # an object carries its aliases, so one actor's names are gathered here
    names = aliases_long(t).groupBy("actor").agg(gathered(c("value"), c("first_at")).alias("aliases"))
    return facts.join(names, "actor", "left").join(m.sources_cited(t.records), "actor", "left")


def _graph(t, malware=None, campaigns=None):
    """The run, the actors, and the nodes and edges of the graph over tables that are written once; malware and campaigns by default the merged ones."""
    run = profile_run(t)
    written = lambda name, build: lambda: run.base.once(name, build)
    kept = [written("graph_actors", lambda: _actors(t)), written("graph_malware", malware or (lambda: run.malware)), written("graph_campaigns", campaigns or (lambda: k.merged_campaigns(t)))]
    run.prepare("techniques", "owners")
    run.base.together(*kept)
    actors, mal, camp = (x() for x in kept)
    # what needs the order lines is written by now
    t.release("intel", "placed")
    iocs = run.indicators_as(lambda rows, by: stix.indicator_texts(_named(rows), k.NOW, by=by), "graph_indicators")
    nodes = stix.stix_nodes(actors, run.techniques, mal, iocs, camp, k.NOW)
    return run, actors, nodes, stix.stix_edges(run.techniques, mal, iocs, camp, k.NOW)


def _stix(t):
    return _graph(t)[2:]


def _object_fields(body, *fields):
    """Fields of objects, each body read once; what is no text is JSON."""
    return F.from_json(body, ", ".join(f"{f} string" for f in fields))


_SID = lambda kind, *keys: (
    "(SELECT '" + kind + "--' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] FROM (SELECT sha256('" + kind + "'"
    + "".join(f" || chr(1) || {x}" for x in keys) + ") AS h) q)"
)
_PAT = (
    "CASE type WHEN 'ip' THEN '[ipv4-addr:value = ''' WHEN 'domain' THEN '[domain-name:value = ''' WHEN 'url' THEN '[url:value = ''' "
    "WHEN 'hash_md5' THEN '[file:hashes.''MD5'' = ''' END || value || ''']'"
)
STIX_USES = ["techniques", "malware", "campaigns", *FEED_USES, "records"]


_STAMP = lambda x: f"coalesce(CASE WHEN length({x}) = 4 THEN {x} || '-01-01T00:00:00.000Z' ELSE {x} || 'T00:00:00.000Z' END, '')"
_ACTORS = """
nm AS (SELECT actor, string_agg(v, '|' ORDER BY o) AS aliases FROM (
    SELECT actor, first(v ORDER BY source_rank, pos, i) AS v, min(row(source_rank, pos, i)) AS o FROM (SELECT actor, source_rank, pos, unnest(aliases) AS v, generate_subscripts(aliases, 1) AS i FROM records) x
    WHERE trim(v) <> '' GROUP BY actor, lower(trim(v))) y GROUP BY actor),
a AS (SELECT actor, first(actor_name ORDER BY source_rank, pos) FILTER (WHERE actor_name <> '') AS nm, first(mitre_group_id ORDER BY source_rank, pos) FILTER (WHERE mitre_group_id <> '') AS gid,
    first(first_seen ORDER BY source_rank, pos) FILTER (WHERE first_seen <> '') AS seen, first(description ORDER BY source_rank, pos) FILTER (WHERE description <> '') AS said FROM records GROUP BY actor)"""


@query(
    "stix_nodes",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {PARSED_FEED}, {_FI}, {_ACTORS}
    SELECT actor, 'identity' AS type, {_SID('identity', "'intelweave'")} AS id, 'intelweave' AS name, '' AS description, '' AS ref, '' AS extra, '' AS more, true AS made FROM a
    UNION ALL SELECT actor, 'intrusion-set', {_SID('intrusion-set', 'actor')}, nm, coalesce(said, 'Threat actor ' || nm || '.'), coalesce(gid, ''), coalesce(substr(seen, 1, 4) || '-01-01T00:00:00.000Z', ''), coalesce(aliases, ''), true FROM a LEFT JOIN nm USING (actor)
    UNION ALL SELECT actor, 'attack-pattern', {_SID('attack-pattern', 'actor', 'technique_id')}, coalesce(name, technique_id), coalesce(description, ''), technique_id, coalesce(replace(lower(tactic), ' ', '-'), ''), coalesce(detection, ''), true FROM merged_t
    UNION ALL SELECT actor, 'malware', {_SID('malware', 'actor', 'name_key')}, trim(name), coalesce(description, ''), '', 'true', coalesce(array_to_string(list_filter(aliases, lambda x: x <> '' AND x <> trim(name)), '|'), ''), true FROM merged_m
    UNION ALL SELECT actor, 'indicator', {_SID('indicator', 'actor', _PAT)}, type || ': ' || value, description, {_PAT}, first_seen || 'T00:00:00.000Z', CASE WHEN confidence_score > 0 THEN least(confidence_score, 100)::VARCHAR ELSE '' END || '|' || family, true FROM fi
    UNION ALL SELECT actor, 'campaign', {_SID('campaign', 'actor', 'name')}, name, coalesce(description, ''), '', {_STAMP('first_seen')}, {_STAMP('last_seen')}, true FROM merged_c""",
    uses=STIX_USES,
)
def _(t):
    nodes = _stix(t)[0].select("actor", "type", "id", "name", _object_fields(
        c("body"), "created", "modified", "created_by_ref", "description", "external_references", "pattern", "first_seen", "last_seen",
        "kill_chain_phases", "is_family", "valid_from", "aliases", "x_mitre_detection", "confidence", "x_malware_family",
    ).alias("o"))
    get = lambda n: F.coalesce(c(f"o.{n}"), F.lit(""))
    inner = lambda n, p: F.coalesce(F.get_json_object(f"o.{n}", p), F.lit(""))
    listed = lambda n: F.coalesce(F.array_join(F.from_json(c(f"o.{n}"), "array<string>"), "|"), F.lit(""))
    kind = lambda **by: F.coalesce(*[F.when(c("type") == n.replace("_", "-"), e) for n, e in by.items()], F.lit(""))
    made = (get("created") == "2024-05-01T00:00:00.000Z") & (get("created") == get("modified"))
    number = inner("external_references", "$[0].external_id")
    return nodes.select(
        "actor", "type", "id", "name", get("description").alias("description"),
        kind(intrusion_set=number, attack_pattern=number, indicator=get("pattern")).alias("ref"),
        kind(
            intrusion_set=get("first_seen"), attack_pattern=inner("kill_chain_phases", "$[0].phase_name"), malware=get("is_family"),
            indicator=get("valid_from"), campaign=get("first_seen"),
        ).alias("extra"),
        kind(
            intrusion_set=listed("aliases"), attack_pattern=get("x_mitre_detection"), malware=listed("aliases"),
            indicator=F.concat(get("confidence"), F.lit("|"), get("x_malware_family")), campaign=get("last_seen"),
        ).alias("more"),
        (made & ((get("created_by_ref") != "") | (c("type") == "identity"))).alias("made"),
    )


@query(
    "stix_edges",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {PARSED_FEED}, {_FI}
    SELECT actor, 'uses' AS relationship_type, {_SID('intrusion-set', 'actor')} AS source_ref, {_SID('attack-pattern', 'actor', 'technique_id')} AS target_ref FROM merged_t
    UNION ALL SELECT actor, 'uses', {_SID('intrusion-set', 'actor')}, {_SID('malware', 'actor', 'name_key')} FROM merged_m
    UNION ALL SELECT actor, 'indicates', {_SID('indicator', 'actor', _PAT)}, {_SID('intrusion-set', 'actor')} FROM fi
    UNION ALL SELECT actor, 'attributed-to', {_SID('campaign', 'actor', 'name')}, {_SID('intrusion-set', 'actor')} FROM merged_c""",
    uses=STIX_USES,
)
def _(t):
    return _stix(t)[1].select("actor", "relationship_type", "source_ref", "target_ref")


@query(
    "report_refs",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {PARSED_FEED}, {_FI},
    n AS (SELECT actor, 2 * count(*) AS n FROM merged_t GROUP BY actor UNION ALL SELECT actor, 2 * count(*) FROM merged_m GROUP BY actor
          UNION ALL SELECT actor, 2 * count(*) FROM merged_c GROUP BY actor UNION ALL SELECT actor, 2 * count(*) FROM fi GROUP BY actor UNION ALL SELECT DISTINCT actor, 2 FROM records)
    SELECT actor, CAST(sum(n) AS BIGINT) AS refs FROM n GROUP BY actor""",
    uses=STIX_USES,
)
def _(t):
    # the indicators of a group are of distinct patterns, and so are their ids
    return stix.report_refs(*_stix(t), unique=stix.UNIQUE).groupBy("actor").agg(F.count("*").alias("refs"))


@query(
    "stix_bundle",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {PARSED_FEED}, {_FI},
    a AS (SELECT DISTINCT actor FROM records),
    n AS (SELECT actor, 'attack-pattern' AS type FROM merged_t UNION ALL SELECT actor, 'malware' FROM merged_m UNION ALL SELECT actor, 'campaign' FROM merged_c UNION ALL SELECT actor, 'indicator' FROM fi),
    o AS (SELECT * FROM n UNION ALL SELECT actor, 'relationship' FROM n UNION ALL SELECT actor, unnest(['bundle', 'identity', 'intrusion-set', 'report']) FROM a)
    SELECT regexp_replace(lower(actor), '[^a-z0-9]', '_', 'g') AS actor_slug, type, count(*) AS objects, count(*) FILTER (WHERE type NOT IN ('bundle', 'identity')) AS owned FROM o GROUP BY 1, 2""",
    uses=STIX_USES,
)
def _(t):
    run, actors, nodes, edges = _graph(t)
    lines = stix.stix_objects(nodes, edges, stix.report_nodes(actors, k.NOW))
    path = scratch_path(t.spark, "stix")
    stix.write_objects(lines.withColumn("actor_slug", labels.file_slug(c("actor"))), path, sizes=_folder_sizes(run, 2))
    files = t.spark.read.schema("body string, actor_slug string").json(path)
    found = files.select("actor_slug", _object_fields(c("body"), "type", "created_by_ref").alias("o"))
    return found.groupBy("actor_slug", c("o.type").alias("type")).agg(
        F.count("*").alias("objects"), F.count("o.created_by_ref").alias("owned")
    )


_RELATION = lambda kind, src, dst, said: f"""'{{"type":"relationship","spec_version":"2.1","id":"' || {_SID('relationship', f"'{kind}'", src, dst)}
      || '","created":"2024-05-01T00:00:00.000Z","modified":"2024-05-01T00:00:00.000Z","created_by_ref":"' || {_SID('identity', "'intelweave'")} || '","relationship_type":"{kind}","source_ref":"'
      || {src} || '","target_ref":"' || {dst} || '","description":' || to_json({said}) || '}}'"""


@query(
    "stix_family_links",
    f""", {k.MERGED_TECHNIQUES}, {PARSED_FEED}, {_FI},
    fm AS (SELECT actor, lower(trim(name)) AS mk, {_SID('malware', 'actor', 'lower(trim(name))')} AS mid FROM (SELECT DISTINCT actor, lower(trim(name)) AS name FROM family_malware) x),
    ind AS (SELECT *, {_SID('indicator', 'actor', _PAT)} AS iid, {_SID('intrusion-set', 'actor')} AS aid, {_PAT} AS pat FROM fi),
    tech AS (SELECT actor, technique_id, {_SID('intrusion-set', 'actor')} AS aid, {_SID('attack-pattern', 'actor', 'technique_id')} AS tid FROM merged_t),
    mal AS (SELECT *, {_SID('intrusion-set', 'actor')} AS aid FROM fm),
    lines AS (
      SELECT actor, 'uses' AS kind, {_RELATION('uses', 'aid', 'tid', "actor || ' uses ' || technique_id")} AS line FROM tech
      UNION ALL SELECT actor, 'uses', {_RELATION('uses', 'aid', 'mid', "actor || ' uses ' || mk")} FROM mal
      UNION ALL SELECT actor, 'indicates actor', {_RELATION('indicates', 'iid', 'aid', "'Associated with ' || actor")} FROM ind
      UNION ALL SELECT i.actor, 'indicates malware', {_RELATION('indicates', 'iid', 'mid', "'Associated with ' || family")} FROM ind i JOIN fm ON i.actor = fm.actor AND lower(family) = mk
      UNION ALL SELECT actor, 'indicator', '{{"type":"indicator","spec_version":"2.1","id":"' || iid || '","created":"2024-05-01T00:00:00.000Z","modified":"2024-05-01T00:00:00.000Z","created_by_ref":"' || {_SID('identity', "'intelweave'")}
        || '","name":' || to_json(type || ': ' || value) || ',"description":' || to_json(description) || ',"pattern":' || to_json(pat) || ',"pattern_type":"stix","valid_from":"' || first_seen || 'T00:00:00.000Z","indicator_types":'
        || CASE threat_label WHEN 'Botnet C2' THEN '["malicious-activity","compromised"]' ELSE '["malicious-activity"]' END || CASE WHEN confidence_score > 0 THEN ',"confidence":' || least(confidence_score, 100) ELSE '' END
        || ',"x_sources":["family_feed","","x"],"x_malware_family":' || to_json(family) || '}}' FROM ind)
    SELECT regexp_replace(lower(actor), '[^a-z0-9]', '_', 'g') AS actor_slug, kind, md5(line) AS line FROM lines
    UNION ALL SELECT '', 'refers to nothing', '0'""",
    uses=["techniques", "family_malware", *FEED_USES],
)
def _(t):
    """Whole lines of the written graph; indicators lead to the malware of their family, and every reference is there."""
    mal = lambda: m.merge_malware(t.write_once(placed=["o_orderkey"], intel=()).family_malware)
    run, actors, nodes, edges = _graph(t, mal, lambda: k.merged_campaigns(t).limit(0))
    lines = stix.stix_objects(nodes, edges, stix.report_nodes(actors, k.NOW))
    path = scratch_path(t.spark, "stix-links")
    stix.write_objects(lines.withColumn("actor_slug", labels.file_slug(c("actor"))), path, sizes=_folder_sizes(run, 3))
    files = t.spark.read.schema("body string, actor_slug string").json(path)
    fields = _object_fields(c("body"), "id", "type", "relationship_type", "source_ref", "target_ref")
    found = files.select("actor_slug", "body", fields.alias("o"))
    towards = F.concat(F.lit("indicates "), F.when(F.startswith("o.target_ref", F.lit("malware--")), "malware").otherwise("actor"))
    kind = F.when(c("o.type") == "indicator", "indicator").when(c("o.relationship_type") == "indicates", towards).otherwise(c("o.relationship_type"))
    shown = found.withColumn("kind", kind).filter("kind is not null").select("actor_slug", "kind", F.md5("body").alias("line"))
    return shown.unionByName(_lost(found).select(F.lit("").alias("actor_slug"), F.lit("refers to nothing").alias("kind"), "line"))


def _lost(found):
    """How many references of the objects lead to none of them, as a text.

    One row per id comes out of a task however many objects refer to it, and ids are shuffled as kind and 16 bytes.
    """
    end = lambda n, here: F.struct(c(f"o.{n}").alias("id"), F.lit(here).alias("here"))
    ids = found.select(F.explode(F.array(end("id", True), end("source_ref", False), end("target_ref", False))).alias("e")).filter("e.id is not null")
    ids = ids.groupBy(labels.id_kind(c("e.id")).alias("kind"), labels.id_bytes(c("e.id")).alias("number"))
    met = ids.agg(F.count_if(~c("e.here")).alias("refs"), F.max("e.here").alias("here")).filter("not here")
    return met.agg(F.coalesce(F.sum("refs"), F.lit(0)).cast("string").alias("line"))


_LEAD = "lead AS (SELECT actor, technique_id, max(technique_rules) AS n, first(title ORDER BY rule_rank) AS title FROM hit GROUP BY actor, technique_id)"


@query(
    "matrix_layer",
    f""", {k.MERGED_TECHNIQUES}, {RULES_SQL}, {_LEAD}
    SELECT actor, technique_id, coalesce(replace(lower(tactic), ' ', '-'), '') AS tactic, CASE confidence WHEN 'HIGH' THEN '#ff6666' WHEN 'MEDIUM' THEN '#ffaa00' ELSE '#ffe680' END AS color,
       CASE confidence WHEN 'HIGH' THEN 100 WHEN 'MEDIUM' THEN 60 ELSE 30 END AS score,
       'Confidence: ' || confidence || CASE WHEN n IS NOT NULL THEN ' | Sigma: ' || n || CASE WHEN n = 1 THEN ' rule — ' ELSE ' rules — ' END || title WHEN detection IS NOT NULL THEN ' | Detection: ' || detection[1:120] ELSE '' END AS comment,
       true AS enabled, CASE WHEN n IS NOT NULL AND NOT contains(technique_id, '.') THEN true END AS show_subtechniques
    FROM merged_t LEFT JOIN lead USING (actor, technique_id)""",
    uses=["techniques", "rules"],
)
def _(t):
    return profile_run(t).layer()


@query(
    "layer_entries",
    f""", {k.MERGED_TECHNIQUES}, {RULES_SQL}, {_LEAD}
    SELECT actor, technique_id, coalesce(replace(lower(tactic), ' ', '-'), 'none') AS tactic, CASE WHEN n IS NOT NULL AND NOT contains(technique_id, '.') THEN 'true' ELSE '' END AS subs
    FROM merged_t LEFT JOIN lead USING (actor, technique_id)""",
    uses=["techniques", "rules"],
)
def _(t):
    entries = layers.layer_entries(profile_run(t).layer())
    get = lambda p: F.get_json_object("entry", p)
    return entries.select(
        "actor", get("$.techniqueID").alias("technique_id"), F.coalesce(get("$.tactic"), F.lit("none")).alias("tactic"),
        F.coalesce(get("$.showSubtechniques"), F.lit("")).alias("subs"),
    )


_DISTINCT = lambda table, field: f"""(SELECT actor, first(v ORDER BY source_rank, pos, i) AS v, min(row(source_rank, pos, i)) AS o FROM (
    SELECT actor, source_rank, pos, unnest({field}) AS v, generate_subscripts({field}, 1) - 1 AS i FROM {table}) x WHERE trim(v) <> '' GROUP BY actor, lower(trim(v)))"""
_COND = k.squash_sql("condition")


def _key_sql(*parts: str) -> str:
    """The sort text of whole numbers that are not negative."""
    return " || chr(1) || ".join(f"printf('8%015X', ({x})::BIGINT)" for x in parts)


def _at(row: str, *path: str) -> list[str]:
    return [f"{row}{''.join(f'[{i}]' for i in step.split('.'))}" for step in path]


_LINE = lambda row: _key_sql(*_at(row, "1", "2.1", "2.2", "2.3", "2.4"))  # (source_rank, (order, line, part, supplier))
_PLACED = lambda row: _key_sql(*_at(row, "1", "2"))  # (source_rank, number)
_ITEM = lambda row: _key_sql(*_at(row, "1", "2", "3"))  # (source_rank, number, place in the list)
_FOUND = f"{_LINE('family_pos')} || chr(1) || {_key_sql(*_at('pos', '1', '2', '3', '4'))}"
_RULE_TEXTS = f"""
    rl AS (SELECT path, status, CASE WHEN category <> '' AND product <> '' THEN category || ' / ' || product WHEN category <> '' THEN category WHEN product <> '' THEN product ELSE 'unknown' END AS logsource,
             CASE WHEN length({_COND}) > 80 THEN ({_COND})[1:77] || '...' ELSE {_COND} END AS cond FROM rules)"""
_ADVISORIES = """
    ad AS (SELECT actor, first(date ORDER BY source_rank, pos) AS date, first(title ORDER BY source_rank, pos) AS title, first(url ORDER BY source_rank, pos) AS url,
           first(summary ORDER BY source_rank, pos) AS summary, min(row(source_rank, pos)) AS o FROM advisories GROUP BY actor, coalesce(nullif(url, ''), title))"""
_CVES = """
    cv AS (SELECT actor, cve_id, first(product ORDER BY source_rank, pos) AS product, first(vendor ORDER BY source_rank, pos) AS vendor, first(date_added ORDER BY source_rank, pos) AS added, min(row(source_rank, pos)) AS o FROM cves WHERE cve_id <> '' GROUP BY actor, cve_id)"""
_HEAD = "first({0} ORDER BY source_rank, pos) FILTER (WHERE {0} <> '') AS {0}"


@query(
    "report_rows",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_CAMPAIGNS}, {k.MERGED_MALWARE}, {RULES_SQL}, {PARSED_FEED}, {_FI}, {_REPO}, {_RULE_TEXTS}, {_ADVISORIES}, {_CVES},
    hd AS (SELECT actor, {_HEAD.format('origin')}, {_HEAD.format('first_seen')}, {_HEAD.format('mitre_group_id')}, {_HEAD.format('description')} FROM records GROUP BY actor),
    det AS (SELECT actor, technique_id, technique_id || chr(1) || lpad(rule_rank::VARCHAR, 3, '0') AS key, title, upper(level) AS level, logsource, cond FROM hit JOIN rl USING (path)
      UNION ALL SELECT actor, technique_id, technique_id, detection, '', '', '' FROM merged_t WHERE detection IS NOT NULL AND (actor, technique_id) NOT IN (SELECT (actor, technique_id) FROM hit)),
    fam AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY hits DESC, family_pos) AS r FROM hits QUALIFY r <= 8),
    rep AS (SELECT s.actor, s.name, r.platform, r.tier, r.url, row_number() OVER (PARTITION BY s.actor ORDER BY s.score DESC, s.pos) AS r FROM scored s JOIN repos r USING (pos) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY s.actor ORDER BY s.score DESC, s.pos) <= 6)
    SELECT actor, 'overview' AS section, '0' AS key, 'Group ID' AS c1, mitre_group_id AS c2, '' AS c3, '' AS c4, '' AS c5 FROM hd WHERE mitre_group_id IS NOT NULL
    UNION ALL SELECT actor, 'overview', '1', 'Origin', coalesce(origin, 'Unknown'), '', '', '' FROM hd
    UNION ALL SELECT actor, 'overview', '2', 'First Seen', coalesce(first_seen, 'Unknown'), '', '', '' FROM hd
    UNION ALL SELECT actor, 'overview', '3' || {_ITEM('o')}, 'Motivations', v, '', '', '' FROM {_DISTINCT('records', 'motivations')} x
    UNION ALL SELECT actor, 'overview', '4' || {_ITEM('o')}, 'Also Known As', v, '', '', '' FROM {_DISTINCT('records', 'aliases')} x
    UNION ALL SELECT actor, 'overview', '5', 'Description', description, '', '', '' FROM hd WHERE description IS NOT NULL
    UNION ALL SELECT DISTINCT actor, 'overview', '6' || source_id, 'Sources', source_id, '', '', '' FROM records WHERE source_id <> ''
    UNION ALL SELECT actor, 'overview', '7family feed', 'Indicators', 'family feed', count(*)::VARCHAR, '', '' FROM fi GROUP BY actor
    UNION ALL SELECT actor, 'techniques', technique_id, technique_id, coalesce(tactic, ''), coalesce(name, ''), confidence, '' FROM merged_t
    UNION ALL SELECT actor, 'detection', key, technique_id, title, level, logsource, cond FROM det
    UNION ALL SELECT actor, 'indicators', type || chr(1) || {_FOUND} || chr(1) || value, {k.defang_sql('type', 'value')}, CASE WHEN confidence_score = 100 THEN 'HIGH' WHEN confidence_score >= 75 THEN 'MED' WHEN confidence_score <> 0 THEN 'LOW' ELSE '' END, threat_label, family, first_seen FROM fi
    UNION ALL SELECT actor, 'families', lpad(r::VARCHAR, 3, '0'), family, hits::VARCHAR, '', '', '' FROM fam
    UNION ALL SELECT actor, 'repositories', lpad(r::VARCHAR, 3, '0'), name, upper(platform[1]) || platform[2:], CASE WHEN tier = 1 THEN 'Official' ELSE 'Community' END, url, '' FROM rep
    UNION ALL SELECT actor, 'sectors', {_ITEM('o')}, v, '', '', '', '' FROM {_DISTINCT('records', 'sectors')} x
    UNION ALL SELECT actor, 'cves', {_PLACED('o')}, cve_id, product, vendor, added, '' FROM cv
    UNION ALL SELECT actor, 'advisories', {_PLACED('o')}, date, title, url, '', '' FROM ad
    UNION ALL SELECT actor, 'malware', {_LINE('first_at')}, name, coalesce(type, ''), coalesce(trim(regexp_replace(description, '\\s+', ' ', 'g')), ''), '', '' FROM merged_m
    UNION ALL SELECT 'NATION_' || (pos % 25), 'articles', lpad((1000 - pos * 7 % 100)::VARCHAR, 4, '0') || chr(1) || {_key_sql('pos')}, source, date, CASE WHEN pos * 7 % 100 >= 70 THEN 'HIGH' WHEN pos * 7 % 100 >= 40 THEN 'MEDIUM' ELSE 'LOW' END, title, url FROM articles
    UNION ALL SELECT actor, 'campaigns', {_PLACED('first_at')}, name, CASE WHEN first_seen IS NULL AND last_seen IS NULL THEN '' ELSE coalesce(first_seen, '?') || ' – ' || coalesce(last_seen, '?') END, coalesce(description, ''), coalesce(url, ''), '' FROM merged_c""",
    uses=["techniques", "campaigns", "malware", "rules", *FEED_USES, "records", "cves", "advisories", "articles", "repos"],
)
def _(t):
    return profile_run(t).report().select("actor", "section", "key", "c1", "c2", "c3", "c4", "c5")


@query(
    "report_lists",
    """SELECT actor, 'sectors' AS section, c1, '' AS c2 FROM (SELECT actor, first(v ORDER BY source_rank, pos, i) AS c1 FROM (SELECT actor, source_rank, pos, unnest(sectors) AS v, generate_subscripts(sectors, 1) AS i FROM records) x GROUP BY actor, lower(trim(v))) s
       UNION ALL SELECT actor, 'advisories', first(date ORDER BY source_rank, pos), first(title ORDER BY source_rank, pos) FROM advisories GROUP BY actor, coalesce(nullif(url, ''), title)
       UNION ALL SELECT 'NATION_' || (pos % 25), 'articles', source, date FROM articles""",
    uses=["records", "advisories", "articles"],
)
def _(t):
    from .mapping import actor_articles, sectors_long

    rows = reports.report_rows(
        {"sectors": sectors_long(t), "advisories": m.merge_advisories(t.advisories), "articles": actor_articles(t)}
    )
    return rows.select("actor", "section", "c1", "c2")


@query(
    "report_repositories",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {_REPO}
    SELECT s.actor, s.name AS c1, upper(r.platform[1]) || r.platform[2:] AS c2, CASE WHEN r.tier = 1 THEN 'Official' ELSE 'Community' END AS c3
    FROM scored s JOIN repos r USING (pos) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY s.actor ORDER BY s.score DESC, s.pos) <= 6""",
    uses=["records", "techniques", "malware", "repos"],
)
def _(t):
    return reports.repo_rows(matched_repos(t)).select("actor", "c1", "c2", "c3")


_AGE_RANK = "CASE type WHEN 'domain' THEN 0 WHEN 'ip' THEN 1 WHEN 'url' THEN 2 WHEN 'email' THEN 9 ELSE 3 END"


@query(
    "playbook_rows",
    f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {RULES_SQL}, {_LEAD},
    bl AS (SELECT actor, CASE WHEN date '2024-05-01' - d <= 30 THEN 'FRESH' ELSE 'AGING' END AS bucket, type, value, coalesce(nullif(last_seen, ''), nullif(first_seen, ''), '') AS seen FROM (
        SELECT 'NATION_' || (doc % 25) AS actor, type, value, first_seen, last_seen, CAST(nullif(coalesce(nullif(last_seen, ''), first_seen), '') AS DATE) AS d FROM indicators) i WHERE date '2024-05-01' - d <= 90)
    SELECT actor, 'confidence' AS section, (count(*) FILTER (WHERE confidence = 'HIGH'))::VARCHAR AS c1, (count(*) FILTER (WHERE confidence = 'MEDIUM'))::VARCHAR AS c2, (count(*) FILTER (WHERE confidence = 'LOW'))::VARCHAR AS c3, '' AS c4, '' AS c5 FROM merged_t GROUP BY actor
    UNION ALL SELECT actor, 'checklist', coalesce(nullif(m.tactic, ''), 'Unknown'), technique_id, coalesce(m.name, ''), confidence, coalesce(l.title || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ' more)' ELSE '' END, detection, '') FROM merged_t m LEFT JOIN lead l USING (actor, technique_id)
    UNION ALL SELECT actor, 'malware', name, coalesce(type, ''), coalesce(trim(regexp_replace(description, '\\s+', ' ', 'g')), ''), '', '' FROM merged_m
    UNION ALL SELECT actor, 'references', coalesce(nullif(source_citation, ''), source_id), coalesce(source_url, ''), '', '', '' FROM records WHERE source_id <> ''
    UNION ALL SELECT actor, 'references', name, url, '', '', '' FROM merged_c WHERE url IS NOT NULL
    UNION ALL SELECT actor, 'block', bucket, type, {k.defang_sql('type', 'value')}, '', '' FROM (SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY actor, bucket ORDER BY {_AGE_RANK}, value) <= 50) b""",
    uses=["techniques", "malware", "campaigns", "rules", "records", "indicators"],
)
def _(t):
    rows = t.indicators.withColumn("actor", F.concat(F.lit("NATION_"), (c("pos.doc") % 25).cast("string")))
    out = reports.playbook_rows(
        k.merged_techniques(t), rul.lead_rules(matched_rules(t)), rows, k.merged_malware(t), m.source_ledger(t.records),
        k.merged_campaigns(t), k.NOW,
    )
    # equal values of several texts tie for a block's last place, so when it was seen is not compared
    last = F.when(c("section") == "block", F.lit("")).otherwise(c("c5"))
    return out.select("actor", "section", "c1", "c2", "c3", "c4", last.alias("c5"))


@query(
    "freshness_rows",
    f""", {k.MERGED_INDICATORS}
    SELECT actor, bucket, row_no, type, {k.defang_sql('type', 'value')} AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY actor, bucket ORDER BY CASE type WHEN 'domain' THEN 0 WHEN 'ip' THEN 1 WHEN 'url' THEN 2 ELSE 9 END, value) AS row_no FROM (
        SELECT actor, type, value, CASE WHEN date '2024-05-01' - d <= 30 THEN 'FRESH' WHEN date '2024-05-01' - d <= 90 THEN 'AGING' ELSE 'STALE' END AS bucket FROM (
          SELECT *, CAST(nullif(coalesce(nullif(last_seen, ''), first_seen), '') AS DATE) AS d FROM merged_i) x) y) z WHERE row_no <= 100""",
    uses=["indicators"],
)
def _(t):
    return reports.freshness_rows(k.merged_indicators(t), k.NOW).drop("seen")


@query(
    "coverage_report",
    f""", {COVERED_SQL}, p AS (SELECT actor, CAST(round_even(100.0 * count(*) FILTER (WHERE covered) / count(*), 0) AS INT) AS pct, count(*) AS total FROM flagged GROUP BY actor)
    SELECT actor, CASE WHEN covered THEN 'covered' ELSE 'gap' END AS status, CASE WHEN covered THEN 9 ELSE CASE confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END END AS gap_rank, technique_id, name, tactic, confidence, pct, total FROM flagged JOIN p USING (actor)""",
    uses=["techniques", "rules"],
)
def _(t):
    return reports.coverage_report(flagged(t))


# every field of a profile, as the JSON of its items; advisories belong to actors of their own, who have no header
_SOURCES = lambda name, table, key, where: f"""
    {name} AS (SELECT actor, k, list(source_id ORDER BY source_rank) AS sources FROM (SELECT DISTINCT actor, {key} AS k, source_id, source_rank FROM {table} WHERE {where}) d GROUP BY actor, k)"""
_JSON = lambda *fields: "to_json({" + ", ".join(f"'{f.split(' AS ')[-1]}': {f.split(' AS ')[0]}" for f in fields) + "})"
_ITEMS = f""", {k.MERGED_TECHNIQUES}, {k.MERGED_MALWARE}, {k.MERGED_CAMPAIGNS}, {RULES_SQL}, {PARSED_FEED}, {_FI}, {_RULE_TEXTS}, {_ADVISORIES}, {_CVES},
    {_SOURCES('ms', 'malware', 'lower(trim(name))', "trim(name) <> ''")}, {_SOURCES('cs', 'campaigns', 'trim(name)', "trim(name) <> ''")},
    reference AS (SELECT actor, trim(name) AS name, {_HEAD.format('reference')} FROM campaigns GROUP BY actor, trim(name)),
    hd AS (SELECT actor, {", ".join(_HEAD.format(x) for x in ('actor_name', 'mitre_group_id', 'origin', 'first_seen', 'description'))} FROM records GROUP BY actor),
    totals AS (SELECT * FROM hd LEFT JOIN (SELECT actor, CAST(sum(technique_rules) AS BIGINT) AS rules FROM hit WHERE rule_rank = 1 GROUP BY actor) r USING (actor)
      LEFT JOIN (SELECT actor, count(*) AS iocs FROM fi GROUP BY actor) i USING (actor) LEFT JOIN (SELECT 'NATION_' || (pos % 25) AS actor, count(*) AS arts FROM articles GROUP BY 1) a USING (actor)),
    items AS (
      SELECT actor, 0 AS section_no, 'header' AS section, '' AS item_key, {_JSON('actor', 'actor_name', 'mitre_group_id', 'origin', 'first_seen', 'description', 'origin AS suspected_origin',
        'coalesce(rules, 0) AS rule_count', 'coalesce(iocs, 0) AS family_ioc_count', 'coalesce(arts, 0) AS article_count')} AS item FROM totals
      UNION ALL SELECT actor, 1, 'aliases', {_ITEM('o')}, {_JSON('v AS value')} FROM {_DISTINCT('records', 'aliases')} x
      UNION ALL SELECT actor, 2, 'motivations', {_ITEM('o')}, {_JSON('v AS value')} FROM {_DISTINCT('records', 'motivations')} x
      UNION ALL SELECT actor, 3, 'sectors', {_ITEM('o')}, {_JSON('v AS value')} FROM {_DISTINCT('records', 'sectors')} x
      UNION ALL SELECT actor, 4, 'techniques', {_LINE('first_at')}, {_JSON('technique_id', 'name', 'tactic', 'description', 'detection', 'sources', 'confidence')} FROM merged_t
      UNION ALL SELECT m.actor, 5, 'malware', {_LINE('first_at')}, {_JSON('name', 'type', 'description', 'aliases', 'yara_count', 'sources')} FROM merged_m m JOIN ms ON m.actor = ms.actor AND m.name_key = ms.k
      UNION ALL SELECT actor, 6, 'indicators', {_FOUND} || chr(1) || type || chr(1) || value,
        {_JSON('type', 'value', 'confidence_score', 'threat_type', 'threat_label', 'family AS malware_family', 'first_seen', 'last_seen', 'description', "['family_feed'] AS sources")} FROM fi
      UNION ALL SELECT actor, 7, 'cves', {_PLACED('o')}, {_JSON('cve_id', 'product', 'vendor', 'added AS date_added')} FROM cv
      UNION ALL SELECT actor, 8, 'advisories', {_PLACED('o')}, {_JSON('title', 'url', 'date', 'summary')} FROM ad
      UNION ALL SELECT m.actor, 9, 'campaigns', {_PLACED('first_at')}, {_JSON('m.name AS name', 'description', 'url', 'reference', 'first_seen', 'last_seen', 'sources')}
        FROM merged_c m JOIN cs ON m.actor = cs.actor AND m.name = cs.k JOIN reference f ON m.actor = f.actor AND m.name = f.name
      UNION ALL SELECT actor, 10, 'rules', technique_id || chr(1) || {_key_sql('rule_rank')}, {_JSON('technique_id', 'title', 'level', 'status', 'logsource', 'cond AS condition_summary', 'path', 'path AS url', 'technique_rules')} FROM hit JOIN rl USING (path)
      UNION ALL SELECT 'NATION_' || (pos % 25), 11, 'articles', {_key_sql('pos')}, {_JSON('title', 'source', 'date', 'url', 'pos * 7 % 100 AS relevance')} FROM articles
      UNION ALL SELECT actor, 12, 'families', {_LINE('family_pos')} || chr(1) || family, {_JSON('family', 'hits')} FROM hits
      UNION ALL SELECT DISTINCT actor, 13, 'sources_cited', source_id, {_JSON('source_id AS value')} FROM records WHERE source_id <> ''
      UNION ALL SELECT actor, 14, 'sources', {_key_sql('source_rank', 'pos')}, {_JSON('source_id', "coalesce(source_citation, '') AS source_citation", "coalesce(source_url, '') AS source_url", "coalesce(retrieved_at, '') AS retrieved_at")} FROM records WHERE source_id <> '')"""
_ITEM_USES = ["techniques", "malware", "campaigns", "rules", *FEED_USES, "records", "cves", "advisories", "articles"]


@query("assemble_profile", f"{_ITEMS} SELECT actor, section_no, item_key, md5(item::VARCHAR) AS item FROM items", uses=_ITEM_USES)
def _(t):
    return profile_run(t).profile().select("actor", "section_no", "item_key", F.md5("item").alias("item"))


@query(
    "profiles_json",
    f"""{_ITEMS} SELECT regexp_replace(lower(actor), '[^a-z0-9]', '_', 'g') AS actor_slug, section,
      md5('{{"section":"' || section || '","item":' || item::VARCHAR || '}}') AS line, count(*) AS lines FROM items GROUP BY ALL""",
    uses=_ITEM_USES,
)
def _(t):
    from .mapping import actor_articles

    run = profile_run(t)
    # folders are written some at a time, so what a section is made of is written first, but no texts of articles
    run.landed["articles"] = lambda: actor_articles(t).drop("summary")
    run.keep("campaigns", "cves", "advisories", "articles")
    lines = run.profile().withColumn("actor_slug", labels.file_slug(c("actor")))
    # all that starts from these is written by now
    t.release("intel", "placed")
    run.base.drop("parsed_feed", "parsed_rules")
    path = scratch_path(t.spark, "profiles")
    profiles.write_profiles_json(lines, path, sizes=_folder_sizes(run))
    back = t.spark.read.schema("value string, actor_slug string").text(path)
    section = F.regexp_extract("value", r'^\{"section":"([a-z_]*)"', 1)
    # the 16 bytes of a digest are shuffled, not their 32 digits
    lines = back.groupBy("actor_slug", section.alias("section"), F.unhex(F.md5("value")).alias("line")).agg(F.count("*").alias("lines"))
    return lines.withColumn("line", F.lower(F.hex("line")))
