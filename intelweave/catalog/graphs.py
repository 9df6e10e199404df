"""Object-graph lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources.documents import parse_graph
from .registry import query

c = F.col
_none = lambda kind: F.lit(None).cast(kind)


def group_objects(t):
    """Customers as intrusion sets, with nested references."""
    from .scalars import group_refs

    return t.groups.withColumn("external_references", group_refs())


def arsenal_objects(t):
    """Parts as techniques and software."""
    ref = lambda s, i: F.struct(F.lit(s).alias("source_name"), i.alias("external_id"), F.lit("https://e.org/").alias("url"))
    phase = lambda n: F.struct(F.lit("mitre-attack").alias("kill_chain_name"), n.alias("phase_name"))
    return t.arsenal.withColumns(
        {
            "external_references": F.array(ref("capec", F.lit("CAPEC-1")), ref("mitre-attack", c("tid"))),
            "kill_chain_phases": F.array(phase(c("phase")), phase(F.lit("impact"))),
            "labels": F.when(c("label").isNotNull(), F.array(c("label"), F.lit("more"))),
        }
    ).drop("tid", "phase", "label")


def campaign_objects(t):
    ref = F.struct(c("ref_source").alias("source_name"), _none("string").alias("external_id"), c("ref_url").alias("url"))
    return t.campaign_objects.withColumn("external_references", F.array(ref)).drop("ref_source", "ref_url")


@query(
    "graph_objects",
    """SELECT id, name, bundle FROM (
         SELECT id, name, 'a' AS bundle, pos FROM groups
         UNION ALL SELECT 'intrusion-set--' || (pos % 700), name || ' again', 'b', pos FROM groups WHERE pos % 2 = 0) x
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY bundle DESC, pos DESC) = 1""",
    uses=["groups"],
)
def _(t):
    base = group_objects(t).withColumns(
        {"bundle": F.lit("a"), "relationship_type": _none("string"), "source_ref": _none("string"), "target_ref": _none("string")}
    )
    again = base.filter("pos % 2 = 0").withColumns(
        {
            "bundle": F.lit("b"),
            "id": F.concat(F.lit("intrusion-set--"), (c("pos") % 700).cast("string")),
            "name": F.concat("name", F.lit(" again")),
        }
    )
    objects, _edges = parse_graph(base.unionByName(again))
    return objects.select("id", "name", "bundle")


@query(
    "graph_edges",
    """SELECT relationship_type, source_ref, target_ref FROM uses_edges
       QUALIFY row_number() OVER (PARTITION BY source_ref, target_ref ORDER BY pos DESC) = 1""",
    uses=["uses_edges"],
)
def _(t):
    rows = t.uses_edges.select(
        F.concat_ws("--", F.lit("relationship"), "source_ref", "target_ref").alias("id"), F.lit("relationship").alias("type"),
        "relationship_type", "source_ref", "target_ref", "pos", F.lit("a").alias("bundle"),
    )
    _objects, edges = parse_graph(rows)
    return edges.select("relationship_type", "source_ref", "target_ref")


@query(
    "resolve_group",
    """SELECT n.pos, n.name, x.group_id FROM (SELECT c_custkey AS pos, CASE c_custkey % 4 WHEN 0 THEN 'GROUP ' || (c_custkey % 70) WHEN 1 THEN ' Alias ' || (c_custkey % 300) WHEN 2 THEN 'alt ' || c_custkey ELSE 'nobody' END AS name FROM customer) n
       JOIN (SELECT lower(a) AS called, first(id ORDER BY pos, id) AS group_id FROM (
         SELECT id, pos, unnest(list_concat([name], coalesce(aliases, []))) AS a FROM groups) y GROUP BY lower(a)) x ON lower(trim(n.name)) = x.called""",
    uses=["groups"],
)
def _(t):
    k4 = c("c_custkey") % 4
    txt = lambda e: e.cast("string")
    names = t.customer.select(
        c("c_custkey").alias("pos"),
        F.when(k4 == 0, F.concat(F.lit("GROUP "), txt(c("c_custkey") % 70)))
        .when(k4 == 1, F.concat(F.lit(" Alias "), txt(c("c_custkey") % 300)))
        .when(k4 == 2, F.concat(F.lit("alt "), txt(c("c_custkey")))).otherwise("nobody").alias("name"),
    )
    return g.resolve_group(names, group_objects(t)).select("pos", "name", "group_id")


def _group_ids(t):
    return t.groups.select(c("id").alias("group_id"))


_USES = """SELECT e.source_ref AS group_id, e.target_ref AS id, a.type, count(*) AS n FROM uses_edges e JOIN groups g ON e.source_ref = g.id JOIN arsenal a ON e.target_ref = a.id
  WHERE e.relationship_type = 'uses' AND a.type IN {types} AND NOT a.revoked GROUP BY ALL"""


@query("related_techniques", _USES.format(types="('attack-pattern', 'none')"), uses=["uses_edges", "groups", "arsenal"])
def _(t):
    out = g.related(_group_ids(t), arsenal_objects(t), t.uses_edges, "uses", ["attack-pattern"])
    return out.groupBy("group_id", "id", "type").agg(F.count("*").alias("n"))


@query("related_software", _USES.format(types="('malware', 'tool')"), uses=["uses_edges", "groups", "arsenal"])
def _(t):
    out = g.related(_group_ids(t), arsenal_objects(t), t.uses_edges, "uses", ["malware", "tool"])
    return out.groupBy("group_id", "id", "type").agg(F.count("*").alias("n"))


@query(
    "related_campaigns",
    """SELECT e.target_ref AS group_id, o.id, o.name FROM attributed_edges e JOIN groups g ON e.target_ref = g.id JOIN campaign_objects o ON e.source_ref = o.id
       WHERE o.type = 'campaign' AND NOT o.revoked""",
    uses=["attributed_edges", "groups", "campaign_objects"],
)
def _(t):
    out = g.related_reverse(_group_ids(t), campaign_objects(t), t.attributed_edges, "attributed-to", ["campaign"])
    return out.select("group_id", "id", "name")


@query(
    "group_supplement",
    """SELECT id, CASE WHEN gid = 'G0032' THEN '2009' WHEN gid = 'G0007' THEN '2004' WHEN gid = 'G0010' THEN '2004' WHEN gid = 'G0016' THEN '2008' WHEN gid = 'G0045' THEN '2009' WHEN gid = 'G0096' THEN '2012' WHEN gid = 'G0034' THEN '2009'
          WHEN gid = 'G0064' THEN '2013' WHEN gid = 'G0049' THEN '2014' WHEN gid = 'G0094' THEN '2012' WHEN gid = 'G0046' THEN '2013' WHEN gid = 'G1017' THEN '2021' ELSE CAST(1990 + pos % 30 AS VARCHAR) END AS first_seen,
          gid IN ('G0007','G0016','G0032','G0045','G0096','G0034','G0010','G0064','G0049','G0094','G0046','G1017') AS curated FROM groups""",
    uses=["groups"],
)
def _(t):
    ids = g.group_supplement(t.spark).select(c("mitre_id"), F.lit(True).alias("curated"))
    out = g.group_records(group_objects(t), g.group_supplement(t.spark), keep=("id",))
    return out.join(ids, "mitre_id", "left").select("id", "first_seen", F.coalesce("curated", F.lit(False)).alias("curated"))


@query(
    "not_revoked",
    "SELECT type, count(*) AS n FROM arsenal WHERE NOT revoked GROUP BY type",
    uses=["arsenal"],
)
def _(t):
    rows = arsenal_objects(t).withColumn("revoked", F.when(c("revoked"), F.lit(True)))
    return g.live(rows).groupBy("type").agg(F.count("*").alias("n"))


def graph_profile(t):
    """Techniques, software and campaigns of every group, from the graph."""
    groups = t.groups.select(c("id").alias("group_id"), c("name").alias("actor"))
    objects = arsenal_objects(t)
    techniques = g.technique_from_object(g.related(groups, objects, t.uses_edges, "uses", ["attack-pattern"]))
    software = g.software_from_object(g.related(groups, objects, t.uses_edges, "uses", ["malware", "tool"]))
    return techniques, software


@query(
    "graph_profile",
    """SELECT g.name AS actor, 'technique' AS kind, a.tid AS key, count(DISTINCT e.source_ref) AS groups FROM uses_edges e JOIN groups g ON e.source_ref = g.id JOIN arsenal a ON e.target_ref = a.id
         WHERE e.relationship_type = 'uses' AND a.type = 'attack-pattern' AND NOT a.revoked AND a.tid IS NOT NULL GROUP BY ALL
       UNION ALL SELECT g.name, 'software', a.name, count(DISTINCT e.source_ref) FROM uses_edges e JOIN groups g ON e.source_ref = g.id JOIN arsenal a ON e.target_ref = a.id
         WHERE e.relationship_type = 'uses' AND a.type IN ('malware', 'tool') AND NOT a.revoked AND a.name <> '' GROUP BY ALL""",
    uses=["uses_edges", "groups", "arsenal"],
)
def _(t):
    techniques, software = graph_profile(t)
    count = lambda df, kind, key: df.groupBy("actor", F.lit(kind).alias("kind"), c(key).alias("key")).agg(
        F.count_distinct("group_id").alias("groups")
    )
    return count(techniques, "technique", "technique_id").unionByName(count(software, "software", "name"))


