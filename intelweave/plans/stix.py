"""Node, edge and reference tables of the graph export.

Everything stays a long table, at any size: one row per object, one row per
relationship, and ``report_refs`` with one row for every object a report refers
to.  Files hold one object per line, so no actor's graph is gathered in one
place.  ``as_of`` is the time objects are created and modified at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ioc, labels, text
from ..operators import BY
from ..operators.ordering import keep_first

SPEC = "2.1"
PRODUCER = "intelweave"


def _stamp(as_of) -> Column:
    return dates.stix_timestamp(F.lit(None).cast("string"), as_of)


def _head(kind: str) -> Column:
    return F.lit(f'{{"type":"{kind}","spec_version":"{SPEC}","id":"')


def _tail(as_of, fields: dict[str, Column], name: Column | None = None) -> Column:
    """What follows the id in an object's JSON; fields that are NULL are left out."""
    rest = F.to_json(
        F.struct(
            _stamp(as_of).alias("created"), _stamp(as_of).alias("modified"), producer_id().alias("created_by_ref"),
            *([name.alias("name")] if name is not None else []), *[c.alias(n) for n, c in fields.items()],
        )
    )
    return F.concat(F.lit('",'), F.substr(rest, F.lit(2)))


def _object(df: DataFrame, kind: str, sid: Column, name: Column, tail: Column, by) -> DataFrame:
    """(group, type, id, name, body, head, tail): an object as JSON, and its parts before and after the id."""
    return df.select(
        *by, F.lit(kind).alias("type"), sid.alias("id"), name.alias("name"), F.concat(_head(kind), sid, tail).alias("body"),
        _head(kind).alias("head"), tail.alias("tail"),
    )


def _node(df: DataFrame, kind: str, key: list[Column], name: Column, fields: dict[str, Column], as_of, by) -> DataFrame:
    sid = labels.stable_id(kind, *[F.col(b) for b in by], *key)
    return _object(df, kind, sid, name, _tail(as_of, fields, name), by)


def _have(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _reference(number: Column, url: Column) -> Column:
    ref = F.struct(F.lit("mitre-attack").alias("source_name"), number.alias("external_id"), url.alias("url"))
    return F.when(F.coalesce(number, F.lit("")) != "", F.array(ref))


def producer_id() -> Column:
    return labels.stable_id("identity", F.lit(PRODUCER))


def producer_node(actors: DataFrame, as_of, *, by=BY) -> DataFrame:
    rest = F.to_json(
        F.struct(
            _stamp(as_of).alias("created"), _stamp(as_of).alias("modified"),
            F.lit(PRODUCER).alias("name"), F.lit("system").alias("identity_class"),
        )
    )
    return _object(actors, "identity", producer_id(), F.lit(PRODUCER), F.concat(F.lit('",'), F.substr(rest, F.lit(2))), by)


def actor_nodes(actors: DataFrame, as_of, *, by=BY) -> DataFrame:
    """intrusion-set nodes from (group, actor_name, aliases, description, motivations, first_seen, origin, mitre_group_id)."""
    c = F.col
    mots = F.transform(_strings(c("motivations")), labels.stix_motivation)
    gid = text.non_blank(c("mitre_group_id"))
    return _node(
        actors, "intrusion-set", [], c("actor_name"),
        {
            "description": F.coalesce(
                F.nullif("description", F.lit("")), F.concat(F.lit("Threat actor "), c("actor_name"), F.lit("."))
            ),
            "aliases": _strings(_have(actors, "aliases", "array<string>")),
            "primary_motivation": F.try_element_at(mots, F.lit(1)),
            "secondary_motivations": F.when(F.size(mots) > 1, F.slice(mots, F.lit(2), F.size(mots) - 1)),
            "first_seen": F.concat(dates.leading_year(c("first_seen")), F.lit("-01-01T00:00:00.000Z")),
            "x_origin": text.non_blank(c("origin")),
            "external_references": _reference(
                gid, F.concat(F.lit("https://attack.mitre.org/groups/"), gid, F.lit("/"))
            ),
        },
        as_of, by,
    )


def technique_nodes(techniques: DataFrame, as_of, *, by=BY, order=("first_at",)) -> DataFrame:
    c = F.col
    rows = techniques.withColumn("technique_id", F.upper(text.strip(c("technique_id"))))
    rows = keep_first(rows.filter("technique_id <> ''"), [*by, "technique_id"], list(order))
    phase = F.struct(F.lit("mitre-attack").alias("kill_chain_name"), labels.tactic_slug(c("tactic")).alias("phase_name"))
    return _node(
        rows, "attack-pattern", [c("technique_id")],
        F.coalesce(F.nullif("name", F.lit("")), c("technique_id")),
        {
            "description": F.coalesce("description", F.lit("")),
            "external_references": _reference(c("technique_id"), labels.technique_url(c("technique_id"))),
            "kill_chain_phases": F.when(F.coalesce("tactic", F.lit("")) != "", F.array(phase)),
            "x_mitre_detection": F.nullif("detection", F.lit("")),
        },
        as_of, by,
    )


def malware_nodes(malware: DataFrame, as_of, *, by=BY, order=("first_at",)) -> DataFrame:
    c = F.col
    rows = malware.withColumn("name", text.strip(c("name"))).filter("name <> ''")
    rows = keep_first(rows, [*by, F.lower("name")], list(order))
    aliases = _have(rows, "aliases", "array<string>")
    return _node(
        rows, "malware", [F.lower("name")], c("name"),
        {
            "description": F.coalesce("description", F.lit("")),
            "malware_types": F.array(labels.stix_malware_type(c("type"))),
            "is_family": F.lit(True),
            "aliases": F.when(
                F.size(_strings(aliases)) > 0, F.filter(aliases, lambda a: (a != "") & (a != c("name")))
            ),
        },
        as_of, by,
    )


def indicator_rows(indicators: DataFrame, *, by=BY, order=("first_at",)) -> DataFrame:
    """Indicators that have a pattern, one per distinct pattern; rows that come from here are left as they are."""
    if "pattern" in indicators.columns:
        return indicators
    rows = indicators.withColumn("value", text.strip(F.col("value"))).filter("value <> ''")
    rows = rows.withColumn("pattern", ioc.stix_pattern(F.col("type"), F.col("value"))).filter("pattern is not null")
    return keep_first(rows, [*by, "pattern"], list(order))


def _indicator_name() -> Column:
    return F.concat(F.col("type"), F.lit(": "), F.col("value"))


def _indicator_tail(patterned: DataFrame, as_of) -> Column:
    c = F.col
    have = lambda n: _have(patterned, n)
    label = text.non_blank(have("confidence"))
    score = F.when(label.isNotNull(), labels.confidence_number(label))
    if "confidence_score" in patterned.columns:
        score = F.coalesce(c("confidence_score"), score)
    name = _indicator_name()
    sources = _strings(_have(patterned, "sources", "array<string>"))
    fields = {
        "description": F.coalesce(F.nullif(have("description"), F.lit("")), name),
        "pattern": c("pattern"),
        "pattern_type": F.lit("stix"),
        "valid_from": dates.stix_timestamp(F.coalesce(have("first_seen"), F.lit("")), as_of),
        "indicator_types": F.split(ioc.stix_indicator_type(c("type"), have("threat_label")), ","),
        # an indicator nobody scored says nothing about confidence
        "confidence": F.when(score > 0, F.least(score, F.lit(100))),
        "x_sources": F.when(F.size(sources) > 0, sources),
        "x_malware_family": text.non_blank(have("malware_family")),
    }
    return _tail(as_of, fields, name)


def indicator_texts(indicators: DataFrame, as_of, *, by=BY, order=("first_at",)) -> DataFrame:
    """:func:`indicator_rows` with the text of their objects but the id, for rows that go to several groups."""
    rows = indicator_rows(indicators, by=by, order=order)
    families = ["malware_family"] if "malware_family" in rows.columns else []
    return rows.select(*by, "type", "value", "pattern", *families, _indicator_tail(rows, as_of).alias("tail"))


def indicator_nodes(patterned: DataFrame, as_of, *, by=BY) -> DataFrame:
    sid = labels.stable_id("indicator", *[F.col(b) for b in by], F.col("pattern"))
    tail = F.col("tail") if "tail" in patterned.columns else _indicator_tail(patterned, as_of)
    return _object(patterned, "indicator", sid, _indicator_name(), tail, by)


def campaign_nodes(campaigns: DataFrame, as_of, *, by=BY) -> DataFrame:
    c = F.col
    rows = campaigns.withColumn("name", text.strip(c("name"))).filter("name <> ''")
    when = lambda n: F.when(F.coalesce(c(n), F.lit("")) != "", dates.stix_timestamp(c(n), as_of))
    return _node(
        rows, "campaign", [c("name")], c("name"),
        {"description": F.coalesce("description", F.lit("")), "first_seen": when("first_seen"), "last_seen": when("last_seen")},
        as_of, by,
    )


def report_nodes(actors: DataFrame, as_of, *, by=BY) -> DataFrame:
    """One report per actor; what it refers to is in :func:`report_refs`."""
    c = F.col
    sources = _strings(_have(actors, "sources_cited", "array<string>"))
    return _node(
        actors, "report", [], F.concat(F.lit("Dossier: "), c("actor_name")),
        {
            "description": F.concat(
                F.lit("Threat actor report for "), c("actor_name"), F.lit(", from sources: "), F.array_join(sources, ", "), F.lit(".")
            ),
            "report_types": F.array(F.lit("threat-actor")),
            "published": _stamp(as_of),
            "labels": F.array(F.lit("threat-intelligence")),
            "x_sources": sources,
        },
        as_of, by,
    )


def _edge(df: DataFrame, relation: str, source: Column, target: Column, said: Column, as_of, by) -> DataFrame:
    """(group, relationship_type, source_ref, target_ref, id, body, head, mid, tail): the body's parts stand around its ids."""
    sid = labels.stable_id("relationship", F.lit(relation), source, target)
    made = F.to_json(
        F.struct(
            _stamp(as_of).alias("created"), _stamp(as_of).alias("modified"), producer_id().alias("created_by_ref"),
            F.lit(relation).alias("relationship_type"),
        )
    )
    mid = F.concat(F.lit('",'), F.substr(made, F.lit(2), F.length(made) - 2), F.lit(',"source_ref":"'))
    rest = F.when(said.isNotNull(), F.concat(F.lit(","), F.substr(F.to_json(F.struct(said.alias("description"))), F.lit(2))))
    parts = [_head("relationship").alias("head"), mid.alias("mid"), F.concat(F.lit('"'), F.coalesce(rest, F.lit("}"))).alias("tail")]
    rows = df.select(
        *by, F.lit(relation).alias("relationship_type"), source.alias("source_ref"), target.alias("target_ref"), sid.alias("id"), *parts
    )
    return rows.withColumn("body", _spelled())


def _spelled() -> Column:
    """The JSON of an object from its parts and ids."""
    ends = F.concat("mid", "source_ref", F.lit('","target_ref":"'), "target_ref")
    return F.concat("head", "id", F.coalesce(ends, F.lit("")), "tail")


def stix_nodes(actors, techniques, malware, indicators, campaigns, as_of, *, by=BY) -> DataFrame:
    """All nodes but the report."""
    parts = [
        producer_node(actors, as_of, by=by),
        actor_nodes(actors, as_of, by=by),
        technique_nodes(techniques, as_of, by=by),
        malware_nodes(malware, as_of, by=by),
        indicator_nodes(indicator_rows(indicators, by=by), as_of, by=by),
        campaign_nodes(campaigns, as_of, by=by),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ioc_to_malware(indicators: DataFrame, malware: DataFrame, *, by=BY) -> DataFrame:
    """Indicators joined to the malware their family names, ignoring case."""
    known = malware.select(*by, text.fold_key(F.col("name")).alias("_m")).distinct()
    rows = indicators.withColumn("_m", text.fold_key(F.col("malware_family"))).filter("_m <> ''")
    return rows.join(known, [*by, "_m"]).withColumnRenamed("_m", "malware_key")


def stix_edges(techniques, malware, indicators, campaigns, as_of, *, by=BY) -> DataFrame:
    """uses, uses, indicates (actor), indicates (malware), attributed-to."""
    c = F.col
    scope = [c(b) for b in by]
    who = F.concat_ws(" ", *scope)
    actor = labels.stable_id("intrusion-set", *scope)
    tech = techniques.select(*by, F.upper(text.strip(c("technique_id"))).alias("k")).filter("k <> ''").distinct()
    mal = malware.select(*by, text.fold_key(c("name")).alias("k")).filter("k <> ''").distinct()
    camp = campaigns.select(*by, text.strip(c("name")).alias("k")).filter("k <> ''").distinct()
    rows = indicator_rows(indicators, by=by)
    ind = labels.stable_id("indicator", *scope, c("pattern"))
    uses = F.concat(who, F.lit(" uses "), c("k"))
    parts = [
        _edge(tech, "uses", actor, labels.stable_id("attack-pattern", *scope, c("k")), uses, as_of, by),
        _edge(mal, "uses", actor, labels.stable_id("malware", *scope, c("k")), uses, as_of, by),
        _edge(rows, "indicates", ind, actor, F.concat(F.lit("Associated with "), who), as_of, by),
        _edge(
            camp, "attributed-to", labels.stable_id("campaign", *scope, c("k")), actor,
            F.concat(F.lit("Attributed to "), who), as_of, by,
        ),
    ]
    if "malware_family" in rows.columns:
        linked = ioc_to_malware(rows, malware, by=by)
        said = F.concat(F.lit("Associated with "), c("malware_family"))
        target = labels.stable_id("malware", *scope, c("malware_key"))
        parts.append(_edge(linked, "indicates", ind, target, said, as_of, by))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: objects that are one per group and pattern, as their indicators are, or one per pair of ends
UNIQUE = ("indicator", "indicates")


def report_refs(nodes: DataFrame, edges: DataFrame, *, by=BY, unique=()) -> DataFrame:
    """(group, report_id, id): every object a report refers to, one row each.

    Types of nodes and edges named in ``unique`` have each id once in a group as
    they come (see ``UNIQUE``), so they are not shuffled to find that out.
    """
    cols = [*by, "id"]
    rows = nodes.filter("type <> 'report'").select(*cols, "type").unionByName(edges.select(*cols, F.col("relationship_type").alias("type")))
    known = F.col("type").isin(*unique) if unique else F.lit(False)
    refs = rows.filter(~known).select(*cols).distinct()
    if unique:
        refs = refs.unionByName(rows.filter(known).select(*cols))
    return refs.withColumn("report_id", labels.stable_id("report", *[F.col(b) for b in by]))


def stix_objects(nodes: DataFrame, edges: DataFrame, reports: DataFrame, *, by=BY) -> DataFrame:
    """(group, place, id, body): the lines of a graph file: the bundle's header, then objects, edges and the report.

    The parts of the body and the ids in it come along for :func:`write_objects`.
    """
    none = F.lit(None).cast("string")
    ends = lambda df: [(F.col(x) if x in df.columns else none).alias(x) for x in ("mid", "source_ref", "target_ref")]
    at = lambda df, place: df.select(*by, F.lit(place).alias("place"), "id", "head", "tail", *ends(df))
    bundle = labels.stable_id("bundle", *[F.col(b) for b in by])
    header = reports.select(
        *by, F.lit(0).alias("place"), bundle.alias("id"), F.lit('{"type":"bundle","id":"').alias("head"),
        F.lit(f'","spec_version":"{SPEC}"}}').alias("tail"), *[none.alias(x) for x in ("mid", "source_ref", "target_ref")],
    )
    rows = header.unionByName(at(nodes, 1)).unionByName(at(edges, 2)).unionByName(at(reports, 3))
    return rows.withColumn("body", _spelled())


def write_objects(objects: DataFrame, path: str, slug: str = "actor_slug", **how) -> DataFrame:
    """A folder per actor with one object per line, the bundle's header first, then by place and id; compressed.

    Rows are put in order with their ids as kind and 16 bytes (see ``labels.stable_id``) and the parts of
    their bodies; bodies are spelled out behind the exchange.  ``how`` is what ``write_partitioned`` takes besides.
    """
    from .indicators import write_partitioned

    ids = ("id", "source_ref", "target_ref")
    packed = [x for i in ids for x in (labels.id_kind(F.col(i)).alias(f"{i}_kind"), labels.id_bytes(F.col(i)).alias(f"{i}_bytes"))]
    rows = objects.select(slug, "place", *packed, "head", "mid", "tail")

    def finish(placed: DataFrame) -> DataFrame:
        spelled = placed.select(slug, "place", "head", "mid", "tail", *[labels.id_text(F.col(f"{i}_kind"), F.col(f"{i}_bytes")).alias(i) for i in ids])
        return spelled.select(slug, "place", "id", _spelled().alias("body"))

    # most of a line is the names of its fields and random digits, so the quick level packs it nearly as well
    how = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", **how}
    write_partitioned(rows, path, "json", slug, ["place", "id_kind", "id_bytes"], finish=finish, **how)
    return objects
