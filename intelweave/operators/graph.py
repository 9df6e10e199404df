"""One-hop lookups in the object graph, as equi-joins over objects and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import dates, labels, text
from .ordering import keep_first


def live(objects: DataFrame) -> DataFrame:
    return objects.filter(~F.coalesce("revoked", F.lit(False)))


def resolve_group(names: DataFrame, objects: DataFrame, name: str = "name") -> DataFrame:
    """First group in file order called like the name, by its own name or an alias.

    Revoked groups count; names that match nothing are dropped.
    """
    groups = objects.filter(F.col("type") == "intrusion-set")
    called = F.concat(F.array(F.col("name")), F.coalesce("aliases", F.array().cast("array<string>")))
    index = groups.select(
        F.col("id").alias("group_id"), F.col("pos").alias("group_pos"), F.explode(called).alias("_called")
    ).withColumn("_called", F.lower("_called"))
    index = keep_first(index.filter("_called is not null"), ["_called"], ["group_pos", "group_id"])
    return names.join(index, F.lower(text.strip(F.col(name))) == F.col("_called")).drop("_called", "group_pos")


def related(groups: DataFrame, objects: DataFrame, edges: DataFrame, relation: str, types) -> DataFrame:
    """Live targets of the given types reached from each group by ``relation``."""
    wanted = live(objects).filter(F.col("type").isin(*types))
    hops = edges.filter(F.col("relationship_type") == relation).select(
        F.col("source_ref").alias("group_id"), F.col("target_ref").alias("id"), F.col("pos").alias("edge_pos")
    )
    return hops.join(groups, "group_id").join(wanted.drop("pos"), "id")


def related_reverse(groups: DataFrame, objects: DataFrame, edges: DataFrame, relation: str, types) -> DataFrame:
    """Live sources of the given types that point at each group by ``relation``."""
    flipped = edges.withColumns({"source_ref": F.col("target_ref"), "target_ref": F.col("source_ref")})
    return related(groups, objects, flipped, relation, types)


def external_id(refs: Column, pattern: str) -> Column:
    """First external id that matches the whole pattern, '' when none does."""
    hits = F.filter(refs, lambda r: F.coalesce(r["external_id"], F.lit("")).rlike(f"^{pattern}$"))
    return F.coalesce(F.try_element_at(hits, F.lit(1))["external_id"], F.lit(""))


def reference_url(refs: Column, source: str = "mitre-attack") -> Column:
    hits = F.filter(refs, lambda r: r["source_name"] == source)
    return F.coalesce(F.try_element_at(hits, F.lit(1))["url"], F.lit(""))


def primary_and_secondary(primary: Column, secondary: Column) -> Column:
    """Primary motivation, then the secondary ones, each once."""
    head = F.when(F.coalesce(primary, F.lit("")) != "", F.array(primary)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(head, F.coalesce(secondary, F.array().cast("array<string>"))))


def _cut(c: Column, limit: int | None) -> Column:
    return text.truncate(c, limit) if limit else text.strip(c)


def technique_from_object(df: DataFrame, text_limit: int | None = None, detection_limit: int | None = None) -> DataFrame:
    """Technique fields of a graph object; rows without a technique id are dropped.  Limits cut texts for display."""
    tactics = labels.phase_tactics(F.transform("kill_chain_phases", lambda p: p["phase_name"]))
    detection = F.coalesce(F.nullif("x_mitre_detection", F.lit("")), "detection", F.lit(""))
    return (
        df.withColumn("technique_id", external_id(F.col("external_references"), labels.TECHNIQUE_ID))
        .filter("technique_id <> ''")
        .withColumns(
            {
                "tactics": tactics,
                "tactic": text.first_label(tactics, ""),
                "description": _cut(F.coalesce("description", F.lit("")), text_limit),
                "detection": _cut(detection, detection_limit),
            }
        )
    )


def software_from_object(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("name", F.lit("")) != "").withColumns(
        {
            "type": text.first_label(F.col("labels"), "malware"),
            "description": text.strip_md_links(F.coalesce("description", F.lit(""))),
        }
    )


def campaign_from_object(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce("name", F.lit("")) != "").withColumns(
        {
            "description": text.strip_md_links(F.coalesce("description", F.lit(""))),
            "url": reference_url(F.col("external_references")),
        }
    )


def group_supplement(spark) -> DataFrame:
    """Curated group facts as a table."""
    rows = [(g, seen, mots, origin) for g, (seen, mots, origin) in vocab.GROUP_SUPPLEMENT.items()]
    return spark.createDataFrame(
        rows, "mitre_id string, s_first_seen string, s_motivations array<string>, s_origin string"
    )


def group_records(groups: DataFrame, supplement: DataFrame, limit: int | None = None, keep=()) -> DataFrame:
    """Record fields of a group; curated facts win over inferred ones."""
    c = F.col
    base = groups.withColumn("mitre_id", external_id(c("external_references"), r"G\d{4}"))
    out = base.join(supplement, "mitre_id", "left")
    others = F.filter(
        F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) != F.lower(c("name"))
    )
    return out.select(
        *keep,
        c("name").alias("actor_name"),
        "mitre_id",
        others.alias("aliases"),
        _cut(text.strip_md_links(F.coalesce("description", F.lit(""))), limit).alias("description"),
        F.coalesce(
            F.nullif("s_origin", F.lit("")), labels.infer_origin(c("x_mitre_contributors"), c("description"))
        ).alias("origin"),
        F.coalesce(
            F.nullif("s_first_seen", F.lit("")), dates.first_year(F.coalesce("description", F.lit("")))
        ).alias("first_seen"),
        F.coalesce(
            "s_motivations", primary_and_secondary(c("primary_motivation"), c("secondary_motivations"))
        ).alias("motivations"),
    )
