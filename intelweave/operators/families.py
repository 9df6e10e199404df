"""Malware families and the indicators a family feed has for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import ioc, labels, text
from . import BY
from .ordering import keep_first, top_n


def normalize_family(df: DataFrame) -> DataFrame:
    """(slug, common_name, description, tags, alt_names, yara) to a malware row."""
    c = F.col
    return df.select(
        *[x for x in df.columns if x not in {"common_name", "description", "tags", "alt_names", "yara"}],
        F.coalesce(F.nullif("common_name", F.lit("")), labels.display_slug(c("slug"))).alias("name"),
        labels.family_class(F.coalesce("tags", F.array().cast("array<string>"))).alias("type"),
        F.regexp_replace(F.coalesce("description", F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1").alias("description"),
        F.coalesce("alt_names", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(F.size("yara"), F.lit(0)).alias("yara_count"),
    )


def cap_families(families: DataFrame, n: int | None = DEFAULTS.families_per_actor, *, by=BY) -> DataFrame:
    return top_n(families, n, by, ["pos"])


def family_details(families: DataFrame, details: DataFrame) -> DataFrame:
    """Families with their detail row; those without one are dropped."""
    return families.join(details, "slug")


def parse_family_ioc(df: DataFrame) -> DataFrame:
    """Raw feed rows (ioc, ioc_type, threat_type, ...) to indicator rows.

    Unmapped types and blank values are dropped; the port goes from ``ip:port``.
    """
    c = F.col
    # each input is named once by what the filter asks, and a text that several columns need has a step of its own:
    # Spark puts the inputs' own expressions there, and code that repeats them is too long to be compiled
    cut = F.when(F.lower("ioc_type") == "ip:port", F.lit(":")).otherwise(F.lit(""))
    value = text.strip(F.split_part(text.strip(c("ioc")), cut, F.lit(1)))
    family = F.coalesce(F.nullif("malware", F.lit("")), F.nullif("malware_printable", F.lit("")))
    known = df.filter(ioc.family_type(c("ioc_type")).isNotNull()).withColumn("_value", value).filter("_value <> ''")
    known = known.withColumns({"_label": ioc.threat_label(c("threat_type")), "_family": family})
    day = lambda n: F.left(F.coalesce(n, F.lit("")), F.lit(10))
    used = {"ioc", "ioc_type", "threat_type", "confidence_level", "first_seen", "last_seen", "malware", "malware_printable"}
    return known.select(
        *[x for x in df.columns if x not in used],
        ioc.family_type(c("ioc_type")).alias("type"),
        c("_value").alias("value"),
        F.coalesce(c("confidence_level").try_cast("int"), F.lit(0)).alias("confidence_score"),
        F.lower(F.coalesce("threat_type", F.lit(""))).alias("threat_type"),
        c("_label").alias("threat_label"),
        day("first_seen").alias("first_seen"),
        day("last_seen").alias("last_seen"),
        F.coalesce("_family", F.lit("")).alias("malware"),
        F.coalesce(F.concat("_label", F.lit(" — "), "_family"), "_label").alias("description"),
    )


def cap_per_family(feed: DataFrame, n: int | None = DEFAULTS.iocs_per_family, family: str = "family") -> DataFrame:
    """First n feed rows of a family, where a client's request limit is wanted."""
    return top_n(feed, n, [family], ["pos"])


def _families(malware: DataFrame, by) -> DataFrame:
    names = malware.select(*by, F.col("name").alias("family"), F.col("pos").alias("family_pos"))
    return keep_first(names, [*by, "family"], ["family_pos"])


def value_classes(feed: DataFrame, n: int | None = DEFAULTS.iocs_per_family) -> DataFrame:
    """The first feed row of each family and value, with the class of its value.

    Values that the same families have are one class; ``class_id`` is a hash of
    the set of families, taken over one row per family that has the value.
    """
    rows = keep_first(cap_per_family(feed, n), ["family", "type", F.lower("value")], ["pos"])
    held = rows.groupBy("type", F.lower("value").alias("_value")).agg(
        F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "type"])).alias("_rows")
    )
    families = F.array_sort(F.transform("_rows", lambda r: r["family"]))
    return held.select("type", F.xxhash64(families).alias("class_id"), F.inline("_rows"))


def class_owners(malware: DataFrame, classes: DataFrame, *, by=BY) -> DataFrame:
    """(group, class_id, family, family_pos): the family of a group that its values of a class belong to.

    That is the first of the group's families that the class has.  It is decided
    between the groups' families and the classes, without any value.
    """
    members = classes.select("class_id", "family").distinct()
    # a family's place among those of its group is a number, so the first one is a plain minimum
    ranked = top_n(_families(malware, by), None, by, ["family_pos", "family"], rank="_nth")
    first = ranked.join(members, "family").groupBy(*by, "class_id").agg(F.min("_nth").alias("_nth"))
    return first.join(ranked, [*by, "_nth"]).select(*by, "class_id", "family", "family_pos")


def family_iocs(
    malware: DataFrame, feed: DataFrame, n: int | None = DEFAULTS.iocs_per_family, *, by=BY, once=lambda name, build: build()
) -> DataFrame:
    """Feed indicators of a group's malware; a repeated one belongs to the group's first family that has it.

    Ownership is decided per group and class of values, so every joined row is a
    result.  With a request limit the feed is cut per family first.  ``once(name,
    build)`` may write the classes and owners, which are read more than once
    (see ``RunBase.once``).
    """
    classed = once("family_feed", lambda: value_classes(feed, n))
    return owned_iocs(once("owners", lambda: class_owners(malware, classed, by=by)), classed)


def owned_iocs(owners: DataFrame, classed: DataFrame) -> DataFrame:
    """The feed rows that belong to each group, from :func:`class_owners` and :func:`value_classes`."""
    return owners.join(classed, ["class_id", "family"]).drop("class_id").withColumnRenamed("family", "malware_family")


def family_hits(malware: DataFrame, feed: DataFrame, n: int | None = DEFAULTS.iocs_per_family, *, by=BY) -> DataFrame:
    """Indicators per family before they are made unique; only families with any."""
    hits = cap_per_family(feed, n).groupBy("family").agg(F.count("*").alias("hits"))
    return _families(malware, by).join(hits, "family").select(*by, "family", "hits", "family_pos")


def top_families(hits: DataFrame, n: int, *, by=BY) -> DataFrame:
    """Families with the most hits, ties in list order."""
    return top_n(hits, n, by, [F.desc("hits"), F.asc("family_pos")])


def family_ioc_order(recency: bool = False) -> list[Column]:
    """Score, then threat priority, then first seen (oldest first unless ``recency``)."""
    seen = F.desc("first_seen") if recency else F.asc("first_seen")
    return [F.desc("confidence_score"), ioc.threat_priority(F.col("threat_type")).asc(), seen]


def ioc_counts(indicators: DataFrame, added: Column, *, by=BY) -> DataFrame:
    """Indicators per type: all, those a family feed added, the others."""
    return indicators.groupBy(*by, "type").agg(
        F.count("*").alias("total"), F.count_if(added).alias("added"), F.count_if(~added).alias("other")
    )
