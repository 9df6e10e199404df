"""Profiles: facts for a writer, and nested export objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import BY
from .ordering import first_present, gathered, keep_first, top_n


def tactic_frequency(techniques: DataFrame, n: int | None = 5, *, by=BY, order="first_at") -> DataFrame:
    """Techniques per tactic, most frequent first, ties by first appearance."""
    rows = techniques.filter(F.coalesce("tactic", F.lit("")) != "")
    counts = rows.groupBy(*by, "tactic").agg(F.count("*").alias("techniques"), F.min(order).alias("_at"))
    if n is None:
        return counts.drop("_at")
    return top_n(counts, n, by, [F.desc("techniques"), F.asc("_at")], rank="tactic_rank").drop("_at")


def distinct_tactics(techniques: DataFrame, *, by=BY) -> DataFrame:
    """Sorted distinct tactics; the vocabulary bounds the list."""
    return techniques.groupBy(*by).agg(
        F.sort_array(F.collect_set(F.nullif("tactic", F.lit("")))).alias("tactics")
    )


def high_confidence(
    techniques: DataFrame, n: int, fallback: int | None = None, *, by=BY, order="first_at"
) -> DataFrame:
    """First n HIGH rows; groups without any get their first ``fallback`` rows."""
    high = top_n(techniques.filter("confidence = 'HIGH'"), n, by, [order])
    if not fallback:
        return high
    answered = techniques.filter("confidence = 'HIGH'").select(*by).distinct()
    rest = techniques.join(answered, list(by), "left_anti")
    return high.unionByName(top_n(rest, fallback, by, [order]))


def top_list(df: DataFrame, value: Column, n: int, name: str, *, by=BY, order="first_at", sep=", ") -> DataFrame:
    """First n values of a group as one text."""
    rows = df.select(*by, value.alias("_v"), F.col(order).alias("_o")).filter(F.coalesce("_v", F.lit("")) != "")
    first = top_n(rows, n, by, ["_o"])
    return first.groupBy(*by).agg(F.array_join(gathered(F.col("_v"), F.col("_o")), sep).alias(name))


def backfill_attribution(profiles: DataFrame, raw: DataFrame, *, by=BY) -> DataFrame:
    """Origin and motivations from the raw records where a profile has none."""
    spare = raw.groupBy(*by).agg(
        first_present(raw, "origin").alias("_origin"), first_present(raw, "motivations").alias("_motivations")
    )
    out = profiles.join(spare, list(by), "left")
    has = F.coalesce(F.col("origin"), F.lit("")) != ""
    listed = F.coalesce(F.size("motivations"), F.lit(0)) > 0
    return (
        out.withColumn("origin", F.when(has, F.col("origin")).otherwise(F.col("_origin")))
        .withColumn("motivations", F.when(listed, F.col("motivations")).otherwise(F.col("_motivations")))
        .drop("_origin", "_motivations")
    )


def raw_passthrough(raw_indicators: DataFrame, *, by=BY) -> DataFrame:
    """Raw indicators first-wins by type + value, without merged sources or confidence.

    CVE-typed rows are left to the CVE table.
    """
    rows = raw_indicators.filter("type <> 'cve'")
    return keep_first(rows, [*by, "type", F.lower("value")])


def join_sections(header: DataFrame, *sections: DataFrame, by=BY) -> DataFrame:
    """Left-join one-row-per-group sections to the header."""
    out = header
    for s in sections:
        out = out.join(s, list(by), "left")
    return out


def brief_facts(
    header: DataFrame, techniques: DataFrame, malware: DataFrame, campaigns: DataFrame,
    sectors: DataFrame, aliases: DataFrame, articles: DataFrame, *, by=BY, executive: bool = False
) -> DataFrame:
    """Evidence row for a writer.

    The executive form has shorter lists and the first HIGH techniques instead
    of the leading tactics.
    """
    n_mal, n_camp, n_alias, n_art = (6, 4, 6, 4) if executive else (8, 5, 8, 6)
    name = F.col("name")
    line = F.concat(F.lit("- ["), "source", F.lit("] "), "title")
    parts = [
        top_list(malware, name, n_mal, "top_malware", by=by),
        top_list(campaigns, name, n_camp, "campaigns", by=by),
        top_list(sectors, F.col("value"), 8, "sectors", by=by),
        top_list(aliases, F.col("value"), n_alias, "aliases", by=by),
        top_list(
            articles.withColumn("first_at", F.struct(F.negative("relevance").alias("r"), F.col("pos").alias("p"))),
            line, n_art, "recent", by=by, sep="\n",
        ),
    ]
    if executive:
        named = techniques.filter(F.coalesce("name", F.lit("")) != "")
        parts.append(top_list(high_confidence(named, 8, by=by), name, 8, "high_techniques", by=by))
    else:
        tactics = tactic_frequency(techniques, 5, by=by)
        parts.append(top_list(tactics, F.col("tactic"), 5, "top_tactics", by=by, order="tactic_rank"))
    return join_sections(header, *parts, by=by).fillna("")


# --- nested export -----------------------------------------------------------


def section_items(df: DataFrame, section: str | Column, fields, key: Column, *, by=BY) -> DataFrame:
    """Rows of one section (or of the one each row names) as (group, section, key, item JSON) for the nested export."""
    return df.select(
        *by,
        (F.lit(section) if isinstance(section, str) else section).alias("section"),
        key.cast("string").alias("item_key"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("item"),
    )


SECTION_NAMES = (
    "techniques", "malware", "indicators", "campaigns", "cves", "advisories", "articles", "aliases", "sectors"
)


def assemble_profiles(header: DataFrame, items: DataFrame, *, by=BY, sections=SECTION_NAMES) -> DataFrame:
    """(group, section_no, section, item_key, item): a header row, then one JSON item per row, at any size.

    The order of a profile is (section_no, item_key); nothing is gathered.
    """
    number = F.create_map(*[F.lit(x) for i, n in enumerate(sections) for x in (n, i + 1)])
    rest = [c for c in header.columns if c not in by]
    head = header.select(
        *by, F.lit(0).alias("section_no"), F.lit("header").alias("section"), F.lit("").alias("item_key"),
        F.to_json(F.struct(*by, *rest), {"ignoreNullFields": "false"}).alias("item"),
    )
    rows = items.select(*by, number[F.col("section")].alias("section_no"), "section", "item_key", "item")
    return head.unionByName(rows)
