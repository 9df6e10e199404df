"""Merging entities across sources, with provenance-based confidence.

A merge is one aggregation per key.  Everything it keeps per key is bounded (one
row, one value per field, one entry per source), so each map task sends at most
one small buffer per key, however often an item was reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.labels import confidence_label
from ..functions.text import fold_key, non_blank
from . import BY, ORDER
from .ordering import distinct_values, first_present, keep_first, order_key, present


def merge_entities(
    df: DataFrame, keys: dict[str, Column], *, keep=(), fill=(), source="source_id", order=ORDER
) -> DataFrame:
    """One row per key.

    ``keep`` columns come from the first row as a whole, each ``fill`` column
    from the first row where it carries something.  Adds ``first_at`` (merge
    order) and ``sources`` (source ids by first appearance).  The first order
    column ranks the sources, so the order of their ranks is that of their
    first appearance.
    """
    keyed = df.withColumns(keys)
    first = order_key(order)
    merged = keyed.groupBy(*keys).agg(
        F.min(first).alias("_first"),
        *([F.min_by(F.struct(*keep), first).alias("_keep")] if keep else []),
        *[
            F.min(F.when(present(keyed, f), F.struct(first.alias("o"), F.col(f).alias("v")))).alias(f"_f_{f}")
            for f in fill
        ],
        F.array_sort(F.collect_set(F.struct(F.col(order[0]).alias("o"), F.col(source).alias("s")))).alias("_src"),
    )
    return merged.select(
        *keys,
        *[F.col(f"_keep.{c}").alias(c) for c in keep],
        *[F.col(f"_f_{f}.v").alias(f) for f in fill],
        F.array_distinct(F.transform("_src", lambda e: e["s"])).alias("sources"),
        F.col("_first").alias("first_at"),
    )


def _keys(by, **named: Column) -> dict[str, Column]:
    return {**{b: F.col(b) for b in by}, **named}


def with_confidence(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """HIGH / MEDIUM / LOW from the ``sources`` array."""
    return df.withColumn("confidence", confidence_label(F.col("sources"), settings.high_provenance))


def merge_techniques(df: DataFrame, *, by=BY, order=ORDER, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per (group, technique id); blanks are filled by later rows."""
    rows = df.filter(F.coalesce(F.col("technique_id"), F.lit("")) != "")
    out = merge_entities(
        rows,
        _keys(by, technique_id=F.col("technique_id")),
        fill=("name", "tactic", "description", "detection"),
        order=order,
    )
    return with_confidence(out, settings)


def technique_recommendations(df: DataFrame, *, by=BY, order=ORDER) -> DataFrame:
    """Ordered union of the detection recommendations, one row each."""
    rows = df.select(
        *by, "technique_id", *order, F.posexplode("detection_recs").alias("rec_pos", "recommendation")
    )
    return keep_first(rows, [*by, "technique_id", "recommendation"], [*order, "rec_pos"])


def merge_indicators(df: DataFrame, *, by=BY, order=ORDER, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per (group, type, value ignoring case).

    The first row is kept whole; its own source list is followed by the record
    sources in order of appearance.
    """
    extra = [c for c in df.columns if c not in {*by, *order, "type", "source_id", "sources", "value_key"}]
    own = "sources" in df.columns
    rows = df.withColumnRenamed("sources", "_own") if own else df
    out = merge_entities(
        rows,
        _keys(by, type=F.col("type"), value_key=F.lower("value")),
        keep=[*extra, "_own"] if own else extra,
        order=order,
    )
    if own:
        out = out.withColumn(
            "sources",
            F.array_distinct(F.concat(F.coalesce("_own", F.array().cast("array<string>")), "sources")),
        ).drop("_own")
    return with_confidence(out, settings)


def merge_malware(df: DataFrame, *, by=BY, order=ORDER) -> DataFrame:
    """One row per (group, name ignoring case); blanks are filled by later rows."""
    fill = [c for c in ("description", "type", "aliases", "yara_count") if c in df.columns]
    rows = df.filter(non_blank(F.col("name")).isNotNull())
    return merge_entities(
        rows, _keys(by, name_key=fold_key(F.col("name"))), keep=("name",), fill=fill, order=order
    )


def merge_campaigns(df: DataFrame, *, by=BY, order=ORDER) -> DataFrame:
    """One row per (group, trimmed name, case kept); blanks are filled by later rows."""
    rows = df.filter(non_blank(F.col("name")).isNotNull())
    fill = [c for c in ("description", "url", "first_seen", "last_seen", "reference") if c in df.columns]
    out = merge_entities(rows, _keys(by, name=non_blank(F.col("name"))), fill=fill, order=order)
    return out


def merge_cves(df: DataFrame, *, by=BY, order=ORDER) -> DataFrame:
    """First entry per CVE id."""
    return keep_first(df.filter(F.coalesce("cve_id", F.lit("")) != ""), [*by, "cve_id"], order)


def article_identity(url="url", title="title") -> Column:
    """The url, or the title where there is no url."""
    return F.coalesce(F.nullif(F.col(url), F.lit("")), F.col(title))


def merge_advisories(df: DataFrame, *, by=BY, order=ORDER, texts: bool = False) -> DataFrame:
    """First entry per url, or per title where there is no url.

    Bodies stay out of the merge.  With ``texts`` they join the rows that are
    left, by group and position, which tell rows apart.
    """
    heavy = [c for c in ("body", "content", "search_text") if c in df.columns]
    key = article_identity()
    rows = keep_first(df.drop(*heavy).filter(F.coalesce(key, F.lit("")) != ""), [*by, key], order)
    return rows.join(df.select(*by, *order, *heavy), [*by, *order]) if texts and heavy else rows


def merge_scalars(df: DataFrame, fields, *, by=BY, order=ORDER) -> DataFrame:
    """One row per group with the first value of each field that carries something."""
    return df.groupBy(*by).agg(*[first_present(df, f, order).alias(f) for f in fields])


def merge_strings(df: DataFrame, array: str, *, by=BY, order=ORDER) -> DataFrame:
    """Ordered distinct strings of a list field, ignoring case, one row each."""
    rows = df.select(*by, *order, F.posexplode(array).alias("item_pos", "item"))
    return distinct_values(rows, F.col("item"), by, [*order, "item_pos"])


def merge_string_fields(df: DataFrame, arrays, *, by=BY, order=ORDER) -> DataFrame:
    """Like :func:`merge_strings` over several fields; earlier fields come first."""
    empty = F.array().cast("array<string>")
    fields = F.array(*[F.coalesce(F.col(a), empty) for a in arrays])
    rows = df.select(*by, *order, F.posexplode(fields).alias("field", "items"))
    rows = rows.select(*by, *order, "field", F.posexplode("items").alias("item_pos", "item"))
    return distinct_values(rows, F.col("item"), by, ["field", *order, "item_pos"])


def merge_lists(df: DataFrame, arrays, *, by=BY, order=ORDER, name: str = "section") -> DataFrame:
    """Ordered distinct strings of several list fields, each field a list of its own, in one pass."""
    empty = F.array().cast("array<string>")
    fields = F.explode(F.array(*[F.struct(F.lit(a).alias("n"), F.coalesce(F.col(a), empty).alias("items")) for a in arrays]))
    rows = df.select(*by, *order, fields.alias("field"))
    rows = rows.select(*by, *order, F.col("field.n").alias(name), F.posexplode("field.items").alias("item_pos", "item"))
    return distinct_values(rows, F.col("item"), [*by, name], [*order, "item_pos"])


def sources_cited(df: DataFrame, *, by=BY, source="source_id", extra: str | None = None) -> DataFrame:
    """Sorted distinct source ids, with already aggregated lists folded in."""
    ids = F.array(F.col(source))
    if extra:
        ids = F.concat(ids, F.coalesce(F.col(extra), F.array().cast("array<string>")))
    rows = df.select(*by, F.explode(ids).alias("s")).filter(F.coalesce("s", F.lit("")) != "")
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set("s")).alias("sources_cited"))


def source_ledger(df: DataFrame, *, by=BY) -> DataFrame:
    """Citation, url and retrieval time of every contributing record."""
    return df.filter(F.coalesce("source_id", F.lit("")) != "").select(
        *by, "source_id", "source_citation", "source_url", "retrieved_at"
    )


def confidence_summary(df: DataFrame, *, by=BY) -> DataFrame:
    """Number of HIGH, MEDIUM and LOW rows."""
    return df.groupBy(*by).agg(
        *[
            F.count_if(F.upper("confidence") == label.upper()).alias(label)
            for label in ("high", "medium", "low")
        ]
    )


def fill_from(df: DataFrame, meta: DataFrame, keys, fields) -> DataFrame:
    """Fill blank fields from a meta table joined on the keys."""
    renamed = meta.select(*keys, *[F.col(f).alias(f"_m_{f}") for f in fields])
    out = df.join(renamed, list(keys), "left")
    for f in fields:
        out = out.withColumn(f, F.when(present(df, f), F.col(f)).otherwise(F.col(f"_m_{f}")))
    return out.drop(*[f"_m_{f}" for f in fields])


def technique_meta(raw: DataFrame, *, by=BY, order=ORDER, per_field: bool = True) -> DataFrame:
    """Name, detection and tactic of a technique id from the raw records.

    ``per_field`` takes the first non-blank value of each field; otherwise the
    first record decides all three, blank or not.
    """
    fields = ["name", "detection", "tactic"]
    rows = raw.withColumn("technique_id", F.upper(F.trim("technique_id"))).filter("technique_id <> ''")
    keys = [*by, "technique_id"]
    if per_field:
        return rows.groupBy(*keys).agg(*[first_present(rows, f, order).alias(f) for f in fields])
    return keep_first(rows, keys, order).select(*keys, *fields)


def malware_meta(raw: DataFrame, *, by=BY, order=ORDER) -> DataFrame:
    """Last record per family name: aliases, rule count, description."""
    from .ordering import latest_by

    rows = raw.withColumn("name_key", F.lower("name")).filter("name_key <> ''")
    return latest_by(rows, [*by, "name_key"], order).select(
        *by, "name_key", "aliases", "yara_count", "description"
    )


def new_rows(existing: DataFrame, candidates: DataFrame, *, by=BY) -> DataFrame:
    """Candidate indicators whose type + value (ignoring case) is not there yet."""
    known = existing.select(*by, "type", F.lower("value").alias("_vk"))
    rows = candidates.withColumn("_vk", F.lower("value"))
    return rows.join(known, [*by, "type", "_vk"], "left_anti").drop("_vk")


def append_new(existing: DataFrame, candidates: DataFrame, *, by=BY) -> DataFrame:
    """Existing indicators followed by the new ones."""
    return existing.unionByName(new_rows(existing, candidates, by=by), allowMissingColumns=True)


def union_records(*frames: DataFrame) -> DataFrame:
    """All source records; keys a source lacks become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
