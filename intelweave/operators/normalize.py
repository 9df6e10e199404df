"""Bringing records to the common form and rejecting what cannot be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, ioc, labels, text
from . import BY


def require_identity(df: DataFrame, actor="actor_name", source="source_id") -> tuple[DataFrame, DataFrame]:
    """(usable, rejected): both identity fields must be there."""
    ok = F.coalesce(F.col(actor) != "", F.lit(False)) & F.coalesce(F.col(source) != "", F.lit(False))
    rejected = df.filter(~ok).withColumn(
        "reason", F.when(F.coalesce(F.col(actor), F.lit("")) == "", F.lit(actor)).otherwise(F.lit(source))
    )
    return df.filter(ok), rejected


def has_identity(actor: Column, source: Column) -> Column:
    return (F.coalesce(actor, F.lit("")) != "") & (F.coalesce(source, F.lit("")) != "")


def normalize_record(df: DataFrame, as_of) -> DataFrame:
    """Scalar and list fields of a common record; nested entries have their own functions."""
    c = F.col
    blank = lambda name: F.coalesce(text.strip(c(name)), F.lit(""))
    good, _ = require_identity(df)
    return good.withColumns(
        {
            "actor_name": text.squash_ws(c("actor_name")),
            "source_id": text.strip(c("source_id")),
            "aliases": text.clean_list(c("aliases")),
            "source_url": blank("source_url"),
            "retrieved_at": dates.iso_ts(dates.parse_ts(c("retrieved_at"), as_of)),
            "origin": blank("origin"),
            "motivations": labels.canonical_motivations(c("motivations")),
            "first_seen": dates.parse_ts_lenient(c("first_seen"), as_of),
            "sponsorship": blank("sponsorship"),
            "sectors": labels.canonical_sectors(c("sectors")),
            "countries": text.clean_list(c("countries")),
            "source_citation": F.coalesce(text.non_blank(c("source_citation")), c("source_id")),
        }
    )


def normalize_techniques(df: DataFrame) -> DataFrame:
    """Valid technique rows with the id in canonical form and the record source as default."""
    c = F.col
    tid = labels.technique_id(c("technique_id"))
    out = df.withColumn("technique_id", tid).filter("technique_id is not null")
    for name in ("name", "tactic", "description"):
        out = out.withColumn(name, F.coalesce(text.strip(c(name)), F.lit("")))
    return out


def normalize_indicators(df: DataFrame, as_of) -> DataFrame:
    """Rows of a canonical type with a value; types are mapped, first_seen is ISO."""
    c = F.col
    out = df.withColumns({"type": ioc.canonical_type(c("type")), "value": text.strip(c("value"))})
    out = out.filter(ioc.is_canonical(c("type"), c("value")))
    return out.withColumns(
        {
            "context": F.coalesce(text.strip(c("context")), F.lit("")),
            "first_seen": dates.parse_ts_lenient(c("first_seen"), as_of),
        }
    )


def normalize_malware(df: DataFrame) -> DataFrame:
    """Rows with a name."""
    return df.withColumn("name", text.strip(F.col("name"))).filter(F.coalesce("name", F.lit("")) != "")


def normalize_campaigns(df: DataFrame, as_of) -> DataFrame:
    """Rows that say something: a description or a reference."""
    c = F.col
    said = ~text.is_blank(c("description")) | ~text.is_blank(c("reference"))
    return df.filter(said).withColumn("date", dates.parse_ts_lenient(c("date"), as_of))


# --- one projection per source family ------------------------------------


def map_techniques(df: DataFrame, default_source: str, keep_text: bool = True) -> DataFrame:
    """Technique rows of a source: id upper-cased, tactic relabelled, default source.

    The pulse source publishes no usable prose, so its text is blanked
    (``keep_text=False``).
    """
    c = F.col
    prose = lambda n: F.coalesce(c(n), F.lit("")) if keep_text else F.lit("")
    return (
        df.withColumn("technique_id", F.upper(text.strip(c("technique_id"))))
        .filter(F.coalesce("technique_id", F.lit("")) != "")
        .withColumns(
            {
                "tactic": labels.tactic_label(c("tactic")),
                "description": prose("description"),
                "detection": prose("detection"),
                "source_id": F.coalesce(c("source_id"), F.lit(default_source)),
            }
        )
    )


def map_passthrough_techniques(df: DataFrame, default_source: str) -> DataFrame:
    """Like :func:`map_techniques` for sources that publish final tactic names."""
    return (
        df.withColumn("technique_id", F.upper(text.strip(F.col("technique_id"))))
        .filter(F.coalesce("technique_id", F.lit("")) != "")
        .withColumn("source_id", F.coalesce(F.col("source_id"), F.lit(default_source)))
    )


def map_malware(df: DataFrame) -> DataFrame:
    """Malware rows of a source: named ones, with ``malware`` as the default type."""
    return df.filter(~text.is_blank(F.col("name"))).withColumn("type", F.coalesce("type", F.lit("malware")))


def map_campaigns(df: DataFrame) -> DataFrame:
    c = F.col
    return (
        df.withColumn("name", text.strip(c("name")))
        .filter(F.coalesce("name", F.lit("")) != "")
        .withColumns({n: F.coalesce(c(n).cast("string"), F.lit("")) for n in ("first_seen", "last_seen")})
    )


def map_indicators(df: DataFrame) -> DataFrame:
    """Indicator rows that have a type and a value."""
    return df.filter((F.coalesce("type", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != ""))


def display_fields(techniques: DataFrame, meta: DataFrame, recs: DataFrame, *, by=BY) -> DataFrame:
    """technique_name and the detection text: first recommendation, else meta."""
    from .merge import fill_from

    keys = [*by, "technique_id"]
    first_rec = recs.groupBy(*keys).agg(
        F.min_by("recommendation", F.struct(*[c for c in recs.columns if c in ("source_rank", "pos", "rec_pos")])).alias("_rec")
    )
    filled = fill_from(techniques, meta, keys, ["name", "tactic", "detection"])
    return (
        filled.join(first_rec, keys, "left")
        .withColumn("technique_name", F.coalesce("name", F.lit("")))
        .withColumn("detection", F.coalesce(F.nullif("_rec", F.lit("")), "detection", F.lit("")))
        .drop("_rec")
    )
