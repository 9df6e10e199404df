"""Official advisories and exploited vulnerabilities of an actor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from . import BY, ORDER
from .mentions import text_mentions
from .ordering import distinct_values, keep_first


def normalize_advisory(df: DataFrame) -> DataFrame:
    """url or link, date or published, summary or description; sectors and technique ids in the text."""
    get = lambda *names: F.coalesce(*[F.nullif(n, F.lit("")) for n in names if n in df.columns], F.lit(""))
    tags, summary, body = get("tags"), get("summary"), get("body")
    rest = [c for c in df.columns if c not in {"title", "url", "link", "date", "published", "summary", "description"}]
    return df.select(
        *rest,
        get("title").alias("title"),
        get("url", "link").alias("url"),
        get("date", "published").alias("date"),
        get("summary", "description").alias("summary"),
        labels.advisory_sectors(F.concat_ws(" ", tags, summary)).alias("sectors"),
        labels.technique_ids_in(F.concat_ws(" ", body, summary)).alias("technique_ids"),
    )


def advisory_text(df: DataFrame) -> DataFrame:
    """Adds the text actors are searched in."""
    names = [n for n in ("title", "summary", "description", "tags", "body") if n in df.columns]
    return df.withColumn("search_text", F.concat_ws(" ", *[F.coalesce(n, F.lit("")) for n in names]))


def mentioned(texts: DataFrame, terms: DataFrame, key: str, field: str = "search_text", strategy=None) -> DataFrame:
    """Rows per actor one of whose names occurs in the text; the searched text is not copied to them."""
    found = text_mentions(texts, key, field, terms, strategy=strategy)
    return found.join(texts.drop(field, "actor"), key)


def advisory_techniques(advisories: DataFrame, *, by=BY, order=ORDER) -> DataFrame:
    """Technique ids of a group's advisories, first mention first, each once."""
    rows = advisories.select(*by, *order, F.posexplode("technique_ids").alias("item_pos", "technique_id"))
    return keep_first(rows, [*by, "technique_id"], [*order, "item_pos"])


def advisory_sectors(advisories: DataFrame, *, by=BY, order=ORDER) -> DataFrame:
    """Sectors of a group's advisories, each once ignoring case."""
    rows = advisories.select(*by, *order, F.posexplode("sectors").alias("item_pos", "sector"))
    return distinct_values(rows, F.col("sector"), by, [*order, "item_pos"], name="sector")
