"""Indicators in freshness blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..config import DEFAULTS, Settings
from ..functions import dates, ioc
from . import BY
from .ordering import top_n


def with_bucket(indicators: DataFrame, as_of, unknown: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds ``bucket``; rows without a readable date get ``unknown`` or, without it, go."""
    label = dates.freshness(
        F.col("last_seen"), F.col("first_seen"), as_of, settings.fresh_days, settings.aging_days, unknown
    )
    return indicators.withColumn("bucket", label).filter("bucket is not null")


def bucket_counts(bucketed: DataFrame, *, by=BY) -> DataFrame:
    return bucketed.groupBy(*by, "bucket").agg(F.count("*").alias("indicators"))


def cap_per_bucket(bucketed: DataFrame, n: int, type_order: dict, *, by=BY) -> DataFrame:
    """First n rows of every block by type order, then value."""
    rank = ioc.type_rank(F.col("type"), type_order, 9)
    return top_n(bucketed, n, [*by, "bucket"], [rank, F.col("value")], rank="row_no")


def blocklist(indicators: DataFrame, as_of, settings: Settings = DEFAULTS, *, by=BY) -> DataFrame:
    """FRESH and AGING rows of a playbook."""
    rows = with_bucket(indicators, as_of, None, settings).filter("bucket <> 'STALE'")
    return cap_per_bucket(rows, settings.playbook_rows, vocab.BLOCKLIST_TYPE_ORDER, by=by)


def page_rows(indicators: DataFrame, as_of, settings: Settings = DEFAULTS, *, by=BY) -> DataFrame:
    """FRESH, AGING and STALE rows of a page; undated rows are STALE."""
    rows = with_bucket(indicators, as_of, "STALE", settings)
    return cap_per_bucket(rows, settings.page_rows, vocab.PAGE_TYPE_ORDER, by=by)
