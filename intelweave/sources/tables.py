"""Landed dimension and snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import as_ts
from ..operators.aliases import alias_rows
from ..operators.ordering import latest_by


def _load(spark: SparkSession, path, schema: str, fmt: str) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def read_aliases(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    """Alias rows from a landed actor table."""
    return alias_rows(_load(spark, path, schemas.ACTORS, fmt))


def read_feeds(spark: SparkSession, path, custom=None, fmt: str = "json") -> DataFrame:
    """Feed registry followed by the user's own feeds."""
    feeds = _load(spark, path, schemas.FEEDS, fmt)
    return with_custom_feeds(feeds, _load(spark, custom, schemas.FEEDS, fmt)) if custom else feeds


def with_custom_feeds(feeds: DataFrame, custom: DataFrame) -> DataFrame:
    """User feeds are listed after the registry."""
    return feeds.withColumn("origin", F.lit(0)).unionByName(
        custom.withColumn("origin", F.lit(1)), allowMissingColumns=True
    )


def read_detection_repos(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    return _load(spark, path, schemas.REPOS, fmt)


def latest_snapshot(df: DataFrame, key, ttl_hours: int, as_of, ts: str = "fetched_at") -> DataFrame:
    """Newest snapshot per key, if it is not older than the time to live."""
    oldest = as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))
    # the filter comes first: it prunes files before any shuffle, and if the
    # newest snapshot is too old then so are the others
    return newest_snapshot(df.filter(F.col(ts) >= oldest), key, ts)


def newest_snapshot(df: DataFrame, key, ts: str = "fetched_at", tie=()) -> DataFrame:
    """Newest snapshot per key, however old."""
    keys = [key] if isinstance(key, str) else list(key)
    return latest_by(df, keys, [ts, *tie])


def read_snapshots(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    return _load(spark, path, schemas.SNAPSHOT, fmt)
