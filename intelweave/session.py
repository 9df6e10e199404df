"""Session construction for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, app: str = "intelweave", scratch: str | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own.

    ``scratch`` becomes the shared folder; without it the environment names one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        # merge keys are near-unique: keep aggregating in memory beyond the default of 128 keys a task
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    return (builder.config("spark.checkpoint.dir", scratch) if scratch else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
