"""Incremental indicator feeds.

Event times must be TIMESTAMP (cast NTZ first, session zone UTC).  The watermark
trails the newest event by a delay the caller names; rows later than that are
dropped, so the delay is how far out of order batches may come.  The caller
names target and checkpoint as well: a refresh with the same two reads only
what has landed since the last one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS, Settings
from ..functions.labels import confidence_label
from ..operators.ordering import keep_first, latest_by

# of a folded table
BUCKETS = 64


def read_landed(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", ts: str | None = None, max_files: int | None = None
) -> DataFrame:
    """File stream over landed data; ``ts`` is cast to TIMESTAMP for watermarks.

    ``max_files`` bounds a micro-batch, and with it what one key can bring at once.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def stream_keep_first(df: DataFrame, keys, ts: str, ttl: str) -> DataFrame:
    """A key seen again within the time to live is ignored.

    At most one row per key within the time to live; which one survives a
    micro-batch is not fixed, so keep only columns the key decides, or use
    :func:`stream_readmit` where the time matters.
    """
    return df.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(list(keys))


def stream_readmit(df: DataFrame, key: str, ts: str, ttl_seconds: int, delay: str) -> DataFrame:
    """(key, ts) rows admitted: the first of a key, then the next one after the time to live.

    Batches are taken as they come: a row older than the last one admitted of
    its key counts as seen, a key's first row is admitted however late it is
    within ``delay``.  State is one timestamp per key, dropped when the
    watermark has passed its time to live.  A task holds the event times one
    key has in a micro-batch (eight bytes each); bound the batch with
    ``max_files`` of :func:`read_landed`.
    """
    ttl = ttl_seconds * 1_000_000

    def admit(group, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = np.unique(np.concatenate([b[ts].to_numpy("datetime64[us]").astype(np.int64) for b in batches]))
        kept = []
        # one step for each row admitted, not for each row
        at = 0 if last is None else int(np.searchsorted(times, last + ttl, side="right"))
        while at < len(times):
            last = int(times[at])
            kept.append(last)
            at = int(np.searchsorted(times, last + ttl, side="right"))
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({key: [group[0]] * len(kept), ts: pd.to_datetime(kept, unit="us")})

    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(key, ts)
        .withWatermark(ts, delay)
        .groupBy(key)
        .applyInPandasWithState(
            admit, f"{key} {kind}, {ts} timestamp", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def stream_sources(df: DataFrame, keys, ts: str, ttl: str, source: str = "source_id") -> DataFrame:
    """(keys..., source) sightings, each once within the time to live, after which its state is dropped."""
    return stream_keep_first(df, [*keys, source], ts, ttl).select(*keys, source)


def confidence_of(sightings: DataFrame, keys, source: str = "source_id", settings: Settings = DEFAULTS) -> DataFrame:
    """Sources and label per indicator; sources are a bounded registry, and the label only rises as they come."""
    sources = sightings.groupBy(*keys).agg(F.sort_array(F.collect_set(source)).alias("sources"))
    return sources.withColumn("confidence", confidence_label(F.col("sources"), settings.high_provenance))


def stream_confidence(df: DataFrame, keys, ts: str, ttl: str, source: str = "source_id") -> DataFrame:
    """What a confidence table is fed with: append it, and read labels with :func:`confidence_of`.

    The stream remembers a sighting for the time to live only; the table keeps
    it, so labels never fall.  :func:`compact` keeps the table at one row per
    indicator and source.
    """
    return stream_sources(df, keys, ts, ttl, source)


def stream_new(df: DataFrame, known: DataFrame, on, keys, ts: str, ttl: str) -> DataFrame:
    """Rows that the known table does not have (by ``on``), each key once within the time to live.

    ``known`` is the table as it is when the stream starts.  Where the stream's
    own target is what must not be repeated, write with :func:`append_new_to`.
    """
    seen = known.select(*on).distinct().withColumn("_known", F.lit(True))
    fresh = df.join(seen, list(on), "left").filter("_known is null").drop("_known")
    return stream_keep_first(fresh, keys, ts, ttl)


def _run(writer, checkpoint: str) -> int:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def append_to(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> int:
    """Run the stream over everything that has landed, then stop; the number of rows read."""
    return _run(df.writeStream.format(fmt).outputMode(mode).option("path", path), checkpoint)


def upsert_to(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Write every batch's rows under its batch id; the number of rows read.

    A repeated batch overwrites its own folder, so a restart leaves no doubles.
    Read the current state with :func:`current`, and fold the batches from time
    to time with :func:`compact`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")

    return _run(df.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def append_new_to(on, keys, first=()) -> Callable[[DataFrame, str, str], int]:
    """A writer for :func:`refresh_job`: rows whose ``on`` the target does not have yet, each of ``keys`` once.

    Every batch is compared with the target as it is by then, so a key that
    comes again after any time is not appended a second time.  Of a batch's rows
    of one key the first by ``first`` stays.  The batch, not the target, is what
    a join hands round: the target's keys are cut to those of the batch first.  A
    repeated batch is compared with the target without its own folder, and
    overwrites it; streams with checkpoints of their own may feed one target in
    turn.
    """

    def append(df: DataFrame, path: str, checkpoint: str) -> int:
        stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

        def write(batch: DataFrame, batch_id: int) -> None:
            rows = keep_first(batch, list(keys), list(first) or list(keys))
            own = f"batch={stream}-{batch_id}"
            have = [p for p in _matching(batch.sparkSession, path, "batch=*") if not p.endswith(own)]
            if have:
                target = batch.sparkSession.read.parquet(*have)
                # values of the batch that the target has; null-safe, as a key may be blank
                match = lambda x, y: reduce(and_, [x[k].eqNullSafe(y[k]) for k in on])
                asked = rows.select(*on).distinct()
                known = asked.join(target.select(*on), match(asked, target), "left_semi")
                rows = rows.join(known, match(rows, known), "left_anti")
            rows.write.mode("overwrite").parquet(f"{path}/{own}")

        return _run(df.writeStream.outputMode("append").foreachBatch(write), checkpoint)

    return append


def _matching(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """What lies below a path, by a pattern of names; nothing is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in files.globStatus(hadoop.Path(top, pattern)) or ()]


def _folders(spark: SparkSession, path: str, name: str, done: bool = False) -> dict[int, str]:
    """Number to path of the folders ``name=number`` below a path; with ``done``, of those that were written to the end."""
    places = [p.removesuffix("/_SUCCESS") for p in _matching(spark, path, f"{name}=*" + ("/_SUCCESS" if done else ""))]
    return {int(p.rsplit("=", 1)[1]): p for p in places}


def _bucket(keys) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _manifest(spark: SparkSession, path: str) -> tuple[dict[int, int], int]:
    """Which version each bucket of the folded table has, and the last batch in it."""
    newest = max(_folders(spark, f"{path}/manifests", "upto", done=True).items(), default=None)
    if newest is None:
        return {}, -1
    rows = spark.read.schema("bucket int, version long").parquet(newest[1]).collect()  # BUCKETS at most
    return {r.bucket: r.version for r in rows}, newest[0]


def _base(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    parts = [f"{path}/folded/version={v}/bucket={b}" for b, v in versions.items()]
    return spark.read.option("basePath", f"{path}/folded").parquet(*parts) if parts else None


def _rows(spark: SparkSession, path: str, keys, versions: dict[int, int], after: int, upto: int | None = None) -> DataFrame:
    """Newest row per key of the folded buckets and the batches behind ``after``."""
    base = _base(spark, path, versions)
    batches = {b: p for b, p in _folders(spark, f"{path}/changes", "batch_id").items() if b > after and (upto is None or b <= upto)}
    parts = [] if base is None else [base.withColumn("batch_id", F.lit(-1).cast("long")).drop("version", "bucket")]
    if batches:
        fresh = spark.read.option("basePath", f"{path}/changes").parquet(*batches.values())
        parts.append(fresh.withColumn("batch_id", F.col("batch_id").cast("long")))
    return latest_by(reduce(DataFrame.unionByName, parts), list(keys), ["batch_id"]).drop("batch_id")


def current(spark: SparkSession, path: str, keys) -> DataFrame:
    """Newest row per key of an upserted table: the folded buckets and the batches since."""
    versions, upto = _manifest(spark, path)
    return _rows(spark, path, keys, versions, upto)


def compact(spark: SparkSession, path: str, keys) -> int:
    """Fold the batches since the last fold into the buckets their keys fall in; the last batch folded.

    The folded table has one row per key, in buckets by the keys' hash.  Only
    buckets that the new batches touch are written again, under a version of
    their own; a manifest, written last, names the version of every bucket.  A
    fold that dies before that leaves the old manifest and all it names, and is
    done again.  Batch folders up to the fold, and versions no manifest names,
    may be removed.
    """
    versions, upto = _manifest(spark, path)
    last = max(_folders(spark, f"{path}/changes", "batch_id"), default=-1)
    if last <= upto:
        return upto
    touched = _rows(spark, path, keys, {}, upto, last).select(_bucket(keys).alias("b")).distinct()
    touched = {r.b for r in touched.collect()}  # BUCKETS at most
    rows = _rows(spark, path, keys, {b: v for b, v in versions.items() if b in touched}, upto, last)
    rows = rows.withColumn("bucket", _bucket(keys)).repartition("bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/folded/version={last}")
    named = [(b, last if b in touched else versions[b]) for b in sorted({*versions, *touched})]
    manifest = spark.createDataFrame(named, "bucket int, version long").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{path}/manifests/upto={last}")
    return last


def refresh_job(
    stream: DataFrame, target: str, checkpoint: str, write: Callable[[DataFrame, str, str], int] = append_to
) -> int:
    """One scheduled refresh of ``target``: reads what has landed since the checkpoint, returns the rows read."""
    return write(stream, target, checkpoint)
