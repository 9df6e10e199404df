"""Streaming variants, run to completion over everything that has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import feeds as st
from . import common as k
from .registry import query

c = F.col


def landed(t):
    """The events table as a file stream; a glob also matches a folder of files."""
    schema = t.events.schema
    stream = st.read_landed(t.spark, f"{t.sf_dir}/events.parquet*", schema, ts="ts", max_files=1000)
    return stream.withColumn("source_id", F.when(c("event_type") == "click", "mitre_attack").otherwise(c("event_type")))


def refreshed(t, stream, label, write=st.append_to):
    """A refresh into a target of this call's own; returns its path."""
    base = scratch_path(t.spark, label)
    st.refresh_job(stream, f"{base}/data", f"{base}/checkpoint", write)
    return f"{base}/data"


@query(
    "stream_keep_first",
    "SELECT DISTINCT user_id, event_type FROM events",
)
def _(t):
    kept = st.stream_keep_first(landed(t), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type")
    return t.spark.read.parquet(refreshed(t, kept, "keep-first"))


@query(
    "refresh_job",
    "SELECT event_id, user_id, event_type, value FROM events",
)
def _(t):
    rows = landed(t).select("event_id", "user_id", "event_type", "value")
    return t.spark.read.parquet(refreshed(t, rows, "refresh"))


@query(
    "stream_confidence",
    """SELECT user_id, value_key, array_to_string(list(DISTINCT s ORDER BY s), '|') AS sources, CASE WHEN count(DISTINCT s) >= 2 THEN 'HIGH' WHEN min(s) = 'mitre_attack' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (
         SELECT user_id, event_id % 40 AS value_key, CASE WHEN event_type = 'click' THEN 'mitre_attack' ELSE event_type END AS s FROM events) x GROUP BY ALL""",
)
def _(t):
    rows = landed(t).withColumn("value_key", c("event_id") % 40)
    keys = ["user_id", "value_key"]
    path = refreshed(t, st.stream_confidence(rows, keys, "ts", "40 days"), "confidence", st.upsert_to)
    st.compact(t.spark, path, [*keys, "source_id"])
    sightings = st.current(t.spark, path, [*keys, "source_id"])
    return st.confidence_of(sightings, keys).withColumn("sources", k.joined("sources"))


@query(
    "stream_new_iocs",
    "SELECT DISTINCT user_id, event_type FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)",
)
def _(t):
    known = t.supplier.filter("s_suppkey % 2 = 0").select(c("s_suppkey").alias("user_id"))
    new = st.stream_new(landed(t), known, ["user_id"], ["user_id", "event_type"], "ts", "40 days")
    return t.spark.read.parquet(refreshed(t, new.select("user_id", "event_type"), "new-iocs"))


@query(
    "stream_append_new",
    "SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at FROM events GROUP BY user_id, event_type",
)
def _(t):
    """Each indicator once, however often and late it comes again: two refreshes of one target."""
    rows = landed(t).select("user_id", "event_type", "ts")
    base = scratch_path(t.spark, "append-new")
    write = st.append_new_to(["user_id", "event_type"], ["user_id", "event_type"], first=["ts"])
    for run in (1, 2):  # the second reads everything again, as a new checkpoint starts from the beginning
        st.refresh_job(rows, f"{base}/data", f"{base}/checkpoint-{run}", write)
    out = t.spark.read.parquet(f"{base}/data")
    return out.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


@query(
    "stream_readmit",
    """WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events),
       kept(user_id, ts) AS (SELECT user_id, min(ts) FROM t GROUP BY user_id
         UNION ALL SELECT kept.user_id, (SELECT min(n.ts) FROM t n WHERE n.user_id = kept.user_id AND n.ts > kept.ts + INTERVAL 5 DAY) FROM kept WHERE kept.ts IS NOT NULL)
       SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM kept WHERE ts IS NOT NULL""",
)
def _(t):
    kept = st.stream_readmit(landed(t), "user_id", "ts", 5 * 86400, delay="40 days")
    path = refreshed(t, kept, "readmit")
    return t.spark.read.parquet(path).select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))

