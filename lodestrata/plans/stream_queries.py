"""Registered queries that run as a stream to the end of their input and give the sink's table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.bundle_queries import entries
from lodestrata.session import app_dir, cut, table
from lodestrata.streaming import incremental as S


def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    """All delivered rows as a stream against the last state of each bundle: distinct (bundle, id, status)."""
    rows = table(spark, d, "bundle_artifact")
    at = f"{app_dir(spark)}/stream-{uuid.uuid4().hex}"
    state = entries(spark, d).groupBy("bundle_name", "canonical_id").agg(F.max_by("content_hash", "snapshot_no").alias("content_hash"))
    key = F.to_json(F.struct("bundle_name", "canonical_id"))
    stream = S.file_stream(spark, f"{d}/bundle_artifact.parquet", rows.schema).withColumns({"real_id": F.col("canonical_id"), "canonical_id": key})
    q = S.drain(S.classify_stream(stream, state.withColumn("canonical_id", key)).select("bundle_name", "real_id", "status"), f"{at}/out", f"{at}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("bundle_name", F.col("real_id").alias("canonical_id"), "status").distinct()


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour and type."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.windowed_counts(e, by=["event_type"]).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


def windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events an hour and type as a stream of two files, the later half first: windows that the watermark has closed are not reopened.

    A window of the first file's hours is written once the watermark, two hours behind the latest event, has passed it; events of the second
    file, all earlier, come too late.
    """
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
    ends = e.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
    mid = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    at = f"{app_dir(spark)}/events-{uuid.uuid4().hex}"
    halves = cut(e.select("ts", "event_type", (F.unix_micros("ts") < mid).alias("early")))
    halves.where("NOT early").select("ts", "event_type").coalesce(1).write.mode("append").parquet(f"{at}/in")
    run = lambda: S.drain(S.windowed_counts(S.file_stream(spark, f"{at}/in", halves.select("ts", "event_type").schema, files_per_batch=1), by=["event_type"]), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    run()
    halves.where("early").select("ts", "event_type").coalesce(1).write.mode("append").parquet(f"{at}/in")
    run()
    return spark.read.parquet(f"{at}/out").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


QUERIES = {"stream_incremental": stream_incremental, "windowed_events": windowed_events, "windowed_stream": windowed_stream}
SQL = {
    "stream_incremental": """WITH e AS (SELECT bundle_name, snapshot_no, canonical_id, content_hash FROM bundle_artifact WHERE bundle_name IS NOT NULL AND snapshot_no IS NOT NULL AND canonical_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bundle_name, snapshot_no, canonical_id ORDER BY coalesce(loaded_at, TIMESTAMPTZ '1900-01-01 00:00:00+00') DESC, coalesce(content_hash, '') DESC) = 1),
 s AS (SELECT bundle_name, canonical_id, content_hash FROM e QUALIFY row_number() OVER (PARTITION BY bundle_name, canonical_id ORDER BY snapshot_no DESC) = 1), k AS (SELECT DISTINCT bundle_name, canonical_id FROM e)
 SELECT DISTINCT r.bundle_name, r.canonical_id, CASE WHEN k.canonical_id IS NULL THEN 'new' WHEN r.content_hash = s.content_hash THEN 'unchanged' ELSE 'changed' END AS status FROM bundle_artifact r LEFT JOIN k USING (bundle_name, canonical_id) LEFT JOIN s USING (bundle_name, canonical_id)""",
    "windowed_stream": """WITH e AS (SELECT ts, event_type FROM events WHERE ts IS NOT NULL), m AS (SELECT make_timestamp(((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)::BIGINT) AS mid, max(ts) AS top FROM e)
 SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM e, m WHERE ts >= mid AND time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= top - INTERVAL 2 HOUR GROUP BY ALL""",
    "windowed_events": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
