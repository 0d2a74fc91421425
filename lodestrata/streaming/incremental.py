"""Streaming variants: records that arrive as files are classified as they come; windowed request counts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def file_stream(spark: SparkSession, path: str, schema, *, files_per_batch: int = 100) -> DataFrame:
    """New parquet files below ``path`` as a stream; ``files_per_batch`` bounds a batch as a batch size bounds a resumed run."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    plain = path.removeprefix("file://")
    if os.path.isfile(plain):  # a stream's path is a folder
        return r.option("pathGlobFilter", os.path.basename(plain)).parquet(os.path.dirname(plain))
    return r.parquet(path)


def classify_stream(records: DataFrame, state: DataFrame, *, change_key: str = "content_hash") -> DataFrame:
    """New, changed or unchanged against a fixed previous state (``canonical_id`` and the key, one row an id): a stream-static join."""
    prev = state.select(F.col("canonical_id").alias("_id"), F.col(change_key).alias("_k"), F.lit(True).alias("_there"))
    j = records.join(prev, F.col("canonical_id") == F.col("_id"), "left")
    status = F.when(F.col("_there").isNull(), "new").when(F.col(change_key).isNotNull() & F.col("_k").isNotNull() & (F.col(change_key) == F.col("_k")), "unchanged").otherwise("changed")
    return j.withColumn("status", status).drop("_id", "_k", "_there")


def drain(stream: DataFrame, sink: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, exactly once, to a parquet table; a restart goes on where the last run stopped."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, ts: str | Column = "ts", by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts a window, with a watermark for late rows; works on a stream and on a table alike."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def thresholds(before: int, after: int, every: int = 500) -> list[int]:
    """The multiples of ``every`` that a count has reached or passed on its way."""
    return list(range((before // every + 1) * every, after + 1, every))


class Progress(StreamingQueryListener):
    """Tells ``report`` each multiple of ``every`` input rows that a stream has read; add it with ``spark.streams.addListener``."""

    def __init__(self, report: Callable[[int], None], every: int = 500):
        self.report, self.every, self.seen = report, every, 0

    def onQueryStarted(self, event) -> None:
        self.seen = 0

    def onQueryProgress(self, event) -> None:
        before, self.seen = self.seen, self.seen + event.progress.numInputRows
        for n in thresholds(before, self.seen, self.every):
            self.report(n)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
