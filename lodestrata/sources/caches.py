"""Payload and listing caches as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import sha256


def _host(base_url: str):
    return sha256(F.regexp_replace(F.lit(base_url), "/+\\z", ""))


def store(pages: DataFrame, root: str, base_url: str, *, at: str) -> None:
    """Appends payloads of one base URL; later rows win on reading, so storing twice does no harm.

    ``pages``: (canonical_id, page_version, last_modified, payload); ``at`` says which write is later.
    """
    pages.select("canonical_id", "page_version", "last_modified", "payload", F.lit(at).alias("stored_at"), _host(base_url).alias("base")).write.partitionBy("base").mode("append").parquet(root)


def load(spark: SparkSession, root: str, base_url: str) -> DataFrame:
    """The latest payload of each page of one base URL (one partition is read). A missing or unreadable cache is empty."""
    schema = "canonical_id string, page_version string, last_modified string, payload string, stored_at string, base string"
    try:
        df = spark.read.schema(schema).parquet(root)
    except Exception:  # a cache never fails a run
        df = spark.createDataFrame([], schema)
    latest = df.where(F.col("base") == _host(base_url)).groupBy("canonical_id").agg(F.max_by(F.struct("page_version", "last_modified", "payload"), F.struct("stored_at", "page_version", "payload")).alias("m"))
    return latest.select("canonical_id", "m.*")


def store_listing(listings: DataFrame, root: str, base_url: str, *, at: str) -> None:
    """Appends listings of one base URL: (kind, key, ids) with kind ``child`` or ``space``; later rows win on reading."""
    listings.select("kind", "key", "ids", F.lit(at).alias("stored_at"), _host(base_url).alias("base")).write.partitionBy("base").mode("append").parquet(root)


def load_listing(spark: SparkSession, root: str, base_url: str) -> DataFrame:
    """The latest listing of each (kind, key) of one base URL; entries with a null or blank id, or of another kind, are misses."""
    schema = "kind string, key string, ids array<string>, stored_at string, base string"
    try:
        df = spark.read.schema(schema).parquet(root)
    except Exception:  # a cache never fails a run
        df = spark.createDataFrame([], schema)
    sound = F.col("kind").isin("child", "space") & F.col("key").isNotNull() & F.col("ids").isNotNull() & ~F.exists("ids", lambda i: i.isNull() | (F.trim(i) == ""))
    return df.where((F.col("base") == _host(base_url)) & sound).groupBy("kind", "key").agg(F.max_by("ids", F.struct("stored_at", "ids")).alias("ids"))


def clear(spark: SparkSession, root: str, base_url: str) -> bool:
    """Drops one base URL's partition only; says whether there was one."""
    import hashlib

    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/base={hashlib.sha256(base_url.rstrip('/').encode()).hexdigest()}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
