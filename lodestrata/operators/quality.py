"""Replay quality of captured sources: classification and acceptance and bounded previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import col


def total(counts: str | Column) -> Column:
    """The sum of a map of counts; negative and null ones are 0."""
    return F.aggregate(F.map_values(col(counts)), F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)))


def classification(units: str | Column, cleanup: str | Column, remaining: str | Column, blockers: str | Column, mismatch: Column | None = None) -> Column:
    """a struct of state, promotion, effort, economics and reason from retained units and two maps of counts."""
    mismatch = F.lit(False) if mismatch is None else mismatch
    u = F.greatest(F.coalesce(col(units), F.lit(0)), F.lit(0)).cast("bigint")
    left, kept = total(remaining), u > 0
    limit = F.greatest(F.lit(5).cast("bigint"), F.floor(u / 20))
    stop = F.array_distinct(F.concat(F.coalesce(col(blockers), F.array().cast("array<string>")), F.when(kept, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_retained_content"))),
                                     F.when(kept & mismatch, F.array(F.lit("likely_wrong_capture_target"))).otherwise(F.array().cast("array<string>"))))
    return F.struct(
        F.when(kept & mismatch, "likely-wrong-capture-target").when(kept, "review-ready").otherwise("diagnostic-only").alias("state"), F.when(F.size(stop) > 0, "unsafe-to-promote").otherwise("promotion-capable").alias("promotion"),
        F.when(kept & mismatch, "source_target_review").when(~kept, "not_useful").when(left == 0, "bounded").when(left <= limit, "focused").otherwise("extended").alias("effort"), (kept & (left <= limit)).alias("bounded"),
        F.when(~kept, "no_retained_content").when(left > 0, "retained_content_with_reported_remaining_artifacts").otherwise("retained_content_with_no_reported_artifacts").alias("reason"),
        total(cleanup).alias("cleanup"), left.alias("remaining"), stop.alias("blockers"))


def acceptance(specs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each (source_key, label, path, minimum, maximum) against (source_key, path, value); a missing value is 0."""
    j = specs.join(metrics, ["source_key", "path"], "left")
    v = F.coalesce("value", F.lit(0).cast("bigint"))
    return j.select("source_key", "label", "path", v.alias("value"), "minimum", "maximum", v.between(F.col("minimum"), F.col("maximum")).alias("ok"))


def acceptance_report(results: DataFrame) -> DataFrame:
    """F16: stable if nothing failed; the failed labels in order."""
    return results.groupBy("source_key").agg(F.bool_and("ok").alias("stable"), F.count_if(~F.col("ok")).alias("n_failed"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("label")))), ",").alias("failed"))


def first_examples(rows: DataFrame, by: list[str], order: list[str], fields: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group in encounter order, as one array, and how many there are.

    The rank is taken with a limit that Spark applies before the shuffle, so a group of any size sends ``k`` rows a task.
    """
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    top = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k)
    got = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_rank", *fields))).alias("_e")).select(*by, F.transform("_e", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("examples"))
    return n.join(got, by)
