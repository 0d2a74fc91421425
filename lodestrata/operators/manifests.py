"""Manifests: validation, incremental classification, stale and orphaned artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reasons a decision is reported with.
REASONS = {"no_manifest": "no previous manifest", "no_entry": "prior manifest entry missing entirely", "no_path": "output_path changed", "path": "output_path changed",
           "gone": "prior artifact missing, so safe rewrite", "no_metadata": "prior manifest entry missing metadata, so safe rewrite"}


def duplicates(entries: DataFrame, by: list[str], key: str) -> DataFrame:
    """values of ``key`` that several entries of one manifest share; nulls are no values."""
    return entries.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def classify(current: DataFrame, previous: DataFrame, existing: DataFrame, *, on: list[str], change_keys: list[str], has_manifest: Column, reasons: dict[str, str] | None = None) -> DataFrame:
    """New, changed or unchanged, with the reason, of every current entry.

    ``on`` are the columns that name the manifest; the entry is joined by ``canonical_id`` too, its file in ``existing`` by
    ``output_path``. The first change key with a value on both sides decides; a null current key is skipped. ``previous`` and
    ``existing`` must hold one row a key. Without a manifest (``has_manifest`` false, which is not an empty manifest) all is new.
    """
    why = REASONS | (reasons or {})
    keys = [*on, "canonical_id"]
    prev = previous.select(*keys, F.col("output_path").alias("_path"), *[F.col(k).alias(f"_{k}") for k in change_keys], F.lit(True).alias("_there"))
    files = existing.select(*on, F.col("output_path").alias("_path"), F.lit(True).alias("_file"))
    j = current.join(prev, keys, "left").join(files, [*on, "_path"], "left")
    there, has_file = F.coalesce("_there", F.lit(False)), F.coalesce("_file", F.lit(False))
    path = F.coalesce("output_path", F.lit(""))
    first = F.coalesce(*[F.when(F.col(k).isNotNull() & F.col(f"_{k}").isNotNull(), F.when(F.col(k) == F.col(f"_{k}"), F.lit(f"{k} unchanged")).otherwise(F.lit(f"{k} changed"))) for k in change_keys])
    rules = [(~has_manifest, "new", F.lit(why["no_manifest"])), (~there, "new", F.lit(why["no_entry"])), (path == "", "changed", F.lit(why["no_path"])), (~F.coalesce(F.col("_path") == path, F.lit(False)), "changed", F.lit(why["path"])),
             (~has_file, "changed", F.lit(why["gone"])), (first.endswith("unchanged"), "unchanged", first), (first.isNotNull(), "changed", first)]
    some = F.coalesce(*[F.col(k) for k in change_keys]).isNotNull()
    if "missing_current" in why:
        rules.append((~some, "changed", F.lit(why["missing_current"])))
    if "missing_previous" in why:
        rules.append((some, "changed", F.lit(why["missing_previous"])))
    status, reason = F.lit("changed"), F.lit(why["no_metadata"])
    for test, s, r in reversed(rules):
        status, reason = F.when(test, F.lit(s)).otherwise(status), F.when(test, r).otherwise(reason)
    return j.select(*current.columns, status.alias("status"), reason.alias("reason"))


def status_counts(classified: DataFrame, by: list[str]) -> DataFrame:
    """new, changed, unchanged, and what is written or skipped for it."""
    n = lambda s: F.count_if(F.col("status") == s)
    return classified.groupBy(*by).agg(n("new").alias("n_new"), n("changed").alias("n_changed"), n("unchanged").alias("n_unchanged")).withColumns({"n_write": F.col("n_new") + F.col("n_changed"), "n_skip": F.col("n_unchanged")})


def stale(previous: DataFrame, current: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Prior entries whose output path no current entry has and whose file exists (keyed by path, not by id)."""
    keys = [*on, "output_path"]
    return previous.where(F.col("output_path").isNotNull()).join(current.select(*keys).distinct(), keys, "left_anti").join(existing.select(*keys), keys, "left_semi")


def orphans(listing: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Distinct listed ``.md`` files that neither current nor stale entries refer to."""
    keys = [*on, "output_path"]
    return listing.where(F.col("output_path").endswith(".md")).select(*keys).join(references.select(*keys), keys, "left_anti").distinct()


def collisions(current: DataFrame, previous: DataFrame, on: list[str]) -> DataFrame:
    """Planned paths that another id owned before."""
    p = previous.select(*on, "output_path", F.col("canonical_id").alias("prior_id")).distinct()
    return current.join(p, [*on, "output_path"]).where(F.col("canonical_id") != F.col("prior_id")).select(*on, "output_path", "canonical_id", "prior_id")


def prune_plan(stale_rows: DataFrame, references: DataFrame, on: list[str]) -> DataFrame:
    """Every candidate for deletion with what speaks against it (null: nothing); nothing is deleted here."""
    keys = [*on, "output_path"]
    refs = references.select(*keys, F.lit(True).alias("_ref")).distinct()
    p = F.col("output_path")
    bad = (F.when(p.startswith("/") | p.contains("\\") | p.rlike(r"(^|/)\.\.?(/|\z)"), "outside the output folder").when(~p.endswith(".md"), "not a markdown file").when(F.col("_ref"), "still referenced"))
    return stale_rows.join(refs, keys, "left").select(*stale_rows.columns, bad.alias("violation"))


# What the reports are ordered by.
REPORT_ORDER = {"stale": ["output_path", "canonical_id"], "orphaned": ["output_path"], "inventory": ["path"]}


def in_report_order(rows: DataFrame, kind: str, by: list[str] = ()) -> DataFrame:
    """The rows of a stale, orphaned or inventory report in its order: a range-partitioned sort."""
    return rows.orderBy(*by, *REPORT_ORDER[kind])
