"""JSON manifests as tables: strict reads, replacing writes, versioned state."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.manifests import duplicates

TEXTS = ["source_url", "title", "fetched_at", "path", "ref", "content_hash", "page_version", "last_modified"]


def _typed(v: Column, key: str, kind: str) -> Column:
    """A value of a JSON object only if it has the type asked for (a boolean is no text, a number no boolean)."""
    x = F.try_variant_get(v, f"$.{key}", "variant")
    name = F.schema_of_variant(x)
    if kind == "boolean":
        return F.when(name == "BOOLEAN", F.try_variant_get(v, f"$.{key}", "boolean"))
    text = F.when(name == "STRING", F.try_variant_get(v, f"$.{key}", "string"))
    return text if kind == "strict" else F.nullif(F.coalesce(text, F.when(name == "BIGINT", F.try_variant_get(v, f"$.{key}", "string"))), F.lit(""))


def read_manifests(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """``manifest, part (files | stale_artifacts), entry_index, canonical_id, output_path, ..., stale``; None if no path exists.

    No manifest at all is not an empty one. A manifest without a list of files, an entry that is no object or lacks a text id or
    path, and ids or paths that repeat, raise. Integers become texts, booleans and other types null, '' null.
    """
    there = [p for p in paths if os.path.exists(p)]
    if not there:
        return None
    raw = spark.read.text(there, wholetext=True).select(F.input_file_name().alias("manifest"), F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.files", "variant"))
    bad = raw.where(F.col("v").isNull() | ~F.coalesce(kind.startswith("ARRAY"), F.lit(False))).limit(1).count()
    if bad:
        raise RuntimeError("a manifest is no JSON object with a list of files")
    parts = [raw.select("manifest", F.lit(p).alias("part"), F.try_variant_get("v", f"$.{p}", "array<variant>").alias("a")) for p in ("files", "stale_artifacts")]
    e = parts[0].unionByName(parts[1]).select("manifest", "part", F.posexplode("a").alias("entry_index", "x"))
    out = e.select("manifest", "part", "entry_index", _typed(F.col("x"), "canonical_id", "strict").alias("canonical_id"), _typed(F.col("x"), "output_path", "strict").alias("output_path"), *[_typed(F.col("x"), k, "text").alias(k) for k in TEXTS], F.coalesce(_typed(F.col("x"), "stale", "boolean"), F.lit(False)).alias("stale"))
    files = out.where("part = 'files'")
    if files.where("canonical_id IS NULL OR output_path IS NULL").limit(1).count():
        raise RuntimeError("a manifest entry lacks a text canonical_id or output_path")
    for key in ("canonical_id", "output_path"):
        twice = duplicates(files, ["manifest"], key).limit(1).collect()
        if twice:
            raise RuntimeError(f"duplicate {key} {twice[0][key]!r} in a manifest")
    return out


def write_manifest(path: str, entries: DataFrame, *, generated_at: str, root_page_id: str | None = None, max_depth: int | None = None, stale: DataFrame | None = None) -> str:
    """One run's manifest as a JSON file, replaced whole; absent values are left out.

    Rows stream through the driver in order of path and into the file one by one; for manifests beyond a file's size keep the table (``commit_state``).
    """
    head = {"generated_at": generated_at} | ({"root_page_id": root_page_id} if root_page_id else {}) | ({"max_depth": max_depth} if max_depth is not None else {})
    text = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text(head).removesuffix("\n}"))
        for name, part in (("files", entries), ("stale_artifacts", stale)):
            n = 0
            for r in () if part is None else part.orderBy("output_path", "canonical_id").toLocalIterator():
                f.write((",\n    " if n else f',\n  "{name}": [\n    ') + text({k: v for k, v in r.asDict().items() if v is not None and v != ""}).replace("\n", "\n    "))
                n += 1
            if n or name == "files":
                f.write("\n  ]" if n else ',\n  "files": []')
        f.write("\n}\n")
    os.replace(f"{path}.tmp", path)
    return path


def commit_state(entries: DataFrame, root: str, run_id: str) -> None:
    """A run's manifest as one partition of a state table; a failed run leaves the last one in place."""
    entries.drop("run_id").write.mode("overwrite").parquet(f"{root.rstrip('/')}/run_id={run_id}")


def current_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The entries of the greatest run id; None if no run was committed."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        return None
    runs = spark.read.parquet(root)
    last = runs.agg(F.max(F.col("run_id").cast("string")).alias("r")).first()["r"]
    return None if last is None else runs.where(F.col("run_id").cast("string") == last)
