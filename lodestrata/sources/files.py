"""File scans and file sinks."""

from __future__ import annotations

import os
from urllib.parse import unquote
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """One row a file: ``canonical_id (absolute path), title, source_url, content, skip_reason``; nothing is decoded leniently.

    A missing path raises. Files with NUL bytes or invalid UTF-8 have a skip reason and null content; an empty file is valid.
    """
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    f = r.load(path).select("path", "length", "content")
    # The scan leaves files of no bytes out; the index that Spark made of the folder has them.
    listed = spark.createDataFrame([(unquote(x),) for x in f.inputFiles()], "path string")
    empty = listed.join(f.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path")), "path", "left_anti")
    f = f.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content")))
    p = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^dbfs:", "")
    return f.select(p.alias("canonical_id"), F.element_at(F.split(p, "/"), -1).alias("title"), F.concat(F.lit("file://"), p).alias("source_url"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), *text_or_reason("content"))


def text_or_reason(data: str):
    """(content, skip_reason) of bytes: NUL bytes first, then invalid UTF-8."""
    text = F.col(data).cast("string")
    nul = F.when(F.instr(text, "\u0000") > 0, "binary file").when(~F.call_function("is_valid_utf8", text), "binary or non-UTF-8 file")
    return F.when(nul.isNull(), text).alias("content"), nul.alias("skip_reason")


def write_files(rows: DataFrame, root: str, *, path: str = "output_path", content: str = "markdown", dry_run: bool = False) -> DataFrame:
    """One file a row below ``root``, a folder all executors share; returns the paths.

    Each file is written beside its place and renamed, so a task that runs twice leaves the same file. Unsafe paths raise.
    With ``dry_run`` nothing is written.
    """
    def put(part: Iterator) -> Iterator[None]:
        for r in part:
            p = r[path]
            if not p or p.startswith("/") or "\\" in p or any(s in ("", ".", "..") for s in p.split("/")):
                raise ValueError(f"unsafe output path: {p!r}")
            at = os.path.join(root, p)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            tmp = f"{at}.{os.getpid()}.tmp"
            with open(tmp, "w", encoding="utf-8", newline="") as f:
                f.write(r[content] or "")
            os.replace(tmp, at)

    if not dry_run:
        rows.select(path, content).foreachPartition(put)
    return rows.select(F.concat(F.lit(root.rstrip("/") + "/"), path).alias("path"))


def present(paths: DataFrame, root: str, *, path: str = "output_path") -> DataFrame:
    """The distinct paths that are files below ``root``, a folder all executors share; each is looked for where its row lies."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([p for p in b.column(0).to_pylist() if os.path.isfile(os.path.join(root, p))], pa.string())], [path])

    return paths.select(path).where(F.col(path).isNotNull()).distinct().mapInArrow(look, f"{path} string")


def numbered_name(output: str, index: int, total: int) -> str:
    """``stem-001.suffix`` ..., or the name itself for a single file."""
    stem, dot, suffix = output.rpartition(".")
    return output if total == 1 else f"{stem or suffix}-{index:03d}{dot + suffix if stem else ''}"


def delete_files(plan: DataFrame, root: str, *, path: str = "output_path") -> int:
    """Deletes the planned files if not one row of the plan has a violation; else raises with all of them first.

    The plan is checked on the cluster, and the files, in a folder all executors share, are deleted there; one that is gone already is none.
    """
    bad = plan.where("violation IS NOT NULL").select(path, "violation").orderBy(path).limit(1000).collect()
    if bad:
        raise ValueError("; ".join(f"{r[path]}: {r['violation']}" for r in bad))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top = 0, os.path.realpath(root)
        for b in batches:
            for p in b.column(0).to_pylist():
                at = os.path.realpath(os.path.join(top, p))
                if not at.startswith(top + os.sep):
                    raise ValueError(f"{p}: outside the output folder")
                if os.path.isfile(at):
                    os.remove(at)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return plan.select(path).distinct().mapInArrow(drop, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
