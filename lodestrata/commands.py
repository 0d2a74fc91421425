"""What the commands do: scan, classify against the last manifest, write what changed; bundle; run a configuration."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import byte_length, sha256
from lodestrata.operators import bundles as B
from lodestrata.operators import manifests as M
from lodestrata.operators import records as R
from lodestrata.operators import runs as U
from lodestrata.session import cut, rows
from lodestrata.sources import config, files, git
from lodestrata.sources import manifests as stored

MANIFEST = "manifest.json"
KEPT = ["canonical_id", "source_url", "output_path", "title", "content_hash", "path", "ref"]


def sync(spark: SparkSession, records: DataFrame, out: str, *, at: str, dry_run: bool = False) -> tuple[DataFrame, int, int]:
    """One incremental run: (status of every record, how many were written, how many skipped).

    ``records``: canonical_id, source_url, output_path, title, markdown, path, ref. New and changed ones are written below ``out``, a
    folder all executors share, then the manifest is replaced. Records whose path another one has are an error. With ``dry_run`` nothing is written.
    """
    now = cut(records.withColumn("content_hash", sha256("markdown")))
    if now.groupBy("output_path").count().where("count > 1").limit(1).count():
        raise ValueError("two records have the same output path")
    prior = stored.read_manifests(spark, [os.path.join(out, MANIFEST)])
    known = prior is not None
    old = (prior.where("part = 'files'") if known else now.where("false")).select("canonical_id", "output_path", "content_hash")
    there = files.present(old, out)
    every = F.lit(0).alias("one")
    status = M.classify(now.select(every, *KEPT), old.select(every, "*"), there.select(every, "output_path"), on=["one"], change_keys=["content_hash"], has_manifest=F.lit(known)).select("canonical_id", "output_path", "status", "reason")
    status = cut(status, counted=F.col("status") != "unchanged")
    wrote, total = rows(status), rows(now)
    if not dry_run:
        files.write_files(now.join(status.where("status <> 'unchanged'").select("canonical_id"), "canonical_id", "left_semi"), out)
        stored.write_manifest(os.path.join(out, MANIFEST), now.select(*KEPT), generated_at=at)
    return status, wrote, total - wrote


def local_records(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """The files below a path as records; unreadable ones are left out."""
    f = files.scan_files(spark, path, pattern=pattern).where("skip_reason IS NULL")
    md = R.record_markdown(title="title", canonical_id="canonical_id", source_url="source_url", content="content", source=F.lit("local_files"), adapter=F.lit("local_files"))
    name = F.concat(F.regexp_replace("title", r"(?<=.)\.[^.]+$", ""), F.lit("-"), F.substring(sha256("canonical_id"), 1, 12), F.lit(".md"))
    return f.select("canonical_id", "source_url", name.alias("output_path"), "title", md.alias("markdown"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("ref"))


def git_records(spark: SparkSession, repo: str, *, ref: str | None = None, include: list[str] = (), exclude: list[str] = (), subdir: str = "", cache: str | None = None) -> DataFrame:
    """A repository's text files at a reference as records."""
    from lodestrata.functions.text import path_regex

    git.register(spark)
    r = spark.read.format("lodestrata_git").option("repo", repo).option("subdir", subdir)
    for k, v in (("ref", ref), ("cache", cache)):
        r = r.option(k, v) if v else r
    g = r.load().where("skip_reason IS NULL")
    for patterns, keep in ((include, True), (exclude, False)):
        if patterns:
            hit = F.lit(False)
            for p in patterns:
                hit = hit | F.col("repo_path").rlike(path_regex(p))
            g = g.where(hit if keep else ~hit)
    md = R.record_markdown(title="repo_path", canonical_id="canonical_id", source_url="repo", content="content", source=F.lit("git_repo"), adapter=F.lit("git_repo"))
    return g.select("canonical_id", F.col("repo").alias("source_url"), R.tree_output_path("repo_path").alias("output_path"), F.col("repo_path").alias("title"), md.alias("markdown"), F.col("repo_path").alias("path"), F.col("commit_sha").alias("ref"))


def bundle(spark: SparkSession, inputs: list[str], output: str, *, max_bytes: int | None = None, order: str = "canonical_id", dry_run: bool = False) -> tuple[DataFrame, int, int]:
    """The artifacts of several run folders as one or more markdown files; (files, sections, repeats left out)."""
    inputs = list(dict.fromkeys(map(os.path.abspath, inputs)))
    found = stored.read_manifests(spark, [os.path.join(i, MANIFEST) for i in inputs])
    if found is None:
        raise ValueError("no input folder has a manifest")
    places = spark.createDataFrame([(i, n) for n, i in enumerate(inputs)], "folder string, input_index int")
    folder = F.regexp_replace(F.regexp_replace("manifest", "^file:/+", "/"), f"/{MANIFEST}$", "")
    e = found.where("part = 'files'").select(folder.alias("folder"), F.lit(output).alias("bundle"), "entry_index", *[c for c in ("canonical_id", "output_path", "source_url", "title", "path", "ref", "fetched_at")]).join(F.broadcast(places), "folder")
    first = cut(B.first_wins(e, ["bundle"]))
    text = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(inputs).select(F.regexp_replace("path", "^file:/+", "/").alias("_at"), F.col("content").cast("string").alias("content"))
    j = first.join(text, F.concat_ws("/", "folder", "output_path") == F.col("_at"), "left")
    md = B.section(title="title", canonical_id="canonical_id", source_url="source_url", content="content", is_stale=F.lit(False), fetched_at="fetched_at", path="path", ref="ref")
    s = cut(B.ordered(j.select("bundle", "canonical_id", "input_index", "entry_index", md.alias("md")), ["bundle"], order))
    sized = s.select("bundle", "position", byte_length("md").alias("n_bytes"))
    placed = B.split(sized, "bundle", max_bytes=max_bytes).select("position", "file_no") if max_bytes else sized.select("position", F.lit(1).cast("bigint").alias("file_no"))
    whole = s.join(placed, "position").groupBy("file_no").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "md"))), lambda x: x["md"]), B.SEPARATOR), F.lit("\n")).alias("markdown"))
    total = placed.agg(F.max("file_no")).first()[0] or 0
    stem, dot, suffix = os.path.basename(output).rpartition(".")
    name = F.lit(os.path.basename(output)) if total <= 1 else F.concat(F.lit(stem or suffix), F.format_string("-%03d", "file_no"), F.lit(dot + suffix if stem else ""))
    out = cut(whole.select(name.alias("output_path"), "markdown"))
    if not dry_run:
        files.write_files(out, os.path.dirname(os.path.abspath(output)))
    return out.select("output_path", byte_length("markdown").alias("n_bytes")), rows(s), e.count() - rows(first)


def planned(run: config.Run, *, at: str, dry_run: bool):
    """The work of one configured run as a function of the session that says what it wrote and skipped."""
    o = run.options

    def work(spark: SparkSession) -> tuple[int, int]:
        if run.type == "local_files":
            records = local_records(spark, o["file_path"])
        elif run.type == "git_repo":
            several = lambda k: [x for x in o.get(k, "").split(",") if x]
            records = git_records(spark, o["repo_url"], ref=o.get("ref"), include=several("include"), exclude=several("exclude"), subdir=o.get("subdir", ""))
        elif run.type == "bundle":
            _, n, repeats = bundle(spark, o["inputs"].split(","), o["output_path"], dry_run=dry_run)
            return n, repeats
        else:
            raise ValueError(f"{run.type} runs need a client; read them with the data sources of lodestrata.sources.http")
        _, wrote, skipped = sync(spark, records, o["output_dir"], at=at, dry_run=dry_run or run.dry_run)
        return wrote, skipped

    return run.name, run.type, work


def run_config(spark: SparkSession, path: str, *, at: str, only: list[str] | None = None, dry_run: bool = False, continue_on_error: bool = False) -> DataFrame:
    """The enabled (or named) runs of a configuration in its order; the records of the report."""
    runs, _ = config.load(path)
    chosen = {r["name"] for r in U.selected_runs(config.frame(spark, runs), only).select("name").collect()}  # bounded by the configuration
    return U.run_all(spark, [planned(r, at=at, dry_run=dry_run) for r in runs if r.name in chosen], dry_run=dry_run, continue_on_error=continue_on_error)
