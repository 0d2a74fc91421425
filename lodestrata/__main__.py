"""``python -m lodestrata``: registered queries, scans, bundles, configured runs with their report, package verification."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import json
import sys

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrata", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    add("list", "names of the registered queries")
    for verb, text in (("query", "run a registered query"), ("explain", "its plan")):
        q = add(verb, text)
        q.add_argument("name")
        q.add_argument("tables", help="folder with the parquet tables")
        if verb == "query":
            q.add_argument("--out", help="folder for the result; without it the first rows are shown (a dry run writes nothing)")
    v = add("verify", "check a sealed package")
    v.add_argument("package")
    v.add_argument("--supports", action="append", default=[])
    f = add("local_files", "files below a path as records")
    f.add_argument("path")
    f.add_argument("--pattern")
    g = add("git_repo", "a repository's text files as records")
    g.add_argument("repo")
    g.add_argument("--ref")
    g.add_argument("--subdir", default="")
    g.add_argument("--cache", help="folder all executors share, for clones of remote repositories")
    for k in ("include", "exclude"):
        g.add_argument(f"--{k}", action="append", default=[])
    b = add("bundle", "the artifacts of run folders as one or more files")
    b.add_argument("inputs", nargs="+")
    b.add_argument("--output", required=True)
    b.add_argument("--max-bytes", type=int)
    b.add_argument("--order", choices=["canonical_id", "manifest", "input"], default="canonical_id")
    r = add("run", "the runs of a configuration file, one after the other")
    r.add_argument("config")
    r.add_argument("--only", action="append")
    r.add_argument("--continue-on-error", action="store_true")
    r.add_argument("--report", help="file for the markdown report")
    for x in (f, g):
        x.add_argument("--out", required=True)
    for x in (f, g, b, r):
        x.add_argument("--dry-run", action="store_true", help="say what would be done and write nothing")
    add("identity", "versions and place of this installation")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.verb == "list":
        print("\n".join(sorted(importlib.import_module("__spark_entry__").queries())))
        return 0
    from lodestrata import commands as C
    from lodestrata.session import runtime_identity, ship
    from lodestrata.sources.packages import verify

    if a.verb == "verify":
        result = verify(None, a.package, tuple(a.supports))
        print(json.dumps(result, indent=2))
        return 0 if result["state"] == "verified" else 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    at = dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
    if a.verb in ("query", "explain"):
        df = importlib.import_module("__spark_entry__").queries()[a.name](spark, a.tables)
        if a.verb == "explain":
            df.explain("formatted")
        elif a.out:
            df.write.mode("errorifexists").parquet(a.out)
        else:
            df.show(20, truncate=60)
    elif a.verb in ("local_files", "git_repo"):
        records = C.local_records(spark, a.path, pattern=a.pattern) if a.verb == "local_files" else C.git_records(spark, a.repo, ref=a.ref, include=a.include, exclude=a.exclude, subdir=a.subdir, cache=a.cache)
        status, wrote, skipped = C.sync(spark, records, a.out, at=at, dry_run=a.dry_run)
        status.orderBy("output_path").show(20, truncate=60)
        print(f"{'would write' if a.dry_run else 'wrote'} {wrote}, {'would skip' if a.dry_run else 'skipped'} {skipped}")
    elif a.verb == "bundle":
        out, n, repeats = C.bundle(spark, a.inputs, a.output, max_bytes=a.max_bytes, order=a.order, dry_run=a.dry_run)
        out.orderBy("output_path").show(20, truncate=60)
        print(f"{n} sections, {repeats} repeats left out")
    elif a.verb == "run":
        from lodestrata.operators.runs import report_markdown

        records = C.run_config(spark, a.config, at=at, only=a.only, dry_run=a.dry_run, continue_on_error=a.continue_on_error)
        text = report_markdown(records).first()["markdown"]
        print(text)
        if a.report and not a.dry_run:
            with open(a.report, "w", encoding="utf-8") as f:
                f.write(text)
        return 0 if records.where("status <> 'succeeded'").isEmpty() else 1
    else:
        runtime_identity(spark).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
