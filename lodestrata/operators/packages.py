"""Content-addressed packages: inventory, accounting, coverage, references, lineage, findings."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import col
from lodestrata.operators.urls import is_safe_path

# Outcomes, envelope files and stages in their order.
OUTCOMES = ["completed", "unchanged", "skipped", "failed", "cancelled"]
ENVELOPE = ["package.json", "package.sha256"]
STAGES = ["envelope", "sidecar-format", "manifest-digest", "manifest-parse", "compatibility", "path-safety", "inventory-coverage", "terminal-accounting", "item-semantics", "lineage", "artifact-integrity"]


# The states of a collection's progress, and the lineage that manifest and receipt must agree on.
PROGRESS = ["continuation_remaining", "exhausted"]
LINEAGE = ["run_id", "resumes_run_id", "prior_run_ids", "prior_package_ids", "reconciliation_summary", "final_attempt_counts", "collection_progress"]
CONTRACT = "sealed-package"


def inventory(artifacts: DataFrame, *, path: str = "path", data: str = "data") -> DataFrame:
    """Bytes and SHA-256 of every artifact of each package."""
    d = col(data).cast("binary")
    return artifacts.select(*[c for c in artifacts.columns if c != data], F.octet_length(d).cast("bigint").alias("bytes"), F.sha2(d, 256).alias("sha256"))


def totals(files: DataFrame, by: list[str]) -> DataFrame:
    """files and bytes of each package."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"))


def accounting(items: DataFrame, on: str) -> DataFrame:
    """the five outcome counts of each package (zeros included) and the status they make."""
    n = items.groupBy(on).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    return n.withColumn("status", F.when((F.col("failed") > 0) | (F.col("cancelled") > 0), "completed_with_errors").otherwise("completed"))


def coverage(observed: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """Files without an inventory row and inventory rows without a file; the two envelope files are never listed."""
    o = observed.where(~F.col("path").isin(*ENVELOPE)).select(on, "path", F.lit(1).alias("_o")).distinct()
    j = o.join(listed.select(on, "path", F.lit(1).alias("_l")).distinct(), [on, "path"], "full")
    return j.where("_o IS NULL OR _l IS NULL").select(on, "path", F.when(F.col("_o").isNull(), "missing_file").otherwise("unlisted_file").alias("code"))


def references(items: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """References to nothing, to an artifact of the wrong role, or to one that another item claims as well.

    ``items``: (on, item_id, artifacts, diagnostics); ``listed``: (on, path, role).
    """
    refs = items.select(on, "item_id", F.explode(F.concat(F.transform(F.coalesce("artifacts", F.array()), lambda p: F.struct(p.alias("path"), F.lit(False).alias("diag"))),
                                                          F.transform(F.coalesce("diagnostics", F.array()), lambda p: F.struct(p.alias("path"), F.lit(True).alias("diag"))))).alias("r")).select(on, "item_id", "r.*")
    j = refs.join(listed.select(on, "path", "role"), [on, "path"], "left")
    many = refs.groupBy(on, "path").agg(F.countDistinct("item_id").alias("n")).where("n > 1").select(on, "path", F.lit(None).cast("string").alias("item_id"), F.lit("claimed_by_several").alias("code"))
    bad = j.withColumn("code", F.when(F.col("role").isNull(), "unknown_reference").when((F.col("role") == "diagnostic") != F.col("diag"), "wrong_role")).where("code IS NOT NULL")
    return bad.select(on, "path", "item_id", "code").unionByName(many)


def item_problem(outcome: str | Column, error: str | Column, skip_reason: str | Column, locators: str | Column | None = None, identity: str | Column | None = None, references: str | Column | None = None) -> Column:
    """What an item record lacks for its outcome; null if nothing.

    ``identity`` is an array of texts of 1 to 200 characters, ``locators`` one of texts of at most 2,048, ``references`` has at most 256 entries.
    """
    o, none = col(outcome), F.array().cast("array<string>")
    given = lambda c: none if c is None else F.coalesce(col(c), none)
    return (F.when(~F.coalesce(o.isin(*OUTCOMES), F.lit(False)), "unknown_outcome").when(F.exists(given(identity), lambda x: x.isNull() | ~F.length(x).between(1, 200)), "invalid_identity")
            .when(o.isin("completed", "unchanged") & col(error).isNotNull(), "success_with_error").when(o.isin("failed", "cancelled") & col(error).isNull(), "missing_error")
            .when((o == "skipped") & (F.coalesce(col(skip_reason), F.lit("")) == ""), "missing_skip_reason").when(F.exists(given(locators), lambda x: F.length(x) > 2048), "locator_too_long")
            .when((F.size(given(references)) > 256) | F.exists(given(references), lambda x: x.isNull()), "invalid_references"))


def unsupported(required: str | Column, supported: str | Column) -> Column:
    """Required capabilities that are not supported, sorted."""
    return F.array_sort(F.array_except(col(required), col(supported)))


def lineage_problem(own: str | Column, prior: str | Column, resumes: str | Column, attempts: str | Column) -> Column:
    """Repeats, the run itself among its priors, a resumed run that is no prior, or negative attempts; null if sound."""
    p = F.coalesce(col(prior), F.array().cast("array<string>"))
    return (F.when(F.size(F.array_distinct(p)) != F.size(p), "duplicate_prior").when(F.array_contains(p, col(own)), "self_reference").when(col(resumes).isNotNull() & ~F.array_contains(p, col(resumes)), "resumes_unknown_run")
            .when(F.exists(F.map_values(col(attempts)), lambda x: x < 0), "negative_attempts"))


def unequal_keys(left: str | Column, right: str | Column) -> Column:
    """Keys of both maps whose values differ, sorted."""
    l, r = col(left), col(right)
    return F.array_sort(F.filter(F.array_intersect(F.map_keys(l), F.map_keys(r)), lambda k: ~F.element_at(l, k).eqNullSafe(F.element_at(r, k))))


def handoff(expected: DataFrame, verified: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Rows that only one side has or whose values differ."""
    e = expected.select(*on, F.struct(*values).alias("_e"))
    v = verified.select(*on, F.struct(*values).alias("_v"))
    return e.join(v, on, "full").where(~F.col("_e").eqNullSafe(F.col("_v"))).select(*on, F.when(F.col("_v").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("different").alias("code"))


def bounded(value: str | Column, limit: int = 200) -> Column:
    """A claim longer than the limit is null, not cut."""
    return F.when(F.length(col(value)) <= limit, col(value))


def shortened(message: str | Column, limit: int = 200) -> Column:
    """A finding's message, cut behind ``limit`` characters."""
    m = col(message)
    return F.when(F.length(m) > limit, F.concat(F.substring(m, 1, limit), F.lit("…"))).otherwise(m)


def claims(verified: DataFrame, manifests: DataFrame, on: str) -> DataFrame:
    """What may be said of each package, as far as its verification came: texts beyond 200 characters are null.

    ``verified`` as ``first_failing_stage`` gives it; ``manifests``: (on, package_id, run_id, status, counts, prior_run_ids, artifacts). Names come with
    the parsed manifest, status and counts with the accounting, lineage with its stage, the inventory's totals with the last.
    """
    done = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("last_completed_stage")), F.lit(0))
    done = F.when(F.col("last_completed_stage") == "complete", len(STAGES)).otherwise(done)
    at = lambda stage: done > STAGES.index(stage)
    j = manifests.join(verified.select(on, "state", "last_completed_stage"), on)
    size = F.struct(F.size("artifacts").cast("bigint").alias("files"), F.aggregate("artifacts", F.lit(0).cast("bigint"), lambda a, x: a + x["bytes"]).alias("bytes"))
    return j.select(on, "state", *[F.when(at("manifest-parse"), bounded(c)).alias(c) for c in ("package_id", "run_id")], F.when(at("terminal-accounting"), bounded("status")).alias("status"), F.when(at("terminal-accounting"), F.col("counts")).alias("counts"),
                    F.when(at("lineage"), F.transform("prior_run_ids", lambda x: bounded(x))).alias("prior_run_ids"), F.when(at("artifact-integrity"), size).alias("totals"))


# C14: the records of a request and of a package's lineage; members that are null are left out of their JSON.
REQUEST = ("request_id string, adapter_type string, targets array<string>, scope map<string,string>, output_location string, credential_reference string, selection map<string,string>, checkpoint_reference string, "
           "retry_policy map<string,bigint>, expected_contract string, extensions map<string,string>")
LINEAGE_RECORD = "run_id string, resumes_run_id string, prior_run_ids array<string>, prior_package_ids array<string>, reconciliation_summary map<string,bigint>, final_attempt_counts map<string,bigint>, collection_progress struct<state:string>"


def record_json(*columns: str) -> Column:
    """C14: a record's members as JSON in the order of their names, absent ones left out."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "true"})


def request_problem() -> Column:
    """C14: what a request record (``REQUEST``) breaks first; null if nothing. Extensions may not use a member's name."""
    own = [x.split()[0] for x in REQUEST.split(", ") if " " in x]
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (F.when(blank("request_id"), "missing request_id").when(blank("adapter_type"), "missing adapter_type").when(F.coalesce(F.size("targets"), F.lit(0)) < 1, "no targets").when(F.exists("targets", lambda x: x.isNull() | (x == "")), "blank target")
            .when(F.size(F.array_distinct("targets")) != F.size("targets"), "repeated target").when(blank("output_location"), "missing output_location")
            .when(F.exists(F.map_values(F.coalesce("retry_policy", F.create_map().cast("map<string,bigint>"))), lambda x: x < 0), "negative retry_policy")
            .when(F.size(F.array_intersect(F.map_keys(F.coalesce("extensions", F.create_map().cast("map<string,string>"))), F.array(*[F.lit(x) for x in own]))) > 0, "reserved extension"))


def first_failing_stage(findings: DataFrame, packages: DataFrame, on: str) -> DataFrame:
    """Per package its state, the stage that failed first, and the last completed one. ``findings``: (on, stage_no from 1, code)."""
    f = findings.groupBy(on).agg(F.min("stage_no").alias("s"))
    name = F.array(*[F.lit(s) for s in STAGES])
    j = packages.select(on).distinct().join(f, on, "left")
    return j.select(on, F.when(F.col("s").isNull(), "verified").otherwise("rejected").alias("state"), F.get(name, F.col("s") - 1).alias("failed_stage"), F.when(F.col("s").isNull(), "complete").otherwise(F.get(name, F.col("s") - 2)).alias("last_completed_stage"))


def all_findings(package: DataFrame, observed: DataFrame, listed: DataFrame, items: DataFrame, on: str, supported: list[str]) -> DataFrame:
    """The findings of the relational stages of many packages at once: (on, stage_no, code, reference)."""
    at = lambda stage: F.lit(STAGES.index(stage) + 1)
    put = lambda df, stage, ref: df.select(on, at(stage).alias("stage_no"), "code", F.col(ref).cast("string").alias("reference"))
    caps = package.select(on, F.explode(unsupported("required_capabilities", F.array(*[F.lit(s) for s in supported]))).alias("reference"), F.lit("unsupported_capability").alias("code"))
    unsafe = listed.where(~is_safe_path("path")).select(on, F.col("path").alias("reference"), F.lit("unsafe_path").alias("code"))
    twice = listed.groupBy(on, F.lower("path").alias("reference")).count().where("count > 1").select(on, "reference", F.lit("duplicate_path").alias("code"))
    o = observed.select(on, "path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    content = listed.join(o, [on, "path"]).withColumn("code", F.when(F.col("bytes") != F.col("_b"), "size_mismatch").when(F.col("sha256") != F.col("_s"), "digest_mismatch")).where("code IS NOT NULL")
    semantic = items.withColumn("code", item_problem("outcome", "error", "skip_reason")).where("code IS NOT NULL")
    counted = accounting(items, on).select(on, *OUTCOMES).join(package.select(on, "counts"), on).select(on, F.explode(F.array(*[F.struct(F.lit(x).alias("o"), F.col(x).alias("n"), F.coalesce(F.element_at("counts", F.lit(x)), F.lit(0)).alias("m")) for x in OUTCOMES])).alias("c"))
    counted = counted.where("c.n <> c.m").select(on, F.col("c.o").alias("reference"), F.lit("count_mismatch").alias("code"))
    parts = [put(caps, "compatibility", "reference"), put(unsafe, "path-safety", "reference"), put(twice, "path-safety", "reference"), put(coverage(observed, listed, on), "inventory-coverage", "path"), put(content, "artifact-integrity", "path"),
             put(semantic, "item-semantics", "item_id"), put(counted, "terminal-accounting", "reference"), put(references(items, listed, on), "item-semantics", "path")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def canonical_json(value) -> bytes:
    """Sorted keys, no blanks, non-ASCII kept, one line end."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()


def json_depth(value) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return 1 if inner is None else 1 + max(map(json_depth, inner), default=0)


def canonical(df: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """C13 on a column of JSON texts: ``id, canonical, depth, problem`` (repeated keys, no JSON)."""
    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError("duplicate key")
        return dict(pairs)

    def one(t: str | None) -> tuple[str | None, int | None, str | None]:
        try:
            v = json.loads(t or "", object_pairs_hook=unique)
        except ValueError as e:
            return None, None, "duplicate key" if "duplicate key" in str(e) else "no JSON"
        return canonical_json(v).decode(), json_depth(v), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *one(t)) for i, t in zip(b.iloc[:, 0], b.iloc[:, 1])], columns=["id", "canonical", "depth", "problem"])

    return df.select(id_col, text).mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, canonical string, depth int, problem string")


def seal(destination: str, *, package_id: str, run_id: str, request: dict, items: list[dict], artifacts: dict[str, tuple[bytes, str, str]], created_at: str, capabilities: tuple[str, ...] = (), lineage: dict | None = None) -> str:
    """Write one package atomically (temporary folder, then rename) and return its content address.

    ``lineage`` holds the manifest's further fields (``LINEAGE``, ``run_receipt``); items without a ``resource_kind`` are records.
    A package is a bounded artifact of one run and is written by the driver; the inventory of many packages is ``inventory``.
    """
    if os.path.exists(destination):
        raise FileExistsError(destination)
    for p in artifacts:
        if p in (*ENVELOPE, "request.json") or p.startswith(("/", "items/")) or "\\" in p or any(s in ("", ".", "..") for s in p.split("/")):
            raise ValueError(f"unsafe artifact path: {p}")
    items = [{"resource_kind": "record", **i} for i in items]
    files = {"request.json": canonical_json(request), **{f"items/{i['item_id']}.json": canonical_json(i) for i in items}, **{p: d for p, (d, _, _) in artifacts.items()}}
    kinds = {p: (role, kind) for p, (_, role, kind) in artifacts.items()}
    counts = {o: sum(i["outcome"] == o for i in items) for o in OUTCOMES}
    manifest = {**(lineage or {}), "contract_name": CONTRACT, "contract_version": "1.1.0", "package_id": package_id, "run_id": run_id, "created_at": created_at, "required_capabilities": sorted(capabilities), "counts": counts, "items": sorted(f"items/{i['item_id']}.json" for i in items),
                "status": "completed_with_errors" if counts["failed"] or counts["cancelled"] else "completed",
                "artifacts": [{"path": p, "bytes": len(d), "sha256": hashlib.sha256(d).hexdigest(), "role": kinds.get(p, ("record", ""))[0], "media_type": kinds.get(p, ("", "application/json"))[1]} for p, d in sorted(files.items())]}
    body = canonical_json(manifest)
    address = hashlib.sha256(body).hexdigest()
    os.makedirs(os.path.dirname(destination) or ".", exist_ok=True)
    tmp = tempfile.mkdtemp(dir=os.path.dirname(destination) or ".", prefix=".seal-")
    try:
        for p, d in {**files, "package.json": body, "package.sha256": f"{address}\n".encode()}.items():
            at = os.path.join(tmp, p)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "wb") as f:
                f.write(d)
        os.rename(tmp, destination)
    except BaseException:
        shutil.rmtree(tmp, ignore_errors=True)
        raise
    return address
