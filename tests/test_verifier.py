"""Each way a sealed package can be broken, its stage and code; and the runs, caches and checks around packages."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import packages as P
from lodestrata.operators import runs as U
from lodestrata.sources import packages as V

ITEMS = [{"item_id": "1", "outcome": "completed", "artifacts": ["data/a.txt"]}, {"item_id": "2", "outcome": "skipped", "skip_reason": "old"}]
RESUMED = {"resumes_run_id": "r0", "prior_run_ids": ["r0"], "reconciliation_summary": {"reused": 1}, "final_attempt_counts": {"1": 2}}


def sealed(at, items=ITEMS, lineage=None, capabilities=(), artifacts=None):
    P.seal(at, package_id="pk", run_id="r", request={"request_id": "q"}, items=items, artifacts=artifacts or {"data/a.txt": (b"hello", "record", "text/plain")}, created_at="t", capabilities=capabilities, lineage=lineage)
    return at


def rewrite(at, change, body=None):
    """Change the manifest and seal it again."""
    m = json.load(open(f"{at}/package.json"))
    change(m)
    data = body(m) if body else P.canonical_json(m)
    open(f"{at}/package.json", "wb").write(data)
    open(f"{at}/package.sha256", "w").write(hashlib.sha256(data).hexdigest() + "\n")


def put(path, data):
    def change(at):
        os.makedirs(os.path.dirname(f"{at}/{path}"), exist_ok=True)
        open(f"{at}/{path}", "wb").write(data)
    return change


def manifest(**fields):
    return lambda at: rewrite(at, lambda m: m.update(fields))


def entry(n, **fields):
    return lambda at: rewrite(at, lambda m: m["artifacts"][n].update(fields))


def item(n, **fields):
    """Change an item and what the inventory says of it."""
    def change(at):
        path = f"items/{n}.json"
        data = P.canonical_json({**json.load(open(f"{at}/{path}")), **fields})
        open(f"{at}/{path}", "wb").write(data)
        rewrite(at, lambda m: next(a for a in m["artifacts"] if a["path"] == path).update(bytes=len(data), sha256=hashlib.sha256(data).hexdigest()))
    return change


def both(*changes):
    return lambda at: [c(at) for c in changes]


def side(data):
    return put("package.sha256", data)


BAD = {
    "no manifest": (lambda at: os.remove(f"{at}/package.json"), "envelope", "missing-required-file"), "linked sidecar": (lambda at: (os.rename(f"{at}/package.sha256", f"{at}/s"), os.symlink("s", f"{at}/package.sha256")), "envelope", "missing-required-file"),
    "large sidecar": (side(b"0" * 2000), "envelope", "consumer-size-limit"), "no newline": (side(b"0" * 64), "sidecar-format", "invalid-sidecar-format"), "upper case": (side(b"A" * 64 + b"\n"), "sidecar-format", "invalid-sidecar-format"), "words": (side(b"hello\n"), "sidecar-format", "invalid-sidecar-format"),
    "other digest": (side(b"0" * 64 + b"\n"), "manifest-digest", "manifest-digest-mismatch"), "not UTF-8": (lambda at: rewrite(at, lambda m: None, lambda m: b"\xff{}"), "manifest-parse", "invalid-manifest-json"), "no JSON": (lambda at: rewrite(at, lambda m: None, lambda m: b"{"), "manifest-parse", "invalid-manifest-json"),
    "key twice": (lambda at: rewrite(at, lambda m: None, lambda m: b'{"a":1,"a":2}'), "manifest-parse", "duplicate-json-key"), "no object": (lambda at: rewrite(at, lambda m: None, lambda m: b"[]"), "manifest-parse", "invalid-manifest-shape"), "too deep": (manifest(x=json.loads("[" * 70 + "]" * 70)), "manifest-parse", "consumer-depth-limit"),
    "other contract": (manifest(contract_name="x"), "compatibility", "unsupported-contract-name"), "other major": (manifest(contract_version="2.0.0"), "compatibility", "unsupported-contract-major"), "no version": (manifest(contract_version=1), "compatibility", "unsupported-contract-major"),
    "unknown capability": (manifest(required_capabilities=["zz"]), "compatibility", "unknown-required-capability"), "capability shape": (manifest(required_capabilities="zz"), "compatibility", "invalid-required-capabilities"), "progress unnamed": (manifest(collection_progress={"state": "exhausted"}), "compatibility", "missing-collection-progress-capability"),
    "progress too early": (manifest(collection_progress={"state": "exhausted"}, required_capabilities=["collection-progress"], contract_version="1.0.0"), "compatibility", "unsupported-collection-progress-version"),
    "absolute": (entry(0, path="/etc/x"), "path-safety", "unsafe-artifact-path"), "escape": (entry(0, path="a/../b"), "path-safety", "unsafe-artifact-path"), "same path": (entry(0, path="ITEMS/1.json"), "path-safety", "unsafe-artifact-path"), "long path": (entry(0, path="x" * 2000), "path-safety", "unsafe-artifact-path"),
    "entry shape": (entry(0, bytes=True), "path-safety", "invalid-inventory-entry"), "inventory shape": (manifest(artifacts={}), "path-safety", "invalid-inventory-shape"), "missing file": (lambda at: os.remove(f"{at}/data/a.txt"), "inventory-coverage", "inventory-coverage-mismatch"),
    "extra file": (put("z", b""), "inventory-coverage", "inventory-coverage-mismatch"), "link": (lambda at: os.symlink("x", f"{at}/l"), "inventory-coverage", "symlink-not-allowed"), "hard link": (lambda at: os.link(f"{at}/data/a.txt", f"{at}/../h"), "inventory-coverage", "hard-link-not-allowed"),
    "counts": (manifest(counts={"completed": 2, "unchanged": 0, "skipped": 0, "failed": 0, "cancelled": 0}), "terminal-accounting", "terminal-count-mismatch"), "counts shape": (manifest(counts={}), "terminal-accounting", "invalid-terminal-counts"), "status": (manifest(status="x"), "terminal-accounting", "terminal-status-mismatch"),
    "not terminal": (item(1, outcome="running"), "terminal-accounting", "terminal-count-mismatch"), "unlisted item": (manifest(items=["items/9.json"]), "terminal-accounting", "invalid-item-references"), "success with error": (item(1, error={}), "item-semantics", "contradictory-item-error"),
    "no reason": (item(2, skip_reason=None), "item-semantics", "missing-skip-reason"), "no identity": (item(1, item_id=""), "item-semantics", "invalid-item-identity"), "locator": (item(1, resolved_locator="x" * 3000), "item-semantics", "invalid-item-locator"), "other's artifact": (item(2, artifacts=["data/a.txt"]), "item-semantics", "cross-item-artifact-reference"),
    "wrong role": (item(2, diagnostics=["data/a.txt"]), "item-semantics", "invalid-item-artifact-reference"), "references shape": (item(2, artifacts="x"), "item-semantics", "invalid-item-artifact-references"),
    "own prior": (manifest(prior_run_ids=["r"]), "lineage", "self-referential-lineage"), "own package": (manifest(prior_package_ids=["pk"]), "lineage", "self-referential-lineage"), "prior twice": (manifest(prior_run_ids=["a", "a"]), "lineage", "invalid-lineage-identifiers"),
    "resumes nothing": (manifest(**{**RESUMED, "resumes_run_id": ""}), "lineage", "invalid-resume-lineage"), "resumes another": (manifest(**{**RESUMED, "prior_run_ids": ["x"]}), "lineage", "inconsistent-resume-lineage"), "no summary": (manifest(**{k: v for k, v in RESUMED.items() if k != "reconciliation_summary"}), "lineage", "incomplete-resume-lineage"),
    "negative": (manifest(**{**RESUMED, "final_attempt_counts": {"1": -1}}), "lineage", "invalid-lineage-counts"), "no receipt": (manifest(run_receipt="gone"), "lineage", "invalid-run-receipt-reference"), "receipt no JSON": (manifest(run_receipt="data/a.txt"), "lineage", "invalid-run-receipt"),
    "bytes": (entry(0, bytes=99), "artifact-integrity", "artifact-size-mismatch"), "digest": (put("data/a.txt", b"jello"), "artifact-integrity", "artifact-digest-mismatch"),
    "counts before bytes": (both(put("data/a.txt", b"jello"), manifest(status="x")), "terminal-accounting", "terminal-status-mismatch"), "items before bytes": (both(item(1, error={}), put("data/a.txt", b"jello")), "item-semantics", "contradictory-item-error"), "lineage before bytes": (both(put("data/a.txt", b"jello"), manifest(prior_run_ids=["r"])), "lineage", "self-referential-lineage"),
}


@pytest.mark.parametrize("name", sorted(BAD))
def test_broken_packages(tmp_path, name):
    change, stage, code = BAD[name]
    at = sealed(str(tmp_path / "p"))
    assert V.verify(None, at)["state"] == "verified"
    change(at)
    r = V.verify(None, at)
    assert (r["state"], r["failed_stage"]) == ("rejected", stage) and any(f.endswith(": " + code) for f in r["findings"]), r
    before = P.STAGES.index(stage)
    assert r["last_completed_stage"] == (P.STAGES[before - 1] if before else None) and (r["content_address"] is None) == (before < 3)


def test_sound_packages_and_limits(tmp_path):
    receipt = P.canonical_json({"run_id": "r", "other": 1})
    kinds = {"data/a.txt": (b"hello", "record", "text/plain"), "receipt.json": (receipt, "receipt", "application/json")}
    failed = [*ITEMS, {"item_id": "3", "outcome": "failed", "error": {"code": "x"}}]
    at = sealed(str(tmp_path / "p"), items=failed, lineage={**RESUMED, "run_receipt": "receipt.json", "collection_progress": {"state": "continuation_remaining"}}, capabilities=("collection-progress",), artifacts=kinds)
    assert V.verify(None, at)["failed_stage"] == "compatibility" and V.verify(None, at, ("collection-progress",))["state"] == "verified"
    for limit, stage, code in (({"manifest_bytes": 10}, "envelope", "consumer-size-limit"), ({"json_depth": 2}, "manifest-parse", "consumer-depth-limit"), ({"entries": 2}, "inventory-coverage", "consumer-entry-limit"), ({"file_bytes": 3}, "inventory-coverage", "consumer-file-limit"),
                               ({"total_bytes": 9}, "inventory-coverage", "consumer-total-limit"), ({"items": 1}, "terminal-accounting", "consumer-item-limit")):
        r = V.verify(None, at, profile=V.Profile(supports=("collection-progress",), **limit))
        assert r["failed_stage"] == stage and any(code in f for f in r["findings"]), limit
    rewrite(at, lambda m: m.update(run_id="r9"))
    assert V.verify(None, at, ("collection-progress",))["findings"] == ["run_id: receipt-lineage-conflict"]
    rewrite(at, lambda m: m.update(run_id="r", collection_progress={"state": "x"}))
    assert V.verify(None, at, ("collection-progress",))["findings"] == ["collection_progress: invalid-collection-progress"]
    assert V.verify(None, str(tmp_path / "none"))["failed_stage"] == "envelope"


def test_claims_and_requests(spark):
    assert [r[0] for r in spark.createDataFrame([("x" * 201,), ("x" * 200,), (None,)], "m string").select(P.shortened("m")).collect()] == ["x" * 200 + "…", "x" * 200, None]
    row = lambda **k: tuple({"request_id": "1", "adapter_type": "a", "targets": ["t"], "scope": None, "output_location": "o", "credential_reference": None, "selection": None, "checkpoint_reference": None, "retry_policy": None, "expected_contract": None, "extensions": None, **k}.values())
    rows = [row(), row(request_id=" "), row(targets=[]), row(targets=None), row(targets=["a", None]), row(targets=["a", "a"]), row(retry_policy={"n": -1}), row(extensions={"targets": "x"}), row(output_location=None)]
    got = [r[0] for r in spark.createDataFrame(rows, P.REQUEST).select(P.request_problem()).collect()]
    assert got == [None, "missing request_id", "no targets", "no targets", "blank target", "repeated target", "negative retry_policy", "reserved extension", "missing output_location"]
    item = lambda **k: spark.range(1).select(P.item_problem(F.lit("completed"), F.lit(None), F.lit(None), **k)).first()[0]
    some = lambda *x: F.array(*[F.lit(y) for y in x])
    assert item(identity=some("a", "")) == item(identity=some("x" * 201)) == "invalid_identity" and item(references=F.array_repeat(F.lit("x"), 257)) == "invalid_references" and item(locators=some("x" * 3000)) == "locator_too_long" and item(identity=some("a"), references=some("b")) is None


def test_runs_stop_and_go_on(spark):
    def stop(_):
        raise KeyboardInterrupt

    def fail(_):
        raise ValueError("bad\nnews")

    ok = lambda s: (s.range(3).count(), 1)
    status = lambda *plans, **k: [(r["status"], r["wrote"], r["message"]) for r in U.run_all(spark, [(str(i), "t", p) for i, p in enumerate(plans)], **k).orderBy("position").collect()]
    assert status(ok, stop, ok) == [("succeeded", 3, None), ("interrupted", None, None), ("succeeded", 3, None)]
    assert status(stop, stop, ok)[2][0] == "not_run" and status(fail, ok) == [("failed", None, "bad"), ("not_run", None, None)] and status(fail, ok, continue_on_error=True)[1][0] == "succeeded"
