import json
import os
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import packages as P
from lodestrata.sources import caches, checkpoints, config, files, git, http, manifests
from lodestrata.sources import packages as PK


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.md", "text\n"), ("c.md", ""), ("d.md", None)], "output_path string, markdown string")
    files.write_files(rows, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    files.write_files(rows, str(tmp_path / "out"))
    (tmp_path / "out/bin").write_bytes(b"a\0b")
    (tmp_path / "out/bad").write_bytes(b"\xff\xfe")
    got = {r["title"]: (r["content"], r["skip_reason"]) for r in files.scan_files(spark, str(tmp_path / "out")).collect()}
    assert got == {"b.md": ("text\n", None), "c.md": ("", None), "d.md": ("", None), "bin": (None, "binary file"), "bad": (None, "binary or non-UTF-8 file")}
    with pytest.raises(Exception, match="unsafe"):
        files.write_files(spark.createDataFrame([("../x", "y")], rows.schema), str(tmp_path / "out"))
    plan = spark.createDataFrame([("c.md", None), ("nope.md", None)], "output_path string, violation string")
    assert files.delete_files(plan, str(tmp_path / "out")) == 1 and not (tmp_path / "out/c.md").exists()
    with pytest.raises(ValueError, match="because"):
        files.delete_files(plan.withColumn("violation", F.lit("because")), str(tmp_path / "out"))
    assert files.numbered_name("out/b.md", 2, 3) == "out/b-002.md" and files.numbered_name("b.md", 1, 1) == "b.md"


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), *a], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b"})
    (tmp_path / "r/docs").mkdir(parents=True)
    (tmp_path / "r/docs/a.md").write_text("é\n")
    (tmp_path / "r/x.bin").write_bytes(b"\0")
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    git.register(spark)
    r = spark.read.format("lodestrata_git").option("repo", str(tmp_path / "r")).load().collect()
    assert {x["repo_path"]: (x["content"], x["skip_reason"]) for x in r} == {"docs/a.md": ("é\n", None), "x.bin": (None, "binary file")} and r[0]["canonical_id"].endswith(f"@{r[0]['commit_sha']}:docs/a.md")
    assert spark.read.format("lodestrata_git").option("repo", str(tmp_path / "r")).option("subdir", "docs").load().count() == 1
    with pytest.raises(Exception, match="Could not resolve"):
        spark.read.format("lodestrata_git").option("repo", str(tmp_path / "r")).option("ref", "nope").load().count()


class _Server(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def do_GET(self):
        port = self.server.server_port
        pages = {"/ok": ("text/html; charset=latin-1", "é".encode("latin-1")), "/big": ("text/html", b"x" * 5000), "/pdf": ("application/pdf", b"x"),
                 "/l1": ("application/json", json.dumps({"results": [{"id": "2"}, {"id": "10"}], "_links": {"next": "/l2"}}).encode()), "/l2": ("application/json", json.dumps({"results": [{"id": "1"}], "_links": {}}).encode()),
                 "/loop": ("application/json", json.dumps({"results": [], "_links": {"next": "/loop"}}).encode()), "/out": ("application/json", json.dumps({"results": [], "_links": {"next": f"http://localhost:{port}/l1"}}).encode())}
        if self.path not in pages:
            self.send_error(404)
            return
        kind, body = pages[self.path]
        self.send_response(200)
        self.send_header("Content-Type", kind)
        self.end_headers()
        self.wfile.write(body)


def test_http(spark):
    s = HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    http.register(spark)
    r = spark.read.format("lodestrata_urls").option("urls", json.dumps([f"{at}/{x}" for x in ("ok", "big", "pdf", "none")])).option("maxbytes", "1000").option("accept", "text/html").option("private", "true").load()
    assert {x["requested_url"].rpartition("/")[2]: (x["status"], x["body"], x["problem"]) for x in r.collect()} == {"ok": (200, "é", None), "big": (200, None, "too large"), "pdf": (200, None, "content type not accepted"), "none": (404, None, "status 404")}
    read = lambda p: spark.read.format("lodestrata_listing").option("urls", json.dumps([f"{at}/{p}"])).load()
    assert [x["id"] for x in read("l1").orderBy("position").collect()] == ["2", "10", "1"]
    for p, why in (("loop", "repeats"), ("out", "outside"), ("none", "status 404")):
        with pytest.raises(Exception, match=why):
            read(p).count()
    s.shutdown()


def test_manifests(spark, tmp_path):
    p = str(tmp_path / "m.json")
    assert manifests.read_manifests(spark, [p]) is None
    e = spark.createDataFrame([("b", "b.md", None, 3), ("a", "a.md", "", None)], "canonical_id string, output_path string, title string, page_version int")
    manifests.write_manifest(p, e, generated_at="t", max_depth=0)
    assert json.load(open(p)) == {"generated_at": "t", "max_depth": 0, "files": [{"canonical_id": "a", "output_path": "a.md"}, {"canonical_id": "b", "output_path": "b.md", "page_version": 3}]}
    got = {r["canonical_id"]: (r["page_version"], r["title"], r["stale"]) for r in manifests.read_manifests(spark, [p]).collect()}
    assert got == {"a": (None, None, False), "b": ("3", None, False)}
    write = lambda x: open(p, "w").write(json.dumps(x))
    write({"files": [{"canonical_id": "a", "output_path": "x", "title": True, "stale": "yes"}], "stale_artifacts": [{"canonical_id": "s", "output_path": "y"}]})
    assert {(r["part"], r["canonical_id"], r["title"], r["stale"]) for r in manifests.read_manifests(spark, [p]).collect()} == {("files", "a", None, False), ("stale_artifacts", "s", None, False)}
    for bad in ({"files": 3}, {"files": [{"canonical_id": 1, "output_path": "x"}]}, {"files": [{"canonical_id": "a", "output_path": "x"}, {"canonical_id": "a", "output_path": "y"}]}):
        write(bad)
        with pytest.raises(RuntimeError):
            manifests.read_manifests(spark, [p])
    root = str(tmp_path / "state")
    assert manifests.current_state(spark, root) is None
    manifests.commit_state(e, root, "2031-01")
    manifests.commit_state(e.limit(1), root, "2031-02")
    assert manifests.current_state(spark, root).count() == 1


def test_caches(spark, tmp_path):
    root = str(tmp_path / "c")
    assert caches.load(spark, root, "https://w/").count() == 0
    df = spark.createDataFrame([("1", "1", None, "old")], "canonical_id string, page_version string, last_modified string, payload string")
    caches.store(df, root, "https://w/", at="1")
    caches.store(df.withColumn("payload", F.lit("new")), root, "https://w", at="2")
    caches.store(df, root, "https://other", at="1")
    assert [r["payload"] for r in caches.load(spark, root, "https://w").collect()] == ["new"]
    assert caches.clear(spark, root, "https://w/") and caches.load(spark, root, "https://w").count() == 0 and caches.load(spark, root, "https://other").count() == 1


def test_checkpoints(tmp_path):
    p, d = str(tmp_path / "c.json"), "a" * 64
    state = {"run_id": "r", "request_fingerprint": "f", "observed": ["1", "2"], "completed": [{"video_id": "1", "captured_sha256": d, "normalized_sha256": d}], "pending": ["2"], "attempts": {"1": 1}, "prior_run_ids": []}
    checkpoints.save(state, p)
    assert checkpoints.load(p, "f")["pending"] == ["2"]
    with pytest.raises(ValueError, match="fingerprint"):
        checkpoints.load(p, "g")
    checkpoints.save(state | {"pending": ["1", "3"], "attempts": {"1": True}, "prior_run_ids": ["r", "r"]}, p)
    with pytest.raises(ValueError, match="pending is no part of observed; completed and pending overlap; attempts out of range; prior runs repeat; run is its own prior"):
        checkpoints.load(p, "f")


def test_config(spark, tmp_path):
    p = tmp_path / "runs.json"
    p.write_text(json.dumps({"runs": [{"name": "a", "type": "local_files", "options": {"output_dir": "out"}}, {"name": "b", "type": "git_repo", "enabled": False}], "bundles": [{"name": "x", "runs": ["a"], "output": "o.md"}]}))
    runs, bundles = config.load(str(p))
    assert runs[0].options["output_dir"] == str(tmp_path / "out") and bundles[0].runs == ("a",) and config.frame(spark, runs).count() == 2
    for bad in ({"runs": []}, {"runs": [{"name": "a", "type": "zzz"}]}, {"runs": [{"name": "a", "type": "bundle", "x": 1}]}, {"runs": [{"name": "a", "type": "bundle"}], "bundles": [{"name": "x", "runs": ["a"], "output": "o"}]}):
        p.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load(str(p))
    with pytest.raises(ValueError, match="choose one of: a, b"):
        config.choose({"a": 1, "b": 2}, "c", label="strategy")


def test_packages(spark, tmp_path):
    at = str(tmp_path / "p")
    items = [{"item_id": "1", "outcome": "completed", "artifacts": ["data/a.txt"]}, {"item_id": "2", "outcome": "skipped", "skip_reason": "old"}]
    address = P.seal(at, package_id="pk", run_id="r", request={"request_id": "q"}, items=items, artifacts={"data/a.txt": (b"hello", "record", "text/plain")}, created_at="t")
    assert len(address) == 64 and PK.verify(spark, at)["state"] == "verified"
    with pytest.raises(FileExistsError):
        P.seal(at, package_id="pk", run_id="r", request={}, items=[], artifacts={}, created_at="t")
    with pytest.raises(ValueError):
        P.seal(str(tmp_path / "q"), package_id="pk", run_id="r", request={}, items=[], artifacts={"../x": (b"", "record", "")}, created_at="t")
    open(os.path.join(at, "data/a.txt"), "w").write("jello")
    r = PK.verify(spark, at)
    assert (r["state"], r["failed_stage"], r["findings"]) == ("rejected", "artifact-integrity", ["data/a.txt: artifact-digest-mismatch"])
    open(os.path.join(at, "extra"), "w").write("x")
    assert PK.verify(spark, at)["failed_stage"] == "inventory-coverage"
    os.symlink("extra", os.path.join(at, "link"))
    assert PK.verify(spark, at)["findings"] == ["link: symlink-not-allowed", "extra: inventory-coverage-mismatch"]
