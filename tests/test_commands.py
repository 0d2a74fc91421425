"""Runs from the command line: incremental scans, bundles, configurations and their reports; dry runs write nothing."""

import json
import os
import subprocess

import pytest

from lodestrata import commands as C
from lodestrata.__main__ import main, parser
from lodestrata.operators import captions, issues
from lodestrata.sources import config, http


def tree(root):
    return sorted(os.path.relpath(os.path.join(a, f), root) for a, _, fs in os.walk(root) for f in fs if not f.startswith("."))


def test_incremental_runs_and_bundles(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.txt").write_text("one\n")
    (src / "b.txt").write_text("")
    (src / "c.bin").write_bytes(b"\0\1")
    run = lambda **k: C.sync(spark, C.local_records(spark, str(src)), out, at="t", **k)
    s, wrote, skipped = run(dry_run=True)
    assert (wrote, skipped) == (2, 0) and not os.path.exists(out) and {r["status"] for r in s.collect()} == {"new"}
    assert run()[1:] == (2, 0) and run()[1:] == (0, 2) and len(tree(out)) == 3
    (src / "a.txt").write_text("two\n")
    os.remove(os.path.join(out, next(f for f in tree(out) if f.startswith("b-"))))
    assert {r["reason"] for r in run(dry_run=True)[0].collect()} == {"content_hash changed", "prior artifact missing, so safe rewrite"}
    assert run()[1:] == (2, 0) and run()[1:] == (0, 2)
    C.sync(spark, C.local_records(spark, str(src)), f"{out}2", at="t")
    got, n, repeats = C.bundle(spark, [out, out, f"{out}2"], str(tmp_path / "all.md"), dry_run=True)
    assert (n, repeats) == (2, 2) and not (tmp_path / "all.md").exists() and [r["output_path"] for r in got.collect()] == ["all.md"]
    C.bundle(spark, [out], str(tmp_path / "all.md"))
    text = (tmp_path / "all.md").read_text()
    assert text.count("\n---\n") == 1 and "two" in text and text.endswith("\n")
    parts, _, _ = C.bundle(spark, [out], str(tmp_path / "p.md"), max_bytes=10)
    assert sorted(r["output_path"] for r in parts.collect()) == ["p-001.md", "p-002.md"] and (tmp_path / "p-002.md").exists()
    with pytest.raises(ValueError):
        C.bundle(spark, [str(tmp_path / "none")], str(tmp_path / "x.md"))


def test_configured_runs(spark, tmp_path, capsys):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("one\n")
    repo = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True)
    repo.mkdir()
    (repo / "r.md").write_text("text")
    (repo / "skip.py").write_text("code")
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    runs = [{"name": "f", "type": "local_files", "options": {"file_path": str(src), "output_dir": "out/f"}}, {"name": "g", "type": "git_repo", "options": {"repo_url": str(repo), "output_dir": "out/g", "include": "*.md"}}, {"name": "off", "type": "git_repo", "enabled": False},
            {"name": "w", "type": "public_webpage", "options": {"url": "https://x.example", "output_dir": "out/w"}}, {"name": "b", "type": "bundle", "options": {"inputs": f"{tmp_path}/out/f,{tmp_path}/out/g", "output_path": "all.md"}}]
    at = str(tmp_path / "runs.json")
    open(at, "w").write(json.dumps({"runs": runs}))
    status = lambda **k: [(r["name"], r["status"], r["wrote"], r["skipped"]) for r in C.run_config(spark, at, at="t", **k).orderBy("position").collect()]
    assert status(only=["f"], dry_run=True) == [("f", "succeeded", 1, 0)] and not (tmp_path / "out").exists()
    assert status(continue_on_error=True) == [("f", "succeeded", 1, 0), ("g", "succeeded", 1, 0), ("w", "failed", None, None), ("b", "succeeded", 2, 0)] and tree(tmp_path / "out" / "g") == ["manifest.json", "r.md"]
    assert status(only=["f", "g"]) == [("f", "succeeded", 0, 1), ("g", "succeeded", 0, 1)] and status()[3][1] == "not_run"
    with pytest.raises(ValueError, match="unknown runs"):
        status(only=["zz"])
    assert main(["run", at, "--only", "f", "--report", str(tmp_path / "r.md")]) == 0 and "| f | local_files | succeeded |" in (tmp_path / "r.md").read_text()
    assert main(["git_repo", str(repo), "--out", str(tmp_path / "g2"), "--exclude", "*.py", "--dry-run"]) == 0 and "would write 1" in capsys.readouterr().out
    assert main(["verify", str(tmp_path)]) == 1 and main(["identity"]) == 0 and main(["list"]) == 0
    with pytest.raises(SystemExit):
        parser().parse_args(["nonsense"])


def test_options(spark, monkeypatch):
    assert issues.options_problem("a/b", "all", "2024-01-01T00:00:00Z", 1) is None
    assert [bool(issues.options_problem(*x)) for x in (("a",), ("a/b/c",), ("/b",), ("a/b", "x"), ("a/b", "open", "soon"), ("a/b", "open", None, 0))] == [True] * 6
    assert config.option_problem("git_repo", {"zz": 1}) == "unknown options zz" and config.option_problem("confluence", {"max_depth": "x"}) and config.option_problem("confluence", {"max_depth": "0"}) is None and config.option_problem("github_metadata", {"max_items": 0})
    monkeypatch.setenv("SOME_TOKEN", "t")
    assert http.AUTH["bearer"]({"tokenenv": "SOME_TOKEN"}) == ({"Authorization": "Bearer t"}, None) and http.AUTH["bearer"]({}) == ({}, None)
    with pytest.raises(ValueError, match="not set"):
        http.AUTH["bearer"]({"tokenenv": "NO_SUCH_TOKEN"})
    with pytest.raises(ValueError, match="unknown auth"):
        http._get("http://x.example", {"auth": "zz", "private": "true"})
    with pytest.raises((OSError, KeyError)):
        http.AUTH["client_cert"]({"clientcert": "/none"})


def test_caption_tracks(spark):
    p = {"id": "v", "subtitles": {"en": [{"ext": "vtt", "name": "n"}, {"ext": "srv1"}], "de": None}, "automatic_captions": {"en": [{"ext": "vtt"}]}}
    df = spark.createDataFrame([(json.dumps(p),), (json.dumps({"id": "w"}),), (None,), ("[]",)], "payload string")
    got = captions.enriched(df)
    assert {tuple(r) for r in got.collect()} == {("v", "creator", "en", "vtt", "n"), ("v", "creator", "en", "srv1", None), ("v", "automatic", "en", "vtt", None)}
    assert captions.choose(got, on="video_id", languages=["en"]).first()["kind"] == "creator"
    with pytest.raises(Exception, match="more than 2"):
        captions.enriched(df, most=2).collect()
