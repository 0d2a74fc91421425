"""Git checkouts as a Python data source (A02-A05): ``spark.read.format("lodestrata_git").option("repo", url).load()``."""

from __future__ import annotations

import hashlib
import os
import subprocess

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _git(repo: str | None, *args: str) -> bytes:
    done = subprocess.run(["git", *(["-C", repo] if repo else []), *args], capture_output=True)
    if done.returncode:
        raise ValueError(f"Could not run git {args[0]}: {done.stderr.decode(errors='replace').strip()[:200]}")
    return done.stdout


class _Files(InputPartition):
    def __init__(self, at: str, sha: str, paths: list[str]):
        self.at, self.sha, self.paths = at, sha, paths


class _Reader(DataSourceReader):
    """Resolves the reference and lists tracked files once; each partition reads its share of blobs from the object store."""

    def __init__(self, options: dict[str, str]):
        self.repo, self.ref, self.step = options["repo"], options.get("ref"), int(options.get("filesperpartition", "500"))
        sub = options.get("subdir", "").strip().strip("/")
        if sub.startswith("/") or ".." in sub.split("/"):
            raise ValueError("subdir must be a relative path inside the repository")
        self.subdir = "" if sub in ("", ".") else sub
        self.cache = options.get("cache")

    def _place(self) -> str:
        """A local repository is read in place; others are cloned once into the shared cache folder."""
        if os.path.isdir(self.repo):
            return self.repo
        if not self.cache:
            raise ValueError("a remote repository needs the option cache, a folder that all executors share")
        at = os.path.join(self.cache, hashlib.sha256(self.repo.encode()).hexdigest()[:16])
        if os.path.isdir(at):
            if _git(at, "remote", "get-url", "origin").decode().strip() != self.repo:
                raise ValueError("Could not reuse the cached clone: it has another origin")
            _git(at, "fetch", "--tags", "origin")
        else:
            _git(None, "clone", "--no-checkout", self.repo, at)
        return at

    def _commit(self, at: str) -> str:
        """Without a reference the remote's head, else the first of ref and origin/ref that exists; one the clone lacks is fetched by name."""
        def first(names: list[str]) -> str | None:
            for t in names:
                done = subprocess.run(["git", "-C", at, "rev-parse", "--verify", "--quiet", f"{t}^{{commit}}"], capture_output=True, check=False)
                if not done.returncode:
                    return done.stdout.decode().strip()
            return None

        found = first([self.ref, f"origin/{self.ref}"] if self.ref else ["origin/HEAD", "HEAD"])
        if found is None and self.ref and not self.ref.startswith("-"):
            done = subprocess.run(["git", "-C", at, "fetch", "origin", self.ref], capture_output=True, check=False)
            found = None if done.returncode else first(["FETCH_HEAD", self.ref, f"origin/{self.ref}"])
        if found is None:
            raise ValueError(f"Could not resolve the reference {self.ref!r}")
        return found

    def partitions(self) -> list[InputPartition]:
        at = self._place()
        sha = self._commit(at)
        listed = _git(at, "ls-tree", "-r", "-z", "--full-name", sha, *(["--", self.subdir] if self.subdir else [])).split(b"\0")
        # A submodule's entry is a commit, not a blob; it is kept for its skip reason.
        rows = sorted(x.decode() for x in listed if x)
        return [_Files(at, sha, rows[i:i + self.step]) for i in range(0, len(rows), self.step)] or [_Files(at, sha, [])]

    def read(self, partition: _Files):
        for row in partition.paths:
            meta, _, path = row.partition("\t")
            mode, kind, blob = meta.split()[:3]
            head = (self.repo, self.ref or "", partition.sha, path, f"{self.repo}@{partition.sha}:{path}")
            if kind != "blob" or mode == "120000":
                yield (*head, None, "not a regular file; submodules are not supported")
                continue
            data = _git(partition.at, "cat-file", "blob", blob)
            if b"\0" in data:
                yield (*head, None, "binary file")
                continue
            try:
                yield (*head, data.decode("utf-8"), None)
            except UnicodeDecodeError:
                yield (*head, None, "binary or non-UTF-8 file")


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestrata_git"

    def schema(self) -> str:
        return "repo string, ref string, commit_sha string, repo_path string, canonical_id string, content string, skip_reason string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)
