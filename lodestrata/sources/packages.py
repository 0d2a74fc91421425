"""Sealed packages from disk: observed files and the manifest's own tables (A25), with the envelope checks of M05."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import re
import stat

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import packages as P

FILE_SCHEMA = "package_id string, path string, bytes bigint, sha256 string, problem string"
LISTED_SCHEMA = "package_id string, path string, bytes bigint, sha256 string, role string, media_type string"
ITEM_SCHEMA = "package_id string, item_id string, outcome string, error string, skip_reason string, artifacts array<string>, diagnostics array<string>"
PACKAGE_SCHEMA = "package_id string, required_capabilities array<string>, counts map<string,bigint>, content_address string"


def observed(root: str, *, max_files: int = 10_000, max_bytes: int = 64 << 20) -> list[tuple[str, int, str | None, str | None]]:
    """(path, bytes, sha256, problem) of every file below ``root``; links are never followed, limits are the profile's."""
    out = []
    for at, dirs, files in os.walk(root, followlinks=False):
        for name in sorted(files) + [d for d in dirs if os.path.islink(os.path.join(at, d))]:
            full = os.path.join(at, name)
            path, before = os.path.relpath(full, root), os.lstat(full)
            if not stat.S_ISREG(before.st_mode) or before.st_nlink > 1:
                out.append((path, before.st_size, None, "not a plain file"))
            elif before.st_size > max_bytes or len(out) >= max_files:
                out.append((path, before.st_size, None, "over the limit"))
            else:
                with open(os.open(full, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
                    data = f.read(max_bytes + 1)
                    same = os.fstat(f.fileno())
                moved = (same.st_ino, same.st_size, same.st_mtime_ns) != (before.st_ino, before.st_size, before.st_mtime_ns)
                out.append((path, len(data), hashlib.sha256(data).hexdigest(), "changed while it was read" if moved else None))
    return sorted(out)


def read_package(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[str]]:
    """(package, observed, listed, items, envelope problems) of one sealed package; a package is bounded by its profile."""
    files = observed(root)
    problems = [f"{p}: {why}" for p, _, _, why in files if why]
    try:
        with open(os.path.join(root, "package.json"), "rb") as f:
            body = f.read()
        manifest = json.loads(body)
    except (OSError, ValueError):
        return (*(spark.createDataFrame([], s) for s in (PACKAGE_SCHEMA, FILE_SCHEMA, LISTED_SCHEMA, ITEM_SCHEMA)), [*problems, "package.json is missing or no JSON"])
    address = hashlib.sha256(body).hexdigest()
    try:
        with open(os.path.join(root, "package.sha256")) as f:
            if f.read().split()[:1] != [address]:
                problems.append("package.sha256 does not match")
    except OSError:
        problems.append("package.sha256 is missing")
    pid = manifest.get("package_id")
    items = []
    for ref in manifest.get("items", []):
        try:
            with open(os.path.join(root, ref)) as f:
                i = json.load(f)
            items.append((pid, i.get("item_id"), i.get("outcome"), json.dumps(i["error"]) if i.get("error") else None, i.get("skip_reason"), i.get("artifacts", []), i.get("diagnostics", [])))
        except (OSError, ValueError):
            problems.append(f"{ref}: unreadable item")
    listed = [(pid, a.get("path"), a.get("bytes"), a.get("sha256"), a.get("role"), a.get("media_type")) for a in manifest.get("artifacts", [])]
    return (spark.createDataFrame([(pid, manifest.get("required_capabilities", []), manifest.get("counts", {}), address)], PACKAGE_SCHEMA), spark.createDataFrame([(pid, *f) for f in files], FILE_SCHEMA),
            spark.createDataFrame(listed, LISTED_SCHEMA), spark.createDataFrame(items, ITEM_SCHEMA), problems)


@dataclasses.dataclass(frozen=True)
class Profile:
    """What a consumer accepts; the defaults are the usual profile."""

    manifest_bytes: int = 16 << 20
    sidecar_bytes: int = 1024
    json_depth: int = 64
    entries: int = 10_000
    items: int = 2_000
    file_bytes: int = 64 << 20
    total_bytes: int = 512 << 20
    path_chars: int = 1024
    contract: str = P.CONTRACT
    majors: tuple[int, ...] = (1,)
    supports: tuple[str, ...] = ()


class _Unreadable(Exception):
    """A file of the package could not be read; whether it is sound can't be said."""


class _Check:
    """One package's verification, a generator of (code, reference) a stage; a stage may use what the ones before it found sound.

    The codes are fixed values of the package contract.
    """

    def __init__(self, root: str, profile: Profile):
        self.root, self.profile, self.manifest, self.entries, self.found, self.items = root, profile, {}, {}, {}, []

    def read(self, path: str, limit: int) -> bytes:
        """At most ``limit`` bytes of a plain file, through no link anywhere below the root, unchanged while it was read."""
        at = os.open(self.root, os.O_RDONLY | os.O_DIRECTORY)
        try:
            *folders, name = path.split("/")
            for part in folders:
                last, at = at, os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
                os.close(last)
            with open(os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=at), "rb") as f:
                before = os.fstat(f.fileno())
                if not stat.S_ISREG(before.st_mode):
                    raise OSError("no plain file")
                data = f.read(limit + 1)
                after = os.fstat(f.fileno())
        finally:
            os.close(at)
        if len(data) > limit or (before.st_ino, before.st_size, before.st_mtime_ns) != (after.st_ino, after.st_size, after.st_mtime_ns):
            raise OSError("changed or too large")
        return data

    def sound(self, path: str, limit: int) -> bytes:
        try:
            return self.read(path, limit)
        except OSError as e:
            raise _Unreadable(path) from e

    @staticmethod
    def parse(data: bytes):
        """(value, code of what is wrong)."""
        def unique(pairs):
            if len({k for k, _ in pairs}) < len(pairs):
                raise KeyError
            return dict(pairs)

        try:
            return json.loads(data.decode(), object_pairs_hook=unique), None
        except KeyError:
            return None, "duplicate-json-key"
        except (ValueError, RecursionError):
            return None, "invalid-manifest-json"

    def envelope(self):
        for name, limit in (("package.json", self.profile.manifest_bytes), ("package.sha256", self.profile.sidecar_bytes)):
            try:
                at = os.lstat(os.path.join(self.root, name))
            except OSError:
                yield "missing-required-file", name
                continue
            if not stat.S_ISREG(at.st_mode):
                yield "missing-required-file", name
            elif at.st_size > limit:
                yield "consumer-size-limit", name

    def sidecar_format(self):
        self.body = self.sound("package.json", self.profile.manifest_bytes)
        side = self.sound("package.sha256", self.profile.sidecar_bytes)
        self.address = side[:64].decode("ascii", "replace")
        if not re.fullmatch(rb"[0-9a-f]{64}\n", side):
            yield "invalid-sidecar-format", "package.sha256"

    def manifest_digest(self):
        if hashlib.sha256(self.body).hexdigest() != self.address:
            yield "manifest-digest-mismatch", "package.json"

    def manifest_parse(self):
        value, wrong = self.parse(self.body)
        if wrong:
            yield wrong, "package.json"
        elif P.json_depth(value) > self.profile.json_depth:
            yield "consumer-depth-limit", "package.json"
        elif not isinstance(value, dict):
            yield "invalid-manifest-shape", "package.json"
        else:
            self.manifest = value

    def compatibility(self):
        m, version = self.manifest, self.manifest.get("contract_version")
        parts = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", version) if isinstance(version, str) else None
        if m.get("contract_name") != self.profile.contract:
            yield "unsupported-contract-name", "contract_name"
        if not parts or int(parts[1]) not in self.profile.majors:
            yield "unsupported-contract-major", "contract_version"
        needs = m.get("required_capabilities", [])
        if not _texts(needs):
            yield "invalid-required-capabilities", "required_capabilities"
            return
        if set(needs) - set(self.profile.supports):
            yield "unknown-required-capability", "required_capabilities"
        if "collection_progress" in m:
            if "collection-progress" not in needs:
                yield "missing-collection-progress-capability", "required_capabilities"
            if not parts or tuple(map(int, parts.groups())) < (1, 1, 0):
                yield "unsupported-collection-progress-version", "contract_version"

    def path_safety(self):
        listed, folded = self.manifest.get("artifacts"), set()
        if not isinstance(listed, list) or not all(isinstance(e, dict) for e in listed):
            yield "invalid-inventory-shape", "artifacts"
            return
        for e in listed:
            path = e.get("path")
            same = path.casefold() if isinstance(path, str) else None
            if not isinstance(path, str) or not path or len(path) > self.profile.path_chars or "\\" in path or "\0" in path or any(x in ("", ".", "..") for x in path.split("/")) or path in P.ENVELOPE or same in folded:
                yield "unsafe-artifact-path", str(path)
                continue
            folded.add(same)
            if not _count(e.get("bytes")) or not isinstance(e.get("sha256"), str) or not re.fullmatch("[0-9a-f]{64}", e["sha256"]) or not isinstance(e.get("role"), str):
                yield "invalid-inventory-entry", path
            self.entries[path] = e

    def inventory_coverage(self):
        total, seen, stack = 0, 0, [""]
        folded: set[str] = set()
        while stack:
            folder = stack.pop()
            for x in sorted(os.scandir(os.path.join(self.root, folder)), key=lambda x: x.name):
                path, seen = (f"{folder}/{x.name}" if folder else x.name), seen + 1
                if seen > self.profile.entries:
                    yield "consumer-entry-limit", path
                    return
                at = x.stat(follow_symlinks=False)
                if stat.S_ISLNK(at.st_mode):
                    yield "symlink-not-allowed", path
                elif stat.S_ISDIR(at.st_mode):
                    stack.append(path)
                elif not stat.S_ISREG(at.st_mode):
                    yield "special-file-not-allowed", path
                elif at.st_nlink > 1:
                    yield "hard-link-not-allowed", path
                else:
                    if at.st_size > self.profile.file_bytes:
                        yield "consumer-file-limit", path
                    if path.casefold() in folded:
                        yield "case-collision", path
                    folded.add(path.casefold())
                    total += at.st_size
                    self.found[path] = at.st_size
        if total > self.profile.total_bytes:
            yield "consumer-total-limit", ""
        for path in sorted((self.found.keys() - set(P.ENVELOPE)) ^ self.entries.keys()):
            yield "inventory-coverage-mismatch", path

    def terminal_accounting(self):
        counts, paths = self.manifest.get("counts"), self.manifest.get("items")
        if isinstance(paths, list) and len(paths) > self.profile.items:
            yield "consumer-item-limit", "items"
            return
        if not isinstance(counts, dict) or counts.keys() != set(P.OUTCOMES) or not all(map(_count, counts.values())):
            yield "invalid-terminal-counts", "counts"
        if not _texts(paths) or not self.entries.keys() >= set(paths):
            yield "invalid-item-references", "items"
            return
        seen = dict.fromkeys(P.OUTCOMES, 0)
        for path in paths:
            item, wrong = self.parse(self.sound(path, self.profile.file_bytes))
            if wrong or not isinstance(item, dict):
                yield "invalid-item-record", path
            elif item.get("outcome") in seen:
                seen[item["outcome"]] += 1
                self.items.append((path, item))
        if seen != counts:
            yield "terminal-count-mismatch", "counts"
        elif self.manifest.get("status") != ("completed_with_errors" if seen["failed"] or seen["cancelled"] else "completed"):
            yield "terminal-status-mismatch", "status"

    def item_semantics(self):
        owner: dict[str, str] = {}
        for path, item in self.items:
            if not all(isinstance(item.get(k), str) and 0 < len(item[k]) <= 200 for k in ("item_id", "resource_kind")):
                yield "invalid-item-identity", path
            for k in ("requested_locator", "resolved_locator", "canonical_locator"):
                if item.get(k) is not None and not (isinstance(item[k], str) and len(item[k]) <= 2048):
                    yield "invalid-item-locator", path
            for k in ("artifacts", "diagnostics"):
                refs = item.get(k, [])
                if not _texts(refs) or len(refs) > 256:
                    yield "invalid-item-artifact-references", path
                    continue
                for r in refs:
                    if r not in self.entries or (self.entries[r].get("role") == "diagnostic") != (k == "diagnostics"):
                        yield "invalid-item-artifact-reference", path
                    elif owner.setdefault(r, path) != path:
                        yield "cross-item-artifact-reference", r
            kind, error = item["outcome"], item.get("error")
            if kind in ("completed", "unchanged") and error is not None:
                yield "contradictory-item-error", path
            if kind in ("failed", "cancelled") and not isinstance(error, dict):
                yield "missing-item-error", path
            if kind == "skipped" and not isinstance(item.get("skip_reason"), (str, dict)):
                yield "missing-skip-reason", path

    def lineage(self):
        m, resumes = self.manifest, self.manifest.get("resumes_run_id")
        if m.get("collection_progress") is not None and m["collection_progress"] not in [{"state": x} for x in P.PROGRESS]:
            yield "invalid-collection-progress", "collection_progress"
        named = isinstance(resumes, str) and resumes != ""
        if resumes is not None and not named:
            yield "invalid-resume-lineage", "resumes_run_id"
        prior: dict[str, list[str]] = {}
        for k in ("prior_run_ids", "prior_package_ids"):
            ids = m.get(k)
            if ids is not None and not (_texts(ids) and all(ids) and len(set(ids)) == len(ids)):
                yield "invalid-lineage-identifiers", k
            prior[k] = ids if _texts(ids) else []
        if m.get("run_id") and m["run_id"] in (resumes, *prior["prior_run_ids"]):
            yield "self-referential-lineage", "resumes_run_id"
        if m.get("package_id") and m["package_id"] in prior["prior_package_ids"]:
            yield "self-referential-lineage", "prior_package_ids"
        if named and resumes not in prior["prior_run_ids"]:
            yield "inconsistent-resume-lineage", "prior_run_ids"
        if named and not {"reconciliation_summary", "final_attempt_counts"} <= m.keys():
            yield "incomplete-resume-lineage", "resumes_run_id"
        for k in ("reconciliation_summary", "final_attempt_counts"):
            if m.get(k) is not None and not (isinstance(m[k], dict) and all(m[k]) and all(map(_count, m[k].values()))):
                yield "invalid-lineage-counts", k
        receipt = m.get("run_receipt")
        if receipt is None:
            return
        if not isinstance(receipt, str) or receipt not in self.entries:
            yield "invalid-run-receipt-reference", "run_receipt"
            return
        value, wrong = self.parse(self.sound(receipt, self.profile.file_bytes))
        if wrong:
            yield "invalid-run-receipt", receipt
        for k in sorted(P.LINEAGE) if isinstance(value, dict) else ():
            if k in value and k in m and value[k] != m[k]:
                yield "receipt-lineage-conflict", k

    def artifact_integrity(self):
        for path, e in sorted(self.entries.items()):
            data = self.sound(path, self.profile.file_bytes)
            if len(data) != e["bytes"]:
                yield "artifact-size-mismatch", path
            elif hashlib.sha256(data).hexdigest() != e["sha256"]:
                yield "artifact-digest-mismatch", path


def _texts(x) -> bool:
    return isinstance(x, list) and all(isinstance(y, str) for y in x)


def _count(x) -> bool:
    return type(x) is int and x >= 0


def verify(spark: SparkSession | None, root: str, supported: tuple[str, ...] = (), profile: Profile | None = None) -> dict:
    """State, failed stage, last completed stage, content address and all findings of the first failing stage of one package.

    Eleven stages in order (``operators.packages.STAGES``); ``indeterminate_io`` if a file of the package can't be read. A package is bounded by
    its profile and is read by the driver; many packages at once are checked by ``operators.packages.all_findings``.
    """
    profile = dataclasses.replace(profile or Profile(), supports=(*(profile or Profile()).supports, *supported))
    check, done, address = _Check(root, profile), None, None
    for stage in P.STAGES:
        try:
            findings = [f"{ref}: {code}" for code, ref in getattr(check, stage.replace("-", "_"))()]
        except (_Unreadable, OSError) as e:
            return {"state": "indeterminate_io", "failed_stage": stage, "last_completed_stage": done, "content_address": address, "findings": [f"{e}: unreadable"]}
        if findings:
            return {"state": "rejected", "failed_stage": stage, "last_completed_stage": done, "content_address": address, "findings": findings}
        done = stage
        address = check.address if stage == "manifest-digest" else address
    return {"state": "verified", "failed_stage": None, "last_completed_stage": "complete", "content_address": address, "findings": []}
