"""Run configuration (A29, D08, D15, E13, M01, M11): checked dataclasses from YAML or JSON, on the driver only."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Run types and the keys each part of a configuration may have.
RUN_TYPES = ("confluence", "local_files", "git_repo", "github_metadata", "public_webpage", "public_pdf", "bundle")
TOP, RUN, BUNDLE = {"runs", "bundles"}, {"name", "type", "enabled", "dry_run", "options"}, {"name", "runs", "output", "max_bytes", "order", "header_mode", "stale_mode"}


@dataclass(frozen=True)
class Run:
    index: int
    name: str
    type: str
    enabled: bool = True
    dry_run: bool = False
    options: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Bundle:
    name: str
    runs: tuple[str, ...]
    output: str
    max_bytes: int | None = None
    order: str = "canonical_id"
    header_mode: str = "minimal"
    stale_mode: str = "include"


def choose(strategies: Mapping[str, object], name: str, *, label: str):
    """A named strategy, or an error that lists the names."""
    if name not in strategies:
        raise ValueError(f"unknown {label} {name!r}; choose one of: {', '.join(sorted(strategies))}")
    return strategies[name]


def _known(given: Mapping, allowed: set[str], where: str) -> None:
    extra = set(given) - allowed
    if extra:
        raise ValueError(f"{where}: unknown keys {', '.join(sorted(map(str, extra)))}")


# The options each type of run takes, and those that are whole numbers of at least one.
OPTIONS: dict[str, set[str]] = {
    "confluence": {"base_url", "target", "output_dir", "space_key", "space_url", "ca_bundle_path", "fetch_cache_dir", "tree_cache_dir", "force_refresh", "clear_cache", "auth", "tree", "max_depth", "request_delay_ms", "max_requests_per_second"},
    "git_repo": {"repo_url", "output_dir", "ref", "include", "exclude", "subdir"},
    "github_metadata": {"repo", "output_dir", "base_url", "token_env", "resource_type", "state", "since", "max_items", "include_comments", "include_review_comments"},
    "local_files": {"file_path", "output_dir"}, "public_webpage": {"url", "output_dir"}, "public_pdf": {"url", "output_dir"}, "bundle": {"inputs", "output_path"},
}
NUMBERS = {"max_depth", "request_delay_ms", "max_requests_per_second", "max_items"}


def option_problem(kind: str, options: Mapping[str, object]) -> str | None:
    """What is wrong with a run's options: a key its type doesn't take, or a number that is none."""
    extra = set(options) - OPTIONS.get(kind, set(options))
    if extra:
        return f"unknown options {', '.join(sorted(extra))}"
    bad = sorted(k for k in NUMBERS & set(options) if not (str(options[k]).isdigit() and int(str(options[k])) >= (0 if k != "max_items" else 1)))
    return f"{bad[0]} must be a whole number" if bad else None


def load(path: str) -> tuple[list[Run], list[Bundle]]:
    """The runs and bundles of a file; every bundle's runs must exist, have an output folder and be no bundles."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("runs"), list) or not raw["runs"]:
        raise ValueError("runs must be a list that isn't empty")
    _known(raw, TOP, "configuration")
    runs = []
    for i, r in enumerate(raw["runs"]):
        _known(r, RUN, f"run {i + 1}")
        if r.get("type") not in RUN_TYPES or not isinstance(r.get("name"), str) or not r["name"]:
            raise ValueError(f"run {i + 1}: needs a name and one of the types {', '.join(RUN_TYPES)}")
        for k in ("enabled", "dry_run"):
            if not isinstance(r.get(k, False), bool):
                raise ValueError(f"run {i + 1}: {k} must be true or false")
        opts = {k: os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), v)) if k.endswith(("_dir", "_path")) else str(v) for k, v in (r.get("options") or {}).items()}
        if problem := option_problem(r["type"], opts):
            raise ValueError(f"run {i + 1}: {problem}")
        runs.append(Run(i, r["name"], r["type"], r.get("enabled", True), r.get("dry_run", False), opts))
    if len({r.name for r in runs}) != len(runs):
        raise ValueError("run names must not repeat")
    by = {r.name: r for r in runs}
    bundles = []
    for b in raw.get("bundles", []):
        _known(b, BUNDLE, f"bundle {b.get('name')}")
        for name in b["runs"]:
            if name not in by or by[name].type == "bundle" or "output_dir" not in by[name].options:
                raise ValueError(f"bundle {b['name']}: {name!r} is no run with an output folder")
        bundles.append(Bundle(**{**b, "runs": tuple(b["runs"])}))
    return runs, bundles


def frame(spark: SparkSession, runs: list[Run]) -> DataFrame:
    return spark.createDataFrame([(r.index, r.name, r.type, r.enabled, r.dry_run, dict(r.options)) for r in runs], "index int, name string, type string, enabled boolean, dry_run boolean, options map<string,string>")
