"""Resume checkpoints: bounded JSON with its invariants."""

from __future__ import annotations

import json
import os
import re

from lodestrata.operators.packages import canonical_json, json_depth

# Limits of the format.
MAX_BYTES, MAX_DEPTH, SCHEMA = 1 << 20, 8, "1.3.0"
HEX64 = re.compile(r"[0-9a-f]{64}")


def problems(state: dict, fingerprint: str) -> list[str]:
    """Every invariant a checkpoint breaks, in a fixed order."""
    seen, pending = state.get("observed", []), state.get("pending", [])
    done = state.get("completed", [])
    ids = [c.get("video_id") for c in done if isinstance(c, dict)]
    attempts = state.get("attempts", {})
    count = lambda n: isinstance(n, int) and not isinstance(n, bool) and 1 <= n <= 10
    rules = [
        ("schema version", state.get("schema") == SCHEMA), ("fingerprint", state.get("request_fingerprint") == fingerprint), ("observed ids repeat", len(set(seen)) == len(seen)), ("pending is no part of observed", set(pending) <= set(seen)),
        ("completed is no part of observed", set(ids) <= set(seen)), ("completed and pending overlap", not set(ids) & set(pending)), ("completed ids repeat", len(set(ids)) == len(ids) == len(done)),
        ("attempts out of range", all(map(count, attempts.values()))), ("digest malformed", all(HEX64.fullmatch(str(c.get(k, ""))) for c in done if isinstance(c, dict) for k in ("captured_sha256", "normalized_sha256"))),
        ("prior runs repeat", len(set(state.get("prior_run_ids", []))) == len(state.get("prior_run_ids", []))), ("run is its own prior", state.get("run_id") not in state.get("prior_run_ids", []))]
    return [name for name, ok in rules if not ok]


def load(path: str, fingerprint: str) -> dict:
    """The checkpoint, or ValueError with all it breaks."""
    if os.path.getsize(path) > MAX_BYTES:
        raise ValueError("checkpoint too large")
    with open(path, "rb") as f:
        state = json.loads(f.read())
    if not isinstance(state, dict) or json_depth(state) > MAX_DEPTH:
        raise ValueError("checkpoint is no object or nested too deeply")
    bad = problems(state, fingerprint)
    if bad:
        raise ValueError("; ".join(bad))
    return state


def save(state: dict, path: str) -> None:
    """Canonical JSON, written beside its place and renamed."""
    data = canonical_json(state | {"schema": SCHEMA})
    if len(data) > MAX_BYTES or json_depth(state) > MAX_DEPTH:
        raise ValueError("checkpoint too large")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "wb") as f:
        f.write(data)
    os.replace(f"{path}.tmp", path)
