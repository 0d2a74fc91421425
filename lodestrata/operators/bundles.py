"""Bundles of many manifests: union, first-wins, filters, changed-only, stale marks, order, sections, split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestrata.functions.text import any_match, byte_length, col, rstrip
from lodestrata.operators.hierarchy import running_offsets
from lodestrata.session import cut, rows

# Fixed value: what stands between two sections of a bundle.
SEPARATOR = "\n\n---\n\n"
MATCHED = ["canonical_id", "title", "output_path", "source_url"]


def numbered(entries: DataFrame, on: list[str]) -> DataFrame:
    """``place`` 1 for the first entry of an id in (input_index, entry_index) order, 2.. for its duplicates.

    The window's group is one id of one bundle, so it is as large as the number of inputs that list the id.
    """
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(*on, "canonical_id").orderBy("input_index", "entry_index")))


def first_wins(entries: DataFrame, on: list[str]) -> DataFrame:
    """The entry that counts of each id: an aggregate (combined before the shuffle), not a window."""
    rest = [c for c in entries.columns if c not in (*on, "canonical_id")]
    return entries.groupBy(*on, "canonical_id").agg(F.min_by(F.struct(*rest), F.struct("input_index", "entry_index")).alias("_e")).select(*on, "canonical_id", "_e.*")


def globbed(entries: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Any include pattern (if there are any) on any of four columns, then none of the exclude patterns."""
    keep = any_match(MATCHED, include) if include else F.lit(True)
    return entries.where(keep & ~any_match(MATCHED, exclude))


def changed_only(current: DataFrame, baseline: DataFrame, on: list[str]) -> DataFrame:
    """Entries that the baseline lacks, whose baseline file is missing, or whose hash differs.

    Both sides may carry ``file_hash``, the hash of the file's bytes, for entries without ``content_hash``.
    """
    h = lambda df, p="": F.coalesce(*[F.col(c) for c in ("content_hash", "file_hash") if c in df.columns])
    base = baseline.select(*on, "canonical_id", h(baseline).alias("_h"), F.lit(True).alias("_there"))
    j = current.join(base, [*on, "canonical_id"], "left")
    return j.where(F.col("_there").isNull() | F.col("_h").isNull() | ~F.coalesce(h(current) == F.col("_h"), F.lit(False))).select(*current.columns)


def stale_marked(entries: DataFrame, stale: DataFrame, on: list[str]) -> DataFrame:
    """``is_stale`` if the entry says so or its (id, path) is in the stale list."""
    s = stale.select(*on, "canonical_id", "output_path", F.lit(True).alias("_s")).distinct()
    return entries.join(s, [*on, "canonical_id", "output_path"], "left").withColumn("is_stale", F.coalesce("is_stale", F.lit(False)) | F.coalesce("_s", F.lit(False))).drop("_s")


def stale_appended(entries: DataFrame, stale: DataFrame, on: list[str]) -> DataFrame:
    """Stale rows that have a source URL and neither id nor path of an entry, first by id, then by path; columns of ``stale``."""
    s = stale.where("source_url IS NOT NULL AND source_url <> ''")
    s = s.join(entries.select(*on, "canonical_id").distinct(), [*on, "canonical_id"], "left_anti").join(entries.select(*on, "output_path").distinct(), [*on, "output_path"], "left_anti").select(*stale.columns)
    rest = lambda k: [c for c in stale.columns if c not in (*on, k)]
    for k in ("canonical_id", "output_path"):
        s = s.groupBy(*on, k).agg(F.min(F.struct("entry_index", *[c for c in rest(k) if c != "entry_index"])).alias("_e")).select(*on, k, "_e.*").select(*stale.columns)
    return s


def without_stale(entries: DataFrame, metadata_available: Column, mode: str) -> DataFrame:
    """Stale entries go only if the mode is ``exclude`` and stale metadata exists at all."""
    return entries.where(~(F.col("is_stale") & metadata_available)) if mode == "exclude" else entries


def ordered(entries: DataFrame, on: list[str], order: str = "canonical_id") -> DataFrame:
    """``position`` from 1 in the bundle, without one task per bundle. Input order and manifest order are the same here."""
    keys = {"canonical_id": ["canonical_id"], "manifest": ["input_index", "entry_index", "canonical_id"], "input": ["input_index", "entry_index", "canonical_id"]}[order]
    k = F.to_json(F.struct(*on)) if len(on) != 1 else F.col(on[0])
    return running_offsets(entries.withColumn("_k", k).withColumn("_one", F.lit(1).cast("bigint")), "_k", keys, "_one", "_o").withColumn("position", F.col("_o") + 1).drop("_k", "_one", "_o")


def section(*, title, canonical_id, source_url, content, is_stale=None, fetched_at=None, path=None, ref=None, header: str = "full", flag_stale: bool = True) -> Column:
    """One bundle section; absent lines are nulls, which the join leaves out."""
    opt = lambda label, v: F.when(F.coalesce(col(v).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), col(v).cast("string")))
    lines = [F.concat(F.lit("## "), F.coalesce(F.nullif(col(title), F.lit("")), col(canonical_id), F.lit(""))), F.concat(F.lit("source_url: "), F.coalesce(col(source_url), F.lit("")))]
    if flag_stale:
        lines.append(F.when(col(is_stale).cast("boolean"), F.lit("stale: true")))
    if header == "full":
        lines += [F.concat(F.lit("canonical_id: "), F.coalesce(col(canonical_id), F.lit(""))), opt("fetched_at", fetched_at), opt("path", path), opt("ref", ref)]
    return rstrip(F.concat_ws("\n", *lines, F.lit(""), rstrip(F.coalesce(col(content), F.lit("")), "\\n")))


def _exits(max_bytes: int, blocks: int):
    """Per block of consecutive sections: where a file that starts at each of them ends, and where its block is left."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = key[1]
        pdf = pdf.sort_values("no")
        no, s, e, own = pdf["no"].to_numpy(), pdf["s"].to_numpy(), pdf["e"].to_numpy(), pdf["own"].to_numpy()
        # A file from section i takes all up to the last whose end is within the limit, and at least its own.
        nxt = np.maximum(np.searchsorted(e, s + max_bytes + len(SEPARATOR) - 1, "right"), np.arange(len(no)) + 1)
        ids = np.append(no, no[-1] + 1)
        n_own = int(own.sum())
        leave = nxt.copy()
        for i in range(n_own - 1, -1, -1):
            if nxt[i] < n_own:
                leave[i] = leave[nxt[i]]
        return pd.DataFrame({"k": key[0], "no": no[:n_own], "nxt": ids[nxt[:n_own]], "leave": ids[leave[:n_own]], "block": b})

    return run


def split(sections: DataFrame, on: str, *, max_bytes: int, size: str = "n_bytes", position: str = "position") -> DataFrame:
    """Greedy next-fit of ordered sections into files of at most ``max_bytes``; adds ``file_no`` (from 1) and ``oversized``.

    A file of n sections has their bytes, 7 for each of n-1 separators and 1 for the last line end. A section larger than
    that gets a file of its own. Never one task per bundle: byte offsets are running sums; in blocks of 16 files' worth of bytes each
    section's next file start is searched; starts are then marked by doubling over the blocks, and counted by running sums.
    """
    sep = len(SEPARATOR)
    base = sections.withColumn("_c", F.col(size) + sep)
    base = cut(running_offsets(base, on, position, "_c", "_s"))
    span = 16 * max_bytes
    items = base.select(F.col(on).alias("k"), F.col(position).alias("no"), F.col("_s").alias("s"), (F.col("_s") + F.col("_c")).alias("e"))
    block = F.floor(F.col("s") / span)
    # The first sections of a block are also seen by the blocks before it that a file may reach in from.
    seen = items.withColumn("block", block).withColumn("own", F.lit(True)).unionByName(
        items.withColumn("block", block - 1).withColumn("own", F.lit(False)).where(f"block >= 0 AND s - (block + 1) * {span} <= {max_bytes + sep}"))
    nxt = cut(seen.groupBy("k", "block").applyInPandas(_exits(max_bytes, 16), "k string, no bigint, nxt bigint, leave bigint, block bigint"))
    jump = nxt.select("k", F.col("no").alias("v"), F.col("leave").alias("a"))
    marked = cut(items.groupBy("k").agg(F.min("no").alias("v")))
    n = 0
    while True:
        jump_n = jump.select("k", F.col("v").alias("_v"), "a")
        marked_next = cut(marked.join(jump_n, (marked.k == jump_n.k) & (F.col("v") == F.col("_v"))).select(marked.k, F.col("a").alias("v")).unionByName(marked).distinct())
        m = rows(marked_next)
        marked = marked_next
        if m == n:
            break
        n = m
        x, y = jump.alias("x"), jump.alias("y")
        jump = cut(x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.a") == F.col("y.v"))).select(F.col("x.k").alias("k"), F.col("x.v").alias("v"), F.col("y.a").alias("a")))
    # Inside a block the starts follow from the first one.
    starts = _inner_starts(nxt, marked)
    flagged = base.join(starts.select(F.col("k").alias(on), F.col("v").alias(position), F.lit(1).cast("bigint").alias("_f")), [on, position], "left").withColumn("_f", F.coalesce("_f", F.lit(0).cast("bigint")))
    out = running_offsets(flagged.drop("_s", "_c"), on, position, "_f", "_n")
    return out.withColumn("file_no", F.col("_n") + F.col("_f")).withColumn("oversized", F.col(size) + 1 > max_bytes).drop("_n", "_f")


def _inner_starts(nxt: DataFrame, marked: DataFrame) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        at = dict(zip(pdf["no"], pdf["nxt"]))
        out = set()
        for v in pdf.loc[pdf["hit"], "no"]:
            while v in at and v not in out:
                out.add(v)
                v = at[v]
        return pd.DataFrame({"k": key[0], "v": sorted(out)}, dtype=None).astype({"v": "int64"})

    hit = marked.select("k", F.col("v").alias("no"), F.lit(True).alias("hit")).distinct()
    return nxt.join(hit, ["k", "no"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))).groupBy("k", "block").applyInPandas(run, "k string, v bigint")
