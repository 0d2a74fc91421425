"""Filling containers of a fixed capacity with texts, by minimum bin slack over the histogram of lengths.

Two items of one length are interchangeable, so the search runs on how many items there are of each length: at most
``capacity`` + 1 numbers, however many documents there are. Per container a bitset subset-sum over the lengths still
available finds the fullest combination; it is taken as often as the counts allow, which is what repeating the search
container by container would do. Items are then numbered within their length, spread over the cluster, and each number
falls into one combination's range, which names its container.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.hierarchy import running_offsets
from lodestrata.session import cut

MAX_PACKS = 1000


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, copies) whose sum comes closest to ``room`` from below; longer lengths are tried first."""
    reach, stages, full = 1, [], 1 << room
    mask = (full << 1) - 1
    for s in order:
        c = min(counts[s], room // s)
        if not c:
            continue
        stages.append((s, c, reach))
        step, left = 1, c
        while left:
            step = min(step, left)
            reach |= (reach << (s * step)) & mask
            left -= step
            step *= 2
        if reach & full:
            break
    total = reach.bit_length() - 1
    chosen = []
    for s, c, before in reversed(stages):
        j = 0
        while not (before >> total) & 1:
            j += 1
            total -= s
        if j:
            chosen.append((s, j))
    return chosen


def solve(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges ``(length, first rank, first container, copies per container)`` and the number of containers.

    Every container starts from the longest item left, so none is left for last. Ranks of a length count from 0; a range
    ends where the next of its length begins.
    """
    counts = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    used = dict.fromkeys(counts, 0)
    order = sorted(counts, reverse=True)
    ranges, bins = [], 0
    while order:
        top = order[0]
        counts[top] -= 1
        chosen = dict(fullest(counts, order, capacity - top)) if capacity > top else {}
        counts[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        times = min(counts[s] // k for s, k in chosen.items())
        for s, k in chosen.items():
            ranges.append((s, used[s], bins, k))
            used[s] += k * times
            counts[s] -= k * times
        bins += times
        order = [s for s in order if counts[s]]
    return ranges, bins


def pack(sizes: DataFrame, capacities: list[tuple[str, int]], *, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """Every item in a container of each capacity: ``pack_name, container_no, <id>, piece_no, first_token, n_tokens``.

    Only an item longer than the capacity is split, into full pieces and a rest. An item of no tokens (null, empty) needs no
    room and goes to the containers in turn, container 1 if there is no other. Containers count from 1. A null size is 0.
    The item ids must be unique. Capacities must be positive; there may be at most ``MAX_PACKS`` of them.
    """
    if len(capacities) > MAX_PACKS or any(c is None or c < 1 for _, c in capacities):
        raise ValueError("capacities must be positive, and at most MAX_PACKS")
    if not capacities:
        return sizes.select(F.lit(None).cast("string").alias("pack_name"), F.lit(0).cast("bigint").alias("container_no"), id_col, F.lit(0).alias("piece_no"),
                            F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n_tokens")).where(F.lit(False))
    packs = F.array(*[F.struct(F.lit(i).alias("pk"), F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("cap")) for i, (n, c) in enumerate(capacities)])
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    pieces = (sizes.select(F.col(id_col).alias("id"), F.col(size_col).alias("n")).select("id", n.alias("n"), F.explode(packs).alias("p")).select("id", "n", "p.*")
              .withColumn("piece_no", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("cap"))).cast("int"))))
              .withColumn("first_token", (F.col("piece_no") - 1) * F.col("cap")).withColumn("size", F.least(F.col("cap"), F.col("n") - F.col("first_token"))))
    pieces = pieces.withColumn("k", F.col("pk") * F.lit(1 << 40) + F.col("size")).withColumn("one", F.lit(1).cast("bigint"))
    # At most capacity + 1 rows a pack reach the driver: the counts by length, none of the items.
    hist: list[dict[int, int]] = [{} for _ in capacities]
    for r in pieces.groupBy("pk", "size").count().collect():
        hist[r["pk"]][r["size"]] = r["count"]
    tables, bins = {}, []
    for i, (_, c) in enumerate(capacities):
        ranges, b = solve(hist[i], c)
        bins.append(max(1, b))
        for s, first, start, per in ranges:
            tables.setdefault((i << 40) + s, []).append((first, start, per))
        tables[i << 40] = [(0, -1, bins[-1])]
    look = {k: tuple(np.array(x, np.int64) for x in zip(*sorted(v))) for k, v in tables.items()}
    shared = sizes.sparkSession.sparkContext.broadcast(look)

    def place(k: pd.Series, rank: pd.Series) -> pd.Series:
        keys, ranks = k.to_numpy(), rank.to_numpy()
        out = np.zeros(len(keys), np.int64)
        for key in np.unique(keys):
            at = np.flatnonzero(keys == key)
            first, start, per = shared.value[int(key)]
            r = ranks[at]
            i = np.searchsorted(first, r, "right") - 1
            out[at] = np.where(start[i] < 0, r % per[i], start[i] + (r - first[i]) // per[i]) + 1
        return pd.Series(out)

    ranked = running_offsets(pieces, "k", ["id", "piece_no"], "one", "rank")
    return ranked.select("pack_name", F.pandas_udf(place, "bigint")("k", "rank").alias("container_no"), F.col("id").alias(id_col), "piece_no", "first_token", F.col("size").alias("n_tokens"))


def packed_summary(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, the least containers that the tokens need, and the unused space."""
    per = packed.groupBy("pack_name", "container_no").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return capacities.select("pack_name", "capacity_tokens").distinct().join(per, "pack_name", "left").select(
        "pack_name", "capacity_tokens", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).alias("unused_tokens"))
