"""Breadth-first walks over parent-child links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut, release, rows


def walk(links: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth) of the pages met level by level from each root; the shortest depth counts, cycles end.

    ``links``: (parent, child); ``roots``: (root), each at depth 0. One shuffle join a level; levels stop at ``max_depth``.
    Nulls are no pages. An empty frame of roots gives an empty frame.
    """
    links = cut(links.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct())
    levels = [cut(roots.where("root IS NOT NULL").select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct())]
    depth = 0
    while rows(levels[-1]) and (max_depth is None or depth < max_depth):
        depth += 1
        seen = levels[0]
        for x in levels[1:]:
            seen = seen.unionByName(x)
        step = levels[-1].join(links, F.col("id") == F.col("parent")).select("root", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct()
        levels.append(cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti")))
        if depth % 16 == 0:  # keep the union short on deep trees
            whole = levels[0]
            for x in levels[1:-1]:
                whole = whole.unionByName(x)
            whole = cut(whole)
            release(*levels[:-1])
            levels = [whole, levels[-1]]
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def listing(pages: DataFrame, space: str, key: str) -> DataFrame:
    """The distinct ids of each space, with their place in lexical order counted by ``ordered`` where needed."""
    return pages.where(F.col(key).isNotNull()).select(space, key).distinct()
