"""Parent-child links to full hierarchies: cycles, paths, depths, roots and descendants.

Everything runs on (parent, child) link frames in O(log depth) join rounds; no step needs a whole tree in one task.

* ``cyclic_links`` separates cycles. Nodes with one parent are contracted into the nearest ancestor with another number
  of parents by pointer doubling; what remains is a much smaller graph between nodes of several parents. One task solves it
  if its counted links stay below a bound; beyond that it is contracted again with its links turned round, and so on. Results are carried back down the levels. What contraction does not
  shrink goes by reachability over jumps of doubling length (``_cyclic_by_colour``).
* ``hierarchy`` then labels the forest by heavy-path decomposition: subtree sizes (doubling sums), the heavy child of
  each node, chains; a path is the concatenation of chain segments, and preorder numbers that run down each chain first
  make the descendants of a node one interval of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut, release, scoped
from lodestrata.session import rows as _rows

# Links of the contracted graph that one task takes: some 100 bytes each in its memory.
ONE_TASK_LINKS = 500_000


def current_rows(pages: DataFrame) -> DataFrame:
    """The row that counts of each id: highest version (null lowest), then latest fetch, then a fixed order of content.

    Rows without an id are dropped. Ties in version and time are decided by the greater child list, so that repeated
    rows and any row order give the same result. The child list is cleaned (blanks, nulls, repeats, padding) before the
    shuffle and rides along in the aggregate, which is combined map-side; other columns of the input are ignored.
    """
    # The code points that Unicode calls white space, plus the four ASCII separators Python strips.
    ws = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    strip = lambda c: F.regexp_replace(c, f"^{ws}|{ws}\\z", "")
    kids = F.array_sort(F.array_distinct(F.filter(F.transform(
        F.coalesce("child_page_ids", F.array().cast("array<string>")), strip), lambda c: c.isNotNull() & (c != ""))))
    return (
        pages.where(F.col("id").isNotNull())
        .select("id", F.col("version").alias("v"), F.col("fetched_at").alias("f"), kids.alias("kids"))
        .groupBy("id")
        .agg(F.max(F.struct(F.col("v").isNotNull().alias("h"), "v", F.col("f").isNotNull().alias("g"), "f", "kids")).alias("m"))
        .select("id", F.col("m.kids").alias("kids"))
    )


def page_links(current: DataFrame) -> DataFrame:
    """Distinct (parent, child) links whose child is the id of some current row."""
    links = current.select(F.col("id").alias("parent"), F.explode("kids").alias("child"))
    return links.join(current.select(F.col("id").alias("child")), "child", "left_semi").select("parent", "child")


def _jump_tables(pointer: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Doubling over single-parent pointers ``(v, p)``; p may lie outside the set of v (then it is a top).

    Returns the tables J_k of ``(v, a)`` with a the 2^k-th ancestor, for the v that reach no top before it; the settled
    ``(v, top)``; and the last table, whose v never reach a top (they lie on or below a pure cycle).
    The depths in a tree have no gaps, so an unchanged number of unsettled rows means that only those are left.
    """
    active = cut(pointer.select("v", F.col("p").alias("a")))
    tables, n = [active], _rows(active)
    settled = active.where(F.lit(False)).select("v", F.col("a").alias("top"))
    while n:
        # The ancestor is a top itself (it has no row), has a top, or has an ancestor as far up again.
        seen = active.select(F.col("v").alias("y"), F.col("a").alias("ya"), F.lit(True).alias("act")).unionByName(
            settled.select(F.col("v").alias("y"), F.col("top").alias("ya"), F.lit(False).alias("act")))
        hop = cut(active.join(seen, F.col("a") == F.col("y"), "left").select("v", F.coalesce("ya", "a").alias("a"), F.coalesce("act", F.lit(False)).alias("act")), counted=F.col("act"))
        settled = settled.unionByName(hop.where("NOT act").select("v", F.col("a").alias("top")))
        active, before, n = hop.where("act").select("v", "a"), n, _rows(hop)
        if n == before or n == 0:
            break
        tables.append(active)
    return tables, settled, active


def _on_pure_cycles(left: DataFrame) -> DataFrame:
    """Ids on cycles of nodes that all have one parent: the image of ever longer jumps shrinks to exactly these."""
    t, image = left, cut(left.select(F.col("a").alias("v")).distinct())
    n = _rows(image)
    while n:
        t2 = cut(t.alias("x").join(t.alias("y"), F.col("x.a") == F.col("y.v")).select(F.col("x.v").alias("v"), F.col("y.a").alias("a")))
        nxt = cut(t2.select(F.col("a").alias("v")).distinct())
        m = _rows(nxt)
        release(image)
        image, t = nxt, t2
        if m == n:
            break
        n = m
    return image


@scoped
def _cyclic_by_colour(edges: DataFrame, *, growth: int = 4) -> DataFrame:
    """The links ``(src, dst)`` on cycles of a graph that contraction does not shrink; links from a node to itself are left out.

    Jumps of 1, 2, 4, ... links are joined from shorter ones, as long as a length has at most ``growth`` times as many jumps
    as there are links. In each turn every node learns the highest-ranked node that reaches it and the highest-ranked one it
    reaches (one pass from the longest jumps to the shortest; more passes only if long jumps were given up). Both ends of a
    link on a cycle learn the same two, so other links go; where the two are one node, its component is found. Ranks are
    hashes drawn anew each turn: the parts shrink geometrically, whatever the shape of the graph.
    """
    step = cut(edges.where("src <> dst").select("src", "dst").distinct().withColumn("k", F.lit(0)))
    n = _rows(step)
    if not n:
        return cut(step.select("src", "dst"))
    levels, whole = [step], False
    while True:
        y = step.select(F.col("src").alias("via"), F.col("dst").alias("far"))
        step = cut(step.join(y, F.col("dst") == F.col("via")).where("src <> far").select("src", F.col("far").alias("dst")).distinct().withColumn("k", F.lit(len(levels))))
        m = _rows(step)
        whole = m == 0 or 2 ** len(levels) > n
        if whole or m > growth * n:
            break
        levels.append(step)
    jumps = levels[0]
    for x in levels[1:]:
        jumps = jumps.unionByName(x)
    found, turn, ks = None, 0, range(len(levels))
    while True:
        v = F.col("v")
        rank = F.struct(F.xxhash64(F.lit(turn), v).alias("h"), v.alias("v"))
        ends = jumps.where("k = 0")
        label = cut(ends.select(F.col("src").alias("v")).union(ends.select("dst")).distinct().select("v", rank.alias("f"), rank.alias("b"), F.lit(True).alias("moved")))
        none = F.lit(None).cast(label.schema["f"].dataType)
        while True:
            moved = 0
            for k in sorted(ks, reverse=True):
                hop = jumps.where(F.col("k") == k)
                told = (hop.join(label, F.col("src") == v).select(F.col("dst").alias("to"), F.col("f").alias("nf"), none.alias("nb"))
                        .unionByName(hop.join(label, F.col("dst") == v).select(F.col("src").alias("to"), none.alias("nf"), F.col("b").alias("nb")))
                        .groupBy("to").agg(F.max("nf").alias("nf"), F.max("nb").alias("nb")))
                last, label = label, cut(label.join(told, v == F.col("to"), "left").select(
                    "v", F.greatest("f", "nf").alias("f"), F.greatest("b", "nb").alias("b"), (F.coalesce(F.col("nf") > F.col("f"), F.lit(False)) | F.coalesce(F.col("nb") > F.col("b"), F.lit(False))).alias("moved")), counted=F.col("moved"))
                release(last)
                moved += _rows(label)
            if whole or not moved:
                break
        a, b = (label.select(v.alias(end), F.col("f").alias(f"f_{end}"), F.col("b").alias(f"b_{end}")) for end in ("src", "dst"))
        jumps = cut(jumps.join(a, "src").join(b, "dst").where("f_src = f_dst AND b_src = b_dst").select("k", "src", "dst", (F.col("f_src") == F.col("b_src")).alias("closed")))
        here = jumps.where("k = 0 AND closed").select("src", "dst")
        found = here if found is None else found.unionByName(here)
        jumps = jumps.where("NOT closed").select("k", "src", "dst")
        ks = [r["k"] for r in jumps.select("k").distinct().collect()]  # at most one row a power of two
        if 0 not in ks:
            return cut(found)
        turn += 1


def _components_of(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """The number of each node's strongly connected component, by one depth-first walk that keeps its own stack."""
    order = np.argsort(src, kind="stable")
    to, first = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    seen, low, comp, stack, count, found = [0] * n, [0] * n, [-1] * n, [], 0, 0
    for root in range(n):
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        stack.append(root)
        walk = [(root, first[root])]
        while walk:
            v, i = walk[-1]
            if i < first[v + 1]:
                walk[-1] = (v, i + 1)
                w = to[i]
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    stack.append(w)
                    walk.append((w, first[w]))
                elif comp[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            walk.pop()
            if walk:
                u = walk[-1][0]
                low[u] = min(low[u], low[v])
            if low[v] == seen[v]:
                while True:
                    w = stack.pop()
                    comp[w] = found
                    if w == v:
                        break
                found += 1
    return np.array(comp, np.int64)


def _cyclic_in_one_task(edges: DataFrame) -> DataFrame:
    """The links ``(src, dst)`` on cycles of a graph whose number of links the caller has checked; no link from a node to itself is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict = {}
        parts = [[np.array([number.setdefault(x, len(number)) for x in c.to_pylist()], np.int64) for c in b.columns] for b in batches]
        if not parts:
            return
        src, dst = (np.concatenate(x) for x in zip(*parts))
        comp = _components_of(src, dst, len(number))
        names, keep = list(number), np.flatnonzero((comp[src] == comp[dst]) & (src != dst))
        kind = pa.string() if not names or isinstance(names[0], str) else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in c[keep]], kind) for c in (src, dst)], ["src", "dst"])

    kinds = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("src", "dst"))
    return cut(edges.select("src", "dst").coalesce(1).mapInArrow(run, kinds))


@scoped
def cyclic_links(links: DataFrame, *, src: str = "parent", dst: str = "child", one_task: int = ONE_TASK_LINKS, _stuck: int = 0) -> DataFrame:
    """The links that lie on a cycle, a link from a node to itself included; columns ``src`` and ``dst``.

    What the first contraction leaves is solved in one task if it has at most ``one_task`` links (0 for never), else by further rounds; the
    result is the same.

    A node is on a cycle exactly when one of these links ends in it. Nulls on either side are no links; repeated links
    count once; an empty frame gives an empty frame.
    """
    edges = cut(links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    loops = edges.where("src = dst")
    plain = edges.where("src <> dst")
    parents = cut(plain.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("p")))
    if not _rows(parents):
        return cut(loops)
    single = parents.where("n = 1").select(F.col("dst").alias("v"), "p")
    heads = parents.where("n > 1").select(F.col("dst").alias("head"))
    jumps, settled, left = _jump_tables(single)
    ring = _on_pure_cycles(left)
    out = loops.unionByName(single.join(ring, "v", "left_semi").select(F.col("p").alias("src"), F.col("v").alias("dst")))

    # Links into nodes of several parents, with the node that their source was contracted into.
    into = plain.join(heads.withColumnRenamed("head", "dst"), "dst", "left_semi")
    home = settled.select(F.col("v").alias("src"), "top").unionByName(heads.select(F.col("head").alias("src"), F.col("head").alias("top")))
    between = cut(into.join(home, "src").join(heads.withColumnRenamed("head", "top"), "top", "left_semi").select("src", "dst", "top"))
    pairs = cut(between.where("top <> dst").select(F.col("top").alias("a"), F.col("dst").alias("b")).distinct())
    n, before = _rows(pairs), _rows(edges)
    if n:
        small = 4 * n <= 3 * before
        if n <= one_task:
            inner = _cyclic_in_one_task(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("src").alias("a"), F.col("dst").alias("b"))
        elif not small and _stuck >= 1:  # contraction has to pay, or its levels would be as many as the graph is long
            inner = _cyclic_by_colour(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
            inner = inner.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        else:
            turned = cyclic_links(pairs, src="b", dst="a", one_task=one_task, _stuck=0 if small else _stuck + 1)
            inner = turned.select(F.col("dst").alias("a"), F.col("src").alias("b"))
        closed = between.join(inner.select(F.col("a").alias("top"), F.col("b").alias("dst")), ["top", "dst"], "left_semi").select("src", "dst", "top")
    else:
        closed = between.where(F.lit(False))
    closed = cut(closed.unionByName(between.where("top = dst")))
    out = out.unionByName(closed.select("src", "dst"))

    # Every contracted node between such a link's source and its top lies on the cycle too.
    marked = cut(closed.select(F.col("src").alias("v")).distinct())
    for j in jumps:
        # Written at each step: the set is used twice, and unwritten plans would double with every table.
        last, marked = marked, cut(marked.unionByName(marked.join(j, "v").select(F.col("a").alias("v"))).distinct())
        release(last)
    up = single.join(marked, "v", "left_semi").select(F.col("p").alias("src"), F.col("v").alias("dst"))
    return cut(out.unionByName(up).distinct())


def cycle_members(links: DataFrame) -> DataFrame:
    """Distinct ids of the nodes on a cycle of (parent, child) links; column ``id``."""
    return cyclic_links(links).select(F.col("dst").alias("id")).distinct()


def _climb(nodes: DataFrame, weight: Column | None, join_weights) -> DataFrame:
    """Doubling over ``nodes(v, p, w, size)``: (v, top, dist, acc, act, size) with acc the weights from below the top to v.

    ``join_weights(upper, lower)`` must be associative. ``size`` becomes the sum of ``size`` over the subtree of v.
    """
    state = cut(nodes.select("v", F.coalesce("p", "v").alias("top"), F.col("p").isNotNull().cast("int").alias("dist"),
                             weight.alias("acc"), F.col("p").isNotNull().alias("act"), "size"), counted=F.col("act"))
    while _rows(state):
        t = state.select(F.col("v").alias("tv"), F.col("top").alias("tt"), F.col("dist").alias("td"), F.col("acc").alias("ta"), F.col("act").alias("tact"))
        sums = state.where("act").groupBy(F.col("top").alias("sv")).agg(F.sum("size").alias("more"))
        moved = (state.where("act").join(t, F.col("top") == F.col("tv"))
                 .select("v", F.col("tt").alias("top"), (F.col("dist") + F.col("td")).alias("dist"),
                         join_weights(F.col("ta"), F.col("acc")).alias("acc"), F.col("tact").alias("act"), "size"))
        nxt = cut(state.where("NOT act").unionByName(moved).join(sums, F.col("v") == F.col("sv"), "left")
                  .select("v", "top", "dist", "acc", "act", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), counted=F.col("act"))
        release(state)
        state = nxt
    return state


def running_offsets(df: DataFrame, key: str, order: str | list[str], value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over the rows of the same key that come before in ``order``, without a one-task group.

    Rows are range-partitioned by (key, order), so a hot key spreads over many tasks; each task sums its own part, and
    the parts' totals (one row per key and task) are added in front. Rows with a null key or order form groups of their own.
    """
    from pyspark.sql import Window

    order = [order] if isinstance(order, str) else order
    parts = cut(df.repartitionByRange(key, *order).withColumn("__run_part", F.spark_partition_id()))
    local = Window.partitionBy("__run_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("__run_part", key).agg(F.sum(value).alias("__run_total"))
    before = totals.select(F.col("__run_part").alias("__run_bp"), F.col(key).alias("__run_bk"), F.coalesce(
        F.sum("__run_total").over(Window.partitionBy(key).orderBy("__run_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__run_before"))
    return (parts.withColumn("__run_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
            .join(before, (F.col("__run_part") == F.col("__run_bp")) & F.col(key).eqNullSafe(F.col("__run_bk")))
            .withColumn(out, F.col("__run_local") + F.col("__run_before")).drop("__run_part", "__run_local", "__run_bp", "__run_bk", "__run_before"))


def hierarchy(current: DataFrame) -> DataFrame:
    """One row per page: parent, root, depth, path, descendants as an interval of numbers, cycle marks.

    Input: ``current_rows`` (id, kids). Links on cycles are taken out first; of several remaining parents the smallest id is
    the page's place in the tree. Columns: ``id, parent, root, depth, path (array from the root), n_descendants,
    first_no, last_no, on_cycle``. Numbers are preorder within the root's tree, the heavy child first: the page itself
    is ``first_no``, its descendants are the pages of the same root with numbers in (first_no, last_no].
    An empty table gives an empty frame.
    """
    current = cut(current)
    links = cut(page_links(current))
    cyc = cyclic_links(links)
    kept = links.join(cyc.select(F.col("src").alias("parent"), F.col("dst").alias("child")), ["parent", "child"], "left_anti")
    up = kept.groupBy("child").agg(F.min("parent").alias("p"))
    forest = cut(current.select(F.col("id").alias("v")).join(up, F.col("v") == F.col("child"), "left").select("v", "p"))
    on = cyc.select(F.col("dst").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    return _numbered(forest).join(on, "id", "left").withColumn("on_cycle", F.coalesce("on_cycle", F.lit(False)))


def _numbered(forest: DataFrame) -> DataFrame:
    """The columns of ``hierarchy`` but ``on_cycle``, from a forest ``(v, p)`` with one row a node and p null at the roots."""
    tops = _climb(forest.withColumn("size", F.lit(1).cast("bigint")), F.lit(0), lambda a, b: a + b)
    tree = first = cut(forest.join(tops.select("v", F.col("top").alias("root"), F.col("dist").alias("depth"), "size"), "v"))
    release(tops)
    best = tree.where("p IS NOT NULL").groupBy("p").agg(F.min(F.struct((-F.col("size")).alias("s"), "v")).alias("b"))
    heavy = best.select(F.col("b.v").alias("hv"), F.lit(True).alias("is_heavy"))
    tree = cut(tree.join(heavy, F.col("v") == F.col("hv"), "left").select("v", "p", "root", "depth", "size", F.coalesce("is_heavy", F.lit(False)).alias("is_heavy")))
    release(first)

    # Chains: climb along heavy links only.
    chain = _climb(tree.select("v", F.when(F.col("is_heavy"), F.col("p")).alias("p"), F.lit(0).cast("bigint").alias("size")), F.lit(0), lambda a, b: a + b)
    second, tree = tree, cut(tree.join(chain.select("v", F.col("top").alias("head"), F.col("dist").alias("pos")), "v"))
    release(second, chain)
    best = tree.where("p IS NOT NULL").groupBy("p").agg(F.min((-F.col("size"))).alias("s"))
    # Light children come after the heavy child's whole subtree, in the order of their ids.
    light = tree.where("p IS NOT NULL AND NOT is_heavy").select("v", "p", "size")
    offs = running_offsets(light, "p", "v", "size", "off").select("v", "off")
    heavy_size = best.select(F.col("p").alias("hp"), (-F.col("s")).alias("hsize"))
    place = tree.select(F.col("v").alias("pv"), F.col("head").alias("phead"), F.col("pos").alias("ppos"))
    heads = (tree.where("v = head").select("v", "p")
             .join(offs, "v", "left").join(heavy_size, F.col("p") == F.col("hp"), "left").join(place, F.col("p") == F.col("pv"), "left")
             .select("v", F.col("phead").alias("p"), "ppos", (F.col("ppos") + 1 + F.col("hsize") + F.col("off")).alias("step")))
    segments = tree.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "v", "size"))).alias("chain"))
    segments = cut(segments.withColumn("ids", F.col("chain.v")))
    parts = (heads.join(segments.select(F.col("head").alias("sh"), "ids"), F.col("p") == F.col("sh"), "left")
             .select("v", "p", F.struct(F.coalesce("step", F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.slice("ids", 1, F.col("ppos") + 1), F.array().cast("array<string>")).alias("path")).alias("w"),
                     F.lit(0).cast("bigint").alias("size")))
    chains = _climb(parts, F.col("w"), lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.concat(a["path"], b["path"]).alias("path")))
    members = (chains.select(F.col("v").alias("head"), F.col("acc.n").alias("n0"), F.col("acc.path").alias("pre"))
               .join(segments, "head")
               .select("n0", "pre", "ids", F.posexplode("chain").alias("i", "m"))
               .select(F.col("m.v").alias("id"), F.concat("pre", F.slice("ids", 1, F.col("i") + 1)).alias("path"),
                       (F.col("n0") + F.col("i")).alias("first_no"), (F.col("n0") + F.col("i") + F.col("m.size") - 1).alias("last_no"), (F.col("m.size") - 1).alias("n_descendants")))
    return (members.join(tree.select(F.col("v").alias("id"), F.col("p").alias("parent"), "root", "depth"), "id")
            .select("id", "parent", "root", "depth", "path", "n_descendants", "first_no", "last_no"))


def descendants(tree: DataFrame, wanted: DataFrame, *, block: int = 4096) -> DataFrame:
    """All (id, descendant, distance) below the ids in ``wanted(id)`` in the tree of smallest parents, linear in the output.

    Links that the tree leaves out don't count; ``all_descendants`` follows those too.

    An interval of numbers is cut at multiples of ``block``, so the equi-join on (root, block) never meets more than
    ``block`` pages a key, however large the tree.
    """
    cell = lambda c: F.floor(c / block)
    spans = (tree.join(wanted.select("id").distinct(), "id", "left_semi").where("n_descendants > 0")
             .select("id", "root", F.col("depth").alias("d0"), "first_no", "last_no",
                     F.explode(F.sequence(cell(F.col("first_no") + 1), cell(F.col("last_no")))).alias("cell")))
    below = tree.select("root", cell(F.col("first_no")).alias("cell"), F.col("first_no").alias("no"), F.col("id").alias("descendant"), "depth")
    return (spans.join(below, ["root", "cell"]).where("no > first_no AND no <= last_no")
            .select("id", "descendant", (F.col("depth") - F.col("d0")).alias("distance")))


def _components(links: DataFrame) -> DataFrame:
    """(v, c): the smallest id c that v is connected with, whichever way the links ``(src, dst)`` point."""
    label = cut(links.select(F.col("src").alias("v")).union(links.select("dst")).distinct().withColumn("c", F.col("v")))
    while True:
        named = links.join(label.select(F.col("v").alias("src"), F.col("c").alias("a")), "src").join(label.select(F.col("v").alias("dst"), F.col("c").alias("b")), "dst").where("a <> b")
        hooks = cut(named.groupBy(F.greatest("a", "b").alias("v")).agg(F.min(F.least("a", "b")).alias("p")))
        if not _rows(hooks):
            return label
        # Each hook leads to a smaller label, so there are no cycles among them.
        names = label.select(F.col("c").alias("v")).distinct().join(hooks, "v", "left").withColumn("size", F.lit(1).cast("bigint"))
        tops = _climb(names, F.lit(0), lambda a, b: a + b).select(F.col("v").alias("c"), "top")
        label = cut(label.join(tops, "c").select("v", F.col("top").alias("c")))


def all_descendants(current: DataFrame, wanted: DataFrame, *, block: int = 4096) -> DataFrame:
    """Distinct (id, descendant) of all pages met along the links from the ids in ``wanted(id)``, the id itself left out.

    Every link counts: those of all parents of a page, and those on cycles. Pages on one cycle are contracted to one node;
    what is left has no cycles, and the smallest parent of each node makes a forest of intervals (``_numbered``). From an
    interval that is reached, the links that the forest leaves out lead to further ones, round by round until nothing is
    new; there are as many rounds as such links on the path that has fewest. Input as for ``hierarchy``.
    """
    current = cut(current)
    links = cut(page_links(current))
    joined = _components(cyclic_links(links))
    node = cut(current.select(F.col("id").alias("v")).join(joined, "v", "left").select("v", F.coalesce("c", "v").alias("c")))
    between = cut(links.join(node.select(F.col("v").alias("parent"), F.col("c").alias("p")), "parent").join(node.select(F.col("v").alias("child"), F.col("c")), "child")
                  .where("p <> c").select("p", "c").distinct())
    up = cut(between.groupBy("c").agg(F.min("p").alias("p")))
    tree = cut(_numbered(cut(node.select(F.col("c").alias("v")).distinct().join(up.withColumnRenamed("c", "v"), "v", "left").select("v", "p")))
               .select("id", "root", "first_no", "last_no"))
    cell = lambda c: F.floor(c / block)
    spans = cut(tree.select(F.col("id").alias("via"), "root", "first_no", "last_no"))
    at = tree.select("id", "root", cell(F.col("first_no")).alias("cell"), F.col("first_no").alias("no"))
    extra = cut(between.join(up, ["p", "c"], "left_anti").join(at.withColumnRenamed("id", "p"), "p").select("root", "cell", "no", F.col("c").alias("next")))

    def met(reached: DataFrame, what: DataFrame) -> DataFrame:
        cells = reached.join(spans, "via").withColumn("cell", F.explode(F.sequence(cell(F.col("first_no")), cell(F.col("last_no")))))
        return cells.join(what, ["root", "cell"]).where("no BETWEEN first_no AND last_no")

    asked = wanted.select("id").distinct().join(node.withColumnRenamed("v", "id"), "id")
    reached = cut(asked.select(F.col("c").alias("of"), F.col("c").alias("via")).distinct())
    fresh = reached
    while _rows(fresh):
        fresh = cut(met(fresh, extra).select("of", F.col("next").alias("via")).distinct().join(reached, ["of", "via"], "left_anti"))
        reached = cut(reached.unionByName(fresh))
    below = met(reached, at.withColumnRenamed("id", "c")).select("of", "c").distinct()
    return (asked.select("id", F.col("c").alias("of")).join(below, "of").join(node.withColumnRenamed("v", "descendant"), "c")
            .where("id <> descendant").select("id", "descendant"))
