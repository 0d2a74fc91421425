"""Hierarchies against brute force on random graphs, and the defined results of odd input."""

import datetime as dt
import random

import pytest

from lodestrata.operators import hierarchy as H

PAGES = "id string, title string, version int, last_modified string, content string, child_page_ids array<string>, space_key string, fetched_at timestamp, kids int"
T = dt.datetime(2030, 1, 1)


def page(i, kids, version=1, at=T):
    return (i, None, version, None, None, kids, None, at, 7)


def reach(links):
    nodes = {x for e in links for x in e}
    out = {n: {b for a, b in links if a == n} for n in nodes}
    grew = True
    while grew:
        grew = False
        for n in nodes:
            more = set().union(*[out[m] for m in out[n]], out[n]) if out[n] else set()
            if more != out[n]:
                out[n], grew = more, True
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 8, 12), (2, 12, 14), (3, 14, 40), (4, 6, 0), (5, 16, 60)])
def test_cycles_against_reachability(spark, seed, n, m):
    rng = random.Random(seed)
    links = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)]
    df = spark.createDataFrame(links + links[:3] + [(None, "1"), ("1", None)], "parent string, child string")
    r = reach(set(links))
    assert {x["id"] for x in H.cycle_members(df).collect()} == {n for n in r if n in r[n]}
    assert {tuple(x) for x in H.cyclic_links(df, one_task=0).collect()} == {tuple(x) for x in H.cyclic_links(df).collect()} == {(a, b) for a, b in set(links) if a in r[b] or a == b}


def test_colouring_fallback_is_exact(spark):
    links = [(a, b) for a in "abcd" for b in "abcd" if a != b] + [("a", "x"), ("b", "x"), ("x", "y"), ("x", "z"), ("y", "z")]
    found = H._cyclic_by_colour(spark.createDataFrame(links, "src string, dst string"))
    assert {tuple(r) for r in found.collect()} == {e for e in links if e[0] in "abcd" and e[1] in "abcd"}


def test_current_rows_ties_nulls_and_dirty_children(spark):
    rows = [page("a", [" b ", "", None, "b", "zz", " c"], None), page("a", ["x"], None, None), page("b", None, 2), page("b", ["a"], 1, dt.datetime(2031, 1, 1)), page("c", []), page("c", []), page(None, ["a"])]
    cur = H.current_rows(spark.createDataFrame(rows, PAGES))
    assert {r["id"]: r["kids"] for r in cur.collect()} == {"a": ["b", "c", "zz"], "b": [], "c": []}
    assert {tuple(r) for r in H.page_links(cur).collect()} == {("a", "b"), ("a", "c")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_against_walk(spark, seed):
    rng = random.Random(seed)
    n = 40
    kids = {str(i): [] for i in range(n)}
    for i in range(1, n):
        kids[str(i - 1 if seed == 3 else rng.randrange(i))].append(str(i))
    kids["5"].append("5")
    kids["20"].append(str(rng.randrange(20)))
    kids["7"].append("30")
    links = {(p, c) for p, cs in kids.items() for c in cs}
    r = reach(links)
    up = {}
    for p, c in links:
        if p not in r.get(c, ()) and p != c:
            up[c] = min(up.get(c, p), p)
    tree = {x["id"]: x for x in H.hierarchy(H.current_rows(spark.createDataFrame([page(i, k) for i, k in kids.items()], PAGES))).collect()}
    assert len(tree) == n
    for i, x in tree.items():
        path = [i]
        while path[0] in up:
            path.insert(0, up[path[0]])
        assert (x["path"], x["depth"], x["root"], x["parent"]) == (path, len(path) - 1, path[0], up.get(i)), i
        below = {j for j, y in tree.items() if y["root"] == x["root"] and x["first_no"] < y["first_no"] <= x["last_no"]}
        want = {j for j in tree if i in (lambda p: p)(tree[j]["path"][:-1])}
        assert below == want and x["n_descendants"] == len(want)
        assert x["on_cycle"] == (i in r.get(i, ()))


def test_descendants_and_blocks(spark):
    rows = [page(str(i), [str(2 * i + 1), str(2 * i + 2)]) for i in range(31)] + [page(str(i), None) for i in range(31, 63)]
    tree = H.hierarchy(H.current_rows(spark.createDataFrame(rows, PAGES)))
    got = H.descendants(tree, spark.createDataFrame([("0",), ("2",), ("40",), (None,)], "id string"), block=4).collect()
    assert sum(r["id"] == "0" for r in got) == 62 and {r["descendant"] for r in got if r["id"] == "2" and r["distance"] == 1} == {"5", "6"} and not any(r["id"] == "40" for r in got)


@pytest.mark.parametrize("seed,n,m", [(1, 12, 14), (2, 40, 44), (3, 30, 70)])
def test_all_descendants_follow_every_link(spark, seed, n, m):
    rng = random.Random(seed)
    kids = {str(i): [] for i in range(n)}
    for _ in range(m):
        kids[str(rng.randrange(n))].append(str(rng.randrange(n)))
    r = reach({(p, c) for p, cs in kids.items() for c in cs})
    cur = H.current_rows(spark.createDataFrame([page(i, k) for i, k in kids.items()], PAGES))
    got = [tuple(x) for x in H.all_descendants(cur, cur.select("id"), block=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, bs in r.items() for b in bs if a != b}


def test_all_descendants_of_a_second_parent_and_of_a_cycle(spark):
    rows = [page("a", ["x"]), page("b", ["x"]), page("x", ["y"]), page("y", None), page("c", ["d"]), page("d", ["c", "b"])]
    cur = H.current_rows(spark.createDataFrame(rows, PAGES))
    got = {tuple(r) for r in H.all_descendants(cur, spark.createDataFrame([("b",), ("c",), ("zz",), (None,)], "id string")).collect()}
    assert got == {("b", "x"), ("b", "y"), ("c", "d"), ("c", "b"), ("c", "x"), ("c", "y")}
    assert H.all_descendants(cur.where("false"), cur.select("id")).count() == 0


def test_empty_pages(spark):
    none = H.current_rows(spark.createDataFrame([], PAGES))
    assert H.cycle_members(H.page_links(none)).count() == 0 and H.hierarchy(none).count() == 0


def test_running_offsets_with_a_hot_and_a_null_key(spark):
    rows = [("hot", i, 1) for i in range(500)] + [("b", 3, 5), ("b", 1, 2), (None, 1, 4), (None, 2, 4)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r["k"], r["o"]): r["off"] for r in H.running_offsets(df, "k", "o", "v", "off").collect()}
    assert got["hot", 499] == 499 and got["hot", 0] == 0 and got["b", 3] == 2 and got[None, 2] == 4 and len(got) == 504


def ladder(n, ring, rng):
    ids = [f"n{x}" for x in rng.sample(range(10**6), 2 * n)]
    return [(ids[2 * i + a], ids[2 * ((i + 1) % n) + b]) for i in range(n if ring else n - 1) for a in (0, 1) for b in (0, 1)]


def test_ladders_take_few_tables(spark, monkeypatch):
    """Every node has two parents and two children, so contraction ends nowhere; the tables written grow with the square of the logarithm at most."""
    made, cut = [], H.cut
    monkeypatch.setattr(H, "cut", lambda *a, **k: made.append(1) or cut(*a, **k))
    for n in (8, 200):
        for ring in (False, True):
            made.clear()
            links = ladder(n, ring, random.Random(n))
            got = {tuple(r) for r in H.cyclic_links(spark.createDataFrame(links, "parent string, child string"), one_task=0).collect()}
            assert got == (set(links) if ring else set())
            assert len(made) <= 20 + 3 * n.bit_length() ** 2, (n, ring, len(made))


def test_jumps_that_are_given_up(spark):
    """Layers in which jumps multiply: the long jumps are dropped, and the passes go on until nothing moves."""
    rng = random.Random(9)
    links = {(f"{i}.{a}", f"{i + 1}.{rng.randrange(6)}") for i in range(12) for a in range(6) for _ in range(3)} | {("12.0", "5.1"), ("3.2", "0.0")}
    r = reach(links)
    found = H._cyclic_by_colour(spark.createDataFrame(sorted(links), "src string, dst string"), growth=1)
    assert {tuple(x) for x in found.collect()} == {(a, b) for a, b in links if a in r.get(b, ())}


def test_components_of_large_shapes():
    """A ring, a long chain with a tail, and a random graph against repeated reachability; no recursion."""
    import numpy as np

    n = 50_000
    ring = H._components_of(np.arange(n), (np.arange(n) + 1) % n, n)
    chain = H._components_of(np.arange(n - 1), np.arange(1, n), n)
    assert len(set(ring.tolist())) == 1 and len(set(chain.tolist())) == n
    rng = random.Random(6)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    comp = H._components_of(np.array([a for a, _ in links]), np.array([b for _, b in links]), 60)
    r = reach(links)
    assert all((comp[a] == comp[b]) == (a == b or (b in r.get(a, ()) and a in r.get(b, ()))) for a in range(60) for b in range(60))
