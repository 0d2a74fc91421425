import itertools
import os
import random

import pytest

from lodestrata.llm import packing as P


@pytest.mark.parametrize("seed", range(12))
def test_fullest_is_the_best_sum(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 30) for _ in range(9)]
    room = rng.randrange(0, 90)
    counts = {s: items.count(s) for s in items}
    best = max(sum(c) for n in range(10) for c in itertools.combinations(items, n) if sum(c) <= room)
    chosen = P.fullest(counts, sorted(counts, reverse=True), room)
    assert sum(s * k for s, k in chosen) == best and all(k <= counts[s] for s, k in chosen)


@pytest.mark.parametrize("seed,cap", [(1, 10), (2, 50), (3, 7), (4, 100)])
def test_every_item_once_and_never_over(spark, seed, cap):
    rng = random.Random(seed)
    sizes = [rng.choice([None, 0, 1, 3, 5, cap, cap + 1, 3 * cap, rng.randrange(1, 4 * cap)]) for _ in range(120)] + [4] * 200
    df = spark.createDataFrame([(i, s, 9, "x") for i, s in enumerate(sizes)], "doc_id bigint, n_tokens bigint, rank int, pk string")
    rows = P.pack(df, [("a", cap), ("b", 3)]).collect()
    for name, c in (("a", cap), ("b", 3)):
        own = [r for r in rows if r["pack_name"] == name]
        load, pieces = {}, {}
        for r in own:
            load[r["container_no"]] = load.get(r["container_no"], 0) + r["n_tokens"]
            pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["first_token"], r["n_tokens"]))
        assert max(load.values()) <= c and set(load) == set(range(1, max(load) + 1))
        assert set(pieces) == set(range(len(sizes)))
        for i, ps in pieces.items():
            n = sizes[i] or 0
            ps.sort()
            assert sum(p[2] for p in ps) == n and (len(ps) == 1) == (n <= c) and [p[1] for p in ps] == [k * c for k in range(len(ps))]
        # No fewer than the tokens need, nor than there are pieces over half a container.
        least = max(-(-sum(s or 0 for s in sizes) // c), sum(2 * r["n_tokens"] > c for r in own))
        assert len([k for k, v in load.items() if v]) <= least * 1.15 + 1


def test_edges(spark):
    df = spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")
    assert [(r["container_no"], r["n_tokens"]) for r in P.pack(df, [("a", 5)]).collect()] == [(1, 0), (1, 0)]
    assert P.pack(df.where("false"), [("a", 5)]).count() == 0 and P.pack(df, []).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, [("a", 0)])
    caps = spark.createDataFrame([("a", 5)], "pack_name string, capacity_tokens int")
    full = spark.createDataFrame([(i, n) for i, n in enumerate([3, 2, 4, 1, 12])], "doc_id bigint, n_tokens bigint")
    assert tuple(P.packed_summary(P.pack(full, [("a", 5)]), caps).first()) == ("a", 5, 5, 22, 5, 5, 3)


def test_blocks_of_the_query_are_read_one_at_a_time(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from lodestrata.llm import registry
    from lodestrata.session import app_dir

    # one scan task writes three blocks here; in one row group they would be read at once.
    spark.range(0, 3, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1600001) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("wide", 1_000_000)], "pack_name string, capacity_tokens int").write.parquet(f"{tmp_path}/pack_capacity.parquet")
    files = lambda: {*glob.glob(f"{app_dir(spark).removeprefix('file://')}/*/*.parquet")}
    before = files()
    got = registry.p6_packed(spark, str(tmp_path)).collect()
    blocks = [m for f in files() - before for m in [pq.ParquetFile(f)] if "words" in m.schema_arrow.names]
    assert [m.metadata.row_group(i).num_rows for m in blocks for i in range(m.metadata.num_row_groups)] == [1, 1, 1]
    assert sorted(r["n_tokens"] for r in got) == [600_002] * 3 + [1_000_000] * 3 and len({r["container_no"] for r in got}) == 6


def test_texts_of_a_row_group_are_not_copied_outside_the_heap(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lodestrata.llm import registry

    # a row group's texts went through one direct buffer, which the reading thread then kept.
    n = 48_000
    os.makedirs(f"{tmp_path}/documents.parquet")
    pq.write_table(pa.table({"doc_id": range(n), "text": ["a" * 1000] * n}), f"{tmp_path}/documents.parquet/part-0.parquet", row_group_size=n, compression="none", use_dictionary=False)
    spark.createDataFrame([("wide", 1_000_000)], "pack_name string, capacity_tokens int").write.parquet(f"{tmp_path}/pack_capacity.parquet")
    jvm = spark.sparkContext._jvm
    kind = jvm.java.lang.Class.forName("java.lang.management.BufferPoolMXBean")
    direct = lambda: next(p.getMemoryUsed() for p in jvm.java.lang.management.ManagementFactory.getPlatformMXBeans(kind) if p.getName() == "direct")
    before = direct()
    assert registry.p6_packed(spark, str(tmp_path)).count() == n
    assert direct() - before < 24_000_000
