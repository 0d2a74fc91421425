"""Every registered query with SQL against DuckDB on the smallest tables, with all its rows."""

import os

import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="session")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(D):
        c.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


def norm(rows):
    return sorted(tuple("" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    r = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    rows = r.fetchall()
    assert norm([[x[c] for c in cols] for x in df.collect()]) == norm([[x[names.index(c)] for c in cols] for x in rows])


def test_entry_and_names(spark):
    assert entry.entry(spark).columns == ["bundle_name", "snapshot_no", "canonical_id", "change"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in set(entry.queries()) - set(entry.oracle_sql()) if not n[:2] in ("p2", "p4", "p5", "p6", "p7")))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, D).count() >= 0


def test_walk_reaches_pages_of_any_depth(spark, tmp_path):
    rows = [(str(i), [str(i + 1)] + ["x"] * (i == 20), 1) for i in range(40)] + [("40", ["35"], 1), ("x", None, 1)]
    spark.createDataFrame(rows, "id string, child_page_ids array<string>, version int").selectExpr("*", "timestamp'2030-01-01' AS fetched_at").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["id"]: r["depth"] for r in entry.queries()["tree_bfs_all"](spark, str(tmp_path)).collect()}
    assert got == {str(i): i for i in range(41)} | {"x": 21}
    assert max(r["depth"] for r in entry.queries()["tree_bfs"](spark, str(tmp_path)).collect()) == 8
