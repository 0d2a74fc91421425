import datetime as dt
import random

from pyspark.sql import functions as F

from lodestrata.operators import snapshots as S

ROWS, GIVEN = "g string, n int, k string, h string, s boolean, at timestamp, bits int, vec string", "g string, n int"


def changes(spark, rows, given, known=None):
    values = {"h": S.normal_hash("h"), "s": F.coalesce("s", F.lit(False))}
    df = S.snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(given, GIVEN), grp="g", snap="n", key="k", loaded="at", values=values, known=known)
    return sorted(tuple(r) for r in df.collect())


def row(g, n, k, h, s=False, at=0):
    return (g, n, k, h, s, None if at is None else dt.datetime(2030, 1, 1) + dt.timedelta(seconds=at), 1, "x")


def test_rules(spark):
    rows = [row("a", 1, "x", "AB"), row("a", 3, "x", " sha256:ab\n"), row("a", 1, "y", "1"), row("a", 3, "y", "2"), row("a", 1, "z", ""), row("a", 3, "z", None), row("a", 3, "new", "1"), row("a", 1, "old", "1"), row("a", 2, "ghost", "1"),
            row("a", 1, "f", "1", None), row("a", 3, "f", "1", False), row("a", 1, "t", "1", False), row("a", 3, "t", "1", True), row("a", 1, "v", None), row("a", 3, "v", "1"), row("a", 3, "late", "1", at=5), row("a", 1, "late", "9", at=1), row("a", 1, "late", "1", at=9),
            row("a", 1, "late", "7", at=None), row(None, 1, "n", "1"), row("a", None, "n", "1"), row("a", 3, None, "1"), row("b", 1, "only", "1"), row("c", 2, "x", "1"), row("c", 2, "x", "1")]
    given = [("a", 1), ("a", 3), ("a", 3), ("b", 1), ("c", 2), ("c", 4), ("c", 9), (None, 1), ("a", None)]
    assert changes(spark, rows, given) == [("a", 3, "new", "added"), ("a", 3, "old", "removed"), ("a", 3, "t", "changed"), ("a", 3, "v", "changed"), ("a", 3, "y", "changed"), ("c", 4, "x", "removed")]


def test_all_bits_of_a_word_and_hot_group(spark):
    rng = random.Random(5)
    rows, want = [], []
    for k in range(900):
        old, new = rng.choice([None, "1"]), rng.choice([None, "1", "2"])
        rows += [row("hot", 1, f"k{k}", old)] * (old is not None) + [row("hot", 2, f"k{k}", new)] * (new is not None)
        if old != new:
            want.append(("hot", 2, f"k{k}", "added" if old is None else "removed" if new is None else "changed"))
    assert changes(spark, rows, [("hot", 1), ("hot", 2)]) == sorted(want)


def test_empty(spark):
    assert changes(spark, [], [("a", 1), ("a", 2)]) == [] and changes(spark, [row("a", 1, "x", "1")], []) == []


def test_ordinals_persist(spark):
    first = spark.createDataFrame([(0, "a", "x"), (0, "a", "z"), (1, "b", "q"), (0, "a", None)], "bucket int, grp string, key string")
    known = S.key_ordinals(first)
    more = S.key_ordinals(first.union(spark.createDataFrame([(0, "a", "b"), (2, "c", "n")], "bucket int, grp string, key string")), known)
    got = {(r["bucket"], r["key"]): r["ordinal"] for r in more.collect()}
    assert got == {(0, "x"): 0, (0, "z"): 1, (1, "q"): 0, (0, "b"): 2, (2, "n"): 0}


def test_ordinals_persist_when_the_number_of_buckets_changes(spark):
    keys = lambda ks, n: spark.createDataFrame([("a", k) for k in ks], "grp string, key string").select(F.pmod(F.xxhash64("grp", "key"), F.lit(n)).cast("int").alias("bucket"), "grp", "key")
    old, new = [f"k{i}" for i in range(40)], [f"n{i}" for i in range(40)]
    known = S.key_ordinals(keys(old, 5))
    more = S.key_ordinals(keys(old + new, 3), known).collect()
    assert len(more) == 80 == len({(r["bucket"], r["ordinal"]) for r in more})
    assert {tuple(r) for r in known.collect()} <= {(r["bucket"], r["grp"], r["key"], r["ordinal"]) for r in more}
    rows = [row("a", 1, k, "1") for k in old] + [row("a", 2, k, "1" if k != "k7" else "2") for k in old[1:] + new[:1]]
    assert changes(spark, rows, [("a", 1), ("a", 2)], known=known) == [("a", 2, "k0", "removed"), ("a", 2, "k7", "changed"), ("a", 2, "n0", "added")]


def test_known_dictionary_gives_the_same_changes(spark):
    rows = [row("a", 1, "x", "1"), row("a", 2, "x", "2"), row("a", 2, "y", "1")]
    n = 4
    keys = spark.createDataFrame([("a", "x")], "grp string, key string").select(F.pmod(F.xxhash64("grp", "key"), F.lit(n)).cast("int").alias("bucket"), "grp", "key")
    assert changes(spark, rows, [("a", 1), ("a", 2)], known=S.key_ordinals(keys)) == [("a", 2, "x", "changed"), ("a", 2, "y", "added")]


def test_salted_join_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "broadcast_if_small", lambda df: None)
    rows = [row("a", 1, f"k{i}", "1") for i in range(300)] + [row("a", 2, f"k{i}", "1" if i % 3 else "2") for i in range(100, 300)]
    got = changes(spark, rows, [("a", 1), ("a", 2)])
    assert len(got) == 100 + sum(i % 3 == 0 for i in range(100, 300))


def test_a_stored_dictionary_keeps_every_ordinal(spark, tmp_path):
    """Rows and partitions grow between the runs; the known keys keep bucket and ordinal, new ones are numbered behind them."""
    at = str(tmp_path / "dictionary")
    values = {"h": S.normal_hash("h"), "s": F.coalesce("s", F.lit(False))}
    run = lambda rows: sorted(tuple(r) for r in S.snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame([("a", 1), ("a", 2)], GIVEN), grp="g", snap="n", key="k", loaded="at", values=values, dictionary=at).collect())
    kept = lambda: {(r["grp"], r["key"]): (r["bucket"], r["ordinal"]) for r in S.stored_dictionary(spark, at).collect()}
    old = [row("a", 1, f"k{i}", "1") for i in range(30)] + [row("a", 2, f"k{i}", "1") for i in range(29)]
    assert S.stored_dictionary(spark, at) is None and run(old) == [("a", 2, "k29", "removed")]
    first = kept()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert run(old + [row("a", 2, f"n{i}", "1") for i in range(300)]) == sorted([("a", 2, "k29", "removed"), *(("a", 2, f"n{i}", "added") for i in range(300))])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    second = kept()
    assert len(first) == 30 and len(second) == 330 == len(set(second.values())) and first.items() <= second.items()
    assert run(old) == [("a", 2, "k29", "removed")] and kept() == second


def test_packed_texts_differ_as_the_texts_do(spark):
    texts = ["", "a", "ab", "AB", "abc", "0a", "a0", "00", "0", "\u00ab", "zz", "01ab", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.packed("t")).collect()]
    assert len({bytes(x) for x in got[:-1]}) == len(texts) - 1 and got[-1] is None


def test_a_thousand_snapshots(spark):
    """Each word of a snapshot meets the one before it only; a gap between deliveries and a last absence are found."""
    rows = [row("a", n, k, str(n // 400)) for n in range(1000) for k in ("x", "y") if not (k == "y" and n % 250 == 0)]
    given = [("a", n) for n in range(1000)]
    want = [("a", n, "x", "changed") for n in (400, 800)] + [("a", n, "y", "removed") for n in (250, 500, 750)] + [("a", n, "y", "added") for n in (1, 251, 501, 751)] + [("a", n, "y", "changed") for n in (400, 800)]
    assert changes(spark, rows, given) == sorted(want)
