"""What changed between consecutive full snapshots of keyed records.

Keys get ordinals inside hash buckets, kept from run to run in a dictionary (``extend_dictionary``); a snapshot of a bucket is
a set of 64-bit words (only words with a member exist, which is the compression), each with the value vectors aligned with
its set bits. AND-NOT of two consecutive snapshots' words gives additions and removals, AND gives the common keys, whose
aligned vectors are compared. The records are shuffled to their latest versions and then to their buckets; everything
behind that stays inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestrata.session import broadcast_if_small, cut, plan_bytes

BUCKET_BYTES = 32 << 20


def normal_hash(c: str | Column) -> Column:
    """A hash without surrounding white space, algorithm prefix (``sha256:``) and letter case; empty becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+\z", "")
    return F.nullif(F.regexp_replace(bare, r"(?U)^[a-z][a-z0-9+._/-]*\s*:\s*", ""), F.lit(""))


def key_ordinals(keys: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dense ordinals for distinct ``(bucket, grp, key)``; those in ``known`` (same columns + ordinal) keep theirs.

    New keys are numbered behind the highest known ordinal of their bucket, in order of (grp, key), so a dictionary that
    is stored and passed in again never renumbers. A key is known by (grp, key) and keeps its stored bucket too, so the
    number of buckets may change between runs. Nulls in grp or key are not keys and are left out.
    """
    keys = keys.select("bucket", "grp", "key").where("grp IS NOT NULL AND key IS NOT NULL").distinct()
    w = Window.partitionBy("bucket").orderBy("grp", "key")
    if known is None:
        return keys.withColumn("ordinal", (F.row_number().over(w) - 1).cast("bigint"))
    fresh = keys.join(known.select("grp", "key"), ["grp", "key"], "left_anti")
    top = known.groupBy("bucket").agg(F.max("ordinal").alias("top"))
    fresh = fresh.join(top, "bucket", "left").withColumn("ordinal", F.coalesce(F.col("top") + 1, F.lit(0)) + F.row_number().over(w) - 1)
    return known.select("bucket", "grp", "key", "ordinal").unionByName(fresh.select("bucket", "grp", "key", "ordinal"))


def _bits(word: Column, test) -> Column:
    """The positions of the set bits of ``word`` for which ``test(position)`` holds."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.call_function("shiftrightunsigned", word, i).bitwiseAND(F.lit(1).cast("bigint")) != 0) & test(i))


def packed(c: str | Column) -> Column:
    """A text as bytes that are equal exactly when the texts are: pairs of lower-case hex digits take a byte each."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^(?:[0-9a-f]{2})+\z"), F.concat(F.lit(bytearray(b"\x01")), F.unhex(c))).otherwise(F.concat(F.lit(bytearray(b"\x00")), F.encode(c, "UTF-8")))


DICTIONARY = "bucket int, grp string, key string, ordinal bigint, buckets int"


def stored_dictionary(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The dictionary of ordinals kept below ``path`` (``bucket, grp, key, ordinal, buckets``), None if there is none yet."""
    if path is None:
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(DICTIONARY).parquet(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("grp", "key"), F.lit(buckets)).cast("int")


def extend_dictionary(keys: DataFrame, path: str, buckets: int) -> tuple[DataFrame, int]:
    """The dictionary below ``path`` with the new ones of ``(grp, key)`` appended, and its number of buckets; one writer at a time.

    The number of buckets is set by the first run and kept, so a key's bucket never changes; known keys keep their ordinals, new
    ones are numbered behind the highest of their bucket, in order. Nulls are no keys; repeated keys count once.
    """
    spark = keys.sparkSession
    known = stored_dictionary(spark, path)
    first = known.select("buckets").head() if known is not None else None
    buckets = first["buckets"] if first else buckets
    all_keys = keys.where("grp IS NOT NULL AND key IS NOT NULL").select("grp", "key", F.lit(None).cast("bigint").alias("ordinal"))
    if known is not None:
        all_keys = all_keys.unionByName(known.select("grp", "key", "ordinal"))
    one = all_keys.groupBy(_bucket(buckets).alias("bucket"), "grp", "key").agg(F.max("ordinal").alias("ordinal"))
    bucket = Window.partitionBy("bucket")
    new = one.withColumn("top", F.max("ordinal").over(bucket)).where("ordinal IS NULL").withColumn("ordinal", F.coalesce(F.col("top") + 1, F.lit(0)) + F.row_number().over(bucket.orderBy("grp", "key")) - 1)
    new = new.select("bucket", "grp", "key", "ordinal", F.lit(buckets).alias("buckets"))
    if known is not None:
        new = cut(new)  # what is appended must not be read from where it is appended to
    new.write.mode("append").parquet(path)
    return stored_dictionary(spark, path), buckets


def snapshot_changes(rows: DataFrame, delivered: DataFrame, *, grp: str, snap: str, key: str, loaded: str, values: dict[str, Column],
                     known: DataFrame | None = None, dictionary: str | None = None) -> DataFrame:
    """Records added, removed or changed between each delivered snapshot and the delivered one with the next lower number.

    ``rows`` holds full contents, ``delivered`` says which (grp, snap) exist; a delivered one without rows is empty, rows
    of one that was not delivered don't count, a first snapshot gives nothing. Per (grp, snap, key) the row with the
    latest ``loaded`` counts (null is earliest; ties by the greatest values). ``values`` are compared null-safely. Rows
    with a null in grp, snap or key are no records. Repeated rows, extra columns and empty tables are harmless.
    ``dictionary`` names a folder in which the keys' ordinals are kept from run to run (``extend_dictionary``), ``known`` is
    such a dictionary as a frame; without either the ordinals last one run. The result is the same.
    Returns (grp, snap, key, change) under the names given. Work and memory grow with the records of each snapshot: a
    word of a snapshot is one row and meets the same word of the snapshot before it only.
    """
    spark = rows.sparkSession
    size = plan_bytes(rows)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES) if size < 1 << 54 else 0)  # beyond that Catalyst doesn't know the size
    names = list(values)
    src = rows.select(F.col(grp).alias("grp"), F.col(snap).alias("snap"), F.col(key).alias("key"), F.col(loaded).alias("ld"),
                      F.struct(*[values[v].alias(v) for v in names]).alias("val")).where("grp IS NOT NULL AND snap IS NOT NULL AND key IS NOT NULL")
    if dictionary is not None:
        stored, n = extend_dictionary(src, dictionary, n)
    latest = (src.groupBy(_bucket(n).alias("bucket"), "grp", "key", "snap").agg(F.max(F.struct(F.col("ld").isNotNull().alias("h"), "ld", "val")).alias("m"))
              .select("bucket", "grp", "key", "snap", F.col("m.val").alias("val")))
    if dictionary is not None:  # the stored ordinals go to the buckets with the records, and meet them there
        none = lambda c: F.lit(None).cast(latest.schema[c].dataType).alias(c)
        both = latest.withColumn("ordinal", F.lit(None).cast("bigint")).unionByName(stored.select("bucket", "grp", "key", none("snap"), none("val"), "ordinal"))
        latest = both.repartition("bucket").withColumn("ordinal", F.max("ordinal").over(Window.partitionBy("bucket", "grp", "key"))).where("snap IS NOT NULL")
    elif known is not None:
        latest = latest.drop("bucket").join(key_ordinals(latest, known), ["grp", "key"])
    else:  # the dictionary is made where the rows lie
        latest = latest.repartition("bucket").withColumn("ordinal", F.dense_rank().over(Window.partitionBy("bucket").orderBy("grp", "key")) - 1)
    word, bit = F.floor(F.col("ordinal") / 64), F.col("ordinal") % 64
    words = (latest.groupBy("bucket", "grp", word.alias("word"), "snap")
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))).alias("bits"),
                  F.array_sort(F.collect_list(F.struct(bit.cast("int").alias("bit"), "key", "val"))).alias("vec")))

    # Every delivered snapshot with the numbers of the ones before and behind it; a group's deliveries are few beside its records.
    seq = delivered.select(F.col(grp).alias("grp"), F.col(snap).alias("snap")).where("grp IS NOT NULL AND snap IS NOT NULL").groupBy("grp").agg(F.array_sort(F.collect_set("snap")).alias("s"))
    seq = seq.select("grp", F.explode(F.transform("s", lambda x, i: F.struct(x.alias("snap"), F.get("s", i - 1).alias("before"), F.get("s", i + 1).alias("behind")))).alias("x")).select("grp", "x.*")
    small = broadcast_if_small(delivered)
    if small is not None:
        placed = words.join(F.broadcast(seq), ["grp", "snap"])
    else:  # one snapshot may hold a large share of the words: spread each over salts
        salts = 64
        placed = (words.withColumn("salt", F.pmod(F.hash("bucket", "word"), F.lit(salts)))
                  .join(seq.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["grp", "snap", "salt"]))

    # A word meets its own state in the snapshot before, if it has one there; a word without one behind it has lost all its bits.
    line = Window.partitionBy("bucket", "grp", "word").orderBy("snap")
    empty = F.struct(F.lit(0).cast("bigint").alias("bits"), F.array().cast(words.schema["vec"].dataType).alias("vec"))
    here = F.struct("bits", "vec")
    met = placed.select("bucket", "grp", "word", "snap", "before", "behind", "bits", "vec", F.lag("snap").over(line).alias("last"), F.lag(here).over(line).alias("old"), F.lead("snap").over(line).alias("next"))
    into = F.when(F.col("before").isNotNull(), F.struct(F.col("snap").alias("snap"), F.when(F.col("last") == F.col("before"), F.col("old")).otherwise(empty).alias("old"), here.alias("new")))
    gone = F.when(F.col("behind").isNotNull() & ~F.coalesce(F.col("next") == F.col("behind"), F.lit(False)), F.struct(F.col("behind").alias("snap"), here.alias("old"), empty.alias("new")))
    step = met.select("grp", F.explode(F.array_compact(F.array(into, gone))).alias("p")).select("grp", "p.snap", "p.old", "p.new")
    # A word whose bits and vectors are both as before has no case.
    step = step.where("old.bits <> new.bits OR old.vec <> new.vec")
    at = lambda side, i: F.col(side)["vec"][F.bit_count(F.col(side)["bits"].bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), i))))]
    ob, nb = F.col("old.bits"), F.col("new.bits")
    case = lambda bits, side, name, test=lambda i: F.lit(True): F.transform(
        _bits(bits, test), lambda i: F.struct(at(side, i)["key"].alias("key"), F.lit(name).alias("change")))
    differs = lambda i: ~at("old", i)["val"].eqNullSafe(at("new", i)["val"])
    found = F.concat(case(nb.bitwiseAND(F.bitwise_not(ob)), "new", "added"), case(ob.bitwiseAND(F.bitwise_not(nb)), "old", "removed"),
                     case(ob.bitwiseAND(nb), "new", "changed", differs))
    return step.select("grp", "snap", F.explode(found).alias("f")).select(
        F.col("grp").alias(grp), F.col("snap").alias(snap), F.col("f.key").alias(key), F.col("f.change").alias("change"))
