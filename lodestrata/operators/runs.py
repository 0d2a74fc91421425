"""Runs and requests: failure classes, pacing, metrics, attempts, resume, reports, selection."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import col
from lodestrata.operators.hierarchy import running_offsets
from lodestrata.session import cut

# Parts of messages that speak of certificates.
TLS = ["certificate", "cert", "ssl", "tls", "handshake", "pem", "x509"]
RETRIED = ["timeout", "throttled", "transient"]


def page_failure(status: str | Column, error: str | Column | None = None) -> Column:
    """M06, page API: the class of a failed request from its HTTP status, or from the transport error if there is none."""
    s, e = col(status), F.lower(col(error).cast("string"))
    tls = F.exists(F.array(*[F.lit(x) for x in TLS]), lambda x: F.contains(e, x))
    return (F.when(s.isin(401, 403), "auth").when(s == 429, "expected_retryable").when(s == 404, "permanent").when(s.between(500, 599), "provider").when(s.isNotNull(), "permanent")
            .when(tls, "configuration").when(e.isNotNull(), "expected_retryable"))


def issue_failure(status: str | Column, retry_after: str | Column, remaining: str | Column) -> Column:
    """M06, issue API: a rate-limit hint decides before the status does."""
    s = col(status)
    limited = (F.coalesce(col(retry_after), F.lit("")) != "") | F.coalesce(col(remaining) == "0", F.lit(False)) | (s == 429)
    return F.when(limited, "expected_retryable").when(s.isin(401, 403), "auth").when(s == 404, "permanent").when(s.between(500, 599), "provider").otherwise("permanent")


def provider_failure(message: str | Column, status: str | Column | None = None) -> Column:
    """What a provider's error text means for the item."""
    m, s = F.lower(F.coalesce(col(message), F.lit(""))), col(status)
    return F.when(m.rlike(r"time(d )?-?out"), "timeout").when((s == 429) | m.contains("429") | m.contains("too many requests"), "throttled").when(s.between(500, 599) | m.rlike(r"\b5\d\d\b"), "transient").otherwise("unavailable")


def paced(requests: DataFrame, *, on: str, order: list[str], arrival: str, interval: float) -> DataFrame:
    """``start`` of each request: max of its arrival and the last start + interval, per client.

    Closed form: start = max over earlier requests of (arrival - n * interval) + n * interval, with n counted by running sums over
    range-partitioned rows and the running maximum taken per part, then carried over the parts; no client goes to one task.
    """
    from pyspark.sql import Window

    n = running_offsets(requests.withColumn("__pace_one", F.lit(1).cast("bigint")), on, order, "__pace_one", "__pace_n").drop("__pace_one")
    part = cut(n.withColumn("__pace_z", F.col(arrival) - F.col("__pace_n") * interval).repartitionByRange(on, *order).withColumn("__pace_part", F.spark_partition_id()))
    local = F.max("__pace_z").over(Window.partitionBy("__pace_part", on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tops = part.groupBy("__pace_part", on).agg(F.max("__pace_z").alias("__pace_top"))
    before = tops.select(F.col("__pace_part").alias("__pace_bp"), F.col(on).alias("__pace_bk"), F.max("__pace_top").over(Window.partitionBy(on).orderBy("__pace_part").rowsBetween(Window.unboundedPreceding, -1)).alias("__pace_before"))
    out = part.withColumn("__pace_local", local).join(before, (F.col("__pace_part") == F.col("__pace_bp")) & F.col(on).eqNullSafe(F.col("__pace_bk")))
    return out.withColumn("start", F.greatest("__pace_local", "__pace_before") + F.col("__pace_n") * interval).drop("__pace_n", "__pace_z", "__pace_part", "__pace_local", "__pace_bp", "__pace_bk", "__pace_before")


def request_metrics(requests: DataFrame, by: list[str], *, seconds: str, hit: str) -> DataFrame:
    """requests, cache hits and misses, seconds, and requests a second (null without time)."""
    n = requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"), F.sum(seconds).alias("seconds"))
    return n.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("requests") / F.col("seconds")))


def attempts(log: DataFrame, *, key: str, order: str, outcome: str) -> DataFrame:
    """Attempts of each item, its last outcome, and whether it may be tried again."""
    return log.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(outcome, F.struct(order, outcome)).alias("last_outcome")).withColumn("retryable", F.col("last_outcome").isin(*RETRIED))


def reconcile(found: DataFrame, completed: DataFrame, *, key: str, on: str, order: str, batch: int) -> DataFrame:
    """Found items as ``preserved`` (completed before), ``attempted`` (the next ``batch`` of each run) or ``unattempted``."""
    done = completed.select(on, key).distinct().withColumn("_done", F.lit(True))
    j = found.join(done, [on, key], "left").withColumn("_new", F.col("_done").isNull().cast("bigint"))
    r = running_offsets(j, on, [order, key], "_new", "_before")
    return r.withColumn("disposition", F.when(F.col("_done"), "preserved").when(F.col("_before") < batch, "attempted").otherwise("unattempted")).drop("_done", "_new", "_before")


def progress(reconciled: DataFrame, on: str) -> DataFrame:
    """Whether anything is left for a later run."""
    return reconciled.groupBy(on).agg(F.count_if(F.col("disposition") == "preserved").alias("preserved"), F.count_if(F.col("disposition") == "attempted").alias("attempted"), F.count_if(F.col("disposition") == "unattempted").alias("unattempted")).withColumn(
        "state", F.when(F.col("unattempted") > 0, "continuation_remaining").otherwise("exhausted"))


def run_report(records: DataFrame, by: list[str]) -> DataFrame:
    """runs by status, and what they wrote and skipped, apart for dry runs."""
    n, s = (lambda t: F.count_if(t)), (lambda c, t: F.coalesce(F.sum(F.when(t, F.col(c))), F.lit(0)).cast("bigint"))
    dry = F.col("dry_run")
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), n(F.col("status") == "succeeded").alias("succeeded"), n(F.col("status") == "failed").alias("failed"), n(F.col("status") == "interrupted").alias("interrupted"),
                                    s("wrote", ~dry).alias("wrote"), s("skipped", ~dry).alias("skipped"), s("wrote", dry).alias("would_write"), s("skipped", dry).alias("would_skip"))


def selected_runs(runs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The enabled runs, or the named ones even if disabled; unknown names are an error."""
    if not only:
        return runs.where("enabled")
    unknown = set(only) - {r["name"] for r in runs.where(F.col("name").isin(*only)).select("name").distinct().collect()}
    if unknown:
        raise ValueError(f"unknown runs: {', '.join(sorted(unknown))}")
    return runs.where(F.col("name").isin(*only))


def cache_lookup(wanted: DataFrame, cache: DataFrame, *, on: list[str]) -> DataFrame:
    """``hit`` if the cache has the page in the wanted version and no other modification time; anything else is a miss."""
    c = cache.select(*on, F.col("page_version").alias("_v"), F.col("last_modified").alias("_m"), F.col("payload").alias("payload"))
    j = wanted.join(c, on, "left")
    hit = F.coalesce((F.col("_v") == F.col("page_version")) & (F.col("_m").isNull() | F.col("last_modified").isNull() | (F.col("_m") == F.col("last_modified"))), F.lit(False))
    return j.withColumn("hit", hit).withColumn("payload", F.when(F.col("hit"), F.col("payload"))).drop("_v", "_m")


def retry_rule(log: DataFrame, *, key: str, run: str, order: str, outcome: str, max_attempts: int) -> DataFrame:
    """Per run and item the attempts in it and in all runs up to it, the last outcome, and the ``decision``.

    ``retry`` while the last failure is of a kind that may pass and the run has attempts left, ``done`` after a success, else ``give_up``.
    Runs are ordered by their key; an item's runs are few, its attempts are aggregates.
    """
    from pyspark.sql import Window

    n = log.groupBy(run, key).agg(F.count(F.lit(1)).alias("attempts"), F.max_by(outcome, F.struct(order, outcome)).alias("last_outcome"))
    total = F.sum("attempts").over(Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, 0))
    last = F.col("last_outcome")
    return n.withColumn("total_attempts", total).withColumn("decision", F.when(last == "completed", "done").when(last.isin(*RETRIED) & (F.col("attempts") < max_attempts), "retry").otherwise("give_up"))


def reconciliation_summary(reconciled: DataFrame, log: DataFrame, *, on: str, key: str) -> DataFrame:
    """per run how many items were reused, acquired, dropped and left pending, and the attempts of those tried.

    ``reconciled`` as ``reconcile`` gives it, ``log`` one row an attempt (on, key). Attempts are summed as a histogram (attempts -> items), which
    has as many entries as an item may have attempts, so no run's items are gathered.
    """
    tried = log.groupBy(on, key).agg(F.count(F.lit(1)).alias("n"))
    hist = tried.groupBy(on, "n").agg(F.count(F.lit(1)).alias("items")).groupBy(on).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "items")))).alias("attempts"))
    got = tried.select(on, key, F.lit(True).alias("_tried"))
    n = lambda t: F.count_if(t)
    d, was = F.col("disposition"), F.coalesce("_tried", F.lit(False))
    s = reconciled.join(got, [on, key], "left").groupBy(on).agg(n(d == "preserved").alias("reused"), n((d == "attempted") & was).alias("acquired"), n((d == "attempted") & ~was).alias("dropped"), n(d == "unattempted").alias("pending"))
    return s.join(hist, on, "left").select(on, "reused", "acquired", "dropped", "pending", F.coalesce("attempts", F.create_map().cast("map<bigint,bigint>")).alias("attempts"))


def bundle_inputs(bundles: DataFrame, runs: DataFrame) -> DataFrame:
    """The input folder of each run that a bundle names, in the order of the names: ``bundle, position, run, input_dir, problem``.

    ``bundles``: (bundle, runs); ``runs``: (name, output_dir). A name that is no run, or whose run has no output folder, is the row's problem.
    """
    named = bundles.select("bundle", F.posexplode("runs").alias("position", "run"))
    known = runs.select(F.col("name").alias("run"), "output_dir", F.lit(True).alias("_there")).dropDuplicates(["run"])
    j = named.join(known, "run", "left")
    problem = F.when(F.col("_there").isNull(), "unknown run").when(F.coalesce("output_dir", F.lit("")) == "", "run without an output folder")
    return j.select("bundle", "position", "run", F.when(problem.isNull(), F.col("output_dir")).alias("input_dir"), problem.alias("problem"))


def readiness(features: DataFrame, dimensions: list[str]) -> DataFrame:
    """one row an adapter, one flag a dimension, from (adapter, dimension) rows; dimensions nobody has are false."""
    return features.groupBy("adapter").pivot("dimension", dimensions).agg(F.count(F.lit(1)) > 0).na.fill(False).select("adapter", *dimensions)


def report_markdown(records: DataFrame, *, title: str = "Run report") -> DataFrame:
    """One markdown text from the runs' records (position, name, run_type, status, dry_run, wrote, skipped, message).

    A report is of one invocation, whose runs are bounded by its configuration.
    """
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("position").cast("string"), F.coalesce("name", F.lit("")), "run_type", "status", F.when(F.col("dry_run"), "yes").otherwise("no"), F.coalesce(F.col("wrote").cast("string"), F.lit("-")),
                                             F.coalesce(F.col("skipped").cast("string"), F.lit("-")), F.translate(F.coalesce("message", F.lit("")), "|\r\n", "/  ")), F.lit(" |"))
    s = lambda c, dry: F.coalesce(F.sum(F.when(F.col("dry_run") == dry, F.col(c))), F.lit(0)).cast("string")
    n = lambda x: F.count_if(F.col("status") == x).cast("string")
    text = F.concat(F.lit(f"# {title}\n\n"), F.concat_ws("\n", F.concat(F.lit("- runs: "), F.count(F.lit(1)).cast("string")), *[F.concat(F.lit(f"- {x}: "), n(x)) for x in ("succeeded", "failed", "interrupted")],
                    F.concat(F.lit("- wrote: "), s("wrote", False), F.lit(", skipped: "), s("skipped", False)), F.concat(F.lit("- would write: "), s("wrote", True), F.lit(", would skip: "), s("skipped", True))),
                    F.lit("\n\n| # | name | type | status | dry run | wrote | skipped | message |\n| --- | --- | --- | --- | --- | --- | --- | --- |\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n"), F.lit("\n"))
    return records.agg(text.alias("markdown"))


REPORT_SCHEMA = "position int, name string, run_type string, status string, dry_run boolean, wrote bigint, skipped bigint, message string"


def run_all(spark: SparkSession, plans: list[tuple[str, str, Callable[[SparkSession], tuple[int, int]]]], *, dry_run: bool = False, continue_on_error: bool = False) -> DataFrame:
    """The plans (name, type, work) one after the other; ``work`` says how many records it wrote and skipped.

    An interrupt stops the current run's Spark jobs by their tag and goes on with the next; a second one in a row ends the whole.
    An error ends the whole too, unless ``continue_on_error``. The records of all runs, those not reached included, come back.
    """
    records, stopped, interrupts = [], False, 0
    for i, (name, kind, work) in enumerate(plans, 1):
        if stopped:
            records.append((i, name, kind, "not_run", dry_run, None, None, None))
            continue
        tag = f"lodestrata-{uuid.uuid4().hex}"
        spark.addTag(tag)
        try:
            wrote, skipped = work(spark)
            records.append((i, name, kind, "succeeded", dry_run, wrote, skipped, None))
            interrupts = 0
        except KeyboardInterrupt:
            with contextlib.suppress(Exception):
                spark.interruptTag(tag)
            interrupts += 1
            stopped = interrupts > 1
            records.append((i, name, kind, "interrupted", dry_run, None, None, None))
        except Exception as e:  # noqa: BLE001 - every failure is a run's result
            records.append((i, name, kind, "failed", dry_run, None, None, str(e).splitlines()[0][:200] if str(e) else type(e).__name__))
            stopped = not continue_on_error
        finally:
            spark.removeTag(tag)
    return spark.createDataFrame(records, REPORT_SCHEMA)
