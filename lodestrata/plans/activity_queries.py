"""Registered queries of the issue-tracker, run, request and package-item operators, over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import byte_length, sha256
from lodestrata.operators import hierarchy as H
from lodestrata.operators import issues as I
from lodestrata.operators import packages as P
from lodestrata.operators import records as R
from lodestrata.operators import runs as U
from lodestrata.session import cut, table

SINCE = "1996-06-01T00:00:00Z"
BATCH = 25


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def issue_list(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred open records by number."""
    return I.first_rows(table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 100)


def pr_since(spark, d):
    """Records updated since a time."""
    return I.since_filter(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", SINCE).select("o_orderkey")


def release_order(spark, d):
    """The place of every release by its text key, without one task for the whole order."""
    k = I.release_key(F.when(F.col("o_orderstatus") != "P", _text("o_orderdate")), F.col("o_orderpriority"), F.col("o_orderkey"))
    r = table(spark, d, "orders").select("o_orderkey", k.alias("k"), F.lit(1).cast("bigint").alias("one"), F.lit(0).alias("all")).select("o_orderkey", "one", "all", "k.a", "k.b", "k.c")
    return H.running_offsets(r, "all", ["a", "b", "c"], "one", "before").select("o_orderkey", (F.col("before") + 1).alias("place"))


def _comments(spark, d):
    c = table(spark, d, "lineitem").select("l_orderkey", _text("l_shipdate").alias("created_at"), _text("l_shipdate").alias("updated_at"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("author"),
                                           F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit("\n"))).alias("body"), "l_linenumber")
    key = [F.col("created_at"), F.col("updated_at"), F.coalesce("author", F.lit("")), F.col("body"), F.col("l_linenumber")]
    return I.ordered_comments(c, "l_orderkey", key, ["author", "created_at", "updated_at", "body"])


def issue_markdown(spark, d):
    """Every record with its ordered comments as markdown, by size and hash."""
    o = I.hydrate(table(spark, d, "orders"), _comments(spark, d).withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    s = R.comment_sections("Comments", "comments", ("author", "created_at", "updated_at"), R.EMPTY["issue_comment"], "Comment")
    md = R.issue_markdown(kind="issue", number="o_orderkey", title="o_orderpriority", state="o_orderstatus", author=F.concat(F.lit("c"), F.col("o_custkey").cast("string")), created_at=_text("o_orderdate"), updated_at=_text("o_orderdate"), source_url=F.lit("https://tracker.example/x"), repo=F.lit("a/b"), body=F.lit(None), sections=s)
    return o.select("o_orderkey", F.explode(F.array(md)).alias("md")).select("o_orderkey", byte_length("md").alias("n_bytes"), sha256("md").alias("content_hash"))


def release_markdown(spark, d):
    """Every part as a release."""
    md = R.release_markdown(tag_name="p_brand", title=F.when(F.col("p_size") > 10, F.col("p_name")), release_id="p_partkey", author=F.lit(None), created_at=F.lit("t"), published_at=F.lit(None), draft=F.col("p_size") > 25, prerelease=F.col("p_size") < 5, source_url=F.lit("u"), repo=F.lit("a/b"), body="p_type")
    return table(spark, d, "part").select("p_partkey", sha256(md).alias("content_hash"))


def review_comment_order(spark, d):
    """The order of each record's review comments by a nine-field key, as one text."""
    l = table(spark, d, "lineitem").withColumns({"t": _text("l_shipdate"), "qty": F.col("l_quantity").cast("int")})
    key = [F.col("t"), F.col("l_returnflag"), F.col("qty"), F.col("l_linestatus"), F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")]
    c = I.ordered_comments(l, "l_orderkey", key, ["l_linenumber"])
    return c.select("l_orderkey", F.array_join(F.transform("comments", lambda x: x["l_linenumber"].cast("string")), ",").alias("line_order"))


def hydrate_after_limit(spark, d):
    """The fifty records with the highest numbers, then their comments."""
    o = table(spark, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(50)
    n = table(spark, d, "lineitem").join(F.broadcast(o.withColumnRenamed("o_orderkey", "l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("l_partkey")).alias("parts"))
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_comments"), F.coalesce(F.array_join("parts", ","), F.lit("")).alias("parts"))


def failure_class(spark, d):
    """Request failures by class; an event's value is its status."""
    status = F.lit(400) + F.floor(F.col("value")).cast("int") % 130
    wait = F.when(F.col("event_id") % 7 == 0, F.lit("30"))
    e = table(spark, d, "events").select(F.explode(F.array(F.struct(status.alias("s"), wait.alias("w"), F.col("event_type").alias("t")))).alias("x")).select("x.*")
    return e.groupBy("s", U.page_failure("s").alias("page_class"), U.issue_failure("s", "w", F.lit(None)).alias("issue_class"), U.provider_failure("t", "s").alias("provider_class")).agg(F.count(F.lit(1)).alias("n"))


def paced_starts(spark, d):
    """When each user's requests may start, a quarter of an hour apart at least."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("at", F.col("us").cast("bigint"))
    p = U.paced(e, on="user_id", order=["at", "event_id"], arrival="at", interval=900_000_000)
    return p.select("event_id", "user_id", F.col("start").cast("bigint").alias("start"))


def request_metrics(spark, d):
    """requests, hits and rates of each user."""
    m = U.request_metrics(table(spark, d, "events").withColumn("hit", F.col("event_type") == "view"), ["user_id"], seconds="value", hit="hit")
    return m.select("user_id", "requests", "hits", "misses", F.round("seconds", 4).alias("seconds"), F.round("per_second", 6).alias("per_second"))


def attempt_counts(spark, d):
    """Events of each user as attempts; the last one's type is the outcome."""
    return U.attempts(table(spark, d, "events").where("event_type IS NOT NULL"), key="user_id", order="event_id", outcome="event_type")


def _reconciled(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type").where("user_id IS NOT NULL")
    return U.reconcile(e.select("user_id", "event_id"), e.where("event_type = 'purchase'"), key="event_id", on="user_id", order="event_id", batch=BATCH)


def resume_reconcile(spark, d):
    """Each user's items as preserved, attempted in the next batch, or left."""
    return _reconciled(spark, d).select("user_id", "event_id", "disposition")


def collection_progress(spark, d):
    """Whether anything is left for a later run."""
    return U.progress(_reconciled(spark, d), "user_id")


def run_report(spark, d):
    """Orders as runs, by priority."""
    r = table(spark, d, "orders").select("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "failed").otherwise("interrupted").alias("status"), (F.col("o_custkey") % 3 == 0).alias("dry_run"), (F.col("o_orderkey") % 11).alias("wrote"), (F.col("o_orderkey") % 5).alias("skipped"))
    return U.run_report(r, ["o_orderpriority"])


def run_selection(spark, d):
    """Named runs even if they are disabled."""
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey", (F.col("n_regionkey") > 2).alias("enabled"))
    return U.selected_runs(n)


def package_accounting(spark, d):
    """outcomes of each user's items with zeros filled in, and the status."""
    o = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "view", "unchanged").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "error", F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed")).otherwise("unchanged")
    return P.accounting(table(spark, d, "events").select(F.col("user_id").alias("package_id"), o.alias("outcome")), "package_id")


def item_problems(spark, d):
    """What is missing from item records."""
    p = P.item_problem(F.col("event_type"), F.when(F.col("value") > 50, F.lit("e")), F.when(F.col("event_id") % 2 == 0, F.lit("why")))
    q = P.item_problem(F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "failed").otherwise("skipped"), F.when(F.col("value") > 50, F.lit("e")), F.when(F.col("event_id") % 2 == 0, F.lit("why")))
    return table(spark, d, "events").groupBy(p.alias("raw_problem"), q.alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def package_references(spark, d):
    """Orders as items that refer to parts; large parts are diagnostics, and a supplier's parts belong to one item."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("package_id"), F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_partkey").cast("string").alias("path"), "l_returnflag")
    items = l.groupBy("package_id", "item_id").agg(F.array_distinct(F.collect_list(F.when(F.col("l_returnflag") != "A", F.col("path")))).alias("artifacts"), F.array_distinct(F.collect_list(F.when(F.col("l_returnflag") == "A", F.col("path")))).alias("diagnostics"))
    parts = table(spark, d, "part").where("p_size > 1").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_size") > 30, "diagnostic").otherwise("record").alias("role"))
    listed = l.select("package_id", "path").distinct().join(parts, "path")
    return P.references(items, listed, "package_id").groupBy("package_id", "code").agg(F.count(F.lit(1)).alias("n"))


def capability_gap(spark, d):
    """What each order needs beyond what is supported."""
    need = F.array_distinct(F.collect_list(F.concat(F.col("l_returnflag"), F.col("l_linestatus"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(need.alias("need")).select("l_orderkey", F.array_join(P.unsupported("need", F.array(F.lit("AF"), F.lit("NO"))), ",").alias("gap"))


def receipt_differences(spark, d):
    """Keys of two records of each customer whose values differ."""
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    a = F.create_map(F.lit("key"), F.col("c_nationkey").cast("string"), F.lit("name"), F.col("n_name"), F.lit("segment"), F.col("c_mktsegment"))
    b = F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("c_name"), F.lit("other"), F.col("c_mktsegment"))
    return j.select("c_custkey", F.array_join(P.unequal_keys(a, b), ",").alias("keys"))


QUERIES = {f.__name__: f for f in (issue_list, pr_since, release_order, issue_markdown, release_markdown, review_comment_order, hydrate_after_limit, failure_class, paced_starts, request_metrics, attempt_counts, resume_reconcile, collection_progress, run_report,
                                   run_selection, package_accounting, item_problems, package_references, capability_gap, receipt_differences)}

_T = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_REC = f"""WITH r AS (SELECT user_id, event_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, event_id) AS done FROM events WHERE user_id IS NOT NULL),
rec AS (SELECT user_id, event_id, CASE WHEN done THEN 'preserved' WHEN coalesce(sum(CASE WHEN done THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {BATCH} THEN 'attempted' ELSE 'unattempted' END AS disposition FROM r)"""
_ITEM = lambda o: f"CASE WHEN {o} NOT IN ('completed', 'unchanged', 'skipped', 'failed', 'cancelled') THEN 'unknown_outcome' WHEN {o} IN ('completed', 'unchanged') AND value > 50 THEN 'success_with_error' WHEN {o} IN ('failed', 'cancelled') AND NOT coalesce(value > 50, false) THEN 'missing_error' WHEN {o} = 'skipped' AND event_id % 2 <> 0 THEN 'missing_skip_reason' END"

SQL = {
    "issue_list": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 100",
    "pr_since": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-01 00:00:00'",
    "release_order": f"SELECT o_orderkey, row_number() OVER (ORDER BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN {_T('o_orderdate')} END, ''), o_orderpriority, o_orderkey) AS place FROM orders",
    "issue_markdown": f"""WITH c AS (SELECT l_orderkey, {_T('l_shipdate')} AS t, 's' || l_suppkey::VARCHAR AS a, CASE WHEN l_returnflag = 'R' THEN '' ELSE 'part ' || l_partkey::VARCHAR || chr(10) END AS body, l_linenumber FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY t, a, body, l_linenumber) AS i FROM c),
 s AS (SELECT l_orderkey, string_agg('### Comment ' || i::VARCHAR || chr(10) || chr(10) || '- author: ' || a || chr(10) || '- created_at: ' || t || chr(10) || '- updated_at: ' || t || chr(10) || chr(10) || CASE WHEN body = '' THEN '(empty issue comment body)' ELSE rtrim(body, chr(10)) END || chr(10), chr(10) ORDER BY i) AS s FROM n GROUP BY 1),
 m AS (SELECT o_orderkey, '# Issue #' || o_orderkey::VARCHAR || ': ' || o_orderpriority || chr(10) || chr(10) || '## Metadata' || chr(10) || '- repo: a/b' || chr(10) || '- resource_type: issue' || chr(10) || '- number: ' || o_orderkey::VARCHAR || chr(10) || '- state: ' || o_orderstatus || chr(10) || '- author: c' || o_custkey::VARCHAR || chr(10) || '- created_at: ' || {_T('o_orderdate')} || chr(10) || '- updated_at: ' || {_T('o_orderdate')}
   || chr(10) || '- source_url: https://tracker.example/x' || chr(10) || chr(10) || '## Body' || chr(10) || chr(10) || '(empty issue body)' || CASE WHEN s IS NULL THEN '' ELSE chr(10) || chr(10) || '## Comments' || chr(10) || chr(10) || rtrim(s, chr(10)) END || chr(10) AS md FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
 SELECT o_orderkey, strlen(md) AS n_bytes, sha256(md) AS content_hash FROM m""",
    "release_markdown": """SELECT p_partkey, sha256('# Release ' || p_brand || CASE WHEN p_size > 10 THEN ': ' || p_name ELSE '' END || chr(10) || chr(10) || '## Metadata' || chr(10) || '- repo: a/b' || chr(10) || '- resource_type: release' || chr(10) || '- release_id: ' || p_partkey::VARCHAR || chr(10) || '- tag_name: ' || p_brand || chr(10) || '- title: ' || CASE WHEN p_size > 10 THEN p_name ELSE '' END
  || chr(10) || '- author: ' || chr(10) || '- created_at: t' || chr(10) || '- published_at: ' || chr(10) || '- draft: ' || (p_size > 25)::VARCHAR || chr(10) || '- prerelease: ' || (p_size < 5)::VARCHAR || chr(10) || '- source_url: u' || chr(10) || chr(10) || '## Body' || chr(10) || chr(10) || CASE WHEN p_type = '' THEN '(empty release body)' ELSE p_type END || chr(10)) AS content_hash FROM part""",
    "review_comment_order": f"SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY {_T('l_shipdate')}, l_returnflag, l_quantity::INT, l_linestatus, l_suppkey, l_partkey, l_linenumber) AS line_order FROM lineitem GROUP BY 1",
    "hydrate_after_limit": "WITH o AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50) SELECT o_orderkey, count(l_partkey) AS n_comments, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey), '') AS parts FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "failure_class": """WITH e AS (SELECT 400 + floor(value)::INT % 130 AS s, event_id % 7 = 0 AS w, lower(event_type) AS t FROM events)
 SELECT s, CASE WHEN s IN (401, 403) THEN 'auth' WHEN s = 429 THEN 'expected_retryable' WHEN s = 404 THEN 'permanent' WHEN s BETWEEN 500 AND 599 THEN 'provider' WHEN s IS NOT NULL THEN 'permanent' END AS page_class,
  CASE WHEN w OR s = 429 THEN 'expected_retryable' WHEN s IN (401, 403) THEN 'auth' WHEN s = 404 THEN 'permanent' WHEN s BETWEEN 500 AND 599 THEN 'provider' ELSE 'permanent' END AS issue_class,
  CASE WHEN s = 429 THEN 'throttled' WHEN s BETWEEN 500 AND 599 THEN 'transient' ELSE 'unavailable' END AS provider_class, count(*) AS n FROM e GROUP BY ALL""",
    "paced_starts": "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS a0, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - 1 AS n FROM events) SELECT event_id, user_id, max(a0 - n * 900000000) OVER (PARTITION BY user_id ORDER BY a0, event_id ROWS UNBOUNDED PRECEDING) + n * 900000000 AS start FROM e",
    "request_metrics": "SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type <> 'view') AS misses, round(sum(value), 4) AS seconds, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) END, 6) AS per_second FROM events GROUP BY 1",
    "attempt_counts": "SELECT user_id, count(*) AS attempts, arg_max(event_type, event_id) AS last_outcome, arg_max(event_type, event_id) IN ('timeout', 'throttled', 'transient') AS retryable FROM events WHERE event_type IS NOT NULL GROUP BY 1",
    "resume_reconcile": _REC + " SELECT * FROM rec",
    "collection_progress": _REC + " SELECT user_id, count(*) FILTER (disposition = 'preserved') AS preserved, count(*) FILTER (disposition = 'attempted') AS attempted, count(*) FILTER (disposition = 'unattempted') AS unattempted, CASE WHEN count(*) FILTER (disposition = 'unattempted') > 0 THEN 'continuation_remaining' ELSE 'exhausted' END AS state FROM rec GROUP BY 1",
    "run_report": """SELECT o_orderpriority, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS interrupted, coalesce(sum(o_orderkey % 11) FILTER (o_custkey % 3 <> 0), 0)::BIGINT AS wrote, coalesce(sum(o_orderkey % 5) FILTER (o_custkey % 3 <> 0), 0)::BIGINT AS skipped,
 coalesce(sum(o_orderkey % 11) FILTER (o_custkey % 3 = 0), 0)::BIGINT AS would_write, coalesce(sum(o_orderkey % 5) FILTER (o_custkey % 3 = 0), 0)::BIGINT AS would_skip FROM orders GROUP BY 1""",
    "run_selection": "SELECT n_name AS name, n_nationkey, n_regionkey > 2 AS enabled FROM nation WHERE n_regionkey > 2",
    "package_accounting": """WITH o AS (SELECT user_id AS package_id, CASE WHEN event_type = 'click' THEN 'completed' WHEN event_type = 'view' THEN 'unchanged' WHEN event_type = 'signup' THEN 'skipped' WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'completed' END ELSE 'unchanged' END AS o FROM events)
 SELECT package_id, count(*) FILTER (o = 'completed') AS completed, count(*) FILTER (o = 'unchanged') AS unchanged, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed, 0::BIGINT AS cancelled, CASE WHEN count(*) FILTER (o = 'failed') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM o GROUP BY 1""",
    "item_problems": f"WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN 'completed' WHEN event_type = 'click' THEN 'failed' ELSE 'skipped' END AS o FROM events) SELECT {_ITEM('event_type')} AS raw_problem, {_ITEM('o')} AS problem, count(*) AS n FROM e GROUP BY ALL",
    "package_references": """WITH r AS (SELECT DISTINCT l_suppkey AS package_id, l_orderkey AS item_id, l_partkey AS path, l_returnflag = 'A' AS diag FROM lineitem), p AS (SELECT p_partkey AS path, CASE WHEN p_size > 30 THEN 'diagnostic' ELSE 'record' END AS role FROM part WHERE p_size > 1),
 bad AS (SELECT package_id, CASE WHEN role IS NULL THEN 'unknown_reference' WHEN (role = 'diagnostic') <> diag THEN 'wrong_role' END AS code FROM r LEFT JOIN p USING (path)), many AS (SELECT package_id, 'claimed_by_several' AS code FROM r GROUP BY package_id, path HAVING count(DISTINCT item_id) > 1)
 SELECT package_id, code, count(*) AS n FROM (SELECT * FROM bad WHERE code IS NOT NULL UNION ALL SELECT * FROM many) GROUP BY ALL""",
    "capability_gap": "SELECT l_orderkey, coalesce(string_agg(c, ',' ORDER BY c) FILTER (c NOT IN ('AF', 'NO')), '') AS gap FROM (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS c FROM lineitem) GROUP BY 1",
    "receipt_differences": "SELECT c_custkey, CASE WHEN n_name <> c_name THEN 'name' ELSE '' END AS keys FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
