"""Registered queries of the manifest and bundle operators, over all bundles and snapshots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestrata.functions.text import path_regex
from lodestrata.operators import bundles as B
from lodestrata.operators import manifests as M
from lodestrata.operators import packages as P
from lodestrata.operators import runs as U
from lodestrata.operators.urls import is_safe_path, page_target
from lodestrata.session import table

ON = ["bundle_name", "snapshot_no"]
FIELDS = ["source_url", "title", "output_path", "fetched_at", "path", "ref", "content_hash", "artifact_path", "is_stale", "loaded_at"]


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The row that counts of each (bundle, snapshot, id): the one loaded last. Combined before the shuffle."""
    rows = table(spark, d, "bundle_artifact").where("bundle_name IS NOT NULL AND snapshot_no IS NOT NULL AND canonical_id IS NOT NULL")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("content_hash", "output_path", "title", "source_url", "fetched_at", "path", "ref", "artifact_path", "is_stale")]
    key = F.struct(F.coalesce("loaded_at", F.lit("1900-01-01").cast("timestamp")).alias("_l"), *text)
    return rows.groupBy(*ON, "canonical_id").agg(F.max_by(F.struct(*FIELDS), key).alias("m")).select(*ON, "canonical_id", "m.*")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """(bundle, snapshot_no, prior_no): each delivered snapshot and the delivered one before it (null for the first)."""
    s = table(spark, d, "bundle_snapshot").where("bundle_name IS NOT NULL AND snapshot_no IS NOT NULL").select("bundle_name", "snapshot_no").distinct()
    return s.withColumn("prior_no", F.lag("snapshot_no").over(Window.partitionBy("bundle_name").orderBy("snapshot_no")))


def _ends(spark, d):
    return table(spark, d, "bundle_snapshot").where("bundle_name IS NOT NULL AND snapshot_no IS NOT NULL").groupBy("bundle_name").agg(F.min("snapshot_no").alias("first_no"), F.max("snapshot_no").alias("last_no"))


def _now(spark, d):
    return entries(spark, d).join(steps(spark, d), ON)


def _prior(spark, d):
    """The entries of the snapshot before, under the number of the later one."""
    s = steps(spark, d).where("prior_no IS NOT NULL").select("bundle_name", F.col("snapshot_no").alias("later"), F.col("prior_no").alias("snapshot_no"))
    return entries(spark, d).join(s, ON).drop("snapshot_no").withColumnRenamed("later", "snapshot_no")


def _files(prior: DataFrame) -> DataFrame:
    return prior.where("NOT coalesce(is_stale, false) AND output_path IS NOT NULL").select(*ON, "output_path").distinct()


def manifest_entries(spark, d):
    e = entries(spark, d)
    return e.select(*ON, "canonical_id", "source_url", "output_path", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("title", "content_hash", "path", "ref", "fetched_at")])


def manifest_duplicates(spark, d):
    return M.duplicates(entries(spark, d), ON, "output_path")


def incremental_status(spark, d):
    prior = _prior(spark, d)
    c = M.classify(_now(spark, d), prior, _files(prior), on=ON, change_keys=["content_hash", "fetched_at"], has_manifest=F.col("prior_no").isNotNull())
    return c.select(*ON, "canonical_id", "status", "reason")


def incremental_counts(spark, d):
    return M.status_counts(incremental_status(spark, d), ON)


def stale_artifacts(spark, d):
    prior = _prior(spark, d)
    return M.stale(prior, _now(spark, d), _files(prior), ON).select(*ON, "output_path", "canonical_id")


def orphaned_artifacts(spark, d):
    e = entries(spark, d)
    last = e.join(_ends(spark, d), "bundle_name").where("snapshot_no = last_no")
    return M.orphans(e, last, ["bundle_name"])


def collision_check(spark, d):
    return M.collisions(_now(spark, d), _prior(spark, d), ON)


def prune_plan(spark, d):
    prior = _prior(spark, d)
    return M.prune_plan(M.stale(prior, _now(spark, d), _files(prior), ON), _now(spark, d).where("is_stale"), ON).select(*ON, "canonical_id", "output_path", "violation")


def _inputs(spark, d):
    """A bundle's snapshots as inputs, the latest first; entries in the order they were loaded in."""
    return entries(spark, d).withColumn("input_index", -F.col("snapshot_no")).withColumn("entry_index", F.unix_micros("loaded_at"))


def bundle_first_wins(spark, d):
    return B.first_wins(_inputs(spark, d), ["bundle_name"]).select("bundle_name", "canonical_id", "input_index", "output_path", "content_hash")


def bundle_duplicates(spark, d):
    return B.numbered(_inputs(spark, d), ["bundle_name"]).where("place > 1").select("bundle_name", "canonical_id", "input_index", "place")


INCLUDE, EXCLUDE = ["*wiki*", "*/team/*", "[0-9]*"], ["*backlog*", "*review"]


def bundle_filtered(spark, d):
    return B.globbed(B.first_wins(_inputs(spark, d), ["bundle_name"]), INCLUDE, EXCLUDE).select("bundle_name", "canonical_id", "title")


def bundle_changed_only(spark, d):
    e = entries(spark, d).join(_ends(spark, d), "bundle_name")
    return B.changed_only(e.where("snapshot_no = last_no"), e.where("snapshot_no = first_no"), ["bundle_name"]).select("bundle_name", "canonical_id", "content_hash")


def _stale_list(spark, d):
    return _prior(spark, d).where("is_stale").withColumn("entry_index", F.unix_micros("loaded_at"))


def bundle_stale_marked(spark, d):
    return B.stale_marked(_now(spark, d), _stale_list(spark, d), ON).select(*ON, "canonical_id", "is_stale")


def bundle_stale_appended(spark, d):
    s = _stale_list(spark, d).select(*ON, "canonical_id", "output_path", "source_url", "entry_index")
    return B.stale_appended(_now(spark, d), s, ON).select(*ON, "canonical_id", "output_path", "source_url")


def bundle_without_stale(spark, d):
    return B.without_stale(B.stale_marked(_now(spark, d), _stale_list(spark, d), ON), F.lit(True), "exclude").select(*ON, "canonical_id")


def bundle_ordered(spark, d):
    return B.ordered(B.first_wins(_inputs(spark, d), ["bundle_name"]), ["bundle_name"], "canonical_id").select("bundle_name", "canonical_id", "position")


def package_coverage(spark, d):
    """The last snapshot's paths as a package's files, the first one's as its inventory."""
    e = entries(spark, d).join(_ends(spark, d), "bundle_name").withColumn("path", F.col("output_path"))
    return P.coverage(e.where("snapshot_no = last_no AND path IS NOT NULL"), e.where("snapshot_no = first_no AND path IS NOT NULL"), "bundle_name")


def package_first_failing_stage(spark, d):
    """Unlisted files fail the inventory, stale entries the items, changed hashes the artifacts; the first failing stage counts."""
    e = entries(spark, d).join(_ends(spark, d), "bundle_name")
    cov = package_coverage(spark, d).select("bundle_name", F.lit(P.STAGES.index("inventory-coverage") + 1).alias("stage_no"))
    chg = bundle_changed_only(spark, d).select("bundle_name", F.lit(P.STAGES.index("artifact-integrity") + 1).alias("stage_no"))
    old = e.where("is_stale AND snapshot_no = last_no").select("bundle_name", F.lit(P.STAGES.index("item-semantics") + 1).alias("stage_no"))
    return P.first_failing_stage(cov.unionByName(chg).unionByName(old), e, "bundle_name")


def package_handoff(spark, d):
    v = ["content_hash", "artifact_path"]
    return P.handoff(_prior(spark, d), _now(spark, d).where("prior_no IS NOT NULL"), [*ON, "canonical_id"], v)


def lineage_checks(spark, d):
    """Each snapshot as a run whose priors are the earlier deliveries, as they came (repeats included)."""
    s = table(spark, d, "bundle_snapshot").where("bundle_name IS NOT NULL AND snapshot_no IS NOT NULL")
    own = s.select("bundle_name", F.col("snapshot_no").alias("own")).distinct()
    seq = s.groupBy("bundle_name").agg(F.array_sort(F.collect_list("snapshot_no")).alias("seq"))
    j = own.join(seq, "bundle_name").withColumn("prior", F.filter("seq", lambda x: x < F.col("own")).cast("array<string>"))
    return j.select("bundle_name", F.col("own").alias("snapshot_no"), P.lineage_problem(F.col("own").cast("string"), "prior", (F.col("own") - 1).cast("string"), F.create_map(F.lit("a"), F.col("own") - 2)).alias("problem"))


def cache_lookup(spark, d):
    """The snapshot before as the cache of the snapshot at hand: same hash, no other fetch time."""
    names = {"content_hash": "page_version", "fetched_at": "last_modified"}
    want = _now(spark, d).select(*ON, "canonical_id", *[F.col(k).alias(v) for k, v in names.items()])
    have = _prior(spark, d).select(*ON, "canonical_id", *[F.col(k).alias(v) for k, v in names.items()], F.col("artifact_path").alias("payload"))
    return U.cache_lookup(want, have, on=[*ON, "canonical_id"]).select(*ON, "canonical_id", "hit", "payload")


def git_selected_paths(spark, d):
    """Repository paths that right-anchored patterns select."""
    p = F.col("path")
    keep = p.rlike(path_regex("docs/*.md")) | p.rlike(path_regex("*.yaml")) | p.rlike(path_regex("src/**"))
    return table(spark, d, "bundle_artifact").where(keep & ~p.rlike(path_regex("src/*-[0-9]*.txt"))).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def page_target_kind(spark, d):
    t = page_target("source_url")
    return table(spark, d, "bundle_artifact").groupBy(t["kind"].alias("kind"), t["page_id"].alias("page_id")).agg(F.count(F.lit(1)).alias("n"))


def safe_paths(spark, d):
    return table(spark, d, "bundle_artifact").groupBy(is_safe_path("artifact_path").alias("artifact_safe"), is_safe_path("source_url").alias("url_safe"), is_safe_path("path").alias("path_safe")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (manifest_entries, manifest_duplicates, incremental_status, incremental_counts, stale_artifacts, orphaned_artifacts, collision_check, prune_plan, bundle_first_wins, bundle_duplicates, bundle_filtered,
                                   bundle_changed_only, bundle_stale_marked, bundle_stale_appended, bundle_without_stale, bundle_ordered, package_coverage, package_first_failing_stage, package_handoff, lineage_checks, cache_lookup,
                                   git_selected_paths, page_target_kind, safe_paths)}

_CTE = """
e AS (SELECT bundle_name, snapshot_no, canonical_id, source_url, title, output_path, fetched_at, path, ref, content_hash, artifact_path, is_stale, loaded_at
      FROM bundle_artifact WHERE bundle_name IS NOT NULL AND snapshot_no IS NOT NULL AND canonical_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY bundle_name, snapshot_no, canonical_id ORDER BY coalesce(loaded_at, TIMESTAMPTZ '1900-01-01 00:00:00+00') DESC, coalesce(content_hash, '') DESC, coalesce(output_path, '') DESC,
        coalesce(title, '') DESC, coalesce(source_url, '') DESC, coalesce(fetched_at, '') DESC, coalesce(path, '') DESC, coalesce(ref, '') DESC, coalesce(artifact_path, '') DESC, coalesce(is_stale::VARCHAR, '') DESC) = 1),
steps AS (SELECT bundle_name, snapshot_no, lag(snapshot_no) OVER (PARTITION BY bundle_name ORDER BY snapshot_no) AS prior_no
          FROM (SELECT DISTINCT bundle_name, snapshot_no FROM bundle_snapshot WHERE bundle_name IS NOT NULL AND snapshot_no IS NOT NULL)),
ends AS (SELECT bundle_name, min(snapshot_no) AS first_no, max(snapshot_no) AS last_no FROM bundle_snapshot WHERE snapshot_no IS NOT NULL GROUP BY 1),
now AS (SELECT e.*, s.prior_no FROM e JOIN steps s USING (bundle_name, snapshot_no)),
prior AS (SELECT e.* REPLACE (s.snapshot_no AS snapshot_no) FROM e JOIN steps s ON s.bundle_name = e.bundle_name AND s.prior_no = e.snapshot_no),
files AS (SELECT DISTINCT bundle_name, snapshot_no, output_path FROM prior WHERE NOT coalesce(is_stale, false) AND output_path IS NOT NULL),
status AS (
  SELECT n.bundle_name, n.snapshot_no, n.canonical_id,
    CASE WHEN n.prior_no IS NULL THEN 'no previous manifest' WHEN p.canonical_id IS NULL THEN 'prior manifest entry missing entirely' WHEN coalesce(n.output_path, '') = '' THEN 'output_path changed'
         WHEN p.output_path IS DISTINCT FROM n.output_path THEN 'output_path changed' WHEN f.output_path IS NULL THEN 'prior artifact missing, so safe rewrite'
         WHEN n.content_hash IS NOT NULL AND p.content_hash IS NOT NULL THEN CASE WHEN n.content_hash = p.content_hash THEN 'content_hash unchanged' ELSE 'content_hash changed' END
         WHEN n.fetched_at IS NOT NULL AND p.fetched_at IS NOT NULL THEN CASE WHEN n.fetched_at = p.fetched_at THEN 'fetched_at unchanged' ELSE 'fetched_at changed' END
         ELSE 'prior manifest entry missing metadata, so safe rewrite' END AS reason
  FROM now n LEFT JOIN prior p USING (bundle_name, snapshot_no, canonical_id)
  LEFT JOIN files f ON f.bundle_name = n.bundle_name AND f.snapshot_no = n.snapshot_no AND f.output_path = p.output_path),
classified AS (SELECT *, CASE WHEN reason IN ('no previous manifest', 'prior manifest entry missing entirely') THEN 'new' WHEN reason LIKE '%unchanged' THEN 'unchanged' ELSE 'changed' END AS status FROM status),
stale AS (SELECT p.* FROM prior p WHERE p.output_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM now n WHERE n.bundle_name = p.bundle_name AND n.snapshot_no = p.snapshot_no AND n.output_path = p.output_path)
          AND EXISTS (SELECT 1 FROM files f WHERE f.bundle_name = p.bundle_name AND f.snapshot_no = p.snapshot_no AND f.output_path = p.output_path)),
inp AS (SELECT *, -snapshot_no AS input_index, epoch_us(loaded_at) AS entry_index, row_number() OVER (PARTITION BY bundle_name, canonical_id ORDER BY -snapshot_no, epoch_us(loaded_at)) AS place FROM e),
first AS (SELECT * FROM inp WHERE place = 1),
marked AS (SELECT n.* REPLACE (coalesce(n.is_stale, false) OR s.c IS NOT NULL AS is_stale) FROM now n LEFT JOIN (SELECT DISTINCT bundle_name b, snapshot_no s, canonical_id c, output_path o FROM prior WHERE is_stale) s
           ON s.b = n.bundle_name AND s.s = n.snapshot_no AND s.c = n.canonical_id AND s.o = n.output_path),
chg AS (SELECT l.bundle_name, l.canonical_id, l.content_hash FROM (SELECT e.* FROM e JOIN ends x USING (bundle_name) WHERE snapshot_no = last_no) l
        LEFT JOIN (SELECT e.* FROM e JOIN ends x USING (bundle_name) WHERE snapshot_no = first_no) f USING (bundle_name, canonical_id) WHERE f.canonical_id IS NULL OR f.content_hash IS NULL OR l.content_hash IS NULL OR f.content_hash <> l.content_hash),
obs AS (SELECT DISTINCT bundle_name, output_path AS path FROM e JOIN ends USING (bundle_name) WHERE snapshot_no = last_no AND output_path IS NOT NULL AND output_path NOT IN ('package.json', 'package.sha256')),
lst AS (SELECT DISTINCT bundle_name, output_path AS path FROM e JOIN ends USING (bundle_name) WHERE snapshot_no = first_no AND output_path IS NOT NULL),
cov AS (SELECT coalesce(o.bundle_name, l.bundle_name) AS bundle_name, coalesce(o.path, l.path) AS path, CASE WHEN o.path IS NULL THEN 'missing_file' ELSE 'unlisted_file' END AS code
        FROM obs o FULL JOIN lst l ON o.bundle_name = l.bundle_name AND o.path = l.path WHERE o.path IS NULL OR l.path IS NULL)
"""


def _q(body: str) -> str:
    return "WITH " + _CTE + body


_ANY = lambda pats: "(" + " OR ".join(f"coalesce({c} GLOB '{p}', false)" for p in pats for c in ("canonical_id", "title", "output_path", "source_url")) + ")"

SQL = {
    "manifest_entries": _q("SELECT bundle_name, snapshot_no, canonical_id, source_url, output_path, nullif(title, '') AS title, nullif(content_hash, '') AS content_hash, nullif(path, '') AS path, nullif(ref, '') AS ref, nullif(fetched_at, '') AS fetched_at FROM e"),
    "manifest_duplicates": _q("SELECT bundle_name, snapshot_no, output_path, count(*) AS n FROM e WHERE output_path IS NOT NULL GROUP BY ALL HAVING count(*) > 1"),
    "incremental_status": _q("SELECT bundle_name, snapshot_no, canonical_id, status, reason FROM classified"),
    "incremental_counts": _q("SELECT bundle_name, snapshot_no, count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status <> 'unchanged') AS n_write, count(*) FILTER (status = 'unchanged') AS n_skip FROM classified GROUP BY ALL"),
    "stale_artifacts": _q("SELECT bundle_name, snapshot_no, output_path, canonical_id FROM stale"),
    "orphaned_artifacts": _q("SELECT DISTINCT bundle_name, output_path FROM e WHERE output_path LIKE '%.md' AND NOT EXISTS (SELECT 1 FROM e l JOIN ends x ON x.bundle_name = l.bundle_name AND x.last_no = l.snapshot_no WHERE l.bundle_name = e.bundle_name AND l.output_path = e.output_path)"),
    "collision_check": _q("SELECT n.bundle_name, n.snapshot_no, n.output_path, n.canonical_id, p.prior_id FROM now n JOIN (SELECT DISTINCT bundle_name, snapshot_no, output_path, canonical_id AS prior_id FROM prior) p USING (bundle_name, snapshot_no, output_path) WHERE n.canonical_id <> p.prior_id"),
    "prune_plan": _q("SELECT s.bundle_name, s.snapshot_no, s.canonical_id, s.output_path, CASE WHEN s.output_path LIKE '/%' OR contains(s.output_path, '\\') OR regexp_matches(s.output_path, '(^|/)\\.\\.?(/|$)') THEN 'outside the output folder' WHEN s.output_path NOT LIKE '%.md' THEN 'not a markdown file' WHEN r.output_path IS NOT NULL THEN 'still referenced' END AS violation FROM stale s LEFT JOIN (SELECT DISTINCT bundle_name, snapshot_no, output_path FROM now WHERE is_stale) r USING (bundle_name, snapshot_no, output_path)"),
    "bundle_first_wins": _q("SELECT bundle_name, canonical_id, input_index, output_path, content_hash FROM first"),
    "bundle_duplicates": _q("SELECT bundle_name, canonical_id, input_index, place FROM inp WHERE place > 1"),
    "bundle_filtered": _q(f"SELECT bundle_name, canonical_id, title FROM first WHERE {_ANY(INCLUDE)} AND NOT {_ANY(EXCLUDE)}"),
    "bundle_changed_only": _q("SELECT * FROM chg"),
    "bundle_stale_marked": _q("SELECT bundle_name, snapshot_no, canonical_id, is_stale FROM marked"),
    "bundle_stale_appended": _q(""", c0 AS (SELECT p.bundle_name, p.snapshot_no, p.canonical_id, p.output_path, p.source_url, epoch_us(p.loaded_at) AS entry_index FROM prior p WHERE p.is_stale AND coalesce(p.source_url, '') <> ''
   AND NOT EXISTS (SELECT 1 FROM now n WHERE n.bundle_name = p.bundle_name AND n.snapshot_no = p.snapshot_no AND (n.canonical_id = p.canonical_id OR n.output_path = p.output_path))),
 c1 AS (SELECT * FROM c0 QUALIFY row_number() OVER (PARTITION BY bundle_name, snapshot_no, canonical_id ORDER BY entry_index, output_path, source_url) = 1),
 c2 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY bundle_name, snapshot_no, output_path ORDER BY entry_index, canonical_id, source_url) = 1)
 SELECT bundle_name, snapshot_no, canonical_id, output_path, source_url FROM c2"""),
    "bundle_without_stale": _q("SELECT bundle_name, snapshot_no, canonical_id FROM marked WHERE NOT is_stale"),
    "bundle_ordered": _q("SELECT bundle_name, canonical_id, row_number() OVER (PARTITION BY bundle_name ORDER BY canonical_id) AS position FROM first"),
    "package_coverage": _q("SELECT * FROM cov"),
    "package_first_failing_stage": _q(""", f AS (SELECT bundle_name, 7 AS s FROM cov UNION ALL SELECT bundle_name, 11 FROM chg UNION ALL SELECT bundle_name, 9 FROM e JOIN ends USING (bundle_name) WHERE is_stale AND snapshot_no = last_no),
 m AS (SELECT b.bundle_name, min(f.s) AS s FROM (SELECT DISTINCT e.bundle_name FROM e JOIN ends USING (bundle_name)) b LEFT JOIN f USING (bundle_name) GROUP BY 1)
 SELECT bundle_name, CASE WHEN s IS NULL THEN 'verified' ELSE 'rejected' END AS state, CASE s WHEN 7 THEN 'inventory-coverage' WHEN 11 THEN 'artifact-integrity' WHEN 9 THEN 'item-semantics' END AS failed_stage,
        CASE WHEN s IS NULL THEN 'complete' WHEN s = 7 THEN 'path-safety' WHEN s = 11 THEN 'lineage' ELSE 'terminal-accounting' END AS last_completed_stage FROM m"""),
    "package_handoff": _q("SELECT coalesce(p.bundle_name, n.bundle_name) AS bundle_name, coalesce(p.snapshot_no, n.snapshot_no) AS snapshot_no, coalesce(p.canonical_id, n.canonical_id) AS canonical_id, CASE WHEN n.canonical_id IS NULL THEN 'missing' WHEN p.canonical_id IS NULL THEN 'unexpected' ELSE 'different' END AS code FROM prior p FULL JOIN (SELECT * FROM now WHERE prior_no IS NOT NULL) n ON n.bundle_name = p.bundle_name AND n.snapshot_no = p.snapshot_no AND n.canonical_id = p.canonical_id WHERE p.canonical_id IS NULL OR n.canonical_id IS NULL OR p.content_hash IS DISTINCT FROM n.content_hash OR p.artifact_path IS DISTINCT FROM n.artifact_path"),
    "lineage_checks": """WITH s AS (SELECT bundle_name, snapshot_no FROM bundle_snapshot WHERE bundle_name IS NOT NULL AND snapshot_no IS NOT NULL), own AS (SELECT DISTINCT bundle_name, snapshot_no AS own FROM s),
 j AS (SELECT o.bundle_name, o.own, count(s.snapshot_no) AS n, count(DISTINCT s.snapshot_no) AS k, coalesce(bool_or(s.snapshot_no = o.own - 1), false) AS has FROM own o LEFT JOIN s ON s.bundle_name = o.bundle_name AND s.snapshot_no < o.own GROUP BY ALL)
 SELECT bundle_name, own AS snapshot_no, CASE WHEN n <> k THEN 'duplicate_prior' WHEN NOT has THEN 'resumes_unknown_run' WHEN own - 2 < 0 THEN 'negative_attempts' END AS problem FROM j""",
    "cache_lookup": _q(", x AS (SELECT n.bundle_name, n.snapshot_no, n.canonical_id, coalesce(p.content_hash = n.content_hash AND (p.fetched_at IS NULL OR n.fetched_at IS NULL OR p.fetched_at = n.fetched_at), false) AS hit, p.artifact_path FROM now n LEFT JOIN prior p USING (bundle_name, snapshot_no, canonical_id)) SELECT bundle_name, snapshot_no, canonical_id, hit, CASE WHEN hit THEN artifact_path END AS payload FROM x"),
    "git_selected_paths": r"SELECT path, count(*) AS n FROM bundle_artifact WHERE (regexp_matches(path, '(^|/)docs/[^/]*\.md$') OR regexp_matches(path, '(^|/)[^/]*\.yaml$') OR regexp_matches(path, '(^|/)src/[^/]*$')) AND NOT regexp_matches(path, '(^|/)src/[^/]*-[0-9][^/]*\.txt$') GROUP BY 1",
    "page_target_kind": r"""SELECT kind, page_id, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(t, '\d+') THEN 'page_id' WHEN t = '' THEN 'empty' WHEN contains(t, '://') THEN CASE WHEN regexp_matches(t, '(?i)^https?://[^/?#\s]+') THEN 'url' ELSE 'invalid_url' END ELSE 'unknown' END AS kind,
 CASE WHEN regexp_full_match(t, '\d+') THEN t WHEN regexp_matches(t, '(?i)^https?://[^/?#\s]+') THEN nullif(regexp_extract(regexp_extract(t, '^[^:]+://[^/?#]*([^?#]*)', 1), '/pages/(\d+)(?:/|$)', 1), '') END AS page_id FROM (SELECT trim(coalesce(source_url, '')) AS t FROM bundle_artifact)) GROUP BY ALL""",
    "safe_paths": "SELECT artifact_safe, url_safe, path_safe, count(*) AS n FROM (SELECT " + ", ".join(f"(coalesce({c}, '') <> '' AND NOT contains({c}, '\\') AND {c} NOT LIKE '/%' AND {c} NOT LIKE '%/' AND NOT contains({c}, '//') AND NOT regexp_matches({c}, '(^|/)\\.{{1,2}}(/|$)')) AS {a}" for c, a in (("artifact_path", "artifact_safe"), ("source_url", "url_safe"), ("path", "path_safe"))) + " FROM bundle_artifact) GROUP BY ALL",
}
