"""Queries p1_... (hierarchies) and p3_... (snapshot changes) over their whole tables, and the same in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import hierarchy as H
from lodestrata.operators import snapshots as S
from lodestrata.session import app_dir, cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages on a cycle of child links."""
    return H.cycle_members(H.page_links(cut(H.current_rows(table(spark, d, "pages")))))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(H.current_rows(table(spark, d, "pages")))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every page's place: parent, root, depth, path, and its descendants as an interval of numbers below its root."""
    return _tree(spark, d).withColumn("path", F.array_join("path", "/"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of each page whose id is divisible by 100 (the stated query set), against all pages."""
    tree = cut(_tree(spark, d))
    return H.descendants(tree, tree.where(F.try_to_number("id", F.lit("999999999999999999")) % 100 == 0))


def p1_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """As ``p1_descendants``, but along every link: those of all parents of a page and those on cycles."""
    cur = cut(H.current_rows(table(spark, d, "pages")))
    return H.all_descendants(cur, cur.where(F.try_to_number("id", F.lit("999999999999999999")) % 100 == 0))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records added, removed or changed between consecutive delivered snapshots of a bundle.

    The keys' ordinals are kept below ``spark.lodestrata.dictionaries``, from run to run, or for this application if that is unset.
    """
    kept = f"{spark.conf.get('spark.lodestrata.dictionaries', None) or app_dir(spark)}/p3-{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    return S.snapshot_changes(
        table(spark, d, "bundle_artifact"), table(spark, d, "bundle_snapshot"), grp="bundle_name", snap="snapshot_no", key="canonical_id", loaded="loaded_at",
        values={"content_hash": S.packed(S.normal_hash("content_hash")), "is_stale": F.coalesce("is_stale", F.lit(False))}, dictionary=kept)


QUERIES = {"p1_found": p1_found, "p1_hierarchy": p1_hierarchy, "p1_descendants": p1_descendants, "p1_all_descendants": p1_all_descendants, "p3_found": p3_found}

_LINKS = r"""
cur AS (SELECT id, child_page_ids FROM pages WHERE id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, fetched_at DESC NULLS LAST) = 1),
links AS (SELECT DISTINCT c.id AS p, k.kid AS c FROM cur c, LATERAL (SELECT trim(u.x, E' \t\n\r ') AS kid FROM unnest(c.child_page_ids) AS u(x)) k
          WHERE k.kid <> '' AND k.kid IN (SELECT id FROM cur)),
reach(a, b) AS (SELECT p, c FROM links UNION SELECT r.a, l.c FROM reach r JOIN links l ON l.p = r.b)
"""
_FOREST = r"""
WITH RECURSIVE """ + _LINKS + r""",
kept AS (SELECT l.* FROM links l WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.a = l.c AND r.b = l.p) AND l.p <> l.c),
up AS (SELECT c AS id, min(p) AS parent FROM kept GROUP BY c),
walk(id, parent, root, depth, path) AS (
  SELECT cur.id, NULL::VARCHAR, cur.id, 0, cur.id FROM cur WHERE cur.id NOT IN (SELECT id FROM up)
  UNION ALL SELECT u.id, u.parent, w.root, w.depth + 1, w.path || '/' || u.id FROM walk w JOIN up u ON u.parent = w.id)
"""

SQL = {
    "p1_found": "WITH RECURSIVE " + _LINKS + " SELECT DISTINCT a AS id FROM reach WHERE a = b",
    "p1_all_descendants": "WITH RECURSIVE " + _LINKS + " SELECT DISTINCT a AS id, b AS descendant FROM reach WHERE a <> b AND TRY_CAST(a AS BIGINT) % 100 = 0",
    "p1_descendants": _FOREST + """, below(id, descendant, distance) AS (
  SELECT w.id, w.id, 0 FROM walk w WHERE TRY_CAST(w.id AS BIGINT) % 100 = 0
  UNION ALL SELECT b.id, u.id, b.distance + 1 FROM below b JOIN up u ON u.parent = b.descendant)
SELECT id, descendant, distance FROM below WHERE distance > 0""",
    "p3_found": r"""
WITH rec AS (
  SELECT bundle_name, snapshot_no, canonical_id,
         nullif(regexp_replace(regexp_replace(regexp_replace(lower(content_hash), '^\s+', ''), '\s+$', ''), '^[a-z][a-z0-9+._/-]*\s*:\s*', ''), '') AS h,
         coalesce(is_stale, false) AS s, loaded_at
  FROM bundle_artifact WHERE bundle_name IS NOT NULL AND snapshot_no IS NOT NULL AND canonical_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY bundle_name, snapshot_no, canonical_id ORDER BY loaded_at DESC NULLS LAST, h DESC NULLS LAST, s DESC) = 1),
pairs AS (
  SELECT bundle_name, lag(snapshot_no) OVER (PARTITION BY bundle_name ORDER BY snapshot_no) AS a, snapshot_no AS b
  FROM (SELECT DISTINCT bundle_name, snapshot_no FROM bundle_snapshot) QUALIFY a IS NOT NULL)
SELECT p.bundle_name, p.b AS snapshot_no, n.canonical_id, 'added' AS change FROM pairs p JOIN rec n ON n.bundle_name = p.bundle_name AND n.snapshot_no = p.b
  LEFT JOIN rec o ON o.bundle_name = p.bundle_name AND o.snapshot_no = p.a AND o.canonical_id = n.canonical_id WHERE o.canonical_id IS NULL
UNION ALL
SELECT p.bundle_name, p.b, o.canonical_id, 'removed' FROM pairs p JOIN rec o ON o.bundle_name = p.bundle_name AND o.snapshot_no = p.a
  LEFT JOIN rec n ON n.bundle_name = p.bundle_name AND n.snapshot_no = p.b AND n.canonical_id = o.canonical_id WHERE n.canonical_id IS NULL
UNION ALL
SELECT p.bundle_name, p.b, n.canonical_id, 'changed' FROM pairs p JOIN rec n ON n.bundle_name = p.bundle_name AND n.snapshot_no = p.b
  JOIN rec o ON o.bundle_name = p.bundle_name AND o.snapshot_no = p.a AND o.canonical_id = n.canonical_id
  WHERE n.h IS DISTINCT FROM o.h OR n.s <> o.s""",
}
SQL["p1_hierarchy"] = _FOREST + """,
anc(id, above) AS (SELECT id, id FROM walk UNION ALL SELECT a.id, u.parent FROM anc a JOIN up u ON u.id = a.above),
sized AS (SELECT w.*, (SELECT count(*) FROM anc a WHERE a.above = w.id) AS size FROM walk w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY size DESC, id) AS rk FROM sized),
offs AS (SELECT *, CASE WHEN parent IS NULL THEN 0 ELSE 1 + coalesce(sum(size) OVER (PARTITION BY parent ORDER BY rk > 1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS off FROM ranked),
no AS (SELECT a.id, sum(o.off)::BIGINT AS n FROM anc a JOIN offs o ON o.id = a.above GROUP BY a.id)
SELECT o.id, o.parent, o.root, o.depth, o.path, (o.size - 1)::BIGINT AS n_descendants, no.n AS first_no, (no.n + o.size - 1)::BIGINT AS last_no,
       EXISTS (SELECT 1 FROM reach r WHERE r.a = o.id AND r.b = o.id) AS on_cycle
FROM offs o JOIN no ON no.id = o.id"""
