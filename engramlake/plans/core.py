"""Queries of the general data problems: hierarchies and change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engramlake.operators import changefeed, hierarchy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.found(table(spark, sf_dir, "asper_record"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with root, depth, path (joined by '/'), subtree size and its place to circles."""
    return hierarchy.hierarchy(table(spark, sf_dir, "asper_record")).selectExpr(
        "id", "root", "depth", "array_join(path, '/') as path", "subtree_size", "on_circle", "into_circle"
    )


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.successors(table(spark, sf_dir, "asper_record"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.found(table(spark, sf_dir, "asper_record"), table(spark, sf_dir, "asper_op"))


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changefeed.current_state(table(spark, sf_dir, "asper_record"), table(spark, sf_dir, "asper_op"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p2_state)
}

_WALK = """
WITH RECURSIVE node AS (SELECT lower(id) AS k, id, lower(supersedes) AS p FROM asper_record),
link AS (SELECT c.k, c.id, c.p, q.id AS pid FROM node c JOIN node q ON c.p = q.k),
walk AS (
  SELECT k AS start, k AS cur, [id] AS seen, NULL::VARCHAR[] AS ring FROM node
  UNION ALL
  SELECT w.start, l.p, list_append(w.seen, l.pid), CASE WHEN list_contains(w.seen, l.pid) THEN w.seen[list_position(w.seen, l.pid):] END
  FROM walk w JOIN link l ON l.k = w.cur WHERE w.ring IS NULL
),
ends AS (
  SELECT n.id, w.ring, w.seen, n.p IN (SELECT k FROM node) AS has_parent
  FROM walk w JOIN node n ON n.k = w.start
  WHERE w.ring IS NOT NULL OR w.cur NOT IN (SELECT k FROM link)
)
"""

_JOURNAL = """
WITH same AS (
  SELECT min(seq) AS seq, any_value(kind) AS kind, any_value("at") AS raw, any_value(record) AS record, any_value(lower(id)) AS id, any_value(content) AS content
  FROM asper_op GROUP BY kind, "at", record, lower(id), content, reason, "value", ids, project
),
ops AS (
  SELECT seq, kind, CASE WHEN raw > 100000000000 THEN raw // 1000 ELSE raw END AS t,
    CASE WHEN kind = 'insert' THEN lower(record.id) ELSE id END AS id, coalesce(content, record.content) AS content, coalesce(record.deprecated, false) AS off
  FROM same WHERE raw IS NOT NULL AND (kind IN ('deprecate', 'keep') OR (kind = 'insert' AND record.content IS NOT NULL) OR (kind = 'update' AND content IS NOT NULL))
),
base AS (SELECT lower(id) AS id, deprecated AS off, content, updated_at FROM asper_record),
starts AS (
  SELECT id, NULL::BIGINT AS seq, NULL::BIGINT AS t, off, content, updated_at FROM base
  UNION ALL
  SELECT id, arg_min(seq, (t, seq)), min(t), arg_min(off, (t, seq)), arg_min(content, (t, seq)), min(t) FROM ops
  WHERE kind = 'insert' AND id NOT IN (SELECT id FROM base) GROUP BY id
),
ev AS (
  SELECT o.id, o.seq, o.t, o.kind, o.content, s.off,
    last_value(CASE WHEN o.kind <> 'update' THEN o.kind END IGNORE NULLS) OVER (PARTITION BY o.id ORDER BY o.t, o.seq ROWS UNBOUNDED PRECEDING) AS st
  FROM ops o JOIN starts s ON o.id = s.id
  WHERE o.kind <> 'insert' AND (s.t IS NULL OR (o.t, o.seq) > (s.t, s.seq))
),
ups AS (
  SELECT id, max(seq) FILTER (WHERE r = 1) AS seq, max(t) FILTER (WHERE r = 1) AS t, max(content) FILTER (WHERE r = 1) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, seq DESC) AS r FROM ev WHERE kind = 'update' AND coalesce(st = 'keep', NOT off)) GROUP BY id
),
fin AS (SELECT id, arg_max(kind, (t, seq)) AS st FROM ev WHERE kind <> 'update' GROUP BY id),
live AS (
  SELECT s.id, coalesce(u.content, s.content) AS content, coalesce(u.t, s.updated_at) AS updated_at, coalesce(u.seq, s.seq) AS seq
  FROM starts s LEFT JOIN ups u ON u.id = s.id LEFT JOIN fin f ON f.id = s.id WHERE coalesce(f.st = 'keep', NOT s.off)
)
"""

ORACLES = {
    "p1_found": _WALK
    + "SELECT id, CASE WHEN ring IS NULL THEN seen[len(seen)] ELSE list_min(ring) END AS root, CAST(CASE WHEN ring IS NULL THEN len(seen) - 1 ELSE -1 END AS BIGINT) AS depth FROM ends WHERE has_parent",
    "p1_descendants": _WALK
    + "SELECT DISTINCT seen[i] AS id, e.id AS descendant, CAST(i - 1 AS BIGINT) AS distance FROM ends e, unnest(range(2, len(seen) + CASE WHEN ring IS NULL THEN 1 ELSE 0 END)) AS u(i)",
    "p1_hierarchy": _WALK
    + """, sizes AS (SELECT a AS id, count(DISTINCT id) AS n FROM (SELECT id, unnest(CASE WHEN ring IS NULL THEN seen ELSE list_distinct(seen) END) AS a FROM ends) GROUP BY a)
SELECT e.id, CASE WHEN ring IS NULL THEN seen[len(seen)] ELSE list_min(ring) END AS root, CAST(CASE WHEN ring IS NULL THEN len(seen) - 1 ELSE -1 END AS BIGINT) AS depth,
  CASE WHEN ring IS NULL THEN array_to_string(list_reverse(seen), '/') END AS path,
  CAST(CASE WHEN ring IS NOT NULL AND list_contains(ring, e.id) THEN 1 + (SELECT count(*) FROM ends o WHERE o.ring IS NOT NULL AND NOT list_contains(o.ring, o.id) AND list_contains(o.seen, e.id) AND o.seen[len(o.seen) - len(o.ring)] IS NOT NULL AND o.ring[1] = e.id) ELSE s.n END AS BIGINT) AS subtree_size,
  coalesce(list_contains(ring, e.id), false) AS on_circle, ring IS NOT NULL AS into_circle
FROM ends e JOIN sizes s ON s.id = e.id""",
    "p2_found": _JOURNAL + "SELECT id, seq FROM live WHERE seq IS NOT NULL",
    "p2_state": _JOURNAL + "SELECT id, content, updated_at, seq FROM live",
}
