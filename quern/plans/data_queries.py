"""Registered queries of the general data-processing operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hierarchy, instants, schema_drift, upsert
from quern.session import cut, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.lineage(table(spark, sf, "sessions"))


def p1_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.resolve(table(spark, sf, "sessions"), "id", "parent_session_id", paths=True).select(F.col("id").alias("session_id"), F.col("root").alias("root_session_id"), "depth", "path", "is_cycle")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(table(spark, sf, "sessions"), "id", "parent_session_id", paths=True))


def p1_circle_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """What p1_descendants leaves out by its SQL: the pairs of lineages that never end."""
    return hierarchy.circle_descendants(hierarchy.resolve(table(spark, sf, "sessions"), "id", "parent_session_id", paths=True))


def p1_cut_points(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.cut_points(table(spark, sf, "sessions"), table(spark, sf, "messages"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.records(table(spark, sf, "sessions"), table(spark, sf, "messages"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.changes(_records(spark, sf), table(spark, sf, "source_files"))


def p3_unified(spark: SparkSession, sf: str) -> DataFrame:
    m, s = table(spark, sf, "messages"), table(spark, sf, "sessions")
    rows = m.select(F.lit("message").alias("record_kind"), "file_id", F.col("delivery_id").cast("string").alias("record_id"), "options").unionByName(s.select(F.lit("session").alias("record_kind"), "file_id", F.col("id").alias("record_id"), "options"))
    renames = cut(p3_found(spark, sf).where("change_kind = 'renamed'").drop("change_kind"), "renames")
    return schema_drift.unify(rows, renames, table(spark, sf, "source_files"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return instants.archive_instants(*(table(spark, sf, t) for t in ("messages", "sessions", "head_entries", "hosts")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.surplus(table(spark, sf, "messages"))


def p7_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.survivors(table(spark, sf, "messages"), ["role", "timestamp"]).withColumn("delivered_at", F.col("delivered_at").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_circle_descendants, p1_cut_points, p3_found, p3_unified, p5_found, p7_found, p7_survivors)}

_WALK = """
WITH RECURSIVE named AS (
  SELECT id, min(CASE WHEN trim(parent_session_id) <> '' THEN parent_session_id END) AS parent FROM sessions WHERE id IS NOT NULL GROUP BY id),
edge AS (SELECT n.id, n.parent FROM named n JOIN named p ON n.parent = p.id),
walk AS (
  SELECT id, id AS cur, 0::BIGINT AS depth, [id] AS trail, false AS loops FROM named
  UNION ALL
  SELECT w.id, e.parent, w.depth + 1, list_append(w.trail, e.parent), list_contains(w.trail, e.parent)
  FROM walk w JOIN edge e ON w.cur = e.id WHERE NOT w.loops),
ended AS (
  SELECT id, cur, depth, trail, loops FROM walk w WHERE loops OR NOT EXISTS (SELECT 1 FROM edge e WHERE e.id = w.cur)),
solved AS (
  SELECT id, CASE WHEN loops THEN list_min(trail[list_position(trail, cur):]) ELSE cur END AS root, CASE WHEN loops THEN -1 ELSE depth END AS depth,
         CASE WHEN loops THEN NULL ELSE array_to_string(list_reverse(trail), ' > ') END AS path, loops, trail FROM ended)
"""
_KEYED = "(SELECT *, lower(trim(id, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS message_key FROM messages WHERE session_id IS NOT NULL AND id IS NOT NULL)"

ORACLES = {
    "p1_found": _WALK + "SELECT s.id AS session_id, s.root AS root_session_id, s.depth FROM solved s JOIN named n ON n.id = s.id WHERE n.parent IS NOT NULL",
    "p1_paths": _WALK + "SELECT id AS session_id, root AS root_session_id, depth, path, loops AS is_cycle FROM solved",
    "p1_descendants": _WALK + """SELECT a.ancestor, s.id AS descendant, a.distance::BIGINT AS distance FROM solved s,
        LATERAL (SELECT unnest(s.trail) AS ancestor, generate_subscripts(s.trail, 1) - 1 AS distance) a WHERE NOT s.loops AND a.distance > 0""",
    "p1_circle_descendants": _WALK + """SELECT a.ancestor, s.id AS descendant, min(a.distance)::BIGINT AS distance FROM solved s,
        LATERAL (SELECT unnest(s.trail) AS ancestor, generate_subscripts(s.trail, 1) - 1 AS distance) a WHERE s.loops AND a.ancestor <> s.id GROUP BY a.ancestor, s.id""",
    "p1_cut_points": """
WITH s AS (SELECT DISTINCT id, CASE WHEN trim(parent_session_id) <> '' THEN parent_session_id END AS parent, CASE WHEN trim(parent_message_id) <> '' THEN lower(trim(parent_message_id)) END AS cut FROM sessions WHERE id IS NOT NULL)
SELECT s.id AS session_id, s.cut AS cut_point, CASE WHEN cut IS NULL THEN 'none' WHEN parent IS NULL THEN 'no_parent'
  WHEN parent NOT IN (SELECT id FROM sessions WHERE id IS NOT NULL) THEN 'parent_absent'
  WHEN NOT EXISTS (SELECT 1 FROM """ + _KEYED + """ m WHERE m.session_id = s.parent AND m.message_key = s.cut) THEN 'message_absent' ELSE 'ok' END AS state FROM s""",
    "p7_found": "SELECT delivery_id FROM (SELECT delivery_id, row_number() OVER (PARTITION BY session_id, message_key ORDER BY delivered_at, delivery_id) AS rn FROM " + _KEYED + ") WHERE rn > 1",
    "p7_survivors": "SELECT session_id, message_key, delivery_id, CAST(delivered_at AT TIME ZONE 'UTC' AS TIMESTAMP) AS delivered_at, role, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY session_id, message_key ORDER BY delivered_at, delivery_id) AS rn FROM " + _KEYED + ") WHERE rn = 1",
}
