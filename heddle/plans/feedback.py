"""Explicit feedback on fields of conversations: what edges between roles and zones of turns learn from a list of goals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.field import goal_cluster
from heddle.operators import feedback as ops
from heddle.sources.tables import table, written

#: Goals that every conversation is asked, in this order; a turn answers one by the share of its words that it holds.
GOALS = ("the river", "que reaux ment", "und ieren", "tion erent ie")
#: Conversations of one field.
FIELD = 20


def feedback_log(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each turn and goal: twenty conversations are a field, each goal to a conversation is a feedback, turns are nodes on a path."""
    rows = table(spark, sf, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    rows = rows.select(F.floor(F.col("conv_id") / FIELD).alias("field"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    path = Window.partitionBy("field", "conv_id").orderBy("turn")
    at = F.dense_rank().over(Window.partitionBy("field").orderBy("conv_id")) - 1
    rows = rows.withColumn("parent_role", F.lag("role").over(path)).withColumn("at", at)

    def asked(k: int, goal: str):
        words = goal.split()
        share = sum(F.contains("text", F.lit(w)).cast("int") for w in words) / F.lit(float(len(words)))
        return F.struct(F.lit(k).alias("k"), goal_cluster(F.lit(goal)).alias("cluster"), share.alias("amplitude"))

    rows = rows.select("*", F.inline(F.array(*(asked(k, g) for k, g in enumerate(GOALS)))))
    n = (F.col("at") * len(GOALS) + F.col("k") + 1).cast("int")
    return rows.select(
        "field", n.alias("n"), n.alias("t"), "cluster", "role", "parent_role", F.col("turn").cast("int").alias("depth"), "amplitude", (F.col("amplitude") >= 0.5).alias("success")
    )


def edge_regrets(spark: SparkSession, sf: str) -> DataFrame:
    return ops.edge_regrets(written(feedback_log(spark, sf), "feedback"))


def answer_zones(spark: SparkSession, sf: str) -> DataFrame:
    return ops.answer_zones(written(feedback_log(spark, sf), "feedback"))


QUERIES = {f.__name__: f for f in (feedback_log, edge_regrets, answer_zones)}


def _cluster(goal: str) -> str:
    return "+".join(sorted({w for w in goal.split() if len(w.encode()) > 3})[:3]) or "_"


def _share(goal: str) -> str:
    words = goal.split()
    return "(" + " + ".join(f"contains(text, '{w}')::INT" for w in words) + f")::DOUBLE / {len(words)}"


_LOG = f"""
turns AS (
  SELECT conv_id // {FIELD} AS field, turn, coalesce(role, '') AS role, lower(coalesce(text, '')) AS text,
    lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_role,
    dense_rank() OVER (PARTITION BY conv_id // {FIELD} ORDER BY conv_id) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), log AS MATERIALIZED ({" UNION ALL ".join(
    f"SELECT field, (place * {len(GOALS)} + {k + 1})::INT AS n, (place * {len(GOALS)} + {k + 1})::INT AS t, '{_cluster(g)}' AS cluster, role, parent_role, turn::INT AS depth,"
    f" {_share(g)} AS amplitude, {_share(g)} >= 0.5 AS success FROM turns" for k, g in enumerate(GOALS))})"""
ORACLE = {
    "feedback_log": f"WITH {_LOG} SELECT * FROM log",
    "edge_regrets": f"""
WITH {_LOG}, beats AS (
  SELECT field, n // {ops.BEAT} AS b, CASE WHEN max(t) > 1 THEN pow(max(t), 1.5) / (pow(max(t), 1.5) + 1) ELSE 0.5 END AS plus,
    CASE WHEN max(t) > 1 THEN pow(max(t), 2.0) / (pow(max(t), 2.0) + 1) ELSE 0.5 END AS minus
  FROM log WHERE n % {ops.BEAT} = 0 GROUP BY field, n
), weights AS (
  SELECT field, b - 1 AS b, exp(sum(ln(plus)) OVER later) AS plus, exp(sum(ln(minus)) OVER later) AS minus
  FROM beats WINDOW later AS (PARTITION BY field ORDER BY b DESC)
), edges AS (
  SELECT field, n // {ops.BEAT} AS b, unnest([parent_role || ':down:' || cluster, role || ':up:' || cluster]) AS edge,
    CASE WHEN success THEN greatest(least(amplitude, 1), 0.1) ELSE -greatest(1 - least(amplitude, 1), 0.1) END AS r
  FROM log WHERE parent_role IS NOT NULL
)
SELECT e.field, edge, round(sum(CASE WHEN r > 0 THEN r * coalesce(plus, 1) ELSE 0 END), 6) AS gained,
  round(sum(CASE WHEN r > 0 THEN 0 ELSE r * coalesce(minus, 1) END), 6) AS lost
FROM edges e LEFT JOIN weights w ON e.field = w.field AND e.b = w.b GROUP BY e.field, edge""",
    "answer_zones": f"""
WITH RECURSIVE {_LOG}, sums AS MATERIALIZED (
  SELECT field, role || ':' || CASE WHEN depth <= 1 THEN 'shallow' WHEN depth <= 4 THEN 'mid' ELSE 'deep' END AS zone, (n - 1) // {ops.DECAY_BEAT} AS b,
    sum(success::INT)::DOUBLE AS s, count(*)::DOUBLE AS o
  FROM log WHERE success OR amplitude > 0.3 GROUP BY ALL
), ends AS (SELECT field, max(n) // {ops.DECAY_BEAT} AS decays FROM log GROUP BY field
), steps AS MATERIALIZED (
  SELECT z.field, z.zone, e.decays, k.b, coalesce(x.s, 0.0) AS s, coalesce(x.o, 0.0) AS o
  FROM (SELECT DISTINCT field, zone FROM sums) z JOIN ends e ON z.field = e.field
  JOIN (SELECT field, unnest(range(0, decays + 1)) AS b FROM ends) k ON k.field = z.field LEFT JOIN sums x ON x.field = z.field AND x.zone = z.zone AND x.b = k.b
), fold(field, zone, b, s, o) AS (
  SELECT field, zone, -1, 0.0::DOUBLE, 0.0::DOUBLE FROM steps WHERE b = 0
  UNION ALL
  SELECT f.field, f.zone, p.b, CASE WHEN p.b >= p.decays THEN f.s + p.s WHEN (f.o + p.o) * {ops.DECAY} >= {ops.LEAST} THEN (f.s + p.s) * {ops.DECAY} ELSE 0 END,
    CASE WHEN p.b >= p.decays THEN f.o + p.o WHEN (f.o + p.o) * {ops.DECAY} >= {ops.LEAST} THEN (f.o + p.o) * {ops.DECAY} ELSE 0 END
  FROM fold f JOIN steps p ON f.field = p.field AND f.zone = p.zone AND p.b = f.b + 1
)
SELECT f.field, f.zone, round(s, 6) AS hits, round(o, 6) AS seen, round(CASE WHEN o >= 3 THEN 0.7 + s / o * 0.6 ELSE 1 END, 6) AS boost
FROM fold f JOIN ends e ON f.field = e.field WHERE f.b = e.decays AND o > 0""",
}
