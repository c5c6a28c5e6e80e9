"""Late interaction of texts with goals, and the staged ranking of page nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.hypervectors import OFFSET, PRIME
from heddle.functions.interaction import DIM, adaptive_alpha, late_interaction, words_of
from heddle.operators import staged as ops
from heddle.plans.hypervectors import GOAL, GOALS, trees
from heddle.sources.tables import table


def late_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten different texts of each goal with the highest late interaction; ties go to the text that sorts first."""
    texts = table(spark, sf, "conversations").filter("text IS NOT NULL").select("text").distinct()
    goals = F.explode(F.array(*map(F.lit, GOALS)))
    rows = texts.withColumn("words", words_of(F.col("text"))).select("text", "words", goals.alias("goal"))
    rows = rows.withColumn("score", late_interaction(F.col("words"), words_of(F.col("goal"))))
    best = Window.partitionBy("goal").orderBy(F.desc("score"), "text")
    ranked = rows.withColumn("rank", F.row_number().over(best).cast("long")).filter("rank <= 10")
    return ranked.select("goal", "rank", "text", F.round("score", 6).alias("score"))


def staged_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of each page that the stages leave, best first."""
    return ops.staged(trees(spark, sf), GOAL)


def blended_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best nodes of each page by late interaction and whole-text likeness, weighted by the label's number of words."""
    weight = adaptive_alpha(F.size(F.array_remove(F.split("label", r"\s+"), "")))
    nodes = trees(spark, sf, raw=True).filter("label <> ''").select("page_id", "node_id", "role", "text_likeness", F.col("raw").alias("_raw"), weight.alias("a"))
    rows, a = ops.normalised(nodes), F.col("a")  # labels stay where they are made
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), F.col("interaction") * a + F.col("text_likeness") * (1 - a)), 6))
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "node_id")
    ranked = rows.withColumn("rank", F.row_number().over(best).cast("long")).filter("rank <= 10")
    return ranked.select("page_id", "rank", "node_id", "role", "score")


QUERIES = {f.__name__: f for f in (late_topk, staged_nodes, blended_nodes)}

_TOP = (1 << 64) - 1
_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_TOTALS = ", ".join(f"2 * sum((h >> {j}::UBIGINT) & 1)::BIGINT - count(*)" for j in range(DIM))
#: The tree builder is Python: tests hold the two node queries against a plain version.
ORACLE = {
    "late_topk": f"""
WITH goals AS (SELECT unnest([{", ".join(f"'{g}'" for g in GOALS)}]) AS text),
texts AS MATERIALIZED (SELECT text, {_WORDS} AS ws FROM (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL)),
asked AS MATERIALIZED (SELECT text AS goal, unnest({_WORDS}) AS word FROM goals),
words AS MATERIALIZED (SELECT DISTINCT unnest(ws) AS word FROM texts UNION SELECT word FROM asked),
pieces AS (
  SELECT word, encode(substr('<' || word || '>', k, 3)) AS piece FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)
), bytes AS (SELECT word, list_transform(range(0, octet_length(piece)), lambda k: ('0x' || substr(hex(piece), 2 * k + 1, 2))::INT::UHUGEINT) AS b FROM pieces
), hashed AS (
  SELECT word, ((list_reduce(b, lambda x, y: (xor(x, y) * {PRIME}) & {_TOP}::UHUGEINT, {OFFSET}::UHUGEINT) * {PRIME}) & {_TOP}::UHUGEINT)::UBIGINT AS h FROM bytes
), totals AS (SELECT word, [{_TOTALS}] AS t FROM hashed GROUP BY word
), vectors AS MATERIALIZED (
  SELECT word, list_transform(t, lambda z: floor((z / CASE WHEN n > 0 THEN n ELSE 1.0::DOUBLE END + 1.0) * 127.5)::DOUBLE) AS v
  FROM (SELECT word, t, sqrt(list_sum(list_transform(t, lambda z: z * z))::DOUBLE) AS n FROM totals)
), pairs AS MATERIALIZED (
  SELECT a.word AS g, b.word AS w, list_inner_product(a.v, b.v) AS s FROM vectors a, vectors b WHERE a.word IN (SELECT word FROM asked)
), tops AS (
  SELECT t.text, p.g, max(p.s) AS s FROM (SELECT text, unnest(list_distinct(ws)) AS w FROM texts) t JOIN pairs p ON t.w = p.w GROUP BY t.text, p.g
), scored AS (
  SELECT a.goal, x.text, sum(coalesce(t.s, 0.0)) / count(*) AS score
  FROM asked a CROSS JOIN texts x LEFT JOIN tops t ON t.g = a.word AND t.text = x.text GROUP BY a.goal, x.text
)
SELECT goal, rank, text, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY goal ORDER BY score DESC, text) AS rank FROM scored) WHERE rank <= 10""",
}
