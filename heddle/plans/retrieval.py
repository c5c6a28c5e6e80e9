"""Queries: tokens, term statistics, BM25, prefix fallback, ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import STOP_WORDS, text_similarity, tokens
from heddle.operators import retrieval as ops
from heddle.operators.index import TextIndex
from heddle.sources.tables import table, written

GOALS = ["find the price", "with_that", "the thing-er of", "zzz", "add to cart", ""]


def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("n_distinct"),
    )


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ops.term_stats(table(spark, sf, "documents"))


def bm25_documents_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = ops.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10)
    return found.withColumnsRenamed({"qid": "item_id", "id": "doc_id"})


def bm25_prefix_fallback(spark: SparkSession, sf: str) -> DataFrame:
    talks = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    return ops.prefix_fallback(talks, table(spark, sf, "benchmark")).withColumnRenamed("qid", "item_id")


def _cut_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items by their first three words, each without its last letter; most are no words then."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    cut = F.transform(F.slice(words, 1, 3), lambda w: F.left(w, F.length(w) - 1))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(cut, " ").alias("text"))


def bm25_cut_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked turns for queries of cut words: by terms with the same beginning where no word is known."""
    talks = table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    found = ops.bm25_with_fallback(talks, _cut_queries(spark, sf), 10)
    return found.withColumnsRenamed({"qid": "item_id", "id": "turn_id"})


def text_similarity_conversations(spark: SparkSession, sf: str) -> DataFrame:
    goals = F.posexplode(F.array(*map(F.lit, GOALS))).alias("goal_id", "goal")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), goals)
    score = F.round(text_similarity(F.col("goal"), F.col("text")), 6)
    return rows.select("conv_id", "turn", F.col("goal_id").cast("long").alias("goal_id"), score.alias("score"))


def _changes(docs: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Three batches of changes by rules on doc_id: four fifths of the documents; the rest, halved texts and removals; texts that come back whole."""
    rows, half = docs.select(F.col("doc_id").alias("id"), "text"), F.expr("left(text, cast(length(text) div 2 as int))")
    first = rows.filter("id % 5 <> 0")
    second = rows.filter("id % 5 = 0 OR id % 3 = 0").withColumn("text", F.when(F.col("id") % 3 == 0, half).otherwise(F.col("text")))
    return [(first, rows.limit(0)), (second, rows.filter("id % 7 = 0")), (rows.filter("id % 11 = 0"), rows.limit(0))]


def index_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each item, from an index that was built and changed batch by batch."""
    index = TextIndex(spark)
    for changed, removed in _changes(table(spark, sf, "documents")):
        index.apply(changed, removed.select("id"))
    return index.search(table(spark, sf, "benchmark"), 10).withColumnsRenamed({"qid": "item_id", "id": "doc_id"})


def mrr_ndcg_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant: the documents of good quality among an item's fifty best."""
    ranked = written(ops.bm25(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 50), "ranked")
    good = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    relevant = ranked.join(good, "id").select("qid", "id")
    return ops.ranking_metrics(ranked, relevant).withColumnRenamed("qid", "item_id")


STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens_sql(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        f"lambda t: strlen(t) > 2 AND NOT list_contains({STOP}, t))"
    )


BM25_SQL = f"""
corpus AS (SELECT doc_id AS id, {tokens_sql("coalesce(text, '')")} AS toks FROM documents),
stats AS (SELECT count(*) AS total, avg(len(toks)) FILTER (WHERE len(toks) > 0) AS mean FROM corpus),
asked AS (SELECT qid, term, count(*) AS qn FROM (
  SELECT item_id AS qid, unnest({tokens_sql("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
postings AS (SELECT id, l, term, count(*) AS tf FROM (SELECT id, len(toks) AS l, unnest(toks) AS term FROM corpus)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT qid, id, round(sum(qn * ln((total - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score
  FROM postings JOIN freq USING (term) JOIN asked USING (term), stats GROUP BY qid, id),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id, score FROM scored)
"""
SIMILARITY_SQL = f"""
WITH goals AS (SELECT unnest(range(6)) AS goal_id, unnest({GOALS}) AS goal),
x AS (SELECT conv_id, turn, goal_id, lower(goal) AS low,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS cand,
  list_filter(regexp_split_to_array(lower(goal), '[\\s_-]+'), lambda w: w <> '') AS words FROM conversations, goals),
y AS (SELECT *, len(list_filter(words, lambda w: contains(cand, w))) AS hits FROM x)
SELECT conv_id, turn, goal_id, round(CASE WHEN len(words) = 0 THEN 0.0
  WHEN contains(cand, low) OR hits = len(words) THEN 1.0
  WHEN hits = 0 AND strlen(cand) >= strlen(low)
    AND contains(regexp_replace(cand, '[ \\t\\n\\f\\r_-]', '', 'g'), array_to_string(words, '')) THEN 1.0
  ELSE hits::DOUBLE / len(words) END, 6) AS score FROM y
"""

QUERIES = {
    "tokenize_documents": tokenize_documents,
    "term_stats": term_stats,
    "bm25_documents_topk": bm25_documents_topk,
    "bm25_prefix_fallback": bm25_prefix_fallback,
    "bm25_cut_queries": bm25_cut_queries,
    "index_after_changes": index_after_changes,
    "text_similarity_conversations": text_similarity_conversations,
    "mrr_ndcg_recall": mrr_ndcg_recall,
}
ORACLE = {
    "index_after_changes": f"""WITH {BM25_SQL.replace("FROM documents)", """FROM (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 0
    THEN left(text, length(text) // 2) ELSE text END AS text FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 <> 0))""")}
SELECT qid AS item_id, rank, id AS doc_id, score FROM ranked WHERE rank <= 10""",
    "tokenize_documents": f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct
FROM (SELECT doc_id, {tokens_sql("coalesce(text, '')")} AS t FROM documents)""",
    "term_stats": f"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf
FROM (SELECT doc_id, unnest({tokens_sql("text")}) AS term FROM documents) GROUP BY term""",
    "bm25_documents_topk": f"WITH {BM25_SQL} SELECT qid AS item_id, rank, id AS doc_id, score FROM ranked WHERE rank <= 10",
    "bm25_prefix_fallback": f"""
WITH vocab AS (SELECT term, count(DISTINCT conv_turn) AS df FROM (
  SELECT conv_id || '-' || turn AS conv_turn, unnest({tokens_sql("text")}) AS term FROM conversations) GROUP BY term),
lost AS (SELECT DISTINCT item_id, token FROM (
  SELECT item_id, unnest({tokens_sql("text")}) AS token FROM benchmark) WHERE token NOT IN (SELECT term FROM vocab))
SELECT item_id, token, count(*) AS n_terms, min(term) AS first_term, sum(df)::BIGINT AS docs
FROM lost JOIN vocab ON starts_with(term, token) OR starts_with(token, term) GROUP BY item_id, token""",
    "bm25_cut_queries": f"""
WITH corpus AS MATERIALIZED (SELECT conv_id || '-' || turn AS id, {tokens_sql("coalesce(text, '')")} AS toks FROM conversations),
stats AS (SELECT count(*) AS total, avg(len(toks)) FILTER (WHERE len(toks) > 0) AS mean FROM corpus),
q AS (SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'),
  lambda w: length(w) > 3)[1:3], lambda w: left(w, length(w) - 1)), ' ') AS text FROM benchmark),
asked AS MATERIALIZED (SELECT item_id AS qid, term, count(*) AS qn FROM (SELECT item_id, unnest({tokens_sql("text")}) AS term FROM q) GROUP BY ALL),
held AS MATERIALIZED (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(toks) AS len, unnest(toks) AS term FROM corpus) GROUP BY ALL),
freq AS MATERIALIZED (SELECT term, count(*) AS df FROM held GROUP BY term),
known AS MATERIALIZED (SELECT DISTINCT qid FROM asked WHERE term IN (SELECT term FROM freq)),
wanted AS (SELECT qid, term, qn, 1.0::DOUBLE AS factor FROM asked WHERE qid IN (SELECT qid FROM known) UNION ALL
  SELECT qid, f.term, sum(qn), 0.7::DOUBLE FROM asked a JOIN freq f ON starts_with(f.term, a.term) OR starts_with(a.term, f.term)
  WHERE qid NOT IN (SELECT qid FROM known) GROUP BY qid, f.term),
scored AS (SELECT qid, id, round(sum(qn * ln((total - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) * any_value(factor), 6) AS score
  FROM wanted JOIN held USING (term) JOIN freq USING (term), stats GROUP BY qid, id)
SELECT qid AS item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, id AS turn_id, score FROM scored QUALIFY rank <= 10""",
    "text_similarity_conversations": SIMILARITY_SQL,
    "mrr_ndcg_recall": f"""
WITH {BM25_SQL}, returned AS (SELECT * FROM ranked WHERE rank <= 50),
rel AS (SELECT qid, id FROM returned WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)),
n AS (SELECT qid, count(*) AS n FROM rel GROUP BY qid),
top AS (SELECT r.qid, r.rank, (x.id IS NOT NULL)::INT AS hit FROM returned r LEFT JOIN rel x
  ON r.qid = x.qid AND r.id = x.id WHERE rank <= 10),
agg AS (SELECT qid, coalesce(max(1.0 / rank) FILTER (WHERE hit = 1), 0)::DOUBLE AS rr,
  sum(hit / log2(rank + 1.0)) AS dcg, sum(hit) AS hits, count(*) AS returned FROM top GROUP BY qid)
SELECT qid AS item_id, round(rr, 6) AS rr,
  round(coalesce(dcg / list_sum(list_transform(range(1, greatest(1, least(n, returned)) + 1), lambda i: 1 / log2(i + 1.0))), 0), 6)::DOUBLE AS ndcg,
  round(coalesce(hits / n, 0), 6)::DOUBLE AS recall
FROM agg LEFT JOIN n USING (qid)""",
}
