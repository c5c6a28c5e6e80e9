"""Lexical retrieval: term statistics, BM25 by an inverted-index join, prefix fallback, ranking metrics.

Texts are tokenised once; only terms of the queries become posting rows, so the corpus is not
shuffled. Statistics are single-row or query-sized tables. Null texts count as empty; ties in
scores go to the smaller document id; an empty corpus or query table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import tokens
from heddle.sources.tables import written

K1, B = 1.2, 0.75


def token_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, toks, len): a document's tokens and their number."""
    toks = tokens(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("id"), toks.alias("toks")).withColumn("len", F.size("toks").cast("long"))


def term_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, tf): documents that hold each term, and its occurrences."""
    toks = token_table(docs, key, text).select("toks")
    row = lambda df, tf: lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(tf).alias("tf"))
    both = F.concat(F.transform(F.array_distinct("toks"), row(1, 0)), F.transform("toks", row(0, 1)))
    seen = toks.select(F.explode(both).alias("r")).select("r.*")
    return seen.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.sum("tf").cast("long").alias("tf"))


def term_weight(tf: Column, df: Column, size: Column, mean: Column, total: Column) -> Column:
    """One term's share of a BM25 score."""
    idf = F.log((total - df + 0.5) / (df + 0.5) + 1.0)
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(qid, term, qn): a query's tokens with how often each stands there."""
    q = token_table(queries, key, text).select(F.col("id").alias("qid"), F.explode("toks").alias("term"))
    return q.groupBy("qid", "term").agg(F.count("*").alias("qn"))


def postings(docs: DataFrame, terms: DataFrame, doc_key: str) -> tuple[DataFrame, DataFrame]:
    """(id, len, term, tf) of the wanted terms, and one row (total, mean) over all documents; texts are tokenised once.

    Each document sends one row without a term for the statistics; tokens that no query asks for go before anything is shuffled.
    """
    corpus = token_table(docs, doc_key, "text")
    all_ = F.concat("toks", F.array(F.lit(None).cast("string")))
    rows = corpus.select("id", "len", F.explode(all_).alias("term")).join(terms.select("term", F.lit(True).alias("_wanted")).distinct(), "term", "left")
    seen = written(rows.filter("term IS NULL OR _wanted").groupBy("id", "len", "term").agg(F.count("*").alias("tf")), "postings")
    stats = seen.filter("term IS NULL").agg(F.sum("tf").alias("total"), (F.sum(F.col("len") * F.col("tf")) / F.sum(F.when(F.col("len") > 0, F.col("tf")))).alias("mean"))
    return seen.filter("term IS NOT NULL"), stats


def _scored(held: DataFrame, stats: DataFrame, asked: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """(qid, id, score): the weights of the terms (id, len, term, tf) that each query (qid, keys, qn) asks for."""
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    weight = term_weight(F.col("tf"), F.col("df"), F.col("len"), F.col("mean"), F.col("total"))
    rows = held.join(df, "term").crossJoin(F.broadcast(stats)).select("id", "term", weight.alias("w"))  # stats is a single row
    return rows.join(asked, keys).groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("qn")) * factor, 6).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "id", "score")


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc_key: str = "doc_id", query_key: str = "item_id") -> DataFrame:
    """(qid, rank, id, score): the k best documents of each query that share a term with it."""
    asked = query_terms(queries, query_key, "text")
    held, stats = postings(docs, asked, doc_key)
    return _best(_scored(held, stats, asked, ["term"]), k)


def _near_terms(tokens_: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens with the terms that begin them or that they begin; both have three bytes or more, and share the first three."""
    first = lambda c: F.substring(F.encode(c, "UTF-8"), 1, 3)
    near = F.col("term").startswith(F.col("token")) | F.col("token").startswith(F.col("term"))
    return tokens_.withColumn("_k", first("token")).join(vocab.withColumn("_k", first("term")), "_k").filter(near).drop("_k")


def prefix_fallback(docs: DataFrame, queries: DataFrame, doc_key: str = "doc_id", query_key: str = "item_id") -> DataFrame:
    """(qid, token, n_terms, first_term, docs): terms that begin a token without hits, or that it begins.

    Terms and tokens meet by their first three bytes, so that the join has a key; only vocabularies join.
    """
    vocab = term_stats(docs, doc_key)
    asked = query_terms(queries, query_key, "text").select("qid", F.col("term").alias("token"))
    lost = asked.join(vocab.select(F.col("term").alias("token")), "token", "left_anti")
    return _near_terms(lost, vocab).groupBy("qid", "token").agg(
        F.count("*").alias("n_terms"), F.min("term").alias("first_term"), F.sum("df").cast("long").alias("docs")
    )


def bm25_with_fallback(docs: DataFrame, queries: DataFrame, k: int, doc_key: str = "doc_id", query_key: str = "item_id") -> DataFrame:
    """(qid, rank, id, score): as ``bm25``; a query none of whose terms is known is ranked by the terms that begin its tokens or that
    these begin, at 0.7 of their weight.
    """
    asked = written(query_terms(queries, query_key, "text"), "asked")
    vocab = written(term_stats(docs, doc_key).select("term"), "vocabulary")
    known = asked.join(vocab, "term", "left_semi").select("qid").distinct()
    lost = asked.join(known, "qid", "left_anti").select("qid", F.col("term").alias("token"), "qn")
    near = _near_terms(lost, vocab).groupBy("qid", "term").agg(F.sum("qn").alias("qn"))
    wanted = written(asked.join(known, "qid").withColumn("exact", F.lit(True)).unionByName(near.withColumn("exact", F.lit(False))), "wanted")
    held, stats = postings(docs, wanted, doc_key)
    exact = _scored(held, stats, wanted.filter("exact").drop("exact"), ["term"])
    return _best(exact.unionByName(_scored(held, stats, wanted.filter("NOT exact").drop("exact"), ["term"], 0.7)), k)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rr, ndcg, recall) of ranked (qid, rank, id) against relevant (qid, id).

    The ideal order is as long as what was returned, at most k. A query without relevant documents gives zeros.
    """
    top = ranked.filter(F.col("rank") <= k)
    hits = top.join(relevant.withColumn("rel", F.lit(1)), ["qid", "id"], "left")
    gain = F.when(F.col("rel") == 1, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    found = hits.groupBy("qid").agg(
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.sum(gain).alias("dcg"),
        F.coalesce(F.sum("rel"), F.lit(0)).alias("hit"),
        F.count("*").alias("returned"),
    )
    totals = relevant.groupBy("qid").agg(F.count("*").alias("n"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n", "returned")).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1 / F.log2(i + 1.0),
    )
    return found.join(totals, "qid", "left").select(
        "qid",
        F.round("rr", 6).alias("rr"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(F.col("hit") / F.col("n"), F.lit(0.0)), 6).alias("recall"),
    )
