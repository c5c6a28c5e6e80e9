"""An inverted index that changes: generations of postings with tombstones, statistics kept by differences.

A generation holds the postings of the texts that it adds or changes, a tombstone for each id that it changes or removes, and differences: of
documents, of their lengths, and of the documents that hold each term. A posting counts unless a later generation has a tombstone for its id.
Nothing of earlier generations is rewritten; a search adds up the differences and reads live postings of its own terms. ``compact`` writes
all generations as one.

Defined results: a null text counts as empty; an id that stands twice in a batch takes the text that sorts last; an id both changed and
removed in a batch is removed; removing an unknown id changes nothing; without queries, texts or hits there are no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.operators.retrieval import query_terms, term_weight, token_table
from heddle.sources.tables import written

TABLES = {
    "postings": "id long, len long, term string, tf long", "docs": "id long, len long", "gone": "id long",
    "terms": "term string, df long", "stats": "total long, filled long, size long",
}


class TextIndex:
    """``generations[i]`` holds the written tables of generation i."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.generations: list[dict[str, DataFrame]] = []

    def _all(self, name: str) -> DataFrame:
        """The rows of a table over all generations, with the generation's number."""
        none = self.spark.createDataFrame([], TABLES[name]).withColumn("gen", F.lit(0))
        return reduce(DataFrame.unionByName, (g[name].withColumn("gen", F.lit(i)) for i, g in enumerate(self.generations)), none)

    def live(self, name: str, only: DataFrame | None = None) -> DataFrame:
        """Postings or documents that no later tombstone hides, of the terms ``only`` (term) if given."""
        rows = self._all(name)
        rows = rows if only is None else rows.join(only, "term", "left_semi")
        last = self._all("gone").groupBy("id").agg(F.max("gen").alias("_last"))
        return rows.join(last, "id", "left").filter(F.col("_last").isNull() | (F.col("gen") >= F.col("_last"))).drop("_last", "gen")

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Adds a generation: texts (id, text) that are new or changed, and ids (id) that go."""
        out = (changed.limit(0) if removed is None else removed).select(F.col("id").cast("long").alias("id")).distinct()
        new = changed.groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).join(out, "id", "left_anti")
        held = token_table(new, "id", "text")
        counted = held.select("id", "len", F.explode(F.concat("toks", F.array(F.lit(None).cast("string")))).alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
        seen = written(counted, "generation")  # one row for each document stands without a term
        postings, docs = seen.filter("term IS NOT NULL"), seen.filter("term IS NULL").select("id", "len")
        gone = written(docs.select("id").unionAll(out), "gone")
        lost_terms = self.live("postings").join(gone, "id", "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
        terms = postings.groupBy("term").agg(F.count("*").alias("df")).unionAll(lost_terms).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        each = docs.withColumn("s", F.lit(1)).unionAll(self.live("docs").join(gone, "id", "left_semi").select("id", "len", F.lit(-1)))
        whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        stats = each.agg(whole(F.col("s")).alias("total"), whole(F.when(F.col("len") > 0, F.col("s"))).alias("filled"), whole(F.col("s") * F.col("len")).alias("size"))
        found = {"postings": postings, "docs": docs, "gone": gone, "terms": written(terms, "terms"), "stats": written(stats, "stats")}
        self.generations.append(found)

    def stats(self) -> DataFrame:
        """One row (total, mean): the documents, and the mean length of those that have words."""
        sums = self._all("stats").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "filled", "size")))
        return sums.select("total", F.when(F.col("filled") > 0, F.col("size") / F.col("filled")).otherwise(1.0).alias("mean"))

    def search(self, queries: DataFrame, k: int, key: str = "item_id", text: str = "text") -> DataFrame:
        """(qid, rank, id, score): the k best live documents of each query."""
        asked = written(query_terms(queries, key, text), "asked")
        wanted = asked.select("term").distinct()
        df = self._all("terms").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        rows = self.live("postings", wanted).join(df, "term").crossJoin(F.broadcast(self.stats()))  # a single row
        weight = term_weight(F.col("tf"), F.col("df"), F.col("len"), F.col("mean"), F.col("total"))
        scored = rows.select("id", "term", weight.alias("w")).join(asked, "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("qn")), 6).alias("score"))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.select("qid", F.col("rank").cast("long").alias("rank"), "id", "score")

    def compact(self) -> None:
        """All generations as one, without tombstones."""
        terms = self._all("terms").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        stats = self._all("stats").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", "filled", "size")))
        one = {"postings": self.live("postings"), "docs": self.live("docs"), "gone": self.spark.createDataFrame([], TABLES["gone"]), "terms": terms, "stats": stats}
        self.generations = [{name: written(rows, name) for name, rows in one.items()}]
