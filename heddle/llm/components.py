"""Connected components of an edge table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import materialise, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges`` (a, b).

    Each round every node points to the smallest of itself and its neighbours, pointers are followed
    to the end by doubling, and edges are redrawn between what they point to; stars, the usual shape
    of candidate groups, end in the first round. Rounds grow with the logarithm of a chain's length.
    Written tables cut the lineage of each round; a node that many point to or link with is split.
    """
    spark = edges.sparkSession
    labels, nodes = None, 0
    edges = materialise(spark, edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while edges.limit(1).count():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        point = materialise(spark, point.select("node", F.least("node", "to").alias("to")), "point")
        size = point.count()
        while True:
            ahead = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
            point = materialise(
                spark,
                spread_join(point, ahead, ["to"], size, "left").select("node", "to", F.coalesce("next", "to").alias("next")),
                "jump",
            )
            moved = point.filter("to <> next").limit(1).count()
            point = point.select("node", F.col("next").alias("to"))
            if not moved:
                break
        step = point.withColumnRenamed("to", "component")
        if labels is None:
            labels, nodes = step, size
        else:
            ahead = step.select(F.col("node").alias("component"), F.col("component").alias("next"))
            labels = spread_join(labels, ahead, ["component"], nodes, "left").select(
                "node", F.coalesce("next", "component").alias("component")
            )
        labels = materialise(spark, labels, "labels")
        links = edges.count()
        from_a = point.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        from_b = point.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        drawn = spread_join(spread_join(edges, from_a, ["a"], links), from_b, ["b"], links)
        edges = (
            drawn.filter("ta <> tb").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct()
        )
        edges = materialise(spark, edges, "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
