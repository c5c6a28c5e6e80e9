"""Where a ranked list ends: at the first clear gap, unless it is short or has no clear winners; and scores as calibrated probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut_at_gap(rows: DataFrame, keys: list[str], score: str, tie: str, most: int) -> DataFrame:
    """``rows`` up to the first gap after the fourth place of each list, with the place ``i`` and the ``reason`` where the list ends.

    A gap is a fall by more than 0.30 - 0.10 * most / 50. Lists of up to five rows are not cut at gaps; nor are those without clear
    winners, where the fifth has over three quarters of the first.
    """
    order, whole = Window.partitionBy(*keys).orderBy(F.desc(score), tie), Window.partitionBy(*keys)
    rows = rows.withColumn("i", F.row_number().over(order).cast("long")).withColumn("_before", F.lag(score).over(order)).withColumn("_n", F.count("*").over(whole))
    gap = (F.col("i") > 4) & (F.col("_before") > 0.001) & (F.col(score) < F.col("_before") * (1.0 - (0.30 - 0.10 * min(most / 50, 1.0))))
    first, fifth = (F.max(F.when(F.col("i") == i, F.col(score))).over(whole) for i in (1, 5))
    broad = F.coalesce((first > 0.01) & ((first - fifth) / first < 0.25), F.lit(False))
    rows = rows.withColumn("_broad", broad).withColumn("_at", F.when(F.col("_broad"), None).otherwise(F.min(F.when(gap, F.col("i"))).over(whole)))
    keep = (~F.col("_broad") & (F.col("_n") <= 5)) | ((F.col("i") <= most) & (F.col("_at").isNull() | (F.col("i") < F.col("_at"))))
    reason = (
        F.when(F.col("_broad"), "broad").when(F.col("_n") <= 5, "too_few_candidates").when(F.col("_at") <= most, "relevance_gap").otherwise("top_k_limit")
    )
    return rows.filter(keep).withColumn("reason", reason).drop("_before", "_n", "_broad", "_at")


def calibrated(score: Column, hits: Column, nodes: Column, causal: Column) -> Column:
    """The chance that a node holds the answer: a sigmoid, the steeper the more hits its field has had, around a threshold that they lower."""
    rate = F.when(nodes > 0, F.greatest(F.lit(0.001), F.least(F.lit(0.5), hits / nodes))).otherwise(0.05)
    p = 1.0 / (1.0 + F.exp(-(5.0 + F.least(hits, F.lit(50)) * 0.2) * (score - (0.3 - rate * 0.5))))
    return F.least(F.lit(0.99), p * F.when(causal, 1.2).otherwise(1.0))
