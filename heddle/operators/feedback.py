"""What a field learns from explicit feedback: regrets of edges between roles, zones where answers stand, and its state as a stream.

A feedback row says, for one node of a field's ``n``-th feedback (from 1; ``t`` queries so far): its role, its parent's role (null for a root), its
depth, its amplitude and whether it was of use. Regrets of an edge are summed for its parent's role downwards and its own role upwards,
by the goal's cluster. At every fifth feedback what was summed before is discounted, at every tenth the zones decay.

In batch, a discount is a weight of everything before it: sums by blocks of five feedbacks are weighed with the product of the later discounts, so
nothing is replayed. Zones forget an entry whose number of observations has decayed below one half; they are folded over blocks of ten.

Defined results
---------------
* nodes without a parent have no edge; a null role, cluster or field is the empty string (or 0); null amplitude counts as 0.
* repeated rows count as often as they stand; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEAT, DECAY_BEAT, DECAY, LEAST = 5, 10, 0.9, 0.5
FEEDBACK = "field long, n int, t int, cluster string, role string, parent_role string, depth int, amplitude double, success boolean"


def regret(amplitude: Column, success: Column) -> Column:
    """The amplitude of a node that was of use (0.1 at least), what was missing of it, negative, of one that was not."""
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), amplitude))
    return F.when(success, F.greatest(conf, F.lit(0.1))).otherwise(-F.greatest(1.0 - conf, F.lit(0.1)))


def discount(t: Column, power: float) -> Column:
    """What a sum keeps at a discount after ``t`` queries; failures (2) are forgotten sooner than successes (1.5)."""
    grown = F.pow(t, F.lit(power))
    return F.when(t > 1, grown / (grown + 1.0)).otherwise(0.5)


def zone(role: Column, depth: Column) -> Column:
    """A node's role with the region of its depth."""
    return F.concat(F.coalesce(role, F.lit("")), F.lit(":"), F.when(depth <= 1, "shallow").when(depth <= 4, "mid").otherwise("deep"))


def edge_regrets(feedback: DataFrame) -> DataFrame:
    """(field, edge, gained, lost): the discounted sums of positive and negative regrets of each edge."""
    rows = feedback.filter("parent_role IS NOT NULL").withColumn("block", F.floor(F.col("n") / BEAT).cast("int"))
    name = lambda role, way: F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(f":{way}:"), F.coalesce("cluster", F.lit("")))
    edges = F.explode(F.array(name("parent_role", "down"), name("role", "up"))).alias("edge")
    held = rows.select("field", "block", edges, regret(F.coalesce("amplitude", F.lit(0.0)), F.coalesce("success", F.lit(False))).alias("r"))
    some = lambda on: F.sum(F.when(on, F.col("r")).otherwise(0.0))
    sums = held.groupBy("field", "edge", "block").agg(some(F.col("r") > 0).alias("plus"), some(F.col("r") <= 0).alias("minus"))
    beats = feedback.filter(F.col("n") % BEAT == 0).groupBy("field", "n").agg(F.max("t").alias("t"))
    later = Window.partitionBy("field").orderBy(F.desc("n"))  # a row for each fifth feedback
    kept = lambda power: F.exp(F.sum(F.log(discount(F.col("t"), power))).over(later))
    weights = beats.select("field", (F.col("n") / BEAT - 1).cast("int").alias("block"), kept(1.5).alias("w_plus"), kept(2.0).alias("w_minus"))
    both = sums.join(weights, ["field", "block"], "left")
    whole = lambda c: F.round(F.sum(F.col(c) * F.coalesce(f"w_{c}", F.lit(1.0))), 6)
    return both.groupBy("field", "edge").agg(whole("plus").alias("gained"), whole("minus").alias("lost"))


def answer_zones(feedback: DataFrame) -> DataFrame:
    """(field, zone, hits, seen, boost): where useful nodes stood; boost goes from 0.7 to 1.3 once three were seen, else it is 1."""
    good = F.coalesce("success", F.lit(False))
    counted = feedback.filter(good | (F.coalesce("amplitude", F.lit(0.0)) > 0.3))
    block = F.floor((F.col("n") - 1) / DECAY_BEAT).cast("int")
    sums = counted.groupBy("field", zone(F.col("role"), F.col("depth")).alias("zone"), block.alias("block")).agg(
        F.sum(good.cast("double")).alias("s"), F.count("*").cast("double").alias("o")
    )
    blocks = sums.groupBy("field", "zone").agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct("s", "o")))).alias("of"))
    decays = feedback.groupBy("field").agg(F.floor(F.max("n") / DECAY_BEAT).cast("int").alias("decays"))
    none = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("o"))

    def step(state: Column, k: Column) -> Column:
        new = F.coalesce(F.try_element_at(F.col("of"), k), none)
        s, o = state["s"] + new["s"], state["o"] + new["o"]
        left = F.when(o * DECAY >= LEAST, F.struct((s * DECAY).alias("s"), (o * DECAY).alias("o"))).otherwise(none)
        return F.when(k < F.col("decays"), left).otherwise(F.struct(s.alias("s"), o.alias("o")))

    state = F.aggregate(F.sequence(F.lit(0), F.col("decays")), none, step)
    rows = blocks.join(decays, "field").select("field", "zone", state.alias("x")).filter("x.o > 0")
    boost = F.when(F.col("x.o") >= 3, 0.7 + F.col("x.s") / F.col("x.o") * 0.6).otherwise(1.0)
    return rows.select("field", "zone", F.round("x.s", 6).alias("hits"), F.round("x.o", 6).alias("seen"), F.round(boost, 6).alias("boost"))
