"""The staged ranking of page nodes: BM25 within the page, pruning by hypervectors, late interaction with an expanded goal, blended scores.

Every stage is a join or an aggregation by page; what is gathered for a page is at most the survivors of its first stage.

Defined results
---------------
* pages whose nodes share no word with the goal: the ``most`` nodes most like it by hypervectors survive, with a BM25 score of 0.
* ties go to the smaller node id, among words of an expansion to the one that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.hypervectors import adaptive_threshold
from heddle.functions.interaction import blended, late_interaction, no_content, rarest, words_of
from heddle.functions.text import tokens
from heddle.operators.retrieval import term_weight

#: Nodes of a page that the first stage leaves at most.
MOST = 300
KEYS = ["page_id", "node_id"]


def with_bm25(nodes: DataFrame, goal: str) -> DataFrame:
    """``nodes`` with bm25: each page is a corpus of its nodes' labels. Tokens are counted before the rows of a page meet."""
    terms = nodes.sparkSession.range(1).select(tokens(F.lit(goal)).alias("t")).first()["t"]  # the goal's own words
    times = lambda toks, t: F.size(F.filter(toks, lambda x: x == t))
    counts = lambda toks: F.struct(F.size(toks).alias("len"), *(times(toks, t).alias(f"tf_{i}") for i, t in enumerate(terms)))
    rows = nodes.withColumn("_held", F.get(F.transform(F.array(tokens(F.col("label"))), counts), F.lit(0)))  # tokens are made once
    page = Window.partitionBy("page_id")
    rows = rows.select(*nodes.columns, "_held.*")
    held = {f"df_{i}": F.sum((F.col(f"tf_{i}") > 0).cast("long")).over(page) for i in range(len(terms))}
    stats = rows.withColumns({"total": F.count("*").over(page), "mean": F.avg(F.when(F.col("len") > 0, F.col("len"))).over(page), **held})
    part = lambda i: F.when(F.col(f"tf_{i}") > 0, term_weight(F.col(f"tf_{i}"), F.col(f"df_{i}"), F.col("len"), F.col("mean"), F.col("total"))).otherwise(0.0)
    return stats.select(*nodes.columns, F.round(sum((part(i) for i in range(len(terms))), F.lit(0.0)), 9).alias("bm25"))


def bm25_within(nodes: DataFrame, goal: str) -> DataFrame:
    """(page_id, node_id, bm25): each page is a corpus of its nodes' labels."""
    return with_bm25(nodes.select(*KEYS, "label"), goal).select(*KEYS, "bm25")


def survivors(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """The nodes of each page that go on: the best by BM25, or by likeness where none has a hit, that are like enough for their role and level.

    ``nodes`` has bm25, likeness, role and level.
    """
    page = Window.partitionBy("page_id")
    rows = nodes.withColumn("_hit", F.max("bm25").over(page) > 0)
    order = page.orderBy(F.desc(F.when(F.col("_hit"), F.col("bm25")).otherwise(F.col("likeness"))), "node_id")
    first = rows.filter(~F.col("_hit") | (F.col("bm25") > 0)).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    enough = ~F.col("_hit") | (F.col("likeness") >= adaptive_threshold(F.col("role"), F.col("level")))
    return first.filter(enough).drop("_hit", "_r")


def expanding(items: Column, goal: str, best: int = 5, words: int = 4) -> Column:
    """The rarest longer words of the ``best`` items (structs with bm25, node_id and label) that the goal lacks."""
    top = F.slice(F.array_sort(F.transform(items, lambda x: F.struct((-x["bm25"]).alias("o"), x["node_id"].alias("n"), x["label"].alias("label")))), 1, best)
    long = lambda w: (F.octet_length(w) >= 4) & ~F.regexp_like(w, F.lit(r"^[0-9]+$|://|\."))
    seen = F.flatten(F.transform(top, lambda x: F.filter(F.split(F.lower(x["label"]), r"\s+"), long)))
    return rarest(seen, F.split(F.lower(F.lit(goal)), r"\s+"), F.lit(words))


def expansions(nodes: DataFrame, goal: str, best: int = 5, words: int = 4) -> DataFrame:
    """(page_id, more): the rarest longer words of the ``best`` survivors of each page that the goal lacks."""
    pages = nodes.groupBy("page_id").agg(F.collect_list(F.struct("bm25", "node_id", "label")).alias("items"))
    return pages.select("page_id", expanding(F.col("items"), goal, best, words).alias("more")).filter(F.size("more") > 0)


def normalised(rows: DataFrame) -> DataFrame:
    """``rows`` with ``interaction`` for ``_raw``: by the median and quartiles of the page through a sigmoid.

    Ranks are counted, so that no row carries the values of its page.
    """
    page = Window.partitionBy("page_id")
    ranked = rows.withColumn("_r", F.row_number().over(page.orderBy("_raw"))).withColumn("_n", F.count("*").over(page))
    at = lambda n: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * n / 4) + 1, F.col("_raw"))).over(page)
    stats = ranked.withColumns({"_m": at(2), "_iqr": at(3) - at(1)})
    z = (F.col("_raw") - F.col("_m")) / F.when(F.col("_iqr") > 1e-9, F.col("_iqr")).otherwise(1.0)
    norm = F.when(F.col("_n") == 1, 0.5).otherwise(1 / (1 + F.exp(z * -2)))
    return stats.withColumn("interaction", norm).drop("_r", "_n", "_m", "_iqr")


def interactions(nodes: DataFrame, goal: str, expand: bool = True) -> DataFrame:
    """``nodes`` with ``interaction``: late interaction with the page's goal, by the median and quartiles of the page through a sigmoid."""
    if expand:
        rest = [c for c in nodes.columns if c != "page_id"]
        pages = nodes.groupBy("page_id").agg(F.collect_list(F.struct(*rest)).alias("items"))  # at most the survivors of a page
        pages = pages.withColumn("more", expanding(F.col("items"), goal))
        aim = words_of(F.concat_ws(" ", F.lit(goal), F.array_join("more", " ")))
        rows = pages.select("page_id", aim.alias("_aim"), F.inline("items"))
    else:
        rows = nodes.withColumn("_aim", words_of(F.lit(goal)))
    return normalised(rows.withColumn("_raw", late_interaction(words_of(F.col("label")), F.col("_aim"))).drop("_aim"))


def contained(items: Column) -> Column:
    """The items (rank order, each a struct with ``label``) that no kept one before makes superfluous.

    A label's first 120 characters, trimmed, are compared: one that holds a kept one, or that a kept one holds, goes; so does one of four words or
    more of which over 70 % stand within one kept label. Labels of under four bytes always stay and are compared with none.
    """
    key = lambda x: F.regexp_replace(F.substring(x["label"], 1, 120), r"^\s+|\s+$", "")
    keyed = F.transform(items, lambda x: F.struct(x.alias("item"), key(x).alias("key"), F.filter(F.split(key(x), r"\s+"), lambda w: w != "").alias("ws")))

    def gone(kept: Column, x: Column) -> Column:
        held = lambda p: F.contains(p["key"], x["key"]) | F.contains(x["key"], p["key"])
        shared = lambda p: F.size(F.filter(x["ws"], lambda w: F.contains(p["key"], w))) / F.size(x["ws"]) > 0.7
        return F.exists(kept, lambda p: (F.octet_length(p["key"]) >= 4) & (held(p) | ((F.size(x["ws"]) >= 4) & shared(p))))

    none = F.filter(keyed, lambda x: F.lit(False))
    kept = F.aggregate(keyed, none, lambda acc, x: F.when((F.octet_length(x["key"]) >= 4) & gone(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x["item"])


def first_unlike(items: Column, most: int) -> Column:
    """The first ``most`` items (rank order, each a struct with ``text``) whose text no kept one holds or is held by."""
    none = F.filter(items, lambda x: F.lit(False))
    like = lambda kept, x: F.exists(kept, lambda k: F.contains(k["text"], x["text"]) | F.contains(x["text"], k["text"]))
    return F.aggregate(items, none, lambda kept, x: F.when((F.size(kept) >= most) | like(kept, x), kept).otherwise(F.array_append(kept, x)))


def with_leaves(nodes: DataFrame) -> DataFrame:
    """``nodes`` with leaf: whether none has it as its parent."""
    parents = nodes.filter("parent_id IS NOT NULL").select("page_id", F.col("parent_id").alias("node_id"), F.lit(False).alias("_leaf")).distinct()
    return nodes.join(parents, KEYS, "left").withColumn("leaf", F.coalesce("_leaf", F.lit(True))).drop("_leaf")


def best_children(rows: DataFrame) -> DataFrame:
    """``rows`` with _child: the most ``own`` of a row's children that are leaves. A leaf stands a second time beside its parent, so rows of a page stay in place."""
    spot = lambda n, c: F.struct(n.alias("_at"), c.alias("_own"))
    self = spot(F.col("node_id"), F.lit(None).cast("double"))
    both = F.when(F.col("leaf") & F.col("parent_id").isNotNull(), F.array(self, spot(F.col("parent_id"), F.col("own")))).otherwise(F.array(self))
    twice = rows.select("*", F.inline(both)).withColumn("label", F.when(F.col("_own").isNull(), F.col("label")))
    return twice.withColumn("_child", F.max("_own").over(Window.partitionBy("page_id", "_at"))).filter("_own IS NULL").drop("_at", "_own")


def staged(nodes: DataFrame, goal: str, most: int = MOST) -> DataFrame:
    """(page_id, rank, node_id, role, label, score) of ``nodes`` (page_id, node_id, parent_id, role, label, level, likeness, text_likeness).

    Nodes may bring their ``leaf``; else it is found by a join.
    A node with children scores at least 0.75 of the best of them that have none of their own.
    """
    rows = with_bm25(nodes if "leaf" in nodes.columns else with_leaves(nodes), goal)
    rows = interactions(survivors(rows, most), goal).filter(~no_content(F.col("label"), F.col("role")))
    own = blended(F.col("interaction"), F.col("text_likeness"), F.col("bm25"), F.col("role"), F.col("label"), F.col("leaf"))
    rows = best_children(rows.select(*KEYS, "parent_id", "role", "label", "leaf", own.alias("own")))
    story = F.col("leaf") & (F.col("role") == "link") & F.octet_length("label").between(30, 200)
    score = F.greatest(F.col("own"), F.coalesce(F.col("_child") * 0.75, F.lit(0.0))) * F.when(story, 1.15).otherwise(1.0)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), score), 6)).filter("score > 0")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_o"), "node_id", "role", "label", "score")))  # at most the survivors
    once = rows.groupBy("page_id").agg(contained(ranked).alias("kept"))
    out = once.select("page_id", F.posexplode("kept").alias("_p", "x"))
    return out.select("page_id", (F.col("_p") + 1).cast("long").alias("rank"), "x.node_id", "x.role", "x.label", "x.score")
