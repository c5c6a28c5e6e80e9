"""Queries over ranked nodes of pages: penalties, filters, cuts, search results, propagation over the tree, next actions.

A conversation stands for a page and its turns for the nodes; planted pages, with negative ids, reach every rule.
A page's list is short (at most what a search returned), so windows and anti-joins by page stay small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import field as search
from heddle.functions.text import alternatives, text_similarity
from heddle.functions.urls import domain
from heddle.plans.pages import BLOCKED, FAILED
from heddle.plans.safety import listed, quoted
from heddle.plans.web import DOMAIN
from heddle.operators.cuts import cut_at_gap
from heddle.sources.tables import table

# Beginnings of serialised state, and what its nodes keep of their score.
STATE = (
    "__APOLLO_STATE__", "__NEXT_DATA__", "window.__", "contentApiData.", "layoutData.", "localeData.", "commonI18nResources.",
    "dataManifest.", "currentUrlString", "pageProps.",
)
STATE_FACTOR = 0.15
# What labels of boilerplate keep of their score: the lower-cased label begins with one of the first phrases (if there are any), holds one
# of each further group, and has more and fewer bytes than the two numbers. The first rule that holds counts.
BOILERPLATE = [
    (0.5, (), [("uh oh! there was an error", "please reload this page", "something went wrong", "loading...", "laddar...")], None, None),
    (0.4, (), [("points by", "hours ago", "minutes ago"), ("comments", "hide")], None, None),
    (0.5, (), [("ago",), ("point", "vote", "score")], None, None),
    (0.3, ("^ ",), [("retrieved 20", "archived from")], None, None),
    (0.2, (), [("doi :", "doi:"), ("issn", "pmid", "bibcode")], None, None),
    (0.25, ("articles with ", "short description", "category:articles"), [], None, 80),
    (0.25, ("^ ",), [("(20", "(19", "doi", "isbn", "pmid")], 30, None),
    (0.3, (), [("posts must", "submissions must"), ("code of conduct", "message the mods", "details")], None, None),
    (0.25, ("1 observe", "2 submission"), [], None, None),
    (0.25, ("r/",), [("rules",), ("observe",)], None, None),
    (0.35, (), [("community bookmarks", "official resources"), ("megathreads", "alternative venues")], None, None),
    (0.3, (), [("no meta posts",), ("mods",)], None, None),
    (0.3, ("search ",), [("...",)], 40, None),
    (0.2, (), [("we use cookies",)], 80, None),
    (0.2, (), [("cookie settings",), ("accept all",)], None, None),
]
# Labels of nodes that are no content, by beginnings, groups and bytes in the same way, and whole labels.
EMPTY = [
    ((), [("cookie",), ("consent",)], None),
    ((), [("we use cookies",)], 100),
    ((), [("cookie settings",), ("analytics",)], None),
    ((), [("reject all cookies",), ("accept all",)], None),
    ((), [("privacy choices",), ("cookie",)], None),
    (("search or jump to", "search code, repositories"), [("...",)], None),
    (("^ ",), [("retrieved 20",)], None),
    (('^ "',), [(". retrieved",)], None),
    ((), [("doi :", "doi:"), ("issn", "pmid", "bibcode", "arxiv")], None),
    (("articles with short description", "short description is different", "category:articles with"), [], None),
]
WHOLE = ("loading...", "loading contributors", "just a moment...")


def _patterns(starts: tuple[str, ...], groups: list[tuple[str, ...]]) -> list[str]:
    """Patterns that all find something in a label that the phrases fit."""
    return [*([f"^({alternatives(starts)})"] if starts else []), *map(alternatives, groups)]


PENALTIES = [(keep, _patterns(starts, groups), more, fewer) for keep, starts, groups, more, fewer in BOILERPLATE]
NO_CONTENT = [*((_patterns(starts, groups), more) for starts, groups, more in EMPTY), ([f"^({alternatives(WHOLE)})\\z"], None)]
META_NAMES = r"^(opengraph\.|og:|twitter\.|fb:|article:)"
SIDE_IDS = "sidebar|related-posts|recommended|advertisement|ad-container|cookie-banner"
# Edge weights down from a role and up to one, polynomial coefficients, share of the seed.
DOWN = {1.2: ("heading", "table", "row", "list"), 0.7: ("price", "text", "button", "link"), 0.3: ("navigation", "complementary", "contentinfo")}
UP = {1.3: ("price", "data", "cell"), 1.1: ("text", "paragraph", "heading"), 0.9: ("button", "link", "cta"), 0.3: ("navigation", "complementary")}
THETA = (0.50, 0.30, 0.12, 0.05, 0.03)
RESTART = 0.15
# Fixed value: what a label that is an address holds.
ADDRESS = r"www\.|http|\.(com|se|org|net|io|de|uk|no|dk|fi)/"
REDIRECT = "duckduckgo.com/l/?uddg="
AD_REDIRECT = "duckduckgo.com/y.js"

LABELS = [
    "Loading...", "12 points by ann 3 hours ago | hide | 4 comments", "3 votes, a day ago", "^ Smith (2021). Retrieved 2022", "doi : 10.1/x ISSN 1",
    "Articles with short description", "^ Jones, A. Long title of a book (1999), p. 7", "Posts must follow our code of conduct", "1 Observe our rules",
    "r/x rules: observe them", "Community bookmarks and megathreads", "No meta posts; message the mods", "Search code, repositories, users, issues, pull requests...",
    "We use cookies to give you the best of this site, and share what you do there with our many partners.", "Cookie settings: accept all",
    "__NEXT_DATA__ loading...", "window.__x", "pageProps.a", "News of the day", "", "ago", "SHORT DESCRIPTION " + "x" * 70, "^ short (2020)",
]
FILTERED = "page_id long, rank long, label string, name string, html_id string"
RANKED = [
    (-1, 1, "A long headline about the prices of oil and gas", None, None), (-1, 2, "the prices of oil and gas", None, None),
    (-1, 3, "The prices of oil and gas", None, None), (-1, 4, "prices of oil", None, None), (-1, 5, "the prices of oil and gas and all else", "og:title", None),
    (-1, 6, "prices of oil and gas and all", None, None), (-1, 7, "Text beside", None, "right-Sidebar-2"), (-1, 8, "just a moment...", None, None),
    (-1, 9, "just a moment...\n", None, None), (-1, 10, '^ "A title". Retrieved', "x", "y"), (-1, 11, "Cookie consent", None, None),
    (-1, 12, "A long headline about the prices of oil and gas", None, None), (-1, 13, "arXiv doi: 1", None, None), (-1, 14, "", "", ""),
    (-1, 15, "Search or jump to...", None, None), (-1, 16, "Reject all cookies Accept all", None, None),
]
NODES = "page_id long, pos long, role string, label string, value string, relevance double"
REDIRECTED = "//duckduckgo.com/l/?uddg=https%3A%2F%2F"
FOUND = [
    (-1, 1, "text", "Results for a search", None, 0.1), (-1, 2, "link", "First", REDIRECTED + "www.a.org%2Fx&rut=1", 0.9),
    (-1, 3, "link", "www.a.org/x", REDIRECTED + "www.a.org%2Fx", 0.5), (-1, 4, "text", "a.org/x www.a.org", None, 0.1), (-1, 5, "text", "short", None, 0.1),
    (-1, 6, "text", "What the first page says", None, 0.3), (-1, 7, "text", "More that it says, left out", None, 0.3),
    (-1, 8, "link", "Advertisement", REDIRECTED + "x.com%2Fads%2F1", 0.8), (-1, 9, "link", "Ad", "https://duckduckgo.com/y.js?ad", 0.8),
    (-1, 10, "heading", "Second without snippet", REDIRECTED + "b.se", 0.7), (-1, 11, "cta", "", REDIRECTED + "c.fi", 0.6),
    (-1, 12, "link", "Third", REDIRECTED + "d.net%2Fa%20b", 0.6), (-1, 13, "text", "What is a redirect by its role only", REDIRECTED + "e.net", 0.2),
    (-1, 14, "link", "", REDIRECTED + "f.no", 0.2),
]
TREE_ROLES = ["heading", "text", "generic", "price", "navigation", "link", "cell"]
GOAL = "and then of those"
KEEP = 10
CUT = 6
#: page, title, DOM nodes
ACTED = [
    (-1, "Robot check", 3), (-2, "404 not found", 30), (-3, "App", 60), (-4, "Data", 40), (-5, "News", 40), (-6, "", 30), (-7, "News", 40), (-8, "News", 40),
    (-9, "News", 40), (-10, "News", 40), (-11, "Tiny", 9),
]
MATCHED = "page_id long, role string, label string, name string, amplitude double, causal double, confidence double"
MATCHES = [
    (-3, "link", "A link of more than thirty characters in all", None, 0.9, 0.0, 0.9),
    (-4, "data", "x", "page.@news[1].a", 0.9, 0.0, 0.9), (-4, "data", "initialState", "a.b[0]", 0.9, 0.0, 0.9), (-4, "text", "y", None, 0.9, 0.0, 0.9),
    (-5, "text", "Sure of it, but low", None, 0.4, 0.0, 0.9),
    (-7, "text", "It costs 5", None, 0.4, 0.2, 0.9), (-8, "link", "It costs 5", None, 0.9, 0.0, 0.9), (-9, "text", "none", None, 0.6, 0.0, 0.3),
    (-10, "text", "none", None, 0.6, 0.0, 0.1),
]


def _all(c: Column, patterns: list[str]) -> Column:
    found = F.lit(True)
    for p in patterns:
        found = found & F.regexp_like(c, F.lit(p))
    return found


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as ranked nodes; every label stands in several turns."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("page_id"), F.col("turn").cast("long").alias("rank"), F.coalesce("text", F.lit("")).alias("label"),
        (F.col("conv_id") + F.col("turn")).cast("long").alias("n"),
    )


def label_penalty(label: Column) -> Column:
    """What a label keeps of its score: boilerplate and serialised state lose most of it. Sizes are those of the lower-cased label."""
    low, size = F.lower(label), F.octet_length(F.lower(label))
    factor = F.lit(1.0)
    for keep, patterns, more, fewer in reversed(PENALTIES):
        rule = _all(low, patterns)
        rule = rule if more is None else rule & (size > more)
        rule = rule if fewer is None else rule & (size < fewer)
        factor = F.when(rule, keep).otherwise(factor)
    return factor * F.when(F.regexp_like(label, F.lit(f"^({alternatives(STATE)})")), STATE_FACTOR).otherwise(1.0)


def label_penalties(spark: SparkSession, sf: str) -> DataFrame:
    planted = spark.range(1).select(F.explode(F.array(*map(F.lit, LABELS))).alias("label"))
    rows = _turns(spark, sf).select("label").unionAll(planted).distinct()
    return rows.select("label", F.round(label_penalty(F.col("label")), 6).alias("penalty"))


def is_content(label: Column, name: Column, html_id: Column) -> Column:
    """False for tags of metadata, consent texts, placeholders, citations and sidebars."""
    low = F.lower(label)
    none = F.lit(False)
    for patterns, more in NO_CONTENT:
        rule = _all(low, patterns)
        none = none | (rule if more is None else rule & (F.octet_length(low) > more))
    meta = F.coalesce(F.regexp_like(F.lower(name), F.lit(META_NAMES)), F.lit(False))
    side = F.coalesce(F.regexp_like(F.lower(html_id), F.lit(SIDE_IDS)), F.lit(False))
    return ~(none | meta | side)


def post_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Content nodes whose label, from 20 bytes on, is no proper part of a better node's label.

    Being part of a label that is itself part of a better one is being part of that one, so an anti-join says the same as a pass in order.
    """
    rows = _turns(spark, sf).select("page_id", "rank", "label", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("html_id"))
    rows = rows.unionAll(spark.createDataFrame(RANKED, FILTERED))  # a fixed list
    kept = rows.filter(is_content(F.col("label"), F.col("name"), F.col("html_id"))).select("page_id", "rank", "label")
    n, e = kept.alias("n"), kept.alias("e")
    within = (F.octet_length("n.label") >= 20) & (F.octet_length("e.label") > F.octet_length("n.label")) & F.contains(F.col("e.label"), F.col("n.label"))
    return n.join(e, (F.col("n.page_id") == F.col("e.page_id")) & (F.col("e.rank") < F.col("n.rank")) & within, "left_anti")


def field_label_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """One node for each label of ten bytes or more: the one of the largest causal gain, the first of equals; short labels all stay."""
    names = F.array(*map(F.lit, [*TREE_ROLES, " Prices of the day", "prices OF the day", "The weather of the day"]))
    rows = _turns(spark, sf).select(
        "page_id", "rank", F.element_at(names, (F.col("n") * 7 % 10 + 1).cast("int")).alias("label"), (F.col("rank") % 3 / 10).alias("causal")
    )
    key = F.when(F.octet_length("label") < 10, F.concat(F.lit("rank "), F.col("rank"))).otherwise(F.lower(F.trim("label")))
    best = F.max_by(F.struct("rank", "label", "causal"), F.struct("causal", -F.col("rank"))).alias("b")
    one = rows.groupBy("page_id", key.alias("key")).agg(F.min("rank").alias("place"), best)
    return one.select("page_id", "place", F.col("b.rank").alias("rank"), F.col("b.label").alias("label"), F.col("b.causal").alias("causal"))


def result_cut(spark: SparkSession, sf: str) -> DataFrame:
    """A page's best nodes up to the first gap after the fourth."""
    amplitude = F.round(F.pow(F.lit(0.5) + F.col("page_id") % 10 / 20, F.col("rank") + F.when(F.col("rank") > F.col("page_id") % 7, 2).otherwise(0)), 6)
    rows = _turns(spark, sf).select("page_id", "rank", amplitude.alias("amplitude"))
    return cut_at_gap(rows, ["page_id"], "amplitude", "rank", CUT)


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of a result page with the first text after each that is no address; one result for each address, no advertisements."""
    turn = F.col("rank")
    to = F.concat(F.lit(REDIRECTED), F.col("n") * 5 % 7, F.lit("s.org%2Fp"))
    rows = _turns(spark, sf).select(
        "page_id", turn.alias("pos"), F.when(turn % 2 == 0, "link").otherwise("text").alias("role"), "label",
        F.when(turn % 2 == 0, to).alias("value"), (turn / 10).alias("relevance"),
    )
    rows = rows.unionAll(spark.createDataFrame(FOUND, NODES)).withColumn("value", F.coalesce("value", F.lit("")))  # a fixed list
    title = F.contains("value", F.lit(REDIRECT)) & F.col("role").isin("heading", "link", "cta")
    rows = rows.filter(~F.contains("value", F.lit(AD_REDIRECT))).withColumn("url", F.when(title, search.redirect_target(F.col("value"))))
    rows = rows.filter(F.col("url").isNull() | ~search.contains_any(F.lower("url"), search.ADS))
    seen = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    rows = rows.withColumn("seen", seen).filter("url IS NULL OR seen = 1")
    page = Window.partitionBy("page_id").orderBy("pos")
    rows = rows.withColumn("at", F.count("url").over(page)).filter("at > 0")
    text = F.when(F.col("url").isNull() & (F.octet_length("label") > 10) & ~F.regexp_like("label", F.lit(ADDRESS)), F.col("pos"))
    told = rows.groupBy("page_id", "at").agg(
        F.min_by(F.struct("label", "url", "relevance"), "pos").alias("t"), F.min_by("label", text).alias("snippet")
    ).filter("t.label <> '' OR snippet IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("at")).cast("long")
    out = told.withColumn("rank", rank).filter(F.col("rank") <= KEEP)
    url = F.col("t.url")
    return out.select(
        "page_id", "rank", F.col("t.label").alias("title"), url.alias("url"), domain(url).alias("domain"),
        F.coalesce("snippet", F.lit("")).alias("snippet"), F.col("t.relevance").alias("confidence"),
    )


def _weight(role: Column, weights: dict) -> Column:
    out = F.lit(1.0)
    for w, roles in weights.items():
        out = F.when(role.isin(*roles), w).otherwise(out)
    return out


def _seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Trees with a seed for each node: turns in heap order, a page of one wide level, and one deep chain."""
    roles = F.array(*map(F.lit, TREE_ROLES))
    rows = _turns(spark, sf).select(
        "page_id", F.col("rank").alias("node_id"), F.when(F.col("rank") > 0, F.floor((F.col("rank") - 1) / 2)).alias("parent_id"),
        text_similarity(F.lit(GOAL), F.col("label")).alias("seed"), "n",
    ).withColumn("bm25", F.col("seed") / (F.col("seed") + 1.0))
    rows = rows.select("page_id", "node_id", "parent_id", "seed", "bm25", "n")
    node = F.col("id")
    wide = spark.range(60).select(F.lit(-1).cast("long"), node, F.when(node > 0, F.lit(0).cast("long")), node % 5 / 10, node % 3 / 10, node)
    deep = spark.range(210).select(F.lit(-2).cast("long"), node, F.when(node > 0, node - 1), node % 5 / 10, node % 3 / 10, node)
    return rows.unionAll(wide).unionAll(deep).withColumn("role", F.element_at(roles, (F.col("n") % len(TREE_ROLES) + 1).cast("int"))).drop("n")


def propagate(nodes: DataFrame) -> DataFrame:
    """Seeds spread over each page's tree by a Chebyshev polynomial of its normalised Laplacian, blended with the BM25 score.

    ``nodes``: page_id, node_id, parent_id, role, seed, bm25. Scaled to [-1, 1] the operator is minus the weighted adjacency, so each order sends
    weighted values along edges, to the neighbours listed in the node's own row, and sums them: one shuffle for each order. A parent of more
    than eight children reaches the first 4 + 8 ln(n) only. Small pages take order 2, others 3, deep or very large ones 4.
    """
    family = Window.partitionBy("page_id", "parent_id")
    is_child = F.col("parent_id").isNotNull()
    kids = F.when(is_child, F.count("*").over(family)).otherwise(0)
    place = F.row_number().over(family.orderBy("node_id"))
    nodes = nodes.withColumn("siblings", kids).withColumn("reached", is_child & (place <= F.when(kids <= 8, kids).otherwise(F.least(F.floor(4 + F.ln(kids) * 8), kids))))
    counts = nodes.filter(is_child).groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    nodes = nodes.join(counts, ["page_id", "node_id"], "left")
    degree = F.greatest(F.coalesce("children", F.lit(0)) + is_child.cast("int"), F.lit(1))
    nodes = nodes.withColumn("degree", degree)
    up = nodes.filter("reached").select("page_id", "parent_id", "node_id", F.col("role").alias("low"), F.col("degree").alias("d"))
    top = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("role").alias("high"), F.col("degree").alias("e"))
    weight = F.sqrt(_weight(F.col("high"), DOWN) * _weight(F.col("low"), UP)) / F.sqrt(F.col("d") * F.col("e"))
    edge = up.join(top, ["page_id", "parent_id"]).withColumn("w", weight)
    ends = F.array(*(F.struct(F.col(a).alias("node_id"), F.struct(F.col(b).alias("to"), "w").alias("end")) for a, b in (("node_id", "parent_id"), ("parent_id", "node_id"))))
    near = edge.select("page_id", F.inline(ends)).groupBy("page_id", "node_id").agg(F.collect_list("end").alias("near"))  # at most 4 + 8 ln(n) and a parent
    size = nodes.groupBy("page_id").agg(F.count("*").alias("size"))
    order = F.when(F.col("size") < 50, 2).when(F.col("size") < 200, 3).when((F.col("depth") > 15) | (F.col("size") > 2000), 4).otherwise(3)
    deep = _depths(nodes)
    state = nodes.select("page_id", "node_id", "seed", "bm25").join(near, ["page_id", "node_id"], "left").join(size.join(deep, "page_id"), "page_id")
    state = state.select("page_id", "node_id", "near", order.alias("order"), "bm25", F.lit(0.0).alias("last"), F.col("seed").alias("now"), (F.col("seed") * THETA[0]).alias("sum"))
    whole = ["near", "order", "bm25", "last", "now", "sum"]
    kind = dict(state.dtypes)
    for k in range(1, len(THETA)):
        empty = [F.lit(None).cast(kind[c]).alias(c) for c in whole]
        own = F.struct("node_id", *whole, F.lit(0.0).alias("sent"))

        def letter(e: Column, rest: list[Column] = empty) -> Column:
            return F.struct(e["to"].alias("node_id"), *rest, (e["w"] * F.col("now")).alias("sent"))

        sent = F.transform(F.coalesce("near", F.array().cast(kind["near"])), lambda e: letter(e))
        mail = state.select("page_id", F.inline(F.concat(F.array(own), sent)))
        got = mail.groupBy("page_id", "node_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in whole), F.sum("sent").alias("sent"))
        following = -F.col("sent") if k == 1 else F.col("sent") * -2.0 - F.col("last")
        got = got.withColumn("next", following)
        total = F.col("sum") + F.when(F.col("order") >= k, F.col("next") * THETA[k]).otherwise(0.0)
        state = got.select("page_id", "node_id", "near", "order", "bm25", F.col("now").alias("last"), F.col("next").alias("now"), total.alias("sum"))
    return state.select("page_id", "node_id", F.round((1 - RESTART) * F.greatest("sum", F.lit(0.0)) + RESTART * F.col("bm25"), 5).alias("amplitude"))


def _depths(nodes: DataFrame, most: int = 16) -> DataFrame:
    """Each page's depth, counted up to 16, by doubling: after k rounds a row names its ancestor 2^k levels up."""
    up = nodes.select("page_id", "node_id", F.col("parent_id").alias("above"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(int(math.log2(most))):
        next_up = up.select("page_id", F.col("node_id").alias("above"), F.col("above").alias("further"), F.col("depth").alias("more"))
        up = up.join(next_up, ["page_id", "above"], "left").select("page_id", "node_id", F.col("further").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    return up.groupBy("page_id").agg(F.max("depth").alias("depth"))


def propagation(spark: SparkSession, sf: str) -> DataFrame:
    return propagate(_seeded(spark, sf))


def suggested_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What to do with a page next: from its title and size, and from the kinds, labels and scores of its matched nodes."""
    turns = _turns(spark, sf)
    role = F.element_at(F.array(*map(F.lit, [*TREE_ROLES, "data"])), (F.col("n") % 8 + 1).cast("int"))
    score = F.col("n") * 37 % 100 / 100
    rows = turns.select("page_id", role.alias("role"), "label", F.lit(None).cast("string").alias("name"), score.alias("amplitude"), F.lit(0.0).alias("causal"), score.alias("confidence"))
    rows = rows.unionAll(spark.createDataFrame(MATCHES, MATCHED))  # a fixed list
    pages = turns.groupBy("page_id").agg(F.left(F.min_by("label", "rank"), F.lit(12)).alias("title"), (F.count("*") * 10).alias("nodes"))
    pages = pages.unionAll(spark.createDataFrame(ACTED, "page_id long, title string, nodes long"))  # a fixed list
    raw = (F.col("role") == "data") & F.contains("name", F.lit(".")) & F.contains("name", F.lit("["))
    state = F.regexp_like("label", F.lit(r"__NEXT_DATA__|__NUXT__|initialState|window\.__data"))
    state = state | ((F.col("role") == "data") & F.regexp_like("name", F.lit(r"page\.@|navigation\.")))
    told = F.col("role").isin("text", "data", "cell", "heading", "paragraph")
    facts = rows.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(raw).alias("raw"), F.count_if(state).alias("state"),
        F.count_if((told | (F.col("role") == "price")) & (F.octet_length("label") > 30)).alias("content"),
        F.max("amplitude").alias("top"), F.max("causal").alias("causal"), F.max("confidence").alias("sure"),
        F.bool_or(told & (F.regexp_like("label", F.lit("[0-9]")) | (F.octet_length("label") > 60))).alias("factual"),
    )
    low, nodes = F.lower("title"), F.col("nodes")
    has = lambda words: F.regexp_like(low, F.lit(alternatives(words)))
    blocked = (nodes <= 15) & (has(BLOCKED) | ((nodes <= 5) & (F.contains(low, F.lit("page not found")) | (low == ""))))
    failed = has(FAILED) | ((nodes < 20) & (has(("oops", "sorry")) | (low == "")))
    zero = F.lit(0)
    share = F.col("raw") / F.col("n")
    data_only = F.coalesce((share > 0.6) | ((F.col("state") > 0) & (share > 0.4)), F.lit(False))
    shell = (nodes < 10) | ((nodes > 50) & (F.coalesce("content", zero) == 0))
    doubtful = (F.coalesce("causal", F.lit(0.0)) <= 0) & (F.coalesce("top", F.lit(0.0)) < 0.5) & (F.col("title") != "")
    action = (
        F.when(blocked, "requires_auth_or_proxy").when(failed, "retry_url").when(~data_only & shell, "fetch_api").when(data_only, "run_js")
        .when(doubtful, "verify_url").when(F.col("n").isNull(), "expand_search").when((F.col("sure") > 0.8) & F.col("factual"), "answer_directly")
        .when(F.col("sure") > 0.5, "verify_with_context").when(F.col("sure") > 0.2, "expand_search").otherwise("try_different_goal")
    )
    return pages.join(facts, "page_id", "left").select("page_id", action.alias("action"))


def _sql_all(c: str, patterns: list[str]) -> str:
    return " AND ".join(f"regexp_matches({c}, {quoted(p)})" for p in patterns)


def _values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else repr(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def _sql_weight(role: str, weights: dict) -> str:
    return "CASE " + " ".join(f"WHEN {role} IN ({', '.join(map(quoted, r))}) THEN {w}::DOUBLE" for w, r in weights.items()) + " ELSE 1 END"


PENALTY_CASES = " ".join(
    f"WHEN {_sql_all('low', p)}{'' if more is None else f' AND strlen(low) > {more}'}{'' if fewer is None else f' AND strlen(low) < {fewer}'} THEN {keep}::DOUBLE"
    for keep, p, more, fewer in PENALTIES
)
NONE_CASES = " OR ".join(f"({_sql_all('lower(label)', p)}{'' if more is None else f' AND strlen(lower(label)) > {more}'})" for p, more in NO_CONTENT)
TURNS = "SELECT conv_id AS page_id, turn::BIGINT AS rank, coalesce(text, '') AS label, (conv_id + turn)::BIGINT AS n FROM conversations"
AD_CASES = " OR ".join(f"contains(lower(url), {quoted(a)})" for a in search.ADS)


def _order_sql(k: int) -> str:
    """The k-th Chebyshev term from the two before it."""
    value = "-coalesce(m.s, 0)" if k == 1 else "-2 * coalesce(m.s, 0) - p.t"
    before = "" if k == 1 else f"JOIN t{k - 2} p USING (page_id, node_id)"
    return f"""t{k} AS (SELECT c.page_id, c.node_id, {value} AS t FROM t{k - 1} c {before} LEFT JOIN (
  SELECT e.page_id, b AS node_id, sum(w * t) AS s FROM e JOIN t{k - 1} x ON x.page_id = e.page_id AND x.node_id = e.a GROUP BY ALL) m USING (page_id, node_id))"""


QUERIES = {
    f.__name__: f
    for f in (label_penalties, post_filter, field_label_dedup, result_cut, search_results, propagation, suggested_actions)
}
ORACLE = {
    "label_penalties": f"""
SELECT label, round(CASE {PENALTY_CASES} ELSE 1 END * CASE WHEN regexp_matches(label, {quoted(f"^({alternatives(STATE)})")})
  THEN {STATE_FACTOR}::DOUBLE ELSE 1 END, 6)::DOUBLE AS penalty
FROM (SELECT label, lower(label) AS low FROM ({TURNS}) UNION SELECT unnest({listed(LABELS)}), lower(unnest({listed(LABELS)})))""",
    "post_filter": f"""
WITH r AS (SELECT page_id, rank, label, NULL::VARCHAR AS name, NULL::VARCHAR AS html_id FROM ({TURNS})
  UNION ALL {_values(RANKED)}),
k AS (SELECT page_id, rank, label FROM r WHERE NOT ({NONE_CASES} OR coalesce(regexp_matches(lower(name), {quoted(META_NAMES)}), false)
  OR coalesce(regexp_matches(lower(html_id), {quoted(SIDE_IDS)}), false)))
SELECT * FROM k n WHERE NOT EXISTS (SELECT 1 FROM k e WHERE e.page_id = n.page_id AND e.rank < n.rank
  AND strlen(n.label) >= 20 AND strlen(e.label) > strlen(n.label) AND contains(e.label, n.label))""",
    "field_label_dedup": f"""
WITH r AS (SELECT page_id, rank, ({listed([*TREE_ROLES, " Prices of the day", "prices OF the day", "The weather of the day"])})[n * 7 % 10 + 1] AS label,
  (rank % 3)::DOUBLE / 10 AS causal FROM ({TURNS})),
k AS (SELECT *, CASE WHEN strlen(label) < 10 THEN 'rank ' || rank ELSE lower(trim(label)) END AS key FROM r)
SELECT page_id, min(rank) OVER (PARTITION BY page_id, key) AS place, rank, label, causal FROM k
QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY causal DESC, rank) = 1""",
    "result_cut": f"""
WITH r AS (SELECT page_id, rank, round(pow(0.5::DOUBLE + (page_id % 10)::DOUBLE / 20,
    (rank + CASE WHEN rank > page_id % 7 THEN 2 ELSE 0 END)::DOUBLE), 6) AS amplitude FROM ({TURNS})),
i AS (SELECT *, row_number() OVER w AS i, lag(amplitude) OVER w AS before, count(*) OVER (PARTITION BY page_id) AS n FROM r
  WINDOW w AS (PARTITION BY page_id ORDER BY amplitude DESC, rank)),
f AS (SELECT page_id, max(amplitude) FILTER (WHERE i = 1) AS a, max(amplitude) FILTER (WHERE i = 5) AS b,
  min(i) FILTER (WHERE i > 4 AND before > 0.001 AND amplitude < before * (1.0::DOUBLE - (0.30::DOUBLE - 0.10::DOUBLE * {min(CUT / 50, 1.0)}::DOUBLE))) AS cut FROM i GROUP BY 1),
g AS (SELECT page_id, coalesce(a > 0.01 AND (a - b) / a < 0.25, false) AS broad, cut FROM f)
SELECT page_id, rank, i, amplitude, CASE WHEN broad THEN 'broad' WHEN n <= 5 THEN 'too_few_candidates'
  WHEN cut <= {CUT} THEN 'relevance_gap' ELSE 'top_k_limit' END AS reason FROM i JOIN g USING (page_id)
WHERE (NOT broad AND n <= 5) OR (i <= {CUT} AND (broad OR cut IS NULL OR i < cut))""",
    "search_results": f"""
WITH r AS (SELECT page_id, rank AS pos, CASE WHEN rank % 2 = 0 THEN 'link' ELSE 'text' END AS role, label,
    CASE WHEN rank % 2 = 0 THEN {quoted(REDIRECTED)} || (n * 5 % 7) || 's.org%2Fp' ELSE '' END AS value, rank::DOUBLE / 10 AS relevance FROM ({TURNS})
  UNION ALL SELECT c0, c1, c2, c3, coalesce(c4, ''), c5 FROM ({_values(FOUND)}) AS v(c0, c1, c2, c3, c4, c5)),
u AS (SELECT *, CASE WHEN contains(value, {quoted(REDIRECT)}) AND role IN ('heading', 'link', 'cta')
  THEN url_decode(replace(regexp_extract(value, 'uddg=([^&]*)', 1), '+', ' ')) END AS url FROM r WHERE NOT contains(value, {quoted(AD_REDIRECT)})),
f AS (SELECT * FROM u WHERE url IS NULL OR NOT ({AD_CASES})
  QUALIFY url IS NULL OR row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1),
g AS (SELECT *, count(url) OVER (PARTITION BY page_id ORDER BY pos) AS nr FROM f),
t AS (SELECT page_id, nr, arg_min(label, pos) AS title, arg_min(url, pos) AS url, arg_min(relevance, pos) AS confidence,
  arg_min(label, pos) FILTER (WHERE url IS NULL AND strlen(label) > 10 AND NOT regexp_matches(label, {quoted(ADDRESS)})) AS snippet FROM g WHERE nr > 0 GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY nr) AS rank, title, url, {DOMAIN.format("url")} AS domain,
  coalesce(snippet, '') AS snippet, confidence::DOUBLE AS confidence
FROM t WHERE title <> '' OR snippet IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY nr) <= {KEEP}""",
    "propagation": f"""
WITH RECURSIVE w AS (SELECT page_id, rank AS node_id, label, n, CASE WHEN rank > 0 THEN (rank - 1) // 2 END AS parent_id,
  list_filter(regexp_split_to_array({quoted(GOAL)}, '[\\s_-]+'), lambda x: x <> '') AS ws, lower(label) AS low FROM ({TURNS})),
s AS (SELECT page_id, node_id, parent_id, n, low, ws, len(list_filter(ws, lambda x: contains(low, x))) AS hits FROM w),
n0 AS (SELECT page_id, node_id, parent_id, seed, seed / (seed + 1) AS bm25, n
  FROM (SELECT *, CASE WHEN hits = len(ws) THEN 1 ELSE hits::DOUBLE / len(ws) END AS seed FROM s)
  UNION ALL SELECT -1, i, CASE WHEN i > 0 THEN 0 END, (i % 5)::DOUBLE / 10, (i % 3)::DOUBLE / 10, i FROM range(60) v(i)
  UNION ALL SELECT -2, i, CASE WHEN i > 0 THEN i - 1 END, (i % 5)::DOUBLE / 10, (i % 3)::DOUBLE / 10, i FROM range(210) v(i)),
n AS (SELECT page_id, node_id, parent_id, seed, bm25, ({listed(TREE_ROLES)})[n % {len(TREE_ROLES)} + 1] AS role FROM n0),
c AS (SELECT page_id, parent_id AS node_id, count(*) AS children FROM n WHERE parent_id IS NOT NULL GROUP BY ALL),
d AS (SELECT n.*, greatest(coalesce(children, 0) + (parent_id IS NOT NULL)::INT, 1) AS degree, coalesce(children, 0) AS children FROM n LEFT JOIN c USING (page_id, node_id)),
k AS (SELECT x.page_id, x.node_id, x.parent_id, sqrt(({_sql_weight("p.role", DOWN)}) * ({_sql_weight("x.role", UP)})) / sqrt(x.degree * p.degree) AS w,
    row_number() OVER (PARTITION BY x.page_id, x.parent_id ORDER BY x.node_id) AS place, p.children
  FROM d x JOIN d p ON p.page_id = x.page_id AND p.node_id = x.parent_id),
k1 AS (SELECT * FROM k WHERE place <= CASE WHEN children <= 8 THEN children ELSE least(floor(4 + ln(children) * 8), children) END),
e AS (SELECT page_id, node_id AS a, parent_id AS b, w FROM k1 UNION ALL SELECT page_id, parent_id, node_id, w FROM k1),
h AS (SELECT page_id, node_id, 0 AS depth FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.page_id, n.node_id, depth + 1 FROM h JOIN n ON n.page_id = h.page_id AND n.parent_id = h.node_id),
z AS (SELECT page_id, CASE WHEN count(*) < 50 THEN 2 WHEN count(*) < 200 THEN 3 WHEN max(depth) > 15 OR count(*) > 2000 THEN 4 ELSE 3 END AS o FROM h GROUP BY 1),
t0 AS (SELECT page_id, node_id, seed AS t FROM n), {", ".join(map(_order_sql, range(1, 5)))}
SELECT page_id, node_id, round({1 - RESTART}::DOUBLE * greatest({" + ".join(f"CASE WHEN o >= {k} THEN {x}::DOUBLE * t{k}.t ELSE 0 END" for k, x in enumerate(THETA))}, 0)
  + {RESTART}::DOUBLE * n.bm25, 5)::DOUBLE AS amplitude
FROM t0 JOIN n USING (page_id, node_id) JOIN t1 USING (page_id, node_id) JOIN t2 USING (page_id, node_id) JOIN t3 USING (page_id, node_id) JOIN t4 USING (page_id, node_id) JOIN z USING (page_id)""",
    "suggested_actions": f"""
WITH t AS ({TURNS}),
r AS (SELECT page_id, ({listed([*TREE_ROLES, "data"])})[n % 8 + 1] AS role, label, NULL::VARCHAR AS name, (n * 37 % 100)::DOUBLE / 100 AS amplitude, 0::DOUBLE AS causal,
    (n * 37 % 100)::DOUBLE / 100 AS confidence FROM t UNION ALL {_values(MATCHES)}),
p AS (SELECT page_id, left(arg_min(label, rank), 12) AS title, count(*) * 10 AS nodes FROM t GROUP BY 1 UNION ALL {_values(ACTED)}),
f AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE role = 'data' AND contains(name, '.') AND contains(name, '[')) AS raw,
  count(*) FILTER (WHERE regexp_matches(label, '__NEXT_DATA__|__NUXT__|initialState|window\\.__data') OR (role = 'data' AND regexp_matches(name, 'page\\.@|navigation\\.'))) AS state,
  count(*) FILTER (WHERE role IN ('text', 'data', 'cell', 'heading', 'paragraph', 'price') AND strlen(label) > 30) AS content,
  max(amplitude) AS top, max(causal) AS causal, max(confidence) AS sure,
  bool_or(role IN ('text', 'data', 'cell', 'heading', 'paragraph') AND (regexp_matches(label, '[0-9]') OR strlen(label) > 60)) AS factual FROM r GROUP BY 1),
g AS (SELECT *, lower(title) AS low, coalesce(raw / n > 0.6 OR (state > 0 AND raw / n > 0.4), false) AS data_only FROM p LEFT JOIN f USING (page_id))
SELECT page_id, CASE WHEN nodes <= 15 AND (regexp_matches(low, {quoted(alternatives(BLOCKED))}) OR (nodes <= 5 AND (contains(low, 'page not found') OR low = '')))
    THEN 'requires_auth_or_proxy'
  WHEN regexp_matches(low, {quoted(alternatives(FAILED))}) OR (nodes < 20 AND (regexp_matches(low, 'oops|sorry') OR low = '')) THEN 'retry_url'
  WHEN NOT data_only AND (nodes < 10 OR (nodes > 50 AND coalesce(content, 0) = 0)) THEN 'fetch_api' WHEN data_only THEN 'run_js'
  WHEN coalesce(causal, 0) <= 0 AND coalesce(top, 0) < 0.5 AND title <> '' THEN 'verify_url' WHEN n IS NULL THEN 'expand_search'
  WHEN sure > 0.8 AND factual THEN 'answer_directly' WHEN sure > 0.5 THEN 'verify_with_context' WHEN sure > 0.2 THEN 'expand_search'
  ELSE 'try_different_goal' END AS action FROM g""",
}
