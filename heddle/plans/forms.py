"""Queries that map form fields, extract values by keys and compare two versions of a tree.

Planted nodes reach every rule; page trees and conversations (a conversation is a tree, its turns are the nodes) give the volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.labels import script_content, selector_hint
from heddle.functions.text import text_similarity
from heddle.plans.safety import listed
from heddle.sources import html_dom
from heddle.sources.tables import table

# Roles that take input.
INPUTS = ("textbox", "searchbox", "textarea", "combobox", "checkbox", "radio", "select")
# The role that a word of a key asks for, with its bonus.
WANTED = {
    "link": (0.3, ("url", "href", "link", "src")),
    "heading": (0.2, ("title", "heading", "headline", "rubrik")),
    "button": (0.2, ("button", "action")),
    "cta": (0.35, ("cta", "buy", "purchase", "köp", "cart", "checkout")),
    "price": (0.3, ("price", "pris", "cost", "amount", "belopp")),
    "product_card": (0.25, ("product", "produkt", "item", "card", "vara")),
    "img": (0.2, ("image", "img", "photo", "bild")),
    "navigation": (0.2, ("nav", "menu", "navigation", "meny")),
}
NODE = "page_id long, node_id long, parent_id long, role string, label string, value string, html_id string, name string, relevance double, disabled boolean"
FIELDS = ["email", "first name", "password", "zip", "agree"]
KEYS = ["story_title", "url", "price", "version", "released", "missing thing"]
ROLES = ["heading", "text", "listitem", "price", "cell"]
#: A form and a product page; negative page ids keep them apart from the tables' pages.
PLANTED = [
    (-1, 1, None, "textbox", "Email address", None, None, None, 0.5, False),
    (-1, 2, None, "textbox", "First name", None, None, None, 0.5, False),
    (-1, 3, None, "textbox", "", None, None, "password", 0.5, False),
    (-1, 4, None, "textbox", "Repeat password", None, None, None, 0.5, False),
    (-1, 5, None, "textbox", "Code", None, "zip", None, 0.5, True),
    (-1, 6, None, "checkbox", "I agree to the terms", None, None, None, 0.5, False),
    (-1, 7, None, "link", "email us", "/mail", None, None, 0.5, False),
    (-2, 1, None, "heading", "Story of a title", None, None, None, 0.9, False),
    (-2, 2, None, "link", "Read more", "https://a.org/url", None, None, 0.4, False),
    (-2, 3, None, "price", "$ 9.90", None, None, None, 0.8, False),
    (-2, 4, None, "generic", "version 1.15.0", None, None, None, 0.2, False),
    (-2, 5, 4, "heading", "version", None, None, None, 0.9, False),
    (-2, 6, None, "listitem", "released", None, None, None, 0.6, False),
    (-2, 7, None, "text", "May 2024", None, None, None, 0.3, False),
    (-2, 8, None, "text", "var price = function() { return 1; }", None, None, None, 0.9, False),
]


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    pages = html_dom.sem_nodes(table(spark, sf, "pages"), "read the news")
    planted = spark.createDataFrame(PLANTED, NODE)  # a fixed list
    return pages.select(*planted.columns).unionByName(planted)


def _likeness(key: Column, *texts: str) -> Column:
    """The largest similarity of the key to any of the columns."""
    return F.greatest(*(text_similarity(key, F.coalesce(t, F.lit(""))) for t in texts))


def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Which field of each page takes which key: keys in their order, each the most similar free field above 0.2.

    A page's fields and keys make one small list; a key without a field gets a null node.
    """
    rows = _nodes(spark, sf).filter(F.col("role").isin(*INPUTS) & ~F.col("disabled"))
    asked = rows.select("*", F.posexplode(F.array(*map(F.lit, FIELDS))).alias("at", "key"))
    liked = asked.withColumn("conf", F.round(_likeness(F.col("key"), "label", "name", "html_id"), 6))
    fields = F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("rank"), "node_id")))
    by_key = liked.groupBy("page_id", "at", "key").agg(F.filter(fields, lambda f: f["rank"] < -0.2).alias("fields"))
    lists = by_key.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "fields"))).alias("keys"))
    start = F.expr("cast(array() as array<struct<key: string, node_id: bigint, confidence: double>>)")

    def take(done: Column, k: Column) -> Column:
        free = F.filter(k["fields"], lambda f: ~F.exists(done, lambda d: d["node_id"].eqNullSafe(f["node_id"])))
        first = F.get(free, F.lit(0))
        return F.array_append(done, F.struct(k["key"].alias("key"), first["node_id"].alias("node_id"), (-first["rank"]).alias("confidence")))

    found = lists.select("page_id", F.explode(F.aggregate("keys", start, take)).alias("m")).select("page_id", "m.*")
    hint = selector_hint(F.col("role"), F.col("html_id"), F.col("label"), F.col("name"))
    return found.join(rows.select("page_id", "node_id", hint.alias("selector")), ["page_id", "node_id"], "left").select(
        "page_id", "key", "node_id", "confidence", "selector"
    )


def _found_by_key(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` best nodes above 0.1 for each key on each page, with what stands near a node that is the key itself; ties go to the first node."""
    order = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    rows = rows.withColumn("next", F.lead(F.struct("node_id", "label")).over(order))
    child = rows.filter("parent_id IS NOT NULL AND label <> '' AND role <> 'heading'")
    child = child.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.min_by(F.struct("node_id", "label"), "node_id").alias("child"))
    parent = rows.select("page_id", F.col("node_id").alias("parent_id"), F.struct("node_id", "label").alias("parent"))
    usable = rows.filter("label <> '' OR value IS NOT NULL").filter(~script_content(F.col("label")))
    asked = usable.withColumn("key", F.explode(F.array(*map(F.lit, KEYS))))
    parts = F.split(F.lower("key"), r"[\s_-]+")
    wish, bonus = F.lit(None).cast("string"), F.lit(0.0)
    for role, (gain, words) in reversed(WANTED.items()):
        hit = F.arrays_overlap(parts, F.array(*map(F.lit, words)))
        wish, bonus = F.when(hit, role).otherwise(wish), F.when(hit, gain).otherwise(bonus)
    score = _likeness(F.col("key"), "label", "name", "html_id", "value") + F.when(wish == F.col("role"), bonus).otherwise(0.0)
    scored = asked.withColumn("wish", wish).withColumn("score", score + F.col("relevance") * 0.1).filter("score > 0.1")
    first = Window.partitionBy("page_id", "key").orderBy(F.desc("score"), "node_id")
    best = scored.withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= most)
    best = best.join(child, ["page_id", "node_id"], "left").join(parent, ["page_id", "parent_id"], "left")
    plain = lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))
    names_it = F.col("role").isin("heading", "listitem") & (plain("label") == plain("key"))
    longer = (F.octet_length(F.trim(F.col("parent.label"))) > F.octet_length(F.trim("label"))) & F.contains(F.lower("parent.label"), F.lower(F.trim("label")))
    near = F.coalesce("child", "next", F.when(longer, F.col("parent")))
    low, key = F.lower(near["label"]), F.lower(F.trim("label"))
    rest = F.trim(F.substring(near["label"], F.length(key) + 1, F.length(near["label"])))
    stripped = F.when(F.startswith(low, key) & (rest != ""), rest).otherwise(near["label"])
    confidence = F.round(F.least(F.lit(1.0), F.col("score") * (0.4 + 0.6 * F.col("relevance"))), 6)
    return best.select(
        "page_id", "key", "rank", "node_id", "label", F.col("value").alias("held"), "wish", (names_it & near.isNotNull()).alias("named"),
        stripped.alias("told"), near["node_id"].alias("near_id"), F.coalesce(F.nullif("label", F.lit("")), "value").alias("itself"), confidence.alias("confidence"),
    )


def extract_data(spark: SparkSession, sf: str) -> DataFrame:
    """The value of each key on each page, from its best node above 0.1; those of a confidence below 0.1 are left out.

    A heading or list item that is the key itself names the value: its first child with a label, the next
    node of the same parent, or the rest of its parent's label.
    """
    best = _found_by_key(_nodes(spark, sf), 1)
    link = F.coalesce("wish", F.lit("")) == "link"
    value = F.when(link, F.coalesce("held", "label")).when(F.col("named"), F.col("told")).otherwise(F.col("itself"))
    source = F.when(~link & F.col("named"), F.col("near_id")).otherwise(F.col("node_id"))
    return best.select("page_id", "key", value.alias("value"), source.alias("source_id"), "confidence").filter("confidence >= 0.1")


def extract_data_multi(spark: SparkSession, sf: str, most: int = 3) -> DataFrame:
    """Up to ``most`` values of each key on each page, as for a comparison; a link key takes labels here, and no confidence is too low."""
    best = _found_by_key(_nodes(spark, sf), most)
    value = F.when(F.col("named"), F.col("told")).otherwise(F.col("itself"))
    source = F.when(F.col("named"), F.col("near_id")).otherwise(F.col("node_id"))
    return best.select("page_id", "key", "rank", value.alias("value"), source.alias("source_id"), "confidence")


def _trees(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the conversations as trees: turns are dropped, added and edited by rules on their numbers; every field changes somewhere."""
    n = F.col("conv_id") + F.col("turn")
    pick = lambda xs, k: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", pick(ROLES, n).alias("role"), F.coalesce("text", F.lit("")).alias("label"),
        F.when(n % 5 == 0, F.concat(F.lit("n"), F.col("turn"))).alias("html_id"), F.when(n % 5 == 1, F.lit("field")).alias("name"), n.alias("n"),
        (n % 10 / 10).alias("relevance"), (n % 13 == 0).alias("disabled"), F.lit(True).alias("visible"), F.when(n % 3 == 0, n % 2 == 0).alias("checked"),
        F.lit(None).cast("boolean").alias("expanded"), F.lit("Untrusted").alias("trust"),
    )
    old = rows.filter("n % 7 <> 0").withColumn("value", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))
    new = rows.filter("n % 11 <> 0").withColumn("label", F.when(F.col("n") % 3 == 0, F.concat("label", F.lit(" (edited)"))).otherwise(F.col("label")))
    n = F.col("n")
    return old, new.withColumns({
        "value": F.when(n % 4 == 0, F.lit("set")), "action": F.when(n % 4 == 1, F.lit("click")), "relevance": F.col("relevance") + F.when(n % 3 == 1, 0.05).otherwise(0.0),
        "disabled": n % 17 == 0, "visible": n % 19 != 0, "checked": F.when(n % 3 == 0, n % 4 == 0), "expanded": F.when(n % 5 == 2, n % 2 == 0),
        "trust": F.when(n % 8 == 0, "Trusted").otherwise("Untrusted"), "role": F.when((n % 5 == 0) & (n % 2 == 0), "link").otherwise(F.col("role")),
    })


#: The fields that a diff compares, as it shows them.
SHOWN = ("label", "relevance", "disabled", "visible", "checked", "expanded", "value", "action", "trust", "role")


def _shown(c: Column, field: str) -> Column:
    """A field as text: two digits of a relevance, Some(true) or None of a flag that may be missing, nothing for null."""
    if field == "relevance":
        return F.format_string("%.2f", c)
    if field in ("checked", "expanded"):
        return F.coalesce(F.concat(F.lit("Some("), c.cast("string"), F.lit(")")), F.lit("None"))
    return F.coalesce(c.cast("string"), F.lit(""))


def _keyed(rows: DataFrame) -> DataFrame:
    """Nodes by their key: id, else role and name, else role and the first 60 bytes of the label; of equal keys the last node counts."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(60)), lambda k: F.octet_length(F.left("label", k)) <= 60)
    key = (
        F.when(F.col("html_id").isNotNull(), F.concat(F.lit("id:"), "html_id"))
        .when(F.col("name").isNotNull(), F.concat("role", F.lit(":name:"), "name"))
        .otherwise(F.concat("role", F.lit(":"), F.left("label", F.array_max(fits))))
    )
    last = F.max_by(F.struct("turn", *SHOWN), "turn").alias("node")
    return rows.groupBy("conv_id", key.alias("key")).agg(last)


def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Added and removed nodes and the changed fields of the others, by node key: a full outer join."""
    old, new = (_keyed(t) for t in _trees(spark, sf))
    both = old.withColumnRenamed("node", "o").join(new.withColumnRenamed("node", "n"), ["conv_id", "key"], "full")
    name = lambda f: f"state.{f}" if f in SHOWN[2:6] else f
    change = lambda f: F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.struct(
        F.lit(name(f)).alias("field"), _shown(F.col(f"o.{f}"), f).alias("before"), _shown(F.col(f"n.{f}"), f).alias("after")))
    fields = F.array_compact(F.array(*map(change, SHOWN)))
    none = F.array(F.struct(*(F.lit(None).cast("string").alias(c) for c in ("field", "before", "after"))))
    gone, come = F.col("n").isNull(), F.col("o").isNull()
    changed = F.when(gone | come, none).otherwise(fields)
    kind = F.when(gone, "removed").when(come, "added").otherwise("modified")
    rows = both.select("conv_id", F.coalesce("n.turn", "o.turn").alias("turn"), "key", kind.alias("change"), F.explode(changed).alias("f"))
    return rows.select("conv_id", "turn", "key", "change", "f.*")


QUERIES = {f.__name__: f for f in (form_fields, extract_data, extract_data_multi, tree_diff)}
def _changed_sql(f: str) -> str:
    shown = {"relevance": "printf('%.2f', {})", "checked": "coalesce('Some(' || {} || ')', 'None')", "expanded": "coalesce('Some(' || {} || ')', 'None')"}.get(f, "coalesce({}::VARCHAR, '')")
    name = f"state.{f}" if f in SHOWN[2:6] else f
    return (
        f"UNION ALL SELECT conv_id, turn, key, change, '{name}', {shown.format(f'o.{f}')}, {shown.format(f'n.{f}')} FROM b WHERE change = 'modified' AND o.{f} IS DISTINCT FROM n.{f}"
    )


#: Greedy assignment has no SQL; tests hold form_fields and extract_data against golden rows.
ORACLE = {
    "tree_diff": f"""
WITH r AS (SELECT conv_id, turn, conv_id + turn AS n, {listed(ROLES)}[(conv_id + turn) % {len(ROLES)} + 1] AS role, coalesce(text, '') AS label,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN 'n' || turn END AS html_id, CASE WHEN (conv_id + turn) % 5 = 1 THEN 'field' END AS name FROM conversations),
v AS (SELECT 'o' AS v, conv_id, turn, n, role, label, html_id, name, (n % 10)::DOUBLE / 10 AS relevance, n % 13 = 0 AS disabled, true AS visible,
    CASE WHEN n % 3 = 0 THEN n % 2 = 0 END AS checked, NULL::BOOLEAN AS expanded, NULL AS value, NULL AS action, 'Untrusted' AS trust FROM r WHERE n % 7 <> 0
  UNION ALL SELECT 'n', conv_id, turn, n, CASE WHEN n % 5 = 0 AND n % 2 = 0 THEN 'link' ELSE role END, CASE WHEN n % 3 = 0 THEN label || ' (edited)' ELSE label END,
    html_id, name, (n % 10)::DOUBLE / 10 + CASE WHEN n % 3 = 1 THEN 0.05 ELSE 0 END, n % 17 = 0, n % 19 <> 0, CASE WHEN n % 3 = 0 THEN n % 4 = 0 END,
    CASE WHEN n % 5 = 2 THEN n % 2 = 0 END, CASE WHEN n % 4 = 0 THEN 'set' END, CASE WHEN n % 4 = 1 THEN 'click' END,
    CASE WHEN n % 8 = 0 THEN 'Trusted' ELSE 'Untrusted' END FROM r WHERE n % 11 <> 0),
k AS (SELECT *, CASE WHEN html_id IS NOT NULL THEN 'id:' || html_id WHEN name IS NOT NULL THEN role || ':name:' || name ELSE role || ':' ||
  left(label, list_max(list_filter(range(0, 61), lambda k: strlen(left(label, k)) <= 60))) END AS key FROM v),
u AS (SELECT * EXCLUDE (n) FROM k QUALIFY row_number() OVER (PARTITION BY v, conv_id, key ORDER BY turn DESC) = 1),
b AS (SELECT coalesce(o.conv_id, n.conv_id) AS conv_id, coalesce(n.turn, o.turn) AS turn, coalesce(o.key, n.key) AS key,
    CASE WHEN n.turn IS NULL THEN 'removed' WHEN o.turn IS NULL THEN 'added' ELSE 'modified' END AS change, o, n
  FROM (SELECT * FROM u WHERE v = 'o') o FULL JOIN (SELECT * FROM u WHERE v = 'n') n ON o.conv_id = n.conv_id AND o.key = n.key)
SELECT conv_id, turn, key, change, NULL AS field, NULL AS before, NULL AS after FROM b WHERE change <> 'modified' {" ".join(map(_changed_sql, SHOWN))}""",
}
