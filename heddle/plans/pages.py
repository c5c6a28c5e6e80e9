"""Queries: flags of blocked and failed pages, feeds, social metadata, JSON-LD, and plans for goals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions.text import alternatives, text_similarity
from heddle.plans.safety import listed, quoted
from heddle.sources.tables import table

# Title words of pages that block robots, that failed, and that check the browser first.
BLOCKED = (
    "robot check", "captcha", "are you a robot", "bot detection", "automated access", "sorry, you have been blocked",
    "pardon our interruption", "access to this page has been denied",
)
FAILED = (
    "404", "not found", "hittades inte", "kunde inte hittas", "finns inte", "error", "access denied", "403", "500",
    "forbidden", "unauthorized",
)
CHALLENGE = (
    "just a moment", "checking your browser", "please wait", "verifying", "attention required", "access denied",
    "one more step", "security check", "please enable", "enable javascript", "ddos protection", "challenge",
)
#: (title, elements) of pages that reach every flag.
TITLES = [
    ("Robot Check", 12), ("Robot Check", 40), ("", 4), ("", 18), ("", 50), ("Oops!", 19), ("404 Not Found", 900), ("Just a moment...", 20),
    ("Just a moment...", 31), ("News", 2), ("News", 70), ("Page not found", 5),
]
FEEDS = [
    '<?xml version="1.0"?><rss><channel><title>F</title><item><title><![CDATA[One & <b>two</b>]]></title><link>https://a.org/1</link>'
    "<description>First &lt;i&gt;text&lt;/i&gt;</description></item><item><link>https://a.org/2</link></item>"
    "<item><title>Three</title><description> </description></item></channel></rss>",
    '<?xml version="1.0"?><feed><entry><title>Atom</title><link href="https://b.org/x"/><summary>S</summary></entry></feed>',
    "<html><item><title>no feed</title></item></html>",
    '<?xml version="1.0"?><rss></rss>',
]
HEADS = [
    '<meta property="og:title" content="T"><meta name="twitter:card" content="summary"/><meta name="description" content="D">'
    '<script type="application/ld+json"> {"@type": "Product", "name": "Lamp", "offers": {"price": "9"}} </script>',
    '<meta content="first" property="og:type"><script type="application/ld+json">{broken</script>',
    "<p>none</p>",
]

# The keywords of each kind of goal; earlier kinds win ties.
KEYWORDS = (
    ("price", "pris", "cost", "kostnad", "product", "produkt"),
    ("version", "release", "latest", "senaste", "changelog", "update"),
    ("compare", "jämför", "vs", "skillnad", "difference"),
    ("köp", "buy", "purchase", "beställ", "order"),
    ("logga in", "login", "sign in", "log in"),
    ("sök", "search"),
    ("registrera", "register", "sign up", "skapa konto", "create account"),
    ("extrahera", "extract", "scrape", "hämta data", "get data"),
    ("kontakt", "contact", "telefon", "phone", "epost", "email", "adress", "address"),
    ("analysera", "analyze", "analyse", "granska", "review", "overview", "överblick"),
    ("nyhet", "nyheter", "news", "artikel", "article", "blog"),
    ("navigera", "navigate", "browse", "bläddra", "utforska", "explore"),
    ("hitta", "find", "get", "hämta", "check", "kolla"),
)
# The steps of each kind of goal, in the same order: action, what it is about, the steps that must be done before.
STEPS = (
    (("navigate", "product page", ()), ("extract", "price and product", (0,)), ("verify", "price", (1,))),
    (("navigate", "release page", ()), ("extract", "version and date", (0,)), ("verify", "version", (1,))),
    (
        ("navigate", "first choice", ()), ("extract", "first choice", (0,)), ("navigate", "second choice", (0,)),
        ("extract", "second choice", (2,)), ("verify", "comparison", (1, 3)),
    ),
    (
        ("navigate", "product page", ()), ("click", "add to cart", (0,)), ("navigate", "checkout", (1,)), ("fill", "delivery", (2,)),
        ("fill", "payment", (3,)), ("click", "place the order", (4,)), ("verify", "confirmation", (5,)),
    ),
    (
        ("navigate", "login page", ()), ("fill", "user name", (0,)), ("fill", "password", (1,)), ("click", "log in", (1, 2)),
        ("verify", "being logged in", (3,)),
    ),
    (("fill", "search field", ()), ("click", "search", (0,)), ("extract", "results", (1,))),
    (
        ("navigate", "registration page", ()), ("fill", "name", (0,)), ("fill", "email", (0,)), ("fill", "password", (0,)),
        ("click", "register", (1, 2, 3)), ("verify", "registration", (4,)),
    ),
    (("navigate", "page", ()), ("extract", "data", (0,)), ("verify", "data", (1,))),
    (("navigate", "contact page", ()), ("extract", "contacts", (0,)), ("verify", "contacts", (1,))),
    (
        ("navigate", "page", ()), ("extract", "structure and main content", (0,)), ("extract", "details", (0,)),
        ("verify", "analysis", (1, 2)),
    ),
    (("navigate", "news page", ()), ("extract", "headlines and dates", (0,)), ("verify", "news", (1,))),
    (
        ("navigate", "start page", ()), ("extract", "links and structure", (0,)), ("navigate", "inner page", (1,)),
        ("extract", "inner page", (2,)),
    ),
    (("navigate", "page", ()), ("extract", "what was asked for", (0,)), ("verify", "what was asked for", (1,))),
)
PLANS = list(zip(KEYWORDS, STEPS, strict=True))
GENERIC = (("navigate", "page for '{}'", ()), ("extract", "data for '{}'", (0,)), ("verify", "'{}'", (1,)))
COSTS = {"navigate": 0.3, "click": 0.2, "fill": 0.25, "extract": 0.15, "verify": 0.1}
GENERIC_COSTS = {"navigate": 0.3, "extract": 0.3, "verify": 0.2}
GOALS = [
    "Compare the price of two lamps", "log me into my account and sign in", "buy a blue shirt", "read the news", "zzz", "in",
    "skapa ett konto", "overview of the site", "find my order", "latest release",
]


def _count_tags(html: Column) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit("<[a-z][a-z0-9]*[\\s>]"), 0)).cast("long")


def page_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a page blocks robots, failed or checks the browser first, from its title and size."""
    html = F.coalesce("html", F.lit(""))
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract(html, "<title[^>]*>([^<]*)</title>", 1).alias("title"), _count_tags(html).alias("nodes"))
    planted = F.array(*[F.struct(F.lit(-1 - i).cast("long").alias("page_id"), F.lit(t).alias("title"), F.lit(n).cast("long").alias("nodes")) for i, (t, n) in enumerate(TITLES)])
    low, n = F.lower("title"), F.col("nodes")
    has = lambda words: F.regexp_like(low, F.lit(alternatives(words)))
    return rows.unionAll(spark.range(1).select(F.inline(planted))).select(
        "page_id",
        ((n <= 15) & (has(BLOCKED) | ((n <= 5) & (F.contains(low, F.lit("page not found")) | (low == ""))))).alias("blocked"),
        (has(FAILED) | ((n < 20) & (has(("oops", "sorry")) | (low == "")))).alias("failed"),
        ((has(CHALLENGE) & (n < 30)) | (n <= 3)).alias("challenge"),
    )


def _plain(field: Column) -> Column:
    """A feed field without its CDATA mark, entities and tags; null if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(field, r"^<!\[CDATA\[", ""), r"\]\]>$", "")
    for mark, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return F.nullif(F.trim(F.regexp_replace(text, "<[^>]*>", "")), F.lit(""))


def _field(name: str) -> Column:
    return _plain(F.regexp_extract("item", f"(?s)<{name}[^>]*>(.*?)</{name}>", 1))


def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Titled entries of RSS and Atom feeds with their link and the start of their description."""
    extra = spark.range(1).select(F.posexplode(F.array(*map(F.lit, FEEDS))).alias("i", "html"))
    rows = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    feeds = rows.unionAll(extra.select((-1 - F.col("i")).cast("long"), "html")).filter(
        F.regexp_like("html", F.lit(r"^\s*<\?xml")) & F.regexp_like("html", F.lit("<rss|<feed|<channel>"))
    )
    items = feeds.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<(?:item|entry)[\\s>].*?</(?:item|entry)>"), 0)).alias("pos", "item"))
    link = F.coalesce(_field("link"), F.nullif(F.regexp_extract("item", 'href="([^"]*)"', 1), F.lit("")), F.lit(""))
    about = F.coalesce(_field("description"), _field("summary"), F.lit(""))
    found = items.select("page_id", F.col("pos").cast("long").alias("pos"), _field("title").alias("title"), link.alias("link"), F.substring(about, 1, 200).alias("description"))
    return found.filter("title IS NOT NULL")


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.range(1).select(F.posexplode(F.array(*map(F.lit, HEADS))).alias("i", "html"))
    rows = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return rows.unionAll(extra.select((-1 - F.col("i")).cast("long"), "html"))


def social_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The named meta tags of pages: OpenGraph, Twitter cards and the plain ones."""
    tags = _heads(spark, sf).select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<meta[^>]*>"), 0)).alias("tag"))
    name = F.regexp_extract("tag", '(?:property|name)="([^"]*)"', 1)
    return tags.select("page_id", name.alias("name"), F.regexp_extract("tag", 'content="([^"]*)"', 1).alias("content")).filter("name <> ''")


def json_ld(spark: SparkSession, sf: str) -> DataFrame:
    """Type and name in the first JSON-LD block of pages that have a valid one."""
    block = F.trim(F.regexp_extract("html", '(?s)type="application/ld\\+json"[^>]*>(.*?)</script>', 1))
    found = _heads(spark, sf).select("page_id", F.try_parse_json(block).alias("v")).filter("v IS NOT NULL")
    return found.select("page_id", F.try_variant_get("v", "$['@type']", "string").alias("type"), F.try_variant_get("v", "$.name", "string").alias("name"))


def _rows_of(plan: int, steps: tuple, costs: dict) -> list[tuple]:
    """The steps of a plan with their level: one after the last step that they wait for."""
    level: list[int] = []
    for _, _, waits in steps:  # a step waits for earlier ones only
        level.append(max((level[w] + 1 for w in waits), default=0))
    return [(plan, i, s[0], f"{s[0].capitalize()}: {s[1]}", level[i], costs[s[0]]) for i, s in enumerate(steps)]


STEP_ROWS = [r for p, (_, steps) in enumerate(PLANS) for r in _rows_of(p, steps, COSTS)] + _rows_of(-1, GENERIC, GENERIC_COSTS)


def _steps(spark: SparkSession) -> DataFrame:
    """(plan, step, action, description, level, cost): the fixed plans; the generic one has number -1."""
    return spark.createDataFrame(STEP_ROWS, "plan int, step int, action string, description string, level int, cost double")


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    """(goal, plan) of the planted goals and of what users asked: the plan whose keywords fit best; -1 where none scores over 0.3."""
    words = [F.struct(F.lit(p).alias("plan"), F.lit(w).alias("word")) for p, some in enumerate(KEYWORDS) for w in some]
    goals = spark.range(1).select(F.explode(F.array(*map(F.lit, GOALS))).alias("goal"))
    asked = table(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL").select(F.col("text").alias("goal"))
    goals = goals.unionAll(asked).distinct()
    keyed = goals.select("goal", F.inline(F.array(*words)))
    low = F.lower("goal")
    fit = F.when(F.contains(low, F.col("word")), 1.0).otherwise(text_similarity(F.col("word"), low) * 0.5)
    scored = keyed.withColumn("fit", fit).groupBy("goal", "plan")
    total = F.max("fit") + F.count_if(F.col("fit") > 0.3) * 0.1 + (len(PLANS) - F.col("plan")) * 0.001
    best = scored.agg(F.round(total, 6).alias("score")).groupBy("goal").agg(F.max_by("plan", "score").alias("plan"), F.max("score").alias("score"))
    return best.select("goal", F.when(F.col("score") > 0.3, F.col("plan")).otherwise(-1).alias("plan"))


def plan_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of each goal's plan with the group in which they can run: one after the last step they wait for."""
    steps = _steps(spark)
    rows = _chosen(spark, sf).join(F.broadcast(steps), "plan")  # a few rows for each of the fixed plans
    total = F.round(F.sum("cost").over(Window.partitionBy("goal")), 6)
    text = F.replace("description", F.lit("{}"), F.col("goal"))
    return rows.select(
        "goal", "step", "action", text.alias("description"), "level", F.when(F.col("level") == 0, "ready").otherwise("pending").alias("status"), total.alias("plan_cost")
    )


def _any(words: tuple[str, ...]) -> str:
    return f"regexp_matches(t, {quoted(alternatives(words))})"


def _field_sql(name: str) -> str:
    found = f"regexp_extract(item, '(?s)<{name}[^>]*>(.*?)</{name}>', 1)"
    bare = rf"regexp_replace(regexp_replace({found}, '^<!\[CDATA\[', ''), '\]\]>$', '')"
    text = f"replace(replace(replace({bare}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    return f"nullif(trim(regexp_replace({text}, '<[^>]*>', '', 'g'), ' '), '')"


def _planted(values: list[str]) -> str:
    return f"""SELECT page_id, coalesce(html, '') AS html FROM pages UNION ALL
  SELECT -unnest(range(1, {len(values) + 1})), unnest({listed(values)})"""


def _plan_sql() -> str:
    words = ", ".join(f"({p}, {quoted(w)}, {sum(1 for x in re.split(r'[ _-]+', w) if x)}, {quoted(''.join(re.split(r'[ _-]+', w)))})" for p, some in enumerate(KEYWORDS) for w in some)
    steps = ", ".join(f"({p}, {i}, {quoted(a)}, {quoted(d)}, {level}, {cost}::DOUBLE)" for p, i, a, d, level, cost in STEP_ROWS)
    hits = "len(list_filter(regexp_split_to_array(word, '[ _-]+'), lambda x: x <> '' AND contains(low, x)))"
    return f"""
WITH goals AS (SELECT text AS goal, lower(text) AS low FROM conversations WHERE role = 'user' AND text IS NOT NULL UNION SELECT goal, lower(goal) FROM (SELECT unnest({listed(GOALS)}) AS goal)),
words(plan, word, n, joined) AS (VALUES {words}), steps(plan, step, action, description, level, cost) AS (VALUES {steps}),
fits AS (
  SELECT goal, plan, CASE WHEN contains(low, word) THEN 1.0 WHEN {hits} = n THEN 0.5 WHEN {hits} = 0 THEN CASE WHEN strlen(low) >= strlen(word)
    AND contains(regexp_replace(low, '[ \t\n\f\r_-]', '', 'g'), joined) THEN 0.5 ELSE 0.0 END ELSE {hits}::DOUBLE / n * 0.5 END::DOUBLE AS fit FROM goals, words
), scored AS (
  SELECT goal, plan, round(max(fit) + count(*) FILTER (WHERE fit > 0.3) * 0.1::DOUBLE + ({len(PLANS)} - plan) * 0.001::DOUBLE, 6) AS score FROM fits GROUP BY goal, plan
), best AS (SELECT goal, CASE WHEN max(score) > 0.3 THEN arg_max(plan, score) ELSE -1 END AS plan FROM scored GROUP BY goal)
SELECT goal, step, action, replace(description, '{{}}', goal) AS description, level, CASE WHEN level = 0 THEN 'ready' ELSE 'pending' END AS status,
  round(sum(cost) OVER (PARTITION BY goal), 6) AS plan_cost FROM best JOIN steps USING (plan)"""


QUERIES = {f.__name__: f for f in (page_flags, feed_items, social_metadata, json_ld, plan_steps)}
ORACLE = {
    "plan_steps": _plan_sql(),
    "page_flags": f"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(html, ''), '<title[^>]*>([^<]*)</title>', 1)) AS t,
  len(regexp_extract_all(coalesce(html, ''), '<[a-z][a-z0-9]*[\\s>]')) AS n FROM pages
  UNION ALL SELECT -unnest(range(1, {len(TITLES) + 1})), lower(unnest({listed([t for t, _ in TITLES])})), unnest({[n for _, n in TITLES]}))
SELECT page_id, n <= 15 AND ({_any(BLOCKED)} OR (n <= 5 AND (contains(t, 'page not found') OR t = ''))) AS blocked,
  {_any(FAILED)} OR (n < 20 AND (contains(t, 'oops') OR contains(t, 'sorry') OR t = '')) AS failed,
  ({_any(CHALLENGE)} AND n < 30) OR n <= 3 AS challenge FROM p""",
    "feed_items": f"""
WITH f AS (SELECT * FROM ({_planted(FEEDS)}) WHERE regexp_matches(html, '^\\s*<\\?xml') AND regexp_matches(html, '<rss|<feed|<channel>')),
a AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:item|entry)[\\s>].*?</(?:item|entry)>') AS items FROM f),
i AS (SELECT page_id, unnest(range(len(items))) AS pos, unnest(items) AS item FROM a)
SELECT page_id, pos, {_field_sql("title")} AS title,
  coalesce({_field_sql("link")}, nullif(regexp_extract(item, 'href="([^"]*)"', 1), ''), '') AS link,
  left(coalesce({_field_sql("description")}, {_field_sql("summary")}, ''), 200) AS description
FROM i WHERE {_field_sql("title")} IS NOT NULL""",
    "social_metadata": f"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<meta[^>]*>')) AS tag FROM ({_planted(HEADS)}))
SELECT page_id, regexp_extract(tag, '(?:property|name)="([^"]*)"', 1) AS name, regexp_extract(tag, 'content="([^"]*)"', 1) AS content
FROM t WHERE regexp_extract(tag, '(?:property|name)="([^"]*)"', 1) <> ''""",
    "json_ld": f"""
WITH b AS (SELECT page_id, trim(regexp_extract(html, '(?s)type="application/ld\\+json"[^>]*>(.*?)</script>', 1), ' ') AS j FROM ({_planted(HEADS)}))
SELECT page_id, json_extract_string(j, '$."@type"') AS type, json_extract_string(j, '$.name') AS name FROM b WHERE j <> '' AND json_valid(j)""",
}
