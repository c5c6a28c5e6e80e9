"""Queries: answer scores, suppression, diversity, implicit feedback, structured entries, search results.

Conversation turns stand for a page's nodes (a conversation is a page, its role follows from the
numbers), events for what was shown and used; each rule is an expression over those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import field as ops
from heddle.plans.safety import listed, quoted
from heddle.sources.tables import table

ROLES = ["heading", "cell", "listitem", "price", "text", "navigation", "generic"]
GOALS = ["price of the product", "how many people", "when was the year", "interest rate percent", "a b", "Latest news and NEWS today"]
ENTRIES = [
    ("article.title", "Prices rise"), ("article.url", "https://a.org/prices"), ("meta.description", "All about the latest prices"),
    ("hero.image", "/img/x.png"), ("a.publishedAt", "2026-01-01"), ("offer.price", "9.90"), ("a.author", "Ada"),
    ("a.tag", "news"), ("x.note", "A long remark on the prices of news that goes on and on"), ("x.sessionid", "0" * 45),
    ("x.flag", "true"), ("x.none", ""), ("price", "null"), ("x.name", "/rooted"),
]
RESULT_URLS = [
    "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx%3Fy%3D1&rut=1", "https://a.org/", "https://duckduckgo.com/y.js?ad=1",
    "https://www.bing.com/aclick?x", "//x/?uddg=a%20b+c", "https://B.example/Ads/1",
]
#: A label, an answer that takes most of it up, and one that does not.
TURNS = ["Library opening hours this weekend", "The library keeps its weekend opening short.", "Different subject entirely, sorry."]
SEARCHES = ["weather today", "c++ & c#", "räksmörgås", "a~b*c_d-e.f", ""]
TOP = 50


def _literals(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("label"))
    role = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("conv_id") + F.col("turn")) % len(ROLES) + 1).cast("int"))
    nodes = turns.withColumn("kind", role)
    pages = nodes.groupBy("conv_id").agg((F.count("*") - 1).alias("siblings"), F.max(F.col("kind") == "text").alias("content"))
    return nodes.join(pages, "conv_id")


def answer_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every node's form, zone and, for each goal, the kind of its value and the product of all."""
    label, kind, depth = F.col("label"), F.col("kind"), F.col("turn") % 3
    shape = ops.answer_shape(label, kind, F.col("siblings"), F.col("turn") % 2 == 0, F.col("content"))
    boost = ops.answer_type(F.col("goal"), label)
    strong = ops.consensus(boost > 0.1, shape > 0.2, kind.isin("price", "cell", "text"))
    rows = _nodes(spark, sf).withColumn("goal", F.explode(F.array(*map(F.lit, GOALS))))
    zone = ops.zone_factor(kind, depth)
    return rows.select(
        "conv_id",
        "turn",
        "goal",
        F.round(shape, 6).alias("shape"),
        boost.alias("type_boost"),
        zone.alias("zone"),
        F.round((0.5 + boost) * strong * (1 + shape) * zone, 6).alias("score"),
    )


def suppression_by_user(spark: SparkSession, sf: str) -> DataFrame:
    """What each user's events keep if purchases are the useful ones."""
    used = F.count_if(F.col("event_type") == "purchase")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("shown"), used.alias("useful"))
    return rows.withColumn("factor", F.round(ops.suppression(F.col("useful"), F.col("shown")), 6))


def survivor_caps(spark: SparkSession, sf: str) -> DataFrame:
    """The caps of both rerankers, a document source and language being a page."""
    docs = table(spark, sf, "documents").groupBy("source", "lang")
    rows = docs.agg(F.count("*").alias("nodes"), F.count_if(F.col("n_chars") > 1000).alias("candidates"))
    caps = [ops.survivor_cap(F.col("candidates"), F.col("nodes"), late) for late in (True, False)]
    return rows.select("source", "lang", "nodes", "candidates", caps[0].alias("cap_late"), caps[1].alias("cap_single"))


def goal_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Questions by the cluster of their words; groups of goals that share feedback."""
    asked = table(spark, sf, "conversations").select(F.coalesce("text", F.lit("")).alias("goal"))
    rows = asked.unionAll(_literals(spark, GOALS, "goal"))
    return rows.groupBy(ops.goal_cluster(F.col("goal")).alias("cluster")).agg(F.count("*").alias("n"))


def diversity_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best events of each user; from the fourth of a type on, types with five or more lose 15 %."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
    best = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = events.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= TOP)
    same = Window.partitionBy("user_id", "event_type")
    nth = F.row_number().over(same.orderBy("_r"))
    many = F.count("*").over(same) >= 5
    kept = top.withColumn("score", F.when((nth >= 4) & many, F.col("value") * 0.85).otherwise(F.col("value")))
    again = Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")
    ranked = kept.withColumn("score", F.round("score", 4)).withColumn("rank", F.row_number().over(again).cast("long"))
    return ranked.select("user_id", "rank", "event_id", "event_type", "score")


def _words(rows: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: F.octet_length(w) > 3)
    return rows.select("conv_id", "turn", F.explode(words).alias("word"))


def implicit_feedback(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose words the next turn takes up: two or more, and over 0.4 of them (0.6 of fewer than five)."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    planted = spark.range(1).select(F.lit(-1).cast("long"), F.posexplode(F.array(*map(F.lit, TURNS))))
    turns = turns.unionAll(planted).filter(F.octet_length("text") >= 10)
    label = _words(turns).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    answer = _words(turns.withColumn("turn", F.col("turn") - 1)).distinct().withColumn("hit", F.lit(True))
    found = label.join(answer, ["conv_id", "turn", "word"], "left").groupBy("conv_id", "turn")
    sums = found.agg(F.sum("n").alias("words"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("overlap"))
    least = F.when(F.col("words") < 5, 0.6).otherwise(0.4)
    return sums.filter((F.col("overlap") >= 2) & (F.col("overlap") / F.col("words") > least))


def structured_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Roles and relevance of entries: literal ones, and the distinct properties of events."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in ENTRIES])
    rows = spark.range(1).select(F.inline(pairs))
    props = table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("value")).distinct()
    rows = rows.unionAll(props.filter("value IS NOT NULL").select(F.lit("props.k"), "value"))
    key, value = F.col("key"), F.col("value")
    score = F.round(ops.entry_relevance(key, value, F.lit("latest prices of news")), 6)
    return rows.select("key", "value", ops.entry_role(key, value).alias("role"), score.alias("relevance"))


def search_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The search address of each text of a conversation, whole, and of literal ones."""
    asked = table(spark, sf, "conversations").filter("text IS NOT NULL").select(F.col("text").alias("query"))
    rows = asked.unionAll(_literals(spark, SEARCHES, "query")).distinct()
    return rows.select("query", ops.search_url(F.col("query")).alias("url"))


def search_result_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Where search results lead, and which are advertisements."""
    rows = _literals(spark, RESULT_URLS, "url").unionAll(table(spark, sf, "pages").select("url"))
    ad = ops.contains_any(F.lower("url"), ops.ADS)
    return rows.select("url", ops.redirect_target(F.col("url")).alias("target"), ad.alias("ad"))


def page_goal_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each goal a page's title names, and whether the page asks for a human."""
    html = F.coalesce("html", F.lit(""))
    rows = table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(html, "<title[^>]*>([^<]*)</title>", 1).alias("title"), ops.contains_any(html, ops.CAPTCHA).alias("captcha")
    )
    rows = rows.withColumn("goal", F.explode(F.array(*map(F.lit, GOALS))))
    return rows.select("page_id", "goal", "captcha", F.round(ops.title_overlap(F.col("goal"), F.col("title")), 6).alias("overlap"))


def direct_answer(spark: SparkSession, sf: str) -> DataFrame:
    """The first of a search's three best results that is sure enough and says enough (a turn is a result)."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    sure = (F.col("turn") * 37 + F.col("conv_id")) % 100 / 100
    good = turns.withColumn("confidence", sure).filter((F.col("turn") < 3) & (F.col("confidence") >= 0.3) & (F.octet_length("text") > 20))
    best = good.groupBy("conv_id").agg(F.min_by(F.struct("text", "role", "confidence"), "turn").alias("b"))
    return best.select("conv_id", F.concat(F.trim("b.text"), F.lit(" ("), "b.role", F.lit(")")).alias("answer"), "b.confidence")


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def _in(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(map(quoted, values))})"


def _any(column: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(m)})" for m in marks) + ")"


def _cap_sql(late: bool) -> str:
    steps = "WHEN nodes < 200 THEN 50 WHEN nodes < 500 THEN 60 WHEN nodes < 2000 THEN 80" if late else "WHEN nodes < 200 THEN 60 WHEN nodes < 500 THEN 80"
    a, b, least = (0.7, 0.85, 10) if late else (0.6, 0.8, 20)
    return f"""greatest(floor((CASE WHEN nodes < 50 THEN nodes {steps} ELSE 100 END)
  * (CASE WHEN candidates > 100 THEN {a} WHEN candidates > 30 THEN {b} ELSE 1 END))::BIGINT, {least})::BIGINT"""


QUERIES = {
    f.__name__: f
    for f in (
        answer_scores, suppression_by_user, survivor_caps, goal_clusters, diversity_penalty, implicit_feedback,
        structured_entries, search_urls, search_result_urls, page_goal_overlap, direct_answer,
    )
}
LONG = "['latest', 'prices', 'news']"
ORACLE = {
    "answer_scores": f"""
WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS label, {listed(ROLES)}[(conv_id + turn) % {len(ROLES)} + 1] AS kind FROM conversations),
p AS (SELECT conv_id, count(*) - 1 AS siblings, bool_or(kind = 'text') AS content FROM n GROUP BY 1),
g AS (SELECT unnest({listed(GOALS)}) AS goal),
s AS (SELECT conv_id, turn, goal, kind,
  (CASE WHEN kind = 'heading' AND turn % 2 <> 0 THEN CASE WHEN content THEN -0.25 ELSE -0.35 END ELSE 0 END
  + CASE WHEN {_has("label", "[0-9]")} THEN 0.3 ELSE 0 END + CASE WHEN strlen(label) BETWEEN 1 AND 49 THEN 0.2 ELSE 0 END
  + CASE WHEN {_has("lower(label)", ops.UNITS)} THEN 0.15 ELSE 0 END
  + CASE WHEN siblings >= 2 AND kind IN ('cell', 'listitem') THEN 0.15 ELSE 0 END
  + CASE WHEN kind IN ('price', 'cell') THEN 0.1 ELSE 0 END
  + CASE WHEN strlen(label) BETWEEN 21 AND 199 THEN 0.1 ELSE 0 END)::DOUBLE AS shape,
  (CASE WHEN {_has("lower(goal)", ops.PRICE_GOAL)} AND {_has("lower(label)", ops.PRICE_LABEL)} THEN 0.25
   WHEN {_has("lower(goal)", ops.COUNT_GOAL)} AND {_has("label", ops.COUNT_LABEL)} THEN 0.2
   WHEN {_has("lower(goal)", ops.DATE_GOAL)} AND {_has("label", ops.DATE_LABEL)} THEN 0.15
   WHEN {_has("lower(goal)", ops.RATE_GOAL)} AND contains(label, '%') THEN 0.25 ELSE 0 END)::DOUBLE AS boost,
  (CASE WHEN kind = 'navigation' THEN 0.5 WHEN kind = 'generic' AND turn % 3 <= 1 THEN 0.7 ELSE 1 END)::DOUBLE AS zone
  FROM n JOIN p USING (conv_id), g),
t AS (SELECT *, (boost > 0.1)::INT + (round(shape, 6) > 0.2)::INT + (kind IN ('price', 'cell', 'text'))::INT AS k FROM s)
SELECT conv_id, turn, goal, round(shape, 6) AS shape, boost AS type_boost, zone,
  round((0.5 + boost) * CASE WHEN k >= 2 THEN 1 + (k - 1) * 0.25::DOUBLE ELSE 1 END * (1 + shape) * zone, 6)::DOUBLE AS score FROM t""",
    "suppression_by_user": """SELECT user_id, shown, useful, round(CASE WHEN shown >= 5 AND useful / shown < 0.25
  THEN 0.15 + 0.85 * (useful / shown) / 0.25 ELSE 1 END, 6)::DOUBLE AS factor FROM (
  SELECT user_id, count(*)::DOUBLE AS shown_d, count(*) AS shown, count(*) FILTER (WHERE event_type = 'purchase') AS useful
  FROM events GROUP BY 1)""",
    "survivor_caps": f"""SELECT source, lang, nodes, candidates, {_cap_sql(True)} AS cap_late, {_cap_sql(False)} AS cap_single FROM (
  SELECT source, lang, count(*) AS nodes, count(*) FILTER (WHERE n_chars > 1000) AS candidates FROM documents GROUP BY ALL)""",
    "goal_clusters": f"""SELECT CASE WHEN c = '' THEN '_' ELSE c END AS cluster, count(*) AS n FROM (
  SELECT array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(goal, '[^\\p{{L}}\\p{{N}}]+'),
    lambda w: strlen(w) > 3)))[1:3], '+') AS c
  FROM (SELECT coalesce(text, '') AS goal FROM conversations UNION ALL SELECT unnest({listed(GOALS)}))) GROUP BY 1""",
    "diversity_penalty": f"""
WITH t AS (SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 6) DESC, event_id) <= {TOP}),
s AS (SELECT user_id, event_id, event_type, round(value * CASE WHEN
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) >= 4
    AND count(*) OVER (PARTITION BY user_id, event_type) >= 5 THEN 0.85::DOUBLE ELSE 1 END, 4) AS score FROM t)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank, event_id, event_type, score FROM s""",
    "implicit_feedback": f"""
WITH t AS (SELECT conv_id, turn, lower(text) AS text FROM (SELECT conv_id, turn, text FROM conversations
  UNION ALL SELECT -1, unnest(range({len(TURNS)})), unnest({listed(TURNS)})) WHERE strlen(text) >= 10),
w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: strlen(w) > 3)) AS word FROM t),
s AS (SELECT conv_id, turn, count(*) AS words, count(*) FILTER (WHERE EXISTS (
  SELECT 1 FROM w a WHERE a.conv_id = w.conv_id AND a.turn = w.turn + 1 AND a.word = w.word)) AS overlap FROM w GROUP BY 1, 2)
SELECT * FROM s WHERE overlap >= 2 AND overlap::DOUBLE / words > CASE WHEN words < 5 THEN 0.6 ELSE 0.4 END""",
    "structured_entries": f"""
WITH e AS (SELECT unnest({listed([k for k, _ in ENTRIES])}) AS key, unnest({listed([v for _, v in ENTRIES])}) AS value
  UNION ALL SELECT DISTINCT 'props.k', json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL),
f AS (SELECT key, value, lower(string_split(key, '.')[-1]) AS seg, strlen(value) AS n,
  starts_with(value, 'http') AS web, starts_with(value, '/') AS rooted,
  len(list_filter({LONG}, lambda w: contains(lower(key), w))) / 3.0 AS k, len(list_filter({LONG}, lambda w: contains(lower(value), w))) / 3.0 AS v FROM e)
SELECT key, value, CASE WHEN value IN ('', 'true', 'false', 'null') THEN 'data'
  WHEN {_in("seg", ops.HEADING_KEYS)} AND n > 3 AND n < 300 AND NOT web AND NOT rooted THEN 'heading'
  WHEN {_in("seg", ops.TEXT_KEYS)} AND n > 10 THEN 'text' WHEN {_in("seg", ops.LINK_KEYS)} AND (web OR rooted) THEN 'link'
  WHEN {_in("seg", ops.IMAGE_KEYS)} AND (web OR rooted) THEN 'img' WHEN {_in("seg", ops.DATE_KEYS)} THEN 'data'
  WHEN {_in("seg", ops.PRICE_KEYS)} THEN 'price' WHEN {_in("seg", ops.AUTHOR_KEYS)} AND n > 2 AND n < 100 THEN 'text'
  WHEN {_in("seg", ops.TOPIC_KEYS)} AND n < 80 THEN 'listitem'
  WHEN n > 40 AND NOT web AND left(value, 1) NOT IN ('{{', '[') AND NOT {_any("seg", ("id", "hash", "token", "config"))} THEN 'text'
  ELSE 'data' END AS role,
  round(greatest(0.05, least(1.0, 0.05 + (k * 0.3 + v * 0.7) * 0.95
    - CASE WHEN {_has("lower(value)", "^https?://")} THEN 0.3 WHEN n < 10 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS relevance FROM f""",
    "search_urls": f"""SELECT query, {quoted(ops.SEARCH)} || replace(url_encode(query), '%20', '+') AS url FROM (
  SELECT text AS query FROM conversations WHERE text IS NOT NULL UNION SELECT unnest({listed(SEARCHES)}))""",
    "search_result_urls": f"""SELECT url, url_decode(replace(regexp_extract(url, 'uddg=([^&]*)', 1), '+', ' ')) AS target,
  {_any("lower(url)", ops.ADS)} AS ad FROM (SELECT unnest({listed(RESULT_URLS)}) AS url UNION ALL SELECT url FROM pages)""",
    "page_goal_overlap": f"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(html, ''), '<title[^>]*>([^<]*)</title>', 1)) AS title,
  {_any("coalesce(html, '')", ops.CAPTCHA)} AS captcha, unnest({listed(GOALS)}) AS goal FROM pages),
w AS (SELECT *, list_filter(string_split(lower(goal), ' '), lambda w: strlen(w) > 2) AS ws FROM p)
SELECT page_id, goal, captcha, CASE WHEN title = '' OR len(ws) = 0 THEN 0
  ELSE round(len(list_filter(ws, lambda w: contains(title, w)))::DOUBLE / len(ws), 6) END::DOUBLE AS overlap FROM w""",
    "direct_answer": """SELECT conv_id, trim(arg_min(text, turn), ' ') || ' (' || arg_min(role, turn) || ')' AS answer,
  arg_min(confidence, turn) AS confidence FROM (
  SELECT conv_id, turn, role, text, ((turn * 37 + conv_id) % 100 / 100)::DOUBLE AS confidence FROM conversations)
WHERE turn < 3 AND confidence >= 0.3 AND strlen(text) > 20 GROUP BY 1""",
}
