"""Queries over labels, keys, headers and form fields; planted rows reach every rule, table rows give the volume.

Conversation texts stand for labels and actions; the planted lists are in the queries and their SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import labels as ops
from heddle.functions.text import TREE_PRIORITY, lookup, nav_penalty, text_similarity
from heddle.plans.safety import listed, quoted
from heddle.sources.tables import table

LABELS = [
    "", "42", "1,234.5", "1/5", " 3 / 10 ", "12345678/9", "1/x", "{{title}}", "{name}", "{two words}", "i18n.button.ok", "currencyData.EUR.isObsolete",
    "fields.sections[1].body", "a.b.false", "www.example.com", "https://a.b.C/x", "1.2.X", "translations.messages.x", "jsonld.image[0].height: 1080",
    "Page.SEO.robots", "schema.name", "Home About Contact Services", "Gallium Germanium Gadolinium Gold", "Storm Hits Northern Coast Towns Again",
    "Ångström Öl Över Älven Igen Nu", "Rates rise to 5 % in May", "a short one", "one. two", "one, two", "var x = function(y) { return z; }",
    "window.dataLayer.push({ a: 1 });", "a function of time and of place", "x" * 61, "å" * 45, "B" * 81 + " C.",
]
KEYS = [
    "id", "a.id", "sections[2].content[3].id", "x.y.brandId", "a.trackingID", "props.__N_SSP", "buildId", "data.__typename", "page.footer.legal.text",
    "hero.title", "a.b.valid", "HamburgerNavigation.items", "article.body", "x.contentType", "",
]
ACTIONS = ["Click the button", "klicka här", "Type a name", "fyll i", "Hämta priset", "EXTRACT price", "vänta", "wait for it", "Verifiera", "go on", "fill and click"]
HEADERS = [
    "sid=abc; Path=/App; HttpOnly; Secure; Max-Age=60", "a=b=c", " x = 1 ;max-age=x", "noequals", "=v", "k=; path=/a; PATH=/B", "k=v; max-age=1; max-age=2", "",
]
#: page, node, role, label, name, html_id
FORMS = [
    (1, 1, "textbox", "Your Email", "", ""), (1, 2, "textbox", "Password", "", ""), (1, 3, "button", "Log in", "", ""),
    (2, 1, "searchbox", "Search", "", "user-q"), (2, 2, "textbox", "", "passwd", ""), (2, 3, "textbox", "Again", "login2", ""), (2, 4, "link", "Login", "", ""),
    (3, 1, "textbox", "Email", "", ""), (3, 2, "button", "Submit", "", ""), (4, 1, "textbox", "Lösenord", "", ""), (4, 2, "textbox", "User password", "", ""),
]
ROLES = ["cta", "link", "textbox", "select", "price", "heading"]
#: Roles and names of turns where they stand for the fields of a form.
FORM_ROLES, FORM_NAMES = ["textbox", "searchbox", "textbox", "button"], ["user", "q", "passwd", "go", "note"]
GOAL = "latest prices of news"
SIZE = 80


def _with(rows: DataFrame, values: list[str], name: str) -> DataFrame:
    """The distinct texts of the rows and of the planted list."""
    extra = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name))
    return rows.filter("text IS NOT NULL").select(F.col("text").alias(name)).unionAll(extra).distinct()


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return _with(table(spark, sf, "conversations"), LABELS, "label")


def _flag(spark: SparkSession, sf: str, **rules: Column) -> DataFrame:
    return _labels(spark, sf).select("label", *(c.alias(n) for n, c in rules.items()))


def label_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label")
    return _flag(spark, sf, template=ops.template_artifact(label), numeric=ops.numeric_artifact(label))


def label_kinds(spark: SparkSession, sf: str) -> DataFrame:
    label = F.col("label")
    return _flag(spark, sf, headline=ops.news_headline(label), nav_list=ops.nav_word_list(label), informational=ops.informational(label))


def script_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _flag(spark, sf, script=ops.script_content(F.col("label")))


def label_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _flag(spark, sf, short=ops.truncated(F.col("label"), SIZE))


def internal_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Planted keys and the keys of the events' properties, with the event's type before them."""
    own = table(spark, sf, "events").filter("props IS NOT NULL")
    own = own.select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    keys = own.select(F.concat("event_type", F.lit("."), "k").alias("text"))
    return _with(keys, KEYS, "key").select("key", ops.internal_key(F.col("key")).alias("internal"))


def action_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with(table(spark, sf, "conversations"), ACTIONS, "action").select("action", ops.action_type(F.col("action")).alias("type"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.min("action").alias("first_action"))


def _as_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as nodes: role, id and name by rules on their numbers, the text as label."""
    n = F.col("conv_id") + F.col("turn")
    role = lambda roles: F.element_at(F.array(*map(F.lit, roles)), (n % len(roles) + 1).cast("int"))
    return table(spark, sf, "conversations").filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", "turn", role(ROLES).alias("role"), role(FORM_ROLES).alias("form_role"), F.coalesce("text", F.lit("")).alias("label"),
        F.when(n % 5 == 0, F.concat(F.lit("n"), F.col("turn"))).alias("html_id"), F.when(n % 5 == 1, F.lit("field")).alias("name"),
        role(FORM_NAMES).alias("form_name"),
    )


def selector_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Every role with and without an id, a label and a name, and the turns as nodes."""
    some = lambda *xs: F.explode(F.array(*(F.lit(x).cast("string") for x in xs)))
    rows = spark.range(1).select(some(*ROLES).alias("role")).select("role", some("main", None).alias("html_id"))
    rows = rows.select("role", "html_id", some("It's on", "").alias("label")).select("*", some("q'1", None).alias("name"))
    rows = rows.unionByName(_as_nodes(spark, sf).select(*rows.columns)).distinct()
    return rows.select("*", ops.selector_hint(*map(F.col, ("role", "html_id", "label", "name"))).alias("selector"))


def set_cookies(spark: SparkSession, sf: str) -> DataFrame:
    """Cookies of the planted headers and of one header for each kind of event of each user, for the user's oldest event of it."""
    planted = spark.range(1).select(F.explode(F.array(*map(F.lit, HEADERS))).alias("header"))
    kinds = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.min("event_id").alias("first")).filter("event_type IS NOT NULL AND user_id IS NOT NULL")
    flags = F.concat(F.when(F.col("user_id") % 2 == 0, "; Secure").otherwise(""), F.when(F.col("first") % 3 == 0, "; HttpOnly").otherwise(""))
    header = F.concat("event_type", F.lit("="), F.col("user_id"), F.lit("; Path=/"), "event_type", F.lit("; Max-Age="), F.col("first"), flags)
    rows = kinds.select(header.alias("header")).unionAll(planted)
    return rows.withColumn("c", ops.cookie(F.col("header"))).filter("c IS NOT NULL").select("header", "c.*")


def login_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a field for a name and one for a password; the last field that fits counts. Planted pages have negative numbers."""
    planted = spark.range(1).select(F.explode(F.array(*(F.struct(*map(F.lit, r)) for r in FORMS))).alias("r"))
    planted = planted.select(*(F.col(f"r.col{i + 1}").alias(c) for i, c in enumerate(("page", "node", "role", "label", "name", "html_id"))))
    rows = planted.withColumn("page", -F.col("page").cast("long")).withColumn("node", F.col("node").cast("long"))
    turns = _as_nodes(spark, sf).select(
        F.col("conv_id").alias("page"), F.col("turn").alias("node"), F.col("form_role").alias("role"), "label", F.col("form_name").alias("name"), F.coalesce("html_id", F.lit("")).alias("html_id")
    )
    rows = rows.unionByName(turns)
    fits = lambda words: F.greatest(*(ops.holds_any(F.lower(c), w) for c, w in words.items()))
    node = lambda ok: F.max(F.when(ok, F.col("node"))).cast("long")
    role = F.col("role")
    found = rows.groupBy("page").agg(
        node(role.isin("textbox", "searchbox") & fits(ops.LOGIN_USER)).alias("username"),
        node((role == "textbox") & fits(ops.LOGIN_PASS)).alias("password"),
        node((role == "button") & ops.holds_any(F.lower("label"), ops.LOGIN_SUBMIT)).alias("submit"),
    )
    return found.filter("username IS NOT NULL AND password IS NOT NULL")


def input_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What is given of a screenshot, an address and a page, in this order; every combination over the pages."""
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("given"), "url", "html")
    has = lambda bit, c: (F.col("given").bitwiseAND(F.lit(bit)) > 0) & (F.coalesce(c, F.lit("")) != "")
    kind = F.when(has(1, F.lit("iVBOR")), "screenshot").when(has(2, F.col("url")), "url").when(has(4, F.col("html")), "html").otherwise("none")
    return rows.groupBy("given", kind.alias("kind")).agg(F.count("*").alias("pages"))


def learned_edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of edges by event type, user group and hour group, from their gains; without any, those of type and user group."""
    rows = table(spark, sf, "events").select(
        F.concat_ws(":", "event_type", (F.col("user_id") % 5).cast("string")).alias("base"),
        (F.hour("ts") % 4).alias("h"),
        (F.col("value") - 50).alias("gain"),
    )
    rows = rows.withColumn("key", F.concat_ws(":", "base", F.col("h").cast("string")))
    sums = lambda k: rows.groupBy(k).agg(
        F.sum(F.when(F.col("gain") > 0, F.col("gain")).otherwise(0.0)).alias(f"up_{k}"),
        F.sum(F.when(F.col("gain") < 0, F.col("gain")).otherwise(0.0)).alias(f"down_{k}"),
    )
    own = sums("key").filter("right(key, 1) <> '3'")  # the last hour group has no feedback of its own
    asked = rows.select("key", "base").distinct().join(own, "key", "left").join(sums("base"), "base")
    weight = ops.learned_weight(F.lit(0.6), F.coalesce("up_key", "up_base"), F.coalesce("down_key", "down_base"))
    return asked.select("key", F.round(weight, 6).alias("weight"))


def stream_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance of nodes as a stream meets them (with depth) and as its decision layer scores them (with penalties)."""
    role = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("conv_id") + F.col("turn")) % len(ROLES) + 1).cast("int"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("label"), role.alias("role"))
    likeness, weight, size = text_similarity(F.lit(GOAL), F.col("label")), lookup(F.col("role"), TREE_PRIORITY, 0.2), F.octet_length("label")
    within = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    met = likeness * 0.5 + weight * 0.4 - F.least(F.col("turn") * 0.05, F.lit(0.4))
    long = F.when(size > 500, 0.15).when(size > 300, 0.08).otherwise(0.0)
    decided = likeness * 0.55 + weight * 0.35 - long - nav_penalty(F.col("role"), F.col("label"))
    return rows.select("conv_id", "turn", within(met).alias("met"), within(decided).alias("decided"))


def _any(text: str, parts: tuple[str, ...]) -> str:
    return f"len(list_filter({listed(parts)}, lambda p: contains({text}, p))) > 0"


def _starts(text: str, parts: tuple[str, ...]) -> str:
    return f"len(list_filter({listed(parts)}, lambda p: starts_with({text}, p))) > 0"


def _source(values: list[str], name: str, rows: str = "SELECT text FROM conversations WHERE text IS NOT NULL") -> str:
    return f"(SELECT DISTINCT text AS {name} FROM ({rows} UNION ALL SELECT unnest({listed(values)})))"


LABELS_SQL = _source(LABELS, "label")
WORDS = r"list_filter(regexp_split_to_array(label, '\s+'), lambda w: w <> '')"
DIGIT = "regexp_matches(label, '[0-9]')"
ACTION_CASES = " ".join(f"WHEN {_any('lower(action)', w)} THEN '{n}'" for n, w in ops.ACTION_WORDS.items())
TAG_CASES = " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in ops.SELECTOR_TAGS.items())
ROLE_CASES = " ".join(f"WHEN '{r}' THEN {TREE_PRIORITY.get(r, 0.2)}" for r in ROLES)
GOAL_WORDS = GOAL.split()
LOW = "translate(label, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
FORM_ROWS = ", ".join(f"({p}, {n}, " + ", ".join(map(quoted, rest)) + ")" for p, n, *rest in FORMS)


def _fits(words_: dict[str, tuple[str, ...]]) -> str:
    return "(" + " OR ".join(_any(f"lower({c})", w) for c, w in words_.items()) + ")"


def first_chunks(spark: SparkSession, sf: str, size: int = 10, least: float = 0.3) -> DataFrame:
    """What is sent of each conversation first: the best turns that reach the threshold, or that act or lead on whatever their score."""
    role = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("conv_id") + F.col("turn")) % len(ROLES) + 1).cast("int"))
    rows = stream_relevance(spark, sf).select("conv_id", "turn", F.col("decided").alias("score"), role.alias("role"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    passing = rows.filter((F.col("score") >= least) | (F.col("role") != "price"))
    return passing.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= size).select("conv_id", "place", "turn", "score")


QUERIES = {
    f.__name__: f
    for f in (
        label_artifacts, label_kinds, script_labels, label_truncate, internal_keys, action_types, selector_hints, set_cookies,
        login_forms, input_kinds, learned_edge_weights, stream_relevance, first_chunks,
    )
}
_PICK = "{}[(conv_id + turn) % {} + 1]"
AS_NODES = f"""SELECT conv_id, turn, {_PICK.format(listed(ROLES), len(ROLES))} AS role, {_PICK.format(listed(FORM_ROLES), len(FORM_ROLES))} AS form_role,
    coalesce(text, '') AS label, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'n' || turn END AS html_id, CASE WHEN (conv_id + turn) % 5 = 1 THEN 'field' END AS name,
    {_PICK.format(listed(FORM_NAMES), len(FORM_NAMES))} AS form_name FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL"""
ORACLE = {
    "label_artifacts": rf"""
SELECT label, contains(label, '{{{{') OR contains(label, 'translations.messages') OR {_starts('lower(label)', ops.TEMPLATE_HEADS)}
  OR (NOT contains(label, ' ') AND length(label) - length(replace(label, '.', '')) >= 2 AND strlen(label) < 200 AND NOT contains(label, '://')
    AND NOT regexp_matches(label, '^[0-9]') AND regexp_matches(label, '[A-Z\[]|(true|false|null)$'))
  OR (starts_with(label, '{{') AND ends_with(label, '}}') AND strlen(label) < 50 AND NOT contains(label, ' ')) AS template,
  ({_starts('lower(label)', ops.META_HEADS)} AND {_any('lower(label)', ops.META_PARTS)}) OR (strlen(t) BETWEEN 1 AND 20 AND
    (regexp_matches(t, '^[0-9,.]+$') OR (strlen(t) < 8 AND regexp_matches(t, '^[0-9]*\s*/\s*[0-9]*$')))) AS numeric
FROM (SELECT label, regexp_replace(label, '^\s+|\s+$', '', 'g') AS t FROM {LABELS_SQL})""",
    "label_kinds": rf"""
SELECT label, strlen(label) BETWEEN 20 AND 200 AND NOT {DIGIT} AND NOT regexp_matches(label, '[%$£€]') AND len(ws) >= 4
    AND len(list_filter(ws, lambda w: regexp_matches(w, '^\p{{Lu}}'))) / len(ws) > 0.5 AS headline,
  len(ws) BETWEEN 3 AND 30 AND len(list_filter(ws, lambda w: strlen(w) <= 15 AND regexp_matches(w, '^\p{{Lu}}') AND NOT regexp_matches(w, '[.,]'))) / len(ws) > 0.7
    AND NOT contains(label, '. ') AND NOT {DIGIT} AS nav_list,
  strlen(label) > 60 OR {DIGIT} OR contains(label, '. ') OR contains(label, ', ') AS informational
FROM (SELECT label, {WORDS} AS ws FROM {LABELS_SQL})""",
    "script_labels": f"""SELECT label, strlen(label) >= 20
  AND len(list_filter({listed(ops.SCRIPT_SIGNS)}, lambda s: contains(lower(label), s))) >= 2 AS script FROM {LABELS_SQL}""",
    "label_truncate": f"""SELECT label, CASE WHEN strlen(label) <= {SIZE} THEN label ELSE
  label[1:list_max(list_filter(range(0, {SIZE} + 1), lambda k: strlen(left(label, k)) <= {SIZE}))] || '…' END AS short FROM {LABELS_SQL}""",
    "internal_keys": f"""
SELECT key, {_any('key', ops.INTERNAL_PARTS)} OR list_contains({listed(ops.INTERNAL_LAST)}, last) OR {_any('lower(key)', ops.INTERNAL_REGIONS)}
  OR (ends_with(last, 'id') AND len(string_split(key, '.')) > 2) AS internal
FROM (SELECT key, lower(string_split(key, '.')[-1]) AS last FROM {_source(KEYS, "key",
    "SELECT event_type || '.' || unnest(json_keys(props)) AS text FROM events WHERE props IS NOT NULL")})""",
    "action_types": f"""SELECT CASE {ACTION_CASES} ELSE 'navigate' END AS type, count(*) AS n, min(action) AS first_action
FROM {_source(ACTIONS, "action")} GROUP BY 1""",
    "selector_hints": f"""
SELECT *, CASE WHEN html_id IS NOT NULL THEN tag || '#' || html_id
  WHEN label <> '' THEN tag || '[aria-label=''' || replace(label, '''', '\\''') || ''']'
  WHEN name IS NOT NULL THEN tag || '[name=''' || replace(name, '''', '\\''') || ''']' ELSE tag END AS selector
FROM (SELECT role, html_id, label, name FROM (SELECT unnest({listed(ROLES)}) AS role), (SELECT unnest(['main', NULL]) AS html_id),
    (SELECT unnest(['It''s on', '']) AS label), (SELECT unnest(['q''1', NULL]) AS name) UNION SELECT role, html_id, label, name FROM ({AS_NODES})),
  LATERAL (SELECT CASE role {TAG_CASES} ELSE '*' END AS tag)""".replace("SELECT *, CASE", "SELECT role, html_id, label, name, CASE").replace("\\\\", "\\"),
    "set_cookies": f"""
WITH h AS (SELECT unnest({listed(HEADERS)}) AS header UNION ALL
  SELECT event_type || '=' || user_id || '; Path=/' || event_type || '; Max-Age=' || min(event_id) || CASE WHEN user_id % 2 = 0 THEN '; Secure' ELSE '' END
    || CASE WHEN min(event_id) % 3 = 0 THEN '; HttpOnly' ELSE '' END FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY event_type, user_id),
p AS (SELECT header, trim(string_split(header, ';')[1]) AS f, [lower(trim(x)) FOR x IN string_split(header, ';')[2:]] AS attrs FROM h)
SELECT header, trim(left(f, instr(f, '=') - 1)) AS name, trim(substr(f, instr(f, '=') + 1)) AS value,
  coalesce(list_filter(attrs, lambda a: starts_with(a, 'path='))[-1][6:], '/') AS path,
  (coalesce(list_filter(attrs, lambda a: regexp_matches(a, '^max-age=[0-9]+$'))[-1][9:], '0')::BIGINT * 1000) AS expires_ms,
  list_contains(attrs, 'httponly') AS http_only, list_contains(attrs, 'secure') AS secure
FROM p WHERE instr(f, '=') > 0 AND trim(left(f, instr(f, '=') - 1)) <> ''""",
    "login_forms": f"""
SELECT page::BIGINT AS page, (max(node) FILTER (WHERE role IN ('textbox', 'searchbox') AND {_fits(ops.LOGIN_USER)}))::BIGINT AS username,
  (max(node) FILTER (WHERE role = 'textbox' AND {_fits(ops.LOGIN_PASS)}))::BIGINT AS password,
  (max(node) FILTER (WHERE role = 'button' AND {_any('lower(label)', ops.LOGIN_SUBMIT)}))::BIGINT AS submit
FROM (SELECT -page AS page, node, role, label, name, html_id FROM (VALUES {FORM_ROWS}) t(page, node, role, label, name, html_id)
  UNION ALL SELECT conv_id, turn, form_role, label, form_name, coalesce(html_id, '') FROM ({AS_NODES})) GROUP BY 1 HAVING username IS NOT NULL AND password IS NOT NULL""",
    "input_kinds": """
SELECT given, CASE WHEN given & 1 > 0 THEN 'screenshot' WHEN given & 2 > 0 AND coalesce(url, '') <> '' THEN 'url'
  WHEN given & 4 > 0 AND coalesce(html, '') <> '' THEN 'html' ELSE 'none' END AS kind, count(*) AS pages
FROM (SELECT url, html, unnest(range(0, 8)) AS given FROM pages) GROUP BY 1, 2""",
    "learned_edge_weights": """
WITH r AS (SELECT event_type || ':' || (user_id % 5) AS base, event_type || ':' || (user_id % 5) || ':' || (hour(ts) % 4) AS key, value - 50 AS gain FROM events),
k AS (SELECT key, any_value(base) AS base, sum(greatest(gain, 0.0)) AS up, sum(least(gain, 0.0)) AS down FROM r GROUP BY key),
b AS (SELECT base, sum(greatest(gain, 0.0)) AS up, sum(least(gain, 0.0)) AS down FROM r GROUP BY base),
w AS (SELECT key, CASE WHEN right(key, 1) = '3' THEN b.up ELSE k.up END AS up, abs(CASE WHEN right(key, 1) = '3' THEN b.down ELSE k.down END) AS down
  FROM k JOIN b USING (base))
SELECT key, round(CASE WHEN up + down < 0.001 THEN 0.6 ELSE 0.6 * (0.5 + up / (up + down + 1.0) * 1.3) END, 6)::DOUBLE AS weight FROM w""",
    "stream_relevance": f"""
WITH n AS (SELECT conv_id, turn, coalesce(text, '') AS label, {listed(ROLES)}[(conv_id + turn) % {len(ROLES)} + 1] AS role FROM conversations),
s AS (SELECT *, {LOW} AS low, len(list_filter({listed(GOAL_WORDS)}, lambda w: contains({LOW}, w)))::DOUBLE AS hits FROM n),
v AS (SELECT *, CASE WHEN contains(low, '{GOAL}') OR hits = {len(GOAL_WORDS)} THEN 1.0 WHEN hits = 0 AND strlen(low) >= {len(GOAL)}
    AND contains(regexp_replace(low, '[ \\t\\n\\f\\r_-]', '', 'g'), '{"".join(GOAL_WORDS)}') THEN 1.0 ELSE hits / {len(GOAL_WORDS)} END::DOUBLE AS likeness,
  (CASE role {ROLE_CASES} END)::DOUBLE AS weight, CASE WHEN regexp_matches(low, '^(gå till|gå direkt|skip to|jump to)') THEN 0.25
    WHEN role IN ('button', 'cta') AND regexp_matches(low, 'cookie|jag förstår|i understand|accept all|godkänn') THEN 0.2
    WHEN role IN ('button', 'cta') AND low IN ('meny', 'menu', '☰') THEN 0.15 ELSE 0.0 END::DOUBLE AS nav,
  CASE WHEN strlen(label) > 500 THEN 0.15 WHEN strlen(label) > 300 THEN 0.08 ELSE 0.0 END::DOUBLE AS long FROM s)
SELECT conv_id, turn, round(greatest(0.0, least(1.0, likeness * 0.5 + weight * 0.4 - least(turn * 0.05::DOUBLE, 0.4))), 6)::DOUBLE AS met,
  round(greatest(0.0, least(1.0, likeness * 0.55 + weight * 0.35 - long - nav)), 6)::DOUBLE AS decided FROM v""",
}
ORACLE["first_chunks"] = f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY decided DESC, turn) AS place, turn, decided AS score
FROM ({ORACLE["stream_relevance"]}) WHERE decided >= 0.3 OR {listed(ROLES)}[(conv_id + turn) % {len(ROLES)} + 1] <> 'price' QUALIFY place <= 10"""
