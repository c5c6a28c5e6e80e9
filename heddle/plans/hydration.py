"""Queries over the state that web frameworks leave in a page: which framework, and the entries of its JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import field as entries
from heddle.functions.embedded import FLIGHT, NAMES, assigned, first_of
from heddle.functions.labels import internal_key
from heddle.plans.safety import listed, quoted
from heddle.sources.tables import table, written

# A page without any of these marks holds no state.
MARKS = (
    "__NEXT_DATA__", "__NUXT__", "__remixContext", "__GATSBY", "__APOLLO_STATE__", 'type="application/json"', "q:container", "data-astro",
)
BY_ID = r'(?s)id="{}"[^>]*>\s*(.*?)\s*</script>'
BY_NAME = "window.{}"
# Frameworks in their order, where their state stands, and the part of it that counts (else all).
FRAMEWORKS = [
    ("NextJs", BY_ID.format("__NEXT_DATA__"), "$.props.pageProps"),
    ("NextFlight", FLIGHT, None),
    ("Nuxt", BY_ID.format("__NUXT_DATA__"), None),
    ("Nuxt", BY_NAME.format("__NUXT__"), None),
    ("Angular", BY_ID.format("ng-state"), None),
    ("Remix", BY_NAME.format("__remixContext"), "$.state.loaderData"),
    ("Gatsby", BY_ID.format("___gatsby-initial-props"), None),
    ("Gatsby", BY_ID.format("__gatsby-initial-props"), None),
    ("SvelteKit", BY_ID.format("__sveltekit_data"), None),
    ("Qwik", r'(?s)type="qwik/json"[^>]*>\s*(.*?)\s*</script>', None),
    ("Astro", r'<astro-island[^>]*?props="([^"]*)"', None),
    ("Apollo", BY_NAME.format("__APOLLO_STATE__"), None),
]
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
#: Frameworks whose state may be a list of references, and the handlers that one names in attributes.
CODED = ("Nuxt", "SvelteKit")
HANDLER = r"""on:([^\s=]{1,30})\s*=\s*(?:"([^"]+)"|'([^']+)')"""
DEPTH = 32
JSON = '<script id="{}" type="application/json"> {} </script>'
PAGES = [
    JSON.format("__NEXT_DATA__", '{"props": {"pageProps": {"title": "News", "n": 3, "tags": ["a", "b", {"x": [true, null]}], "none": {}}}, "page": "/"}'),
    JSON.format("__NEXT_DATA__", '{"page": "/only", "props": {"other": 1}}'),
    JSON.format("__NEXT_DATA__", "{broken") + JSON.format("ng-state", '{"user": {"name": "Ada", "buildId": "q1"}}'),
    '<script>window.__NUXT__={"data":[{"price":9.5,"url":"/a"}],"on":false};</script>',
    JSON.format("__NUXT_DATA__", '{"plain": "yes"}') + '<script>window.__NUXT__={"data":1}</script>',
    '<script>window.__remixContext = {"state": {"loaderData": {"root": {"headline": "Hi there"}}}};</script>',
    '<script>window.__remixContext = {"state": {"x": "y"}};</script>',
    JSON.format("___gatsby-initial-props", '{"a": {"b": {"c": {"d": "deep"}}}}'),
    JSON.format("__sveltekit_data", '{"body": "text", "list": [[1, 2], [3]]}'),
    '<div data-astro-x></div><astro-island uid="1" props="{&quot;q&quot;:&quot;a &amp;lt; b&quot;}"></astro-island>',
    '<script>window.__APOLLO_STATE__ = {"Item:1": {"id": 7}};</script>',
    '<script>window.__APOLLO_STATE__ = {"a": "}; </b> { [", "b": {"c": "\\\\"}}; window.__remixContext={"state":{"loaderData":{"r":[1,{"k":"]"}]}}};run()</script>',
    '<script>var x = {}; window.__NUXT__={"a":[{"b":{"c":[1,2]}}]};window.other={"d":1}; go();</script>',
    '<b __NUXT__></b><script>self.__next_f.push([0])</script><script>self.__next_f.push([1,"1:{\\"title\\":\\"Old\\",\\"n\\":1}\\n2:T:[1,"])</script>'
    '<script>self.__next_f.push([1,"{\\"x\\":\\"y]\\"}]\\n{\\"title\\":\\"New\\"}\\nplain line\\n7:\\"text\\"\\n"]);self.__next_f.push([2,null])</script>',
    '<b __NUXT__></b><script>self.__next_f.push([1,"no records"])</script>', '<b __NUXT__></b><script>self.__next_f.push([1,"cut</script>',
    JSON.format("__NUXT_DATA__", '[["ref"], {"when": "Date:2024-05-01", "big": "BigInt:12", "gone": "undefined", "list": ["-0", "NaN", 3]}]'),
    JSON.format("__NUXT_DATA__", '[{"r": 1}, {"a": "x"}, "Date:2020", [true]]'), JSON.format("__NUXT_DATA__", "[[1]]"),
    JSON.format("__sveltekit_data", '{"type": "data", "nodes": [null, {"type": "skip"}, {"data": [{"r": 0}, {"post": {"title": "T"}}]}]}'),
    JSON.format("__sveltekit_data", '{"nodes": [{"data": {"plain": 1}}]}'),
    """<html q:container="paused"><a on:click="./m.js#go" on:input='./n.js#set' on:x=y>b</a><script type="qwik/json">{"ctx": {"a": [1]}}</script></html>""",
    '<html q:container><script type="qwik/json">[1, "two"]</script><i on:click="h"></i></html>',
    '<script id="ng-state">{"a": "no mark on the page"}</script>', JSON.format("other", '{"a": 1}'), "", "__NEXT_DATA__",
]


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    planted = spark.range(1).select(F.posexplode(F.array(*map(F.lit, PAGES))).alias("i", "html"))
    planted = planted.select((-1 - F.col("i")).cast("long").alias("page_id"), "html")
    rows = table(spark, sf, "pages").select("page_id", "html").unionAll(planted)
    return rows.filter(entries.contains_any(F.col("html"), MARKS))


def _plain(text: Column) -> Column:
    for mark, sign in ENTITIES:
        text = F.replace(text, F.lit(mark), F.lit(sign))
    return text


def _decoded(state: Column) -> Column:
    """What a coded state holds: the data of the first node that has some, else the state."""
    nodes = F.try_variant_get(state, "$.nodes", "array<variant>")
    data = F.filter(F.transform(nodes, lambda n: F.try_variant_get(n, "$.data", "variant")), lambda d: d.isNotNull())
    return F.coalesce(F.get(data, F.lit(0)), state)


def hydration_state(pages: DataFrame) -> DataFrame:
    """(page_id, framework, key, state): the first framework whose state is valid JSON, as a variant; other pages give no row.

    A state that is assigned to a name ends where it balances. Chunks of a flight are joined in their order, and each line of them that is or holds
    JSON is a record: the keys of objects, the last of each counting, and numbered others; without any the text itself is the state.
    """
    rows = pages.withColumn("found", assigned(F.col("html")))
    chunks = F.transform(F.filter("found", lambda x: x["mark"] == FLIGHT), lambda x: F.try_parse_json(x["json"]))
    second = F.transform(chunks, lambda v: F.try_variant_get(v, "$[1]", "variant"))
    texts = F.transform(F.filter(second, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    flight = F.when(F.size(texts) > 0, F.array_join(texts, ""))
    found = []
    for name, pattern, part in FRAMEWORKS:
        if pattern == FLIGHT:
            state = F.try_parse_json(F.to_json(F.struct(flight.alias("text"))))
            found.append(F.when(flight.isNotNull(), F.struct(F.lit(name).alias("framework"), state.alias("state"))))
            continue
        named = pattern.removeprefix("window.")
        text = first_of(F.col("found"), named) if named in NAMES else F.nullif(F.regexp_extract("html", pattern, 1), F.lit(""))
        state = F.try_parse_json(_plain(text) if name == "Astro" else text)
        inner = F.coalesce(F.try_variant_get(state, part, "variant"), state) if part else _decoded(state) if name in CODED else state
        found.append(F.when(state.isNotNull(), F.struct(F.lit(name).alias("framework"), inner.alias("state"))))
    first = rows.select("page_id", F.coalesce(*found).alias("s")).filter("s IS NOT NULL").select("page_id", "s.framework", "s.state")
    plain = first.filter("framework <> 'NextFlight'").select("page_id", "framework", F.lit("").alias("key"), "state")
    return plain.unionAll(_records(first.filter("framework = 'NextFlight'")))


def _records(flights: DataFrame) -> DataFrame:
    """The records of flights (state: an object with their text)."""
    text = F.try_variant_get("state", "$.text", "string")
    lines = flights.select("page_id", text.alias("text"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    after = F.regexp_replace(F.regexp_replace("line", "^[^:]*:", ""), "^.:", "")
    value = F.coalesce(F.try_parse_json("line"), F.when(F.contains("line", F.lit(":")), F.try_parse_json(after)))
    read = lines.withColumn("value", F.when(F.col("line") != "", value))
    single = ~F.startswith(F.schema_of_variant("value"), F.lit("OBJECT"))
    order = Window.partitionBy("page_id").orderBy("pos")  # the lines of one page
    read = read.withColumn("single", single).withColumn("n", F.sum(F.coalesce(F.col("single").cast("int"), F.lit(0))).over(order) - 1)
    inner = flights.sparkSession.tvf.variant_explode_outer(F.when(~F.col("single"), F.col("value")).outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    rows = read.filter("value IS NOT NULL").lateralJoin(inner).filter("single OR _key IS NOT NULL")
    key = F.when(F.col("single"), F.concat(F.lit("_rsc_"), F.col("n"))).otherwise(F.col("_key"))
    rows = rows.select("page_id", "pos", key.alias("key"), F.when(F.col("single"), F.col("value")).otherwise(F.col("_value")).alias("state"))
    kept = rows.groupBy("page_id", "key").agg(F.max_by("state", "pos").alias("state"))
    none = lines.filter("pos = 0").join(rows.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit("").alias("key"), F.try_variant_get(F.try_parse_json(F.to_json(F.struct("text"))), "$.text", "variant").alias("state"))
    return kept.unionAll(none).select("page_id", F.lit("NextFlight").alias("framework"), "key", "state")


def flatten(states: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(page_id, framework, key, value): every value by its path, a.b[0].c; objects and lists beyond ``depth`` stay JSON text, empty ones give no row.

    A pass opens one level of what is still nested, in its own row and without a shuffle; there are as many passes as the deepest state has levels.
    """
    tvf, names = states.sparkSession.tvf, ["page_id", "framework", "key"]
    nested = F.regexp_like(F.schema_of_variant("value"), F.lit("^(OBJECT|ARRAY)"))
    rows, done = states.select(*names, F.col("state").alias("value")), []
    for _ in range(depth):
        rows = written(rows.withColumn("open", nested), "entries")
        done.append(rows.filter("NOT open").drop("open"))
        if not rows.filter("open").limit(1).count():
            break
        inner = tvf.variant_explode(F.col("value").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
        dot = F.when(F.col("key") == "", "").otherwise(".")
        name = F.when(F.col("_key").isNotNull(), F.concat("key", dot, "_key")).otherwise(F.concat("key", F.lit("["), "_pos", F.lit("]")))
        rows = rows.filter("open").lateralJoin(inner).select("page_id", "framework", name.alias("key"), F.col("_value").alias("value"))
    else:
        done.append(rows)
    text = F.when(nested, F.to_json("value")).when(F.is_variant_null("value"), "null").otherwise(F.try_variant_get("value", "$", "string"))
    return reduce(DataFrame.unionAll, done).select(*names, text.alias("value"))


def references(entries_: DataFrame, states: DataFrame) -> DataFrame:
    """Entries of states that are lists of references by the values they refer to: the list's head goes, a single value stands for the list,
    dates and big numbers lose or get their mark.
    """
    first = F.schema_of_variant(F.try_variant_get("state", "$[0]", "variant"))
    size = F.size(F.try_variant_get("state", "$", "array<variant>"))
    coded = states.filter(F.col("framework").isin(*CODED) & F.regexp_like(first, F.lit("^(OBJECT|ARRAY)"))).select("page_id", size.alias("_size"))
    rows = entries_.join(coded, "page_id", "left").filter(F.col("_size").isNull() | ~F.startswith("key", F.lit("[0]")))
    alone = F.regexp_replace("key", r"^\[1\]\.?", "")
    key = F.when(F.col("_size") == 2, alone).when(F.col("_size").isNotNull(), F.regexp_replace("key", r"^\[([0-9]+)\]", "_$1")).otherwise(F.col("key"))
    v = F.col("value")
    plain = (
        F.when(F.startswith(v, F.lit("Date:")), F.substring(v, 6, 1 << 30))
        .when(F.startswith(v, F.lit("BigInt:")), F.concat(F.substring(v, 8, 1 << 30), F.lit("n")))
        .when(v == "undefined", "null")
        .when(v == "-0", "0")
        .otherwise(v)
    )
    return rows.select("page_id", "framework", key.alias("key"), F.when(F.col("_size").isNotNull(), plain).otherwise(v).alias("value"))


def _handlers(pages: DataFrame, states: DataFrame) -> DataFrame:
    """The handlers that attributes name on pages whose state is an object that resumes, as entries."""
    asked = states.filter((F.col("framework") == "Qwik") & F.startswith(F.schema_of_variant("state"), F.lit("OBJECT"))).select("page_id")
    all_ = lambda k: F.regexp_extract_all("html", F.lit(HANDLER), F.lit(k))
    both = F.zip_with(all_(2), all_(3), lambda a, b: F.concat(a, b))
    rows = pages.join(asked, "page_id").select("page_id", F.posexplode(F.arrays_zip(all_(1).alias("event"), both.alias("handler"))).alias("i", "x"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"x.{c}").alias("value")) for c in ("event", "handler")))).alias("e")
    rows = rows.select("page_id", "i", each)
    return rows.select("page_id", F.lit("Qwik").alias("framework"), F.concat(F.lit("_qrl_handlers["), "i", F.lit("]."), "e.c").alias("key"), "e.value")


def hydration_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of each page's state by its path."""
    pages = _pages(spark, sf)
    states = written(hydration_state(pages), "states")
    return references(flatten(states), states).unionAll(_handlers(pages, states))


def hydration_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Entries as nodes with role and relevance to a goal; internal keys are left out."""
    key, value = F.col("key"), F.col("value")
    rows = hydration_entries(spark, sf).filter(~internal_key(key))
    score = F.round(entries.entry_relevance(key, value, F.lit("latest prices of news")), 6)
    role = entries.entry_role(key, value)
    return rows.select("page_id", "framework", key.alias("name"), value.alias("value"), role.alias("role"), score.alias("relevance"))


def _balanced_sql(rest: str, ends: str = "'}', ']'") -> str:
    """The first beginning of a text that ends with a bracket and is JSON."""
    return f"list_filter(list_transform(list_filter(range(1, length({rest}) + 1), lambda k: substr({rest}, k, 1) IN ({ends})), lambda k: left({rest}, k)), lambda t: json_valid(t))[1]"


def _state_sql(name: str, pattern: str, part: str | None) -> str:
    if pattern == FLIGHT:
        return "CASE WHEN flight IS NOT NULL THEN {'framework': 'NextFlight', 'state': to_json(flight)} END"
    named = pattern.removeprefix("window.")
    if named in NAMES:
        text = _balanced_sql(f"regexp_extract(html, '(?s)window\\.{named}\\s*=\\s*([\\[{{].*)$', 1)")
    else:
        text = f"nullif(regexp_extract(html, {quoted(pattern)}, 1), '')"
    for mark, sign in ENTITIES if name == "Astro" else ():
        text = f"replace({text}, {quoted(mark)}, {quoted(sign)})"
    state = f"CASE WHEN json_valid({text}) THEN {text}::JSON END"
    inner = f"coalesce(json_extract({state}, {quoted(part)}), {state})" if part else state
    if name in CODED:
        inner = f"coalesce(list_filter(json_extract({state}, '$.nodes[*].data'), lambda d: d IS NOT NULL)[1], {state})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'framework': {quoted(name)}, 'state': {inner}}} END"


QUERIES = {f.__name__: f for f in (hydration_entries, hydration_nodes)}
#: Roles and internal keys have their SQL in other queries.
ORACLE = {
    "hydration_entries": f"""
WITH p AS (SELECT page_id, html FROM pages UNION ALL SELECT -unnest(range(1, {len(PAGES) + 1})), unnest({listed(PAGES)})),
m AS (SELECT * FROM p WHERE {" OR ".join(f"contains(html, {quoted(x)})" for x in MARKS)}),
c AS (SELECT *, list_filter(list_transform(list_transform(string_split(html, '{FLIGHT}')[2:], lambda x: {_balanced_sql("ltrim(x)", "']'")}),
    lambda t: CASE WHEN json_type(t, '$[1]') = 'VARCHAR' THEN t ->> '$[1]' END), lambda t: t IS NOT NULL) AS chunks FROM m),
d AS (SELECT page_id, html, CASE WHEN len(chunks) > 0 THEN array_to_string(chunks, '') END AS flight FROM c),
s AS (SELECT page_id, html, coalesce({", ".join(_state_sql(*f) for f in FRAMEWORKS)}) AS s FROM d),
f AS MATERIALIZED (SELECT page_id, html, s.framework AS framework, s.state AS state FROM s WHERE s IS NOT NULL),
l AS (SELECT page_id, unnest(range(len(ls))) AS pos, trim(unnest(ls)) AS line FROM (SELECT page_id, string_split(state ->> '$', chr(10)) AS ls FROM f WHERE framework = 'NextFlight')),
r AS (SELECT page_id, pos, CASE WHEN json_valid(line) THEN line WHEN contains(line, ':') AND json_valid(rest) THEN rest END::JSON AS v
  FROM (SELECT *, regexp_replace(regexp_replace(line, '^[^:]*:', ''), '^.:', '') AS rest FROM l WHERE line <> '')),
g AS (SELECT page_id, pos, k AS key, json_extract(v, '$."' || k || '"') AS v FROM (SELECT page_id, pos, v, unnest(json_keys(v)) AS k FROM r WHERE json_type(v) = 'OBJECT')
  UNION ALL SELECT page_id, pos, '_rsc_' || (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1), v FROM r WHERE json_type(v) <> 'OBJECT'),
w AS (SELECT page_id, 'NextFlight' AS framework, key, v AS state FROM g QUALIFY row_number() OVER (PARTITION BY page_id, key ORDER BY pos DESC) = 1
  UNION ALL SELECT page_id, framework, '', state FROM f WHERE framework <> 'NextFlight' OR page_id NOT IN (SELECT page_id FROM g)),
e AS (SELECT w.page_id, w.framework, w.key || regexp_replace(replace(t.fullkey, '"', ''), CASE WHEN w.key = '' THEN '^\\$\\.?' ELSE '^\\$' END, '') AS key,
    CASE WHEN t.type = 'NULL' THEN 'null' ELSE t.atom ->> '$' END AS value,
    CASE WHEN w.framework IN {CODED} AND json_type(w.state) = 'ARRAY' AND json_type(w.state, '$[0]') IN ('ARRAY', 'OBJECT') THEN json_array_length(w.state) END AS size
  FROM w, json_tree(w.state) t WHERE t.type NOT IN ('OBJECT', 'ARRAY'))
SELECT page_id, framework, CASE WHEN size = 2 THEN regexp_replace(key, '^\\[1\\]\\.?', '') WHEN size IS NOT NULL THEN regexp_replace(key, '^\\[([0-9]+)\\]', '_\\1') ELSE key END AS key,
  CASE WHEN size IS NULL THEN value WHEN starts_with(value, 'Date:') THEN value[6:] WHEN starts_with(value, 'BigInt:') THEN value[8:] || 'n'
    WHEN value = 'undefined' THEN 'null' WHEN value = '-0' THEN '0' ELSE value END AS value
FROM e WHERE size IS NULL OR NOT starts_with(key, '[0]')
UNION ALL
SELECT page_id, 'Qwik', '_qrl_handlers[' || i || '].' || unnest(['event', 'handler']), unnest([es[i + 1], hs[i + 1]])
FROM (SELECT page_id, es, hs, unnest(range(len(es))) AS i FROM (
  SELECT page_id, regexp_extract_all(html, {quoted(HANDLER)}, 1) AS es,
    list_transform(list_zip(regexp_extract_all(html, {quoted(HANDLER)}, 2), regexp_extract_all(html, {quoted(HANDLER)}, 3)), lambda z: coalesce(z[1], '') || coalesce(z[2], '')) AS hs
  FROM f WHERE framework = 'Qwik' AND json_type(state) = 'OBJECT'))""",
}
