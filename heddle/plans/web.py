"""Queries over page URLs and raw HTML by built-in expressions: firewall, domains, links, scripts, heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import urls as ops
from heddle.plans.safety import listed, quoted
from heddle.sources.tables import table

GOAL = "find product news"
#: Requests that reach every level of the firewall, every relative form and every guarded address.
REQUESTS = [
    "https://www.google-analytics.com/collect", "https://notdrift.com/a", "https://cdn.drift.com/x.js",
    "http://shop.example.com/Tracking/1", "https://example.com/logo.PNG?v=1", "https://example.com/font/a",
    "https://example.com/news/1", "ftp://example.com/file", "http://localhost:8080/x", "http://10.1.2.3/",
    "http://172.20.0.1/", "http://172.32.0.1/", "https://169.254.169.254/latest", "",
]
#: Media types by ending, and more of them as headers give them.
ENDINGS = {
    "png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "css": "text/css", "js": "text/javascript",
    "json": "application/json", "pdf": "application/pdf", "zip": "application/zip", "woff2": "font/woff2", "mp4": "video/mp4", "mp3": "audio/mpeg",
}
KINDS = ["image/png", "TEXT/html", "Application/PDF", "application/json", "font/woff2", "application/octet-stream"]
HREFS = ["https://a.b/c", "//cdn.x/y", "/abs?q=1", "#top", "?page=2", "rel/path", "../up", "", "mailto:a@b.c", " /sp "]
BASES = ["https://site.org/dir/page.html?x=1#f", "http://site.org", "site.org/a/b"]
# Seconds that pages stay cached, by what their address holds; the first line that fits.
TTL = (
    (600, ("wikipedia.org", "britannica.com", "docs.rs")),
    (300, (".gov", "riksdagen.se")),
    (30, ("news", "reuters", "bbc.com", "cnn.com")),
    (60, ("worldpopulationreview", "premierleague", "npmjs.com")),
)
#: An address of each class, and two where the order decides.
CACHED = [
    "https://en.wikipedia.org/wiki/News", "https://docs.rs/serde", "https://www.weather.gov/news", "https://www.riksdagen.se/",
    "https://www.REUTERS.com/", "https://www.bbc.com/sport", "https://www.premierleague.com/tables", "https://www.npmjs.com/package/x",
]
LINK = r'<a\s[^>]*href="([^"]*)"[^>]*>'
SCRIPT = r"<script([^>]*)>"
HANDLER = r"\son(click|load|submit|change|input|keydown|keyup|mouseover|focus|blur)\s*="


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.range(1).select(F.explode(F.array(*map(F.lit, REQUESTS))).alias("url"))
    return table(spark, sf, "pages").select("url").unionAll(extra)


def _level(rows: DataFrame) -> DataFrame:
    goal = F.lit(GOAL)
    return rows.withColumn("level", ops.firewall_level(F.col("url"), goal)).withColumn(
        "relevance", F.round(ops.url_relevance(F.col("url"), goal), 6)
    )


def firewall_classify_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _level(_urls(spark, sf)).select("url", "level", "relevance")


def firewall_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = _level(_urls(spark, sf))
    counts = [F.count_if(F.col("level") == x).alias(x) for x in ("allow", "l1", "l2", "l3")]
    return found.agg(F.count("*").alias("total"), *counts).withColumn(
        "saved_pct", F.round(F.lit(100.0) * (F.col("total") - F.col("allow")) / F.col("total"), 6)
    )


def url_domain_rollup(spark: SparkSession, sf: str) -> DataFrame:
    at = ops.domain(F.col("url"))
    return _urls(spark, sf).groupBy(at.alias("domain")).agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


def url_resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every form of a reference on each page's address and on the planted bases."""
    planted = spark.range(1).select(F.explode(F.array(*map(F.lit, BASES))).alias("base"))
    bases = table(spark, sf, "pages").filter("url IS NOT NULL").select(F.col("url").alias("base")).unionAll(planted).distinct()
    rows = bases.select(F.explode(F.array(*map(F.lit, HREFS))).alias("href"), "base")
    return rows.select("href", "base", ops.resolve(F.col("href"), F.col("base")).alias("url"))


def ssrf_guard(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select("url", ops.unsafe_target(F.col("url")).alias("blocked"))


def _media_type(url: Column) -> Column:
    """The media type that an address promises by its ending."""
    end = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    known = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, end), F.lit("text/html"))


def blocked_media(spark: SparkSession, sf: str) -> DataFrame:
    """Media types of the requested addresses and the planted ones, with how many there are and whether they are blocked."""
    planted = spark.range(1).select(F.explode(F.array(*map(F.lit, KINDS))).alias("content_type"))
    rows = _urls(spark, sf).select(_media_type(F.col("url")).alias("content_type")).unionAll(planted)
    return rows.groupBy("content_type", ops.blocked_media(F.col("content_type")).alias("blocked")).agg(F.count("*").alias("n"))


def _first(pattern: str, at: str = "html") -> Column:
    return F.regexp_extract(F.coalesce(F.col(at), F.lit("")), pattern, 1)


def page_head(spark: SparkSession, sf: str) -> DataFrame:
    """Title, language and description of each page's head."""
    return table(spark, sf, "pages").select(
        "page_id",
        F.trim(_first("<title[^>]*>([^<]*)</title>")).alias("title"),
        _first('<html[^>]*lang="([^"]*)"').alias("lang"),
        _first('<meta[^>]*name="description"[^>]*content="([^"]*)"').alias("description"),
    )


def _links(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)
    rows = table(spark, sf, "pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return rows.select("page_id", "url", "pos", ops.resolve(F.col("href"), F.col("url")).alias("target"))


def extract_links_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The first occurrence of each absolute link on a page, with relevance to the goal."""
    once = _links(spark, sf).groupBy("page_id", "url", "target").agg(F.min("pos").cast("long").alias("pos"))
    return once.select(
        "page_id",
        "pos",
        "target",
        (ops.domain(F.col("target")) == ops.domain(F.col("url"))).alias("internal"),
        F.round(ops.url_relevance(F.col("target"), F.lit(GOAL)), 6).alias("relevance"),
    )


def link_internal_ratio(spark: SparkSession, sf: str) -> DataFrame:
    own = ops.domain(F.col("target")) == ops.domain(F.col("url"))
    return (
        _links(spark, sf)
        .groupBy("page_id")
        .agg(F.count("*").alias("links"), F.round(F.avg(own.cast("double")), 6).alias("internal"))
    )


def link_in_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Links from distinct pages to each target, ranked; ties go to the smaller target."""
    found = _links(spark, sf).groupBy("target").agg(F.count_distinct("page_id").alias("pages"))
    top = found.orderBy(F.desc("pages"), "target").limit(100)
    rank = F.row_number().over(Window.orderBy(F.desc("pages"), "target"))  # at most 100 rows
    return top.withColumn("rank", rank.cast("long"))


def js_snippet_counts(spark: SparkSession, sf: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(SCRIPT), 1)
    return table(spark, sf, "pages").select(
        "page_id",
        F.size(F.filter(tags, lambda t: ~F.contains(t, F.lit("src=")))).cast("long").alias("inline_scripts"),
        F.size(F.filter(tags, lambda t: F.contains(t, F.lit("src=")))).cast("long").alias("external_scripts"),
        F.size(F.regexp_extract_all(html, F.lit(HANDLER), 1)).cast("long").alias("handlers"),
    )


FETCH = r"""(?:fetch\(|\.open\(\s*["'][A-Z]+["']\s*,\s*|\$\.(?:get|post)\()\s*["']([^"'{}]+)["']"""
SNIPPETS = ["fetch('/api/a')", 'x.open("GET", "/b.json"); $.post("/c")', "fetch(`/t/${x}`)", "fetch('/u/{id}')", "none"]


def xhr_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs that scripts request: of literal snippets, and of every page."""
    extra = spark.range(1).select(F.posexplode(F.array(*map(F.lit, SNIPPETS))).alias("i", "html"))
    rows = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    both = rows.unionAll(extra.select((-1 - F.col("i")).cast("long"), "html"))
    return both.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(FETCH), 1)).alias("request"))


def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Opening tags by name over all pages."""
    tags = F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit("<([a-z][a-z0-9]*)[\\s>]"), 1)
    return table(spark, sf, "pages").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def page_ttl_class(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds that a page may stay cached, by its address."""
    low, ttl = F.lower("url"), None
    for seconds, parts in TTL:
        hit = F.regexp_like(low, F.lit(ops.alternatives(parts)))
        ttl = F.when(hit, seconds) if ttl is None else ttl.when(hit, seconds)
    extra = spark.range(1).select(F.explode(F.array(*map(F.lit, CACHED))).alias("url"))
    rows = _urls(spark, sf).unionAll(extra).select("url", ttl.otherwise(300).cast("long").alias("ttl_s"))
    return rows.groupBy("ttl_s").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


URLS = f"(SELECT url FROM pages UNION ALL SELECT unnest({listed(REQUESTS)}))"
HOST = "CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_extract(url, '^https?://([^/:]*)', 1)) END"
DOMAIN = "lower(regexp_replace(split_part(string_split({0}, '://')[-1], '/', 1), '^www\\.', ''))"
WORDS = GOAL.split()
TTL_CASES = " ".join(f"WHEN regexp_matches(lower(url), {quoted(ops.alternatives(p))}) THEN {s}" for s, p in TTL)


def relevance_sql(url: str) -> str:
    hits = " + ".join(f"contains(lower({url}), {quoted(w)})::INT" for w in WORDS)
    return (
        f"round(greatest(0.0, least(1.0, ({hits})::DOUBLE / {len(WORDS)} "
        f"+ CASE WHEN regexp_matches(lower({url}), {quoted(ops.alternatives(ops.RELEVANT))}) THEN 0.2 ELSE 0 END + 0.3 "
        f"- CASE WHEN regexp_matches(lower({url}), {quoted(ops.alternatives(ops.IRRELEVANT))}) THEN 0.5 ELSE 0 END)), 6)::DOUBLE"
    )


LEVELS = f"""
WITH u AS (SELECT url, {HOST} AS host, {relevance_sql("url")} AS relevance FROM {URLS}),
v AS (SELECT url, relevance, CASE
  WHEN host IS NOT NULL AND (regexp_matches(host, {quoted(ops.L1_HOST)}) OR regexp_matches(lower(url), {quoted(ops.L1_PATH)})) THEN 'l1'
  WHEN regexp_matches(lower(split_part(url, '?', 1)), {quoted(ops.L2_END)}) THEN 'l2'
  WHEN relevance < 0.1 THEN 'l3' ELSE 'allow' END AS level FROM u)
"""


def resolve_sql(href: str, base: str) -> str:
    h = f"trim({href}, ' ')"
    rest = f"regexp_replace(regexp_replace({base}, '^.*?://', ''), '[?#].*$', '')"
    site = (
        f"CASE WHEN contains({base}, '://') THEN split_part({base}, '://', 1) ELSE 'https' END || '://' "
        f"|| split_part({rest}, '/', 1)"
    )
    folder = f"regexp_replace(regexp_extract({rest}, '/.*$', 0), '/[^/]*$', '')"
    return f"""CASE WHEN {h} = '' OR regexp_matches({h}, '^(javascript:|mailto:|https?://)') THEN {h}
  WHEN starts_with({h}, '//') THEN CASE WHEN starts_with({base}, 'https://') THEN 'https:' ELSE 'http:' END || {h}
  WHEN starts_with({h}, '/') THEN {site} || {h}
  WHEN starts_with({h}, '#') THEN split_part({base}, '#', 1) || {h}
  WHEN starts_with({h}, '?') THEN split_part({base}, '?', 1) || {h}
  ELSE {site} || {folder} || '/' || {h} END"""


LINKS = f"""
WITH raw AS (SELECT page_id, url, unnest(range(len(hs))) AS pos, unnest(hs) AS href
  FROM (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), {quoted(LINK)}, 1) AS hs FROM pages)),
links AS (SELECT page_id, url, pos, {resolve_sql("href", "url")} AS target FROM raw)
"""

QUERIES = {
    f.__name__: f
    for f in (
        firewall_classify_pages, firewall_batch_summary, url_domain_rollup, url_resolve_links, ssrf_guard, blocked_media,
        page_head, extract_links_pages, link_internal_ratio, link_in_degree, js_snippet_counts, xhr_urls, tag_counts,
        page_ttl_class,
    )
}
ORACLE = {
    "firewall_classify_pages": LEVELS + "SELECT url, level, relevance FROM v",
    "firewall_batch_summary": LEVELS
    + """SELECT count(*) AS total, count(*) FILTER (WHERE level = 'allow') AS allow, count(*) FILTER (WHERE level = 'l1') AS l1,
  count(*) FILTER (WHERE level = 'l2') AS l2, count(*) FILTER (WHERE level = 'l3') AS l3,
  round(100.0 * count(*) FILTER (WHERE level <> 'allow') / count(*), 6)::DOUBLE AS saved_pct FROM v""",
    "url_domain_rollup": f"SELECT {DOMAIN.format('url')} AS domain, count(*) AS n, min(url) AS first_url FROM {URLS} GROUP BY 1",
    "url_resolve_links": f"""SELECT href, base, {resolve_sql("href", "base")} AS url
FROM (SELECT unnest({listed(HREFS)}) AS href), (SELECT url AS base FROM pages WHERE url IS NOT NULL UNION SELECT unnest({listed(BASES)}))""",
    "ssrf_guard": f"""SELECT url, host IS NULL OR host = '' OR starts_with(host, '127.') OR starts_with(host, '10.')
  OR starts_with(host, '192.168.') OR starts_with(host, '169.254.') OR host IN ('localhost', '0.0.0.0') OR starts_with(host, '[::1]')
  OR (starts_with(host, '172.') AND try_cast(split_part(host, '.', 2) AS INT) BETWEEN 16 AND 31) AS blocked
FROM (SELECT url, {HOST} AS host FROM {URLS})""",
    "blocked_media": f"""SELECT content_type, regexp_matches(lower(content_type),
  '^(image/|font/|video/|audio/|application/(font|pdf|zip|octet-stream))') AS blocked, count(*) AS n
FROM (SELECT CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) {" ".join(f"WHEN '{e}' THEN '{m}'" for e, m in ENDINGS.items())}
  ELSE 'text/html' END AS content_type FROM {URLS} UNION ALL SELECT unnest({listed(KINDS)})) GROUP BY 1, 2""",
    "page_head": """SELECT page_id, trim(regexp_extract(coalesce(html, ''), '<title[^>]*>([^<]*)</title>', 1)) AS title,
  regexp_extract(coalesce(html, ''), '<html[^>]*lang="([^"]*)"', 1) AS lang,
  regexp_extract(coalesce(html, ''), '<meta[^>]*name="description"[^>]*content="([^"]*)"', 1) AS description FROM pages""",
    "extract_links_pages": LINKS
    + f"""SELECT page_id, min(pos) AS pos, target, {DOMAIN.format("target")} = {DOMAIN.format("url")} AS internal,
  {relevance_sql("target")} AS relevance FROM links GROUP BY page_id, url, target""",
    "link_internal_ratio": LINKS
    + f"""SELECT page_id, count(*) AS links,
  round(avg(({DOMAIN.format("target")} = {DOMAIN.format("url")})::INT), 6) AS internal FROM links GROUP BY page_id""",
    "link_in_degree": LINKS
    + """SELECT target, count(DISTINCT page_id) AS pages, row_number() OVER (ORDER BY count(DISTINCT page_id) DESC, target) AS rank
FROM links GROUP BY target ORDER BY rank LIMIT 100""",
    "js_snippet_counts": f"""SELECT page_id, len(list_filter(tags, lambda t: NOT contains(t, 'src='))) AS inline_scripts,
  len(list_filter(tags, lambda t: contains(t, 'src='))) AS external_scripts,
  len(regexp_extract_all(html, {quoted(HANDLER)})) AS handlers
FROM (SELECT page_id, coalesce(html, '') AS html, regexp_extract_all(coalesce(html, ''), {quoted(SCRIPT)}, 1) AS tags FROM pages)""",
    "xhr_urls": f"""SELECT page_id, unnest(regexp_extract_all(html, {quoted(FETCH)}, 1)) AS request
FROM (SELECT page_id, coalesce(html, '') AS html FROM pages
  UNION ALL SELECT -unnest(range(1, {len(SNIPPETS) + 1})), unnest({listed(SNIPPETS)}))""",
    "tag_counts": """SELECT tag, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(lower(coalesce(html, '')), '<([a-z][a-z0-9]*)[\\s>]', 1)) AS tag FROM pages) GROUP BY tag""",
    "page_ttl_class": f"""SELECT (CASE {TTL_CASES} ELSE 300 END)::BIGINT AS ttl_s, count(*) AS n, min(url) AS first_url
FROM (SELECT url FROM {URLS} UNION ALL SELECT unnest({listed(CACHED)})) GROUP BY 1""",
}
