"""Scores of answers, structured entries and search results. All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a goal that ask for a kind of answer, and what then raises a label.
PRICE_GOAL, PRICE_LABEL = "price|cost|pris|kr|fee", "[$£€]|kr"
COUNT_GOAL, COUNT_LABEL = "population|invånare|antal|many", "[0-9]([ ,]*[0-9]){3}"
DATE_GOAL, DATE_LABEL = "date|when|datum|year|år", "20[012]"
RATE_GOAL, RATE_LABEL = "rate|percent|ränta", "%"
UNITS = "[$£€%]|kr|km|kg"
LANDMARKS = ("navigation", "complementary", "contentinfo", "banner")
#: A node shown this often, and useful less often than this share, sinks towards the floor.
SHOWN, USEFUL, FLOOR = 5, 0.25, 0.15

# Last key segments of structured data and the roles that their values take.
HEADING_KEYS = ("title", "headline", "heading", "name", "shortname")
TEXT_KEYS = (
    "description", "summary", "abstract", "synopsis", "body", "excerpt", "text", "intro", "lead", "teaser", "caption",
    "alttext", "alt",
)
LINK_KEYS = ("href", "url", "link", "path", "permalink", "canonical")
IMAGE_KEYS = ("image", "imageurl", "thumbnail", "poster", "src", "logo")
DATE_KEYS = (
    "date", "published", "publishedat", "updated", "updatedat", "created", "createdat", "timestamp", "firstpublished",
    "lastupdated",
)
PRICE_KEYS = ("price", "cost", "amount", "fee", "total")
AUTHOR_KEYS = ("author", "byline", "writer", "contributor", "creator")
TOPIC_KEYS = ("category", "tag", "topic", "section", "genre", "label")
# Marks of advertisements in addresses, and of a search page that asks for a human.
ADS = ("duckduckgo.com/y.js", "/ad/click", "/ads/", "doubleclick.net", "googleadservices.com", "ad.atdmt.com", "bing.com/aclick")
CAPTCHA = ("anomaly-modal", "bots use DuckDuckGo", "challenge to confirm")
SEARCH = "https://lite.duckduckgo.com/lite/?q="


def _has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def _points(test: Column, points: float) -> Column:
    return F.when(test, points).otherwise(0.0)


def answer_shape(label: Column, role: Column, siblings: Column, children: Column, content: Column) -> Column:
    """How far a node looks like an answer, from its form alone; null label gives null.

    ``children``: whether it has any; ``content``: whether a sibling holds text or data.
    """
    size = F.octet_length(label)
    return (
        _points((role == "heading") & ~children, -0.35)
        + _points((role == "heading") & ~children & content, 0.10)
        + _points(_has(label, "[0-9]"), 0.3)
        + _points((size > 0) & (size < 50), 0.2)
        + _points(_has(F.lower(label), UNITS), 0.15)
        + _points((siblings >= 2) & role.isin("cell", "data", "row", "listitem"), 0.15)
        + _points(role.isin("price", "data", "cell"), 0.1)
        + _points((size > 20) & (size < 200), 0.1)
    )


def answer_type(goal: Column, label: Column) -> Column:
    """What a label gains where it holds the kind of value that the goal asks for; the first kind counts."""
    want, low = F.lower(goal), F.lower(label)
    return (
        F.when(_has(want, PRICE_GOAL) & _has(low, PRICE_LABEL), 0.25)
        .when(_has(want, COUNT_GOAL) & _has(label, COUNT_LABEL), 0.2)
        .when(_has(want, DATE_GOAL) & _has(label, DATE_LABEL), 0.15)
        .when(_has(want, RATE_GOAL) & _has(low, RATE_LABEL), 0.25)
        .otherwise(0.0)
    )


def zone_factor(role: Column, depth: Column) -> Column:
    """What landmarks and top wrappers keep of their score."""
    return F.when(role.isin(*LANDMARKS), 0.5).when((role == "generic") & (depth <= 1), 0.7).otherwise(1.0)


def consensus(*signals: Column) -> Column:
    """A quarter more for each signal beyond the first that holds."""
    n = sum((s.cast("int") for s in signals[1:]), signals[0].cast("int"))
    return F.when(n >= 2, 1.0 + (n - 1) * 0.25).otherwise(1.0)


def suppression(useful: Column, shown: Column) -> Column:
    """What a node keeps that was shown often and seldom useful."""
    share = F.try_divide(useful, shown)
    return F.when((shown >= SHOWN) & (share < USEFUL), FLOOR + (1 - FLOOR) * share / USEFUL).otherwise(1.0)


def survivor_cap(candidates: Column, nodes: Column, late: bool) -> Column:
    """How many nodes go on to reranking; ``late``: by token vectors, otherwise by one vector for each text."""
    steps, factors, least = (
        (((200, 50), (500, 60), (2000, 80)), (0.7, 0.85), 10) if late else (((200, 60), (500, 80)), (0.6, 0.8), 20)
    )
    base = F.when(nodes < 50, nodes)
    for limit, cap in steps:
        base = base.when(nodes < limit, cap)
    factor = F.when(candidates > 100, factors[0]).when(candidates > 30, factors[1]).otherwise(1.0)
    return F.greatest(F.floor(base.otherwise(100) * factor + 1e-9), F.lit(least).cast("long"))


def goal_cluster(goal: Column) -> Column:
    """The first three of a goal's words of over three bytes, in order, joined by +; _ without any."""
    words = F.filter(F.split(goal, r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 3)
    first = F.array_join(F.slice(F.array_sort(F.array_distinct(words)), 1, 3), "+")
    return F.when(first == "", "_").otherwise(first)


def title_overlap(goal: Column, title: Column) -> Column:
    """The share of the goal's words of over two bytes that the title contains; 0 without any."""
    words = F.filter(F.split(F.lower(goal), r"\s+"), lambda w: F.octet_length(w) > 2)
    low = F.lower(title)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.when(title == "", 0.0).otherwise(F.coalesce(F.try_divide(hits, F.size(words)), F.lit(0.0)))


def entry_role(key: Column, value: Column) -> Column:
    """The role of a structured entry, by the last segment of its key and the form of its value."""
    last, size = F.lower(F.element_at(F.split(key, r"\."), -1)), F.octet_length(value)
    web, rooted = F.startswith(value, F.lit("http")), F.startswith(value, F.lit("/"))
    prose = (size > 40) & ~web & ~_has(value, r"^[{\[]") & ~_has(last, "id|hash|token|config")
    return (
        F.when(value.isin("", "true", "false", "null"), "data")
        .when(last.isin(*HEADING_KEYS) & (size > 3) & (size < 300) & ~web & ~rooted, "heading")
        .when(last.isin(*TEXT_KEYS) & (size > 10), "text")
        .when(last.isin(*LINK_KEYS) & (web | rooted), "link")
        .when(last.isin(*IMAGE_KEYS) & (web | rooted), "img")
        .when(last.isin(*DATE_KEYS), "data")
        .when(last.isin(*PRICE_KEYS), "price")
        .when(last.isin(*AUTHOR_KEYS) & (size > 2) & (size < 100), "text")
        .when(last.isin(*TOPIC_KEYS) & (size < 80), "listitem")
        .when(prose, "text")
        .otherwise("data")
    )


def entry_relevance(key: Column, value: Column, goal: Column) -> Column:
    """How far a structured entry fits a goal, from 0.05 to 1; its value counts more than its key."""
    words = F.filter(F.split(F.lower(goal), r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.octet_length(w) >= 3)

    def share(c: Column) -> Column:
        return F.try_divide(F.size(F.filter(long, lambda w: F.contains(F.lower(c), w))), F.size(long))

    malus = F.when(_has(F.lower(value), "^https?://"), 0.3).when(F.octet_length(value) < 10, 0.1).otherwise(0.0)
    raw = 0.05 + (share(key) * 0.3 + share(value) * 0.7) * 0.95 - malus
    return (
        F.when(F.size(words) == 0, 0.5)
        .when(F.size(long) == 0, 0.3)
        .otherwise(F.greatest(F.lit(0.05), F.least(F.lit(1.0), raw)))
    )


def percent_encode(text: Column) -> Column:
    """A query parameter: letters, digits and -_.~ stay, a space becomes +."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def search_url(query: Column) -> Column:
    """The address of a search."""
    return F.concat(F.lit(SEARCH), percent_encode(query))


def redirect_target(url: Column) -> Column:
    """The address that a search result's redirect leads to; empty without one, null if it is malformed."""
    return F.try_url_decode(F.regexp_extract(url, "uddg=([^&]*)", 1))


def contains_any(c: Column, marks: tuple[str, ...]) -> Column:
    """Whether any of the marks is in the text."""
    out = F.contains(c, F.lit(marks[0]))
    for m in marks[1:]:
        out = out | F.contains(c, F.lit(m))
    return out
