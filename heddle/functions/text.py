"""Text expressions: tokens, similarity to a goal, screening phrases. All are built-in Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop-words of the tokeniser (English and Swedish).
STOP_WORDS = (
    "the and for are but not you all can had her was one our out "
    "och att det som den med har för inte var ett till från"
).split()

# Phrases of high risk.
HIGH_RISK = (
    "ignore previous instructions", "ignore all previous", "disregard your", "forget your instructions",
    "you are now a ", "you are now an ", "you are now the ", "you are now in ", "you are now my ",
    "new instructions:", "system prompt:", "assistant:", "you must now", "override:", "jailbreak",
    "you will act as", "pretend to be", "act as a jailbreak", "become an unrestricted", "from now on, you are",
    "ignore your safety", "bypass your restrictions", "override your limits", "pretend you have no restrictions",
    "disregard safety", "[system]:", "[admin]:", "[developer]:", "below is a new prompt",
    "ignorera tidigare", "glöm dina instruktioner", "du är nu", "nya instruktioner:", "systemmeddelande:",
    "ignorera dina regler", "kringgå dina begränsningar", "låtsas att du är",
)
# Phrases of medium risk.
MEDIUM_RISK = (
    "as an ai", "as a language model", "do not follow", "stop following", "your real task", "your actual goal",
    "secret instruction", "hidden instruction", "roleplay as", "respond in the voice of", "answer as if you are",
    "execute this code:", "the next instruction is", "my next command is", "your guidelines don't apply",
    "according to anthropic", "as per openai policy", "official update from",
    "som en ai", "din riktiga uppgift", "hemlig instruktion", "spela rollen som", "officiell uppdatering",
)

# The goal categories' keywords; the first category with a hit wins.
GOAL_WORDS = {
    "form": (
        "fill", "enter", "login", "log in", "sign in", "sign up", "register", "submit form",
        "logga in", "fyll i", "registrera",
    ),
    "click": (
        "click", "press", "tap", "buy", "purchase", "add to cart", "checkout", "klicka", "köp", "lägg i varukorg",
    ),
    "navigate": ("next page", "previous", "go to", "navigate", "back", "nästa", "tillbaka", "gå till"),
    "extract": (
        "find", "show", "search", "list", "read", "get", "extract", "price", "article", "news", "product",
        "download", "install", "hitta", "visa", "sök", "läs", "hämta",
    ),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def alternatives(words: tuple[str, ...] | list[str]) -> str:
    """A pattern that matches any of the words, with their marks escaped."""
    return "|".join("".join(f"\\{c}" if c in ".[](){}*+?^$|\\" else c for c in w) for w in words)


RISK = f"(?i)({alternatives(HIGH_RISK + MEDIUM_RISK)})"
HIDDEN = "[\u200b\ufeff]"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.translate(c, UPPER, LOWER)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of more than two bytes that are no stop-words; null gives null."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(
        F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: (F.octet_length(t) > 2) & ~F.array_contains(stop, t)
    )


def text_similarity(goal: Column, text: Column) -> Column:
    """1 where the goal or all its words are within the text, else the share of its words that are.

    A goal without words gives 0. Without any hit, the goal's words run together may be in the text
    without its separators, which counts as 1.
    """
    low, cand = F.lower(goal), ascii_lower(text)
    words = F.filter(F.split(low, r"[\s_-]+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.contains(cand, w)))
    joined = F.contains(F.regexp_replace(cand, r"[ \t\n\f\r_-]", ""), F.array_join(words, ""))
    return (
        F.when(F.size(words) == 0, 0.0)
        .when(F.contains(cand, low) | (hits == F.size(words)), 1.0)
        .when((hits == 0) & (F.octet_length(cand) >= F.octet_length(low)) & joined, 1.0)
        .otherwise(hits / F.size(words))
    )


def risk_phrase(text: Column) -> Column:
    """The first screening phrase in the text as it stands there, empty without one."""
    return F.regexp_extract(text, RISK, 1)


def prefix_pattern(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words, with common beginnings written once, so that a position is soon left."""
    if "" in words:
        return ""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(re.escape(c) + prefix_pattern(tuple(rest)) for c, rest in groups.items()) + ")"


def may_hold_risk(text: Column) -> Column:
    """Whether a screening phrase or a hidden character is in the text; far cheaper than to extract the first phrase."""
    return F.regexp_like(text, F.lit(f"(?i){HIDDEN}|{prefix_pattern(HIGH_RISK + MEDIUM_RISK)}"))


def risk_severity(text: Column) -> Column:
    """high, medium or null; hidden characters count as medium."""
    found = ascii_lower(risk_phrase(text))
    return (
        F.when(found.isin(*HIGH_RISK), "high")
        .when((found != "") | F.regexp_like(text, F.lit(HIDDEN)), "medium")
        .otherwise(F.lit(None).cast("string"))
    )


def sanitize(text: Column) -> Column:
    """The text with every screening phrase replaced by a mark."""
    return F.regexp_replace(text, RISK, "[FILTERED]")


def wrap_untrusted(text: Column) -> Column:
    """The text between the marks of untrusted content."""
    return F.concat(F.lit("<UNTRUSTED_WEB_CONTENT>\n"), text, F.lit("\n</UNTRUSTED_WEB_CONTENT>"))


def goal_category(goal: Column) -> Column:
    """form, click, navigate, extract or generic: the first whose keywords the goal contains."""
    out = None
    for name, words in GOAL_WORDS.items():
        hit = F.regexp_like(F.lower(goal), F.lit(alternatives(words)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("generic")


def nav_penalty(role: Column, label: Column) -> Column:
    """What skip links, cookie buttons and menu buttons lose in relevance."""
    low, button = ascii_lower(label), role.isin("button", "cta")
    return (
        F.when(F.regexp_like(low, F.lit("^(gå till|gå direkt|skip to|jump to)")), 0.25)
        .when(button & F.regexp_like(low, F.lit("cookie|jag förstår|i understand|accept all|godkänn")), 0.20)
        .when(button & low.isin("meny", "menu", "☰"), 0.15)
        .otherwise(0.0)
    )


# A role's priority in a tree, and in a resonance field.
TREE_PRIORITY = {
    "cta": 0.95, "button": 0.9, "textbox": 0.85, "searchbox": 0.85, "link": 0.8, "tab": 0.8, "checkbox": 0.75,
    "radio": 0.75, "switch": 0.75, "combobox": 0.75, "select": 0.75, "menu": 0.75, "product_card": 0.7,
    "dialog": 0.7, "price": 0.65, "navigation": 0.6, "complementary": 0.6, "heading": 0.6, "video": 0.55,
    "form": 0.5, "img": 0.4, "text": 0.3, "paragraph": 0.3,
}
FIELD_PRIORITY = {
    "price": 1.0, "data": 1.0, "cell": 1.0, "heading": 0.9, "text": 0.9, "paragraph": 0.9, "button": 0.85,
    "cta": 0.85, "product_card": 0.85, "link": 0.7, "listitem": 0.7, "row": 0.7, "img": 0.6, "table": 0.6,
    "textbox": 0.5, "searchbox": 0.5, "select": 0.5, "navigation": 0.2, "complementary": 0.2, "generic": 0.4,
}
ACTIONS = {
    "button": "click", "link": "click", "menuitem": "click", "cta": "click", "tab": "click",
    "textbox": "type", "searchbox": "type", "textarea": "type",
    "checkbox": "toggle", "radio": "toggle", "switch": "toggle",
    "combobox": "select", "listbox": "select", "select": "select", "menu": "select", "slider": "slide",
    "product_card": "click", "dialog": "click", "video": "click", "navigation": "click", "complementary": "click",
}


def lookup(c: Column, table: dict, default: object) -> Column:
    """The table's value for the column, or the default."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def tree_relevance(goal: Column, role: Column, label: Column, depth: Column) -> Column:
    """Relevance of a tree node to a goal, from 0 to 1."""
    size = F.octet_length(label)
    raw = (
        text_similarity(goal, label) * 0.55
        + lookup(role, TREE_PRIORITY, 0.2) * 0.35
        - F.least(depth * 0.02, F.lit(0.15))
        - F.when(size > 500, 0.15).when(size > 300, 0.08).otherwise(0.0)
        - nav_penalty(role, label)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
