"""HTML pages as node rows: a tolerant tree builder on the standard library's tokenizer.

The only Python kernel of the page queries. It runs in ``mapInArrow`` page by page, so a page is the
unit of work and pages never meet; everything behind it is relational. Implied end tags of p, li,
dt, dd, option, tr, td and th are closed, void elements have no content, script and style are raw.

Defined results
---------------
* null or empty html: no rows. Malformed markup gives the tree of what could be read; nothing raises.
* node ids count from 0 in pre-order within a page; an empty table gives an empty result.
* attribute names repeat: the first value stays. Very long texts stay whole in ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.text import ACTIONS, alternatives, lookup, tree_relevance

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes an open element of these, up to the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr"}),
    "th": ({"td", "th"}, {"tr"}),
}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
DOM = (
    "page_id long, node_id long, parent_id long, ord long, depth long, tag string, attrs map<string,string>, "
    "text string, hidden boolean, path array<long>"
)
#: Ancestors that a node's path names at most, the nearest ones.
NEAR = 255
#: Characters of subtree text that an element keeps (a label has 512).
KEPT = 513
#: Plain tags, which need no tolerance: names of letters and digits, attributes in double quotes without character references.
PLAIN = re.compile(r'<([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][-a-zA-Z0-9_:]*="[^"&<>]*")*)>')
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_ATTR = re.compile(r'([a-zA-Z][-a-zA-Z0-9_:]*)="([^"]*)"')
#: Elements whose content the tokenizer reads in a way of its own.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


# Tags whose subtrees hold no content, tags' roles, words of calls to action, currency marks.
SKIPPED = ("script", "style", "noscript", "meta", "link", "head", "template")
TAG_ROLES = {
    "button": "button", "a": "link", "textarea": "textarea", "select": "combobox", "h1": "heading", "h2": "heading",
    "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "img": "img", "nav": "navigation",
    "main": "main", "header": "banner", "footer": "contentinfo", "form": "form", "table": "table", "li": "listitem",
    "ul": "list", "ol": "list", "p": "text", "span": "text", "div": "text",
}
INPUT_ROLES = {
    "checkbox": "checkbox", "radio": "radio", "submit": "button", "button": "button", "reset": "button", "search": "searchbox",
}
CTA_WORDS = (
    "add to cart", "buy now", "purchase", "checkout", "sign up", "subscribe", "get started", "download", "try free",
    "order now", "köp", "lägg i varukorg", "handla", "beställ", "registrera", "prenumerera", "ladda ner", "kom igång",
)
CURRENCIES = ("$", "€", "£", "¥", "₹", "kr", "SEK", "NOK", "DKK", "USD", "EUR", "GBP")
HIDING = ("display:none", "visibility:hidden", "opacity:0", "left:-9999", "left:-10000", "clip:rect(0")


class _Builder(HTMLParser):
    """Collects (parent, depth, tag, attrs, text) in pre-order; text nodes have no tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int | None, int, str | None, dict[str, str], str | None]] = []
        self.open: list[tuple[int, str]] = []

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines are not counted

    def parse_starttag(self, i: int) -> int:
        plain = PLAIN.match(self.rawdata, i)
        if plain is None or (tag := plain[1].lower()) in RAW:
            return super().parse_starttag(i)
        self.handle_starttag(tag, [(k.lower(), v) for k, v in PLAIN_ATTR.findall(plain[2])] if plain[2] else [])
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def _add(self, tag: str | None, attrs: dict[str, str], text: str | None) -> int:
        self.rows.append((self.open[-1][0] if self.open else None, len(self.open), tag, attrs, text))
        return len(self.rows) - 1

    def _close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][1] in tags:
                del self.open[i:]
                return
            if self.open[i][1] in bounds:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close({"p"}, {"table", "button"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        node = self._add(tag, found, None)
        if tag not in VOID:
            self.open.append((node, tag))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, frozenset())

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._add(None, {}, data)


def page_rows(page: int, html: str, paths: bool = True) -> list[tuple]:
    """The rows of one page; without ``paths``, those of visible elements only, with none."""
    b = _Builder()
    b.feed(html)
    b.close()
    seen: dict[int | None, int] = {}
    texts: list[str] = []
    gone: list[bool] = []
    ways: list[list[int]] = []
    out = []
    for i, (parent, depth, tag, attrs, text) in enumerate(b.rows):
        at = seen[parent] = seen.get(parent, -1) + 1
        hidden = tag in SKIPPED or (bool(attrs) and _hidden(attrs)) or (parent is not None and gone[parent])
        texts.append(text or "")
        gone.append(hidden)
        if paths:
            ways.append([*([] if parent is None else ways[parent][-NEAR:]), i])
        if tag is None and not hidden:
            up, piece = parent, text.strip() + " "
            while up is not None and len(texts[up]) < KEPT:
                texts[up] = (texts[up] + piece)[:KEPT]
                up = b.rows[up][0]
        out.append((page, i, parent, at, depth, tag, list(attrs.items()), hidden))
    if not paths:
        return [(*r[:7], t, False, None) for r, t in zip(out, texts, strict=True) if r[5] is not None and not r[7]]
    return [(*r[:7], t, r[7], p) for r, t, p in zip(out, texts, ways, strict=True)]


def _hidden(attrs: dict[str, str]) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    style = "".join(attrs["style"].lower().split()) if "style" in attrs else ""
    return style != "" and any(h in style for h in HIDING)


def dom_nodes(pages: DataFrame, paths: bool = True) -> DataFrame:
    """(page_id, node_id, parent_id, ord, depth, tag, attrs, text, hidden, path): a row per element and text node.

    A text node's text is whole; an element's is the start of its subtree's visible text. hidden holds for
    nodes within a hidden or skipped element, too. path lists the nearest NEAR ancestors, then the node. Without ``paths``, path is null and
    text nodes and hidden ones have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "node_id", "parent_id", "ord", "depth", "tag", "attrs", "text", "hidden", "path"]
        types = [pa.int64()] * 5 + [pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_(), pa.list_(pa.int64())]
        for batch in batches:
            for page, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
                rows = page_rows(page, html or "", paths)
                if rows:
                    cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, DOM)


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _flag(name: str) -> Column:
    """Whether an attribute is true; null without it."""
    return F.try_element_at("attrs", F.lit(name)) == "true"


def role_of(tag: Column, text: Column) -> Column:
    """A node's role from its attributes, tag and text."""
    kind, cls, low = F.lower(_attr("type")), F.lower(_attr("class")), F.lower(text)
    base = F.when(tag == "input", lookup(kind, INPUT_ROLES, "textbox")).otherwise(lookup(tag, TAG_ROLES, "generic"))
    product = F.regexp_like(F.lower(_attr("itemtype")), F.lit(r"schema\.org/(product|offer)")) | (
        F.exists(F.map_keys("attrs"), lambda k: k.isin("data-product-id", "data-product", "data-item-id"))
        & F.regexp_like(cls, F.lit("product|card|item"))
    )
    cta = base.isin("button", "link") & (
        F.regexp_like(low, F.lit(alternatives(CTA_WORDS))) | F.regexp_like(cls, F.lit("cta|add-to-cart|buy-btn|checkout"))
    )
    trimmed = F.trim(text)
    money = F.regexp_like(trimmed, F.lit(f"(?i)({alternatives(CURRENCIES)})"))
    priced = money | F.regexp_like(cls, F.lit("price|pris|cost")) | F.contains(F.lower(_attr("itemprop")), F.lit("price"))
    price = base.isin("text", "generic") & (F.octet_length(trimmed) <= 40) & F.regexp_like(trimmed, F.lit("[0-9]")) & priced
    return (
        F.when(_attr("role") != "", _attr("role"))
        .when(product, "product_card")
        .when(cta, "cta")
        .when(price, "price")
        .otherwise(base)
    )


def label_of(text: Column) -> Column:
    """A node's label: the first that is not blank of several attributes, its text and its name."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    by = some(_attr("aria-labelledby"))
    return F.coalesce(
        some(_attr("aria-label")),
        F.when(by.isNotNull(), F.concat(F.lit("[ref:"), by, F.lit("]"))),
        *[some(_attr(a)) for a in ("placeholder", "alt", "title")],
        F.substring(some(text), 1, 512),
        some(_attr("name")),
        F.lit(""),
    )


def sem_nodes(pages: DataFrame, goal: str = "", paths: bool = True) -> DataFrame:
    """Visible elements with their role, label, value, action, relevance, html_id, name and state; path is null without ``paths``."""
    shown = dom_nodes(pages, paths).filter("tag IS NOT NULL AND NOT hidden")
    text = F.coalesce("text", F.lit(""))
    value = F.when(F.col("role") == "link", _attr("href")).otherwise(F.coalesce(F.nullif(_attr("value"), F.lit("")), _attr("aria-valuenow")))
    rows = shown.withColumn("role", role_of(F.col("tag"), text)).withColumn("label", label_of(text))
    return rows.select(
        "page_id",
        "node_id",
        "parent_id",
        "depth",
        "tag",
        "role",
        "label",
        F.nullif(value, F.lit("")).alias("value"),
        F.nullif(lookup(F.col("role"), ACTIONS, ""), F.lit("")).alias("action"),
        F.round(tree_relevance(F.lit(goal), F.col("role"), F.col("label"), F.col("depth")), 6).alias("relevance"),
        F.nullif(_attr("id"), F.lit("")).alias("html_id"),
        F.nullif(_attr("name"), F.lit("")).alias("name"),
        (F.array_contains(F.map_keys("attrs"), "disabled") | (_attr("aria-disabled") == "true")).alias("disabled"),
        F.coalesce(_flag("aria-checked"), F.when(F.array_contains(F.map_keys("attrs"), "checked"), True)).alias("checked"),
        _flag("aria-expanded").alias("expanded"),
        F.coalesce(_flag("aria-selected"), F.lit(False)).alias("focused"),
        "path",
    )
