"""Column expressions over labels, keys and headers: artefacts, headlines, script remains, selectors, cookies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs of script text; a sign with capitals never fits, since the text is lower-cased.
SCRIPT_SIGNS = (
    "function(", "function ", "var ", "const ", "let ", "document.", "window.", "optanonwrapper", "adsbygoogle", "gtag(",
    "dataLayer", "createElement", "addEventListener", "typeof ", "return{", "return {", "({", "});", ".push(", "===", "!==",
)
# Beginnings of resource keys, of structured metadata, and what makes such metadata technical.
TEMPLATE_HEADS = ("translations.", "i18n.", "commoni18nresources.", "locale.", "messages.")
META_HEADS = ("jsonld.", "page.seo.", "schema.")
META_PARTS = (
    ".image", ".width", ".height", ".robots", ".canonical", ".og.", "opengraph", ".twitter.", ".@type", ".@context",
)
# Parts, last segments and regions of keys that hold no content.
INTERNAL_PARTS = ("__N_", "_sentryTrace", "buildId", "assetPrefix", "runtimeConfig", "_resolved", "__typename")
INTERNAL_LAST = (
    "isspecial", "islivenow", "inoverlay", "ismissingaccesstoken", "isinternational", "brandid", "seriesid", "indeximage",
    "contenttype", "firstupdated", "lastupdated", "livereorderingallowed", "allowadvertisingflag", "experimentalfeatures",
    "reportinguri", "trackingid", "gauid",
)
INTERNAL_REGIONS = (
    "hamburgernavigation", "footerlink", "footer.legal", "footer.language", "authinfo", "navigation.footer", "navigation.hamburger",
)
# Words of an action, by its type, in the order in which they are tried.
ACTION_WORDS = {
    "click": ("click", "klick"),
    "fill": ("fill", "fyll", "type"),
    "extract": ("extract", "hämta"),
    "wait": ("wait", "vänta"),
    "verify": ("verify", "verifiera"),
}
# The tag that a role's selector names.
SELECTOR_TAGS = {
    "button": "button", "cta": "button", "link": "a", "textbox": "input", "searchbox": "input", "textarea": "textarea",
    "combobox": "select", "select": "select", "checkbox": "input", "radio": "input", "product_card": "div", "price": "span",
}
# Words of a login form's fields, by column.
LOGIN_USER = {"label": ("email", "user", "login"), "name": ("email", "user", "login"), "html_id": ("email", "user")}
LOGIN_PASS = {"label": ("password", "lösenord"), "name": ("pass",), "html_id": ("pass",)}
LOGIN_SUBMIT = ("log in", "login", "logga in", "sign in", "submit")


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(text, p))


def starts_any(text: Column, parts: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: F.startswith(text, p))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def script_content(text: Column) -> Column:
    """At least 20 bytes and two signs of script text."""
    low = F.lower(text)
    found = F.filter(F.array(*map(F.lit, SCRIPT_SIGNS)), lambda s: F.contains(low, s))
    return (F.octet_length(text) >= 20) & (F.size(found) >= 2)


def template_artifact(label: Column) -> Column:
    """An unfilled template variable or the key of a resource."""
    size, spaced = F.octet_length(label), F.contains(label, F.lit(" "))
    dots = F.length(label) - F.length(F.replace(label, F.lit("."), F.lit("")))
    ends = F.regexp_like(label, F.lit("(true|false|null)$"))
    path = ~spaced & (dots >= 2) & (size < 200) & ~F.contains(label, F.lit("://")) & ~F.regexp_like(label, F.lit("^[0-9]"))
    return (
        F.contains(label, F.lit("{{"))
        | F.contains(label, F.lit("translations.messages"))
        | starts_any(F.lower(label), TEMPLATE_HEADS)
        | (path & (F.regexp_like(label, F.lit(r"[A-Z\[]")) | ends))
        | (F.startswith(label, F.lit("{")) & F.endswith(label, F.lit("}")) & (size < 50) & ~spaced)
    )


def numeric_artifact(label: Column) -> Column:
    """A bare number or fraction, or technical metadata."""
    low, trimmed = F.lower(label), F.regexp_replace(label, r"^\s+|\s+$", "")
    size = F.octet_length(trimmed)
    number = F.regexp_like(trimmed, F.lit("^[0-9,.]+$"))
    fraction = (size < 8) & F.regexp_like(trimmed, F.lit(r"^[0-9]*\s*/\s*[0-9]*$"))
    return (starts_any(low, META_HEADS) & holds_any(low, META_PARTS)) | ((size > 0) & (size <= 20) & (number | fraction))


def _digit(label: Column) -> Column:
    return F.regexp_like(label, F.lit("[0-9]"))


def news_headline(label: Column) -> Column:
    """20 to 200 bytes without digits and currencies, at least four words, most of them capitalised."""
    some = words(label)
    upper = F.size(F.filter(some, lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}"))))
    plain = ~_digit(label) & ~F.regexp_like(label, F.lit("[%$£€]"))
    return F.octet_length(label).between(20, 200) & plain & (F.size(some) >= 4) & (upper / F.size(some) > 0.5)


def nav_word_list(label: Column) -> Column:
    """3 to 30 words, over 70 % of them short and capitalised, without sentences and digits."""
    some = words(label)
    short = F.filter(some, lambda w: (F.octet_length(w) <= 15) & F.regexp_like(w, F.lit(r"^\p{Lu}")) & ~F.regexp_like(w, F.lit("[.,]")))
    return F.size(some).between(3, 30) & (F.size(short) / F.size(some) > 0.7) & ~F.contains(label, F.lit(". ")) & ~_digit(label)


def informational(label: Column) -> Column:
    """Over 60 bytes, or a digit, a sentence or an enumeration."""
    return (F.octet_length(label) > 60) | _digit(label) | F.contains(label, F.lit(". ")) | F.contains(label, F.lit(", "))


def truncated(label: Column, size: int) -> Column:
    """The label, or its longest beginning of at most ``size`` bytes with an ellipsis."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(size)), lambda k: F.octet_length(F.left(label, k)) <= size)
    return F.when(F.octet_length(label) <= size, label).otherwise(F.concat(F.left(label, F.array_max(fits)), F.lit("…")))


def internal_key(key: Column) -> Column:
    """Whether a key of embedded data holds no content."""
    last, low = F.lower(F.element_at(F.split(key, r"\."), -1)), F.lower(key)
    deep = F.endswith(last, F.lit("id")) & (F.size(F.split(key, r"\.")) > 2)
    return holds_any(key, INTERNAL_PARTS) | last.isin(*INTERNAL_LAST) | holds_any(low, INTERNAL_REGIONS) | deep


def action_type(action: Column) -> Column:
    """The type of the first words that the action holds; navigate without any."""
    low, out = F.lower(action), None
    for name, some in ACTION_WORDS.items():
        out = F.when(holds_any(low, some), name) if out is None else out.when(holds_any(low, some), name)
    return out.otherwise("navigate")


def selector_hint(role: Column, html_id: Column, label: Column, name: Column) -> Column:
    """A CSS selector by id, else by label, else by name; html_id and name may be null."""
    pairs = F.create_map(*[F.lit(x) for pair in SELECTOR_TAGS.items() for x in pair])
    tag = F.coalesce(F.try_element_at(pairs, role), F.lit("*"))
    safe = lambda c: F.replace(c, F.lit("'"), F.lit("\\'"))
    return (
        F.when(html_id.isNotNull(), F.concat(tag, F.lit("#"), html_id))
        .when(label != "", F.concat(tag, F.lit("[aria-label='"), safe(label), F.lit("']")))
        .when(name.isNotNull(), F.concat(tag, F.lit("[name='"), safe(name), F.lit("']")))
        .otherwise(tag)
    )


def cookie(header: Column) -> Column:
    """name, value, path, expires_ms, http_only and secure of a Set-Cookie header; null where it has no name."""
    parts = F.split(header, ";")
    first = F.trim(F.element_at(parts, 1))
    at = F.instr(first, "=")
    attrs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.lower(F.trim(p)))
    last = lambda found, default: F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(default))
    ages = F.filter(attrs, lambda p: F.regexp_like(p, F.lit("^max-age=[0-9]+$")))
    key = F.trim(F.substring(first, F.lit(1), at - 1))
    return F.when(
        (at > 0) & (key != ""),
        F.struct(
            key.alias("name"),
            F.trim(F.substring(first, at + 1, F.length(first))).alias("value"),
            F.regexp_replace(last(F.filter(attrs, lambda p: F.startswith(p, F.lit("path="))), "path=/"), "^path=", "").alias("path"),
            (F.regexp_replace(last(ages, "max-age=0"), "^max-age=", "").cast("long") * 1000).alias("expires_ms"),
            F.array_contains(attrs, "httponly").alias("http_only"),
            F.array_contains(attrs, "secure").alias("secure"),
        ),
    )


def learned_weight(heuristic: Column, good: Column, bad: Column) -> Column:
    """An edge weight after feedback (regret matching); the heuristic without any."""
    up, down = F.greatest(good, F.lit(0.0)), F.abs(bad)
    return F.when(up + down < 0.001, heuristic).otherwise(heuristic * (0.5 + up / (up + down + 1.0) * 1.3))
