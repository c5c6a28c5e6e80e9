"""URL expressions: hosts, resolving, the request firewall. All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.text import alternatives

# Domains of trackers, advertisers and chat widgets.
TRACKING = (
    "google-analytics.com", "googletagmanager.com", "analytics.google.com", "hotjar.com", "mixpanel.com",
    "segment.io", "segment.com", "amplitude.com", "heap.io", "heapanalytics.com", "fullstory.com", "mouseflow.com",
    "crazyegg.com", "luckyorange.com", "clarity.ms", "plausible.io", "matomo.cloud", "doubleclick.net",
    "googlesyndication.com", "googleadservices.com", "facebook.net", "fbcdn.net", "ads-twitter.com",
    "amazon-adsystem.com", "adnxs.com", "criteo.com", "outbrain.com", "taboola.com", "moatads.com", "facebook.com/tr",
    "bat.bing.com", "snap.licdn.com", "ct.pinterest.com", "t.co/i/adsct", "fingerprintjs.com", "cdn.cookielaw.org",
    "cookiebot.com", "onetrust.com", "intercom.io", "intercomcdn.com", "drift.com", "tawk.to", "zendesk.com",
    "livechatinc.com",
)
# File extensions without text.
EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp", ".avif", ".woff", ".woff2", ".ttf", ".otf", ".eot",
    ".mp4", ".webm", ".ogg", ".avi", ".mov", ".mp3", ".wav", ".flac", ".aac", ".pdf", ".zip", ".gz", ".tar", ".rar", ".map",
)
# Starts of media types without text.
MEDIA_TYPES = (
    "image/", "font/", "video/", "audio/", "application/font", "application/pdf", "application/zip",
    "application/octet-stream",
)
# Parts of URLs that speak for and against relevance.
RELEVANT = (
    "product", "produkt", "cart", "checkout", "kassa", "varukorg", "login", "logga", "search", "sok", "sök", "api", "price", "pris",
    "order", "account", "konto", "register", "registrera",
)
IRRELEVANT = ("font", "analytics", "tracking", "beacon", "pixel", "telemetry")

L1_HOST = f"(^|\\.)({alternatives(TRACKING)})$"
L1_PATH = "/analytics|/tracking|/pixel"
L2_END = f"({alternatives(EXTENSIONS)})$"


def host(url: Column) -> Column:
    """The lower-cased host of an http(s) URL without its port; null for others."""
    found = F.lower(F.regexp_extract(url, "^https?://([^/:]*)", 1))
    return F.when(F.regexp_like(url, F.lit("^https?://")), found)


def domain(url: Column) -> Column:
    """What stands between scheme and path, without a leading www., lower-cased."""
    rest = F.element_at(F.split(url, "://"), -1)
    return F.lower(F.regexp_replace(F.element_at(F.split(rest, "/"), 1), "^www\\.", ""))


def url_relevance(url: Column, goal: Column) -> Column:
    """How far a URL fits a goal, from 0 to 1; 0.5 for a goal without words."""
    low = F.lower(url)
    words = F.filter(F.split(F.lower(goal), r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) > 2)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    bonus = F.when(F.regexp_like(low, F.lit(alternatives(RELEVANT))), 0.2).otherwise(0.0)
    malus = F.when(F.regexp_like(low, F.lit(alternatives(IRRELEVANT))), 0.5).otherwise(0.0)
    raw = F.try_divide(hits, F.size(words)) + bonus + 0.3 - malus
    return F.when(F.size(words) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def firewall_level(url: Column, goal: Column, least: float = 0.1, allowed: tuple[str, ...] = ()) -> Column:
    """allow, or the level that blocks: l1 (tracker), l2 (file type), l3 (relevance)."""
    at = host(url)
    levels = (
        F.when(at.isNotNull() & (F.regexp_like(at, F.lit(L1_HOST)) | F.regexp_like(F.lower(url), F.lit(L1_PATH))), "l1")
        .when(F.regexp_like(F.lower(F.element_at(F.split(url, "\\?"), 1)), F.lit(L2_END)), "l2")
        .when((goal != "") & (url_relevance(url, goal) < least), "l3")
        .otherwise("allow")
    )
    if not allowed:
        return levels
    return F.when(F.coalesce(F.regexp_like(at, F.lit(f"(^|\\.)({alternatives(allowed)})$")), F.lit(False)), "allow").otherwise(levels)


def blocked_media(content_type: Column) -> Column:
    """Whether a media type holds no text."""
    return F.regexp_like(F.lower(content_type), F.lit(f"^({alternatives(MEDIA_TYPES)})"))


def resolve(href: Column, base: Column) -> Column:
    """The absolute form of a link; ``..`` stays as it is."""
    h = F.trim(href)
    scheme = F.when(F.contains(base, F.lit("://")), F.element_at(F.split(base, "://"), 1)).otherwise("https")
    rest = F.regexp_replace(F.regexp_replace(base, "^.*?://", ""), "[?#].*$", "")
    at, path = F.regexp_extract(rest, "^[^/]*", 0), F.regexp_extract(rest, "/.*$", 0)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return (
        F.when(F.regexp_like(h, F.lit("^(javascript:|mailto:|https?://)")) | (h == ""), h)
        .when(h.startswith("//"), F.concat(F.when(base.startswith("https://"), "https:").otherwise("http:"), h))
        .when(h.startswith("/"), F.concat(scheme, F.lit("://"), at, h))
        .when(h.startswith("#"), F.concat(F.element_at(F.split(base, "#"), 1), h))
        .when(h.startswith("?"), F.concat(F.element_at(F.split(base, "\\?"), 1), h))
        .otherwise(F.concat(scheme, F.lit("://"), at, folder, F.lit("/"), h))
    )


def unsafe_target(url: Column) -> Column:
    """Whether a URL must not be fetched: another scheme, a loopback or a private address."""
    at = host(url)
    private = r"^(localhost|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|169\.254\..*|\[::1\].*)$"
    return at.isNull() | (at == "") | F.regexp_like(at, F.lit(private))
