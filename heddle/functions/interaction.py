"""Late interaction of token vectors in 8 bits, and the signals that a node's score is blended from.

A word's vector has 64 components: the signs of the 64-bit hashes of its three-letter pieces (with marks at both ends) are added
up and divided by their norm, so words that share pieces are alike. Components from -1 to 1 become numbers from 0 to
255. A text's score for a goal is the mean, over the goal's words, of the largest inner product with any of its own.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from heddle.functions.hypervectors import seeds
from heddle.functions.labels import informational, nav_word_list, news_headline
from heddle.functions.text import TREE_PRIORITY, alternatives, ascii_lower, lookup

DIM = 64
#: Words of texts that are compared at once.
CHUNK = 1 << 17
#: Words whose vectors are made at once.
BLOCK = 1 << 11


def word_vectors(words: list[str]) -> np.ndarray:
    """(words, 64) numbers from 0 to 255."""
    marked = [f"<{w}>" for w in words]
    size = np.array([max(1, len(m) - 2) for m in marked], np.int64)
    pieces = pa.array([m[k : k + 3] for m in marked for k in range(max(1, len(m) - 2))], pa.string()).dictionary_encode()
    bits = np.unpackbits(seeds(pieces.dictionary.to_pylist(), 1).astype("<u8").view(np.uint8), axis=1, bitorder="little").reshape(-1, DIM).astype(np.int32)
    at, first, order = pieces.indices.to_numpy(zero_copy_only=False), np.cumsum(size) - size, np.argsort(-size, kind="stable")
    out, first, size = np.empty((len(words), DIM), np.uint8), first[order], size[order]
    for begin in range(0, len(words), BLOCK):
        n, start = size[begin : begin + BLOCK], first[begin : begin + BLOCK]
        total = np.zeros((len(n), DIM), np.int32)
        for k in range(n.max(initial=0)):  # the words that have as many pieces come first
            more = int(np.searchsorted(-n, -k, "left"))
            total[:more] += bits[at[start[:more] + k]]
        unit = (2 * total - n[:, None]).astype(np.float64)
        norm = np.sqrt((unit * unit).sum(axis=1))
        unit /= np.where(norm > 0, norm, 1.0)[:, None]
        unit += 1.0
        unit *= 127.5
        out[order[begin : begin + BLOCK]] = unit.astype(np.uint8)  # none is below 0, so this is the floor
    return out


def best_sums(words: pa.Array, goals: pa.Array) -> np.ndarray:
    """The score of each list of words for the list of goal words beside it."""
    size = np.array([len(w) if w.is_valid else 0 for w in words], np.int64)
    flat = words.flatten().dictionary_encode()
    known, at = word_vectors(flat.dictionary.to_pylist()).astype(np.float32), flat.indices.to_numpy(zero_copy_only=False)
    first, out = np.cumsum(size) - size, np.zeros(len(size))
    asked: dict[tuple[str, ...], list[int]] = {}
    for i, g in enumerate(goals.to_pylist()):
        if g and size[i]:
            asked.setdefault(tuple(g), []).append(i)
    place = {w: k for k, w in enumerate(dict.fromkeys(w for goal in asked for w in goal))}
    aims = word_vectors(list(place)).astype(np.float32)
    for goal, rows in asked.items():
        aim = aims[[place[w] for w in goal]]
        few = size[rows].sum() < len(known)  # then these rows' words alone are compared
        like = None if few else aim @ known.T  # whole numbers below 2 ** 24, exact
        rows = np.array(rows)
        for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // CHUNK)) + 1):
            n = size[part]
            take = np.repeat(first[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            spots, begins = at[take], np.cumsum(n) - n
            tops = aim @ known[spots].T if few else like[:, spots]
            out[part] = np.maximum.reduceat(tops, begins, axis=1).astype(np.float64).sum(axis=0) / len(goal)
    return out


@F.arrow_udf(ArrayType(StringType()))
def rarest(words: pa.Array, known: pa.Array, most: pa.Array) -> pa.Array:
    """The ``most`` words of each list that occur least in it, without the known ones; ties go to the word that sorts first."""
    out = []
    for own, without, n in zip(words.to_pylist(), known.to_pylist(), most.to_pylist(), strict=True):
        times = Counter(own)
        found = sorted((k, w.encode()) for w, k in times.items() if w not in without)
        out.append([w.decode() for _, w in found[:n]])
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(DoubleType())
def _interaction(words: pa.Array, goals: pa.Array) -> pa.Array:
    return pa.array(best_sums(words, goals))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}]+"), "")


def late_interaction(words: Column, goal_words: Column) -> Column:
    """The score of a list of words for a list of goal words; 0 where either is empty."""
    return _interaction(words, goal_words)


def adaptive_alpha(n_words: Column) -> Column:
    """The weight of late interaction in a blend: short labels are well told by one vector, long ones by their words."""
    return F.when(n_words <= 20, 0.3).when(n_words <= 80, 0.7).when(n_words <= 200, 0.85).otherwise(0.95)


# Labels that are no content, by their beginnings and parts.
RESOURCE_HEADS = ("commoni18nresources.", "translations.", "i18n.", "locale.", "messages.", "fields.sections[", "dynamicids[", "opengraph.")
STATE_HEADS = ("jsonld.", "props.initialstate.")
STATE_PARTS = (
    ".image", ".url:", ".src", ".href", ".width", ".height", ".@type", ".@context", ".robots", ".canonical", ".og.", ".twitter.",
)
MEDIA_PARTS = ("].image", "].photo", "].thumbnail", "og:image", "og:url", "twitter:image")
IMAGE_ENDINGS = (".png", ".jpg", ".svg", ".webp")


def no_content(label: Column, role: Column) -> Column:
    """Whether a node is left out: no label, keys of resources and states, media addresses, programmatic paths, bare numbers."""
    low, trimmed = ascii_lower(label), F.regexp_replace(label, r"^\s+|\s+$", "")
    starts = lambda heads: F.regexp_like(low, F.lit(f"^({alternatives(heads)})"))
    holds = lambda parts: F.regexp_like(low, F.lit(alternatives(parts)))
    data, address = role == "data", F.contains(low, F.lit("://"))
    dots = F.octet_length(label) - F.octet_length(F.replace(label, F.lit("."), F.lit("")))
    path = ~F.contains(label, F.lit(" ")) & (dots >= 2) & (F.octet_length(label) < 200) & ~F.contains(label, F.lit("://"))
    path &= ~F.regexp_like(label, F.lit("^[0-9]")) & F.regexp_like(label, F.lit(r"[A-Z\[]"))
    return (
        (label == "")
        | starts(RESOURCE_HEADS)
        | F.contains(label, F.lit("{{"))
        | (starts(STATE_HEADS) & holds(STATE_PARTS))
        | holds(MEDIA_PARTS)
        | (data & address & (F.contains(low, F.lit("].url")) | holds(IMAGE_ENDINGS)))
        | (data & F.startswith(low, F.lit("props.")))
        | path
        | ((F.octet_length(trimmed) <= 20) & F.regexp_like(trimmed, F.lit("^[0-9,.]+$")))
    )


def role_factor(role: Column, label: Column, leaf: Column) -> Column:
    """How much a node's role and kind of label raise or lower its score; nodes with children gather their children's text."""
    size, told = F.octet_length(label), informational(label)
    text = (
        F.when(news_headline(label), 0.4)
        .when(nav_word_list(label), 0.3)
        .when(F.startswith(label, F.lit("Between ")) | F.startswith(label, F.lit("Before ")), 0.85)
        .when(told & (size > 50), 1.15)
        .when(told, 1.05)
        .otherwise(0.95)
    )
    steps = F.startswith(label, F.lit("Step ")) | F.contains(label, F.lit("step by step")) | F.contains(label, F.lit("You are currently viewing:"))
    gone = F.contains(label, F.lit("disambiguation")) | F.contains(label, F.lit("(page does not exist)"))
    link = F.when(F.regexp_like(label, F.lit(r'^[\["^]')), 0.2).when(size < 30, 0.5).when(gone, 0.2).otherwise(0.7)
    return (
        F.when(role == "text", text)
        .when(role == "table", F.when(told, 1.15).otherwise(1.0))
        .when(role.isin("row", "cell", "definition"), 1.10)
        .when(role == "data", 1.15)
        .when(role == "heading", 0.95)
        .when(role == "listitem", F.when(steps, 0.3).otherwise(1.10))
        .when(role == "link", link)
        .when(role == "navigation", F.when(leaf, 0.5).otherwise(0.20))
        .when(role == "complementary", F.when(leaf, 0.4).otherwise(0.20))
        .when((role == "generic") & ~leaf & (size > 100), 0.6)
        .when(role.isin("main", "banner") & ~leaf, 0.7)
        .otherwise(1.0)
    )


def wrapper_loss(role: Column, label: Column) -> Column:
    """What structural nodes with gathered text, and very long labels, lose."""
    size, frame = F.octet_length(label), role.isin("generic", "table", "main", "banner", "complementary", "navigation")
    return F.when(frame & (size > 200), 0.20).when(size > 500, 0.15).when(frame & (size > 100), 0.10).when(size > 300, 0.08).otherwise(0.0)


def length_factor(label: Column, leaf: Column) -> Column:
    """How much long labels lower a score, sooner for nodes with children."""
    size = F.octet_length(label)
    alone = F.when(size > 1000, 0.7).when(size > 500, 0.85).otherwise(1.0)
    return F.when(leaf, alone).when(size > 500, 0.5).when(size > 200, 0.65).when(size > 100, 0.80).otherwise(1.0)


def blended(interaction: Column, hyper: Column, bm25: Column, role: Column, label: Column, leaf: Column) -> Column:
    """A node's score from its normalised late interaction, its hypervector's likeness, its BM25 score and its role, from 0 to 1."""
    raw = interaction * 0.40 + (hyper + 1) / 2 * 0.15 + lookup(role, TREE_PRIORITY, 0.2) * 0.15 + F.least(bm25 / 3.0, F.lit(1.0)) * 0.30
    raw = (raw - wrapper_loss(role, label)) * role_factor(role, label, leaf) * length_factor(label, leaf)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
