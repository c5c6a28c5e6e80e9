"""Personal data: fixed grammars plus a linear-chain conditional random field.

The grammars (email, ip, card, phone) are matched exactly on the whole text, in time linear in its
length. The field adds spans that they miss: numbers in national formats, spelled-out addresses. It
labels the tokens around every digit, ``@``, bracketed "at", and spelled-out "at" before a dotted or spelled-out
domain, in any case and with any ending (no form of the labelled table is without one), with B/I tags by Viterbi in padded numpy batches. Its weights, over word-shape features
of the token and of two neighbours at either side, are trained by gradient steps on the conditional
likelihood of a small labelled table that a rule makes. A decoded span stays if it passes its
kind's digit or part count and touches no span of the grammars.

Defined results
---------------
* null or empty text: no spans; counts 0, empty span lists.
* very long texts: whole; long stretches of tokens are decoded in overlapping blocks. A span belongs to the block
  in whose middle it starts; one that reaches a block's end has its whole stretch decoded in one pass.
* spans are ordered by start, then email, ip, card, phone; ties within a kind do not occur.
* repeated rows get one result row each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from heddle.llm.common import byte_chunks, documents, typed

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does: the lookbehind keeps the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SEED = re.compile(r"[0-9@]|(?i:[\[(]at[\])]|\bat\s+[\w-]+(?:\.|\s+dot\s+)\w)")
#: Tokens of a block, and those at its either end that only give context.
LONGEST, MARGIN = 400, 64
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: found from the @ signs outwards."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """The grammars' spans, ordered."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- features ----------------------------------------------------------------------------------------

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
# Words that tell kinds apart.
CUES = frozenset(
    "at dot com org net edu co tel phone call mobile fax email mail card visa ip server host "
    "isbn order ref invoice id no number item items sku part serial page".split()
)
REACH = 2


def shape(text: str, start: int, end: int) -> str:
    """The word-shape feature of a token: what stands there, how long, and whether a space precedes."""
    word = text[start:end]
    gap = "_" if start == 0 or text[start - 1].isspace() else ""
    if word[0] in "0123456789":
        return f"{gap}9{min(len(word), 7)}"
    if word.isalpha():
        low = word.lower()
        if low in CUES:
            return gap + low
        case = "X" if word.isupper() else "Xx" if word[0].isupper() else "x"
        return f"{gap}{case}{min(len(word), 4)}"
    return gap + (word if word in ".-()+@,:/[]=#%$_" else "?")


@dataclass
class Field:
    """weights[o]: (features, labels) for the token at distance o - REACH; move: label to label; start: first label."""

    number: dict[str, int]
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def emit(self, feats: np.ndarray) -> np.ndarray:
        """(n, t, labels) of padded feature numbers (n, t); 0 is padding and the unseen shape."""
        n, t = feats.shape
        wide = np.zeros((n, t + 2 * REACH), np.int64)
        wide[:, REACH : REACH + t] = feats
        return sum(self.weights[o][wide[:, o : o + t]] for o in range(2 * REACH + 1))


def viterbi(emit: np.ndarray, size: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label sequence of each padded row (n, t, labels)."""
    n, t, _ = emit.shape
    score = emit[:, 0] + start
    back = np.zeros((n, t, emit.shape[2]), np.int8)
    for k in range(1, t):
        way = score[:, :, None] + move
        back[:, k] = way.argmax(axis=1)
        on = (k < size)[:, None]
        score = np.where(on, way.max(axis=1) + emit[:, k], score)
    path = np.zeros((n, t), np.int8)
    now = score.argmax(axis=1)
    for k in range(t - 1, -1, -1):
        on = k < size
        path[on, k] = now[on]
        now = np.where(on & (k > 0), back[np.arange(n), k, now], now)
    return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(rows: list[tuple[str, list[Span]]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum conditional likelihood by forward-backward and Adagrad over the whole labelled table."""
    seqs, number = [], {"": 0}
    for text, spans in rows:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        label = []
        for a, _ in tokens:
            hit = next((s for s in spans if s[0] <= a < s[2]), None)
            label.append(0 if hit is None else 1 + 2 * hit[1] + (a > hit[0]))
        seqs.append(([number.setdefault(shape(text, *s), len(number)) for s in tokens], label))
    n, t, n_labels = len(seqs), max(len(f) for f, _ in seqs), len(LABELS)
    feats, gold, size = np.zeros((n, t), np.int64), np.zeros((n, t), np.int64), np.array([len(f) for f, _ in seqs])
    for i, (f, y) in enumerate(seqs):
        feats[i, : len(f)], gold[i, : len(y)] = f, y
    on = np.arange(t) < size[:, None]
    field = Field(
        number, np.zeros((2 * REACH + 1, len(number), n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    )
    wide = np.zeros((n, t + 2 * REACH), np.int64)
    wide[:, REACH : REACH + t] = feats
    params = [field.weights, field.move, field.start]
    past = [np.full_like(p, 1e-3) for p in params]
    for _ in range(rounds):
        emit = field.emit(feats)
        a, b = np.zeros_like(emit), np.zeros_like(emit)
        a[:, 0] = emit[:, 0] + field.start
        for k in range(1, t):
            a[:, k] = np.where(on[:, k, None], _lse(a[:, k - 1][:, :, None] + field.move, 1) + emit[:, k], a[:, k - 1])
        for k in range(t - 2, -1, -1):
            ahead = _lse(field.move + (emit[:, k + 1] + b[:, k + 1])[:, None, :], 2)
            b[:, k] = np.where(on[:, k + 1, None], ahead, 0)
        z = _lse(a[:, -1], 1)
        error = np.exp(a + b - z[:, None, None]) * on[:, :, None]
        np.subtract.at(error, (np.arange(n)[:, None], np.arange(t), gold), on.astype(float))
        g_w, g_m = np.zeros_like(field.weights), np.zeros_like(field.move)
        for o in range(2 * REACH + 1):
            np.add.at(g_w[o], wide[:, o : o + t], error)
        for k in range(1, t):
            both = a[:, k - 1][:, :, None] + field.move + (emit[:, k] + b[:, k])[:, None, :] - z[:, None, None]
            g_m += (np.exp(both) * on[:, k, None, None]).sum(axis=0)
            np.subtract.at(g_m, (gold[on[:, k], k - 1], gold[on[:, k], k]), 1.0)
        g_w[:, 0] = 0  # the unseen shape keeps no weight
        for p, g, s in zip(params, (g_w, g_m, error[:, 0].sum(axis=0)), past, strict=True):
            g = g / n + decay * p
            s += g * g
            p -= rate * g / np.sqrt(s)
    return field


# Words before a number that is not personal.
LABELLED = ("isbn", "order", "ref", "invoice", "id", "no", "item", "sku", "part", "serial", "number", "page")

# --- the labelled table ----------------------------------------------------------------------------


def labelled(n: int = 600, seed: int = 4) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences with one marked item or a look-alike, made by a rule."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda a=2, b=9: "".join(map(chr, rng.integers(97, 123, int(rng.integers(a, b)))))

    def card() -> str:
        body = "4" + num(14)
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick([".", "-", " "])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def name() -> str:
        return pick([word(), word(), word() + pick(["_", ".", "-"]) + word()])

    items = (
        (3, lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (3, lambda: pick(["-", ".", " "]).join([num(3), num(3), num(4)])),
        (3, lambda: f"00{num(2)} {num(3)} {num(3)} {num(4)}"),
        (0, lambda: f"{name()}{pick([' at ', ' (at) ', ' [at] '])}{word()}{pick([' dot ', '.'])}{pick(['com', 'org', 'net'])}"),
        (0, lambda: f"{name()}{pick(['(at)', '[at]', '(AT)', ' at '])}{word()}{pick(['.co.uk', '.com', '.edu', '.ac.at'])}"),
        (0, lambda: f"{word()}.{num(2)} @ {word()}.{pick(['com', 'org'])}"),
        (2, card),
        (1, lambda: " . ".join(str(int(x)) for x in rng.integers(1, 255, 4))),
    )
    sep = lambda: pick(["-", ".", " "])
    others = (
        lambda: f"20{num(2)}-{num(2)}-{num(2)}",
        lambda: f"{num(2)}.{num(2)}.20{num(2)}",
        lambda: f"{num(1)}.{num(1)}.{num(1)}",
        lambda: f"{num(2)},{num(3)}.{num(2)}",
        lambda: f"${num(3)}.{num(2)}",
        lambda: f"{num(2)}:{num(2)}",
        lambda: f"{num(3)}-{num(3)}",
        lambda: num(int(rng.integers(1, 13))),
        lambda: f"{num(2)}%",
        lambda: "AKIA" + num(3) + word().upper() + num(2),
        lambda: f"{word()}={word(2, 5)}{num(4)}{word(2, 5)}",
        lambda: f"{num(3)} {num(3)}",
        lambda: f"{word()}@{word()}",
        # numbers that the word before tells from phones
        lambda: f"{pick(LABELLED)}{sep()}{sep().join([num(3), num(3), num(4)])}{pick(['', ' items', ' invoice'])}",
        lambda: f"{pick(LABELLED)} 978{pick([' ', '-'])}{num(3)} {num(3)} {num(4)}",
    )
    out: list[tuple[str, list[Span]]] = []
    for i in range(n):
        before = " ".join(word().capitalize() if rng.random() < 0.2 else word() for _ in range(int(rng.integers(0, 5))))
        after = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        cue = pick(["", "", "call ", "tel ", "card ", "mail ", "phone: "])
        head = (before + " " if before else "") + cue
        if i % 2:
            kind, make = items[i // 2 % len(items)]
            body = make()
            span = [(len(head), kind, len(head) + len(body))]
        else:
            body, span = pick(others)(), []
        out.append((head + body + pick(["", ".", ","]) + (" " + after if after else ""), span))
    return out


@lru_cache
def trained() -> Field:
    """The field of the labelled table; made once in a process, always the same."""
    return fit(labelled())


# --- decoding ----------------------------------------------------------------------------------------


def windows(text: str, reach: int = 48) -> list[tuple[int, int]]:
    """Stretches of text around the seeds, widened to white space."""
    out: list[list[int]] = []
    for m in SEED.finditer(text):
        a, b = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    wide: list[tuple[int, int]] = []
    for i, (a, b) in enumerate(out):
        floor, roof = wide[-1][1] if wide else 0, out[i + 1][0] if i + 1 < len(out) else len(text)
        while a > floor and not text[a - 1].isspace():
            a -= 1
        while b < roof and not text[b].isspace():
            b += 1
        if wide and a == floor:
            wide[-1] = (wide[-1][0], b)
        else:
            wide.append((a, b))
    return wide


def plausible(kind: int, text: str) -> bool:
    """Whether a decoded span has its kind's parts."""
    d = digits_of(text)
    if kind == 0:
        return bool(re.fullmatch(r"(?i)\S+\s*(?:@|\bat\b|\(at\)|\[at\])\s*[\w-]+(?:\s*(?:\.|\bdot\b)\s*[\w-]+)+", text))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(d) <= 19 and luhn(d) if kind == 2 else 10 <= len(d) <= 15


def blocks(n: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) over n tokens: blocks with overlap, and the middle of each; middles cover all."""
    if n <= LONGEST:
        return [(0, n, 0, n)]
    step = LONGEST - 2 * MARGIN
    return [(max(0, k - MARGIN), min(n, k + step + MARGIN), k, min(n, k + step)) for k in range(0, n, step)]


def field_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """The further spans of each text: Viterbi over its windows, batched by length."""
    whole = [(i, [m.span() for m in TOKEN.finditer(text, a, b)]) for i, text in enumerate(texts) for a, b in windows(text)]
    todo = [(w, *block) for w, (_, tokens) in enumerate(whole) for block in blocks(len(tokens))]
    tagged: list[list[tuple[int, int, int]]] = [[] for _ in whole]  # first token, kind, end
    again: set[int] = set()
    decode(texts, whole, todo, field, tagged, again)
    for w in again:
        tagged[w] = []
    for w in again:  # one at a time: such a stretch may be long
        n = len(whole[w][1])
        decode(texts, whole, [(w, 0, n, 0, n)], field, tagged, set())
    found: list[list[Span]] = [[] for _ in texts]
    for (i, tokens), spans in zip(whole, tagged, strict=True):
        past = 0
        for k, kind, stop in sorted(spans):
            a, b = tokens[k][0], tokens[stop - 1][1]
            if k >= past and plausible(kind, texts[i][a:b]) and not any(s[0] < b and a < s[2] for s in base[i]):
                found[i].append((a, kind, b))
            past = max(past, stop)
    return found


def decode(texts: list[str], whole: list, todo: list, field: Field, tagged: list, again: set[int]) -> None:
    """Adds each block's spans to ``tagged``; stretches with a span that may go on beyond its block come into ``again``."""
    todo.sort(key=lambda p: p[2] - p[1])
    for at in range(0, len(todo), 256):
        some = todo[at : at + 256]
        size = np.array([end - start for _, start, end, _, _ in some])
        feats = np.zeros((len(some), int(size.max(initial=1))), np.int64)
        for row, (w, start, end, _, _) in enumerate(some):
            i, tokens = whole[w]
            feats[row, : end - start] = [field.number.get(shape(texts[i], *s), 0) for s in tokens[start:end]]
        path = viterbi(field.emit(feats), size, field.move, field.start)
        for row, (w, start, end, first, last) in enumerate(some):
            k = 0
            while k < end - start:
                tag = int(path[row, k])
                if tag == 0:
                    k += 1
                    continue
                kind, stop = (tag - 1) // 2, k + 1
                while stop < end - start and path[row, stop] == 2 + 2 * kind:
                    stop += 1
                if first <= start + k < last:
                    tagged[w].append((start + k, kind, start + stop))
                    if start + stop == end < len(whole[w][1]):
                        again.add(w)
                k = stop


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added, redacted) of each whole text.

    The counts and base_sha256 are of the grammars' spans; spans lists all, added counts the field's.
    The further columns asked for come last.
    """
    field = trained()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "added", "redacted", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_chunks(whole, "text", 4_000_000):
                texts = batch["text"].to_pylist()
                base = [base_spans(t) if SEED.search(t) else [] for t in texts]
                added = field_spans(texts, base, field)
                both = [sorted(a + b) if b else a for a, b in zip(base, added, strict=True)]
                count = np.array([np.bincount([k for _, k, _ in s], minlength=4) for s in base]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"],
                        *(pa.array(count[:, k], pa.int64()) for k in range(4)),
                        pa.array([hashlib.sha256(join_spans(s).encode()).hexdigest() for s in base], pa.string()),
                        pa.array(list(map(join_spans, both)), pa.string()),
                        pa.array([len(m) for m in added], pa.int64()),
                        pa.array(list(map(redact, texts, both)), pa.string()),
                        *(batch[c] for c in more),
                    ],
                    names,
                )

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    kinds = "".join(f", {c} {k}" for c, k in typed(docs, more))
    shape_ = f"doc_id long, {counts}, base_sha256 string, spans string, added long, redacted string{kinds}"
    return documents(docs, *more).mapInArrow(run, shape_)


def op5_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")
