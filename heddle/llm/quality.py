"""Quality by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Ten overlapping labellers look at each text and vote good, bad or nothing. Votes are counted by
pattern over the whole table (at most 3 ** 10 patterns), and expectation-maximisation over the
patterns estimates how often each labeller is right on good and bad texts and the share of good ones.
The posterior is the label of a bounded sample of texts (about ``sample`` different rows, by a hash of doc_id and text) on which a
logistic scorer over hashed features is trained; the scorer then scores every whole text.

Defined results
---------------
* null or empty text: no votes but the length's; it is scored from the bias alone.
* very long texts count whole. If all labellers abstain everywhere, posteriors stay at the start value.
* repeated rows get one result row each and count in the statistics; an empty table gives an empty
  result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, documents, mix64, sampled, utf8
from heddle.llm.words import SPACES, salted, word_hashes

LABELLERS = (
    "symbols", "shouting", "exclaim", "pipes", "variety", "stutter", "common_words", "word_length", "stops", "length"
)
# Frequent function words of English, German, French and Spanish.
COMMON = (
    "the of and to in a is that it for on was with be as at by this are from or "
    "der die und das den von zu mit im ist nicht ein eine sich auf für des dem "
    "le la les de des et en que un une pour dans est qui du il pas sur "
    "el los las y por con del se su para al como más"
).split()
DIMS = 1 << 16


def _class(test: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in test]] = True
    return out


UPPER, LOWERS, DIGITS = (np.zeros(256, bool) for _ in range(3))
UPPER[65:91], LOWERS[97:123], DIGITS[48:58] = True, True, True
SYMBOLS, STOPS = _class("#$%&*@^~<>{}[]\\_="), _class(".,;?")


def statistics(body: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text: bytes by class, words, distinct words, repeated neighbours, common words."""

    def per_text(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    word, first = word_hashes(body, offsets)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    listed = np.isin(word, _common())
    order = np.lexsort((word, owner))
    w, o = word[order], owner[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    count = lambda mark, who: np.bincount(who, mark, len(n)).astype(np.int64)
    return {
        "ink": per_text(~SPACES[body]),
        "symbols": per_text(SYMBOLS[body]),
        "upper": per_text(UPPER[body]),
        "lower": per_text(LOWERS[body]),
        "exclaim": per_text(body == 33),
        "pipes": per_text(body == 124),
        "stops": per_text(STOPS[body]),
        "words": n,
        "distinct": count(fresh, o),
        "again": count(again, owner),
        "common": count(listed, owner),
    }


def _common() -> np.ndarray:
    body = "\n".join(COMMON).encode()
    return word_hashes(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers): 1 good, 0 bad, -1 no opinion."""
    words, ink = np.maximum(s["words"], 1), np.maximum(s["ink"], 1)
    letters = np.maximum(s["upper"] + s["lower"], 1)
    some, several, many = s["words"] > 0, s["words"] >= 5, s["words"] >= 20

    def vote(good: np.ndarray, bad: np.ndarray, on: np.ndarray) -> np.ndarray:
        return np.where(on & bad, 0, np.where(on & good, 1, -1))

    def over(value: np.ndarray, bad: float, on: np.ndarray) -> np.ndarray:
        return np.where(on & (value > bad), 0, -1)  # it knows one failure, and has no opinion on other texts

    size = s["ink"] / words
    out = [
        over(s["symbols"] / ink, 0.03, some),
        over(s["upper"] / letters, 0.5, some),
        over(s["exclaim"] / words, 0.1, some),
        over(s["pipes"] / words, 0.08, some),
        vote(s["distinct"] / words >= 0.35, (s["distinct"] / words < 0.15) & many, several),
        over(s["again"] / words, 0.2, many),
        vote(s["common"] / words >= 0.05, s["common"] / words < 0.01, several),
        vote((size >= 3) & (size <= 9), (size > 14) | (size < 2), some),
        vote(s["stops"] / words >= 0.02, s["stops"] / words < 0.002, several),
        vote(several, ~some, np.ones(len(words), bool)),
    ]
    return np.stack(out, axis=1).astype(np.int64)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ 3 ** np.arange(v.shape[1])


def votes_of(pattern: np.ndarray, n: int = len(LABELLERS)) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(n) % 3 - 1


# The starting chances of (no opinion, bad, good) on bad and on good texts; a bad vote is rare on good ones.
START = np.array([[0.35, 0.30, 0.35], [0.38, 0.02, 0.60]])


@dataclass
class LabelModel:
    """share: of good texts; says[c, l, v + 1]: chance that labeller l votes v on a text of class c (0 bad, 1 good)."""

    share: float
    says: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The chance that a text is good, from its votes."""
        ratio = np.log(self.says[1]) - np.log(self.says[0])
        log = np.log(self.share / (1 - self.share)) + sum(ratio[k, v[:, k] + 1] for k in range(v.shape[1]))
        return 1 / (1 + np.exp(-np.clip(log, -50, 50)))


def estimate(v: np.ndarray, weight: np.ndarray, rounds: int = 60, prior: float = 0.02) -> LabelModel:
    """Expectation-maximisation over vote patterns with their counts.

    The starting chances stay as a prior worth ``prior`` of the table in each class, which keeps the
    classes' meaning: failures are of many kinds, and each labeller knows one.
    """
    start = np.repeat(START[:, None, :], v.shape[1], axis=1)
    model = LabelModel(0.8, start)
    for _ in range(rounds if len(v) else 0):
        good = model.posterior(v)
        new = start * (1 + prior * weight.sum())
        for c, p in ((0, 1 - good), (1, good)):
            for k in range(v.shape[1]):
                new[c, k] += np.bincount(v[:, k] + 1, weight * p, 3)
        share = float(np.clip((weight * good).sum() / weight.sum(), 0.01, 0.99))
        model = LabelModel(share, new / new.sum(axis=2, keepdims=True))
    return model


# --- the hashed scorer -----------------------------------------------------------------------------------


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hashed feature, value): words, byte-class pairs and repeated neighbours, as shares of a text."""
    word, first = word_hashes(body, offsets)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    same = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) + 1
    kind = np.arange(256)
    kind[UPPER], kind[LOWERS], kind[DIGITS], kind[128:] = 65, 97, 48, 128
    code = kind[body].astype(np.uint64)
    size = np.diff(offsets)
    at = np.repeat(np.arange(len(size)), size)
    inner = np.flatnonzero(at[1:] == at[:-1]) if len(at) else np.zeros(0, np.int64)
    pair = mix64((code[inner] << np.uint64(8) | code[inner + 1]) + salted(11))
    parts = [
        (owner, mix64(word + salted(12)), 1 / np.maximum(n, 1)[owner]),
        (owner[same], np.full(len(same), salted(13)), 3 / np.maximum(n, 1)[owner[same]]),
        (at[inner], pair, 3 / np.maximum(size, 1)[at[inner]]),
    ]
    text, feat, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    return text, (feat % np.uint64(DIMS)).astype(np.int64), value


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = 12, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Logistic regression (Adagrad, soft labels) on (features, values, label)."""
    w, past, bias, past_b = np.zeros(DIMS), np.full(DIMS, 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(2)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, x, y = rows[i]
            g = 1 / (1 + np.exp(-np.clip(w[f] @ x + bias, -30, 30))) - y
            past[f] += (g * x) ** 2
            w[f] -= rate * g * x / np.sqrt(past[f])
            past_b += g * g
            bias -= rate * g / np.sqrt(past_b)
    return w, bias


def classify(docs: DataFrame, sample: int = 2000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, votes_good, votes_bad, posterior, score, keep) of each whole text."""
    rows = documents(docs)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_chunks(whole, "text", 2_000_000):
                p = pattern_of(votes(statistics(*utf8(batch["text"]))))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(p)], ["doc_id", "pattern"])

    seen = rows.mapInArrow(patterns, "doc_id long, pattern long").groupBy("pattern").count().collect()  # <= 3 ** 10 rows
    pattern = np.array([r["pattern"] for r in seen], np.int64)
    model = estimate(votes_of(pattern), np.array([r["count"] for r in seen], float))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_chunks(whole, "text", 2_000_000):
                body, offsets = utf8(batch["text"])
                good = model.posterior(votes(statistics(body, offsets)))
                text, feat, value = features(body, offsets)
                key, where = np.unique(text * DIMS + feat, return_inverse=True)
                sums = np.bincount(where, value, len(key))
                ends = np.searchsorted(key // DIMS, np.arange(len(good) + 1))
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
                    for x in ((key % DIMS).astype(np.int32), sums.astype(np.float32))
                ]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(good)], ["f", "x", "y"])

    share = min(1.0, sample / max(1, sum(r["count"] for r in seen)))
    picked = sampled(rows.select("doc_id", "text"), F.lit(int((1 << 40) * share)))
    found = picked.mapInArrow(examples, "f array<int>, x array<float>, y double").collect()  # about `sample` texts
    w, bias = fit(_order(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_chunks(whole, "text", 2_000_000):
                body, offsets = utf8(batch["text"])
                v = votes(statistics(body, offsets))
                text, feat, value = features(body, offsets)
                z = np.bincount(text, w[feat] * value, len(v)) + bias
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                columns = [(v == 1).sum(axis=1), (v == 0).sum(axis=1), model.posterior(v), p, p >= threshold]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], *map(pa.array, columns)],
                    ["doc_id", "votes_good", "votes_bad", "posterior", "score", "keep"],
                )

    return rows.mapInArrow(
        run,
        "doc_id long, votes_good long, votes_bad long, posterior double, score double, keep boolean",
    )


def _order(found: list) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Examples in an order that does not depend on the partitions."""
    rows = [(np.array(r["f"], np.int64), np.array(r["x"], np.float64), r["y"]) for r in found]
    return sorted(rows, key=lambda r: (r[2], len(r[0]), r[0][:8].tolist()))


def op1_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document's posterior, score and decision."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
