"""Language identification with a byte convolutional network.

The network: a byte embedding (A-Z as a-z), filters of widths 2, 3 and 4, a rectifier, max pooling
over a fixed-length window and a softmax over the learned languages. It is trained in numpy by
gradient steps on windows of a bounded, stratified sample of labelled texts (about ``per_lang`` rows of each
language, by a threshold on a hash of doc_id; ``windows`` windows of each). Applied, each text is cut into all
its windows (none is left out); the window logits are averaged. For speed the filters of a trained
network become lookup tables over bytes and byte pairs, which give the same sums.

Defined results
---------------
* null text, or a text without letters: ``und`` with score 0; so is everything if nothing is labelled.
* very long texts: all windows count. Short ones: one window, filled up with zero bytes.
* ties between languages go to the first by name; repeated rows get one result row each; an empty
  table gives an empty result; further columns are ignored. Null ``lang`` rows are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, crc_mod, sampled, typed, utf8

STEP = 128
WIDTHS = (2, 3, 4)
REACH = STEP + max(WIDTHS) - 1
LETTER = re.compile(r"[^\W\d_]")
FOLD = np.arange(256)
FOLD[65:91] += 32


@dataclass
class Network:
    langs: list[str]
    emb: np.ndarray  # (256, d)
    filters: list[np.ndarray]  # per width (width * d, f)
    bias: list[np.ndarray]
    out: np.ndarray  # (filters, langs)
    out_bias: np.ndarray

    def columns(self, rows: np.ndarray, width: int) -> np.ndarray:
        """(n, STEP, width * d): the embedded bytes under each filter position."""
        x = self.emb[FOLD[rows]]
        return np.concatenate([x[:, k : k + STEP] for k in range(width)], axis=2)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Per width: a table over pairs of bytes, and one over what follows (bytes or pairs)."""
        emb, out = self.emb[FOLD], []
        d = emb.shape[1]
        for w, k, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            part = [(emb @ k[i * d : (i + 1) * d]).astype(np.float32) for i in range(w)]
            pair = (part[0][:, None] + part[1][None] + b).reshape(65536, -1).astype(np.float32)
            rest = None if w == 2 else part[2] if w == 3 else (part[2][:, None] + part[3][None]).reshape(65536, -1)
            out.append((pair, rest))
        return out


def train(rows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 6, seed: int = 1) -> Network:
    """Gradient descent (Adam) on windows (n, REACH) of bytes."""
    rng = np.random.default_rng(seed)
    d, f, n_out = 8, 16, len(langs)
    net = Network(
        langs,
        rng.normal(0, 0.5, (256, d)),
        [rng.normal(0, 1 / np.sqrt(w * d), (w * d, f)) for w in WIDTHS],
        [np.zeros(f) for _ in WIDTHS],
        rng.normal(0, 0.1, (f * len(WIDTHS), n_out)),
        np.zeros(n_out),
    )
    params = [net.emb, *net.filters, *net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            pick = order[at : at + 128]
            x, y, n = rows[pick], labels[pick], len(pick)
            feats, places, cols = [], [], []
            for w, k, b in zip(WIDTHS, net.filters, net.bias, strict=True):
                c = net.columns(x, w)
                z = c @ k + b
                p = z.argmax(axis=1)
                places.append(p)
                cols.append(c)
                feats.append(np.maximum(np.take_along_axis(z, p[:, None], 1)[:, 0], 0))
            h = np.concatenate(feats, axis=1)
            logit = h @ net.out + net.out_bias
            q = np.exp(logit - logit.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(n), y] -= 1
            q /= n
            gh = (q @ net.out.T) * (h > 0)
            g_emb, g_k, g_b = np.zeros_like(net.emb), [], []
            for i, w in enumerate(WIDTHS):
                g = gh[:, i * f : (i + 1) * f]
                seen = np.take_along_axis(cols[i], places[i][:, :, None], 1)  # (n, f, w * d)
                g_k.append(np.einsum("nf,nfc->cf", g, seen))
                g_b.append(g.sum(axis=0))
                back = g[:, :, None] * net.filters[i].T[None]  # (n, f, w * d)
                for k in range(w):
                    byte = FOLD[x[np.arange(n)[:, None], places[i] + k]]
                    np.add.at(g_emb, byte, back[:, :, k * d : (k + 1) * d])
            grads = [g_emb, *g_k, *g_b, h.T @ q, q.sum(axis=0)]
            t += 1
            for p, g, a, c in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                c += 0.001 * (g * g - c)
                p -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
    return net


class Scorer:
    """Window logits averaged per text, by the trained network's tables."""

    def __init__(self, net: Network):
        self.net, self.tables = net, net.tables()
        self.out = net.out.astype(np.float32)

    def logits(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        windows = np.maximum(1, -(-size // STEP))
        first = np.concatenate([[0], np.cumsum(windows)])
        total = int(first[-1])
        # each text starts at a window; zero bytes fill its last one
        laid = np.zeros(total * STEP + 4, np.uint8)
        laid[np.arange(len(body)) + np.repeat(first[:-1] * STEP - offsets[:-1], size)] = body
        sums = np.empty((total, len(self.out)), np.float32)
        for a in range(0, total, 512):
            b = min(total, a + 512)
            x = laid[a * STEP : b * STEP + 3].astype(np.int32)
            pair = x[:-1] << 8 | x[1:]
            n, at = (b - a) * STEP, 0
            for w, (two, rest) in zip(WIDTHS, self.tables, strict=True):
                z = two[pair[:n]]
                if w == 3:
                    z += rest[x[2 : n + 2]]
                elif w == 4:
                    z += rest[pair[2 : n + 2]]
                f = z.shape[1]
                sums[a:b, at : at + f] = z.reshape(b - a, STEP, f).max(axis=1)
                at += f
        found = np.maximum(sums, 0) @ self.out + self.net.out_bias
        return np.add.reduceat(found, first[:-1], axis=0) / windows[:, None]


def sample_windows(docs: DataFrame, per_lang: int, windows: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of about ``per_lang`` texts of each language, those whose hash of doc_id and text is below the language's threshold.

    A row that is repeated is taken once, so that neither one text nor rows without a doc_id can fill the sample.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = rows.groupBy("lang").count().collect()  # a row for each language, as the network's output has
    if not counts:
        return np.zeros((0, REACH), np.uint8), np.zeros(0, np.int64), []
    least = {r["lang"]: int((1 << 40) * min(1.0, per_lang / r["count"])) for r in counts}
    limit = F.create_map(*(F.lit(x) for pair in least.items() for x in pair))[F.col("lang")]
    picked = sampled(rows.select("doc_id", "lang", "text"), limit)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bytes]] = []
            for lang, key, text in zip(*(batch[c].to_pylist() for c in ("lang", "_key", "text")), strict=True):
                if not LETTER.search(text):
                    continue
                raw, rng = text.encode(), np.random.default_rng(key & (1 << 63) - 1)
                for k in range(windows):
                    at = int(rng.integers(0, max(1, len(raw) - REACH + 1)))
                    size = REACH if k % 2 == 0 else int(rng.integers(12, REACH + 1))  # short texts occur too
                    out.append((lang, raw[at : at + size].ljust(REACH, b"\0")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())],
                ["lang", "bytes"],
            )

    found = picked.select("_key", "lang", "text").mapInArrow(cut, "lang string, bytes binary").collect()
    found = sorted((r["lang"], bytes(r["bytes"])) for r in found)
    langs = sorted({a for a, _ in found})
    number = {a: i for i, a in enumerate(langs)}
    body = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, REACH)
    return body, np.array([number[a] for a, _ in found], np.int64), langs


def learn(docs: DataFrame, per_lang: int = 400, windows: int = 4) -> Network | None:
    """The network trained on the labelled rows of ``docs`` (doc_id, text, lang); None if there are none."""
    rows, labels, langs = sample_windows(docs, per_lang, windows)
    return train(rows, labels, langs) if langs else None


def identify(docs: DataFrame, net: Network | None, *more: str) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text, and the further columns asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net) if net else None
        for whole in batches:
            for batch in byte_chunks(whole, "text", 1_000_000):
                texts = batch["text"].to_pylist()
                known = np.array([bool(scorer and t and LETTER.search(t)) for t in texts])
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if known.any():
                    logit = scorer.logits(*utf8(batch["text"]))
                    q = np.exp(logit - logit.max(axis=1, keepdims=True))
                    q /= q.sum(axis=1, keepdims=True)
                    best = q.argmax(axis=1)
                    pred[known] = np.array(net.langs, object)[best[known]]
                    score[known] = q[np.arange(len(best)), best][known]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.array(pred, pa.string()), pa.array(score), *(batch[f"more_{c}"] for c in more)],
                    ["doc_id", "lang_pred", "score", *more],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c).alias(f"more_{c}") for c in more))
    kinds = "".join(f", {c} {k}" for c, k in typed(docs, more))
    return rows.mapInArrow(run, f"doc_id long, lang_pred string, score double{kinds}")


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: learns from documents whose crc32 of doc_id mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = crc_mod("doc_id", 4) == 2
    found = identify(docs, learn(docs.filter(~held)))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
