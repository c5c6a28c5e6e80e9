"""Log-bilinear language model trained with noise-contrastive estimation.

Counts of all training words are summed over the whole corpus. The ``own`` most frequent words (and
the end mark) are outcomes of the model themselves; every other word belongs to one of ``buckets``
outcomes by a hash of its last bytes, and has its smoothed share of its bucket's count there. The
model predicts the next outcome from the two before it: score(w | h) = (u1[h1] + u2[h2]) . r[w] + b[w],
where u1, u2 are the context words' vectors times each position's matrix. Training texts are dealt into shards and
rounds by a hash of the row, so that the model does not depend on how the input is partitioned. In each round every
shard goes on from the model of the round before, trains on all its texts of the round, in a fixed order, by
noise-contrastive estimation in numpy, and the shards' parameters are averaged by their tokens. Normalisers of all contexts come from batched matrix products, so that the scores are
true log-probabilities over the seen words and one unseen word in each bucket.

Rare words' counts are joined by shuffle; the frequent ones, a bounded number and the only ones that could make a
join key hot, are looked up in the task.

Defined results
---------------
* null or empty text: the end token alone. Very long texts are scored whole.
* no training text: N = V = 0, base scores are 0 and the model scores as it was initialised.
* ties in counts break by the word; repeated rows count and are scored each; an empty table gives an
  empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, crc_mod, materialise, most_frequent

END = b""
OWN, BUCKETS, DIM = 832, 192, 16
CLASSES = OWN + BUCKETS
START = CLASSES  # context before the first token
LOOKUP = 65_536
BATCH, NOISE = 2048, 48
#: Rounds of training; times that a shard goes over each pool of a round, whatever its size; tokens shuffled at once.
ROUNDS, PASSES, POOL = 3, 2, 1 << 18
SLICE = 256


def words_of(text: str) -> list[bytes]:
    """A text's words with A-Z lower-cased; bytes part at [\\x20\\x09-\\x0D] just as asked."""
    return text.encode().lower().split()


def bucket_of(word: bytes) -> int:
    return OWN + crc32(word[-3:]) % BUCKETS


# --- counts ------------------------------------------------------------------------------------------


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word binary, n long) over all texts; the end mark is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"]
            )
            seen.clear()
            return out

        for batch in batches:
            for text in batch["text"]:
                seen.update(words_of(text.as_py() or ""))
                seen[END] += 1
                if len(seen) > 500_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task needs to know of the counts; bounded by LOOKUP words."""

    total: int  # N
    distinct: int  # V
    words: list[bytes]  # most frequent first
    counts: np.ndarray
    mass: np.ndarray  # smoothed count of each outcome

    @property
    def base(self) -> float:
        """log10 of the base model's denominator."""
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def outcomes(self) -> np.ndarray:
        """The outcome of each listed word."""
        out = np.arange(len(self.words))
        for i in range(OWN, len(self.words)):
            out[i] = bucket_of(self.words[i])
        return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals, the most frequent words and the outcomes' mass from a written table of counts."""
    bucket = F.lit(OWN) + F.crc32(F.substring("word", -3, 3)) % F.lit(BUCKETS)
    sums = counts.groupBy(bucket.cast("int").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    top = most_frequent(counts, LOOKUP)
    words, n = [w for w, _ in top], np.array([c for _, c in top], np.int64)
    mass = np.full(CLASSES, 0.5)
    for r in sums:
        mass[r["k"]] += r["n"] + 0.5 * r["v"]
    for i, w in enumerate(words[:OWN]):
        mass[bucket_of(w)] -= n[i] + 0.5
        mass[i] = n[i] + 0.5
    return Vocabulary(sum(r["n"] for r in sums), sum(r["v"] for r in sums), words, n, mass)


# --- texts as outcomes ---------------------------------------------------------------------------------


@dataclass
class Coded:
    outcome: np.ndarray
    known: np.ndarray  # index into the listed words, -1 for others
    first: np.ndarray  # where each text's tokens begin, and the total
    rare: list[list[bytes]]


class Coder:
    def __init__(self, vocab: Vocabulary):
        self.index = {w: i for i, w in enumerate(vocab.words)}
        self.outcomes = vocab.outcomes()

    def __call__(self, texts: list[str | None]) -> Coded:
        get, tokens, size = self.index.get, [], []
        for t in texts:
            some = words_of(t or "")
            some.append(END)
            tokens += some
            size.append(len(some))
        known = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
        first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        other = np.flatnonzero(known < 0)
        outcome = self.outcomes[known] if len(self.outcomes) else np.zeros(len(known), np.int64)
        lost = [tokens[i] for i in other.tolist()]
        outcome[other] = OWN + np.fromiter((crc32(w[-3:]) for w in lost), np.int64, len(lost)) % BUCKETS
        cut = np.searchsorted(other, first).tolist()
        return Coded(outcome, known, first, [lost[a:b] for a, b in zip(cut, cut[1:], strict=False)])


def contexts(outcome: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes one and two places before each token, START before a text."""
    one = np.concatenate([[START], outcome[:-1]])
    two = np.concatenate([[START], one[:-1]])
    begin = first[:-1]
    one[begin], two[begin] = START, START
    second = begin[np.diff(first) > 1] + 1
    two[second] = START
    return one, two


# --- the model -----------------------------------------------------------------------------------------


def initial(vocab: Vocabulary, seed: int = 7) -> list[np.ndarray]:
    """u1, u2 (contexts), r (outcomes), b: the same in every task; b starts at the outcomes' log share."""
    rng = np.random.default_rng(seed)
    shape = ((CLASSES + 1, DIM), (CLASSES + 1, DIM), (CLASSES, DIM))
    out = [rng.normal(0, 0.1, s).astype(np.float32) for s in shape]
    return [*out, np.log(vocab.mass / vocab.mass.sum()).astype(np.float32)]


def _sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different indices, the sum of each one's rows)."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    key = index.take(order)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pairs = rows.take(order, axis=0).view(np.complex64)  # adds two numbers at a time
    return key[start], np.add.reduceat(pairs, start, axis=0).view(np.float32)


class Trainer:
    """Noise-contrastive steps (Adagrad) on batches of (context, context, outcome).

    The vectors u1, u2 and r stand in one array, so that a step gathers, sums and changes the rows it meets at once.
    """

    def __init__(self, vocab: Vocabulary, start: list[np.ndarray], seed: int, rate: float = 0.1):
        *vectors, self.b = (x.copy() for x in start)
        self.w = np.concatenate(vectors)
        self.past, self.past_b = np.full_like(self.w, 1e-4), np.full_like(self.b, 1e-4)
        self.rate, self.rng = np.float32(rate), np.random.default_rng(seed)
        share = vocab.mass / vocab.mass.sum()
        self.steps, self.cum = 0, np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.scores = np.empty((BATCH, NOISE), np.float32)

    @property
    def p(self) -> list[np.ndarray]:
        """u1, u2, r, b as they are now."""
        return [*np.split(self.w, [CLASSES + 1, 2 * (CLASSES + 1)]), self.b]

    def step(self, places: np.ndarray, outcome: np.ndarray) -> None:
        """``places``: (3, n) rows of u1, u2 and r within the one array."""
        n, b, log_noise = len(outcome), self.b, self.log_noise
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), CLASSES - 1)
        at = np.concatenate([places.ravel(), noise + 2 * (CLASSES + 1)])
        rows = self.w.take(at, axis=0)
        q, rw, rn = rows[:n] + rows[n : 2 * n], rows[2 * n : 3 * n], rows[3 * n :]
        good = np.einsum("nd,nd->n", q, rw) + (b - log_noise).take(outcome)
        # derivative of the loss by each score: data pulls up, noise pushes down
        up = np.float32(-1 / n) / (1 + np.exp(np.minimum(good, 30)))
        down = np.matmul(q, -rn.T, out=self.scores[:n])
        down += log_noise[noise] - b[noise]
        np.exp(np.minimum(down, 30, out=down), out=down)
        down += 1
        np.divide(np.float32(1 / n), down, out=down)
        change = np.empty_like(rows)
        np.add(up[:, None] * rw, down @ rn, out=change[:n])
        change[n : 2 * n] = change[:n]
        np.multiply(up[:, None], q, out=change[2 * n : 3 * n])
        np.matmul(down.T, q, out=change[3 * n :])
        key, g = _sums(at, change)  # rows without a gradient stay as they are
        past = self.past.take(key, axis=0) + g * g
        self.past[key] = past
        self.w[key] -= self.rate * g / np.sqrt(past)
        g = (np.bincount(outcome, up, CLASSES) + np.bincount(noise, np.ones(n, np.float32) @ down, CLASSES)).astype(np.float32)
        self.past_b += g * g
        b -= self.rate * g / np.sqrt(self.past_b)
        self.steps += 1


def shard_count(tokens: int) -> int:
    """Shards grow with the root of the corpus: so do the tokens of each."""
    return max(1, int(np.sqrt(tokens / 20_000)))


def coded_rows(docs: DataFrame, vocab: Vocabulary, *more: str) -> DataFrame:
    """A written table of each text's tokens as outcomes, with all that a score takes from its words.

    (_row, doc_id, shard, turn, key, outcomes, n_tokens, n_known, base, inner, rare) and the further columns asked for: shard,
    turn and key are its place in training by a hash of the row; base sums log10 of the listed words' counts, inner of
    their shares of their outcomes; rare are the words to be joined.
    """
    names = ["_row", "doc_id", "shard", "turn", "key", "outcomes", "n_tokens", "n_known", "base", "inner", "rare", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = Coder(vocab), TaskContext.get().partitionId() << 33
        log_count = np.append(np.log10(vocab.counts + 0.5), 0.0)  # the last: words to be joined
        log_mass = np.log10(vocab.mass)
        for whole in batches:
            for batch in byte_chunks(whole, "text", 1_000_000):
                coded = coder(batch["text"].to_pylist())
                out = coded.outcome.astype(np.uint16)
                texts = pa.array([out[a:b].tobytes() for a, b in zip(coded.first, coded.first[1:], strict=False)], pa.binary())
                seen = log_count[coded.known]
                inner = np.where(coded.outcome < OWN, 0.0, seen - log_mass[coded.outcome])
                at, n = coded.first[:-1], len(coded.first) - 1
                columns = [
                    pa.array(np.arange(row, row + n), pa.int64()),
                    *(batch[c] for c in ("doc_id", "shard", "turn", "key")),
                    texts,
                    pa.array(np.diff(coded.first), pa.int64()),
                    pa.array(np.add.reduceat((coded.known >= 0).astype(np.int64), at), pa.int64()),
                    pa.array(np.add.reduceat(seen, at)),
                    pa.array(np.add.reduceat(inner, at)),
                    pa.array(coded.rare, pa.list_(pa.binary())),
                    *(batch[c] for c in more),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)
                row += n

    key = F.xxhash64("doc_id", "text")
    shard = F.pmod(key, F.lit(shard_count(vocab.total))).cast("int").alias("shard")
    turn = F.pmod(F.shiftright(key, 40), F.lit(ROUNDS)).cast("int").alias("turn")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    rows = rows.select("doc_id", "text", *more, shard, turn, key.alias("key"))
    shape = "_row long, doc_id long, shard int, turn int, key long, outcomes binary, n_tokens long, n_known long"
    shape += ", base double, inner double, rare array<binary>" + "".join(f", {c} {dict(docs.dtypes)[c]}" for c in more)
    return materialise(docs.sparkSession, rows.mapInArrow(run, shape), "coded")


class Part:
    """One shard of one round: steps over pools of its tokens, in the order in which they come."""

    def __init__(self, trainer: Trainer):
        self.trainer, self.tokens, self.open, self.size = trainer, 0, [], 0

    def add(self, text: bytes) -> None:
        self.open.append(np.frombuffer(text, np.uint16).astype(np.int64))
        self.size += len(self.open[-1])
        if self.size >= POOL:
            self.close()

    def close(self) -> None:
        if not self.open:
            return
        first = np.concatenate([[0], np.cumsum([len(x) for x in self.open])]).astype(np.int64)
        outcome = np.concatenate(self.open)
        one, two = contexts(outcome, first)
        places = np.stack([one, two + CLASSES + 1, outcome + 2 * (CLASSES + 1)])
        self.tokens, self.open, self.size = self.tokens + len(outcome), [], 0
        for _ in range(PASSES):
            order = self.trainer.rng.permutation(len(outcome))
            mixed, mixed_outcome = places.take(order, axis=1), outcome.take(order)
            for a in range(0, len(order), BATCH):
                self.trainer.step(mixed[:, a : a + BATCH], mixed_outcome[a : a + BATCH])

    def finish(self) -> list[np.ndarray]:
        """The parameters after the last pool."""
        self.close()
        return self.trainer.p


def train(docs: DataFrame, vocab: Vocabulary) -> list[np.ndarray]:
    """The parameters after all rounds."""
    return train_coded(coded_rows(docs, vocab), vocab)


def train_coded(coded: DataFrame, vocab: Vocabulary) -> list[np.ndarray]:
    """``train`` for rows of a table of ``coded_rows``."""
    model = initial(vocab)
    for turn in range(ROUNDS):
        model = train_round(coded.filter(F.col("turn") == turn), vocab, model, turn)
    return model


def train_round(coded: DataFrame, vocab: Vocabulary, start: list[np.ndarray], turn: int) -> list[np.ndarray]:
    """One round from ``start``: every shard in a task of its own, its texts in the order of their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = None, None

        def result() -> pa.RecordBatch:
            flat = np.concatenate([x.ravel() for x in part.finish()]).astype(np.float64) * part.tokens
            flat = np.pad(flat, (0, -len(flat) % SLICE)).reshape(-1, SLICE)
            columns = [pa.array(np.arange(len(flat)), pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part.tokens] * len(flat), pa.int64())], ["slice", "part", "tokens"])

        for batch in batches:
            for s, text in zip(batch["shard"].to_pylist(), batch["outcomes"], strict=True):
                if s != shard:
                    if part:
                        yield result()
                    part, shard = Part(Trainer(vocab, start, s * ROUNDS + turn)), s
                part.add(text.as_py())
        if part:
            yield result()

    def total(part: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(x) for x in part["part"])
        return pd.DataFrame({"slice": [part["slice"].iloc[0]], "mean": [(sums / part["tokens"].sum()).tobytes()]})

    dealt = coded.repartitionById(shard_count(vocab.total), F.col("shard")).sortWithinPartitions("shard", "key")
    parts = dealt.select("shard", "outcomes").mapInArrow(run, "slice int, part binary, tokens long")
    means = parts.groupBy("slice").applyInPandas(total, "slice int, mean binary").collect()  # the model
    if not means:
        return start
    flat = np.concatenate([np.frombuffer(r["mean"]) for r in sorted(means, key=lambda r: r["slice"])])
    cuts = np.cumsum([0, *(x.size for x in start)])
    return [flat[a:b].reshape(x.shape).astype(np.float32) for a, b, x in zip(cuts, cuts[1:], start, strict=False)]


def normalisers(spark: SparkSession, model: list[np.ndarray]) -> np.ndarray:
    """log of the sum of exp(score) for every pair of contexts: (CLASSES + 1) ** 2 floats, a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u1, u2, r, b = model
        for batch in batches:
            ids = batch["id"].to_numpy()
            rows = []
            for i in ids:
                s = (u1[i] + u2) @ r.T + b
                top = s.max(axis=1)
                rows.append((top + np.log(np.exp(s - top[:, None]).sum(axis=1))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows, pa.binary())], ["id", "z"])

    rows = spark.range(0, CLASSES + 1, 1, 12).mapInArrow(run, "id long, z binary").collect()
    return np.stack([np.frombuffer(r["z"], np.float32) for r in sorted(rows, key=lambda r: r["id"])])


# --- scores --------------------------------------------------------------------------------------------


def score(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: list[np.ndarray], *more: str) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row's whole text, and the further columns asked for."""
    return score_coded(coded_rows(docs, vocab, *more), counts, vocab, model, *more)


def score_coded(coded: DataFrame, counts: DataFrame, vocab: Vocabulary, model: list[np.ndarray], *more: str) -> DataFrame:
    """``score`` for a table of ``coded_rows`` with the further columns."""
    spark = coded.sparkSession
    z = normalisers(spark, model)
    kept = ["_row", "doc_id", "n_tokens", "n_known", "base", "inner", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u1, u2, r, b = model
        for whole in batches:
            for batch in byte_chunks(whole, "outcomes", 400_000):
                outcome = np.frombuffer(b"".join(batch["outcomes"].to_pylist()), np.uint16).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(batch["n_tokens"].to_numpy())])
                one, two = contexts(outcome, first)
                logit = np.einsum("nd,nd->n", u1[one] + u2[two], r[outcome]) + b[outcome] - z[one, two]
                sums = pa.array(np.add.reduceat(logit.astype(np.float64) / np.log(10), first[:-1]))
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), sums], [*kept, "model"])

    rows = coded.select(*kept, "outcomes")
    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "outcomes")
    part = rows.mapInArrow(run, f"{shape}, model double")
    # an unseen word has count 0; a seen rare one adds the difference, to both scores alike
    rest = counts.filter(F.col("n") < F.lit(int(vocab.counts[-1]))) if len(vocab.counts) else counts
    gain = (
        coded.select("_row", F.explode("rare").alias("word"))
        .join(rest, "word")
        .groupBy("_row")
        .agg(F.count("*").alias("_k"), F.sum(F.log10(F.col("n") + 0.5)).alias("_log"))
    )
    rare = F.col("n_tokens") - F.col("n_known")
    unseen = F.lit(float(np.log10(0.5))) * (rare - F.coalesce("_k", F.lit(0)))
    gained = F.coalesce("_log", F.lit(0.0)) + unseen
    return part.join(gain, "_row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        (F.col("base") + gained - F.col("n_tokens") * F.lit(vocab.base)).alias("base_score"),
        (F.col("model") + F.col("inner") + gained).alias("score"),
        *more,
    )


def op4_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: learns from documents whose crc32 of doc_id mod 5 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", crc_mod("doc_id", 5) == 1)
    learn = docs.filter(crc_mod("doc_id", 5) != 1)
    counts = materialise(spark, count_tokens(learn), "counts")
    vocab = vocabulary(counts)
    coded = coded_rows(docs, vocab, "held_out")  # texts become outcomes once, for training and scores
    model = train_coded(coded.filter(~F.col("held_out")), vocab)
    return score_coded(coded, counts, vocab, model, "held_out").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
