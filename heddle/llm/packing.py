"""Best-fit packing of token pieces by a configuration linear program.

Tokenising: each text goes through a byte-level BPE once; its pieces keep only their length and a
checksum of their ids.

Packing: the pieces' length histogram (at most ``capacity`` rows) is all that reaches the driver. The
configuration LP (columns: multisets of lengths that fit a sequence) is solved by multiplicative
weights to a bound that its dual prices prove; an unbounded-knapsack dynamic program prices the columns.
The fractional solution is rounded, the residue solved again, and its rest filled by best fit in bulk. Pieces then get
their places by rank within their length: counts per hash bucket, a running sum over buckets and a
row number within bucket and length, so that no length is ever gathered into one task.

Defined results
---------------
* null or empty text: one piece, the end token alone. Special-token strings in a text are encoded as
  the library does by default.
* a document longer than ``capacity``: all pieces but the first have ``capacity`` tokens.
* repeated rows are separate documents; equal lengths are ordered by (doc_id, piece); an empty table
  gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, documents, materialise

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Texts with characters beyond these, or longer, are left to the tokenizers library.
OTHER_SCRIPT = re.compile(r"[^\x00-\u024f\u2010-\u2027\u20ac]")
LONG_TEXT = 500_000


class TextTokenizer:
    """Token ids (little-endian uint32 bytes) of whole texts, as the tokenizers library gives them.

    ``ranks`` names the same vocabulary as byte ranks: it encodes texts of Latin letters, marks and
    digits, four times faster with equal ids (tests compare the two). All other texts, those that hold a
    special token's string, and very long ones go through the tokenizers library itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
            )

    def ids(self, text: str) -> bytes:
        if (
            self.fast
            and len(text) <= LONG_TEXT
            and not OTHER_SCRIPT.search(text)
            and not any(s in text for s in self.special)
        ):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = TextTokenizer(tokenizer, ranks), np.array([end_id], "<u4").tobytes()
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for whole in batches:
            for batch in byte_chunks(whole, "text", 2_000_000):
                rows = []
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    ids = tok.ids(text.as_py()) + end
                    n = len(ids) // 4
                    head = (n - 1) % capacity + 1
                    for k, at in enumerate([0, *range(head, n, capacity)]):
                        stop = at + capacity if k else head
                        rows.append((doc, k, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return documents(docs).mapInArrow(cut, PIECES)


# --- the configuration LP ---------------------------------------------------------------------


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """(best value for each room, the length to place next in it or 0); a length with values[l] <= 0 is not for use."""
    worth = np.full(capacity + 1, -1.0)
    worth[: len(values)] = np.where(values > 0, values, -1.0)
    best, pick = np.zeros(capacity + 1), [0] * (capacity + 1)
    for room in range(1, capacity + 1):
        got = worth[1 : room + 1] + best[room - 1 :: -1] if room > 1 else worth[1:2]
        k = int(got.argmax())
        best[room] = best[room - 1]
        if got[k] > best[room]:
            best[room], pick[room] = got[k], k + 1
    return best, pick


def traced(pick: list[int], room: int, first: int = 0) -> dict[int, int]:
    """The multiset of lengths that the dynamic program chose for ``room``, with ``first`` placed before."""
    out = {first: 1} if first else {}
    while room > 0:
        k = pick[room]
        if k:
            out[k] = out.get(k, 0) + 1
        room -= k or 1
    return out


def price(values: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest value that fits (unbounded knapsack)."""
    return traced(knapsack(values, capacity)[1], capacity)


@dataclass
class Step:
    """How finely the weights move: ``eta`` a covered share, ``alpha`` of a length's pieces at most in a round, ``width``
    columns a round, those worth at least 1 - ``slack`` of the best, ``rounds`` at most."""

    eta: float
    alpha: float
    width: int
    slack: float
    rounds: int


COARSE, FINE = Step(3, 0.1, 2000, 0.01, 100), Step(3, 0.01, 400, 0.0, 400)
Column = tuple[tuple[int, int], ...]  # (length, number) pairs


def solve(count: np.ndarray, capacity: int, by: Step) -> tuple[dict[Column, float], float]:
    """(fractional configurations, lower bound) of the covering LP, by multiplicative weights.

    A length's weight is its share of a sequence, times exp(-eta * the share of its pieces covered so
    far). The knapsack program prices, for each length, the best configuration that holds it; those near the
    best of all get an equal part of the scarcest length in them. A covered length leaves. Any weights
    w give the bound sum(w * count) / (value of the best configuration); the largest is returned.
    """
    n = count.astype(float)
    left, alive = n.copy(), n > 0
    share_of = np.arange(len(n)) / capacity
    bound = float((share_of * n).sum())
    x: dict[Column, float] = {}
    for turn in range(by.rounds):
        if not alive.any():
            break
        done = np.where(alive, 1 - left / np.maximum(n, 1e-9), 1.0)
        weight = np.where(alive, share_of * np.exp(-by.eta * (done - done[alive].min())), 0.0)
        best, pick = knapsack(weight, capacity)
        if turn % 4 == 0:
            bound = max(bound, float((weight * n).sum() / best[capacity]))
        lengths = np.flatnonzero(alive)
        worth = weight[lengths] + best[capacity - lengths]
        near = lengths[worth >= (1 - by.slack) * best[capacity] - 1e-12]
        near = near[np.argsort(done[near], kind="stable")][: by.width]
        columns = {tuple(sorted(traced(pick, capacity - k, k).items())) for k in near.tolist()}
        asked = np.zeros(len(n))
        for column in columns:
            for k, m in column:
                asked[k] += m
        part = np.minimum(by.alpha * n, left) / np.maximum(asked, 1)
        for column in sorted(columns):
            step = min(part[k] for k, _ in column)
            x[column] = x.get(column, 0.0) + step
            for k, m in column:
                left[k] -= m * step
        alive &= left > 1e-6 * n
    return x, bound


def fill(left: np.ndarray, capacity: int) -> dict[int, int]:
    """The best-fit-decreasing configuration of the lengths left."""
    out: dict[int, int] = {}
    room = capacity
    while room > 0:
        fits = np.flatnonzero(left[1 : min(room, capacity) + 1]) + 1
        k = next((int(k) for k in fits[::-1] if left[k] > out.get(int(k), 0)), 0)
        if not k:
            break
        m = min(int(left[k]) - out.get(k, 0), room // k)
        out[k] = out.get(k, 0) + m
        room -= m * k
    return out


def plan(count: np.ndarray, capacity: int, gap: float = 0.001, passes: int = 3) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(whole configurations with how often each is used, the LP's lower bound); every piece is held exactly once.

    The fractional solution is rounded along its columns in order of their longest pieces, carrying the
    fractions on, and what is left is solved and rounded again; best fit places the rest. Steps are refined until the number of
    sequences is within ``gap`` of the bound; the plan with the fewest is taken, and best fit alone is one of them.
    """
    best, bound = _best_fit(count.astype(np.int64), capacity), 0.0
    for by in (COARSE, FINE):
        made, low = _rounded(count, capacity, by, passes)
        bound = max(bound, low)
        if sum(n for _, n in made) <= sum(n for _, n in best):
            best = made
        if sum(n for _, n in best) <= np.ceil(bound - 1e-6) * (1 + gap):
            break
    return best, bound


def _rounded(count: np.ndarray, capacity: int, by: Step, passes: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    left, out, bound = count.astype(np.int64).copy(), [], 0.0
    for i in range(passes):
        x, low = solve(left, capacity, by)
        bound = bound if i else low
        carry, before = 0.0, int(left.sum())
        for column in sorted(x, key=lambda c: c[::-1], reverse=True):
            carry += x[column]
            n = int(carry + 1e-9)
            carry -= n
            n = min(n, *(int(left[k]) // m for k, m in column)) if n else 0
            if n:
                out.append((dict(column), n))
                for k, m in column:
                    left[k] -= m * n
        if left.sum() in (0, before):
            break
    return out + _best_fit(left, capacity), bound


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest pieces first, equal sequences at once."""
    left, out = count.copy(), []
    while left.any():
        column = fill(left, capacity)
        n = min(int(left[k]) // m for k, m in column.items())
        out.append((column, n))
        for k, m in column.items():
            left[k] -= m * n
    return out


def places(configs: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Ranges of rank by length: rank r of a length in [lo, hi) goes to sequence base + (r - lo) // per."""
    rows, done, base = [], {}, 0
    for column, n in configs:
        offset = 0
        for k in sorted(column, reverse=True):
            lo = done.get(k, 0)
            rows.append((k, lo, column[k], base, offset))
            done[k] = lo + n * column[k]
            offset += k * column[k]
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "per", "base", "offset"), table.T, strict=True))


def pack(found: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 5_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...) of at most ``capacity`` tokens.

    ``found`` is read three times: pass a written table.
    """
    hist = found.groupBy("length").count().collect()  # at most `capacity` rows
    count = np.zeros(capacity + 1, np.int64)
    for r in hist:
        count[r["length"]] = r["count"]
    at = places(plan(count, capacity)[0])
    top = int(count.max(initial=0)).bit_length() + 1
    keys = (at["length"] << top) + at["lo"]

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(keys, (n << top) + r, "right") - 1
        k = r - at["lo"][i]
        return pd.DataFrame(
            {"sequence_id": at["base"][i] + k // at["per"][i], "offset": at["offset"][i] + k % at["per"][i] * n}
        )

    buckets = max(1, int(count.sum()) // rows_per_bucket)
    rows = found.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("length", "_b")
        .agg(F.count("*").alias("_n"))
        .select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece")
    return (
        rows.withColumn("_rank", F.row_number().over(within) - 1)
        .join(starts, ["length", "_b"])
        .withColumn("_at", place("length", F.col("_rank") + F.col("_start")))
        .select(*found.columns, "_at.sequence_id", "_at.offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, cuts and packs whole documents: one row per piece with its place."""
    return pack(materialise(docs.sparkSession, pieces(docs, tokenizer, ranks, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query."""
    return pack_vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_vocabulary(docs: DataFrame) -> DataFrame:
    """``pack_documents`` with the public 50k byte-level vocabulary."""
    from public_tokenizers import path

    return pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
