"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only where a local session has none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialise(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage durably.

    A lost executor then costs only the re-read of the written table.
    """
    path = f"{shared_dir(spark)}/heddle/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one key that a task may get in a join; keys of more are dealt over several tasks.
SPREAD = 20_000


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], total: int, how: str = "inner", hot: DataFrame | None = None, spread: int | None = None
) -> DataFrame:
    """``rows`` (``total`` of them) joined to a table, mostly one that is unique on ``keys``, with hot keys split.

    Keys of more than ``spread`` (SPREAD) rows, and of more than a ten-thousandth of all, are dealt over tasks by a hash of the row; their
    line of the table is repeated for each. There are at most 10,000 such keys, so they can be broadcast. ``hot``
    may give the counts: (keys, _n). Null keys join nothing.
    """
    spread = spread or SPREAD
    if total <= spread:
        return rows.join(table, keys, how)
    limit = max(spread, total // 10_000)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")) if hot is None else hot
    hot = F.broadcast(hot.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    lines = table.join(hot, keys, "left").withColumn("_part", parts).drop("_parts")
    return dealt.join(lines, [*keys, "_part"], how).drop("_part")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text (null: empty), with the further columns asked for; others are not read."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *more,
    )


def typed(df: DataFrame, names: tuple[str, ...]) -> list[tuple[str, str]]:
    """The columns asked for with their types, as a result that carries them names them."""
    kinds = dict(df.dtypes)
    return [(name, kinds[name]) for name in names]


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def sampled(rows: DataFrame, below: Column) -> DataFrame:
    """The different rows among ``rows`` whose hash of doc_id and text, modulo 2 ** 40, is ``below`` a bound, with the hash as _key.

    Rows without a doc_id are told apart by their text, and equal rows count once; the repeats go before the shuffle.
    """
    keyed = rows.withColumn("_key", F.xxhash64("doc_id", "text"))
    return keyed.filter(F.pmod("_key", F.lit(1 << 40)) < below).dropDuplicates(["_key", *(c for c in rows.columns if c not in ("doc_id", "text"))])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def byte_chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each (one row at least), for bounded memory."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def most_frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The most frequent words of a written table (word, n), at most ``size``, most frequent first.

    Counts are cut at a step of a fine logarithmic scale: words of one step stay together, so that no
    task has to send more than its share of them (a sort with a limit sends ``size`` rows from every task).
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    left, least = size, None
    for r in sorted(counts.groupBy(step.alias("k")).count().collect(), key=lambda r: -r["k"]):  # a row for each step
        if r["count"] > left:
            break
        left, least = left - r["count"], r["k"]
    if least is None:
        return []
    rows = counts.filter(step >= least).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


BITS, WORD = 1 << 24, 1 << 15


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id may be in ``ids`` (doc_id): a bitmap of fixed size (2 MB) is broadcast.

    Rows pass that share a hash with an id, so a join must follow. The bitmap spares that join's shuffle the
    other rows; past some ten million ids it spares ever fewer, and the join alone decides.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    marks = ids.select(F.floor(place / WORD).alias("_w"), (place % WORD).alias("_p"))
    maps = F.broadcast(marks.groupBy("_w").agg(F.bitmap_construct_agg("_p").alias("_m")))
    byte = F.conv(F.hex(F.substring("_m", F.floor(F.col("_p") / 8).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(_p % 8 as int)) & 1")
    rows = docs.withColumn("_w", F.floor(place / WORD)).withColumn("_p", place % WORD).join(maps, "_w")
    return rows.withColumn("_byte", byte).filter(bit == 1).select(*docs.columns)
