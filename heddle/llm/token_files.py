"""Token-id files: every id in as few bits as its vocabulary needs, with offsets for random access.

Format
------
A token file set is a folder with two Parquet tables. ``blocks`` has one row for each block of whole documents, in order of
(shard, block): the ids of its documents, packed into ``width`` bits each (the least that hold the vocabulary's largest id),
lowest bit first, in 64-bit little-endian words; ``first``, the ids of its shard before it; ``doc_id`` and ``ends``, the
documents it holds and where each ends in it. ``shards`` has one row for each shard: the ids of all shards before it. A document's ids, or
any range of positions, are found by block statistics alone: nothing before them is read or unpacked.

Spark's own writer commits the blocks, so a lost executor leaves no part of a file behind, and any store that Spark reads will do.

Writing: texts are dealt into shards by ranges of doc_id and sorted there; each task encodes its shard in order and
closes a block when it holds ``BLOCK`` ids, so a task holds one block and one text.

Defined results
---------------
* null or empty text: the end id alone. Special-token strings in a text are encoded as the library does by default.
* documents stand in ascending doc_id order, null first; documents of one doc_id in the order of a hash of their text. Repeated rows
  are separate documents, and a doc_id that many rows share is dealt over several shards.
* very long texts: whole; such a document makes one longer block. Further columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import byte_chunks, documents, shared_dir
from heddle.llm.packing import TextTokenizer

#: Ids after which a block is closed.
BLOCK = 65_536
END_ID = 0
BLOCKS = "shard int, block int, first long, ids long, width int, payload binary, doc_id array<long>, ends array<long>"
SHARDS = "shard int, start long, ids long"


def bits_for(largest: int) -> int:
    """The least width that holds ids from 0 to ``largest``."""
    return max(1, int(largest).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each: 64 ids fill ``width`` words, so each of the 64 places has one shift for all rows."""
    rows = -(-len(ids) // 64)
    held = np.zeros(rows * 64, np.uint64)
    held[: len(ids)] = ids
    held, words = held.reshape(rows, 64), np.zeros((rows, width), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[:, word] |= held[:, k] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= held[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack_bits(payload: bytes, width: int, first: int, stop: int) -> np.ndarray:
    """Ids ``first`` to ``stop`` (exclusive) of a block; only the rows of 64 that hold them are touched."""
    lo, hi = first // 64, -(-stop // 64)
    words = np.frombuffer(payload, "<u8", (hi - lo) * width, lo * width * 8).reshape(hi - lo, width)
    out, mask = np.empty((hi - lo, 64), np.uint64), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        got = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            got = got | words[:, word + 1] << np.uint64(64 - shift)
        out[:, k] = got & mask
    return out.reshape(-1)[first - lo * 64 : stop - lo * 64].astype(np.uint32)


def _encoded(tokenizer: str, ranks: str | None, end_id: int, block_ids: int):
    """The task that turns ordered (doc_id, text) rows into blocks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = TextTokenizer(tokenizer, ranks), np.array([end_id], "<u4").tobytes()
        width = bits_for(max(end_id, max(tok.tok.get_vocab(with_added_tokens=True).values(), default=0)))
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        names, ends, held = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal block, first, names, ends, held
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "first": pa.array([first], pa.int64()), "ids": pa.array([len(ids)], pa.int64()), "width": pa.array([width], pa.int32()),
                "payload": pa.array([pack_bits(ids, width)], pa.binary()),
                "doc_id": pa.array([names], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int64())),
            }
            block, first, names, ends, held = block + 1, first + len(ids), [], [], []
            return pa.RecordBatch.from_pydict(row)

        for whole in batches:
            for batch in byte_chunks(whole, "text", 2_000_000):
                for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                    held.append(tok.ids(text.as_py()) + end)
                    names.append(doc)
                    ends.append((ends[-1] if ends else 0) + len(held[-1]) // 4)
                    if ends[-1] >= block_ids:
                        yield close()
        if names:
            yield close()

    return task


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, ranks: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK
) -> None:
    """Writes the ids of ``docs`` (doc_id, text), each document closed by ``end_id``, as token files in ``path``."""
    spark = docs.sparkSession
    keys = ["doc_id", "_hash", "_row"]
    rows = documents(docs).withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    blocks = ordered.mapInArrow(_encoded(tokenizer, ranks, end_id, block_ids), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    totals = _blocks(spark, path).groupBy("shard").agg(F.sum("ids").alias("ids")).collect()  # a row for each writing task
    start, shards = 0, []
    for r in sorted(totals, key=lambda r: r["shard"]):
        shards.append((r["shard"], start, r["ids"]))
        start += r["ids"]
    spark.createDataFrame(shards, SHARDS).coalesce(1).write.parquet(f"{path}/shards")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, the ids of all documents before them; the shards are as many as the tasks that wrote them."""
    shards = spark.read.schema(SHARDS).parquet(f"{path}/shards").select("shard", "start")
    return _blocks(spark, path).join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document of the files; ``ids`` are little-endian unsigned 32-bit integers."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_bits(r["payload"], r["width"], 0, r["ids"]).astype("<u4", copy=False)
                ends = np.array(r["ends"], np.int64)
                cut = np.concatenate([[0], ends])
                cols = [
                    pa.array(r["doc_id"], pa.int64()),
                    pa.array(r["start"] + cut[:-1]),
                    pa.array(np.diff(cut)),
                    pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids"])

    held = _placed(spark, path).select("start", "ids", "width", "payload", "doc_id", "ends")
    return held.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def read_range(spark: SparkSession, path: str, start: int, count: int) -> DataFrame:
    """(start, ids): the ``count`` ids from position ``start`` on, in pieces of a block each; other blocks are not unpacked."""
    stop = start + count
    hit = _placed(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("ids") > start))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = max(start - r["start"], 0), min(stop - r["start"], r["ids"])
                ids = unpack_bits(r["payload"], r["width"], a, b).astype("<u4", copy=False).tobytes()
                yield pa.RecordBatch.from_pydict({"start": pa.array([r["start"] + a]), "ids": pa.array([ids], pa.binary())})

    return hit.select("start", "ids", "width", "payload").mapInArrow(task, "start long, ids binary")


def op13_bit_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: the files of the 50k byte-level vocabulary, written and read back."""
    from public_tokenizers import path

    to = f"{shared_dir(spark)}/heddle/tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, to, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    found = read_documents(spark, to)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
