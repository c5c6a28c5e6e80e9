"""Vector code compression by Lloyd's rounds whose sums are maintained by differences.

Each vector is cut into equal consecutive parts; a part's code is the index of its nearest codebook entry. All is
integer arithmetic, so results do not depend on partitions or on the order of additions.

Vectors are stored once, in blocks of up to ``BLOCK`` rows, bucketed by block. A round reads the blocks beside the assignments that the
round before persisted (a table with the same buckets: nothing is shuffled), assigns every part anew and persists the new
assignments with the block's changes: for each part whose entry changed, its components are taken from the
old entry's sum and added to the new one's, summed up within the block first. Only these changes are shuffled, to the running sums of
(part, entry), which are a persisted table too; a round without changes is the last one. What the driver holds is the codebooks, ``parts`` x
``entries`` rows.

Defined results
---------------
* vectors that are null or hold null or non-finite components are dropped, and so are those of another length than most
  (ties: the shorter) or of a length that ``parts`` does not divide.
* fewer vectors than ``entries``: as many entries. Ties go to the lower index. Rows without an id come last in the first codebook, equal
  ids in the order of their components. Repeated rows count as often as they stand; an entry without parts stays.
* components beyond 2 ** 63 in a squared distance are refused with an error: the result's type has no room for them.
* an empty table gives an empty result; of further columns those asked for by name travel along.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import materialise, shared_dir, spread_join, typed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a block.
BLOCK = 8192
CHANGES = "array<struct<part: int, entry: int, n: long, sums: array<long>>>"


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """(vec_id, v, more...) of the vectors that take part, and their length."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fine = vectors.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & ~bad)
    found = fine.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = found["d"] if found else 0
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return fine.filter(F.size(x) == d).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), *more), d


def first_entries(kept: DataFrame, d: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, d / parts): the parts of the vectors with the smallest ids; only so many rows reach the driver."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, parts, d // parts).transpose(1, 0, 2).copy()


def blocks(kept: DataFrame, more: list[tuple[str, str]]) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors: (block, vec_id array, ints, and an array for each further column)."""
    names = ["vec_id", *(name for name, _ in more)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                ints = batch["v"].flatten().to_numpy(zero_copy_only=False).astype("<i8")
                lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch[name]) for name in names]
                columns = [pa.array([number], pa.int64()), pa.array([ints.tobytes()], pa.binary()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["block", "ints", *names])
                number += 1

    fields = "".join(f", `{name}` array<{kind}>" for name, kind in [("vec_id", "bigint"), *more])
    return kept.select("v", *names).mapInArrow(task, f"block long, ints binary{fields}")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each row, exactly; ties to the lower index."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(book).max(initial=0))
    most = reach * reach * x.shape[1]
    if most >= 1 << 62:
        raise ValueError("components too large: a squared distance has no room in 64 bits")
    kind = np.float64 if most < 1 << 51 else np.int64  # products of doubles are exact that far
    a, b = x.astype(kind), book.astype(kind)
    far = (b * b).sum(axis=1) - 2 * (a @ b.T)
    pick = far.argmin(axis=1)
    return pick, (far[np.arange(len(x)), pick] + (a * a).sum(axis=1)).astype(np.int64)


def changes(x: np.ndarray, old: np.ndarray, new: np.ndarray, entries: int) -> list[dict]:
    """Plus and minus contributions of the parts whose entry changed (old: -1 for none), summed for each (part, entry)."""
    out = []
    for p in range(x.shape[1]):
        moved = np.flatnonzero(old[:, p] != new[:, p])
        had = moved[old[moved, p] >= 0]
        n, sums = np.zeros(entries, np.int64), np.zeros((entries, x.shape[2]), np.int64)
        np.add.at(n, new[moved, p], 1)
        np.add.at(sums, new[moved, p], x[moved, p])
        np.subtract.at(n, old[had, p], 1)
        np.subtract.at(sums, old[had, p], x[had, p])
        for e in np.flatnonzero((n != 0) | (sums != 0).any(axis=1)).tolist():
            out.append({"part": p, "entry": e, "n": int(n[e]), "sums": sums[e].tolist()})
    return out


def assigned(held: DataFrame, books: np.ndarray) -> DataFrame:
    """(block, codes, changes) of ``held`` (block, ints, codes: those of the round before, or null)."""
    parts, entries, width = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
        for batch in batches:
            for block, ints, codes in zip(batch["block"].to_pylist(), batch["ints"], batch["codes"].to_pylist(), strict=True):
                x = np.frombuffer(ints.as_buffer(), "<i8").reshape(-1, parts, width)
                old = np.full((len(x), parts), -1) if codes is None else np.frombuffer(codes, np.uint8).reshape(-1, parts).astype(np.int64)
                new = np.stack([nearest(x[:, p], books[p])[0] for p in range(parts)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([new.astype(np.uint8).tobytes()], pa.binary()), pa.array([changes(x, old, new, entries)], kind)],
                    ["block", "codes", "changes"],
                )

    return held.mapInArrow(task, f"block long, codes binary, changes {CHANGES}")


class DeltaLloyd:
    """The state of the rounds: bucketed blocks, the last assignments and the running sums."""

    def __init__(self, kept: DataFrame, d: int, parts: int = PARTS, entries: int = ENTRIES, more: tuple[str, ...] = ()):
        self.spark, self.parts, self.width = kept.sparkSession, parts, d // parts
        self.more = typed(kept, more)
        self.path = f"{shared_dir(self.spark)}/heddle/codes-{uuid.uuid4().hex}"
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names: list[str] = []
        self.books = first_entries(kept, d, parts, entries)
        self.blocks = self._table(blocks(kept, self.more).repartition(self.buckets, "block"), "vectors")
        self.codes: str | None = None
        self.sums: DataFrame | None = None

    def _table(self, rows: DataFrame, label: str) -> str:
        name = f"heddle_{label}_{uuid.uuid4().hex}"
        out = rows.write.format("parquet").bucketBy(self.buckets, "block").option("path", f"{self.path}/{name}")
        self.names.append(name)
        out.saveAsTable(name)
        return name

    def held(self) -> DataFrame:
        """(block, ints, codes): each block beside its last assignments; both tables are read bucket by bucket."""
        rows = self.spark.table(self.blocks).select("block", "ints")
        if self.codes is None:
            return rows.withColumn("codes", F.lit(None).cast("binary"))
        return rows.join(self.spark.table(self.codes).select("block", "codes").hint("shuffle_hash"), "block")

    def round(self) -> bool:
        """Assigns every part, moves the changed ones between the sums, renews the codebooks; whether anything changed."""
        self.codes = self._table(assigned(self.held(), self.books), "assigned")
        moved = self.spark.table(self.codes).select(F.inline("changes"))
        if not moved.limit(1).count():
            return False
        both = moved if self.sums is None else self.sums.unionByName(moved)
        added = F.array(*(F.sum(F.col("sums")[i]) for i in range(self.width)))
        both = both.groupBy("part", "entry").agg(F.sum("n").alias("n"), added.alias("sums"))
        self.sums = materialise(self.spark, both, "sums")
        for r in self.sums.filter("n > 0").collect():  # at most parts x entries rows
            self.books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        return True

    def coded(self) -> DataFrame:
        """(vec_id, more..., code, error): every vector by the codebooks as they are now."""
        books, parts, width = self.books, self.parts, self.width
        names = ["vec_id", *(name for name, _ in self.more)]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            digits = np.array([f"{i:02x}" for i in range(256)])
            for batch in batches:
                for i in range(batch.num_rows):
                    x = np.frombuffer(batch["ints"][i].as_buffer(), "<i8").reshape(-1, parts, width)
                    found = [nearest(x[:, p], books[p]) for p in range(parts)]
                    code = ["".join(row) for row in np.stack([digits[pick] for pick, _ in found], axis=1).tolist()]
                    error = np.sum([e for _, e in found], axis=0, dtype=np.int64)
                    held = [batch[name].slice(i, 1).flatten() for name in names]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(code, pa.string()), pa.array(error)], [*names, "code", "error"])

        fields = "".join(f"`{name}` {kind}, " for name, kind in [("vec_id", "bigint"), *self.more])
        return self.spark.table(self.blocks).select("ints", *names).mapInArrow(task, f"{fields}code string, error long")

    def drop(self) -> None:
        """Takes the tables out of the session's catalog; results must have been written before."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, more: tuple[str, ...] = ()
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, more..., code, error) for each vector, as a written table, and the codebooks (parts, entries, width)."""
    kept, d = integers(vectors, parts, more=more)
    if not d:
        fields = "".join(f"`{name}` {kind}, " for name, kind in [("vec_id", "bigint"), *typed(kept, more)])
        return vectors.sparkSession.createDataFrame([], f"{fields}code string, error long"), np.zeros((parts, 0, 0), np.int64)
    state = DeltaLloyd(kept, d, parts, entries, more)
    for _ in range(rounds):
        if not state.round():
            break
    out = materialise(vectors.sparkSession, state.coded(), "codes")
    state.drop()
    return out, state.books


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: four parts of 256 entries, four rounds, errors summed over equal labels."""
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), more=("label",))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = coded.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce("label", F.lit(0)))
    sums = rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    sums = materialise(spark, sums, "label-errors")
    both = spread_join(rows, sums.drop("_n"), ["_none", "_label"], rows.count(), hot=sums.select("_none", "_label", "_n"))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    return f"""
near{i} AS MATERIALIZED (
  SELECT r.rid, r.p, any_value(r.x) AS x, arg_min(b.e, (list_inner_product(b.c, b.c) - 2 * list_inner_product(r.x, b.c)) * 256 + b.e) AS e
  FROM cut r JOIN book{i} b ON r.p = b.p GROUP BY r.rid, r.p
), mean{i} AS (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c
  FROM (SELECT p, e, i, sum(x[i]::BIGINT)::BIGINT AS s, count(*) AS n
        FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM near{i}) GROUP BY p, e, i)
  GROUP BY p, e
), book{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e
), """


OP12_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS rid, list_transform(embedding, lambda v: floor(v::DOUBLE * {SCALE})) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), cut AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x
  FROM (SELECT rid, v, unnest(range(0, {PARTS})) AS p FROM kept)
), book0 AS MATERIALIZED (SELECT p, rid AS e, x AS c FROM cut WHERE rid < {ENTRIES}
), {"".join(map(_round_sql, range(ROUNDS)))}
last AS (
  SELECT r.rid, r.p, arg_min(b.e, (list_inner_product(b.c, b.c) - 2 * list_inner_product(r.x, b.c)) * 256 + b.e) AS e,
    min(list_inner_product(r.x, r.x) + list_inner_product(b.c, b.c) - 2 * list_inner_product(r.x, b.c))::BIGINT AS d
  FROM cut r JOIN book{ROUNDS} b ON r.p = b.p GROUP BY r.rid, r.p
), coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(z::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h
  FROM (SELECT p, e, unnest(c) AS z, unnest(range(0, len(c))) AS i FROM book{ROUNDS})
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256
FROM kept k JOIN coded c ON k.rid = c.rid
"""
