"""Line dedup with levelled sorted runs of line hashes.

The store is a log-structured set of runs. A run is a table (key hash, documents), bucketed by hash and
sorted within each bucket. A batch of documents is counted; its merge anti-join with the runs gives the
keys that are new; the keys that some run holds are its updates. The two tables are one run of level 0. When a level holds ``fanout`` runs they are merged into one run of the next level, so a
row is rewritten O(log n) times. Every run has the same buckets: the anti-joins, the merges and the totals
read them where they lie, and only a batch's own counts are shuffled (tests hold the plans to that).

A table is added in batches that double, each about as large as all before it, so that joining every
batch with the runs reads no more than about twice the table's keys. With four batches and a fanout of three the third one
compacts its level.

Defined results
---------------
* null or empty text: one empty line; it has no key and always stays.
* a line's key: the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; blank keys never count.
* each row of the input is one document, so a repeated row counts again; a line repeated within a
  document counts once. Further columns are ignored; an empty table gives an empty result.
* very long texts: whole, line by line; nothing is cut.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import documents, shared_dir, spread_join

SPACE = " \t\n\x0b\f\r"
#: Runs of a level that are merged into one of the next.
FANOUT = 3
#: Hash columns of a run: two independent 64-bit hashes, so that unequal keys do not meet.
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The comparison key of a line."""
    return F.translate(F.trim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_hash(key: Column) -> Column:
    """128 bits of hash; the literal in front seeds the second half differently."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def batch_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, docs): in how many rows of the batch each key occurs; partial sums come before the shuffle."""
    keys = F.array_distinct(
        F.transform(
            F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: F.length(k) >= min_chars), key_hash
        )
    )
    return (
        documents(docs)
        .select(F.explode(keys).alias("k"))
        .groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
        .agg(F.count("*").alias("docs"))
    )


class LineRuns:
    """Levelled sorted runs in the shared folder; ``levels[i]`` lists the runs of level i.

    A run is one bucketed table of the session's catalog, with its files in the shared folder, or two: a batch's
    new keys and its updates.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = path or f"{shared_dir(spark)}/heddle/lines-{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, ...]]] = [[]]

    def _table(self, rows: DataFrame, label: str) -> str:
        name = f"heddle_{label}_{uuid.uuid4().hex}"
        out = rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        out.option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _push(self, run: tuple[str, ...], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def names(self) -> list[str]:
        return [name for level in self.levels for run in level for name in run]

    def _merge(self, runs: list[str], label: str) -> str:
        """One run of the summed counts: merge joins of two runs at a time, bucket by bucket."""
        while len(runs) > 1:
            pairs, runs = list(zip(runs[::2], runs[1::2], strict=False)), runs[len(runs) // 2 * 2 :]
            for a, b in pairs:
                x, y = self.spark.table(a), self.spark.table(b).toDF("g1", "g2", "more").hint("merge")
                both = x.join(y, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "full")
                total = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
                row = both.select(F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2"), total.alias("docs"))
                runs = [*runs, self._table(row, label)]
        return runs[0]

    def totals(self) -> DataFrame:
        """(h1, h2, docs) over all batches: what the levels hold, merged into one run."""
        if self.names():
            name = self._merge(self.names(), "totals")
            self.levels = [[], [(name,)]]
            return self.spark.table(name)
        return self.spark.createDataFrame([], "h1 long, h2 long, docs long")

    def new_keys(self, counts: DataFrame) -> DataFrame:
        """Those of a batch's counts whose key no run holds yet: one merge anti-join for each run."""
        for name in self.names():
            counts = counts.join(self.spark.table(name).select(*KEY).hint("merge"), KEY, "left_anti")
        return counts

    def add(self, docs: DataFrame, min_chars: int = 1) -> None:
        """Adds a batch as a run, its new keys apart from its updates; full levels are compacted."""
        counts = batch_counts(docs, min_chars)
        if self.names():
            counts = self.spark.table(self._table(counts, "batch"))
            new = self._table(self.new_keys(counts), "run")
            known = counts.join(self.spark.table(new).select(*KEY).hint("merge"), KEY, "left_anti")
            self._push((new, self._table(known, "update")), 0)
        else:
            self._push((self._table(counts, "run"),), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push((self._merge([name for run in full for name in run], f"level{level + 1}"),), level + 1)
            level += 1


def doubling(docs: DataFrame, batches: int) -> list[DataFrame]:
    """``docs`` in batches of 1, 1, 2, 4, ... parts: whole input files by a hash of their path, or rows by a hash of the row.

    Whole files are read once, and are taken if they leave no batch empty (their rows are counted without reading a column); a table of
    few files, or without files of its own (a computed one), is dealt by row.
    """
    parts = 1 << (batches - 1)

    def batch(place: Column) -> Column:
        return F.ceil(F.log2(F.pmod(place, F.lit(parts)) + 1)).cast("int")

    by_row = batch(F.xxhash64("doc_id", "text"))
    try:
        by_file = batch(F.xxhash64("_metadata.file_path"))
        held = docs.groupBy(by_file.alias("b")).count().count()  # a row for each batch
    except AnalysisException:
        held = 0
    number = by_file if held == batches else by_row
    return [docs.filter(number == i) for i in range(batches)]


def drop_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = 1, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): ``docs`` without the lines whose key hash is in ``frequent``.

    The columns ``more`` of ``docs`` come last. Only hashes are shuffled to find each row's frequent keys; the texts
    are shuffled once, to meet them, unless the rows with such keys are few enough for Spark to broadcast. The frequent keys (h1, h2, docs) are joined by a broadcast below Spark's own size threshold and by sort-merge beyond, the
    most frequent ones split.
    """
    rows = documents(docs, *more).withColumn("_row", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("_id", F.coalesce("doc_id", F.lit(0)))  # a null doc_id joins too; the row's hash tells it from 0
    lines = rows.select(
        "_id",
        "_row",
        F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))).alias("_key"),
    ).filter(F.length("_key") >= min_chars)
    keyed = lines.select("_id", "_row", key_hash(F.col("_key")).alias("k"))
    keyed = keyed.select("_id", "_row", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    total = frequent.agg(F.sum("docs")).first()[0] or 0  # the rows that the join keeps
    hit = (
        spread_join(keyed, frequent.select(*KEY), KEY, total, hot=frequent.select(*KEY, F.col("docs").alias("_n")))
        .groupBy("_id", "_row")
        .agg(F.collect_set(F.struct(*KEY)).alias("_drop"))
    )
    split = F.split("text", "\n", -1)
    none = F.array().cast("array<struct<h1:bigint,h2:bigint>>")
    joined = rows.join(hit, ["_id", "_row"], "left").withColumn("_drop", F.coalesce("_drop", none))
    kept = F.when(
        F.size("_drop") > 0,
        F.filter(
            split,
            lambda x: (F.length(line_key(x)) < min_chars) | ~F.array_contains(F.col("_drop"), key_hash(line_key(x))),
        ),
    ).otherwise(split)
    return joined.select("doc_id", F.size(split).cast("long").alias("n_lines"), kept.alias("_kept"), *more).select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("text"),
        *more,
    )


def line_dedup(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, more: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) without the lines whose key is in ``min_docs`` documents or more.

    The columns ``more`` of ``docs`` come last. ``docs`` goes into the runs in ``batches`` doubling parts; the
    result does not depend on their number.
    """
    runs = LineRuns(docs.sparkSession)
    for part in doubling(docs, batches):
        runs.add(part, min_chars)
    return drop_lines(docs, runs.totals().filter(F.col("docs") >= min_docs), min_chars, more)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: lines found in ten documents or more go."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM frequent) AS gone FROM keyed
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
