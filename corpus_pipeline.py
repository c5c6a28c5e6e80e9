"""The corpus pipeline: language ID, line dedup, near-dedup, PII redaction, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``.

Language ID, line dedup and PII give one row for each row they keep: the other columns travel along, and
nothing is joined by doc_id. A repeated row stays repeated, and line dedup counts each copy as a document.
Near-dedup takes doc_id as a document's name, so equal rows stay or go together; rows without a doc_id
are named by their text, after all others, so that of a group with a doc_id none of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import materialise
from heddle.llm.language_id import identify, learn
from heddle.llm.line_dedup import line_dedup
from heddle.llm.near_dup import near_groups
from heddle.llm.packing import pack_vocabulary
from heddle.llm.pii import find_pii

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows without a doc_id get names from here on, by their text.
NAMELESS = 1 << 62
#: No SQL expresses the learned stages; tests hold run() against brute force.
ORACLE_SQL = None


def _measured(texts: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return texts.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go (null, empty or letterless); lang becomes the predicted one."""
    found = identify(docs, learn(docs), "text", "source", "n_chars").filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a text all of whose lines went stays, empty."""
    return _measured(line_dedup(docs, more=("lang", "source")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, 0.8): the smallest doc_id."""
    by_text = F.xxhash64("text").bitwiseAND(F.lit(NAMELESS - 1)) + F.lit(NAMELESS)
    named = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), by_text))
    groups = near_groups(named.select(F.col("_id").alias("doc_id"), "text"), words=5)
    kept = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    return named.join(kept, "_id", "left_semi").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets."""
    return _measured(find_pii(docs, "lang", "source").withColumn("text", F.col("redacted")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document gets its place in a sequence of at most 1024."""
    return pack_vocabulary(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
