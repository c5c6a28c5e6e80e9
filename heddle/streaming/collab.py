"""Streams of events: the latest publication per key, and running snapshot counts.

Both are Structured Streaming aggregations over a file source: state is kept per key, survives a lost
executor through the checkpoint folder, and a finished stream equals the batch query over the same files.
Nulls in a key form a key of their own; an empty source gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def latest_per_key(events: DataFrame, keys: list[str]) -> DataFrame:
    """The newest (ts, event_id) of each key with its version: the number of publications so far."""
    return (
        events.groupBy(*keys)
        .agg(F.max(F.struct("ts", "event_id")).alias("m"), F.count("*").alias("version"))
        .select(*keys, "version", F.col("m.ts").alias("ts"), F.col("m.event_id").alias("event_id"))
    )


def drain(rows: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now and returns the state it ends with.

    Each batch writes the keys that it changed, with its number; the row of the last batch counts.
    """
    spark = rows.sparkSession
    run = f"{folder}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    query = (
        rows.writeStream.outputMode("update")
        .option("checkpointLocation", f"{run}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    query.awaitTermination()
    fields = ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("_batch", "int")])
    return spark.read.schema(fields).option("recursiveFileLookup", "true").parquet(f"{run}/out")


def last_state(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key."""
    others = [c for c in changes.columns if c not in (*keys, "_batch")]
    newest = changes.groupBy(*keys).agg(F.max(F.struct("_batch", *others)).alias("m"))
    return newest.select(*keys, *[F.col(f"m.{c}").alias(c) for c in others])
