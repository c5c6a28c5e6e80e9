"""Deliveries of publications to consumers: each address once for each consumer, at the consumer's first fetch after its first publication.

An address is a publisher's topic; publishing again raises its version. A consumer gets what others of its team have published, in
the version that it then has, and the same address never again. In batch nothing is replayed: a delivery is the first of a consumer's fetches
past an address' first publication, and its version is the number of publications before.

Defined results: an event that is equal in time counts by its id; publications and fetches without a user, time or topic take no part;
an empty table gives an empty result. The rows are those of the result: the pairs of a team.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Users of one team.
TEAM = 10
EVENTS = "team long, user_id long, topic string, ts timestamp_ntz, event_id long"


def team_events(events: DataFrame) -> DataFrame:
    """(team, user_id, topic, ts, event_id) of an event table: a view is a fetch (topic null), everything else publishes its type."""
    rows = events.filter("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")
    topic = F.when(F.col("event_type") != "view", F.col("event_type"))
    return rows.select(F.floor(F.col("user_id") / TEAM).alias("team"), "user_id", topic.alias("topic"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


def _pairs(events: DataFrame) -> DataFrame:
    """Each address with each other member of its team who ever fetches: its publications, that one's fetches, and the first that follows."""
    at = F.struct("ts", "event_id")
    made = events.filter("topic IS NOT NULL").groupBy("team", F.col("user_id").alias("publisher"), "topic").agg(F.array_sort(F.collect_list(at)).alias("made"))
    asked = events.filter("topic IS NULL").groupBy("team", F.col("user_id").alias("consumer")).agg(F.array_sort(F.collect_list(at)).alias("asked"))
    pairs = made.join(asked, "team").filter("publisher <> consumer")
    return pairs.withColumn("got", F.get(F.filter("asked", lambda t: t > F.col("made")[0]), F.lit(0)))


def deliveries(events: DataFrame) -> DataFrame:
    """(consumer, publisher, topic, fetch_id, version) of every delivery."""
    rows = _pairs(events).filter("got IS NOT NULL")
    version = F.size(F.filter("made", lambda t: t < F.col("got"))).cast("long")
    return rows.select("consumer", "publisher", "topic", F.col("got.event_id").alias("fetch_id"), version.alias("version"))


def undelivered(events: DataFrame) -> DataFrame:
    """(consumer, publisher, topic, had, version): publications past the version that a consumer got; 0 where it got none yet."""
    had = F.when(F.col("got").isNull(), 0).otherwise(F.size(F.filter("made", lambda t: t < F.col("got")))).cast("long")
    rows = _pairs(events).select("consumer", "publisher", "topic", had.alias("had"), F.size("made").cast("long").alias("version"))
    return rows.filter("had < version")
