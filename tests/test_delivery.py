"""Deliveries against a plain loop, and as a stream over restarts."""

from heddle.operators import delivery as ops
from heddle.streaming import delivery as stream
from tests.conftest import SF


def replay(rows):
    """{(consumer, publisher, topic): (fetch, version)} and what waits, event by event."""
    version, had, got, consumers = {}, {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        team = r["team"]
        if r["topic"] is not None:
            key = (team, r["user_id"], r["topic"])
            version[key] = version.get(key, 0) + 1
            continue
        consumers[r["user_id"]] = team
        for key, n in version.items():
            if key[0] == team and key[1] != r["user_id"] and key not in had.setdefault(r["user_id"], set()):
                had[r["user_id"]].add(key)
                got[r["user_id"], key[1], key[2]] = (r["event_id"], n)
    pairs = {(c, k[1], k[2]): n for c, team in consumers.items() for k, n in version.items() if k[0] == team and k[1] != c}
    return got, {p: (got.get(p, (None, 0))[1], n) for p, n in pairs.items() if got.get(p, (None, 0))[1] < n}


def test_deliveries_equal_a_loop(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    late = events.limit(1).selectExpr("-1L AS event_id", "timestamp_ntz'2030-01-01' AS ts", "1L AS user_id", "'late' AS event_type", "value", "props")
    rows = ops.team_events(events.unionByName(late))  # nobody fetches after it
    got, waits = replay(rows.collect())
    assert got and waits and any(had == 0 for had, _ in waits.values())
    found = ops.deliveries(rows).collect()
    assert {(r["consumer"], r["publisher"], r["topic"]): (r["fetch_id"], r["version"]) for r in found} == got and len(found) == len(got)
    assert {(r["consumer"], r["publisher"], r["topic"]): (r["had"], r["version"]) for r in ops.undelivered(rows).collect()} == waits
    assert ops.deliveries(rows.limit(0)).count() == 0


def test_each_delivery_once_over_restarts(spark, tmp_path):
    rows = ops.team_events(spark.read.parquet(f"{SF}/events.parquet")).orderBy("ts", "event_id").collect()
    seen = []
    cut = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
        part = spark.createDataFrame(rows[a:b], ops.EVENTS)
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(ops.EVENTS).parquet(str(tmp_path / "in"))
        query = stream.deliveries(source).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).foreachBatch(lambda batch, number: seen.extend(batch.collect())).start().awaitTermination()
        got, _ = replay([r.asDict() for r in rows[:b]])
        assert {(r["consumer"], r["publisher"], r["topic"]): (r["fetch_id"], r["version"]) for r in seen} == got and len(seen) == len(got), k
