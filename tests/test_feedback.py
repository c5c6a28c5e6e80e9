"""Feedback: closed sums against a replay in order, and the stream against both, over a restart."""

import pytest

from heddle.operators import feedback as ops
from heddle.plans import feedback as plans
from heddle.streaming import feedback as stream
from tests.conftest import SF


def replay(rows):
    """{(field, edge): [gained, lost]} and {(field, zone): [hits, seen]} by applying one feedback after the other."""
    edges, zones, log = {}, {}, {}
    for r in rows:
        log.setdefault(r["field"], {}).setdefault(r["n"], []).append(r)
    for field, steps in log.items():
        for n in range(1, max(steps) + 1):
            nodes = steps.get(n, [])
            if n % 5 == 0 and nodes:
                t = max(r["t"] for r in nodes)
                for key, v in edges.items():
                    if key[0] == field:
                        v[0] *= t**1.5 / (t**1.5 + 1) if t > 1 else 0.5
                        v[1] *= t * t / (t * t + 1) if t > 1 else 0.5
            for r in nodes:
                conf, good = min(1.0, max(0.0, r["amplitude"] or 0.0)), bool(r["success"])
                if good or (r["amplitude"] or 0) > 0.3:
                    region = "shallow" if r["depth"] <= 1 else "mid" if r["depth"] <= 4 else "deep"
                    z = zones.setdefault((field, f"{r['role'] or ''}:{region}"), [0.0, 0.0])
                    z[0] += good
                    z[1] += 1
                if r["parent_role"] is None:
                    continue
                gain = max(conf, 0.1) if good else -max(1 - conf, 0.1)
                for edge in (f"{r['parent_role']}:down:{r['cluster'] or ''}", f"{r['role'] or ''}:up:{r['cluster'] or ''}"):
                    edges.setdefault((field, edge), [0.0, 0.0])[gain < 0] += gain
            if n % 10 == 0:
                for key in [k for k in zones if k[0] == field]:
                    zones[key] = [x * 0.9 for x in zones[key]]
                    if zones[key][1] < 0.5:
                        del zones[key]
    return edges, zones


def log_of(spark, fields=3, feedbacks=120):
    import random

    rng = random.Random(5)
    rows = []
    for f in range(fields):
        for n in range(1, feedbacks + f * 7):
            for _ in range(rng.randint(1, 4)):
                role = rng.choice(["a", "b", None] if n < 40 else ["a", "c"])
                rows.append((f, n, max(1, n // 2), rng.choice(["x", None]), role, rng.choice(["p", None]), rng.randint(0, 7), rng.choice([0.0, 0.25, 0.4, 1.5, None]), rng.random() < 0.3))
    return spark.createDataFrame(rows, ops.FEEDBACK)


def test_batch_equals_a_replay(spark):
    for log in (plans.feedback_log(spark, SF), log_of(spark)):
        edges, zones = replay(log.collect())
        got = {(r["field"], r["edge"]): [r["gained"], r["lost"]] for r in ops.edge_regrets(log).collect()}
        assert got.keys() == edges.keys() and all(got[k] == pytest.approx(edges[k], abs=1e-5) for k in got)
        found = {(r["field"], r["zone"]): r for r in ops.answer_zones(log).collect()}
        assert found.keys() == zones.keys()
        for k, r in found.items():
            assert [r["hits"], r["seen"]] == pytest.approx(zones[k], abs=1e-5)
            assert r["boost"] == pytest.approx(0.7 + 0.6 * zones[k][0] / zones[k][1] if zones[k][1] >= 3 else 1.0, abs=1e-5)
    assert ops.edge_regrets(log.limit(0)).count() == ops.answer_zones(log.limit(0)).count() == 0


def test_stream_equals_a_replay_over_a_restart(spark, tmp_path):
    log = log_of(spark, fields=2, feedbacks=40)
    parts = [log.filter("n <= 13"), log.filter("n > 13 AND n <= 30"), log.filter("n > 30")]
    seen = []

    def keep(batch, number):
        seen.extend((number, *r) for r in batch.collect())

    for part in parts:  # each part is a run of its own, which goes on from the checkpoint
        part.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(ops.FEEDBACK).parquet(str(tmp_path / "in"))
        query = stream.field_states(rows).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        query.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = max(number for number, *_ in seen)
    edges, zones = replay(log.collect())
    for kind, want in (("edge", edges), ("zone", zones)):
        got = {(f, name): [a, b] for number, f, k, name, a, b in seen if number == last and k == kind}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert len({number for number, *_ in seen}) == 3
