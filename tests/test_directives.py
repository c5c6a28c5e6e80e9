"""Steered chunks against a loop with a heap, over batches and a restart."""

import heapq
import random

from heddle.streaming import directives

SIZE, LEAST, MOST = 3, 0.3, 12


def loop(nodes, commands):
    """[(chunk, node)] of a page: nodes are (id, parent, score, firm)."""
    sent, out, expanded, threshold, number = set(), [], set(), LEAST, 0
    ranked = sorted(nodes, key=lambda n: (-n[2], n[0]))

    def send(ids):
        nonlocal number
        out.extend((number, i) for i in ids)
        number += bool(ids)

    first = []
    for n in ranked:
        if len(sent) >= MOST or len(first) >= SIZE:
            break
        if n[3] or n[2] >= threshold:
            sent.add(n[0])
            first.append(n[0])
    send(first)
    heap = [(-n[2], n[0]) for n in ranked if n[0] not in sent]
    heapq.heapify(heap)
    for kind, node, value in commands:
        if len(sent) >= MOST or kind == "stop":
            break
        got = []
        if kind == "lower_threshold":
            threshold = min(1.0, max(0.0, value))
        elif kind == "expand" and node not in expanded:
            expanded.add(node)
            for i in sorted(n[0] for n in nodes if n[1] == node):
                if i not in sent and len(sent) < MOST:
                    sent.add(i)
                    got.append(i)
        elif kind == "next_branch":
            while heap:
                score, i = heapq.heappop(heap)
                if len(sent) >= MOST or len(got) >= SIZE:
                    break
                if i not in sent and -score >= threshold:
                    sent.add(i)
                    got.append(i)
        send(got)
    return out


def test_chunks_equal_a_loop_over_restarts(spark, tmp_path):
    rng = random.Random(11)
    pages, orders, rows = {}, {}, []
    for p in range(6):
        pages[p] = [(i, rng.randint(0, i - 1) if i else None, rng.choice([0.1, 0.25, 0.4, 0.6, 0.9]), rng.random() < 0.2) for i in range(25)]
        kinds = ["expand", "next_branch", "lower_threshold", "expand", "next_branch"] * 2 + (["stop", "next_branch"] if p % 2 else ["next_branch"])
        orders[p] = [(k, rng.randint(0, 24) if k == "expand" else None, rng.choice([-1.0, 0.2, 0.5, 2.0]) if k == "lower_threshold" else None) for k in kinds]
    node_rows = [(p, 0, "node", i, up, s, f, None) for p, ns in pages.items() for i, up, s, f in ns]
    command_rows = [(p, k + 1, kind, node, None, None, None, value) for p, cs in orders.items() for k, (kind, node, value) in enumerate(cs)]
    batches = [command_rows[:3], node_rows + command_rows[3:20], command_rows[20:50], command_rows[50:]]
    for part in batches:
        spark.createDataFrame(part, directives.EVENTS).repartition(2).write.mode("append").parquet(str(tmp_path / ("commands" if part is not batches[1] else "nodes")))
        for other in ("commands", "nodes"):
            spark.createDataFrame([], directives.EVENTS).write.mode("append").parquet(str(tmp_path / other))
        nodes, commands = (spark.readStream.schema(directives.EVENTS).parquet(str(tmp_path / d)) for d in ("nodes", "commands"))
        query = directives.chunks(nodes.unionByName(commands), SIZE, LEAST, MOST).writeStream.outputMode("append")
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, _: rows.extend(b.collect())).start().awaitTermination()
    got = {}
    for r in sorted(rows, key=lambda r: (r["page_id"], r["chunk"], r["place"])):
        got.setdefault(r["page_id"], []).append((r["chunk"], r["node_id"]))
    assert got == {p: loop(pages[p], orders[p]) for p in pages}
    assert any(c > 2 for page in got.values() for c, _ in page)
