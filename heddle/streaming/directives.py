"""Pages that are sent in chunks and steered by commands: one keyed state per page, driven by a stream of nodes and one of commands.

A page's nodes come in one batch, with their score and whether they pass any threshold. The first chunk holds the best nodes that pass; the others wait
in order of score (ties: the smaller id). Commands apply in the order of ``seq``; those that come before the page's nodes wait for them.

* expand: the node's children that were not sent, whatever their score; a node is expanded once.
* next_branch: the next waiting nodes that reach the threshold, a chunk at most. What is taken from the queue and does not reach it is gone, and so is the node
  that is taken when the chunk is full.
* lower_threshold: sets the threshold, within 0 and 1.
* stop: nothing more is sent. The same holds when ``most`` nodes were sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "page_id long, seq long, kind string, node_id long, parent_id long, score double, firm boolean, value double"
STATE = (
    "nodes array<struct<node_id: long, parent_id: long, score: double>>, at int, sent array<long>, expanded array<long>, "
    "threshold double, stopped boolean, chunk int, waiting array<struct<kind: string, node_id: long, value: double>>"
)
CHUNKS = "page_id long, chunk int, place int, node_id long, score double"


def _steps(size: int, least: float, most: int) -> Callable:
    """The update of one page for chunks of ``size``, a first threshold ``least`` and ``most`` nodes in all."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).astype(object)
        rows = rows.where(rows.notna(), None)
        nodes, at, sent, expanded, threshold, stopped, chunk, waiting = ([], 0, [], [], least, False, 0, [])
        if state.exists:
            nodes, at, sent, expanded, threshold, stopped, chunk, waiting = state.get
            nodes, sent, expanded, waiting = [tuple(n) for n in nodes], list(sent), list(expanded), [tuple(w) for w in waiting]
        out: list[tuple] = []

        def send(found: list[tuple]) -> None:
            nonlocal chunk
            if found:
                out.extend((key[0], chunk, i, n[0], n[2]) for i, n in enumerate(found))
                chunk += 1

        whole = lambda x: None if x is None else int(x)  # a column with nulls comes as floats
        done = lambda: stopped or len(sent) >= most
        fresh = rows[rows["kind"] == "node"]
        if len(fresh) and not nodes:
            order = sorted(fresh.itertuples(index=False), key=lambda r: (-r.score, r.node_id))
            nodes = [(whole(r.node_id), whole(r.parent_id), float(r.score)) for r in order]
            first = [n for n, r in zip(nodes, order, strict=True) if r.firm or r.score >= threshold][: min(size, most)]
            sent += [n[0] for n in first]
            send(first)
            nodes = [n for n in nodes if n[0] in sent] + [n for n in nodes if n[0] not in sent]
            at = len(first)
        commands = rows[rows["kind"] != "node"].sort_values("seq", kind="stable")
        waiting += [(r.kind, whole(r.node_id), r.value) for r in commands.itertuples(index=False)]
        while nodes and waiting and not done():
            kind, node, value = waiting.pop(0)
            if kind == "stop":
                stopped = True
            elif kind == "lower_threshold":
                threshold = min(1.0, max(0.0, value))
            elif kind == "expand" and node not in expanded:
                expanded.append(node)
                found = sorted(n for n in nodes if n[1] == node and n[0] not in sent)[: most - len(sent)]
                sent += [n[0] for n in found]
                send(found)
            elif kind == "next_branch":
                found = []
                while at < len(nodes):
                    n, at = nodes[at], at + 1
                    if done() or len(found) >= size:
                        break
                    if n[0] not in sent and n[2] >= threshold:
                        sent.append(n[0])
                        found.append(n)
                send(found)
        if done():
            waiting = []
        state.update((nodes, at, sent, expanded, threshold, stopped, chunk, waiting))
        yield pd.DataFrame(out, columns=["page_id", "chunk", "place", "node_id", "score"])

    return update


def chunks(events: DataFrame, size: int = 10, least: float = 0.3, most: int = 50) -> DataFrame:
    """A stream of (page_id, chunk, place, node_id, score), from the union of a stream of nodes and one of commands."""
    return events.groupBy("page_id").applyInPandasWithState(_steps(size, least, most), CHUNKS, STATE, "append", GroupStateTimeout.NoTimeout)
