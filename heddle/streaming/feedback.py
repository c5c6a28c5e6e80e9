"""The feedback of a field as keyed state: one processor per field, whose state survives a restart from the checkpoint.

Rows of a field must come in the order of their feedbacks from batch to batch; within a batch they are put in order. A finished stream
equals the batch queries over the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heddle.operators.feedback import BEAT, DECAY, DECAY_BEAT, LEAST

STATE = "n int, edges map<string,struct<gained:double,lost:double>>, zones map<string,struct<hits:double,seen:double>>"
CHANGES = "field long, kind string, name string, a double, b double"


def _row(r: object, edges: dict, zones: dict) -> None:
    """Adds one node of a feedback to the sums."""
    good, conf = bool(r.success) if r.success is not None else False, 0.0 if pd.isna(r.amplitude) else float(r.amplitude)
    if r.parent_role is not None:
        held = min(1.0, max(0.0, conf))
        gain = max(held, 0.1) if good else -max(1.0 - held, 0.1)
        for name in (f"{r.parent_role}:down:{r.cluster or ''}", f"{r.role or ''}:up:{r.cluster or ''}"):
            plus, minus = edges.get(name, (0.0, 0.0))
            edges[name] = (plus + gain, minus) if gain > 0 else (plus, minus + gain)
    if good or conf > 0.3:
        name = f"{r.role or ''}:{'shallow' if r.depth <= 1 else 'mid' if r.depth <= 4 else 'deep'}"
        hits, seen = zones.get(name, (0.0, 0.0))
        zones[name] = (hits + good, seen + 1.0)


def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Applies the rows of one field in order and returns its whole state."""
    edges, zones = {}, {}
    if state.exists:
        _, held_edges, held_zones = state.get
        edges, zones = ({k: tuple(v) for k, v in dict(held).items()} for held in (held_edges, held_zones))
    rows = pd.concat(list(batches)).astype(object)
    rows = rows.where(rows.notna(), None).sort_values("n", kind="stable")
    last = 0
    for n, part in rows.groupby("n", sort=True):
        t = max(part["t"])
        if n % BEAT == 0:
            keep = [x / (x + 1.0) if t > 1 else 0.5 for x in (t**1.5, t**2.0)]
            edges = {k: (plus * keep[0], minus * keep[1]) for k, (plus, minus) in edges.items()}
        for r in part.itertuples(index=False):
            _row(r, edges, zones)
        if n % DECAY_BEAT == 0:
            zones = {k: (s * DECAY, o * DECAY) for k, (s, o) in zones.items() if o * DECAY >= LEAST}
        last = int(n)
    state.update((last, edges, zones))
    found = [(key[0], kind, k, *v) for kind, held in (("edge", edges), ("zone", zones)) for k, v in held.items()]
    yield pd.DataFrame(found, columns=["field", "kind", "name", "a", "b"])


def field_states(feedback: DataFrame) -> DataFrame:
    """A stream of (field, kind, name, a, b): the whole state of each field that a batch touched."""
    return feedback.groupBy("field").applyInPandasWithState(update, CHANGES, STATE, "update", GroupStateTimeout.NoTimeout)
