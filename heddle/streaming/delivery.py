"""Deliveries as keyed state: the versions of a team's addresses and what each of its consumers has had.

Events of a team must come in order from batch to batch; within a batch they are put in order. A finished stream gives the batch result, each delivery
once, over restarts from the checkpoint, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "publisher array<long>, topic array<string>, version array<long>, had map<long,array<int>>"
DELIVERY = "consumer long, publisher long, topic string, fetch_id long, version long"


def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Applies the events of one team in order; a fetch delivers what its consumer has not had."""
    publishers, topics, versions, had = [], [], [], {}
    if state.exists:
        publishers, topics, versions, had = (list(x) if i < 3 else {k: list(v) for k, v in dict(x).items()} for i, x in enumerate(state.get))
    number = {a: i for i, a in enumerate(zip(publishers, topics, strict=True))}
    out = []
    for r in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples(index=False):
        user = int(r.user_id)
        if isinstance(r.topic, str):
            at = number.setdefault((user, r.topic), len(number))
            if at == len(versions):
                publishers.append(user)
                topics.append(r.topic)
                versions.append(0)
            versions[at] += 1
            continue
        mine = had.setdefault(user, [])
        new = [i for i in sorted(set(range(len(versions))) - set(mine)) if publishers[i] != user]
        out += [(user, publishers[i], topics[i], int(r.event_id), versions[i]) for i in new]
        mine += new
    state.update((publishers, topics, versions, had))
    yield pd.DataFrame(out, columns=["consumer", "publisher", "topic", "fetch_id", "version"])


def deliveries(events: DataFrame) -> DataFrame:
    """A stream of deliveries, from a stream of team events."""
    return events.groupBy("team").applyInPandasWithState(update, DELIVERY, STATE, "append", GroupStateTimeout.NoTimeout)
