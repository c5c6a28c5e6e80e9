"""Edge cases of the tree, and leaves dealt into blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import ann

SHAPE = "vec_id long, embedding array<double>, leaf string, query int"


def brute(rows, asked, k):
    """Nearest of usable vectors by inner product, ties to the smaller id."""
    size = {}
    ok = {i: v for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    for v in ok.values():
        size[len(v)] = size.get(len(v), 0) + 1
    d = min(size, key=lambda n: (-size[n], n), default=0)
    ok = {i: np.array(v) for i, v in ok.items() if len(v) == d}
    out = []
    for q in filter(asked, ok):
        best = sorted((i for i in ok if i != q), key=lambda i: (-(ok[i] @ ok[q]), i))[:k]
        out += [(q, r + 1, i) for r, i in enumerate(best)]
    return sorted(out)


def found(spark, rows, k, **more):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SHAPE)
    out = ann.neighbours(table, F.col("vec_id") % 2 == 0, k=k, **more)
    return sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out.collect())


def test_small_and_odd_tables(spark):
    even = lambda i: i % 2 == 0
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 1.0])]
    odd = [(3, None), (4, []), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (2, [1.0, 1.0])]
    for rows in ([], few[:1], few, few + odd, odd[:5]):
        assert found(spark, rows, 5) == brute(rows, even, 5)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(40)]
    assert found(spark, rows, 7) == brute(rows, lambda i: i % 2 == 0, 7)


@pytest.mark.parametrize("blocks", [False, True])
def test_blocks_change_nothing(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(ann, "QUERIES", 7)
        monkeypatch.setattr(ann, "VECTORS", 11)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)) * rng.pareto(2, 900)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(spark, rows, 5, sample=700), brute(rows, lambda i: i % 2 == 0, 5)
    assert len(got) == len(want)
    hit = len({(q, i) for q, _, i in got} & {(q, i) for q, _, i in want})
    assert hit >= 0.95 * len(want)
