"""Samples stay bounded on rows without an id and on repeated rows; label estimation against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import language_id, quality
from heddle.llm.common import sampled


def test_rows_without_an_id_do_not_fill_the_sample(spark):
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    share = F.lit(int((1 << 40) * 0.01))
    assert 500 < sampled(rows, share).count() < 2000
    same = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    assert sampled(same, F.lit(1 << 40)).count() == 1 and sampled(same.union(rows), share).count() < 2000


def test_windows_of_rows_without_an_id(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a text of number "), "id").alias("text"), F.lit("en").alias("lang"))
    again = rows.limit(1).crossJoin(spark.range(n)).select(*rows.columns)
    body, labels, langs = language_id.sample_windows(rows.union(again), per_lang=100, windows=4)
    assert langs == ["en"] and 0 < len(body) == len(labels) <= 4 * 2 * 100


def test_examples_of_rows_without_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.append(len(rows)) or (np.zeros(quality.DIMS), 0.0))
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("a text of number "), "id").alias("text"))
    quality.classify(rows, sample=100)
    assert 30 < seen[0] < 200


@pytest.mark.parametrize("seed", [1, 2])
def test_estimation_equals_a_plain_version(seed):
    rng = np.random.default_rng(seed)
    votes = rng.integers(-1, 2, (40, 4))
    weight = rng.integers(1, 50, 40).astype(float)
    got = quality.estimate(votes, weight, rounds=15, prior=0.02)
    share, says = 0.8, [[list(map(float, quality.START[c])) for _ in range(4)] for c in range(2)]
    for _ in range(15):
        good = []
        for v in votes.tolist():
            p = [1 - share, share]
            for c in range(2):
                for k, x in enumerate(v):
                    p[c] *= says[c][k][x + 1]
            good.append(p[1] / (p[0] + p[1]))
        new = [[[float(quality.START[c][j]) * (1 + 0.02 * sum(weight)) for j in range(3)] for _ in range(4)] for c in range(2)]
        for v, w, g in zip(votes.tolist(), weight.tolist(), good, strict=True):
            for k, x in enumerate(v):
                new[0][k][x + 1] += w * (1 - g)
                new[1][k][x + 1] += w * g
        share = min(0.99, max(0.01, sum(w * g for w, g in zip(weight.tolist(), good, strict=True)) / sum(weight)))
        says = [[[x / sum(row) for x in row] for row in side] for side in new]
    assert got.share == pytest.approx(share) and np.allclose(got.says, says)
