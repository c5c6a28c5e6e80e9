"""Pairs of near-duplicate candidates: none that reaches the similarity is left out, and few others are looked at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import common, near_dup


def shingle_sets(texts):
    return [{tuple(w[i : i + 2]) for i in range(len(w) - 1)} for w in (t.split() for t in texts)]


def linked(texts, percent):
    sets = shingle_sets(texts)
    pairs = ((a, b) for a in range(len(sets)) for b in range(a))
    return {(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def candidates(spark, texts, percent):
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "rep long, component long, text string")
    order = near_dup.frequencies(rows, 2)
    front = common.materialise(spark, near_dup.prefixes(rows, order, 2, percent), "front")
    return {(r["a"], r["b"]) for r in near_dup.prefix_pairs(front, percent).collect()}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_pairs_hold_every_link_whatever_the_sizes(spark, monkeypatch, percent):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = np.random.default_rng(percent)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(250):
        words = base[int(rng.integers(0, 20)) : 60 - int(rng.integers(0, 38))]
        for k in rng.choice(len(words), int(rng.integers(0, 3)), replace=False):
            words[k] = f"o{i % 40}x{k}"
        texts.append(" ".join(words[: 2 + i % 5] if i % 6 == 0 else words))
    want = linked(texts, percent)
    assert len(want) > 10 and want <= candidates(spark, texts, percent)


def test_a_template_without_links_gives_few_pairs(spark):
    rng = np.random.default_rng(1)
    base = [f"t{i}" for i in range(100)]
    texts = []
    for i in range(400):
        words = list(base)
        for k in rng.choice(100, 5, replace=False):
            words[k] = f"o{i}x{k}"
        texts.append(" ".join(words))
    want, got = linked(texts, 80), candidates(spark, texts, 80)
    assert want <= got and len(got) <= len(want) + 400 * 399 // 2 // 50


def test_family_links_are_all_pairs_across_components(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[i : i + 40]) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rest = docs.select(F.col("doc_id").alias("rep"), (F.col("doc_id") % 3).alias("component"))
    got = {(r["a"], r["b"]) for r in near_dup.family_links(rest, docs, 2, 80).collect()}
    assert got == {(a, b) for a, b in linked(texts, 80) if a % 3 != b % 3} and got
