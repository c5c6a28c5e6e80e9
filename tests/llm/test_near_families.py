"""Large families of near copies and templates against all pairs, with every split of hot keys in use."""

import numpy as np
import pytest

from heddle.llm import common, components, near_dup


def family(rng, n, length, own, pool):
    """Texts of one template: ``own`` of its words are each text's own or from a small pool."""
    base = [f"t{rng.integers(1 << 30)}" for _ in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for k in rng.choice(length, own, replace=False):
            words[k] = f"p{rng.integers(pool)}" if rng.random() < 0.5 else f"o{i}x{k}"
        out.append(" ".join(words))
    return out


def all_pairs(texts, k):
    """Component of each text by a product of incidence matrices."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for t in texts)]
    number = {}
    rows = [[number.setdefault(s, len(number)) for s in x] for x in sets]
    size = np.array([len(x) for x in sets])
    held = np.zeros((len(texts), len(number)), np.float32)
    for i, r in enumerate(rows):
        held[i, r] = 1
    common_ = held @ held.T
    linked = 100 * common_ >= 80 * (size[:, None] + size[None, :] - common_)
    label = np.arange(len(texts))
    while True:
        new = np.array([label[linked[i]].min() for i in range(len(texts))])
        new = new[new]
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("split", [False, True])
def test_families_equal_all_pairs(spark, monkeypatch, split):
    rng = np.random.default_rng(4)
    if split:
        monkeypatch.setattr(common, "SPREAD", 5)
        monkeypatch.setattr(near_dup, "BLOCK", 16)
    n = 60 if split else 120
    texts = family(rng, n, 60, 2, 3) + family(rng, n, 60, 3, 20) + family(rng, n, 80, 9, 1 << 20)
    want = all_pairs(texts, 2)
    assert n < len(set(want.tolist())) < len(texts) - n // 4
    rows = spark.createDataFrame(list(enumerate(texts)) + [(len(texts) + i, texts[0]) for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_groups(rows, words=2).collect()}
    assert [got[i] for i in range(len(texts))] == want.tolist()
    assert all(got[len(texts) + i] == want[0] for i in range(40))


def test_prefixes_leave_no_pair_out():
    rng = np.random.default_rng(7)
    order = rng.integers(0, 50, near_dup.CELLS)
    for _ in range(200):
        n, m = sorted(rng.integers(1, 60, 2).tolist())
        shared = int(rng.integers(0, n + 1))
        x = rng.integers(0, 1 << 62, n).astype(np.uint64)
        y = np.concatenate([x[:shared], rng.integers(0, 1 << 62, m - shared).astype(np.uint64)])
        if 100 * shared < 80 * (n + m - shared):
            continue
        lists = [s[np.lexsort((s, order[near_dup._cell(s)]))] for s in (x, y)]
        front = [s[: len(s) + 1 + (-80 * len(s)) // 100] for s in lists]
        assert np.isin(*front).any()


def test_components_with_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD", 3)
    edges = [(i, 0) for i in range(1, 30)] + [(i, i - 1) for i in range(101, 130)] + [(29, 110), (200, 201)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys([*range(30), *range(100, 130)], 0), 200: 200, 201: 200}
