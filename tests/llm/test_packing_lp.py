"""The configuration LP: against an exact solver of small cases, its bound, and cases where best fit is far off."""

from functools import lru_cache

import numpy as np
import pytest

from heddle.llm import packing


def counts(**pieces):
    out = np.zeros(1025, np.int64)
    for k, n in pieces.items():
        out[int(k[1:])] = n
    return out


def held(made, size):
    out = np.zeros(size, np.int64)
    for column, n in made:
        for k, m in column.items():
            out[k] += m * n
    return out


def exact(pieces, capacity):
    """The fewest sequences, by search over the multiset of pieces left."""

    @lru_cache(None)
    def fewest(left):
        if not left:
            return 0
        first, rest, best = left[0], left[1:], len(left)
        full = {()}
        for i, k in enumerate(rest):  # every choice of partners of the longest piece
            full |= {c + (i,) for c in full if first + k + sum(rest[j] for j in c) <= capacity}
        for c in full:
            best = min(best, 1 + fewest(tuple(k for i, k in enumerate(rest) if i not in c)))
        return best

    return fewest(tuple(sorted(pieces, reverse=True)))


@pytest.mark.parametrize("seed", range(12))
def test_small_cases_against_an_exact_solver(seed):
    rng = np.random.default_rng(seed)
    pieces = rng.integers(1, 21, 10).tolist()
    count = np.bincount(pieces, minlength=21)
    made, bound = packing.plan(count, 20)
    best = exact(pieces, 20)
    assert (held(made, 21) == count).all()
    assert all(sum(k * m for k, m in column.items()) <= 20 for column, _ in made)
    assert np.ceil(bound - 1e-6) <= best <= sum(n for _, n in made) <= best + 1


@pytest.mark.parametrize(
    ("count", "most"),
    [
        (counts(_512=1001, _341=999, _171=1000), 1011),  # best fit: 1,034
        (counts(_450=3000, _280=3000, _145=3000, _500=100), 2698),  # best fit: 2,836
        (counts(_300=5000, _600=3000), 3704),
        (counts(_300=5000), 1667),
        (counts(_1024=7, _1=3), 8),
        (counts(_1=1), 1),
        (counts(), 0),
    ],
)
def test_within_a_hundredth_of_the_bound(count, most):
    made, bound = packing.plan(count, 1024)
    n = sum(k for _, k in made)
    assert (held(made, 1025) == count).all() and bound <= n <= most
    assert n <= np.ceil(bound - 1e-6) * 1.01


def test_many_lengths_stay_near_the_bound_and_below_best_fit():
    rng = np.random.default_rng(0)
    smooth = np.bincount(np.clip(rng.lognormal(5.5, 1.0, 50_000), 1, 1024).astype(int), minlength=1025)
    made, bound = packing.plan(smooth, 1024)
    assert (held(made, 1025) == smooth).all()
    assert sum(n for _, n in made) <= np.ceil(bound) * 1.001
    middle = np.bincount(rng.integers(250, 500, 20_000), minlength=1025)
    made, bound = packing.plan(middle, 1024)
    alone = sum(n for _, n in packing._best_fit(middle, 1024))
    assert sum(n for _, n in made) <= 0.96 * alone
