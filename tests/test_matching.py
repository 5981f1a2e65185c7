"""Optimal matching for any number of archetypes, and rejection sampling to an exact number."""

import time
from itertools import permutations

import numpy as np
import pytest

from simplark.operators import archetypes as A
from simplark.operators import generate as N


@pytest.mark.parametrize("n,m", [(1, 1), (3, 3), (4, 6), (6, 6)])
def test_assignment_is_the_best_of_all(n, m):
    rng = np.random.default_rng(n * m)
    for cost in (rng.random((n, m)), rng.integers(0, 3, (n, m)).astype(float), np.zeros((n, m)), rng.normal(size=(n, m))):
        got = A.assignment(cost)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))
        assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(best)


def test_two_hundred_archetypes_are_matched_at_once():
    rng = np.random.default_rng(0)
    true = rng.normal(size=(200, 5))
    order = rng.permutation(200)
    began = time.thread_time()
    assert A.match_archetypes(true, true[order] + 1e-3 * rng.normal(size=(200, 5))) == np.argsort(order).tolist()
    assert time.thread_time() - began < 5
    with pytest.raises(ValueError):
        A.match_archetypes(true, true[:10])


def test_rejection_gives_the_wanted_number_or_says_what_failed(spark):
    corners = [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    box = {0: (0.1, 0.4), 2: (-1.0, 1.0)}
    made, tries = N.mixtures_within(spark, 100, corners, box, 3)
    rows = sorted(made.collect())
    assert [r.cell_id for r in rows] == list(range(100)) and tries["accepted"] == 100
    assert [r.attempt for r in rows] == sorted(r.attempt for r in rows) and tries["rejected"] == rows[-1].attempt + 1 - 100
    for r in rows:
        assert sum(r.weights) == pytest.approx(1) and min(r.weights) >= 0 and 0.1 <= r.vec[0] <= 0.4
        assert np.allclose(np.array(r.weights) @ corners, r.vec)
    # Every attempt that lies in the box is taken: the same draws without a box.
    whole, none = N.mixtures_within(spark, 1000, corners, {}, 3)
    assert none == {"accepted": 1000, "rejected": 0}
    inside = [r.attempt for r in sorted(whole.collect(), key=lambda r: r.attempt) if 0.1 <= r.vec[0] <= 0.4]
    assert inside[:100] == [r.attempt for r in rows][: len(inside)]
    assert 0.3 < len(inside) / 1000 < 0.6  # the area of the strip: 0.45
    few, failed = N.mixtures_within(spark, 50, corners, {0: (0.999, 1.0)}, 3)
    assert few.count() == failed["accepted"] < 50 and failed["accepted"] + failed["rejected"] == 500
