"""Pair counts by squares against all pairs."""

from collections import Counter

import numpy as np
import pytest

from simplark.operators import pairs


def all_pairs(rows, bands):
    n = Counter()
    for i, (a, x, y) in enumerate(rows):
        for j, (b, u, v) in enumerate(rows):
            d = round(float(np.hypot(x - u, y - v)), 9)
            if i != j and d <= bands[-1]:
                n[int(np.searchsorted(bands, d)), a, b] += 1
    return n


@pytest.mark.parametrize("open_pairs", [4, 4096])
def test_pairs_by_squares_are_all_pairs(spark, open_pairs):
    """A dense place, copies, points across borders of squares and of bands, and negative coordinates."""
    r = np.random.default_rng(3)
    spots = np.concatenate((r.normal(0, 0.02, (150, 2)), r.uniform(-2, 2, (80, 2)), np.repeat(r.uniform(-1, 1, (2, 2)), 20, axis=0), [[0, 0], [0.25, 0], [0.5, 0], [-0.5, 0], [1e-12, 0]]))
    rows = [("abc"[int(k)], float(x), float(y)) for k, (x, y) in zip(r.integers(0, 3, len(spots)), spots)]
    bands = [0.01, 0.05, 0.25, 0.5]
    df = spark.createDataFrame([*rows, (None, 0.0, 0.0), ("a", None, 0.0), ("a", float("nan"), 0.0)], "archetype string, x double, y double")
    found = pairs.co_occurrence(df, bands, open_pairs=open_pairs).collect()
    assert {(f.band, f.a, f.b): f.n for f in found} == dict(all_pairs(rows, bands))


def test_fifty_bands_over_everything(spark):
    r = np.random.default_rng(4)
    rows = [("ab"[int(k)], float(x), float(y)) for k, x, y in zip(r.integers(0, 2, 120), *r.uniform(0, 1, (2, 120)))]
    bands = np.linspace(0.02, 1, 50).tolist()
    found = pairs.co_occurrence(spark.createDataFrame(rows, "archetype string, x double, y double"), bands, open_pairs=50).collect()
    assert {(f.band, f.a, f.b): f.n for f in found} == dict(all_pairs(rows, bands))


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "archetype string, x double, y double")
    assert pairs.co_occurrence(empty, [1.0]).count() == 0
    one = spark.createDataFrame([("a", 0.0, 0.0)], empty.schema)
    assert pairs.co_occurrence(one, [1.0]).count() == 0
    with pytest.raises(ValueError, match="bands"):
        pairs.co_occurrence(one, [])


@pytest.mark.parametrize("measured", [7, 1 << 17])
def test_points_of_open_squares_are_measured_in_place(spark, monkeypatch, measured):
    """No row for each pair of points, and the same counts however few pairs a task takes at a time."""
    monkeypatch.setattr(pairs, "MEASURED", measured)
    made = []
    plain = pairs.opened
    monkeypatch.setattr(pairs, "opened", lambda *a: made.append(plain(*a)) or made[-1])
    r = np.random.default_rng(6)
    rows = [("ab"[int(k)], float(x), float(y)) for k, x, y in zip(r.integers(0, 2, 90), *r.uniform(0, 1, (2, 90)))]
    bands = [0.1, 0.3]
    found = pairs.co_occurrence(spark.createDataFrame(rows, "archetype string, x double, y double"), bands).collect()
    assert {(f.band, f.a, f.b): f.n for f in found} == dict(all_pairs(rows, bands))
    assert made and not any("Generate" in m._jdf.queryExecution().executedPlan().toString() for m in made)
