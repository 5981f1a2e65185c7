"""Nearest real rows by counted steps, against numpy."""

import numpy as np
import pytest

from simplark.operators import validate as D


@pytest.mark.parametrize("share", [0.001, 0.05, 1.0])
def test_nearest_real_equals_numpy_and_keeps_nothing_else(spark, monkeypatch, share):
    monkeypatch.setattr(D, "BLOCK_ROWS", 70)
    monkeypatch.setattr(D, "SAMPLE_ROWS", 90)
    rng = np.random.default_rng(5)
    real = rng.integers(0, 4, (300, 3)).astype(float)  # few places: many ties
    real[:40] = rng.normal(size=(40, 3))
    made = np.vstack((rng.normal(size=(60, 3)), real[:20], np.zeros((2, 3)), np.full((1, 3), 50.0)))
    table = lambda x, first: spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>").repartition(3)
    k = max(1, int(300 * share))
    met = []
    plain = D.met
    monkeypatch.setattr(D, "met", lambda *a, **b: met.append(plain(*a, **b)) or met[-1])
    got = sorted((r.src, r.dst, r.distance) for r in D.nearest_real(table(made, 1000), table(real, 0), share).collect())
    d = np.sqrt(((made[:, None] - real[None]) ** 2).sum(2)).round(9)
    want = sorted((1000 + i, int(j), d[i, j]) for i in range(len(made)) for j in np.lexsort((np.arange(300), d[i]))[:k])
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
    assert met[-1].count() == len(want)  # the last pass returns the nearest alone: nothing is shuffled after it


def test_a_misleading_sample_costs_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(D, "SAMPLE_ROWS", 0)  # no row at all: all bounds are open
    x = np.random.default_rng(6).normal(size=(120, 4))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    rows = D.nearest_real(table, table, 0.1).collect()
    assert {(r.src, r.dst) for r in rows} == {(i, int(j)) for i in range(120) for j in np.lexsort((np.arange(120), d[i]))[:12]}


def test_no_real_rows_no_pairs(spark):
    table = spark.createDataFrame([(1, [0.0, 1.0])], "cell_id long, vec array<double>")
    assert D.nearest_real(table, table.where("cell_id < 0")).count() == 0 and D.nearest_real(table.where("cell_id < 0"), table).count() == 0
