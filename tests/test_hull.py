"""The hull of all rows against the one of a matrix, rare corners, deltas and odd tables."""

import numpy as np
import pytest

from simplark.operators import hull as L
from simplark.operators import model as M


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, vec array<double>").repartition(parts)


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(0)
    return rng.dirichlet(np.full(3, 0.5), 300) @ rng.normal(size=(3, 5)) * 3 + rng.normal(size=(300, 5)) * 0.05


def test_it_agrees_with_the_hull_of_a_matrix(spark, mixed):
    fit = L.fit_hull(table(spark, mixed), 3)
    assert fit.r2 >= M.principal_hull(mixed, 3).r2 - 1e-4 and fit.r2 > 0.99
    rows = fit.composition(spark).collect()
    made = np.zeros((3, 5))
    for r in rows:
        made[r.archetype_idx] += r.coefficient * mixed[r.cell_id]
    assert np.allclose(made, fit.archetypes) and all(r.coefficient > 0 for r in rows) and len(rows) < 60
    report = L.composition_report(fit.composition(spark)).collect()
    assert all(abs(r.total - 1) < 1e-9 and not r.violated for r in report) and sum(r.n_cells for r in report) == len(rows)
    assert all(a >= b for a, b in zip(fit.usage, fit.usage[1:])) and all(b <= a * (1 + 1e-6) for a, b in zip(fit.history, fit.history[1:]))


def test_delta_lets_archetypes_leave_the_hull(spark, mixed):
    plain, wide = L.fit_hull(table(spark, mixed), 3, 30), L.fit_hull(table(spark, mixed), 3, 30, delta=0.2)
    assert wide.r2 > plain.r2 and (np.abs(wide.scale - 1) <= 0.2 + 1e-12).all()
    report = L.composition_report(wide.composition(spark), delta=0.2).collect()
    assert {round(r.total, 9) for r in report} == {round(s, 9) for s in wide.scale} and not any(r.violated for r in report)


def test_a_corner_that_one_row_holds_is_found(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack((rng.dirichlet(np.ones(3), 20_000)[:, :2], np.zeros(20_000)))
    x[7777] = [0, 0, 1]
    fit = L.fit_hull(table(spark, x), 4, 15)
    assert np.abs(fit.archetypes - [0, 0, 1]).max(1).min() < 1e-9
    assert 7777 in {c for own in fit.members for c in own}


def test_odd_tables(spark):
    few = L.fit_hull(table(spark, [[1, 2, 3], [1, 2, 3]]), 4, 3)
    assert len(few.archetypes) == 2 and np.allclose(few.archetypes, [1, 2, 3])
    some = spark.createDataFrame([(1, None), (2, [0.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0])], "cell_id long, vec array<double>")
    assert L.fit_hull(some, 2, 5).r2 == pytest.approx(1)
    with pytest.raises(ValueError):
        L.fit_hull(some.limit(0), 2)
