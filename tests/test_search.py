"""The search in passes over all cells against a loop in one process."""

import math

import numpy as np
import pytest

from simplark.operators import archetypes as A
from simplark.operators import search as X
from simplark.operators import shape as H
from simplark.operators.model import Autoencoder, principal_hull, sample_matrix


@pytest.fixture(scope="module")
def cells(spark):
    x = np.random.default_rng(8).dirichlet(np.ones(3) / 2, 60) @ np.random.default_rng(9).normal(size=(3, 5))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")


CONFIG = X.SearchConfig((2, 3), ((8,),), folds=3, epochs=4, patience=2, batch=16, replicas=1)


def test_search_is_the_loop_over_all_cells(spark, cells):
    """One task, so the averaged state is its own: every metric of every configuration and fold."""
    rows = X.folded(cells, CONFIG)
    local = rows.toPandas()
    x, fold = np.array(local["vec"].tolist(), float), local["fold"].to_numpy()
    want = {}
    for i, k, hidden, inflation in CONFIG.grid():
        for f in range(3):
            key = i * 3 + f
            sample = sample_matrix(rows.where(f"fold <> {f}"), seed=CONFIG.seed)
            net = Autoencoder(np.array(A.inflate(principal_hull(sample, k, 50).archetypes.tolist(), inflation)), hidden, CONFIG.seed, CONFIG.rate)
            best, waited, done = math.inf, 0, 0
            for epoch in range(CONFIG.epochs):
                net.rng = np.random.default_rng([CONFIG.seed, epoch, 0, key])
                mine = np.flatnonzero(fold != f)
                parts = np.array_split(net.rng.permutation(mine), max(1, len(mine) // 16))
                loss = sum(len(p) * net.step(x[p])["loss"] for p in parts) / len(mine)
                done, waited, best = epoch + 1, 0 if loss < best - 1e-5 else waited + 1, min(best, loss)
                if waited >= CONFIG.patience:
                    break
            gap, out = net.reconstruct(x) - x, fold == f
            want[i, f, "val_rmse"], want[i, f, "train_rmse"] = (math.sqrt((gap[m] ** 2).mean()) for m in (out, ~out))
            want[i, f, "val_mae"], want[i, f, "train_mae"] = (np.abs(gap[m]).mean() for m in (out, ~out))
            want[i, f, "archetype_r2"] = 1 - (gap[out] ** 2).sum() / ((x[out] - x[out].mean(0)) ** 2).sum()
            want[i, f, "train_archetypal_loss"], want[i, f, "convergence_epoch"] = (gap[~out] ** 2).mean(), done
            want[i, f, "early_stopped"] = float(waited >= CONFIG.patience)
    got = {(r.config_id, r.fold, r.metric): r.value for r in X.search(cells, CONFIG).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-9) for k in want)


def test_search_on_many_tasks_and_a_share(spark, cells):
    """States of several tasks are averaged; an explicit bound takes a share by the ids' hashes; ids alone decide folds."""
    config = X.SearchConfig((2,), ((8,),), folds=2, epochs=2)
    found = X.search(cells.repartition(5), config)
    assert found.count() == 16 and all(math.isfinite(r.value) for r in found.collect())
    whole = {r.cell_id: r.fold for r in X.folded(cells.repartition(5), config).collect()}
    assert len(whole) == cells.count() and set(whole.values()) == {0, 1}
    part = X.folded(cells, X.SearchConfig(folds=2, most_cells=20)).collect()
    assert len(part) == 20 and all(whole[r.cell_id] == r.fold for r in part)


def test_search_of_nothing(spark, cells):
    assert X.search(cells.limit(0), CONFIG).count() == 0
    assert X.search(cells.limit(1), CONFIG).count() == 0  # one fold alone has nothing to learn from


def test_metric_names():
    assert len(H.METRIC_ALIASES) == 11 and set(H.METRIC_ALIASES.values()) == {"archetype_r2", "val_rmse", "train_rmse", "val_mae", "train_mae", "train_archetypal_loss", "convergence_epoch"}


def test_steps_without_report_train_alike_and_measure_no_batch(monkeypatch):
    x = np.random.default_rng(3).normal(size=(40, 5))
    nets = [Autoencoder(x[:3].copy(), (8,), 1, 3e-3) for _ in range(2)]
    want = [nets[0].step(x)["loss"] for _ in range(3)]
    monkeypatch.setattr(Autoencoder, "near_data", None)
    assert [nets[1].step(x, report=False)["loss"] for _ in range(3)] == want
    assert (nets[0].flat() == nets[1].flat()).all()
