"""The autoencoder on all rows: gradients of every loss term, training by averaged states, round trips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplark.operators import archetypes as A
from simplark.operators import model as M
from simplark.operators import preprocess as R
from simplark.operators import training as T
from simplark.operators import validate as D


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    planted = rng.normal(0, 3, (3, 5))
    x = rng.dirichlet(np.ones(3) * 0.5, 300) @ planted + rng.normal(0, 0.05, (300, 5))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, vec array<double>").repartition(3).checkpoint(), x


def test_gradients_of_every_term():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    model = M.Autoencoder(3 * rng.normal(size=(3, 4)), (6, 5), seed=1, regularity=0.7, sparsity=0.3, manifold=0.2, normalise=True, decoder=True)
    seen = {}
    state = model.rng.bit_generator.state
    model.adam = lambda g: seen.setdefault("g", [a.copy() for a in g])
    model.step(x)
    grads, model.adam = seen["g"], lambda g: None
    assert [g.shape for g in grads] == [p.shape for p in model.parameters()]
    for i, p in enumerate(model.parameters()):
        for at in {0, p.size - 1}:
            loss = []
            for h in (1e-6, -1e-6):
                p.flat[at] += h
                model.rng.bit_generator.state = state
                loss.append(model.step(x)["loss"])
                p.flat[at] -= h
            assert np.isclose((loss[0] - loss[1]) / 2e-6, grads[i].flat[at], rtol=1e-3, atol=1e-5), (i, at)


def test_an_epoch_averages_the_tasks(spark, mixed):
    cells, _ = mixed
    model = M.Autoencoder(np.eye(5)[:3], (4,), seed=2, normalise=True)
    parts = [np.array([r.vec for r in rows]) for rows in cells.select("vec").rdd.glom().collect()]
    n, sse, metrics, state = T.epoch_sums(cells.select("vec"), model, 0, 32, 7)
    want, error, before = np.zeros_like(model.flat()), 0.0, model.flat()
    for i, x in enumerate(parts):
        own = M.Autoencoder(np.eye(5)[:3], (4,), seed=2, normalise=True)
        error += ((own.reconstruct(x) - x) ** 2).sum()
        own.rng = np.random.default_rng([7, 0, i])
        for part in np.array_split(own.rng.permutation(len(x)), max(1, len(x) // 32)):
            own.step(x[part])
        want += own.flat() * len(x)
    assert n == 300 and np.isclose(sse, error) and np.allclose(state, want / 300)
    assert (model.flat() == before).all() and len(metrics) == len(T.METRICS)


def test_training_on_all_rows(spark, mixed, tmp_path):
    cells, x = mixed
    folder = f"file://{tmp_path}/best"
    model = T.AutoencoderEstimator(3, epochs=25, hidden=(16,), batch=16, rate=1e-2, inflation=1.0, checkpoint=folder).fit(cells)
    r2 = [h["archetype_r2"] for h in model.history]
    assert len(r2) == 25 and max(r2) > 0.8 > r2[0]
    clash = cells.withColumns({"w": F.lit(1), "latent": F.lit("x"), "__cell_id": F.lit(2)})
    out = model.reconstruct(model.transform(clash))
    assert out.columns == ["cell_id", "vec", "__cell_id", "w", "latent", "log_var", "fitted"]
    rows = out.orderBy("cell_id").collect()
    w = np.array([r.w for r in rows])
    assert np.allclose(w.sum(1), 1) and np.allclose(w, model.network.weights(x)) and np.allclose([r.fitted for r in rows], model.network.reconstruct(x))
    # The best state is kept: its R² over all rows is the best of the history.
    assert np.isclose(A.r_squared(out).first().r2, max(r2), atol=1e-4)
    again = T.AutoencoderModel.load(spark, folder)
    assert np.allclose(again.network.reconstruct(x), model.network.reconstruct(x)) and again.archetypes == model.archetypes
    metrics = D.generation_metrics(out).first()
    assert np.isclose(metrics.archetypal_r2, max(r2), atol=1e-4)
    assert model.projected(2) == [y[:2] for y in model.archetypes]
    assert np.allclose(model.projected(2, np.eye(5).tolist(), [1.0] * 5), np.array(model.archetypes)[:, :2] - 1)


def test_early_stop_and_errors(spark, mixed):
    cells, _ = mixed
    model = T.AutoencoderEstimator(3, epochs=30, hidden=(4,), rate=0.0, patience=2).fit(cells)
    assert len(model.history) == 2
    with pytest.raises(ValueError):
        T.AutoencoderEstimator(3).fit(cells.limit(0))
    with pytest.raises(ValueError):
        T.AutoencoderEstimator(6).fit(cells)
    one = T.AutoencoderEstimator(3, epochs=2, hidden=(4,), decoder=True, normalise=True).fit(cells.limit(1).unionByName(cells.limit(1)))
    assert np.isfinite(one.network.flat()).all()


@pytest.mark.parametrize("rank", [9, 2])
def test_wide_tables_give_the_same_components(spark, rank):
    """Above the dense bound the vectors come from joins: the same scores, also where the table has fewer dimensions than asked for."""
    rng = np.random.default_rng(4)
    x = rng.poisson(rng.gamma(1, 1, (30, rank)) @ rng.gamma(0.5, 2, (rank, 14)) * 3) if rank > 2 else np.outer(rng.integers(1, 4, 30), rng.integers(1, 5, 14))
    v = spark.createDataFrame([(i, f"f{j}", float(c)) for i, row in enumerate(x) for j, c in enumerate(row) if c], "cell_id long, feature string, value double").checkpoint()
    dense, wide = ({r.cell_id: r.vec for r in R.lsi(v, 4, dense_features=n).collect()} for n in (4000, 0))
    assert dense.keys() == wide.keys() and len(dense) == 30
    assert all(len(wide[c]) == 3 and np.allclose(dense[c], wide[c], atol=1e-4) for c in dense)


def test_singular_vectors_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 40)) * 0.85 ** np.arange(40)  # more features than vectors of the subspace, so it has to turn
    v = spark.createDataFrame([(i, f"f{j:02}", float(c)) for i, row in enumerate(x) for j, c in enumerate(row)], "cell_id long, feature string, value double").checkpoint()
    got = np.array([r.v for r in R.right_vectors(v, 3).orderBy("feature").collect()])
    want = np.linalg.svd(x)[2][:3].T
    assert np.allclose(np.abs(got.T @ want), np.eye(3), atol=1e-4)
    with pytest.raises(RuntimeError):
        R.right_vectors(v, 1, rounds=1, tolerance=0.0)


def test_drift_of_each_archetype(spark, mixed):
    """Every epoch reports how far each archetype moved, and the history's own summary of them."""
    cells, _ = mixed
    model = T.AutoencoderEstimator(3, epochs=3, hidden=(8,), batch=64).fit(cells)
    for h in model.history:
        each = np.array([h[f"drift_archetype_{i}"] for i in (1, 2, 3)])
        assert np.isclose(h["drift"], each.mean()) and np.isclose(h["drift_max"], each.max()) and np.isclose(h["drift_variance"], each.var()) and (each > 0).all()
    steps = T.moved(np.zeros((2, 2)), np.array([[3.0, 4.0], [0.0, 0.0]]))
    assert steps == {"drift": 2.5, "drift_max": 5.0, "drift_variance": 6.25, "drift_archetype_1": 5.0, "drift_archetype_2": 0.0}
