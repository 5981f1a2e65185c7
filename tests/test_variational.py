"""The plain variational autoencoder: gradients, training on all rows, a round trip."""

import math

import numpy as np
import pytest

from simplark.operators.variational import VariationalEstimator, VariationalModel, VariationalNetwork


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2)) @ rng.normal(0, 2, (2, 6)) + rng.normal(0, 0.05, (240, 6))
    return spark.createDataFrame([(i, r.tolist(), "old") for i, r in enumerate(x)], "cell_id long, vec array<double>, latent string").repartition(3).checkpoint(), x


def test_gradients_of_all_parameters():
    rng = np.random.default_rng(1)
    x, noise = rng.normal(size=(30, 4)), rng.normal(size=(30, 2))
    net = VariationalNetwork(4, 2, (6, 5), seed=2, kld_weight=0.3)
    seen, grads = net.gradients(x, noise)
    assert math.isclose(seen["loss"], seen["reconstruction_loss"] + 0.3 * seen["kld"]) and math.isclose(seen["elbo"], -4 * seen["reconstruction_loss"] - 0.3 * seen["kld"])
    for p, g in zip(net.parameters(), grads, strict=True):
        for at in {0, p.size // 2, p.size - 1}:
            loss = []
            for h in (1e-5, -1e-5):
                p.flat[at] += h
                loss.append(net.gradients(x, noise)[0]["loss"])
                p.flat[at] -= h
            assert math.isclose((loss[0] - loss[1]) / 2e-5, g.flat[at], rel_tol=1e-3, abs_tol=1e-7)


def test_training_on_all_rows(spark, table, tmp_path):
    cells, x = table
    model = VariationalEstimator(2, (16, 8), epochs=12, batch=16, rate=1e-2, kld_weight=0.01).fit(cells)
    out = model.transform(cells).collect()
    assert len(out) == 240 and all(len(r.latent) == 2 and len(r.fitted) == 6 for r in out)
    assert math.sqrt(np.mean([r.error**2 for r in out])) < 0.6 * x.std()
    assert math.isclose(math.sqrt(np.mean([r.error**2 for r in out])), min(h["eval_rmse"] for h in model.history), rel_tol=1e-9)
    assert {r.metric for r in model.history_table(spark).collect()} == {"loss", "reconstruction_loss", "kld", "rmse", "elbo", "eval_rmse"}
    path = f"file://{tmp_path}/variational"
    model.save(spark, path)
    again = {r.cell_id: r.latent for r in VariationalModel.load(spark, path).transform(cells).collect()}
    assert all(np.allclose(again[r.cell_id], r.latent) for r in out)
    with pytest.raises(ValueError, match="no cells"):
        VariationalEstimator().fit(cells.limit(0))
