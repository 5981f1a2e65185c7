"""Latent factors read their values once."""

import numpy as np

from simplark.operators import preprocess as R


def test_lsi_makes_its_values_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.poisson(1.0, (40, 6)) + 1.0
    one = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(6)], "cell_id long, j long, value double")
    names = spark.createDataFrame([(j, f"f{j}") for j in range(6)], "j long, feature string")
    values = one.join(names, "j").groupBy("cell_id", "feature").agg({"value": "sum"}).withColumnRenamed("sum(value)", "value")
    given = []
    plain = R.tfidf
    monkeypatch.setattr(R, "tfidf", lambda v: given.append(v) or plain(v))
    got = {r.cell_id: r.vec for r in R.lsi(values, 3).collect()}
    assert "Join" not in given[0]._jdf.queryExecution().executedPlan().toString()
    t = np.log1p(x / x.sum(1, keepdims=True)) * np.log1p(40 / x.sum(0))
    u, s, _ = np.linalg.svd(t, full_matrices=False)
    want = (u * s)[:, 1:3]
    have = np.array([got[i] for i in range(40)])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-8)
