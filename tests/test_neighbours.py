"""Pruned neighbours against all pairs: clusters, copies, hot parts, few points."""

import numpy as np
import pytest

from simplark.operators import graph as G


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[: min(k, len(x) - 1)]}


def table(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "cell_id long, vec array<double>").repartition(4)


@pytest.mark.parametrize("kind", ["clusters", "plane", "random", "copies", "one"])
def test_pruned_neighbours_are_exact(spark, kind, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", (20, 40))
    monkeypatch.setattr(G, "VISITORS", 50)
    rng = np.random.default_rng(4)
    x = {
        "clusters": rng.normal(size=(12, 3))[rng.integers(0, 12, 400)] * 50 + rng.normal(size=(400, 3)),
        "plane": rng.integers(0, 12, (400, 2)).astype(float),
        "random": rng.normal(size=(300, 16)) + 1000,
        "copies": np.where(rng.random(300)[:, None] < 0.4, 0.0, rng.normal(size=(300, 4))),
        "one": np.zeros((1, 3)),
    }[kind]
    k = 7
    got = {(r.src, r.dst) for r in G.knn_edges(table(spark, x), k).collect()}
    assert got == brute(x, k)


def test_large_parts_meet_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 8))
    x[50:80] = x[7]
    ids = np.arange(len(x))
    tracemalloc.start()
    got = G.near_pairs(x[:300], ids[:300], x, ids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6  # a whole tile of distances to all rows would be 41 MB, and there were several
    d = np.sqrt(((x[:300, None] - x[None]) ** 2).sum(2)).round(9)
    d[ids[:300], ids[:300]] = np.inf
    assert {(r.src, r.dst) for r in got.itertuples()} == {(i, int(j)) for i in range(300) for j in np.lexsort((ids, d[i]))[:5]}


def test_clusters_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK_ROWS", (50, 50))
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 3))[rng.integers(0, 20, 1000)] * 500 + rng.normal(size=(1000, 3))
    r = G.compared_share(table(spark, x), 5).first()
    assert r.n == 1000 and r.share < 0.4
    assert G.compared_share(table(spark, rng.normal(size=(200, 32))), 5).first().share <= 1


def test_fates_by_joins_broadcast_no_vectors(spark, monkeypatch):
    n = 6
    steps = [(i, j, 0.5) for i in range(1, n - 1) for j in (i - 1, i + 1)] + [(0, 0, 1.0), (n - 1, n - 1, 1.0)]
    ends = spark.createDataFrame([(0, "a"), (n - 1, "b")], "cell_id long, archetype string")
    plans = []

    def noted(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    cut = G.cut
    monkeypatch.setattr(G, "cut", noted)
    got = {(r.cell_id, r.lineage): r.prob for r in G.fate_probabilities(spark.createDataFrame(steps, "src long, dst long, p double"), ends, dense_edges=0).collect()}
    assert all(abs(got[i, "b"] - i / (n - 1)) < 1e-5 for i in range(1, n))
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]
