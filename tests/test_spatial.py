"""Permutation tests against numpy with the same bijection; cross-correlations by hand."""

import itertools

import numpy as np
import pytest

from simplark.operators import spatial as Y


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations_are_bijections_and_differ(n):
    made = [Y.partners(np.arange(n), n, p, 5) for p in range(6)]
    assert all(sorted(m.tolist()) == list(range(n)) for m in made)
    if n > 16:
        assert all((a != b).mean() > 0.7 for a, b in itertools.combinations(made, 2))
        whole = Y.partners(np.arange(n), n, 3, 5)
        assert (Y.partners(np.array([n - 1, 0, n // 2]), n, 3, 5) == whole[[n - 1, 0, n // 2]]).all()


@pytest.mark.parametrize("held", [Y.HELD, 0])
def test_permutation_test_equals_numpy(spark, held):
    rng = np.random.default_rng(0)
    n, perms = 40, 30
    points = rng.random((n, 2))
    near = np.argsort(((points[:, None] - points[None]) ** 2).sum(2), axis=1)[:, 1:5]
    z = np.column_stack((points[:, 0] + 0.1 * rng.normal(size=n), rng.normal(size=n)))
    ids = [3 * i + 7 for i in range(n)]
    edges = spark.createDataFrame([(ids[i], ids[int(j)], 1.0 + (i % 2)) for i in range(n) for j in near[i]], "src long, dst long, w double").repartition(3)
    values = spark.createDataFrame([(ids[i], f"f{k}", float(z[i, k])) for i in range(n) for k in range(2)], "cell_id long, feature string, value double")
    got = {r.feature: r for r in Y.permutation_test(edges, values, perms, 9, held).collect()}
    w = np.zeros((n, n))
    for i in range(n):
        w[i, near[i]] = 1.0 + i % 2
    s1, s2 = ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    for k in range(2):
        x = z[:, k] - z[:, k].mean()
        moran = lambda v: n / w.sum() * (w * np.outer(v, v)).sum() / (x @ x)
        geary = lambda v: (n - 1) / (2 * w.sum()) * (w * (v[:, None] - v[None]) ** 2).sum() / (x @ x)
        r = got[f"f{k}"]
        assert r.moran_i == pytest.approx(moran(x)) and r.geary_c == pytest.approx(geary(x))
        for name, of in (("moran", moran), ("geary", geary)):
            drawn = np.array([of(x[Y.partners(np.arange(n), n, p, 9)]) for p in range(perms)])
            over = (drawn >= of(x)).sum()
            assert r[f"{name}_mean"] == pytest.approx(drawn.mean()) and r[f"{name}_var"] == pytest.approx(drawn.var())
            assert r[f"{name}_p_sim"] == pytest.approx((min(over, perms - over) + 1) / (perms + 1))
        b2 = (x**4).mean() / (x**2).mean() ** 2
        want = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w.sum() ** 2) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * w.sum() ** 2)) / ((n - 1) * (n - 2) * (n - 3) * w.sum() ** 2) - 1 / (n - 1) ** 2
        assert r.var_random == pytest.approx(want)
    assert got["f0"].moran_p_sim < 0.05 < got["f1"].moran_p_sim


def test_large_tables_permute_without_values_beside_edges(spark):
    from pathlib import Path

    rng = np.random.default_rng(3)
    n, perms, features = 300, 40, 8
    z = rng.normal(size=(n, features))
    ends = np.column_stack((np.repeat(np.arange(n), 4), rng.integers(0, n, 4 * n)))
    links = spark.createDataFrame([(int(i), int(j), 1.0 + int(i) % 3) for i, j in ends], "i long, j long, w double").repartition(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(z)], "number long, z array<double>")
    written = lambda: sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).rglob("*") if f.is_file())
    before = written()
    got = {(r.p, r.f): (r.near, r.apart) for r in Y.permuted_sums(links, table, n, features, perms, 2, held=64 * features).collect()}
    assert written() - before < 8 * n * perms * features / 10  # the partners' values would be ten times that
    assert len(got) == (perms + 1) * features
    w = 1.0 + ends[:, 0] % 3
    for p in (-1, 0, perms - 1):
        to = np.arange(n) if p < 0 else Y.partners(np.arange(n), n, p, 2)
        a, b = z[to[ends[:, 0]]], z[to[ends[:, 1]]]
        for f in range(features):
            assert got[p, f] == pytest.approx(((w * a[:, f] * b[:, f]).sum(), (w * (a[:, f] - b[:, f]) ** 2).sum()))


def test_cross_correlations_need_more_than_fifty_cells(spark):
    rng = np.random.default_rng(1)
    cells = [(i, "a" if i % 3 == 0 else "b" if i % 3 == 1 else "c") for i in range(90)]
    w = rng.dirichlet(np.ones(2), 90)
    edges = [(i, int(j), 1.0) for i in range(90) for j in rng.choice(90, 12, replace=False)]
    frames = spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame(cells, "cell_id long, cell_type string"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "cell_id long, w array<double>")
    rows = Y.cross_correlations(*frames, ["a", "b"], more_than=50).collect()
    mean = {t: {i: np.mean([w[j] for s, j, _ in edges if s == i and cells[j][1] == t], axis=0) for i in range(90) if any(s == i and cells[j][1] == t for s, j, _ in edges)} for t in "ab"}
    both = sorted(mean["a"].keys() & mean["b"].keys())
    for r in rows:
        k = int(r.archetype[-1])
        a, b = (np.array([mean[t][i][k] for i in both]) for t in "ab")
        ranks = [np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) for v in (a, b)]
        assert r.n_cells == len(both) and r.spearman_r == pytest.approx(np.corrcoef(*ranks)[0, 1]) and 0 <= r.pvalue <= 1 and r.mean_weight_a == pytest.approx(a.mean())
    assert len(rows) == 2 and Y.cross_correlations(*frames, ["a", "b"], more_than=90).count() == 0
