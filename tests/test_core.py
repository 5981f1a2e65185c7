"""Closed forms, invariants and cross-checks of the archetype core and the statistics."""

import itertools
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplark.functions import special
from simplark.functions import vectors as V
from simplark.operators import archetypes as A
from simplark.operators import generate as N
from simplark.operators import graph as G
from simplark.operators import hull as L
from simplark.operators import model as M
from simplark.operators import patterns as P
from simplark.operators import preprocess as R
from simplark.operators import search as X
from simplark.operators import shape as H
from simplark.operators import stats as S
from simplark.operators import validate as D
from simplark.plans import core_queries
from simplark.sources import tables


@pytest.fixture(scope="module")
def points():
    return np.random.default_rng(3).normal(size=(60, 4)).round(3)


@pytest.fixture(scope="module")
def cells(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p], "ab"[i % 2]) for i, p in enumerate(points)], "cell_id long, vec array<double>, label string").cache()


def test_resolve_vector_column(cells):
    assert V.resolve_vector_column(cells.withColumnRenamed("vec", "PCA")) == "PCA"
    with pytest.raises(ValueError):
        V.resolve_vector_column(cells)


def test_distances_match_numpy(cells, points):
    y = points[:3].tolist()
    rows = A.distance_table(cells, y).orderBy("cell_id").collect()
    d = np.sqrt(((points[:, None] - points[None, :3]) ** 2).sum(2))
    assert np.allclose([[r.archetype_0_distance, r.archetype_1_distance, r.archetype_2_distance] for r in rows], d, atol=1e-8)
    assert [r.nearest_archetype for r in rows] == d.argmin(1).tolist()
    assert np.allclose([r.std_distance for r in rows], d.std(1), atol=1e-5)


def test_furthest_matches_a_loop(cells, points):
    taken = [0]
    while len(taken) < 4:
        near = np.sqrt(((points[:, None] - points[taken][None]) ** 2).sum(2)).round(9).min(1)
        taken.append(int(near.argmax()))
    assert np.allclose(A.furthest_archetypes(cells, 4), points[taken])


def test_bins_cover_every_cell_once_or_more(cells, points):
    y = points[:3].tolist()
    rows = A.bins(cells, y, 0.1).collect()
    assert {r.cell_id for r in rows} == set(range(60))
    by = {}
    for r in rows:
        by.setdefault(r.archetype_label, []).append(r)
    assert all(len(by[f"archetype_{i}"]) == 6 for i in range(4))
    assert all(r.rank_in_archetype == -1 and math.isnan(r.distance) for r in by["no_archetype"])
    d = np.sqrt(((points - points[1]) ** 2).sum(1))
    assert sorted(r.cell_id for r in by["archetype_2"]) == sorted(np.argsort(d, kind="stable")[:6].tolist())
    final = {r.cell_id: r.archetype for r in A.labels(A.bins(cells, y, 0.1)).collect()}
    assert len(final) == 60


def test_select_cells(spark):
    t = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.3, 0.6)], "cell_id int, archetype_0 double, archetype_1 double")
    assert [r.cell_id for r in A.select_cells(t, {"0": ">=50%"}).collect()] == [1]
    assert [r.cell_id for r in A.select_cells(t, {"archetype_1": "==60%", "0": "<40%"}).collect()] == [2]
    with pytest.raises(ValueError):
        A.select_cells(t, {"7": ">1%"})


def test_assign_to_centroids_is_greedy(spark):
    cells = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "cell_id long, vec array<double>")
    out = {r.cell_id: r.assigned for r in A.assign_to_centroids(cells, [("a", [0.0]), ("b", [1.0])], 0.2).collect()}
    assert [out[i] for i in range(5)] == ["a", "a", "b", "b", "unassigned"]


def test_recovery_and_statistics():
    y = [[0.0, 0.0], [4.0, 0.0], [0.0, 3.0]]
    s = A.archetype_statistics(y)
    assert s["max"] == 5 and s["nearest"] == (0, 2)
    r = A.recovery(y, [y[2], y[0], y[1]])
    assert r["matching"] == [1, 2, 0] and r["accuracy"] == 1 and r["mean_distance"] == 0
    cost = np.random.default_rng(0).normal(size=(5, 2))
    other = np.random.default_rng(1).normal(size=(5, 2))
    d = np.sqrt(((cost[:, None] - other[None]) ** 2).sum(2))
    best = min(sum(d[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5)))
    assert math.isclose(sum(d[i, j] for i, j in enumerate(A.match_archetypes(cost.tolist(), other.tolist()))), best)


def ranksum(a, b):
    pooled = sorted(a + b)
    rank = {v: np.mean([i + 1 for i, x in enumerate(pooled) if x == v]) for v in set(pooled)}
    return sum(rank[v] for v in a) - len(a) * (len(a) + 1) / 2


def test_rank_sums_match_brute_force_with_implicit_zeros(spark):
    rng = np.random.default_rng(5)
    labels = [(i, "abc"[i % 3]) for i in range(60)]
    dense = {(i, f): float(v) for i in range(60) for f, v in zip("xyz", rng.integers(0, 4, 3), strict=True)}
    dense |= {(i, "z"): 0.0 for i in range(60)}
    values = spark.createDataFrame([(i, f, v) for (i, f), v in dense.items() if v], "cell_id long, feature string, value double")
    tests = S.rank_sums(values, spark.createDataFrame(labels, "cell_id long, archetype string")).collect()
    assert {(r.feature, r.archetype) for r in tests} == {(f, a) for f in "xy" for a in "abc"}
    for r in tests:
        own = [dense[i, r.feature] for i, a in labels if a == r.archetype]
        rest = [dense[i, r.feature] for i, a in labels if a != r.archetype]
        assert r.statistic == ranksum(own, rest) and math.isclose(r.mean_archetype, np.mean(own), abs_tol=1e-6) and 0 <= r.pvalue <= 1


def test_scaling_and_row_order_leave_u_unchanged(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "f", float(v)) for i, v in enumerate(rng.integers(1, 9, 40))]
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "cell_id long, archetype string")
    u = [sorted(r.statistic for r in S.rank_sums(spark.createDataFrame(x, "cell_id long, feature string, value double"), labels).collect()) for x in (rows, rows[::-1], [(i, f, 3 * v) for i, f, v in rows])]
    assert u[0] == u[1] == u[2]


def bh(p):
    n = len(p)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * n / np.arange(1, n + 1))[::-1])[::-1]
    out = np.empty(n)
    out[order] = np.minimum(q, 1)
    return out


def test_fdr(spark):
    p = [0.01, 0.02, 0.03, 0.5, float("nan"), 0.04, 1.0, 0.0]
    df = spark.createDataFrame([(f"f{i}", "a", x) for i, x in enumerate(p)], "feature string, archetype string, pvalue double")
    got = {r.feature: r.fdr_pvalue for r in S.fdr(df).collect()}
    clean = [1.0 if x != x else x for x in p]
    assert np.allclose([got[f"f{i}"] for i in range(len(p))], bh(clean)) and all(got[f"f{i}"] >= c - 1e-12 for i, c in enumerate(clean))
    assert {r.fdr_pvalue for r in S.fdr(df, method="bonferroni").where("feature = 'f0'").collect()} == {0.08}
    with pytest.raises(ValueError):
        S.fdr(df, method="x")


def test_enrichment_tail_is_exact(spark):
    rows = [(i, "archetype_1" if i < 12 else "archetype_2", "u" if i % 3 or i < 8 else "v") for i in range(40)] + [(99, "no_archetype", "u"), (98, "archetype_1", None)]
    df = spark.createDataFrame(rows, "cell_id long, archetype string, c string")
    got = {(r.archetype, r.condition): r for r in S.enrichment(df, "c", min_cells=1).collect()}
    used = [r for r in rows if r[1] != "no_archetype" and r[2]]
    n, a, k = len(used), sum(r[1] == "archetype_1" for r in used), sum(r[2] == "u" for r in used)
    obs = sum(r[1] == "archetype_1" and r[2] == "u" for r in used)
    p = sum(math.comb(k, j) * math.comb(n - k, a - j) for j in range(obs, min(a, k) + 1)) / math.comb(n, a)
    assert got["archetype_1", "u"].observed == obs and math.isclose(got["archetype_1", "u"].pvalue, p, rel_tol=1e-9)


def test_tails(spark):
    for z in (0.0, 0.5, 1.96, 5.0):
        got = spark.sql(f"SELECT {special.two_sided_sql(str(z))} AS p").first().p
        assert math.isclose(got, math.erfc(z / 2**0.5), rel_tol=1e-6)
    assert math.isclose(special.student_two_sided(2.0, 10), 0.0733880, abs_tol=1e-6)
    lf = spark.range(200).select(special.log_factorial(F.col("id")).alias("x")).collect()
    assert all(math.isclose(r.x, math.lgamma(i + 1), rel_tol=1e-12, abs_tol=1e-12) for i, r in enumerate(lf))


def test_patterns_enumerate():
    names = ["archetype_0", "archetype_1", "archetype_2", "no_archetype"]
    codes = [(p["pattern_type"], p["pattern_code"]) for p in P.enumerate_patterns(names)]
    assert codes == [("specialization", "x1x_0xx"), ("specialization", "xx2_0xx"), ("tradeoff", "x1x_xx2"), ("tradeoff", "xx2_x1x")]
    assert [p["pattern_code"] for p in P.enumerate_patterns(names, specific=["1v2", "1v9"])] == ["x1x_xx2"]
    assert len(P.enumerate_patterns([f"archetype_{i}" for i in range(1, 5)])) == 4 * 3 + 4 * 3 + 12 + 6


def test_exclusive_patterns_find_the_planted_feature(spark):
    rng = np.random.default_rng(1)
    labels = [(i, f"archetype_{i % 3 + 1}") for i in range(90)]
    rows = [(i, f, float(rng.normal() + (4 if f == "hit" and i % 3 == 1 else 0))) for i in range(90) for f in ("hit", "none")]
    out = P.exclusive_pairwise(spark.createDataFrame(rows, "cell_id long, feature string, value double"), spark.createDataFrame(labels, "cell_id long, archetype string")).collect()
    assert [(r.feature, r.archetype) for r in out] == [("hit", "archetype_2")]


def test_knn_and_moran(spark, cells, points):
    e = G.knn_edges(cells.select("cell_id", "vec"), 5)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)).round(9)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), d[i]))[:5]}
    assert {(r.src, r.dst) for r in e.collect()} == want
    x = points[:, 0]
    v = spark.createDataFrame([(i, "f", float(a)) for i, a in enumerate(x)], "cell_id long, feature string, value double")
    z = x - x.mean()
    r = G.autocorrelation(e, v).first()
    assert math.isclose(r.moran_i, 60 / len(want) * sum(z[i] * z[j] for i, j in want) / (z @ z), rel_tol=1e-9)
    assert math.isclose(r.geary_c, 59 / (2 * len(want)) * sum((x[i] - x[j]) ** 2 for i, j in want) / (z @ z), rel_tol=1e-9)


def test_permuted_neighbourhoods_of_random_labels(spark, cells):
    e = G.knn_edges(cells.select("cell_id", "vec"), 5)
    rows = {(r.a, r.b): r for r in G.neighbourhood_enrichment(e, cells, "label").collect()}
    assert sum(r.n for r in rows.values()) == 300 and math.isclose(sum(r.mean for r in rows.values()), 300)
    pairs = np.array([(r.src, r.dst) for r in e.collect()])
    own = np.array([r.label for r in cells.orderBy("cell_id").collect()])
    rng = np.random.default_rng(0)
    drawn = {k: [] for k in rows}
    for _ in range(4000):
        mixed = rng.permutation(own)
        for a, b in rows:
            drawn[a, b].append(((mixed[pairs[:, 0]] == a) & (mixed[pairs[:, 1]] == b)).sum())
    for k, r in rows.items():
        assert abs(np.mean(drawn[k]) - r.mean) < 0.5 and abs(np.std(drawn[k]) / r.std - 1) < 0.05, k


def test_neighbours_of_blocks_are_those_of_all(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(70, 3)).round(1), np.zeros((8, 3)), 1e4 + rng.normal(size=(12, 3))))  # ties, equal points, a far group
    points = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "cell_id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).round(9)
    np.fill_diagonal(d, np.inf)
    for size in ((20, 20), (1000, 1000)):
        monkeypatch.setattr(G, "BLOCK_ROWS", size)
        got = {(r.src, r.dst) for r in G.knn_edges(points, 6).collect()}
        assert got == {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:6]}
    assert G.knn_edges(points.limit(0), 6).count() == 0 and G.knn_edges(points.limit(1), 6).count() == 0


def test_conditional_odds():
    def exact(x, r, c, t, level=0.95):
        low, high = max(0, r + c - t), min(r, c)
        w = lambda o: np.array([math.comb(c, j) * math.comb(t - c, r - j) * o ** (j - low) for j in range(low, high + 1)], float)
        p = lambda o: w(o) / w(o).sum()
        def solve(f):
            a, b = 1e-9, 1e9
            for _ in range(200):
                m = math.sqrt(a * b)
                a, b = (m, b) if f(m) < 0 else (a, m)
            return a
        js = np.arange(low, high + 1)
        return solve(lambda o: (js * p(o)).sum() - x), solve(lambda o: p(o)[js >= x].sum() - (1 - level) / 2), solve(lambda o: (1 - level) / 2 - p(o)[js <= x].sum())

    for x, r, c, t in ((7, 12, 9, 30), (2, 12, 9, 30), (20, 40, 35, 100)):
        assert np.allclose(special.fisher_odds(x, r, c, t), exact(x, r, c, t), rtol=1e-6)
    assert special.fisher_odds(5, 5, 9, 30)[0] == math.inf and special.fisher_odds(0, 5, 9, 30)[:2] == (0.0, 0.0)
    big = special.fisher_odds(30_000_000, 50_000_000, 50_000_000, 100_000_000)
    assert abs(big[0] / (30 * 30 / (20 * 20)) - 1) < 1e-4 and big[1] < big[0] < big[2]


def test_sparse_features_and_sides(spark):
    labels = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(100)], "cell_id long, archetype string")
    values = spark.createDataFrame([(0, "rare", 5.0)] + [(i, "some", float(i + 1)) for i in range(60)], "cell_id long, feature string, value double")
    rows = {(r.feature, r.archetype): r for r in S.rank_sums(values, labels).collect()}
    assert rows["rare", "a"].statistic == 0 and rows["rare", "a"].pvalue == 1 and rows["some", "a"].statistic > 0
    assert S.rank_sums(values, labels, min_nonzero=0).where("feature = 'rare' AND statistic > 0").count() == 2
    both = S.pathway_associations(values, labels, direction="both").collect()
    assert len(both) == 8 and {(r.test_direction, r.direction) for r in both} == {("greater", "higher"), ("less", "lower")}
    assert all(r.pvalue == 1 for r in both if r.feature == "rare")
    assert S.gene_associations(values, labels, min_logfc=0.0, direction="both_legacy").count() == 8
    with pytest.raises(ValueError):
        S.gene_associations(values, labels, direction="x")


def test_pattern_analysis_and_places(spark):
    rng = np.random.default_rng(8)
    binned = spark.createDataFrame([(i, f"archetype_{i % 4}") for i in range(120)] + [(i, "archetype_1") for i in range(0, 30, 4)], "cell_id long, archetype string")
    values = spark.createDataFrame([(i, f, float(rng.normal() + (3 if f == "x" and i % 4 == 1 else 0))) for i in range(120) for f in "xy"], "cell_id long, feature string, value double")
    out = P.pattern_analysis(values, A.labels(binned.withColumnRenamed("archetype", "archetype_label").withColumn("archetype_idx", F.lit(1))), binned)
    assert set(out) == {"individual", "patterns", "exclusivity"} and {"log_fold_change", "statistic"} <= set(out["patterns"].columns)
    assert out["patterns"].where("feature = 'x' AND significant").count() > 0
    fates = spark.createDataFrame([(i, "l", float((i * 7) % 10)) for i in range(50)], "cell_id long, lineage string, prob double")
    got = [(r.cell_id, r.place) for r in H.order_by_fate(fates, "l").orderBy("place").collect()]
    assert got == [(i, k) for k, i in enumerate(sorted(range(50), key=lambda i: ((i * 7) % 10, i)))]


def test_generate_and_validate(spark, cells, points):
    model = L.ArchetypeModel(points[:3].tolist())
    out = D.generate_and_validate(model, cells, 50)
    assert out["generated"].count() == 50 and out["components"].count() == 4 and out["distances"].count() == 3
    assert out["metrics"].first().n_effective >= 1 and out["similarity"].first().n == 50
    pairs = D.nearest_real(cells.where("cell_id < 5"), cells, 0.05).collect()
    d = np.sqrt(((points[:5, None] - points[None]) ** 2).sum(2)).round(9)
    assert {(r.src, r.dst) for r in pairs} == {(i, int(j)) for i in range(5) for j in np.lexsort((np.arange(60), d[i]))[:3]}
    tests, summary = D.validate_weights(model.transform(cells), model.transform(cells))
    assert summary.first().fraction_significant == 0 and tests.count() == 3


def test_detection_and_subsamples(spark, cells, tmp_path):
    names = spark.createDataFrame([("ENSG01",), ("ENSG02",), ("ABC",)], "feature string")
    assert R.looks_like_ensembl(names) and not R.looks_like_ensembl(names.where("feature = 'ABC'"))
    assert R.detect_columns(cells) == {"vectors": ["vec"], "categories": ["label"], "numbers": ["cell_id"]}
    values = spark.createDataFrame([(1, "f", 30.0)], "cell_id long, feature string, value double")
    assert R.resolve_colour(cells, values, "label").count() == 60 and R.resolve_colour(cells, values, "none") is None
    assert {r.colour for r in R.resolve_colour(cells, values, "f").collect()} == {0.0, 30.0}
    assert math.isclose(R.log_if_raw(values).first().value, math.log1p(30)) and R.log_if_raw(values, 40.0).first().value == 30
    path = f"file://{tmp_path}/cells"
    cells.write.parquet(path)
    assert tables.load_subsample(spark, path, 7).count() == 7 and tables.load_subsample(spark, path).count() == 60
    with pytest.raises(FileNotFoundError):
        tables.load_subsample(spark, f"{path}-none")
    folds = X.search(cells, X.SearchConfig((2,), ((8,),), folds=2, epochs=2))
    tables.save_search(folds, {"folds": 2}, f"file://{tmp_path}/search")
    again, config = tables.load_search(spark, f"file://{tmp_path}/search")
    assert config == {"folds": 2} and again.count() == 16
    table = H.elbow(again, "r2")
    assert H.facets(table) == {"facet_by": None, "color_by": "hidden_dims", "n_facets": 1} and H.convergence_table(again, ["config_id"]).first().epochs == 2
    typed = dict(tables.standardize(names, "association").dtypes)
    assert (typed["pvalue"], typed["significant"], typed["n_other_cells"], typed["direction"]) == ("double", "boolean", "bigint", "string")


def test_hypergeometric_tail_of_large_groups():
    for t, r, c, o in ((40, 12, 25, 9), (40, 12, 25, 3), (10, 10, 4, 4), (7, 3, 3, 0), (200, 90, 60, 30)):
        want = sum(math.comb(c, j) * math.comb(t - c, r - j) for j in range(max(o, r + c - t), min(r, c) + 1)) / math.comb(t, r)
        assert math.isclose(special.hypergeometric_upper(o, r, c, t), want, rel_tol=1e-9), (t, r, c, o)
    assert 0.4 < special.hypergeometric_upper(25_000_000, 50_000_000, 50_000_000, 100_000_000) < 0.6


def test_fates_both_ways(spark):
    # a walk on a line 0-1-2-3-4 that ends at both ends
    edges = [(i, j, 1.0) for i in range(5) for j in (i - 1, i + 1) if 0 <= j < 5]
    t = G.transition_matrix(spark.createDataFrame(edges, "src long, dst long, w double"))
    ends = spark.createDataFrame([(0, "l"), (4, "r")], "cell_id long, archetype string")
    want = {(i, "r"): i / 4 for i in range(1, 5)}
    for dense in (100, 0):
        got = {(r.cell_id, r.lineage): r.prob for r in G.fate_probabilities(t, ends, dense_edges=dense, tolerance=1e-4).collect()}
        assert all(abs(got.get(k, 0) - v) < 2e-3 for k, v in want.items())
        assert all(abs(got.get((i, "l"), 0) + got.get((i, "r"), 0) - 1) < 5e-3 for i in range(5))
    assert G.diagnose_transitions(t).first().max_row_error < 1e-12


def test_tfidf_and_aucell(spark):
    v = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 1.0)], "cell_id long, feature string, value double")
    got = {(r.cell_id, r.feature): r.value for r in R.tfidf(v).collect()}
    assert math.isclose(got[1, "a"], math.log1p(0.5) * math.log1p(2 / 3)) and math.isclose(got[2, "a"], math.log1p(1) * math.log1p(2 / 3))
    net = spark.createDataFrame([("s", " A "), ("t", "q")], "source string, target string")
    scores = {(r.cell_id, r.pathway): r.score for r in R.aucell(v, net, top=0.5).collect()}
    assert scores == {(1, "s"): 1.0, (2, "s"): 1.0}


def test_lsi_and_pca_shapes(spark, cells, points):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, f"f{j}", float(x)) for i in range(20) for j, x in enumerate(rng.integers(0, 5, 8)) if x], "cell_id long, feature string, value double")
    assert {len(r.vec) for r in R.lsi(v, 4).collect()} == {3}
    t, loadings, shares = R.pca(cells, 2)
    assert len(loadings) == 4 and shares[0] >= shares[1]
    x = np.array([r.vec for r in t.orderBy("cell_id").collect()])
    u, s, _ = np.linalg.svd(points - points.mean(0), full_matrices=False)
    assert np.allclose(np.abs(x), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_hull_recovers_planted_archetypes(spark):
    planted = N.planted_archetypes(3, 6, "sphere")
    cells = N.convex_cells(spark, 150, planted, 0.1)
    model = L.ArchetypeEstimator(3, "pcha", iterations=60).fit(cells)
    assert A.recovery(planted, model.archetypes, 1.0)["accuracy"] == 1
    w = np.array([r.w for r in model.transform(cells).collect()])
    assert np.allclose(w.sum(1), 1, atol=1e-3) and (w >= 0).all()
    assert A.r_squared(model.reconstruct(model.transform(cells))).first().r2 > 0.9
    with pytest.raises(ValueError):
        L.ArchetypeEstimator(9, "pcha").fit(cells)


def test_model_round_trip(spark, tmp_path):
    m = L.ArchetypeModel([[1.0, 2.0], [3.0, 4.0]])
    m.save(spark, f"file://{tmp_path}/m")
    assert L.ArchetypeModel.load(spark, f"file://{tmp_path}/m").archetypes == m.archetypes


def test_autoencoder_learns(points):
    planted = np.array(N.planted_archetypes(3, 6, "sphere", 3.0))
    w = np.random.default_rng(0).dirichlet(np.ones(3), 150)
    x = w @ planted
    model, history = M.train_autoencoder(x, 3, epochs=30, hidden=(32,), inflation=1.0)
    assert history[-1]["archetype_r2"] > max(0.05, history[0]["archetype_r2"])
    assert np.allclose(model.weights(x).sum(1), 1)
    assert -2 <= history[-1]["archetype_r2"] <= 1


def test_autoencoder_gradient():
    rng = np.random.default_rng(0)
    model = M.Autoencoder(rng.normal(size=(3, 4)), (5,), seed=1, rate=0.0, diversity=0.05)
    x = rng.normal(size=(7, 4))
    seen = {}
    model.adam = lambda g: seen.setdefault("g", [a.copy() for a in g])
    state = model.rng.bit_generator.state
    model.step(x)
    for i in (0, 2, 4, 6):
        p, grads = model.parameters()[i], seen["g"]
        loss = []
        for h in (1e-5, -1e-5):
            p.flat[0] += h
            model.rng.bit_generator.state = state
            model.adam = lambda g: None
            loss.append(model.step(x)["loss"])
            p.flat[0] -= h
        assert math.isclose((loss[0] - loss[1]) / 2e-5, grads[i].flat[0], rel_tol=1e-3, abs_tol=1e-6), i


def test_search_config():
    c = X.SearchConfig(epochs=7, preset="fast")
    assert (c.epochs, c.patience) == (7, 3) and len(c.grid()) == 4
    with pytest.raises(ValueError):
        X.SearchConfig(folds=1)


def test_search_runs_every_fold(spark, cells):
    folds = X.search(cells, X.SearchConfig((2, 3), ((8,),), folds=2, epochs=2))
    assert folds.groupBy("config_id", "fold").count().count() == 4
    summary = H.fold_summary(folds, ["config_id"])
    assert H.rank_configurations(summary, "rmse", ["config_id"]).count() == 2 and "best" in X.report(summary)


def test_generation_stays_where_it_should(spark, cells, points):
    b = N.sample_coordinates(cells, 100, "normal").collect()
    assert len(b) == 100
    x = np.array([r.vec for r in b])
    assert (x >= points.min(0) - 1e-9).all() and (x <= points.max(0) + 1e-9).all()
    inside = np.array([r.vec for r in N.specialists(spark, [1.0, 2.0, 3.0], 100, 0.5).collect()])
    assert (np.sqrt(((inside - [1, 2, 3]) ** 2).sum(1)) <= 0.5 + 1e-9).all()
    same = N.compare_coordinates(cells, cells).collect()
    assert all(r.statistic == 0 and r.pvalue == 1 for r in same)


def test_shapes(spark):
    df = spark.createDataFrame([("a", "f1", -3.0, 0.01), ("a", "f2", 2.0, 0.0), ("a", "f3", 1.0, 0.2), ("b", "f1", float("nan"), 0.1)], "archetype string, feature string, log_fold_change double, pvalue double")
    assert [r.feature for r in H.top_associations(df, "archetype", "log_fold_change", 1).collect()] == ["f1"]
    p = spark.createDataFrame([(0.0,), (1e-5,), (float("nan"),)], "p double").select(H.log_p("p").alias("x")).collect()
    assert p[0].x == 300 and math.isclose(p[1].x, 5) and math.isnan(p[2].x)
    h = spark.createDataFrame([("m", i, float(i)) for i in range(1, 8)], "metric string, epoch int, value double")
    assert [r.rolling for r in H.rolling_mean(h, 5).orderBy("epoch").collect()] == [3.0, 4.0, 5.0]
    assert H.convergence(h).first().convergence_rate == 4 / 5
    sizes = [r.size for r in H.rescale(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v").orderBy("v").collect()]
    assert sizes == [50.0, 400.0]


def test_sources(spark, tmp_path):
    (tmp_path / "a.gmt").write_text("s1\turl\tA\tB\ns2\turl\nbad\n")
    net = tables.load_networks(spark, {"c5_bp": str(tmp_path / "a.gmt")}, ["c5_bp", "unknown"])
    assert sorted((r.source, r.target, r.pathway) for r in net.collect()) == [("s1", "A", "C5_BP"), ("s1", "B", "C5_BP")]
    with pytest.raises(ValueError):
        tables.load_networks(spark, {}, ["c5_bp"])
    tables.write_csv(net, f"{tmp_path}/csv")
    assert tables.read_csv(spark, f"{tmp_path}/csv", net.schema).count() == 2
    with pytest.raises(ValueError):
        tables.validate(net, "association")
    tables.validate(tables.standardize(net.withColumnRenamed("source", "gene"), "association"), "association")


def test_entry_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "simplark", tmp_path / "simplark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 't2_gene_associations' in q and set(o) <= set(q) and not any(n.startswith('op') for n in q)"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True)
    assert run().returncode == 0
    (tmp_path / "corpus_pipeline.py").write_text("from simplark.llm import queries\n")
    assert run().returncode == 0
    (tmp_path / "simplark" / "llm").mkdir()  # an empty folder that is left behind
    assert run().returncode == 0
    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_missing\n")
    assert b"a_library_that_is_missing" in run().stderr


def test_fates_of_a_slow_walk_are_whole_on_every_path(spark):
    n = 30  # a path with a terminal cell at each end, and two cells that only lead to each other
    steps = [(i, j, 0.5) for i in range(1, n - 1) for j in (i - 1, i + 1)] + [(0, 1, 1.0), (n - 1, n - 2, 1.0), (100, 101, 1.0), (101, 100, 1.0), (50, 100, 0.5), (50, 15, 0.5)]
    transitions = spark.createDataFrame(steps, "src long, dst long, p double").checkpoint()
    terminal = spark.createDataFrame([(0, "a"), (n - 1, "b")], "cell_id long, archetype string")
    ends = terminal.toPandas()
    want = {i: i / (n - 1) for i in range(n)} | {50: 15 / (n - 1) / 2}
    paths = {"dense": G.solved_fates(spark, transitions.toPandas(), ends), "sweeps": G.solved_fates(spark, transitions.toPandas(), ends, most=0), "joins": G.fate_probabilities(transitions, terminal, dense_edges=0)}
    for name, fates in paths.items():
        rows = {(r.cell_id, r.lineage): r.prob for r in fates.collect()}
        assert all(abs(rows.get((i, "b"), 0.0) - x) < 1e-5 for i, x in want.items()), name
        assert abs(rows[50, "a"] + rows[50, "b"] - 0.5) < 1e-5 and not any(c in (100, 101) for c, _ in rows), name
    with pytest.raises(RuntimeError):
        G.fate_probabilities(transitions, terminal, rounds=2, dense_edges=0)
    with pytest.raises(RuntimeError):
        G.solved_fates(spark, transitions.toPandas(), ends, most=0, sweeps=20)


def test_all_levels_take_cells(spark, tmp_path):
    rows = [(i, [float(i % 10), float(i // 10) / 100], i % 10) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    out = {r.assigned for r in core_queries.a6_assign_to_centroids(spark, f"file://{tmp_path}").collect()}
    assert {"0", "1", "2", "3", "4", "5"} <= out


def test_hull_sizes():
    cube = [[float(i >> a & 1) for a in range(3)] for i in range(8)]
    volume, area = A.hull_size(np.array([*cube, [0.5, 0.5, 0.5]]))
    assert math.isclose(volume, 1) and math.isclose(area, 6)
    simplex = np.vstack([np.zeros(4), np.eye(4)])
    volume, area = A.hull_size(simplex)
    assert math.isclose(volume, 1 / 24) and math.isclose(area, 4 / 6 + 2 / 6)
    cross = np.vstack([np.eye(3), -np.eye(3)]) * 2
    assert math.isclose(A.hull_size(cross)[0], 8 * 8 / 6) and math.isclose(A.hull_size(cross)[1], 8 * 3**0.5 / 4 * 8)
    flat = A.archetype_statistics([[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]])
    assert flat["hull_volume"] is None and flat["hull_area"] is None
    assert "hull_volume" not in A.archetype_statistics([[1.0, 0], [0, 1.0]])
