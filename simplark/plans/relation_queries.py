"""Queries of patterns, graphs, preprocessing and result shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.functions import special
from simplark.operators import archetypes as A
from simplark.operators import graph as G
from simplark.operators import pairs as Q
from simplark.operators import patterns as P
from simplark.operators import preprocess as R
from simplark.operators import shape as H
from simplark.operators import spatial as Y
from simplark.operators import stats as S
from simplark.plans import core_queries as C
from simplark.plans import inputs as I

NEIGHBOURS = 10
NAMES = [f"archetype_{i}" for i in range(I.K + 1)]


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bins(I.cells(spark, sf_dir), I.archetypes(spark, sf_dir), I.SHARE).where("archetype_label <> 'no_archetype'").select("cell_id", F.col("archetype_label").alias("archetype"))


def pattern_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pattern_associations(I.dims(spark, sf_dir), memberships(spark, sf_dir), P.pattern_table(spark, P.enumerate_patterns(NAMES)))


def t7_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns of the bins that the cells are in, with the cells on either side."""
    members = memberships(spark, sf_dir).checkpoint()
    names = [r.archetype for r in members.select("archetype").distinct().orderBy("archetype").collect()]  # a label each
    t = P.pattern_table(spark, P.enumerate_patterns(names))
    side = lambda c: t.select("pattern_code", F.explode(c).alias("archetype")).join(members, "archetype").groupBy("pattern_code").agg(F.count_distinct("cell_id").alias(f"n_{c}_cells"))
    t = t.join(side("high"), "pattern_code").join(side("low"), "pattern_code")
    return t.select("pattern_code", "pattern_type", "complexity", P.code_complexity(F.col("pattern_code")).alias("digits"), P.reversed_code(F.col("pattern_code")).alias("reversed"), "n_high_cells", "n_low_cells")


def t8_pattern_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.p_rounded(pattern_tests(spark, sf_dir))
    return t.select("feature", "pattern_code", "pattern_type", "n_high_cells", "n_low_cells", "mean_high", "mean_low", "mean_diff", "statistic", "z", "pvalue", "fdr_pvalue", "significant", "direction", "passes_lfc_threshold")


def t9_exclusive_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.exclusive_pairwise(I.dims(spark, sf_dir), memberships(spark, sf_dir), min_effect=0.02)


def t9_exclusive_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = S.pathway_associations(I.dims(spark, sf_dir), I.assigned(spark, sf_dir))
    return C.p_rounded(P.exclusive_one_vs_rest(tests))


def t11_specialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.specialization(pattern_tests(spark, sf_dir))
    return t.select("feature", "archetype", "pattern_code", "mean_diff", F.round("pvalue", 6).alias("pvalue"), "significant")


def t12_tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tradeoffs(pattern_tests(spark, sf_dir))
    return t.select("feature", "pattern_code", "high_archetypes", "low_archetypes", "mean_high", "mean_low", "mean_diff")


def t12_group_tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tradeoffs between groups of up to two archetypes (the operator's default for these bins)."""
    tests = P.pattern_associations(I.dims(spark, sf_dir), memberships(spark, sf_dir), P.pattern_table(spark, P.enumerate_patterns(NAMES)))
    return P.tradeoffs(tests, "patterns").select("feature", "pattern_code", "high_archetypes", "low_archetypes", "mean_high", "mean_low", "mean_diff", F.round("pvalue", 6).alias("pvalue"))


def w9_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by their weight of the first archetype, in the part of a fate."""
    shares = C.weights(spark, sf_dir).select("cell_id", F.lit("archetype_1").alias("lineage"), F.round(F.col("w")[0], 9).alias("prob"))
    return H.order_by_fate(shares, "archetype_1").select("cell_id", F.col("place").cast("long").alias("place"))


def g6_long_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = I.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("price"), F.round(F.avg("p_size"), 4).alias("size"))
    return H.long_metrics(wide, ["p_brand"])


def p15_log_if_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.log_if_raw(I.counts(spark, sf_dir)).withColumn("value", F.round("value", 6))


def p25_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand's quantity of every customer."""
    cells = I.segments(spark, sf_dir)
    return R.resolve_colour(cells, I.counts(spark, sf_dir), "Brand#11")


def t13_mutual_exclusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.mutual_exclusivity(pattern_tests(spark, sf_dir), min_effect=0.02)
    return t.select("feature", F.size("positive_patterns").cast("long").alias("n_positive"), F.size("negative_patterns").cast("long").alias("n_negative"), "max_positive_effect", "min_negative_effect", "effect_range")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.knn_edges(I.cells(spark, sf_dir).select("cell_id", "vec"), NEIGHBOURS)


def r1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


def r2_label_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_edges(edges(spark, sf_dir), I.cells(spark, sf_dir), "label")


def r2_nhood_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.neighbourhood_enrichment(edges(spark, sf_dir), I.cells(spark, sf_dir), "label")
    return t.select("a", "b", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "z")])


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cells(spark, sf_dir).select("cell_id", F.col("label").alias("archetype"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def r3_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Q.co_occurrence(plane(spark, sf_dir), [0.02, 0.05, 0.1])
    return t.withColumn("ratio", F.round("ratio", 6))


def r4_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.autocorrelation(edges(spark, sf_dir), I.dims(spark, sf_dir))
    return t.select("feature", *[F.round(c, 6).alias(c) for c in ("moran_i", "geary_c", "expected_i", "pvalue")], F.round("z", 5).alias("z"))


def r4_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the operator's hundred permutations of all cells."""
    return Y.permutation_test(edges(spark, sf_dir), I.dims(spark, sf_dir))


def t16_cross_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir).select("cell_id", F.col("label").alias("cell_type"))
    t = Y.cross_correlations(edges(spark, sf_dir), cells, C.weights(spark, sf_dir), ["0", "1"])
    return t.select("archetype", *[F.round(c, 6).alias(c) for c in ("spearman_r", "mean_weight_a", "mean_weight_b")], "n_cells")


def r1_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all pairs that the neighbour graph compares."""
    return G.compared_share(I.cells(spark, sf_dir), NEIGHBOURS)


def r5_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir).select("cell_id", F.col("label").alias("cell_type"))
    t = G.interaction_boundaries(edges(spark, sf_dir), cells, C.weights(spark, sf_dir), "0", "1")
    return t.withColumn("boundary_score", F.round("boundary_score", 5))


def r7_high_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = C.weights(spark, sf_dir).withColumn("w", F.transform("w", lambda x: F.round(x, 9)))
    return G.high_purity(w, I.assigned(spark, sf_dir))


def fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    terminal = G.high_purity(C.weights(spark, sf_dir), I.assigned(spark, sf_dir)).checkpoint()
    return G.fate_probabilities(G.transition_matrix(edges(spark, sf_dir)).checkpoint(), terminal)


def r6_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fates(spark, sf_dir).withColumn("prob", F.round("prob", 4))


def r8_pseudotimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pseudotimes(fates(spark, sf_dir), NAMES[1:])


def r9_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here the share of a cell's neighbours with a label stands for its fate, so that SQL can follow."""
    labels = I.assigned(spark, sf_dir).select(F.col("cell_id").alias("dst"), F.col("archetype").alias("lineage"))
    shares = G.transition_matrix(edges(spark, sf_dir)).join(labels, "dst").groupBy(F.col("src").alias("cell_id"), "lineage").agg(F.round(F.sum("p"), 9).alias("prob"))
    return G.transition_frequencies(C.weights(spark, sf_dir), I.assigned(spark, sf_dir), shares)


def r10_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir).select("cell_id", "label")
    return G.single_trajectory(cells, I.assigned(spark, sf_dir), C.weights(spark, sf_dir), fates(spark, sf_dir), "archetype_1", "archetype_2", fate=0.05)


def r11_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.diagnose_transitions(G.transition_matrix(edges(spark, sf_dir)))
    return t.select("n_rows", F.round("max_row_error", 6).alias("max_row_error"), F.round("max_asymmetry", 6).alias("max_asymmetry"))


def r12_paga(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = G.paga(edges(spark, sf_dir), I.cells(spark, sf_dir), "label")
    return t.withColumn("connectivity", F.round("connectivity", 6))


def t15_lineage_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = C.weights(spark, sf_dir).select("cell_id", F.round(F.col("w")[0], 9).alias("y"))
    t = G.spearman(I.dims(spark, sf_dir), target)
    return t.select("feature", "n", F.round("correlation", 6).alias("correlation"))


def p12_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tfidf(I.counts(spark, sf_dir)).withColumn("value", F.round("value", 9))


def p15_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.counts(spark, sf_dir)
    return R.normalize(v).join(R.quality(v), "cell_id").withColumn("value", F.round("value", 6))


def p15_variable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = I.segments(spark, sf_dir).count()
    t = R.variable_features(I.counts(spark, sf_dir), n, 10)
    return t.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "var", "dispersion")])


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.table(spark, sf_dir, "part").select(F.col("p_name").alias("target")).distinct()
    return words.select("target", F.explode(F.slice(F.split("target", " "), 1, 2)).alias("source"), F.lit(1.0).alias("weight"), F.lit("PART").alias("pathway")).distinct()


def t14_aucell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.aucell(I.counts(spark, sf_dir, "p_name"), network(spark, sf_dir), top=0.1).withColumn("score", F.round("score", 6))


def a29_lsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lsi(I.counts(spark, sf_dir), 6)


def a30_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pca(I.cells(spark, sf_dir), 5)[0]


def j3_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = I.table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_name").alias("feature")).distinct()
    return R.pathway_members(network(spark, sf_dir), features).select("source", "target")


def k1_top_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = S.gene_associations(I.counts(spark, sf_dir), I.segments(spark, sf_dir))
    return H.top_associations(tests, "archetype", "log_fold_change", 3, drop_zero_p=False).select("archetype", "feature", "log_fold_change")


def k2_top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.top_with_ties(I.table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", 5)


def k8_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    t = H.rescale(rows, "s_acctbal")
    return H.dot_positions(t, "s_nationkey", "size", "s_suppkey").select("s_suppkey", F.round("size", 6).alias("size"), "y")


def p11_log_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = S.rank_sums(I.counts(spark, sf_dir), I.segments(spark, sf_dir)).withColumn("pvalue", F.round("pvalue", 6))
    return tests.select("feature", "archetype", F.round(H.log_p("pvalue"), 6).alias("log_p"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("epoch"), "value")


def w5_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rolling_mean(history(spark, sf_dir)).select("metric", "epoch", F.round("rolling", 6).alias("rolling"))


def w6_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.drift(history(spark, sf_dir)).select("metric", "epoch", F.round("step", 6).alias("step"), F.round("recent_variance", 6).alias("recent_variance"))


def w7_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.convergence(history(spark, sf_dir)).select("metric", F.round("convergence_rate", 6).alias("convergence_rate"), F.round("stability", 6).alias("stability"))


def a26_metric_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.metric_summaries(history(spark, sf_dir)).select("metric", *[F.round(c, 4).alias(c) for c in ("final", "min", "max", "range", "improvement")])


def g4_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = I.table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("config_id"), F.col("event_type").alias("metric"), "value")
    return H.fold_summary(folds, ["config_id"]).select("config_id", "metric", *[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max")])


def g12_axis_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.axis_ranges(plane(spark, sf_dir), ["x", "y"]).select("axis", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


QUERIES = {f.__name__: f for f in (
    t7_patterns, t8_pattern_associations, t9_exclusive_pairwise, t9_exclusive_one_vs_rest, t11_specialization, t12_tradeoffs, t12_group_tradeoffs, w9_order, g6_long_metrics, p15_log_if_raw, p25_colour, t13_mutual_exclusivity, r1_knn, r2_label_edges, r2_nhood_enrichment, r3_co_occurrence,
    r1_compared, r4_autocorrelation, r4_permutations, t16_cross_correlations, r5_boundaries, r6_fates, r7_high_purity, r8_pseudotimes, r9_transitions, r10_trajectory, r11_diagnose, r12_paga, t15_lineage_drivers, p11_log_p, p12_tfidf, p15_normalize, p15_variable_features,
    t14_aucell, a29_lsi, a30_pca, j3_members, k1_top_associations, k2_top_with_ties, k8_rescale, w5_rolling, w6_drift, w7_convergence, a26_metric_summaries, g4_folds, g12_axis_ranges,
)}

KNN = f"""d AS (SELECT a.cell_id AS src, b.cell_id AS dst, round(list_distance(a.vec, b.vec), 9) AS d FROM cells a JOIN cells b ON a.cell_id <> b.cell_id),
    edges AS (SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS r FROM d) WHERE r <= {NEIGHBOURS})"""
SIDES = "sides AS (SELECT m, (SELECT list(i ORDER BY i) FROM range(1, 5) t(i) WHERE (m >> (i - 1)) & 1 = 1) AS l FROM range(1, 16) s(m))"
CODE = "(SELECT string_agg(CASE WHEN list_contains({}, n) THEN n::VARCHAR ELSE 'x' END, '' ORDER BY n) FROM range(0, 5) t(n))"
NAMED = "array_to_string(list_transform({}, lambda i: 'archetype_' || i), '{}')"
ALL_PATTERNS = f"""{SIDES},
    ps AS (SELECT [i] AS hl, [0] AS ll, 'specialization' AS pattern_type FROM range(1, 5) t(i) UNION ALL SELECT h.l, o.l, 'tradeoff' FROM sides h, sides o WHERE h.m & o.m = 0 AND len(h.l) <= 2 AND len(o.l) <= 2),
    pat AS (SELECT *, concat_ws('_', {CODE.format('hl')}, {CODE.format('ll')}) AS pattern_code, len(hl) + len(ll) AS complexity, {NAMED.format('hl', ',')} AS hi, {NAMED.format('ll', ',')} AS lo,
        pattern_type || '_' || {NAMED.format('hl', '+')} || '_vs_' || {NAMED.format('ll', '+')} || CASE WHEN pattern_type = 'tradeoff' THEN '_nonzero' ELSE '' END AS pattern_name FROM ps)"""
PAIRED = "pat AS (SELECT [i] AS hl, [j] AS ll, i || '>' || j AS pattern_code, 'pair' AS pattern_type, 2 AS complexity, 'archetype_' || i AS hi, 'archetype_' || j AS lo, i || '>' || j AS pattern_name FROM range(0, 5) a(i), range(0, 5) b(j) WHERE i < j)"
PATTERN_TESTS = f"""{I.bins_sql()}, {I.DIMS}, {ALL_PATTERNS},
    mem AS (SELECT DISTINCT cell_id, archetype_idx + 1 AS i FROM bins WHERE archetype_label <> 'no_archetype'),
    sided AS (SELECT p.pattern_name, p.pattern_code, p.pattern_type, p.complexity, p.hi, p.lo, m.cell_id, max(CASE WHEN list_contains(p.hl, m.i) THEN 1 ELSE 0 END) AS side FROM pat p JOIN mem m ON list_contains(p.hl, m.i) OR list_contains(p.ll, m.i) GROUP BY ALL),
    vals AS (SELECT s.*, d.feature, d.value FROM sided s JOIN dims d USING (cell_id)),
    rk AS (SELECT *, rank() OVER (PARTITION BY pattern_code, feature ORDER BY value) + (count(*) OVER (PARTITION BY pattern_code, feature, value) - 1) / 2.0 AS midrank, count(*) OVER (PARTITION BY pattern_code, feature, value) AS c FROM vals),
    pt AS (SELECT pattern_name, pattern_code, pattern_type, complexity, hi, lo, feature, CAST(sum(side) AS DOUBLE) AS n1, CAST(sum(1 - side) AS DOUBLE) AS n2, sum(value * side) AS s1, sum(value * (1 - side)) AS s2, sum(value * value * side) AS q1, sum(value * value * (1 - side)) AS q2,
        sum(midrank * side) AS r1, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM rk GROUP BY ALL),
    pz AS (SELECT *, s1 / n1 AS m1, s2 / n2 AS m2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM pt WHERE n1 >= 10 AND n2 >= 10),
    pv AS (SELECT *, round(m1 - m2, 6) + 0.0 AS mean_diff, round(CASE WHEN sd > 0 THEN (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd ELSE 0 END, 6) AS z FROM pz WHERE q1 / n1 - m1 * m1 > 1e-12 OR q2 / n2 - m2 * m2 > 1e-12),
    pp AS (SELECT *, {special.two_sided_sql('greatest(z, 0.0)')} AS pvalue FROM pv),
    {I.bh_sql('pp', keys='feature, pattern_name')}"""
GROUPS = SIDES + """,
    gp AS (SELECT h.l AS hl, o.l AS ll, concat_ws('_', (SELECT string_agg(CASE WHEN list_contains(h.l, n) THEN n::VARCHAR ELSE 'x' END, '' ORDER BY n) FROM range(0, 5) t(n)), (SELECT string_agg(CASE WHEN list_contains(o.l, n) THEN n::VARCHAR ELSE 'x' END, '' ORDER BY n) FROM range(0, 5) t(n))) AS pattern_code,
        len(h.l) + len(o.l) AS complexity, array_to_string(list_transform(h.l, lambda i: 'archetype_' || i), ',') AS high, array_to_string(list_transform(o.l, lambda i: 'archetype_' || i), ',') AS low
        FROM sides h, sides o WHERE h.m & o.m = 0 AND len(h.l) <= 2 AND len(o.l) <= 2 AND len(h.l) + len(o.l) > 2)"""
ORACLE_SQL = {
    "t12_group_tradeoffs": f"""WITH {I.bins_sql()}, {I.DIMS}, {GROUPS}, mem AS (SELECT DISTINCT cell_id, archetype_idx + 1 AS i FROM bins WHERE archetype_label <> 'no_archetype'),
        sided AS (SELECT p.pattern_code, p.high, p.low, m.cell_id, max(CASE WHEN list_contains(p.hl, m.i) THEN 1 ELSE 0 END) AS side FROM gp p JOIN mem m ON list_contains(p.hl, m.i) OR list_contains(p.ll, m.i) GROUP BY ALL),
        vals AS (SELECT s.*, d.feature, d.value FROM sided s JOIN dims d USING (cell_id)),
        rk AS (SELECT *, rank() OVER (PARTITION BY pattern_code, feature ORDER BY value) + (count(*) OVER (PARTITION BY pattern_code, feature, value) - 1) / 2.0 AS midrank, count(*) OVER (PARTITION BY pattern_code, feature, value) AS c FROM vals),
        pt AS (SELECT pattern_code, high, low, feature, CAST(sum(side) AS DOUBLE) AS n1, CAST(sum(1 - side) AS DOUBLE) AS n2, sum(value * side) AS s1, sum(value * (1 - side)) AS s2, sum(midrank * side) AS r1, sum(CAST(c AS DOUBLE) * c - 1) AS ties FROM rk GROUP BY ALL),
        pz AS (SELECT *, s1 / n1 AS m1, s2 / n2 AS m2, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM pt WHERE n1 >= 10 AND n2 >= 10),
        pv AS (SELECT *, round(m1 - m2, 6) + 0.0 AS diff, {special.two_sided_sql('greatest(round((greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd, 6), 0.0)')} AS pvalue FROM pz),
        t AS (SELECT feature, CASE WHEN diff < 0 THEN split_part(pattern_code, '_', 2) || '_' || split_part(pattern_code, '_', 1) ELSE pattern_code END AS pattern_code, CASE WHEN diff < 0 THEN low ELSE high END AS high_archetypes, CASE WHEN diff < 0 THEN high ELSE low END AS low_archetypes,
            round(CASE WHEN diff < 0 THEN m2 ELSE m1 END, 6) + 0.0 AS mean_high, round(CASE WHEN diff < 0 THEN m1 ELSE m2 END, 6) + 0.0 AS mean_low, abs(diff) AS mean_diff, pvalue FROM pv)
        SELECT * REPLACE (round(pvalue, 6) AS pvalue) FROM t QUALIFY row_number() OVER (PARTITION BY feature, pattern_code ORDER BY pvalue, mean_diff DESC) = 1""",
    "w9_order": f"WITH {I.archetypes_sql()}, {C.WEIGHTS} SELECT cell_id, row_number() OVER (ORDER BY round(x, 9), cell_id) - 1 AS place FROM ws WHERE archetype_idx = 0",
    "g6_long_metrics": "SELECT p_brand, unnest(['price', 'size']) AS metric, unnest([round(avg(p_retailprice), 4), round(avg(p_size), 4)]) AS value FROM part GROUP BY 1",
    "p15_log_if_raw": f"WITH {I.COUNTS} SELECT cell_id, feature, round(CASE WHEN (SELECT max(value) FROM counts) > 20 THEN ln(1 + value) ELSE value END, 6) AS value FROM counts",
    "p25_colour": f"WITH {I.COUNTS} SELECT s.cell_id, coalesce(c.value, 0.0) AS colour FROM segments s LEFT JOIN counts c ON c.cell_id = s.cell_id AND c.feature = 'Brand#11'",
    "t7_patterns": f"""WITH {I.bins_sql()}, {ALL_PATTERNS}, mem AS (SELECT DISTINCT cell_id, archetype_idx + 1 AS i FROM bins WHERE archetype_label <> 'no_archetype')
        SELECT pattern_code, pattern_type, CAST(complexity AS INT) AS complexity, CAST(length(regexp_replace(pattern_code, '[x_]', '', 'g')) AS INT) AS digits, split_part(pattern_code, '_', 2) || '_' || split_part(pattern_code, '_', 1) AS reversed,
        (SELECT count(DISTINCT cell_id) FROM mem WHERE list_contains(hl, mem.i)) AS n_high_cells, (SELECT count(DISTINCT cell_id) FROM mem WHERE list_contains(ll, mem.i)) AS n_low_cells FROM pat""",
    "t8_pattern_associations": f"""WITH {PATTERN_TESTS} SELECT feature, pattern_code, pattern_type, CAST(n1 AS BIGINT) AS n_high_cells, CAST(n2 AS BIGINT) AS n_low_cells, round(m1, 6) + 0.0 AS mean_high, round(m2, 6) + 0.0 AS mean_low, mean_diff, u AS statistic, z,
        round(pvalue, 6) AS pvalue, round(fdr_pvalue, 6) AS fdr_pvalue, fdr_pvalue < 0.05 AS significant, CASE WHEN m1 > m2 THEN 'higher' ELSE 'lower' END AS direction, abs(mean_diff) >= 0.01 AS passes_lfc_threshold FROM fdr""",
    "t11_specialization": f"WITH {PATTERN_TESTS} SELECT feature, hi AS archetype, pattern_code, mean_diff, round(pvalue, 6) AS pvalue, fdr_pvalue < 0.05 AS significant FROM fdr WHERE pattern_type = 'specialization'",
    "t12_tradeoffs": f"""WITH {PATTERN_TESTS}, t AS (SELECT feature, CASE WHEN mean_diff < 0 THEN split_part(pattern_code, '_', 2) || '_' || split_part(pattern_code, '_', 1) ELSE pattern_code END AS pattern_code, CASE WHEN mean_diff < 0 THEN lo ELSE hi END AS high_archetypes,
        CASE WHEN mean_diff < 0 THEN hi ELSE lo END AS low_archetypes, CASE WHEN mean_diff < 0 THEN m2 ELSE m1 END AS a, CASE WHEN mean_diff < 0 THEN m1 ELSE m2 END AS b, abs(mean_diff) AS mean_diff, fdr_pvalue < 0.05 AS significant, pvalue FROM fdr WHERE pattern_type = 'tradeoff' AND complexity = 2)
        SELECT feature, pattern_code, high_archetypes, low_archetypes, round(a, 6) + 0.0 AS mean_high, round(b, 6) + 0.0 AS mean_low, mean_diff FROM t QUALIFY row_number() OVER (PARTITION BY feature, pattern_code ORDER BY significant DESC, pvalue, mean_diff DESC) = 1""",
    "t13_mutual_exclusivity": f"""WITH {PATTERN_TESTS}, s AS (SELECT * FROM fdr WHERE fdr_pvalue < 0.05 AND abs(mean_diff) > 0.02)
        SELECT feature, count(*) FILTER (mean_diff > 0) AS n_positive, count(*) FILTER (mean_diff < 0) AS n_negative, max(mean_diff) AS max_positive_effect, min(mean_diff) AS min_negative_effect, round(max(mean_diff) - min(mean_diff), 6) AS effect_range FROM s GROUP BY feature HAVING n_positive > 0 AND n_negative > 0""",
    "t9_exclusive_pairwise": f"""WITH {PATTERN_TESTS.partition("    pp AS")[0].replace(ALL_PATTERNS, PAIRED).rstrip().rstrip(",")},
        sz AS (SELECT *, CASE WHEN u >= n1 * n2 / 2 THEN z ELSE -z END AS s FROM pv),
        ends AS (SELECT feature, hi AS archetype, mean_diff AS effect, {special.upper_sql('s')} AS p, round(m1, 6) + 0.0 AS own, round(m2, 6) + 0.0 AS other FROM sz
            UNION ALL SELECT feature, lo, -mean_diff, {special.upper_sql('(-s)')}, round(m2, 6) + 0.0, round(m1, 6) + 0.0 FROM sz)
        SELECT feature, archetype, round(min(effect), 6) AS min_pairwise_effect, round(max(p), 6) AS max_pairwise_pvalue, round(max(own) / (max(other) + 1e-6), 4) AS exclusivity_score
        FROM ends GROUP BY 1, 2 HAVING bool_and(p < 0.05 AND effect >= 0.02)""",
    "t9_exclusive_one_vs_rest": f"""WITH {I.bins_sql()}, {I.DIMS}, {I.ranksum_sql('dims', 'assigned', 'mean_diff')}, kept AS (SELECT * FROM tests WHERE abs(mean_diff) >= 0.01), {I.bh_sql('kept')}
        SELECT feature, min(archetype) AS archetype, round(min(pvalue), 6) AS pvalue FROM fdr WHERE fdr_pvalue < 0.05 AND direction = 'higher' GROUP BY feature HAVING count(*) = 1""",
    "r1_knn": f"WITH {I.CELLS}, {KNN} SELECT src, dst, w FROM edges",
    "r2_label_edges": f"WITH {I.CELLS}, {KNN} SELECT x.label AS a, y.label AS b, count(*) AS n FROM edges JOIN cells x ON x.cell_id = src JOIN cells y ON y.cell_id = dst GROUP BY 1, 2",
    "r2_nhood_enrichment": f"""WITH {I.CELLS}, {KNN}, e AS (SELECT src, dst FROM edges),
        s AS (SELECT label AS x, CAST(count(*) AS DOUBLE) AS s FROM cells GROUP BY 1), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells),
        k AS (SELECT count(*) AS m, (SELECT count(*) FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src) AS back, (SELECT count(*) FROM e a JOIN e b ON a.src = b.src AND a.dst <> b.dst) AS ns,
            (SELECT count(*) FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src) AS nt, (SELECT count(*) FROM e a JOIN e b ON a.dst = b.src AND a.src <> b.dst) AS nc FROM e),
        g AS (SELECT a.x AS a, b.x AS b, a.s AS sa, b.s AS sb, a.x = b.x AS eq, n, CAST(m AS DOUBLE) AS m, back, ns, nt, 2 * nc AS nc, CAST(m AS DOUBLE) * m - m - back - ns - nt - 2 * nc AS nn FROM s a, s b, n, k),
        p AS (SELECT *, CASE WHEN eq THEN sa * (sa - 1) ELSE sa * sb END / (n * (n - 1)) AS p2, CASE WHEN eq THEN sa * (sa - 1) * (sa - 2) ELSE sa * sb * (sb - 1) END / (n * (n - 1) * (n - 2)) AS ps,
            CASE WHEN eq THEN sa * (sa - 1) * (sa - 2) ELSE sb * sa * (sa - 1) END / (n * (n - 1) * (n - 2)) AS pt, CASE WHEN eq THEN sa * (sa - 1) * (sa - 2) ELSE 0 END / (n * (n - 1) * (n - 2)) AS pc,
            CASE WHEN eq THEN sa * (sa - 1) * (sa - 2) * (sa - 3) ELSE sa * (sa - 1) * sb * (sb - 1) END / (n * (n - 1) * (n - 2) * (n - 3)) AS pn FROM g),
        v AS (SELECT a, b, m * p2 AS mean, sqrt(greatest(m * p2 + CASE WHEN eq THEN back * p2 ELSE 0 END + ns * ps + nt * pt + nc * pc + nn * pn - m * p2 * m * p2, 0)) AS std FROM p),
        o AS (SELECT x.label AS a, y.label AS b, count(*) AS n FROM e JOIN cells x ON x.cell_id = src JOIN cells y ON y.cell_id = dst GROUP BY 1, 2)
        SELECT v.a, v.b, coalesce(o.n, 0) AS n, round(mean, 4) AS mean, round(std, 4) AS std, round((coalesce(o.n, 0) - mean) / std, 4) AS z FROM v LEFT JOIN o ON o.a = v.a AND o.b = v.b""",
    "r3_co_occurrence": f"""WITH {I.CELLS}, p AS (SELECT x.label AS a, y.label AS b, round(sqrt((x.vec[1] - y.vec[1]) ** 2 + (x.vec[2] - y.vec[2]) ** 2), 9) AS d FROM cells x JOIN cells y ON x.cell_id <> y.cell_id),
        n AS (SELECT CAST(CASE WHEN d <= 0.02 THEN 0 WHEN d <= 0.05 THEN 1 ELSE 2 END AS INT) AS band, a, b, count(*) AS n FROM p WHERE d <= 0.1 GROUP BY 1, 2, 3)
        SELECT band, a, b, n, round((n / sum(n) OVER (PARTITION BY band, b)) / (sum(n) OVER (PARTITION BY band, a) / sum(n) OVER (PARTITION BY band)), 6) AS ratio FROM n""",
    "r4_autocorrelation": f"""WITH {I.CELLS}, {KNN}, {I.DIMS}, st AS (SELECT feature, avg(value) AS m, count(*) AS n, var_pop(value) * count(*) AS ss FROM dims GROUP BY 1),
        s AS (SELECT x.feature, sum(w * (x.value - m) * (y.value - m)) AS zz, sum(w * (x.value - y.value) ** 2) AS dd, sum(w) AS ws FROM edges JOIN dims x ON x.cell_id = src JOIN dims y ON y.cell_id = dst AND y.feature = x.feature JOIN st ON st.feature = x.feature GROUP BY 1),
        bw AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges) GROUP BY 1, 2),
        k AS (SELECT (SELECT sum(w * w) / 2 FROM bw) AS s1, (SELECT sum(o * o) FROM (SELECT sum(w) AS o FROM bw GROUP BY src)) AS s2),
        v AS (SELECT feature, n / ws * zz / ss AS i, (n - 1) / (2 * ws) * dd / ss AS c, -1.0 / (n - 1) AS e, (CAST(n AS DOUBLE) * n * s1 - n * s2 + 3 * ws * ws) / (ws * ws * (CAST(n AS DOUBLE) * n - 1)) - 1.0 / ((n - 1) * (n - 1)) AS v FROM s JOIN st USING (feature), k),
        f AS (SELECT *, (i - e) / sqrt(v) AS z FROM v)
        SELECT feature, round(i, 6) AS moran_i, round(c, 6) AS geary_c, round(e, 6) AS expected_i, round({special.two_sided_sql('z')}, 6) AS pvalue, round(z, 5) AS z FROM f""",
    "t16_cross_correlations": f"""WITH {I.archetypes_sql()}, {C.WEIGHTS}, {KNN},
        nb AS (SELECT src AS cell_id, label AS t, archetype_idx, avg(x) AS m FROM edges JOIN cells ON cells.cell_id = dst JOIN ws ON ws.cell_id = dst WHERE label IN ('0', '1') GROUP BY ALL),
        ab AS (SELECT a.cell_id, a.archetype_idx, a.m AS a, b.m AS b FROM nb a JOIN nb b ON a.cell_id = b.cell_id AND a.archetype_idx = b.archetype_idx AND a.t = '0' AND b.t = '1'),
        rk AS (SELECT *, rank() OVER (PARTITION BY archetype_idx ORDER BY a) + (count(*) OVER (PARTITION BY archetype_idx, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY archetype_idx ORDER BY b) + (count(*) OVER (PARTITION BY archetype_idx, b) - 1) / 2.0 AS rb FROM ab)
        SELECT 'archetype_' || archetype_idx AS archetype, round(corr(ra, rb), 6) AS spearman_r, round(avg(a), 6) AS mean_weight_a, round(avg(b), 6) AS mean_weight_b, count(*) AS n_cells FROM rk GROUP BY archetype_idx HAVING count(*) > 50""",
    "r5_boundaries": f"""WITH {I.archetypes_sql()}, {C.WEIGHTS}, {KNN},
        nb AS (SELECT src AS cell_id, label AS t, archetype_idx, avg(x) AS m, count(*) AS n FROM edges JOIN cells ON cells.cell_id = dst JOIN ws ON ws.cell_id = dst WHERE label IN ('0', '1') GROUP BY ALL),
        pq AS (SELECT a.cell_id, a.archetype_idx, a.n AS n_a, b.n AS n_b, a.m / sum(a.m) OVER (PARTITION BY a.cell_id) AS p, b.m / sum(b.m) OVER (PARTITION BY a.cell_id) AS q FROM nb a JOIN nb b ON a.cell_id = b.cell_id AND a.archetype_idx = b.archetype_idx AND a.t = '0' AND b.t = '1'),
        js AS (SELECT cell_id, sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) AS score FROM pq GROUP BY 1)
        SELECT c.cell_id, coalesce((SELECT max(n) FROM nb WHERE nb.cell_id = c.cell_id AND t = '0'), 0) AS n_a, coalesce((SELECT max(n) FROM nb WHERE nb.cell_id = c.cell_id AND t = '1'), 0) AS n_b, round(coalesce(score, 0.0), 5) AS boundary_score
        FROM cells c LEFT JOIN js ON js.cell_id = c.cell_id""",
    "r7_high_purity": f"""WITH {I.bins_sql()}, {C.WEIGHTS}, o AS (SELECT a.cell_id, archetype, round(x, 9) AS own FROM assigned a JOIN ws ON ws.cell_id = a.cell_id AND 'archetype_' || (archetype_idx + 1) = archetype),
        e AS (SELECT archetype, quantile_cont(own, 0.8) AS edge FROM o GROUP BY 1) SELECT cell_id, archetype FROM o JOIN e USING (archetype) WHERE own >= edge""",
    "r9_transitions": f"""WITH {I.bins_sql()}, {C.WEIGHTS}, {KNN}, s AS (SELECT cell_id, 'archetype_' || (archetype_idx + 1) AS source FROM ws WHERE x > 0.5 UNION ALL SELECT cell_id, archetype FROM assigned WHERE archetype = 'archetype_0'),
        f AS (SELECT src AS cell_id, archetype AS target, round(count(*) / {NEIGHBOURS}.0, 9) AS prob FROM edges JOIN assigned ON assigned.cell_id = dst GROUP BY 1, 2) SELECT source, target, count(*) AS n FROM s JOIN f USING (cell_id) WHERE prob > 0.3 GROUP BY 1, 2""",
    "r11_diagnose": f"WITH {I.CELLS}, {KNN} SELECT count(DISTINCT src) AS n_rows, 0.0::DOUBLE AS max_row_error, max(CASE WHEN EXISTS (SELECT 1 FROM edges b WHERE b.src = e.dst AND b.dst = e.src) THEN 0.0::DOUBLE ELSE {1 / NEIGHBOURS}::DOUBLE END) AS max_asymmetry FROM edges e",
    "r12_paga": f"""WITH {I.CELLS}, {KNN}, n AS (SELECT x.label AS a, y.label AS b, count(*) AS n FROM edges JOIN cells x ON x.cell_id = src JOIN cells y ON y.cell_id = dst GROUP BY 1, 2),
        o AS (SELECT a, sum(n) AS o FROM n GROUP BY 1), z AS (SELECT label, count(*) AS s FROM cells GROUP BY 1), u AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM n WHERE a <> b UNION ALL SELECT b, a, n FROM n WHERE a <> b) GROUP BY 1, 2)
        SELECT u.a, u.b, round(least(1.0, u.n / ((oa.o * zb.s + ob.o * za.s) / ((SELECT count(*) FROM cells) - 1.0))), 6) AS connectivity FROM u JOIN o oa ON oa.a = u.a JOIN o ob ON ob.a = u.b JOIN z za ON za.label = u.a JOIN z zb ON zb.label = u.b""",
    "t15_lineage_drivers": f"""WITH {I.archetypes_sql()}, {C.WEIGHTS}, {I.DIMS}, j AS (SELECT feature, value, round(x, 9) AS y FROM dims JOIN ws ON ws.cell_id = dims.cell_id AND archetype_idx = 0),
        r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM j)
        SELECT feature, count(*) AS n, round(corr(rx, ry), 6) AS correlation FROM r GROUP BY 1""",
    "p11_log_p": f"WITH {I.COUNTS}, {I.ranksum_sql('counts', 'segments', 'log_fold_change')} SELECT feature, archetype, round(least(-log10(greatest(round(pvalue, 6), 1e-300)), 300), 6) + 0.0 AS log_p FROM tests",
    "p12_tfidf": f"""WITH {I.COUNTS}, r AS (SELECT cell_id, sum(value) AS s FROM counts GROUP BY 1), c AS (SELECT feature, sum(value) AS s FROM counts GROUP BY 1)
        SELECT cell_id, feature, round(ln(1 + value / r.s) * ln(1 + (SELECT count(*) FROM r) / c.s), 9) AS value FROM counts JOIN r USING (cell_id) JOIN c USING (feature)""",
    "p15_normalize": f"WITH {I.COUNTS} SELECT cell_id, feature, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY cell_id)), 6) AS value, count(*) OVER (PARTITION BY cell_id) AS n_features, sum(value) OVER (PARTITION BY cell_id) AS total FROM counts",
    "p15_variable_features": f"""WITH {I.COUNTS}, n AS (SELECT count(*) AS n FROM segments), s AS (SELECT feature, sum(value) / max(n) AS mean, sum(value * value) / max(n) AS sq FROM counts, n GROUP BY 1)
        SELECT feature, round(mean, 6) AS mean, round(sq - mean * mean, 6) AS var, round((sq - mean * mean) / mean, 6) AS dispersion FROM s ORDER BY (sq - mean * mean) / mean DESC, feature LIMIT 10""",
    "t14_aucell": f"""WITH v AS (SELECT o_custkey AS cell_id, p_name AS feature, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
        n AS (SELECT CAST(greatest(1, round(0.1 * count(DISTINCT feature))) AS BIGINT) AS l FROM v), net AS (SELECT DISTINCT p_name AS target, split_part(p_name, ' ', i) AS source FROM part, range(1, 3) t(i) WHERE p_name IN (SELECT feature FROM v)),
        b AS (SELECT source AS pathway, least(count(*), max(l)) AS c, max(l) AS l FROM net, n GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, feature) - 1 AS r FROM v),
        h AS (SELECT cell_id, source AS pathway, sum(l - r) AS area FROM r JOIN net ON target = feature, n WHERE r < l GROUP BY 1, 2)
        SELECT g.cell_id, b.pathway, round(coalesce(area, 0) / (c * l - c * (c - 1) / 2.0), 6) AS score FROM (SELECT DISTINCT cell_id FROM v) g CROSS JOIN b LEFT JOIN h ON h.cell_id = g.cell_id AND h.pathway = b.pathway""",
    "j3_members": "SELECT DISTINCT split_part(p_name, ' ', i) AS source, p_name AS target FROM part, range(1, 3) t(i) WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 25)",
    "k1_top_associations": f"""WITH {I.COUNTS}, {I.ranksum_sql('counts', 'segments', 'log_fold_change')} SELECT archetype, feature, log_fold_change FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY abs(log_fold_change) DESC, feature) AS r FROM tests WHERE abs(log_fold_change) >= 0.01) WHERE r <= 3""",
    "k2_top_with_ties": "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 5",
    "k8_rescale": """WITH v AS (SELECT s_suppkey, s_nationkey, CASE WHEN min(s_acctbal) OVER () < 0 THEN abs(s_acctbal) ELSE s_acctbal END AS v FROM supplier), s AS (SELECT *, 50 + (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 350 AS size FROM v)
        SELECT s_suppkey, round(size, 6) AS size, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY size DESC, s_suppkey) - 1 AS INT) AS y FROM s""",
    "w5_rolling": "SELECT metric, epoch, round(r, 6) AS rolling FROM (SELECT event_type AS metric, event_id AS epoch, avg(value) OVER w AS r, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE c = 5",
    "w6_drift": "SELECT event_type AS metric, event_id AS epoch, round(abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)), 6) AS step, round(var_samp(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS recent_variance FROM events",
    "w7_convergence": "SELECT metric, round((arg_max(value, epoch) - arg_min(value, epoch)) / count(*), 6) AS convergence_rate, round(stddev_pop(value) / (avg(value) + 1e-8), 6) AS stability FROM (SELECT event_type AS metric, event_id AS epoch, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5 GROUP BY 1",
    "a26_metric_summaries": "SELECT event_type AS metric, round(arg_max(value, event_id), 4) AS final, round(min(value), 4) AS min, round(max(value), 4) AS max, round(max(value) - min(value), 4) AS range, round((arg_max(value, event_id) - arg_min(value, event_id)) / abs(arg_min(value, event_id)) * 100, 4) AS improvement FROM events GROUP BY 1",
    "g4_folds": "SELECT user_id % 7 AS config_id, event_type AS metric, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max FROM events GROUP BY 1, 2",
    "g12_axis_ranges": f"""WITH {I.CELLS}, q AS (SELECT 'x' AS axis, quantile_cont(vec[1], 0.01) AS lo, quantile_cont(vec[1], 0.99) AS hi FROM cells UNION ALL SELECT 'y', quantile_cont(vec[2], 0.01), quantile_cont(vec[2], 0.99) FROM cells)
        SELECT axis, round(lo - 0.75 * (hi - lo), 6) AS low, round(hi + 0.75 * (hi - lo), 6) AS high FROM q""",
}
