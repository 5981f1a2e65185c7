"""Queries of the archetype core and of the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.functions import special
from simplark.functions import vectors as V
from simplark.operators import archetypes as A
from simplark.operators import stats as S
from simplark.plans import inputs as I

SIX = 6


def p_rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, SIX) for c in ("pvalue", "fdr_pvalue") if c in df.columns})


def p1_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.cells(spark, sf_dir)
    return c.select("cell_id", *[F.round(V.truncate(F.col("vec"), 3)[i], SIX).alias(f"x{i}") for i in range(3)])


def p20_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.cells(spark, sf_dir).select("cell_id", V.truncate(F.col("vec"), 5).alias("v"))
    s, b = V.softmax(F.col("v")), V.barycentric(F.col("v"))
    return c.select("cell_id", F.round(F.array_max(s), SIX).alias("softmax_max"), F.round(V.total(s), SIX).alias("softmax_sum"), F.round(F.array_max(b), SIX).alias("bary_max"), V.argmax(F.col("v")).cast("int").alias("top"))


def a2_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.distance_table(I.cells(spark, sf_dir), I.archetypes(spark, sf_dir))
    return t.withColumns({c: F.round(c, SIX) for c in t.columns if c.endswith("_distance")})


def a3_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = A.bins(I.cells(spark, sf_dir), I.archetypes(spark, sf_dir), I.SHARE)
    return b.withColumn("distance", F.round("distance", SIX))


def a3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.assigned(spark, sf_dir)


def a5_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.centroids(I.cells(spark, sf_dir), "label")
    return c.select("level", "n_cells", *[F.col("centroid")[i].alias(f"x{i}") for i in (0, 1, 63)])


def a5_group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir).join(I.assigned(spark, sf_dir), "cell_id")
    c = A.centroids(cells, "label", groupby="archetype", label="archetype")
    return c.select("group", "level", "n_cells", F.col("centroid")[0].alias("x0"))


def a6_assign_to_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir)
    rows = A.centroids(cells, "label").orderBy("level").collect()
    return A.assign_to_centroids(cells, [(r.level, r.centroid) for r in rows])


def a10_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.positions(I.archetype_table(spark, I.archetypes(spark, sf_dir)))


def a12_pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pair_distances(I.archetype_table(spark, I.archetypes(spark, sf_dir))).withColumn("distance", F.round("distance", SIX))


def a15_furthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.archetype_table(spark, I.archetypes(spark, sf_dir)).select("archetype_idx", *[F.round(F.col("y")[i], SIX).alias(f"y{i}") for i in range(3)])


def a16_inflate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.archetype_table(spark, A.inflate(I.archetypes(spark, sf_dir), 1.5)).select("archetype_idx", *[F.round(F.col("y")[i], SIX).alias(f"y{i}") for i in range(3)])


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, w): closeness to the archetypes, scaled to one."""
    d = A.distances_to(F.col("vec"), I.archetypes(spark, sf_dir))
    return I.cells(spark, sf_dir).select("cell_id", V.softmax(F.transform(d, lambda x: -4 * x)).alias("w"))


WEIGHTS = "ex AS (SELECT cell_id, archetype_idx, exp(-4 * distance) AS e FROM dist), ws AS (SELECT cell_id, archetype_idx, e / sum(e) OVER (PARTITION BY cell_id) AS x FROM ex)"


def a8_weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weight_table(weights(spark, sf_dir))


def a27_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.constraint_report(weights(spark, sf_dir))


def a28_weight_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weight_statistics(weights(spark, sf_dir))


def a24_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the cells the weighted archetypes explain."""
    y = I.archetypes(spark, sf_dir)
    columns = [[row[j] for row in y] for j in range(len(y[0]))]
    w = weights(spark, sf_dir).join(I.cells(spark, sf_dir).select("cell_id", "vec"), "cell_id")
    return A.r_squared(w.withColumn("fitted", V.affine(F.col("w"), columns, [0.0] * len(columns))))


def p2_select_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir).select("cell_id", *[F.round(F.col("w")[i], SIX).alias(f"archetype_{i}") for i in range(I.K)])
    return A.select_cells(w, {"archetype_0": ">=20%", "1": "<40%"})


def t2_gene_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p_rounded(S.gene_associations(I.counts(spark, sf_dir), I.segments(spark, sf_dir)))


def t2_per_archetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p_rounded(S.gene_associations(I.dims(spark, sf_dir), I.assigned(spark, sf_dir), scope="per_archetype", comparison="archetypes_only", min_logfc=0.0))


def t3_pathway_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p_rounded(S.pathway_associations(I.dims(spark, sf_dir), I.assigned(spark, sf_dir)))


def t3_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components as they are: nearly as many distinct values as cells."""
    long = I.cells(spark, sf_dir).select("cell_id", F.posexplode("vec").alias("pos", "value"))
    values = long.select("cell_id", F.concat(F.lit("d"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature"), "value")
    return p_rounded(S.pathway_associations(values, I.assigned(spark, sf_dir)))


def t3_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each side of each test of the brands' counts, most of which are zero."""
    t = p_rounded(S.pathway_associations(I.counts(spark, sf_dir), I.segments(spark, sf_dir), direction="both"))
    return t.select("feature", "archetype", "test_direction", "direction", "mean_diff", "statistic", "pvalue", "fdr_pvalue", "significant")


def t4_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir).join(I.assigned(spark, sf_dir), "cell_id")
    t = p_rounded(S.enrichment(cells, "label"))
    return t.drop("odds_ratio", "ci_lower", "ci_upper").withColumnRenamed("sample_odds_ratio", "odds_ratio")


def t6_bonferroni(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = S.rank_sums(I.counts(spark, sf_dir), I.segments(spark, sf_dir))
    return p_rounded(S.fdr(tests, method="bonferroni")).select("feature", "archetype", "pvalue", "fdr_pvalue", "significant")


def g1_group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.counts(spark, sf_dir).join(I.segments(spark, sf_dir), "cell_id")
    return rows.groupBy("feature", "archetype").agg(F.round(F.avg("value"), SIX).alias("mean"), F.round(F.var_pop("value"), 4).alias("var"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("nonzero"))


def g9_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    rows = I.counts(spark, sf_dir).join(I.segments(spark, sf_dir), "cell_id")
    return rows.groupBy("feature").pivot("archetype", names).agg(F.round(F.avg("value"), SIX)).fillna(0.0)


QUERIES = {f.__name__: f for f in (
    p1_truncate, p20_softmax, a2_distances, a3_bins, a3_labels, a5_centroids, a5_group_centroids, a6_assign_to_centroids, a8_weight_table, a10_positions, a12_pair_distances, a15_furthest, a16_inflate,
    a24_r2, a27_constraints, a28_weight_statistics, p2_select_cells, t2_gene_associations, t2_per_archetype, t3_pathway_associations, t3_continuous, t3_both_sides, t4_enrichment, t6_bonferroni, g1_group_moments, g9_pivot,
)}

A_SQL, B_SQL = I.archetypes_sql(), I.bins_sql()
LEVELS = 10  # labels of the embeddings


def levels_sql() -> str:
    """CTEs s0 ... (cell_id, vec, assigned): level by level, with the rank of the free cells' distances."""
    parts = ["ctr AS (SELECT level, list(m ORDER BY i) AS c, row_number() OVER (ORDER BY level) - 1 AS k FROM (SELECT label AS level, i, round(avg(vec[i]), 6) AS m FROM cells, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)", "s0 AS (SELECT cell_id, vec, CAST(NULL AS VARCHAR) AS assigned FROM cells)"]
    for k in range(LEVELS):
        parts.append(f"""s{k + 1} AS (SELECT cell_id, vec, CASE WHEN assigned IS NULL AND r <= (SELECT greatest(1, CAST(floor(count(*) * 0.15) AS BIGINT)) FROM cells) THEN level ELSE assigned END AS assigned
            FROM (SELECT *, rank() OVER (PARTITION BY assigned IS NULL ORDER BY d) AS r FROM (SELECT s.*, level, round(list_distance(vec, c), 9) AS d FROM s{k} s, ctr WHERE k = {k})))""")
    return ", ".join(parts)


D6 = ", ".join(f"round(max(CASE WHEN archetype_idx = {i} THEN distance END), 6) AS archetype_{i}_distance" for i in range(I.K))
TEST_COLUMNS = "feature, archetype, n_archetype_cells, n_other_cells, mean_archetype, mean_other, {effect}, statistic, z, round(pvalue, 6) AS pvalue, direction, round(fdr_pvalue, 6) AS fdr_pvalue, fdr_pvalue < 0.05 AS significant"
LF = "lgamma({} + 1)"
ORACLE_SQL = {
    "p1_truncate": f"WITH {I.CELLS} SELECT cell_id, round(vec[1], 6) AS x0, round(vec[2], 6) AS x1, round(vec[3], 6) AS x2 FROM cells",
    "p20_softmax": f"""WITH {I.CELLS}, v AS (SELECT cell_id, i - 1 AS i, vec[i] AS x FROM cells, range(1, 6) t(i)), m AS (SELECT cell_id, max(x) AS top, sum(exp(x)) AS s, sum(greatest(x, 0)) AS b FROM v GROUP BY 1)
        SELECT cell_id, round(exp(top) / s, 6) AS softmax_max, 1.0::DOUBLE AS softmax_sum, round(greatest(top, 0) / (b + 1e-8), 6) AS bary_max,
        CAST((SELECT min(i) FROM v WHERE v.cell_id = m.cell_id AND v.x = top) AS INT) AS top FROM m""",
    "a2_distances": f"""WITH {A_SQL} SELECT cell_id, {D6}, CAST(arg_min(archetype_idx, (distance, archetype_idx)) AS INT) AS nearest_archetype, round(min(distance), 6) AS nearest_distance,
        round(avg(distance), 6) AS mean_distance, round(stddev_pop(distance), 6) AS std_distance FROM dist GROUP BY cell_id""",
    "a3_bins": f"WITH {B_SQL} SELECT cell_id, archetype_label, CAST(archetype_idx AS INT) AS archetype_idx, round(distance, 6) AS distance, CAST(rank_in_archetype AS INT) AS rank_in_archetype, multiple_archetypes FROM bins",
    "a3_labels": f"WITH {B_SQL} SELECT cell_id, archetype FROM assigned",
    "a5_centroids": f"WITH {I.CELLS} SELECT label AS level, count(*) AS n_cells, round(avg(vec[1]), 6) AS x0, round(avg(vec[2]), 6) AS x1, round(avg(vec[64]), 6) AS x63 FROM cells GROUP BY label",
    "a5_group_centroids": f"""WITH {B_SQL} SELECT archetype AS "group", label AS level, count(*) AS n_cells, round(avg(vec[1]), 6) AS x0 FROM cells JOIN assigned USING (cell_id)
        WHERE archetype NOT IN ('no_archetype', 'archetype_0') GROUP BY 1, 2""",
    "a6_assign_to_centroids": f"WITH {I.CELLS}, {levels_sql()} SELECT cell_id, coalesce(assigned, 'unassigned') AS assigned FROM s{LEVELS}",
    "a10_positions": f"""WITH {A_SQL}, e AS (SELECT archetype_idx, unnest(y) AS x FROM arch) SELECT CAST(archetype_idx AS INT) AS archetype_idx, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min,
        round(max(x), 6) AS max, round(max(x) - min(x), 6) AS range FROM e GROUP BY 1""",
    "a12_pair_distances": f"WITH {A_SQL} SELECT CAST(a.archetype_idx AS INT) AS i, CAST(b.archetype_idx AS INT) AS j, round(list_distance(a.y, b.y), 6) AS distance FROM arch a JOIN arch b ON a.archetype_idx < b.archetype_idx",
    "a15_furthest": f"WITH {A_SQL} SELECT CAST(archetype_idx AS INT) AS archetype_idx, round(y[1], 6) AS y0, round(y[2], 6) AS y1, round(y[3], 6) AS y2 FROM arch",
    "a16_inflate": f"""WITH {A_SQL}, c AS (SELECT avg(y[1]) AS c0, avg(y[2]) AS c1, avg(y[3]) AS c2 FROM arch)
        SELECT CAST(archetype_idx AS INT) AS archetype_idx, round(c0 + 1.5 * (y[1] - c0), 6) AS y0, round(c1 + 1.5 * (y[2] - c1), 6) AS y1, round(c2 + 1.5 * (y[3] - c2), 6) AS y2 FROM arch, c""",
    "a8_weight_table": f"""WITH {A_SQL}, {WEIGHTS} SELECT cell_id, round(max(x), 6) AS max_weight, CAST(arg_min(archetype_idx, (-x, archetype_idx)) AS INT) AS dominant_archetype, round(-sum(x * ln(x + 1e-8)), 6) AS weight_entropy FROM ws GROUP BY cell_id""",
    "a24_r2": f"""WITH {A_SQL}, {WEIGHTS}, f AS (SELECT ws.cell_id, d.i, sum(ws.x * arch.y[d.i]) AS fit FROM ws JOIN arch USING (archetype_idx), range(1, 65) d(i) GROUP BY 1, 2),
        r AS (SELECT f.i, sum((c.vec[f.i] - f.fit) ** 2) AS res, var_pop(c.vec[f.i]) * count(*) AS tot FROM f JOIN cells c USING (cell_id) GROUP BY 1) SELECT round(1 - sum(res) / greatest(sum(tot), 1e-8), 6) AS r2 FROM r""",
    "a27_constraints": f"""WITH {A_SQL}, {WEIGHTS}, e AS (SELECT cell_id, abs(sum(x) - 1) AS e, avg(CASE WHEN x < 0 THEN 1.0 ELSE 0.0 END) AS neg FROM ws GROUP BY 1)
        SELECT count(*) AS n_rows, round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error, round(stddev_pop(e), 6) AS std_error, round(median(e), 6) AS median_error, round(avg(neg), 6) AS negative_share,
        round(avg(CASE WHEN e > 1e-3 THEN 1.0 ELSE 0.0 END), 6) AS violation_rate FROM e""",
    "a28_weight_statistics": f"""WITH {A_SQL}, {WEIGHTS}, t AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY x DESC, archetype_idx) = 1 AS top FROM ws)
        SELECT CAST(archetype_idx AS INT) AS archetype_idx, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(max(x), 6) AS max, round(min(x), 6) AS min, round(avg(CASE WHEN top THEN 1.0 ELSE 0.0 END), 6) AS dominant_share FROM t GROUP BY 1""",
    "p2_select_cells": f"""WITH {A_SQL}, {WEIGHTS}, w AS (SELECT cell_id, {", ".join(f"round(max(CASE WHEN archetype_idx = {i} THEN x END), 6) AS archetype_{i}" for i in range(I.K))} FROM ws GROUP BY 1)
        SELECT * FROM w WHERE archetype_0 >= 0.2 AND archetype_1 < 0.4""",
    "t2_gene_associations": f"WITH {I.COUNTS}, {I.ranksum_sql('counts', 'segments', 'log_fold_change')}, kept AS (SELECT * FROM tests WHERE abs(log_fold_change) >= 0.01), {I.bh_sql('kept')} SELECT {TEST_COLUMNS.format(effect='log_fold_change')} FROM fdr",
    "t2_per_archetype": f"""WITH {B_SQL}, {I.DIMS}, {I.ranksum_sql('dims', 'assigned', 'log_fold_change', where="archetype NOT IN ('archetype_0', 'no_archetype')")}, {I.bh_sql('tests', scope='archetype')} SELECT {TEST_COLUMNS.format(effect='log_fold_change')} FROM fdr""",
    "t3_pathway_associations": f"WITH {B_SQL}, {I.DIMS}, {I.ranksum_sql('dims', 'assigned', 'mean_diff')}, kept AS (SELECT * FROM tests WHERE abs(mean_diff) >= 0.01), {I.bh_sql('kept')} SELECT {TEST_COLUMNS.format(effect='mean_diff')} FROM fdr",
    "t3_continuous": f"""WITH {B_SQL}, dims AS (SELECT cell_id, 'd' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, vec[i] AS value FROM cells, range(1, 65) t(i)),
        {I.ranksum_sql('dims', 'assigned', 'mean_diff')}, kept AS (SELECT * FROM tests WHERE abs(mean_diff) >= 0.01), {I.bh_sql('kept')} SELECT {TEST_COLUMNS.format(effect='mean_diff')} FROM fdr""",
    "t3_both_sides": f"""WITH {I.COUNTS}, {I.ranksum_sql('counts', 'segments', 'mean_diff')}, signed AS (SELECT *, CASE WHEN statistic >= n_archetype_cells * n_other_cells / 2 THEN z ELSE -z END AS s FROM tests),
        sides AS (SELECT * REPLACE ('higher' AS direction, {special.upper_sql('s')} AS pvalue), 'greater' AS test_direction FROM signed UNION ALL SELECT * REPLACE ('lower' AS direction, {special.upper_sql('(-s)')} AS pvalue), 'less' FROM signed),
        {I.bh_sql('sides', keys='feature, archetype, test_direction')} SELECT feature, archetype, test_direction, direction, mean_diff, statistic, round(pvalue, 6) AS pvalue, round(fdr_pvalue, 6) AS fdr_pvalue, fdr_pvalue < 0.05 AS significant FROM fdr""",
    "t4_enrichment": f"""WITH {B_SQL}, r AS (SELECT archetype, label AS condition FROM cells JOIN assigned USING (cell_id) WHERE archetype <> 'no_archetype'),
        b AS (SELECT archetype, condition, count(*) AS observed FROM r GROUP BY 1, 2),
        t AS (SELECT *, CAST(sum(observed) OVER (PARTITION BY archetype) AS BIGINT) AS ta, CAST(sum(observed) OVER (PARTITION BY condition) AS BIGINT) AS tc, CAST(sum(observed) OVER () AS BIGINT) AS n FROM b),
        k AS (SELECT * FROM t WHERE ta >= 5 AND tc >= 5 AND observed >= 5),
        tail AS (SELECT archetype, condition, sum(exp(lgamma(ta + 1) + lgamma(n - ta + 1) + lgamma(tc + 1) + lgamma(n - tc + 1) - lgamma(n + 1) - lgamma(j + 1) - lgamma(ta - j + 1) - lgamma(tc - j + 1) - lgamma(n - ta - tc + j + 1))) AS p
            FROM (SELECT *, unnest(range(observed, least(ta, tc) + 1)) AS j FROM k) GROUP BY 1, 2),
        e AS (SELECT k.*, least(1.0, p) AS pvalue FROM k JOIN tail USING (archetype, condition)), {I.bh_sql('e', keys='archetype, condition')}
        SELECT archetype, condition, observed, round(CAST(ta AS DOUBLE) * tc / n, 6) AS expected, ta AS total_archetype, tc AS total_condition,
        CASE WHEN ta > observed AND tc > observed THEN round(CAST(observed AS DOUBLE) * (n - ta - tc + observed) / ((ta - observed) * (tc - observed)), 6) ELSE CAST('inf' AS DOUBLE) END AS odds_ratio,
        round(pvalue, 6) AS pvalue, round(fdr_pvalue, 6) AS fdr_pvalue, fdr_pvalue < 0.05 AS significant FROM fdr""",
    "t6_bonferroni": f"WITH {I.COUNTS}, {I.ranksum_sql('counts', 'segments', 'log_fold_change')} SELECT feature, archetype, round(pvalue, 6) AS pvalue, round(least(1.0, pvalue * count(*) OVER ()), 6) AS fdr_pvalue, least(1.0, pvalue * count(*) OVER ()) < 0.05 AS significant FROM tests",
    "g1_group_moments": f"WITH {I.COUNTS} SELECT feature, archetype, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS var, count(*) AS n, count(*) FILTER (value > 0) AS nonzero FROM counts JOIN segments USING (cell_id) GROUP BY 1, 2",
    "g9_pivot": f"""WITH {I.COUNTS} SELECT feature, {", ".join(f"coalesce(round(avg(CASE WHEN archetype = '{s}' THEN value END), 6), 0.0) AS {s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))} FROM counts JOIN segments USING (cell_id) GROUP BY 1""",
}
