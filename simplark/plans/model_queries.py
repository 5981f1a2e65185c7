"""Queries of model fitting, search and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.functions import special
from simplark.functions import vectors as V
from simplark.operators import archetypes as A
from simplark.operators import generate as N
from simplark.operators import graph as G
from simplark.operators import hull as L
from simplark.operators import search as X
from simplark.operators import shape as H
from simplark.operators import training as T
from simplark.operators import validate as D
from simplark.operators import variational as E
from simplark.plans import core_queries as C
from simplark.plans import inputs as I


def a1_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell's convex weights of the fitted archetypes."""
    model = L.ArchetypeEstimator(I.K, "pcha").fit(I.cells(spark, sf_dir))
    return model.transform(I.cells(spark, sf_dir)).select("cell_id", F.transform("w", lambda x: F.round(x, 4)).alias("w"))


def a13_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that the archetypes of all rows are made of, with their coefficients and what they add up to."""
    model = L.ArchetypeEstimator(I.K, "pcha", delta=0.1).fit(I.cells(spark, sf_dir))
    rows = model.fit_.composition(spark)
    return rows.join(L.composition_report(rows, delta=0.1), "archetype_idx").select("archetype_idx", "cell_id", F.round("coefficient", 6).alias("coefficient"), F.round("total", 6).alias("total"), "n_cells", "violated")


def a4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the three furthest cells as archetypes, and how far each cell is from what they give."""
    model = L.ArchetypeEstimator(3, "furthest").fit(I.cells(spark, sf_dir))
    t = model.reconstruct(model.transform(I.cells(spark, sf_dir)))
    return t.select("cell_id", *[F.round(F.col("w")[i], 3).alias(f"w{i}") for i in range(3)], F.round(V.distance(F.col("vec"), F.col("fitted")), 5).alias("error"))


def a17_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inflation_report(I.cells(spark, sf_dir), I.archetypes(spark, sf_dir))


def a17_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the moved archetypes lie, beside the cells."""
    t = L.inflation_report(I.cells(spark, sf_dir), I.archetypes(spark, sf_dir), (1.0, 1.1, 1.5))
    return t.select("factor", "outside_data_count", *[F.round(c, 6).alias(c) for c in ("mean_arch_distance", "min_arch_distance", "max_arch_distance")])


def a18_autoencoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of the autoencoder trained on all cells: epoch, metric, value."""
    model = T.AutoencoderEstimator(I.K, normalise=True).fit(I.cells(spark, sf_dir))
    return model.history_table(spark)


def a7_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, latent means and log variances of all cells by an autoencoder trained on them, and the error of their reconstruction."""
    model = T.AutoencoderEstimator(I.K, epochs=10, normalise=True).fit(I.cells(spark, sf_dir))
    t = model.reconstruct(model.transform(I.cells(spark, sf_dir)))
    return t.select("cell_id", "w", "latent", "log_var", V.distance(F.col("vec"), F.col("fitted")).alias("error"))


def a23_variational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent means of all cells by a plain variational autoencoder trained on them, and the error of their reconstruction."""
    model = E.VariationalEstimator(I.K).fit(I.cells(spark, sf_dir))
    return model.transform(I.cells(spark, sf_dir)).select("cell_id", "latent", "log_var", "error")


def c3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = X.search(I.cells(spark, sf_dir), X.SearchConfig())
    return H.fold_summary(folds, ["config_id", "n_archetypes", "hidden_dims", "inflation"])


def s3_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the table's archetypes, planted in as many generated cells as it has, are found again."""
    planted = I.archetypes(spark, sf_dir)
    cells = N.convex_cells(spark, I.cells(spark, sf_dir).count(), planted, 0.1)
    found = L.ArchetypeEstimator(I.K, "pcha").fit(cells).archetypes
    r = A.recovery(planted, found)
    return spark.createDataFrame([(float(r["mean_distance"]), float(r["normalized_error"]), float(r["accuracy"]))], "mean_distance double, normalized_error double, accuracy double")


def n1_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = I.cells(spark, sf_dir)
    out = None
    for s in ("uniform", "normal", "poisson", "dirichlet"):
        one = N.sample_coordinates(cells, 200, s, archetypes=I.archetypes(spark, sf_dir)).select(F.lit(s).alias("strategy"), "cell_id", F.slice("vec", 1, 3).alias("vec3"))
        out = one if out is None else out.unionByName(one)
    return out


def n1_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many mixtures within the middle of the cells as there are cells."""
    cells = I.cells(spark, sf_dir)
    made, tries = N.mixtures_within(spark, cells.count(), I.archetypes(spark, sf_dir), N.held_out_box(cells, {0: 0.6, 1: 0.6}))
    return made.select("cell_id", "attempt", *[F.col("vec")[i].alias(f"x{i}") for i in (0, 1)], F.lit(tries["rejected"]).alias("rejected"))


def n2_specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = I.archetypes(spark, sf_dir)[0]
    return N.specialists(spark, y, I.cells(spark, sf_dir).count()).select("cell_id", (V.distance(F.col("vec"), V.literal(y)) <= 0.1 + 1e-9).alias("inside"))


def n5_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.volumetric_holdout(I.cells(spark, sf_dir)).select("cell_id", "held_out")


def n6_gene_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three components through fixed loadings."""
    t = N.gene_space(I.cells(spark, sf_dir), [[1.0, 2.0, 0.0], [0.0, -1.0, 1.0]], [0.1, 0.0], "adaptive_per_gene")
    return t.select("cell_id", F.col("feature").cast("int").alias("feature"), F.round("value", 6).alias("value"))


def t17_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of even and odd labels, dimension by dimension."""
    cells = I.cells(spark, sf_dir).withColumn("g", F.col("label").cast("int") % 2 == 0)
    long = cells.select(F.col("g").alias("generated"), F.posexplode("vec").alias("feature", "value"))
    t = N.ks_two_sample(long)
    return t.select("feature", F.round("statistic", 6).alias("statistic"), F.round("pvalue", 6).alias("pvalue"), "n1", "n2")


def t18_feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midrank correlations of the first component with every other."""
    target = I.cells(spark, sf_dir).select("cell_id", F.round(F.col("vec")[0], 2).alias("y"))
    return G.spearman(I.dims(spark, sf_dir), target).select("feature", F.round("correlation", 6).alias("correlation"))


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cells of even labels, in the part of real ones, and those of odd labels, in that of generated ones."""
    cells = I.cells(spark, sf_dir)
    return tuple(cells.where(F.col("label").cast("int") % 2 == r).select("cell_id", "vec") for r in (0, 1))


def j8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, made = halves(spark, sf_dir)
    return D.nearest_real(made, real).select("src", "dst", F.round("distance", 6).alias("distance"), F.round("cosine", 6).alias("cosine"))


def t17_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    real, made = halves(spark, sf_dir)
    t = D.similarity_summary(D.nearest_real(made, real))
    return t.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


def t17_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.validate_components(*halves(spark, sf_dir))
    return t.select("feature", "significant", *[F.round(c, 6).alias(c) for c in ("statistic", "real_mean", "made_mean", "real_std", "made_std")])


def t18_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.paired_correlations(*halves(spark, sf_dir))
    return t.select("feature", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def t18_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = D.correlation_summary(D.sample_pair_correlations(*halves(spark, sf_dir)))
    return t.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max")])


def t19_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = C.weights(spark, sf_dir).withColumn("w", F.transform("w", lambda x: F.round(x, 9))).join(I.cells(spark, sf_dir).select("cell_id", "label"), "cell_id")
    even = F.col("label").cast("int") % 2 == 0
    return D.validate_weights(w.where(even), w.where(~even))[1].withColumn("fraction_significant", F.round("fraction_significant", 6))


def n4_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells through the weights of their distances and back."""
    y = I.archetypes(spark, sf_dir)
    columns = [[row[j] for row in y] for j in range(len(y[0]))]
    w = C.weights(spark, sf_dir).join(I.cells(spark, sf_dir).select("cell_id", "vec"), "cell_id")
    t = D.generation_metrics(w.withColumn("fitted", V.affine(F.col("w"), columns, [0.0] * len(columns))))
    return t.select("n_effective", *[F.round(c, 6).alias(c) for c in ("archetypal_loss", "archetypal_r2", "rmse", "usage_entropy")])


def n7_generate_and_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = L.ArchetypeEstimator(I.K, "furthest").fit(I.cells(spark, sf_dir))
    return D.generate_and_validate(model, I.cells(spark, sf_dir), 500)["components"].select("feature", "statistic", "pvalue", "significant")


def s12_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many mixtures of the table's archetypes as it has cells."""
    y = I.archetypes(spark, sf_dir)
    made = N.convex_cells(spark, I.cells(spark, sf_dir).count(), y, 0.0, 7).select("cell_id", "vec", "true_weights")
    return N.generated_table(made, y, weights="true_weights").select("name", "source", "is_generated", "archetype", "dominant_archetype", F.round("max_archetype_weight", 6).alias("max_archetype_weight"), F.round("nearest_distance", 6).alias("nearest_distance"))


QUERIES = {f.__name__: f for f in (a1_train, a13_hull, a4_weights, a17_inflation, a17_outside, a18_autoencoder, a7_coordinates, a23_variational, c3_search, s3_synthetic, n1_samples, n1_within, n2_specialists, n5_holdout, n6_gene_space, t17_ks, t18_feature_correlations, j8_nearest, t17_similarity, t17_components, t18_paired, t18_summary, t19_weights, n4_metrics, n7_generate_and_validate, s12_generated)}

HALVES = f"{I.CELLS}, re AS (SELECT * FROM cells WHERE CAST(label AS INT) % 2 = 0), ma AS (SELECT * FROM cells WHERE CAST(label AS INT) % 2 = 1)"
NEAREST = f"""{HALVES}, dd AS (SELECT ma.cell_id AS src, re.cell_id AS dst, round(list_distance(ma.vec, re.vec), 9) AS distance, list_cosine_similarity(ma.vec, re.vec) AS cosine FROM ma, re),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS r FROM dd) WHERE r <= (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS INT)) FROM re))"""
ORACLE_SQL = {
    "j8_nearest": f"WITH {NEAREST} SELECT src, dst, round(distance, 6) AS distance, round(cosine, 6) AS cosine FROM near",
    "t17_similarity": f"WITH {NEAREST} SELECT count(*) AS n, round(avg(cosine), 6) AS mean, round(median(cosine), 6) AS median, round(stddev_pop(cosine), 6) AS std FROM near",
    "t17_components": f"""WITH {I.CELLS}, v AS (SELECT CAST(i - 1 AS INT) AS feature, vec[i] AS x, CAST(label AS INT) % 2 = 1 AS g FROM cells, range(1, 65) t(i)),
        c AS (SELECT feature, x, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM v GROUP BY 1, 2),
        f AS (SELECT feature, a, b, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)),
        k AS (SELECT feature, max(abs(fa - fb)) AS d, sum(a) AS n1, sum(b) AS n2 FROM f GROUP BY 1),
        y AS (SELECT feature, d, d * sqrt(CAST(n1 AS DOUBLE) * n2 / (n1 + n2)) AS l FROM k),
        q AS (SELECT feature, 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * l * l)) AS p FROM y, range(1, 101) r(j) GROUP BY 1),
        m AS (SELECT feature, round(avg(x) FILTER (NOT g), 6) AS real_mean, round(avg(x) FILTER (g), 6) AS made_mean, round(stddev_pop(x) FILTER (NOT g), 6) AS real_std, round(stddev_pop(x) FILTER (g), 6) AS made_std FROM v GROUP BY 1)
        SELECT m.*, p < 0.05 AS significant, round(d, 6) AS statistic FROM m JOIN k USING (feature) JOIN q USING (feature)""",
    "t18_paired": f"""WITH {HALVES}, a AS (SELECT row_number() OVER (ORDER BY cell_id) AS pair, vec FROM re QUALIFY pair <= 100), b AS (SELECT row_number() OVER (ORDER BY cell_id) AS pair, vec FROM ma QUALIFY pair <= 100),
        j AS (SELECT CAST(i - 1 AS INT) AS feature, a.vec[i] AS x, b.vec[i] AS y FROM a JOIN b USING (pair), range(1, 65) t(i)),
        r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM j)
        SELECT feature, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""",
    "t18_summary": f"""WITH {HALVES}, a AS (SELECT * FROM ma ORDER BY cell_id LIMIT 50), b AS (SELECT * FROM re ORDER BY cell_id LIMIT 100),
        c AS (SELECT a.cell_id AS s, b.cell_id AS d, corr(a.vec[i], b.vec[i]) AS r FROM a, b, range(1, 65) t(i) GROUP BY 1, 2)
        SELECT count(*) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(stddev_pop(r), 6) AS std, round(min(r), 6) AS min, round(max(r), 6) AS max FROM c""",
    "t19_weights": f"""WITH {I.archetypes_sql()}, {C.WEIGHTS}, v AS (SELECT archetype_idx AS feature, round(x, 9) AS x, CAST(label AS INT) % 2 = 1 AS g FROM ws JOIN cells USING (cell_id)),
        c AS (SELECT feature, x, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM v GROUP BY 1, 2),
        f AS (SELECT feature, a, b, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb FROM c WINDOW w AS (PARTITION BY feature ORDER BY x)),
        y AS (SELECT feature, max(abs(fa - fb)) * sqrt(CAST(sum(a) AS DOUBLE) * sum(b) / (sum(a) + sum(b))) AS l FROM f GROUP BY 1),
        q AS (SELECT feature, 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * l * l)) AS p FROM y, range(1, 101) r(j) GROUP BY 1)
        SELECT count(*) AS n, round(avg(CASE WHEN p < 0.05 THEN 1.0 ELSE 0.0 END), 6) AS fraction_significant FROM q""",
    "n4_metrics": f"""WITH {I.archetypes_sql()}, {C.WEIGHTS}, f AS (SELECT ws.cell_id, d.i, sum(ws.x * arch.y[d.i]) AS fit FROM ws JOIN arch USING (archetype_idx), range(1, 65) d(i) GROUP BY 1, 2),
        r AS (SELECT f.i, sum((c.vec[f.i] - f.fit) ** 2) AS res, var_pop(c.vec[f.i]) * count(*) AS tot, count(*) AS n FROM f JOIN cells c USING (cell_id) GROUP BY 1), u AS (SELECT archetype_idx, avg(x) AS m FROM ws GROUP BY 1)
        SELECT (SELECT count(*) FROM u WHERE m > 0.01) AS n_effective, round(sum(res) / max(n), 6) AS archetypal_loss, round(1 - sum(res) / greatest(sum(tot), 1e-8), 6) AS archetypal_r2, round(sqrt(sum(res) / (max(n) * count(*))), 6) AS rmse,
            (SELECT round(-sum(m * ln(m + 1e-10)), 6) FROM u) AS usage_entropy FROM r""",
    "a17_outside": f"""WITH {I.archetypes_sql()}, f AS (SELECT unnest([1.0::DOUBLE, 1.1, 1.5]) AS factor), m AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(vec[i]) AS m FROM cells, range(1, 65) t(i) GROUP BY i)),
        a AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(y[i]) AS m FROM arch, range(1, 65) t(i) GROUP BY i)), r AS (SELECT max(list_distance(vec, c)) AS radius FROM cells, m),
        y AS (SELECT factor, archetype_idx, list(a.c[i] + factor * (y[i] - a.c[i]) ORDER BY i) AS y FROM f, arch, a, range(1, 65) t(i) GROUP BY 1, 2),
        d AS (SELECT factor, list_distance(y, m.c) AS d FROM y, m)
        SELECT factor, count(*) FILTER (d > radius + 1e-12) AS outside_data_count, round(avg(d), 6) AS mean_arch_distance, round(min(d), 6) AS min_arch_distance, round(max(d), 6) AS max_arch_distance FROM d, r GROUP BY factor""",
    # The nearest point of a triangle: inside it, or on the best of its three edges.
    "a4_weights": f"""WITH {I.archetypes_sql(3)}, p AS (SELECT cell_id, vec, (SELECT y FROM arch WHERE archetype_idx = 0) AS a, (SELECT y FROM arch WHERE archetype_idx = 1) AS b, (SELECT y FROM arch WHERE archetype_idx = 2) AS c FROM cells),
        g AS (SELECT *, list_distance(a, b) ** 2 AS uu, list_distance(a, c) ** 2 AS vv, list_distance(b, c) ** 2 AS tt, list_distance(vec, a) ** 2 AS pa, list_distance(vec, b) ** 2 AS pb, list_distance(vec, c) ** 2 AS pc FROM p),
        d AS (SELECT *, (uu + vv - tt) / 2 AS uv, (pa + uu - pb) / 2 AS pu, (pa + vv - pc) / 2 AS pv, (pb + tt - pc) / 2 AS pt FROM g),
        i AS (SELECT *, (pu * vv - pv * uv) / (uu * vv - uv * uv) AS s, (pv * uu - pu * uv) / (uu * vv - uv * uv) AS t FROM d),
        options AS (
            SELECT cell_id, 1 - s - t AS w0, s AS w1, t AS w2, pa - s * pu - t * pv AS e FROM i WHERE s >= 0 AND t >= 0 AND s + t <= 1
            UNION ALL SELECT cell_id, 1 - x, x, 0, pa - 2 * x * pu + x * x * uu FROM (SELECT *, greatest(0, least(1, pu / uu)) AS x FROM i)
            UNION ALL SELECT cell_id, 1 - x, 0, x, pa - 2 * x * pv + x * x * vv FROM (SELECT *, greatest(0, least(1, pv / vv)) AS x FROM i)
            UNION ALL SELECT cell_id, 0, 1 - x, x, pb - 2 * x * pt + x * x * tt FROM (SELECT *, greatest(0, least(1, pt / tt)) AS x FROM i))
        SELECT cell_id, round(w0, 3) AS w0, round(w1, 3) AS w1, round(w2, 3) AS w2, round(sqrt(greatest(e, 0)), 5) AS error FROM options QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY e) = 1""",
    "n5_holdout": f"""WITH {I.CELLS}, b AS (SELECT min(vec[1]) AS l0, max(vec[1]) AS h0, min(vec[2]) AS l1, max(vec[2]) AS h1 FROM cells)
        SELECT cell_id, abs(vec[1] - (l0 + h0) / 2) <= 0.15 * (h0 - l0) AND abs(vec[2] - (l1 + h1) / 2) <= 0.15 * (h1 - l1) AS held_out FROM cells, b""",
    "n6_gene_space": f"""WITH {I.CELLS}, v AS (SELECT cell_id, 0 AS feature, greatest(vec[1] + 2 * vec[2] + 0.1, 0) AS value FROM cells UNION ALL SELECT cell_id, 1, greatest(vec[3] - vec[2], 0) FROM cells),
        z AS (SELECT feature, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zeros, quantile_cont(CASE WHEN value > 0 THEN value END, 0.2) AS p20 FROM v GROUP BY 1)
        SELECT cell_id, feature, round(CASE WHEN value < p20 * (CASE WHEN zeros > 0.1 THEN least(2.0, 3 * zeros) ELSE 0 END) THEN 0 ELSE value END, 6) AS value FROM v JOIN z USING (feature)""",
    "t17_ks": f"""WITH {I.CELLS}, v AS (SELECT i - 1 AS feature, vec[i] AS value, CAST(label AS INT) % 2 = 0 AS g FROM cells, range(1, 65) t(i)),
        c AS (SELECT feature, value, count(*) FILTER (g) AS a, count(*) FILTER (NOT g) AS b FROM v GROUP BY 1, 2),
        f AS (SELECT feature, a, b, sum(a) OVER w / sum(a) OVER (PARTITION BY feature) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY feature) AS fb FROM c WINDOW w AS (PARTITION BY feature ORDER BY value)),
        k AS (SELECT feature, max(abs(fa - fb)) AS statistic, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(b) AS BIGINT) AS n2 FROM f GROUP BY 1)
        SELECT CAST(feature AS INT) AS feature, round(statistic, 6) AS statistic, round({special.kolmogorov_sql('statistic', 'n1', 'n2')}, 6) AS pvalue, n1, n2 FROM k""",
    "t18_feature_correlations": f"""WITH {I.CELLS}, {I.DIMS}, j AS (SELECT feature, value, round(vec[1], 2) AS y FROM dims JOIN cells USING (cell_id)),
        r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM j)
        SELECT feature, round(corr(rx, ry), 6) AS correlation FROM r GROUP BY 1""",
}
