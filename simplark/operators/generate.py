"""Generating cells, and comparing the distributions of generated and real ones."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.functions import special
from simplark.functions import vectors as V
from simplark.operators import archetypes as A
from simplark.operators import order as O
from simplark.sources.shared import cut, small


def dirichlet(k: int, seed: int) -> Column:
    """Weights from a flat Dirichlet: exponential draws scaled to one."""
    draws = F.array(*[-F.log(F.greatest(F.rand(seed + i), F.lit(1e-300))) for i in range(k)])
    return draws


def scaled(draws: str) -> Column:
    s = V.total(F.col(draws))
    return F.transform(draws, lambda x: x / s)


def planted_archetypes(k: int, dims: int, kind: str = "random", scale: float = 20.0, seed: int = 1205) -> list[list[float]]:
    """k points: 'corners' of a simplex along the axes, on a 'sphere', or 'random' in a cube."""
    import random

    r = random.Random(seed)
    if kind == "corners":
        return [[scale * (j == i % dims) * (1 if i < dims else -1) for j in range(dims)] for i in range(k)]
    points = [[r.gauss(0, 1) if kind == "sphere" else (r.random() - 0.5) * scale for _ in range(dims)] for _ in range(k)]
    if kind == "sphere":
        points = [[x * scale / math.sqrt(sum(y * y for y in p)) for x in p] for p in points]
    return points


def convex_cells(spark: SparkSession, n: int, archetypes: Sequence[Sequence[float]], noise: float = 0.1, seed: int = 1205) -> DataFrame:
    """cell_id, vec, true_weights, dominant_archetype: convex mixtures of the archetypes with Gaussian noise, made where they are used."""
    k, dims = len(archetypes), len(archetypes[0])
    rows = spark.range(n).withColumnRenamed("id", "cell_id").withColumn("__e", dirichlet(k, seed)).withColumn("true_weights", scaled("__e"))
    rows = rows.withColumn("__n", F.array(*[F.randn(seed + 1000 + j) * noise for j in range(dims)]))
    exact = V.affine(F.col("true_weights"), [list(c) for c in zip(*archetypes, strict=True)], [0.0] * dims)
    vec = F.zip_with(exact, F.col("__n"), lambda x, e: x + e)
    return rows.select("cell_id", vec.alias("vec"), "true_weights", F.concat(F.lit("archetype_"), (V.argmax(F.col("true_weights")) + 1).cast("string")).alias("dominant_archetype"))


def bounds(cells: DataFrame) -> list:
    """pos, lo, hi, mean, std of every dimension: a row for each."""
    long = cells.select(F.posexplode("vec").alias("pos", "x"))
    return long.groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).orderBy("pos").collect()


def sample_coordinates(cells: DataFrame, n: int, strategy: str = "uniform", clip: float = 0.8, seed: int = 0, archetypes: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """cell_id, vec: new points by the cells' bounds ('uniform'), moments ('normal'), exponentials ('poisson') or mixtures ('dirichlet').

    All but mixtures are pulled back into ``clip`` times the largest distance from the centre.
    """
    spark = cells.sparkSession
    if strategy == "dirichlet":
        return convex_cells(spark, n, archetypes, 0.0, seed).select("cell_id", "vec")
    b = bounds(cells)
    draw = {
        "uniform": lambda r, i: r.lo + F.rand(seed + i) * (r.hi - r.lo), "normal": lambda r, i: r.mean + F.randn(seed + i) * r.std,
        "poisson": lambda r, i: r.lo - F.log(F.greatest(F.rand(seed + i), F.lit(1e-300))) * (r.hi - r.lo) / 4,
    }[strategy]
    centre = V.literal([r.mean for r in b])
    radius = clip * cells.agg(F.max(V.distance(F.col("vec"), centre))).first()[0]
    rows = spark.range(n).withColumnRenamed("id", "cell_id").withColumn("__v", F.array(*[F.least(F.greatest(draw(r, i), F.lit(r.lo)), F.lit(r.hi)) for i, r in enumerate(b)]))
    rows = rows.withColumn("__d", V.distance(F.col("__v"), centre))
    shrink = F.when(F.col("__d") > radius, radius / F.col("__d")).otherwise(1.0)
    return rows.withColumn("__s", shrink).select("cell_id", F.zip_with("__v", centre, lambda x, c: (x - c)).alias("__v"), "__s").select(
        "cell_id", F.zip_with(F.transform("__v", lambda x: x * F.col("__s")), centre, lambda x, c: x + c).alias("vec")
    )


def held_out_box(cells: DataFrame, ranges: dict[int, float] | None = None, default: float = 0.3) -> dict[int, tuple[float, float]]:
    """The lower and upper end in each given dimension of the box around the middle of the cells."""
    ranges = {0: default, 1: default} if ranges is None else ranges
    middle = {r.pos: ((r.lo + r.hi) / 2, ranges[r.pos] * (r.hi - r.lo) / 2) for r in bounds(cells) if r.pos in ranges}
    return {pos: (mid - half, mid + half) for pos, (mid, half) in middle.items()}


def mixtures_within(spark: SparkSession, n: int, archetypes: Sequence[Sequence[float]], box: dict[int, tuple[float, float]], seed: int = 0, most: int = 10) -> tuple[DataFrame, dict[str, int]]:
    """(cell_id, attempt, weights, vec of ``n`` flat Dirichlet mixtures that lie in the box; how many were accepted and rejected until the last).

    Attempts are numbered, and each one's weights come from hashes of its number, so they don't depend on
    partitions. The first n measure how many are accepted, as many as that asks for are made, at most ``most``
    times n, and accepted ones are numbered in order. With too few in all of these there are fewer rows.
    """
    k, dims = len(archetypes), len(archetypes[0])
    uniform = lambda i: (F.shiftrightunsigned(F.xxhash64("attempt", F.lit(i), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    inside = F.lit(True)
    for pos, (low, high) in box.items():
        inside = inside & F.col("vec")[pos].between(low, high)

    def accepted(attempts: int) -> DataFrame:
        rows = spark.range(attempts).withColumnRenamed("id", "attempt").withColumn("e", F.array(*[-F.log(uniform(i)) for i in range(k)]))
        rows = rows.select("attempt", scaled("e").alias("weights"))
        exact = V.affine(F.col("weights"), [list(c) for c in zip(*archetypes, strict=True)], [0.0] * dims)
        return rows.withColumn("vec", exact).where(inside)

    first = accepted(n).count()
    need = min(most * n, math.ceil(1.1 * n * n / max(first, 1) + 10 * math.sqrt(n)) if first < n else n)
    for attempts in dict.fromkeys((need, most * n)):
        placed = cut(O.places(accepted(attempts), [], ["attempt"], "cell_id"))
        if (have := placed.count()) >= n or attempts == most * n:
            break
    out = placed.where(F.col("cell_id") < n).select("cell_id", "attempt", "weights", "vec")
    tried = attempts if have < n else out.agg(F.max("attempt")).first()[0] + 1 if n else 0
    return out, {"accepted": min(have, n), "rejected": tried - min(have, n)}


def specialists(spark: SparkSession, archetype: Sequence[float], n: int, radius: float = 0.1, seed: int = 0) -> DataFrame:
    """cell_id, vec: points uniform in a ball around an archetype."""
    d = len(archetype)
    rows = spark.range(n).withColumnRenamed("id", "cell_id").withColumn("__g", F.array(*[F.randn(seed + i) for i in range(d)])).withColumn("__r", radius * F.pow(F.rand(seed + d), F.lit(1 / d)))
    rows = rows.withColumn("__n", V.norm(F.col("__g")))
    return rows.select("cell_id", F.zip_with(F.transform("__g", lambda x: x / F.col("__n") * F.col("__r")), V.literal(archetype), lambda x, c: x + c).alias("vec"))


def volumetric_holdout(cells: DataFrame, ranges: dict[int, float] | None = None, default: float = 0.3) -> DataFrame:
    """The cells with held_out: inside the box around the middle of the given dimensions' ranges."""
    inside = F.lit(True)
    for pos, (low, high) in held_out_box(cells, ranges, default).items():
        inside = inside & F.col("vec")[pos].between(low, high)
    return cells.withColumn("held_out", inside)


def gene_space(cells: DataFrame, loadings: Sequence[Sequence[float]], centre: Sequence[float], sparsity: str = "none") -> DataFrame:
    """cell_id, feature, value: coordinates times loadings plus the centre, never below zero.

    'adaptive_per_gene' clears values below each feature's 20th percentile of its positive values,
    times min(2, 3 * share of zeros) where that share is over a tenth; 'quantile' below that percentile.
    """
    dims = len(loadings[0])
    have = F.transform(V.truncate(F.col("vec"), dims), lambda x: x)
    padded = F.slice(F.concat(have, F.lit([0.0] * dims)), 1, dims)
    long = cells.select("cell_id", F.posexplode(V.affine(padded, loadings, centre)).alias("feature", "value")).withColumn("value", F.greatest("value", F.lit(0.0)))
    if sparsity == "none":
        return long
    share = F.avg((F.col("value") == 0).cast("double"))
    factor = F.when(F.col("zeros") > 0.1, F.least(F.lit(2.0), 3 * F.col("zeros"))).otherwise(0.0) if sparsity == "adaptive_per_gene" else F.lit(1.0)
    p20 = O.quantiles(long.where("value > 0"), ["feature"], "value", [0.2]).select("feature", F.col("value").alias("p20"))
    zeros = long.groupBy("feature").agg(share.alias("zeros"))
    edges = small(zeros.join(p20, "feature", "left").select("feature", (F.coalesce("p20", F.lit(0.0)) * factor).alias("edge")))
    return long.join(edges, "feature").select("cell_id", "feature", F.when(F.col("value") < F.col("edge"), 0.0).otherwise(F.col("value")).alias("value"))


def ks_two_sample(values: DataFrame) -> DataFrame:
    """feature, statistic, pvalue, n1, n2 of values (feature, value, generated boolean), from counts of distinct values."""
    one, two = F.count_if(F.col("generated")), F.count_if(~F.col("generated"))
    c = values.groupBy("feature", "value").agg(one.alias("a"), two.alias("b"))
    totals = O.running_totals(c, ["feature"], ["value"], ["a", "b"])
    sizes = totals.groupBy("feature").agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")).where("n1 > 0 AND n2 > 0")
    gap = F.abs((F.col("a_before") + F.col("a")) / F.col("n1") - (F.col("b_before") + F.col("b")) / F.col("n2"))
    t = totals.join(sizes, "feature").groupBy("feature", "n1", "n2").agg(F.max(gap).alias("statistic")).select("feature", "statistic", "n1", "n2")
    return t.withColumn("pvalue", F.expr(special.kolmogorov_sql("statistic", "n1", "n2")))


def compare_coordinates(real: DataFrame, made: DataFrame) -> DataFrame:
    """``ks_two_sample`` of every dimension of two tables of vectors."""
    both = real.select("vec", F.lit(False).alias("generated")).unionByName(made.select("vec", F.lit(True).alias("generated")))
    return ks_two_sample(both.select("generated", F.posexplode("vec").alias("feature", "value")))


def generated_table(made: DataFrame, archetypes: Sequence[Sequence[float]], source: str = "generated", share: float = 0.1, weights: str | None = None) -> DataFrame:
    """Generated cells with their names, source, is_generated, bins and distances; of a column of ``weights`` also the dominant archetype and its weight."""
    made = cut(made)
    binned = A.labels(A.bins(made, archetypes, share))
    d = A.distance_table(made, archetypes)
    out = made.join(binned, "cell_id").join(d, "cell_id").withColumns({"name": F.concat(F.lit(f"{source}_"), F.col("cell_id").cast("string")), "source": F.lit(source), "is_generated": F.lit(True)})
    if weights is None:
        return out
    top = {"max_archetype_weight": F.array_max(weights), "dominant_archetype": F.concat(F.lit("archetype_"), (V.argmax(F.col(weights)) + 1).cast("string"))}
    return out.withColumns(top)
