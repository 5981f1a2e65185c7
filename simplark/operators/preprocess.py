"""Preparing counts: quality, normalisation, TF-IDF, latent factors, gene sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplark.sources.shared import cut


def quality(values: DataFrame) -> DataFrame:
    """cell_id, n_features, total."""
    return values.where("value <> 0").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_features"), F.sum("value").alias("total"))


def log_if_raw(values: DataFrame, above: float = 20.0) -> DataFrame:
    """log1p of the values if any is above ``above``, else the values as they are."""
    top = values.agg(F.max("value").alias("__top"))
    return values.crossJoin(F.broadcast(top)).withColumn("value", F.when(F.col("__top") > above, F.log1p("value")).otherwise(F.col("value"))).drop("__top")


def normalize(values: DataFrame, target: float = 1e4, log: bool = True) -> DataFrame:
    """Values scaled to ``target`` for each cell, and log1p."""
    scaled = F.col("value") * target / F.sum("value").over(Window.partitionBy("cell_id"))
    return values.withColumn("value", F.log1p(scaled) if log else scaled)


def tfidf(values: DataFrame, log_tf: bool = True) -> DataFrame:
    """tf = log1p(x / row sum), times log1p(cells / column sum); column sums, not document frequencies.

    Cells are those with a value. Row and column sums are joined back, so that no window has to
    hold a frequent feature.
    """
    rows = values.groupBy("cell_id").agg(F.sum("value").alias("__row"))
    cols = values.groupBy("feature").agg(F.sum("value").alias("__col"))
    n = rows.agg(F.count(F.lit(1)).alias("__n"))
    share = F.col("value") / F.when(F.col("__row") == 0, 1.0).otherwise(F.col("__row"))
    tf = F.log1p(share) if log_tf else share
    joined = values.join(rows, "cell_id").join(cols, "feature").crossJoin(F.broadcast(n))
    return joined.select("cell_id", "feature", (tf * F.log1p(F.col("__n") / F.col("__col"))).alias("value"))


def variable_features(values: DataFrame, n_cells: int, top: int = 2000) -> DataFrame:
    """feature, mean, var, dispersion: the ``top`` features by variance over mean; missing values are zero."""
    s = values.groupBy("feature").agg((F.sum("value") / n_cells).alias("mean"), (F.sum(F.col("value") ** 2) / n_cells).alias("sq"))
    s = s.select("feature", "mean", (F.col("sq") - F.col("mean") ** 2).alias("var"))
    return s.withColumn("dispersion", F.col("var") / F.col("mean")).orderBy(F.desc("dispersion"), "feature").limit(top)


def gram(values: DataFrame, names: list[str]) -> np.ndarray:
    """Sums of products of features over cells.

    Each task adds up dense products of its cells' rows, 512 cells at a time; what is shuffled is a
    row of the matrix for each feature and task.
    """
    at = {f: i for i, f in enumerate(names)}
    cells = values.groupBy("cell_id").agg(F.collect_list("feature").alias("f"), F.collect_list("value").alias("x"))

    def part(pdf: pd.DataFrame) -> np.ndarray:
        total = np.zeros((len(names), len(names)))
        for i in range(0, len(pdf), 512):
            some = pdf.iloc[i : i + 512]
            rows = np.zeros((len(some), len(names)))
            for k, (fs, xs) in enumerate(zip(some["f"], some["x"], strict=True)):
                rows[k, [at[f] for f in fs]] = xs
            total += rows.T @ rows
        return total

    return added(cells, part, (len(names), len(names)))


def added(rows: DataFrame, part: Callable[[pd.DataFrame], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``part`` over all batches of rows: in tasks first, then in as many tasks as the root of their number."""

    def batches(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"sums": [sum((part(pdf) for pdf in pdfs if len(pdf)), np.zeros(shape)).tobytes()]})

    def again(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"sums": [sum((np.frombuffer(b) for pdf in pdfs for b in pdf["sums"]), np.zeros(math.prod(shape))).tobytes()]})

    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    found = rows.mapInPandas(batches, "sums binary").repartition(fan).mapInPandas(again, "sums binary").toPandas()["sums"]
    return sum((np.frombuffer(b) for b in found), np.zeros(math.prod(shape))).reshape(shape)


def product(values: DataFrame, table: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """(to, v): the matrix of values times the table (by, v) of ``width`` columns, added up before and after the shuffle."""
    sums = values.join(table, by).groupBy(to).agg(*[F.sum(F.col("value") * F.col("v")[i]).alias(f"s{i}") for i in range(width)])
    return sums.select(to, F.array(*[f"s{i}" for i in range(width)]).alias("v"))


def rotated(table: DataFrame, column: str, turn: np.ndarray) -> DataFrame:
    """(feature, v): the rows of a column times a small matrix."""

    def rows(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                yield pd.DataFrame({"feature": pdf["feature"], "v": list(np.array(pdf[column].tolist()) @ turn)})

    return table.select("feature", column).mapInPandas(rows, "feature string, v array<double>")


def right_vectors(values: DataFrame, k: int, rounds: int = 300, tolerance: float = 1e-6) -> DataFrame:
    """feature, v: the first k right singular vectors of a sparse table (cell_id, feature, value) of any width.

    Subspace iteration with twice as many vectors, begun from hashes of the features' names. Products with the
    table are joins, whose sums shuffle; only width x width matrices reach the driver. It ends when no vector's
    residual is above ``tolerance`` times the first eigenvalue and raises if ``rounds`` don't get there.
    """
    width = 2 * k + 10
    names = values.select("feature").distinct()
    unit = lambda i: F.pmod(F.xxhash64("feature", F.lit(i)), F.lit(2_000_003)) / 1_000_001.0 - 1
    space = names.select("feature", F.array(*[unit(i) for i in range(width)]).alias("v")).checkpoint()
    squares = added(space, lambda pdf: (x := np.array(pdf["v"].tolist())).T @ x, (width, width))
    space = rotated(space, "v", upright(squares)).checkpoint()
    for _ in range(rounds):
        width = len(space.first().v)
        there = product(values, space, "feature", "cell_id", width)
        back = product(values, there, "cell_id", "feature", width).withColumnRenamed("v", "z")
        both = space.join(back, "feature").checkpoint()

        def sums(pdf: pd.DataFrame) -> np.ndarray:
            v, z = (np.array(pdf[c].tolist()) for c in ("v", "z"))
            return np.stack([v.T @ z, z.T @ z])

        cross, squares = added(both, sums, (2, width, width))
        found, turn = np.linalg.eigh((cross + cross.T) / 2)
        found, turn = found[::-1], turn[:, ::-1]
        residual = np.sqrt(np.maximum((turn * (squares @ turn)).sum(0) - found**2, 0))[:k].max()
        if residual <= tolerance * max(found[0], 1e-300):
            return rotated(both, "v", np.hstack([turn[:, :k], np.zeros((width, max(0, k - width)))]))
        space = rotated(both, "z", turn @ upright(turn.T @ squares @ turn)).checkpoint()
    raise RuntimeError(f"singular vectors after {rounds} rounds: a residual of {residual:.3g} of {found[0]:.3g}")


def upright(squares: np.ndarray) -> np.ndarray:
    """The matrix that makes columns with these products orthonormal; what depends on others leaves."""
    scale = 1 / np.sqrt(np.maximum(np.diag(squares), 1e-300))
    s, u = np.linalg.eigh(squares * scale[:, None] * scale)
    keep = s > 1e-13 * s[-1]
    return scale[:, None] * u[:, keep] / np.sqrt(s[keep])


def lsi(values: DataFrame, n_components: int = 50, drop_first: bool = True, dense_features: int = 4000) -> DataFrame:
    """cell_id, vec: truncated SVD (uncentred) of TF-IDF, first component dropped; at most the smaller side less two components.

    Up to ``dense_features`` features the Gramian is added up on Spark and decomposed at once; more go through
    ``right_vectors``, which gives the same vectors within its tolerance. The largest loading of each is positive.
    The values are made once and written, as are those of TF-IDF, which all passes read.
    """
    values = cut(values)
    t = cut(tfidf(values))
    names = [r.feature for r in t.select("feature").distinct().orderBy("feature").limit(dense_features + 1).collect()]
    width = t.select("feature").distinct().count() if len(names) > dense_features else len(names)
    k = max(1, min(n_components, width - 2, t.select("cell_id").distinct().count() - 2))
    if len(names) <= dense_features:
        _, vectors = np.linalg.eigh(gram(t, names))
        loadings = values.sparkSession.createDataFrame([(f, r.tolist()) for f, r in zip(names, vectors[:, ::-1][:, :k], strict=True)], "feature string, v array<double>")
    else:
        loadings = right_vectors(t, k).checkpoint()
    sign = loadings.agg(*[F.max_by(F.col("v")[i], F.struct(F.round(F.abs(F.col("v")[i]), 9), "feature")) for i in range(k)]).first()
    turn = [-1.0 if s is not None and s < 0 else 1.0 for s in sign]
    scores = product(t, loadings, "feature", "cell_id", k)
    first = 2 if drop_first else 1
    return scores.select("cell_id", F.slice(F.zip_with("v", F.lit(turn), lambda x, s: x * s), first, k).alias("vec"))


def pca(cells: DataFrame, k: int = 50) -> tuple[DataFrame, list[list[float]], list[float]]:
    """((cell_id, vec) of centred principal components, loadings by feature, explained shares)."""
    mean = cells.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()
    centre = F.lit([r.m for r in mean])
    rows = cells.select("cell_id", array_to_vector(F.zip_with("vec", centre, lambda x, m: x - m)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select("cell_id", vector_to_array("p").alias("vec")), model.pc.toArray().tolist(), model.explainedVariance.toArray().tolist()


def cumulative_variance(shares: DataFrame) -> DataFrame:
    """pc, share, cumulative; a row for each component."""
    return shares.withColumn("cumulative", F.sum("share").over(Window.orderBy("pc").rowsBetween(Window.unboundedPreceding, 0)))


def looks_like_ensembl(features: DataFrame, first: int = 100) -> bool:
    """Whether more than half of the first names (by name) begin as Ensembl ids do."""
    row = features.select("feature").distinct().orderBy("feature").limit(first).agg(F.avg(F.col("feature").startswith("ENSG").cast("double")).alias("share")).first()
    return (row.share or 0) > 0.5


def detect_columns(table: DataFrame) -> dict[str, list[str]]:
    """The columns of a cell table by what they may be: vectors (arrays of numbers), categories (strings, booleans), numbers."""
    kinds: dict[str, list[str]] = {"vectors": [], "categories": [], "numbers": []}
    for field in table.schema.fields:
        kind = field.dataType.simpleString()
        if kind.startswith("array<") and kind[6:-1] in ("float", "double", "int", "bigint"):
            kinds["vectors"].append(field.name)
        elif kind in ("string", "boolean"):
            kinds["categories"].append(field.name)
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            kinds["numbers"].append(field.name)
    return kinds


def resolve_colour(cells: DataFrame, values: DataFrame, name: str) -> DataFrame | None:
    """(cell_id, colour) of a name: a column of the cells, else a feature's values (zero where missing), else nothing."""
    if name in cells.columns:
        return cells.select("cell_id", F.col(name).alias("colour"))
    own = values.where(F.col("feature") == name).select("cell_id", F.col("value").alias("colour"))
    if own.isEmpty():
        return None
    return cells.select("cell_id").join(own, "cell_id", "left").fillna(0.0, ["colour"])


def symbol(name: str):
    """Gene symbols compared without case and blanks, on both sides."""
    return F.upper(F.trim(name))


def pathway_members(net: DataFrame, features: DataFrame) -> DataFrame:
    """The net's rows whose target is a feature."""
    return net.join(features.select(symbol("feature").alias("__f")).distinct(), symbol("target") == F.col("__f"), "left_semi")


def aucell(values: DataFrame, net: DataFrame, top: float = 0.05, n_features: int | None = None) -> DataFrame:
    """cell_id, pathway, score: the area under the recovery curve of a set in a cell's top features.

    Features are ranked by value, largest first, ties by name; a member at rank r (from 0) below
    the cutoff L = max(1, round(top * features)) adds L - r, over the most a set of its size can reach.
    """
    n = n_features or values.select("feature").distinct().count()
    cutoff = max(1, round(top * n))
    ranked = values.withColumn("r", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("value"), "feature")) - 1).where(F.col("r") < cutoff)
    members = pathway_members(net, values.select("feature")).select(F.col("source").alias("pathway"), symbol("target").alias("f")).distinct()
    size = members.groupBy("pathway").agg(F.count(F.lit(1)).alias("m"))
    c = F.least("m", F.lit(cutoff))
    best = size.select("pathway", (c * cutoff - c * (c - 1) / 2).alias("best"))
    hits = ranked.withColumn("f", symbol("feature")).join(members, "f").groupBy("cell_id", "pathway").agg(F.sum(cutoff - F.col("r")).alias("area"))
    grid = values.select("cell_id").distinct().crossJoin(F.broadcast(best))  # cells without a member among their top features score 0
    return grid.join(hits, ["cell_id", "pathway"], "left").select("cell_id", "pathway", (F.coalesce("area", F.lit(0)) / F.col("best")).alias("score"))


def align_scores(cells: DataFrame, scores: DataFrame, fill: float = 0.0) -> DataFrame:
    """A score for every cell; those without one get ``fill``."""
    return cells.select("cell_id").join(scores, "cell_id", "left").fillna(fill)


def top_variance(scores: DataFrame, top: int = 10) -> DataFrame:
    """pathway, variance: sample variance of the scores, largest first."""
    return scores.groupBy("pathway").agg(F.var_samp("score").alias("variance")).orderBy(F.desc("variance"), "pathway").limit(top)
