"""Shaping results for reports: top rows, scales, rolling values, folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplark.operators import order as O

#: Metrics of which less is better.
LOWER_IS_BETTER = frozenset({"rmse", "val_rmse", "train_rmse", "val_mae", "train_mae", "train_archetypal_loss", "convergence_epoch"})
#: The names under which fold metrics are asked for, and their own.
METRIC_ALIASES = {
    "r2": "archetype_r2",
    "archetype_r2": "archetype_r2",
    "rmse": "val_rmse",
    "val_rmse": "val_rmse",
    "train_rmse": "train_rmse",
    "mae": "val_mae",
    "val_mae": "val_mae",
    "train_mae": "train_mae",
    "archetypal_loss": "train_archetypal_loss",
    "train_archetypal_loss": "train_archetypal_loss",
    "convergence_epoch": "convergence_epoch",
}


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def top_associations(df: DataFrame, group: str, ranking: str, n: int = 10, largest: bool = True, drop_zero_p: bool = True, p: str = "pvalue", ties: Sequence[str] = ("feature",)) -> DataFrame:
    """The first n of each group; fold changes rank by their size. Zero p values and values that aren't finite leave."""
    rows = df.where(finite(ranking))
    if drop_zero_p and p in df.columns:
        rows = rows.where(F.col(p) != 0)
    key = F.abs(ranking) if "fold_change" in ranking else F.col(ranking)
    order = [key.desc() if largest else key.asc(), *ties]
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def top_with_ties(df: DataFrame, by: str, n: int, largest: bool = True) -> DataFrame:
    """The n first rows by a column and all that tie with the last; the edge is found by a limit, so no window sorts all."""
    order = F.desc(by) if largest else F.asc(by)
    edge = df.select(by).orderBy(order).limit(n).agg((F.min if largest else F.max)(by).alias("__edge"))
    kept = df.crossJoin(F.broadcast(edge))
    return kept.where(F.col(by) >= F.col("__edge") if largest else F.col(by) <= F.col("__edge")).drop("__edge")


def log_p(p: str, most: float = 300.0) -> Column:
    """-log10(p), at most ``most``; NaN stays."""
    return F.when(F.isnan(p), F.col(p)).otherwise(F.least(-F.log10(F.greatest(F.col(p), F.lit(10.0**-most))), F.lit(most)))


def rescale(df: DataFrame, column: str, low: float = 50, high: float = 400, name: str = "size") -> DataFrame:
    """The column scaled to [low, high], by its size where it has negative values."""
    edges = df.agg(F.min(column).alias("__min")).select("__min")
    base = df.crossJoin(F.broadcast(edges)).withColumn("__v", F.when(F.col("__min") < 0, F.abs(column)).otherwise(F.col(column)))
    span = base.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), low + (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (high - low)).otherwise((low + high) / 2)
    return base.crossJoin(F.broadcast(span)).withColumn(name, scaled).drop("__min", "__v", "__lo", "__hi")


def dot_positions(df: DataFrame, group: str, size: str, feature: str = "feature") -> DataFrame:
    """The y position of each dot: within its group by size, largest first."""
    return df.withColumn("y", F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(size), feature)) - 1)


def pattern_dots(df: DataFrame, min_effect: float = 0.5, max_p: float = 0.05, top: int = 20, effect: str = "mean_diff") -> DataFrame:
    """Patterns' dots: effects by size above ``min_effect`` with a corrected p up to ``max_p``; the largest ``top`` with ties."""
    rows = df.where((F.abs(effect) >= min_effect) & (F.col("fdr_pvalue") <= max_p)).withColumn("size", F.abs(effect))
    return top_with_ties(rows, effect, top)


def plot_ready(df: DataFrame, columns: Sequence[str], p: str = "pvalue") -> DataFrame:
    return df.where(F.col(p) != 0).dropna(subset=list(columns))


def summary_counts(results: dict[str, DataFrame]) -> DataFrame:
    """result, total, significant of each named result."""
    out = None
    for name, df in results.items():
        one = df.agg(F.count(F.lit(1)).alias("total"), F.count_if("significant").alias("significant")).select(F.lit(name).alias("result"), "total", "significant")
        out = one if out is None else out.unionByName(one)
    return out


def sort_results(df: DataFrame, effect: str) -> DataFrame:
    return df.orderBy("fdr_pvalue", "pvalue", F.desc(F.abs(effect)))


def rolling_mean(history: DataFrame, window: int = 5, by: str = "metric", order: str = "epoch") -> DataFrame:
    """The mean of the last ``window`` values of a metric; the first window - 1 rows leave."""
    w = Window.partitionBy(by).orderBy(order)
    rows = history.withColumn("rolling", F.avg("value").over(w.rowsBetween(1 - window, 0))).withColumn("__i", F.row_number().over(w))
    return rows.where(F.col("__i") >= window).drop("__i")


def drift(history: DataFrame, by: str = "metric", order: str = "epoch", window: int = 5) -> DataFrame:
    """step: the change since the row before; recent_variance: sample variance of the last ``window`` values."""
    w = Window.partitionBy(by).orderBy(order)
    return history.withColumn("step", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("recent_variance", F.var_samp("value").over(w.rowsBetween(1 - window, 0)))


def convergence(history: DataFrame, window: int = 5, by: str = "metric", order: str = "epoch") -> DataFrame:
    """metric, convergence_rate ((last - first) / window), stability (std / mean) over the last ``window`` rows."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    last = history.withColumn("__k", k).where(F.col("__k") <= window)
    return last.groupBy(by).agg(
        ((F.max_by("value", order) - F.min_by("value", order)) / F.count(F.lit(1))).alias("convergence_rate"), (F.stddev_pop("value") / (F.avg("value") + 1e-8)).alias("stability")
    )


def metric_summaries(history: DataFrame, by: str = "metric", order: str = "epoch") -> DataFrame:
    """metric, final, min, max, range, improvement: the percentage by which it got better."""
    g = history.groupBy(by).agg(F.max_by("value", order).alias("final"), F.min_by("value", order).alias("first"), F.min("value").alias("min"), F.max("value").alias("max"))
    up = ~F.col(by).isin(*LOWER_IS_BETTER) & ~F.col(by).contains("loss")
    change = (F.col("final") - F.col("first")) / F.when(F.col("first") == 0, None).otherwise(F.abs("first")) * 100
    return g.select(by, "final", "min", "max", (F.col("max") - F.col("min")).alias("range"), F.when(up, change).otherwise(-change).alias("improvement"))


def fold_summary(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, metric, mean, std (population, 0 of one fold), min, max over folds; NaN values don't count."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return folds.groupBy(*keys, "metric").agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def aggregated_history(histories: DataFrame) -> DataFrame:
    """metric, epoch, mean, std over folds (fold, metric, epoch, value), up to the shortest fold."""
    shortest = histories.groupBy("metric", "fold").agg(F.max("epoch").alias("e")).groupBy("metric").agg(F.min("e").alias("upto"))
    return histories.join(F.broadcast(shortest), "metric").where(F.col("epoch") <= F.col("upto")).groupBy("metric", "epoch").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def rank_configurations(summary: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Configurations best first by the mean of a metric."""
    name = METRIC_ALIASES.get(metric, metric)
    order = F.asc("mean") if name in LOWER_IS_BETTER else F.desc("mean")
    return summary.where(F.col("metric").isin(metric, name)).orderBy(order, *keys)


def elbow(folds: DataFrame, metric: str, facets: Sequence[str] = ("hidden_dims",)) -> DataFrame:
    """n_archetypes, facets, mean: what an elbow plot shows."""
    return folds.where(F.col("metric") == METRIC_ALIASES.get(metric, metric)).groupBy("n_archetypes", *facets).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def metric_names(summary: DataFrame) -> DataFrame:
    """The summary with its metrics' own names for their aliases."""
    aliases = F.create_map(*[F.lit(x) for pair in METRIC_ALIASES.items() for x in pair])
    return summary.withColumn("metric", F.coalesce(F.element_at(aliases, F.col("metric")), F.col("metric")))


def facets(table: DataFrame) -> dict[str, str | int | None]:
    """How an elbow table is best split: rows by inflation, colours by hidden_dims, whichever it has."""
    rows = "inflation" if "inflation" in table.columns else None
    return {"facet_by": rows, "color_by": "hidden_dims" if "hidden_dims" in table.columns else None, "n_facets": table.select(rows).distinct().count() if rows else 1}


def convergence_table(folds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, epochs (mean over folds until convergence), early_stopped (share of folds)."""
    pick = lambda m: F.avg(F.when(F.col("metric") == m, F.col("value")))
    return folds.groupBy(*keys).agg(pick("convergence_epoch").alias("epochs"), pick("early_stopped").alias("early_stopped"))


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, metric, value: the other columns of a table, a row for each."""
    return wide.unpivot(list(keys), [c for c in wide.columns if c not in keys], "metric", "value")


def order_by_fate(fates: DataFrame, lineage: str) -> DataFrame:
    """cell_id, prob, place: cells by their fate, smallest first, ties to the smaller id."""
    return O.places(fates.where(F.col("lineage") == lineage).select("cell_id", "prob"), [], ["prob", "cell_id"])


def axis_ranges(points: DataFrame, columns: Sequence[str], pad: float = 0.75) -> DataFrame:
    """axis, low, high: the 1st and 99th percentile, widened by ``pad`` times their distance."""
    long = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    ends = O.quantiles(long, ["axis"], "x", [0.01, 0.99]).groupBy("axis").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return ends.select("axis", (F.col("lo") - pad * (F.col("hi") - F.col("lo"))).alias("low"), (F.col("hi") + pad * (F.col("hi") - F.col("lo"))).alias("high"))
