"""Generating through a model, and holding generated rows against real ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplark.functions import vectors as V
from simplark.operators import generate as N
from simplark.operators import order as O
from simplark.operators.archetypes import distances_to
from simplark.operators.graph import midranks
from simplark.sources.shared import cut

#: Rows of a block of either side in the nearest-neighbour join, of a tile within it, and of the sample that proposes bounds.
BLOCK_ROWS, TILE, SAMPLE_ROWS = 32_768, (128, 4096), 20_000
#: Steps between the bounds of a row; pairs of blocks at least, where there are rows for them.
STEPS, GROUPS = 48, 48
ARROW = {"long": pa.int64(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def lists(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of arrays of one length."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in column.chunks if len(c)])


def within(p: np.ndarray, q: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of p and q and their distance, rounded to nine digits, where it is at most the bound of p's row.

    Products in tiles find what may be near enough, and that alone is measured.
    """
    squares, other = (p * p).sum(1), (q * q).sum(1)
    # Products are off by some units of the last place of the squares; distances tie at nine digits.
    edge = np.where(np.isfinite(bound), (np.maximum(bound, 0) + 1e-9) ** 2 + 1e-12 * (squares + other.max()) + 1e-15, np.inf) - squares
    tall, wide = np.hstack((p, np.ones((len(p), 1)))), np.hstack((-2 * q, other[:, None])).T
    for at in range(0, len(p), TILE[0]):
        for to in range(0, len(q), TILE[1]):
            found = np.flatnonzero(tall[at : at + TILE[0]] @ wide[:, to : to + TILE[1]] <= edge[at : at + TILE[0], None])
            for k in range(0, len(found), TILE[1]):
                r, c = np.divmod(found[k : k + TILE[1]], min(TILE[1], len(q) - to))
                r, c = r + at, c + to
                d = np.sqrt(((p[r] - q[c]) ** 2).sum(1)).round(9)
                keep = d <= bound[r]
                yield r[keep], c[keep], d[keep]


def met(made: DataFrame, real: DataFrame, blocks: tuple[int, int], columns: Sequence[str], run: Callable[..., Iterator[dict[str, object]]], schema: dict[str, str]) -> DataFrame:
    """``run`` of every pair of blocks: ids and vectors of both sides, and ``columns`` of the made one, by name. What it yields leaves at once."""
    deal = lambda n: F.pmod(F.xxhash64("cell_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = made.select("cell_id", "vec", *columns, F.lit(True).alias("is_made"), deal(blocks[0]).alias("i"), every(blocks[1]).alias("j"))
    b = real.select("cell_id", "vec", *[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in columns], F.lit(False).alias("is_made"), every(blocks[0]).alias("i"), deal(blocks[1]).alias("j"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        left, right = rows.filter(rows["is_made"]), rows.filter(pc.invert(rows["is_made"]))
        if left.num_rows and right.num_rows:
            more = [lists(left[c]) if pa.types.is_list(left[c].type) else left[c].to_numpy() for c in columns]
            for found in run(left["cell_id"].to_numpy(), lists(left["vec"]), right["cell_id"].to_numpy(), lists(right["vec"]), *more):
                yield pa.RecordBatch.from_arrays([pa.array(found[c], ARROW[t]) for c, t in schema.items()], names=list(schema))

    return a.unionByName(b).groupBy("i", "j").applyInArrow(meet, ", ".join(f"{c} {t}" for c, t in schema.items()))


def nearest_real(made: DataFrame, real: DataFrame, share: float = 0.01) -> DataFrame:
    """src, dst, distance, cosine: the max(1, floor(real rows x share)) real rows nearest to each generated one, ties to the smaller id.

    Both sides are (cell_id, vec). Pairs of blocks meet three times, and no pair of rows that isn't among the nearest is kept.
    Order statistics of a sample of real rows propose, for each generated row, steps around the distance of its k-th
    neighbour; all rows are counted by step, what lies in the k-th one's step is gathered and gives that
    neighbour, and the last pass returns what is up to it. The counts decide: where a sample misled, a step is only larger.
    """
    n = real.count()
    k = max(1, int(n * share))
    # Small tables still make some tens of groups.
    rows, right = made.count(), max(1, -(-n // BLOCK_ROWS))
    blocks = max(1, -(-rows // BLOCK_ROWS), min(-(-GROUPS // right), rows // 512)), right
    sample = real.where(F.pmod(F.xxhash64("cell_id", F.lit(n)), F.lit(max(1, n))) < SAMPLE_ROWS)

    def propose(ids, p, others, q):
        rank = k * len(q) / n
        low, high = max(0, int(rank - 6 * rank**0.5 - 6)), int(rank + 6 * rank**0.5 + 6)
        at = np.linspace(low, min(high, len(q) - 1), STEPS + 1).round().astype(int)
        squares = (q * q).sum(1)
        for i in range(0, len(p), TILE[0]):
            some = p[i : i + TILE[0]]
            d = np.partition((some * some).sum(1)[:, None] + squares - 2 * some @ q.T, at[-1], axis=1)[:, : at[-1] + 1]
            edges = np.sqrt(np.maximum(np.sort(d, axis=1)[:, at], 0))
            if high >= len(q):
                edges[:, -1] = np.inf
            yield {"cell_id": ids[i : i + TILE[0]], "edges": list(edges)}

    def count(ids, p, others, q, edges):
        counts = np.zeros((len(p), STEPS + 1), np.int64)
        for r, _, d in within(p, q, edges[:, -1]):
            np.add.at(counts, (r, (edges[r] < d[:, None]).sum(1)), 1)
        yield {"cell_id": ids, "upto": list(counts.cumsum(1).astype(np.int32))}

    def gather(ids, p, others, q, low, high):
        for r, c, d in within(p, q, high):
            keep = d > low[r]
            yield {"src": ids[r[keep]], "dst": others[c[keep]], "distance": d[keep]}

    def nearest(ids, p, others, q, last, last_id):
        one, two = (p * p).sum(1), (q * q).sum(1)
        for r, c, d in within(p, q, last):
            keep = (d < last[r]) | (others[c] <= last_id[r])
            r, c, d = r[keep], c[keep], d[keep]
            norms = np.sqrt(one[r] * two[c])
            yield {"src": ids[r], "dst": others[c], "distance": d, "cosine": np.where(norms > 0, (p[r] * q[c]).sum(1) / np.where(norms > 0, norms, 1), np.nan)}

    proposed = made.join(met(made, sample, (blocks[0], 1), [], propose, {"cell_id": "long", "edges": "array<double>"}), "cell_id", "left")
    proposed = cut(proposed.select("cell_id", "vec", F.coalesce("edges", F.lit([float("inf")] * (STEPS + 1))).alias("edges")))
    counts = met(proposed, real, blocks, ["edges"], count, {"cell_id": "long", "upto": "array<int>"})
    upto = counts.groupBy("cell_id").agg(F.array(*[F.sum(F.get("upto", F.lit(i))) for i in range(STEPS + 1)]).alias("upto"))
    # The first step, from 0, that reaches k; beyond all steps where none does.
    step = F.coalesce(F.array_position(F.transform("upto", lambda x: x >= k), True) - 1, F.lit(STEPS + 1)).cast("int")
    below = F.when(step > 0, F.get("upto", step - 1)).otherwise(0)
    infinite = F.lit(float("inf"))
    ranges = proposed.join(upto, "cell_id").select("cell_id", "vec", F.when(step > 0, F.get("edges", step - 1)).otherwise(-1.0).alias("low"), F.coalesce(F.get("edges", step), infinite).alias("high"), (k - below).alias("wanted"))
    ranges = cut(ranges)
    gathered = met(ranges, real, blocks, ["low", "high"], gather, {"src": "long", "dst": "long", "distance": "double"})
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    last = gathered.withColumn("r", rank).join(ranges.select(F.col("cell_id").alias("src"), "wanted"), "src").where(F.col("r") == F.col("wanted"))
    bounded = cut(ranges.join(last.select(F.col("src").alias("cell_id"), F.col("distance").alias("last"), F.col("dst").alias("last_id")), "cell_id").select("cell_id", "vec", "last", "last_id"))
    return met(bounded, real, blocks, ["last", "last_id"], nearest, {"src": "long", "dst": "long", "distance": "double", "cosine": "double"})


def similarity_summary(pairs: DataFrame) -> DataFrame:
    """One row: n, mean, median and population std of the cosines of ``nearest_real``; vectors of length zero have none."""
    c = pairs.where(~F.isnan("cosine"))
    return summarised(c, "cosine", ["n", "mean", "median", "std"])


def component_moments(real: DataFrame, made: DataFrame) -> DataFrame:
    """feature, real and made mean and population std of every component."""
    both = real.select("vec", F.lit(False).alias("g")).unionByName(made.select("vec", F.lit(True).alias("g")))
    long = both.select("g", F.posexplode("vec").alias("feature", "x"))
    one = lambda f, g: f(F.when(F.col("g") == g, F.col("x")))
    return long.groupBy("feature").agg(
        one(F.avg, False).alias("real_mean"), one(F.avg, True).alias("made_mean"), one(F.stddev_pop, False).alias("real_std"), one(F.stddev_pop, True).alias("made_std")
    )


def validate_components(real: DataFrame, made: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``compare_coordinates`` with moments and significant."""
    t = N.compare_coordinates(real, made).join(component_moments(real, made), "feature")
    return t.withColumn("significant", F.col("pvalue") < alpha)


def validate_distances(real: DataFrame, made: DataFrame, archetypes: Sequence[Sequence[float]]) -> DataFrame:
    """The same over distances to archetypes: feature is the archetype's number."""
    d = [df.select(distances_to(F.col("vec"), archetypes).alias("vec")) for df in (real, made)]
    return validate_components(*d)


def validate_weights(real: DataFrame, made: DataFrame, column: str = "w", alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(tests of every weight, one row with the number of weights and the share that differs significantly)."""
    tests = N.compare_coordinates(real.select(F.col(column).alias("vec")), made.select(F.col(column).alias("vec"))).withColumn("significant", F.col("pvalue") < alpha)
    return tests, tests.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("significant").cast("double")).alias("fraction_significant"))


def paired_correlations(real: DataFrame, made: DataFrame, rows: int = 100) -> DataFrame:
    """feature, n, pearson, spearman of the first ``rows`` rows of both tables by cell_id, paired in that order."""

    def first(df: DataFrame, name: str) -> DataFrame:
        some = df.orderBy("cell_id").limit(rows)
        long = some.withColumn("pair", F.row_number().over(Window.orderBy("cell_id")))  # at most ``rows`` rows
        return long.select("pair", F.posexplode("vec").alias("feature", name))

    both = first(real, "x").join(first(made, "y"), ["pair", "feature"])
    ranked = midranks(midranks(both, ("feature",), "x", "rx"), ("feature",), "y", "ry")
    return ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def sample_pair_correlations(real: DataFrame, made: DataFrame, generated: int = 50, others: int = 100) -> DataFrame:
    """src, dst, pearson over the components of the first generated and the first real rows: at most ``generated`` x ``others`` pairs."""
    a = made.orderBy("cell_id").limit(generated).select(F.col("cell_id").alias("src"), F.col("vec").alias("a"))
    b = real.orderBy("cell_id").limit(others).select(F.col("cell_id").alias("dst"), F.col("vec").alias("b"))
    pairs = a.crossJoin(F.broadcast(b))
    moments = pairs.select("*", V.mean(F.col("a")).alias("ma"), V.mean(F.col("b")).alias("mb"))
    t = moments.select("src", "dst", F.transform("a", lambda x: x - F.col("ma")).alias("a"), F.transform("b", lambda x: x - F.col("mb")).alias("b"))
    norms = V.norm(F.col("a")) * V.norm(F.col("b"))
    return t.select("src", "dst", F.when(norms > 0, V.dot(F.col("a"), F.col("b")) / norms).alias("pearson"))


def correlation_summary(tests: DataFrame, column: str = "pearson") -> DataFrame:
    """One row: n, mean, median, population std, smallest and largest of a correlation that isn't null."""
    c = tests.where(F.col(column).isNotNull() & ~F.isnan(column))
    return summarised(c, column, ["n", "mean", "median", "std", "min", "max"])


def summarised(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """One row with the named summaries of a column; the median is exact and null without rows."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)], pa.list_(pa.float64()))], names=["held"])

    # Arrays of a batch each take a third of the disk that rows would.
    rows = cut(rows.select(F.col(column).cast("double")).mapInArrow(packed, "held array<double>")).select(F.explode("held").alias(column))
    moments = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    middle = O.quantiles(rows, [], column, [0.5], written=True).agg(F.max("value").alias("median"))
    return moments.crossJoin(F.broadcast(middle)).select(*names)  # a row each


def generation_metrics(passed: DataFrame, x: str = "vec", fitted: str = "fitted", w: str = "w") -> DataFrame:
    """One row: archetypal_loss (squared Frobenius norm a row), archetypal_r2, rmse, usage entropy and archetypes used over 1 % on average.

    ``passed`` are rows that a model gave weights and a reconstruction.
    """
    error = V.squared_distance(F.col(x), F.col(fitted))
    rows = passed.agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("sse"), F.first(F.size(x)).alias("dims"))
    spread = passed.select(F.posexplode(x).alias("pos", "v")).groupBy("pos").agg((F.var_pop("v") * F.count("v")).alias("t")).agg(F.sum("t").alias("total"))
    usage = passed.select(F.posexplode(w).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    used = usage.agg((-F.sum(F.col("m") * F.log(F.col("m") + 1e-10))).alias("usage_entropy"), F.count_if(F.col("m") > 0.01).alias("n_effective"))
    t = rows.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(used))
    return t.select(
        (F.col("sse") / F.col("n")).alias("archetypal_loss"), (1 - F.col("sse") / F.greatest("total", F.lit(1e-8))).alias("archetypal_r2"), F.sqrt(F.col("sse") / (F.col("n") * F.col("dims"))).alias("rmse"),
        "usage_entropy", "n_effective",
    )


def generate_synthetic(model, coordinates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coordinates with their weights and reconstruction by a fitted model, ``generation_metrics``)."""
    passed = model.reconstruct(model.transform(coordinates))
    return passed, generation_metrics(passed)


def generate_and_validate(model, cells: DataFrame, n: int, strategy: str = "uniform", held_out: float = 0.3, seed: int = 0) -> dict[str, DataFrame]:
    """Sampled coordinates of the cells that aren't held out, passed through the model and compared with those that are.

    Held out is a random share by the hash of the id: the same for any partitioning.
    """
    marked = cells.withColumn("__h", F.pmod(F.xxhash64("cell_id", F.lit(seed)), F.lit(1_000_000)) < held_out * 1_000_000)
    known, validation = (marked.where(c).drop("__h") for c in (~F.col("__h"), F.col("__h")))
    drawn = N.sample_coordinates(known, n, strategy, seed=seed, archetypes=model.archetypes)
    passed, metrics = generate_synthetic(model, drawn)
    made = passed.select("cell_id", F.col("fitted").alias("vec"))
    return {
        "generated": passed, "metrics": metrics, "components": validate_components(validation, made), "distances": validate_distances(validation, made, model.archetypes),
        "similarity": similarity_summary(nearest_real(made, validation)),
    }
