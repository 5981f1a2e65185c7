"""Cross-validated search: all configurations and folds are trained in the same passes over all cells."""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplark.operators import archetypes as A
from simplark.operators.model import Autoencoder, principal_hull, sample_matrix
from simplark.sources.shared import cut

#: Epochs and patience of the speed presets.
PRESETS = {"fast": (25, 3), "balanced": (50, 5), "thorough": (100, 8)}


@dataclass
class SearchConfig:
    """Ranges of a search; a preset fills only what isn't set. With ``most_cells``, larger tables are searched on a ``share`` of their cells, at most so many."""

    n_archetypes: tuple[int, ...] = (3, 4, 5, 6)
    hidden_dims: tuple[tuple[int, ...], ...] = ((64, 32),)
    inflation: tuple[float, ...] = (1.5,)
    folds: int = 3
    epochs: int | None = None
    patience: int | None = None
    preset: str = "balanced"
    share: float = 0.5
    most_cells: int | None = None
    seed: int = 42
    batch: int = 128
    rate: float = 3e-3
    replicas: int = 1024

    def __post_init__(self) -> None:
        if not self.n_archetypes or min(self.n_archetypes) < 2 or self.folds < 2 or not 0 < self.share <= 1:
            raise ValueError("a search needs at least 2 archetypes, 2 folds and a share in (0, 1]")
        epochs, patience = PRESETS[self.preset]
        self.epochs, self.patience = self.epochs or epochs, self.patience or patience

    def grid(self) -> list[tuple[int, int, tuple[int, ...], float]]:
        return [(i, *c) for i, c in enumerate(product(self.n_archetypes, self.hidden_dims, self.inflation))]


def folded(cells: DataFrame, config: SearchConfig) -> DataFrame:
    """(cell_id, vec, fold) of the cells that the search uses: all, or those with the smallest hashes of their ids; the id decides the fold."""
    rows = cells.select("cell_id", "vec")
    n = rows.count() if config.most_cells else 0
    if config.most_cells and n > config.most_cells:
        rows = rows.orderBy(F.xxhash64("cell_id", F.lit(config.seed))).limit(min(config.most_cells, max(1, int(n * config.share))))
    return cut(rows.withColumn("fold", F.pmod(F.xxhash64("cell_id", F.lit(config.seed + 1)), F.lit(config.folds)).cast("int")).coalesce(config.replicas))


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of a model's sums: those of several tasks."""
    state = sum(np.frombuffer(s) for s in pdf["state"])
    return pd.DataFrame({"model": pdf["model"].iloc[:1], "part": [0], "n": [pdf["n"].sum()], "loss": [pdf["loss"].sum()], "state": [state.tobytes()]})


def search_epoch(rows: DataFrame, models: dict[int, tuple[int, Autoencoder]], epoch: int, batch: int, seed: int) -> dict[int, tuple[float, np.ndarray]]:
    """{model: (mean loss, averaged state)} after each task stepped every model on its rows outside the model's fold: one pass."""
    held = rows.sparkSession.sparkContext.broadcast(models)
    parts = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def learn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        own = copy.deepcopy(held.value)
        n, loss = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
        for key, (_, net) in own.items():
            net.rng = np.random.default_rng([seed, epoch, at, key])
        for pdf in batches:
            if not len(pdf):
                continue
            x, fold = np.array(pdf["vec"].tolist(), float), pdf["fold"].to_numpy()
            for key, (out, net) in own.items():
                mine = np.flatnonzero(fold != out)
                for some in np.array_split(net.rng.permutation(mine), max(1, len(mine) // batch)) if len(mine) else ():
                    loss[key] += len(some) * net.step(x[some], report=False)["loss"]
                n[key] += len(mine)
        for key, (_, net) in own.items():
            if n[key]:
                yield pd.DataFrame({"model": [key], "part": [at % parts], "n": [n[key]], "loss": [loss[key]], "state": [(net.flat() * n[key]).tobytes()]})

    schema = "model int, part int, n long, loss double, state binary"
    sums = rows.mapInPandas(learn, schema).groupBy("model", "part").applyInPandas(added, schema)
    found = sums.groupBy("model").applyInPandas(added, schema).toPandas()  # a state for each model
    held.unpersist()
    return {int(r.model): (r.loss / r.n, np.frombuffer(r.state) / r.n) for r in found.itertuples()}


def fold_errors(rows: DataFrame, models: dict[int, tuple[int, Autoencoder]]) -> dict[tuple[int, bool], tuple[int, float, float]]:
    """{(model, held out): (values, squared error, absolute error)} of all rows: one pass."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {(key, out): np.zeros(3) for key in held.value for out in (False, True)}
        for pdf in batches:
            if not len(pdf):
                continue
            x, fold = np.array(pdf["vec"].tolist(), float), pdf["fold"].to_numpy()
            for key, (own, net) in held.value.items():
                gap = net.reconstruct(x) - x
                for out in (False, True):
                    some = gap[(fold == own) == out]
                    sums[key, out] += some.size, (some**2).sum(), np.abs(some).sum()
        yield pd.DataFrame([(*k, int(v[0]), v[1], v[2]) for k, v in sums.items()], columns=["model", "out", "n", "sse", "sae"])

    found = rows.mapInPandas(measure, "model int, out boolean, n long, sse double, sae double").groupBy("model", "out").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae")]).collect()
    held.unpersist()
    return {(r.model, r.out): (r.n, r.sse, r.sae) for r in found}


def search(cells: DataFrame, config: SearchConfig) -> DataFrame:
    """config_id, n_archetypes, hidden_dims, inflation, fold, metric, value of (cell_id, vec).

    An epoch is one pass over all cells: each task takes steps of every configuration and fold on its
    rows outside the fold, and the states are averaged by rows for each. A model that waits ``patience`` epochs
    for a smaller loss leaves the passes. One pass at the end holds all models against all cells.
    Models begin with hulls of a bounded sample of their own training cells. Models of folds
    without cells, or without any outside them, have no rows; no cells give an empty table.
    """
    spark = cells.sparkSession
    rows = folded(cells, config)
    spread = {r.fold: r.s for r in rows.select("fold", F.posexplode("vec").alias("pos", "x")).groupBy("fold", "pos").agg((F.var_pop("x") * F.count("x")).alias("s")).groupBy("fold").agg(F.sum("s").alias("s")).collect()}
    models: dict[int, tuple[int, Autoencoder]] = {}
    grid = {}
    for fold in spread if len(spread) > 1 else ():
        x = sample_matrix(rows.where(F.col("fold") != fold), seed=config.seed)
        hulls = {k: principal_hull(x, k, 50).archetypes.tolist() for k in set(config.n_archetypes)}
        for i, k, hidden, inflation in config.grid():
            key = i * config.folds + fold
            grid[key] = (i, k, ",".join(map(str, hidden)), float(inflation), fold)
            models[key] = (fold, Autoencoder(np.array(A.inflate(hulls[k], inflation)), hidden, config.seed, config.rate))
    best, waited, epochs, active = dict.fromkeys(models, math.inf), dict.fromkeys(models, 0), dict.fromkeys(models, 0), dict(models)
    for epoch in range(config.epochs):
        if not active:
            break
        for key, (loss, state) in search_epoch(rows, active, epoch, config.batch, config.seed).items():
            models[key][1].restore(state)
            epochs[key], waited[key] = epoch + 1, 0 if loss < best[key] - 1e-5 else waited[key] + 1
            best[key] = min(best[key], loss)
            if waited[key] >= config.patience:
                del active[key]
    errors = fold_errors(rows, models) if models else {}
    out = []
    for key, row in sorted(grid.items()):
        (n, sse, sae), (m, val_sse, val_sae) = errors[key, False], errors[key, True]
        values = {
            "val_rmse": math.sqrt(val_sse / m), "val_mae": val_sae / m, "archetype_r2": 1 - val_sse / max(spread[row[-1]], 1e-8), "train_rmse": math.sqrt(sse / n), "train_mae": sae / n,
            "train_archetypal_loss": sse / n, "convergence_epoch": float(epochs[key]), "early_stopped": float(key not in active),
        }
        out += [(*row, metric, float(value)) for metric, value in values.items()]
    return spark.createDataFrame(out, "config_id int, n_archetypes int, hidden_dims string, inflation double, fold int, metric string, value double")


def best_folds(folds: DataFrame) -> DataFrame:
    """config_id, fold, r2: the fold with the largest r2 of each configuration."""
    return folds.where("metric = 'archetype_r2'").groupBy("config_id").agg(F.max_by("fold", "value").alias("fold"), F.max("value").alias("r2"))


def report(summary: DataFrame, metric: str = "archetype_r2", top: int = 3) -> str:
    """A few lines on the best configurations, from the fold summary."""
    rows = summary.where(F.col("metric") == metric).orderBy(F.desc("mean")).limit(top).collect()
    return "\n".join([f"best {len(rows)} by {metric}", *(f"{i}. {r.asDict()}" for i, r in enumerate(rows, 1))])
