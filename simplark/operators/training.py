"""The archetypal autoencoder, trained on and applied to all rows.

An epoch is one pass: each task takes Adam steps over its rows from the state that the epoch began
with, and the states that come out are averaged by rows. The same pass holds the rows against the
state it began with, so the best epoch is known without another one. Only the start, an inflated
principal hull, comes from a bounded sample.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.operators import archetypes as A
from simplark.operators.hull import ArchetypeModel
from simplark.operators.model import SAMPLE, Autoencoder, principal_hull, sample_matrix
from simplark.sources import tables
from simplark.sources.shared import cut

#: What a step reports, in the order in which tasks add it up.
METRICS = (
    "loss", "rmse", "kld", "archetypal_loss", "diversity_loss", "regularity_loss", "sparsity_loss", "manifold_loss", "archetype_entropy", "max_archetype_usage", "min_archetype_usage",
    "active_archetypes_per_sample", "mean_archetype_data_distance", "max_archetype_data_distance",
)
#: Epochs without gain before the rate falls, and what it is multiplied with.
PLATEAU, FALL = 10, 0.1
SUMS = "n long, sse double, metrics array<double>, state binary"


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1)


def epoch_sums(rows: DataFrame, model: Autoencoder, epoch: int, batch: int, seed: int, train: bool = True, names: Sequence[str] = METRICS) -> tuple[int, float, np.ndarray, np.ndarray]:
    """(rows, squared error of ``model``, averaged metrics and state after each task's steps): one pass over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def learn(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fixed, own = held.value, copy.deepcopy(held.value)
        own.rng = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()])
        n, sse, sums = 0, 0.0, np.zeros(len(names))
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf)
            sse += float(((fixed.reconstruct(x) - x) ** 2).sum())
            for part in np.array_split(own.rng.permutation(len(x)), max(1, len(x) // batch)) if train else ():
                seen = own.step(x[part])
                sums += len(part) * np.array([seen[m] for m in names])
            n += len(x)
        if n:
            yield pd.DataFrame({"n": [n], "sse": [sse], "metrics": [sums], "state": [(own.flat() * n).tobytes()]})

    def add(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sse, sums, state = 0, 0.0, np.zeros(len(names)), 0.0
        for pdf in batches:
            n, sse = n + int(pdf["n"].sum()), sse + float(pdf["sse"].sum())
            for m, s in zip(pdf["metrics"], pdf["state"], strict=True):
                sums, state = sums + m, state + np.frombuffer(s)
        if n:
            yield pd.DataFrame({"n": [n], "sse": [sse], "metrics": [sums], "state": [state.tobytes()]})

    # As many second tasks as each of them takes states, so neither a task nor the driver holds more than the root of the replicas.
    fan = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    found = next(add([rows.mapInPandas(learn, SUMS).repartition(fan).mapInPandas(add, SUMS).toPandas()]), None)
    held.unpersist()
    if found is None:
        raise ValueError("no cells")
    n = int(found["n"][0])
    return n, float(found["sse"][0]), np.array(found["metrics"][0]) / n, np.frombuffer(found["state"][0]) / n


def moved(before: np.ndarray, after: np.ndarray) -> dict[str, float]:
    """How far an epoch moved the archetypes: mean, largest, variance, and each one."""
    steps = np.linalg.norm(after - before, axis=1)
    return {"drift": float(steps.mean()), "drift_max": float(steps.max()), "drift_variance": float(steps.var()), **{f"drift_archetype_{i}": float(d) for i, d in enumerate(steps, 1)}}


def total_squares(rows: DataFrame) -> float:
    """Squared distances of all values to the mean of their component."""
    by = rows.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg((F.var_pop("x") * F.count("x")).alias("s"))
    return by.agg(F.sum("s")).first()[0] or 0.0


class AutoencoderEstimator(Estimator):
    """Trains an autoencoder with k archetypes on all rows of (cell_id, vec); the state with the smallest error is kept.

    Training stops early after ``patience`` epochs without a gain of ``min_gain`` in the rows' error, and the
    rate falls where ten epochs bring none. Tasks merge into at most ``replicas``; their division of the
    rows is part of the result, as the order of batches is anywhere. ``checkpoint`` is a folder that gets
    each best model so far. ``options`` are the network's (weights of the loss, ``normalise``, ``decoder``).
    """

    def __init__(
        self, k: int = 5, epochs: int = 50, hidden: tuple[int, ...] = (256, 128, 64), batch: int = 128, seed: int = 42, inflation: float = 1.5, rate: float = 1e-3, patience: int | None = None,
        min_gain: float = 1e-6, replicas: int = 1024, sample: int = SAMPLE, checkpoint: str | None = None, **options,
    ):
        super().__init__()
        self.k, self.epochs, self.hidden, self.batch, self.seed, self.inflation, self.rate = k, epochs, tuple(hidden), batch, seed, inflation, rate
        self.patience, self.min_gain, self.replicas, self.sample, self.checkpoint, self.options = patience, min_gain, replicas, sample, checkpoint, options

    def _fit(self, cells: DataFrame) -> AutoencoderModel:
        x = sample_matrix(cells, self.sample, self.seed)
        if not len(x):
            raise ValueError("no cells")
        if not self.k <= x.shape[1] or x.shape[1] < 3:
            raise ValueError("archetypes need at least 3 dimensions and no more archetypes than dimensions")
        start = A.inflate(principal_hull(x, self.k, 50).archetypes.tolist(), self.inflation)
        network = Autoencoder(np.array(start), self.hidden, self.seed, self.rate, **self.options)
        rows = cut(cells.select("vec").coalesce(self.replicas))  # each epoch reads it again
        spread = max(total_squares(rows), 1e-8)
        history: list[dict[str, float]] = []
        best, kept, waited = np.inf, network.flat(), 0
        for epoch in range(self.epochs + 1):
            n, sse, metrics, state = epoch_sums(rows, network, epoch, self.batch, self.seed, epoch < self.epochs)
            error = math.sqrt(sse / (n * x.shape[1]))
            if history:
                history[-1] |= {"eval_rmse": error, "archetype_r2": 1 - sse / spread}
            if error < best - self.min_gain:
                best, kept, waited = error, network.flat(), 0
                if self.checkpoint:
                    AutoencoderModel(network, self.hidden, self.options, history).save(cells.sparkSession, self.checkpoint)
            else:
                waited += 1
                network.rate *= FALL if waited % PLATEAU == 0 else 1
            if epoch == self.epochs or self.patience and waited >= self.patience:
                break
            before = network.effective().copy()
            network.restore(state)
            history.append({"epoch": epoch, **{m: float(v) for m, v in zip(METRICS, metrics, strict=True)}, **moved(before, network.effective()), "rate": network.rate})
        network.restore(kept)
        return AutoencoderModel(network, self.hidden, self.options, history)


class AutoencoderModel(ArchetypeModel):
    """A trained network; adds w, latent and log_var to every row, in Arrow batches with the network broadcast."""

    def __init__(self, network: Autoencoder, hidden: tuple[int, ...], options: dict, history: list[dict[str, float]] | None = None):
        super().__init__(network.effective().tolist())
        self.network, self.hidden, self.options, self.history = network, tuple(hidden), dict(options), [dict(h) for h in history or []]

    def _transform(self, cells: DataFrame) -> DataFrame:
        held = cells.sparkSession.sparkContext.broadcast(self.network)

        @F.pandas_udf("w array<double>, latent array<double>, log_var array<double>")
        def encode(vec: pd.Series) -> pd.DataFrame:
            net = held.value
            x = np.array(vec.tolist(), float).reshape(len(vec), -1)
            _, mu, log_var = net.encode(x)
            return pd.DataFrame({"w": list(net.softmax(mu)), "latent": list(mu), "log_var": list(log_var)})

        own = "__" + "_".join(cells.columns)  # longer than any column's name
        kept = [c for c in cells.columns if c not in ("w", "latent", "log_var")]
        return cells.select(*kept, encode("vec").alias(own)).select(*kept, f"`{own}`.w", f"`{own}`.latent", f"`{own}`.log_var")

    def projected(self, dims: int, loadings: list[list[float]] | None = None, centre: list[float] | None = None) -> list[list[float]]:
        """The archetypes among ``dims`` components: by loadings (features x components) where given, else their first ones."""
        y = np.array(self.archetypes)
        return ((y - np.array(centre)) @ np.array(loadings)[:, :dims] if loadings is not None else y[:, :dims]).tolist()

    def history_table(self, spark: SparkSession) -> DataFrame:
        """epoch, metric, value."""
        return spark.createDataFrame([(int(h["epoch"]), m, float(v)) for h in self.history for m, v in h.items() if m != "epoch"], "epoch int, metric string, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        shape = {"hidden": list(self.hidden), "options": self.options, "k": len(self.network.y), "dims": self.network.y.shape[1], "rate": self.network.rate, "history": self.history}
        tables.save_model(spark, path, shape, {"state": self.network.flat().tolist(), "archetypes": self.archetypes})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AutoencoderModel:
        shape, arrays = tables.load_model(spark, path)
        network = Autoencoder(np.zeros((shape["k"], shape["dims"])), tuple(shape["hidden"]), rate=shape["rate"], **shape["options"])
        network.restore(np.array(arrays["state"]))
        return cls(network, shape["hidden"], shape["options"], shape["history"])
