"""A plain variational autoencoder, trained on and applied to all rows in the passes of ``training``."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.operators.model import Layer, Norm, leaky
from simplark.operators.training import epoch_sums
from simplark.sources import tables
from simplark.sources.shared import cut

METRICS = ("loss", "reconstruction_loss", "kld", "rmse", "elbo")
#: What a normalisation adds to variances, and how fast its running moments follow.
EPSILON, PACE = 1e-5, 0.1


@dataclass
class Block:
    """A linear map; with ``norm``, batch normalisation and a leaky ramp behind it."""

    layer: Layer
    norm: Norm | None = None

    def parameters(self) -> list[np.ndarray]:
        return [self.layer.w, self.layer.b, *([self.norm.gain, self.norm.shift] if self.norm else [])]

    def forward(self, x: np.ndarray, held: list | None = None) -> np.ndarray:
        """With ``held`` as in training: moments of the batch, kept there for the way back."""
        h, norm = x @ self.layer.w + self.layer.b, self.norm
        if norm is None:
            if held is not None:
                held.append((x, None, None, None))
            return h
        batch = held is not None and len(x) > 1
        mean, var = (h.mean(0), h.var(0)) if batch else (norm.mean, norm.var)
        if batch:
            norm.mean += PACE * (mean - norm.mean)
            norm.var += PACE * (var * len(x) / (len(x) - 1) - norm.var)
        sd = np.sqrt(var + EPSILON)
        z = (h - mean) / sd
        out = z * norm.gain + norm.shift
        if held is not None:
            held.append((x, z, sd, out))
        return leaky(out)

    def backward(self, kept: tuple, back: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(the gradient before the block, those of its parameters)."""
        x, z, sd, out = kept
        grads = []
        if self.norm is not None:
            back = back * np.where(out > 0, 1, 0.01)
            grads = [(back * z).sum(0), back.sum(0)]
            back = back * self.norm.gain
            back = (back - back.mean(0) - z * (back * z).mean(0)) / sd if len(x) > 1 else back / sd
        return back @ self.layer.w.T, [x.T @ back, back.sum(0), *grads]


class VariationalNetwork:
    """Vector -> hidden blocks -> mean and log variance of a latent Gaussian -> mirrored blocks -> vector.

    The loss is the mean squared error plus ``kld_weight`` times the mean divergence from the standard
    Gaussian. Scoring decodes the mean with running moments, so it is a function of the row alone.
    """

    def __init__(self, dims: int, latent: int, hidden: tuple[int, ...] = (128, 64, 32), seed: int = 0, rate: float = 1e-3, kld_weight: float = 1.0):
        self.rng, self.rate, self.kld_weight, self.t = np.random.default_rng(seed), rate, kld_weight, 0.0

        def block(a: int, b: int, normalised: bool = True) -> Block:
            layer = Layer(self.rng.normal(0, (2 / a) ** 0.5 if normalised else a**-0.5, (a, b)), np.zeros(b))
            return Block(layer, Norm(np.ones(b), np.zeros(b), np.zeros(b), np.ones(b)) if normalised else None)

        sizes = [dims, *hidden]
        self.encoder = [block(a, b) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.mu, self.log_var = block(sizes[-1], latent, False), block(sizes[-1], latent, False)
        mirrored = hidden[::-1]
        self.decoder = [block(latent, mirrored[0], False), *[block(a, b) for a, b in zip(mirrored, mirrored[1:], strict=False)], block(mirrored[-1], dims, False)]
        self.m, self.v = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))

    def blocks(self) -> list[Block]:
        return [*self.encoder, self.mu, self.log_var, *self.decoder]

    def parameters(self) -> list[np.ndarray]:
        return [p for b in self.blocks() for p in b.parameters()]

    def state(self) -> list[np.ndarray]:
        return [*self.parameters(), *[p for b in self.blocks() if b.norm for p in (b.norm.mean, b.norm.var)], *self.m, *self.v]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.state()] + [np.array([self.t])])

    def restore(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.state():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.t = float(flat[at])

    def encode(self, x: np.ndarray, held: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        for b in self.encoder:
            x = b.forward(x, held)
        return self.mu.forward(x, held), self.log_var.forward(x, held)

    def decode(self, z: np.ndarray, held: list | None = None) -> np.ndarray:
        for b in self.decoder:
            z = b.forward(z, held)
        return z

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return self.decode(self.encode(x)[0])

    def gradients(self, x: np.ndarray, noise: np.ndarray) -> tuple[dict[str, float], list[np.ndarray]]:
        held: list = []
        mu, log_var = self.encode(x, held)
        sd = np.exp(log_var / 2)
        err = self.decode(mu + sd * noise, held) - x
        rows = len(x)
        loss, kld = (err**2).mean(), float(-0.5 * (1 + log_var - mu**2 - np.exp(log_var)).sum(1).mean())
        back, grads, n = 2 * err / err.size, [], len(self.encoder)
        for b, kept in zip(self.decoder[::-1], held[: n + 1 : -1], strict=True):
            back, found = b.backward(kept, back)
            grads[:0] = found
        d_mu = back + self.kld_weight * mu / rows
        d_log = back * noise * sd / 2 + self.kld_weight * 0.5 * (np.exp(log_var) - 1) / rows
        by_mu, g_mu = self.mu.backward(held[n], d_mu)
        by_log, g_log = self.log_var.backward(held[n + 1], d_log)
        back, grads = by_mu + by_log, [*g_mu, *g_log, *grads]
        for b, kept in zip(self.encoder[::-1], held[:n][::-1], strict=True):
            back, found = b.backward(kept, back)
            grads[:0] = found
        metrics = {"loss": loss + self.kld_weight * kld, "reconstruction_loss": loss, "kld": kld, "rmse": loss**0.5, "elbo": -(err**2).sum() / rows - self.kld_weight * kld}
        return {k: float(v) for k, v in metrics.items()}, grads

    def step(self, x: np.ndarray) -> dict[str, float]:
        seen, grads = self.gradients(x, self.rng.normal(size=(len(x), len(self.mu.layer.b))))
        self.t += 1
        for p, g, m, v in zip(self.parameters(), grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
        return seen


class VariationalEstimator(Estimator):
    """Trains a network on all rows of (cell_id, vec) and keeps the state with the smallest error; vectors have one length."""

    def __init__(self, latent: int = 5, hidden: tuple[int, ...] = (128, 64, 32), epochs: int = 50, batch: int = 128, seed: int = 42, rate: float = 1e-3, kld_weight: float = 1.0, patience: int | None = None, replicas: int = 1024):
        super().__init__()
        if latent < 1 or not hidden:
            raise ValueError("a variational autoencoder needs a latent dimension and a hidden layer")
        self.latent, self.hidden, self.epochs, self.batch, self.seed, self.rate, self.kld_weight, self.patience, self.replicas = latent, tuple(hidden), epochs, batch, seed, rate, kld_weight, patience, replicas

    def _fit(self, cells: DataFrame) -> VariationalModel:
        rows = cut(cells.select("vec").coalesce(self.replicas))  # each epoch reads it again
        first = rows.first()
        if first is None:
            raise ValueError("no cells")
        network = VariationalNetwork(len(first.vec), self.latent, self.hidden, self.seed, self.rate, self.kld_weight)
        history: list[dict[str, float]] = []
        best, kept, waited = math.inf, network.flat(), 0
        for epoch in range(self.epochs + 1):
            n, sse, metrics, state = epoch_sums(rows, network, epoch, self.batch, self.seed, epoch < self.epochs, METRICS)
            error = math.sqrt(sse / (n * len(first.vec)))
            if history:
                history[-1]["eval_rmse"] = error
            waited = 0 if error < best - 1e-6 else waited + 1
            if not waited:
                best, kept = error, network.flat()
            if epoch == self.epochs or self.patience and waited >= self.patience:
                break
            network.restore(state)
            history.append({"epoch": epoch, **{m: float(v) for m, v in zip(METRICS, metrics, strict=True)}})
        network.restore(kept)
        return VariationalModel(network, history)


class VariationalModel(Model):
    """A trained network; adds latent, log_var, fitted and error (rmse of the row) to every row, in Arrow batches with the network broadcast."""

    def __init__(self, network: VariationalNetwork, history: list[dict[str, float]] | None = None):
        super().__init__()
        self.network, self.history = network, list(history or [])

    def _transform(self, cells: DataFrame) -> DataFrame:
        held = cells.sparkSession.sparkContext.broadcast(self.network)

        @F.pandas_udf("latent array<double>, log_var array<double>, fitted array<double>, error double")
        def encode(vec: pd.Series) -> pd.DataFrame:
            x = np.array(vec.tolist(), float).reshape(len(vec), -1)
            mu, log_var = held.value.encode(x)
            fitted = held.value.decode(mu)
            return pd.DataFrame({"latent": list(mu), "log_var": list(log_var), "fitted": list(fitted), "error": np.sqrt(((fitted - x) ** 2).mean(1))})

        own, new = "__" + "_".join(cells.columns), ("latent", "log_var", "fitted", "error")
        kept = [c for c in cells.columns if c not in new]
        return cells.select(*kept, encode("vec").alias(own)).select(*kept, *[f"`{own}`.{c}" for c in new])

    def history_table(self, spark: SparkSession) -> DataFrame:
        """epoch, metric, value."""
        return spark.createDataFrame([(int(h["epoch"]), m, float(v)) for h in self.history for m, v in h.items() if m != "epoch"], "epoch int, metric string, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        net = self.network
        shape = {"dims": len(net.decoder[-1].layer.b), "latent": len(net.mu.layer.b), "hidden": [len(b.layer.b) for b in net.encoder], "rate": net.rate, "kld_weight": net.kld_weight, "history": self.history}
        tables.save_model(spark, path, shape, {"state": net.flat().tolist()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VariationalModel:
        shape, arrays = tables.load_model(spark, path)
        network = VariationalNetwork(shape["dims"], shape["latent"], tuple(shape["hidden"]), 0, shape["rate"], shape["kld_weight"])
        network.restore(np.array(arrays["state"]))
        return cls(network, shape["history"])
