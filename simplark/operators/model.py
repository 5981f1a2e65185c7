"""The parts of models that work on matrices: the hull of a sample, weights of rows, the autoencoder's network.

What runs them over all rows is in ``hull`` and ``training``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplark.functions import vectors as V
from simplark.operators import archetypes as A
from simplark.sources import tables

SAMPLE = 1000


def sample_matrix(cells: DataFrame, rows: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hash of their id: the same for any partitioning."""
    picked = cells.select("vec", F.xxhash64("cell_id", F.lit(seed)).alias("h")).orderBy("h").limit(rows).toPandas()
    return np.array(picked["vec"].tolist(), float)


def furthest_sum(x: np.ndarray, k: int, start: int = 0, swaps: int = 10) -> list[int]:
    """k rows: each time the one with the largest summed distance to those taken; then each is reconsidered ``swaps`` times."""
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0)) if len(x) <= 2000 else None
    far = (lambda i: d[i]) if d is not None else (lambda i: np.sqrt(((x - x[i]) ** 2).sum(1)))
    taken, sums = [start], far(start).copy()
    for step in range(k - 1 + swaps):
        if len(taken) == k:
            old = taken.pop(0)
            sums -= far(old)
        masked = sums.copy()
        masked[taken] = -np.inf
        new = int(masked.argmax())
        taken.append(new)
        sums += far(new)
    return taken


def project_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex to each column."""
    u = -np.sort(-v, axis=0)
    over = np.cumsum(u, axis=0) - 1
    k = np.arange(1, len(v) + 1)[:, None]
    last = (u - over / k > 0).sum(0)
    theta = over[last - 1, np.arange(v.shape[1])] / last
    return np.maximum(v - theta, 0)


@dataclass
class Hull:
    archetypes: np.ndarray
    weights: np.ndarray
    r2: float
    history: list[float]


def principal_hull(x: np.ndarray, k: int, iterations: int = 500, tolerance: float = 1e-6, inner: int = 10, start: int = 0) -> Hull:
    """Archetypes C X and weights S on the simplex that bring S C X closest to X, by projected gradient steps.

    Steps grow by a fifth when they help and halve when they don't. Archetypes come in order of use.
    """
    xt = x.T
    k = min(k, len(x))
    c = np.zeros((len(x), k))
    c[furthest_sum(x, k, start), np.arange(k)] = 1
    total = (x**2).sum() or 1.0
    y = xt @ c
    s = project_simplex(np.linalg.lstsq(y, xt, rcond=None)[0])
    gram = xt.T @ xt if len(x) <= 3000 else None
    rate_s = rate_c = 1.0
    history = [((xt - y @ s) ** 2).sum()]
    for _ in range(iterations):
        for _ in range(inner):
            g = (y.T @ y @ s - y.T @ xt) / (total / len(x))
            best = history[-1]
            for _ in range(20):
                new = project_simplex(s - rate_s * g)
                sse = ((xt - y @ new) ** 2).sum()
                if sse <= best * (1 + 1e-9):
                    s, rate_s = new, rate_s * 1.2
                    history[-1] = sse
                    break
                rate_s /= 2
        for _ in range(inner):
            ss = s @ s.T
            g = (gram @ c @ ss - gram @ s.T if gram is not None else x @ (xt @ c @ ss - xt @ s.T)) / total
            best = history[-1]
            for _ in range(20):
                new = project_simplex(c - rate_c * g)
                sse = ((xt - xt @ new @ s) ** 2).sum()
                if sse <= best * (1 + 1e-9):
                    c, rate_c = new, rate_c * 1.2
                    history[-1] = sse
                    break
                rate_c /= 2
            y = xt @ c
        now = history[-1]
        if len(history) > 1 and abs(history[-2] - now) < tolerance * max(abs(history[-2]), 1e-12) or 1 - now / total >= 0.9999:
            break
        history.append(now)
    order = np.argsort(-s.sum(1))
    spread = ((x - x.mean(0)) ** 2).sum()
    return Hull(y.T[order], s.T[:, order], float(1 - history[-1] / max(spread, 1e-8)), history)


def simplex_weights(x: np.ndarray, archetypes: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For each row the convex weights that bring the archetypes closest to it (accelerated projected gradient)."""
    y = archetypes.T
    gram = y.T @ y
    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    s = np.full((len(archetypes), len(x)), 1 / len(archetypes))
    z, t, right = s, 1.0, y.T @ x.T
    for _ in range(rounds):
        new = project_simplex(z - step * (gram @ z - right))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, t = new + (t - 1) / t2 * (new - s), t2
        if np.abs(new - s).max(initial=0) < 1e-8:
            s = new
            break
        s = new
    return s.T


# -- the autoencoder's network; ``training`` fits it to all rows


@dataclass
class Layer:
    w: np.ndarray
    b: np.ndarray


@dataclass
class Norm:
    """A batch normalisation: trained scale and shift, running mean and variance."""

    gain: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    var: np.ndarray


def leaky(h: np.ndarray) -> np.ndarray:
    return np.where(h > 0, h, 0.01 * h)


class Autoencoder:
    """An archetypal autoencoder: vector -> hidden layers -> softmax weights -> weighted archetypes.

    Trained by Adam: reconstruction .9, divergence of the latent Gaussian .1, a penalty on archetypes
    that lie close together, and by choice on uneven use (``regularity``), on the weights' sum of z log z
    (``sparsity``) and on archetypes far from the batch (``manifold``). ``normalise`` puts a batch
    normalisation behind each hidden layer, ``decoder`` a two-layer map before the archetypes' use.
    Scoring uses the mean and running moments, so it is a function of the row alone.
    """

    def __init__(
        self, archetypes: np.ndarray, hidden: tuple[int, ...] = (64, 32), seed: int = 0, rate: float = 1e-3, diversity: float = 0.05, regularity: float = 0.0, sparsity: float = 0.0,
        manifold: float = 0.0, normalise: bool = False, decoder: bool = False,
    ):
        rng = np.random.default_rng(seed)
        sizes = [archetypes.shape[1], *hidden]
        self.layers = [Layer(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
        k, d = archetypes.shape
        self.mu, self.logvar = Layer(rng.normal(0, 0.1, (sizes[-1], k)), np.zeros(k)), Layer(rng.normal(0, 0.01, (sizes[-1], k)), np.full(k, -4.0))
        self.y, self.rate, self.rng = archetypes.copy(), rate, rng
        self.diversity, self.regularity, self.sparsity, self.manifold = diversity, regularity, sparsity, manifold
        self.norms = [Norm(np.ones(b), np.zeros(b), np.zeros(b), np.ones(b)) for b in hidden] if normalise else []
        self.decoder = [Layer(rng.normal(0, d**-0.5, (d, d)), np.zeros(d)) for _ in range(2)] if decoder else []
        self.m, self.v = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        self.t = 0.0

    def parameters(self) -> list[np.ndarray]:
        maps = [p for l in [*self.layers, self.mu, self.logvar] for p in (l.w, l.b)]
        return [*maps, self.y, *[p for n in self.norms for p in (n.gain, n.shift)], *[p for l in self.decoder for p in (l.w, l.b)]]

    def state(self) -> list[np.ndarray]:
        """All that training changes, but for the number of steps: parameters, running moments, Adam's moments."""
        return [*self.parameters(), *[p for n in self.norms for p in (n.mean, n.var)], *self.m, *self.v]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.state()] + [np.array([self.t])])

    def restore(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.state():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.t = float(flat[at])

    def effective(self) -> np.ndarray:
        """The archetypes as rows are rebuilt from them."""
        if not self.decoder:
            return self.y
        first, second = self.decoder
        return leaky(self.y @ first.w + first.b) @ second.w + second.b

    def encode(self, x: np.ndarray, held: list | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(layers' outputs, mean, log variance); with ``held`` as in training: batch moments, kept there for the way back."""
        acts = [x]
        for i, l in enumerate(self.layers):
            h = acts[-1] @ l.w + l.b
            if self.norms:
                norm = self.norms[i]
                if held is not None and len(x) > 1:
                    mean, var = h.mean(0), h.var(0)
                    norm.mean += 0.1 * (mean - norm.mean)
                    norm.var += 0.1 * (var * len(x) / (len(x) - 1) - norm.var)
                else:
                    mean, var = norm.mean, norm.var
                sd = np.sqrt(var + 1e-5)
                h = (h - mean) / sd
                if held is not None:
                    held.append((h, sd))
                h = h * norm.gain + norm.shift
            acts.append(leaky(h))
        return acts, acts[-1] @ self.mu.w + self.mu.b, np.minimum(acts[-1] @ self.logvar.w + self.logvar.b, 2.0)

    @staticmethod
    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def weights(self, x: np.ndarray) -> np.ndarray:
        return self.softmax(self.encode(x)[1])

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        return self.weights(x) @ self.effective()

    def near_data(self, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(penalty on archetypes off the batch, its gradient, distance of each to the nearest of 200 rows).

        The squared distance to the nearest row, half of what lies outside the batch's box widened by a
        tenth, and a tenth of the squared shortfall of rows within 1.5 median distances below 5 %.
        """
        some, k = x[:200], len(self.y)
        d = np.sqrt(((some[:, None] - self.y[None]) ** 2).sum(2))
        low, high = x.min(0), x.max(0)
        low, high = low - 0.1 * (high - low), high + 0.1 * (high - low)
        under, over = np.maximum(low - self.y, 0), np.maximum(self.y - high, 0)
        short = 0.0
        if len(some) > 50:
            middle = np.sort(d, axis=0)[(len(some) - 1) // 2]
            short = (np.maximum(max(1, len(some) * 0.05) - (d < 1.5 * middle).sum(0), 0) ** 2).sum()
        loss = (d.min(0) ** 2).sum() + 0.5 * (under.sum() + over.sum()) + 0.1 * short
        grad = 2 * (self.y - some[d.argmin(0)]) + 0.5 * ((over > 0).astype(float) - (under > 0))
        return float(loss / k), grad / k, d.min(0)

    def step(self, x: np.ndarray, report: bool = True) -> dict[str, float]:
        """One step of Adam; the loss and, with ``report``, all other metrics of the batch."""
        held: list = []
        acts, mu, logvar = self.encode(x, held)
        eps = self.rng.normal(size=mu.shape)
        sd = np.exp(logvar / 2)
        a = self.softmax(mu + sd * eps)
        used = self.effective()
        err = a @ used - x
        n, k, rows = x.size, len(self.y), len(x)
        loss, kl = (err**2).sum() / n, -0.5 * (1 + logvar - mu**2 - np.exp(logvar)).sum(1).mean()
        d_out = 0.9 * 2 * err / n
        gap = self.y[:, None] - self.y[None]
        dist = np.sqrt((gap**2).sum(2)) + 1e-9
        near = np.exp(-dist) * (1 - np.eye(k))
        pairs = max(1, k * (k - 1))
        usage = a.mean(0)
        soft = self.softmax(usage[None])[0]
        regular = float(-np.log(k) - np.log(soft).mean()) / k
        sparse = float((a * np.log(a + 1e-8)).mean())
        off, d_off, far = self.near_data(x) if report or self.manifold else (0.0, 0.0, None)
        g_used, g_decoder = a.T @ d_out, []
        if self.decoder:
            first, second = self.decoder
            h = self.y @ first.w + first.b
            back = g_used @ second.w.T * np.where(h > 0, 1, 0.01)
            g_decoder = [self.y.T @ back, back.sum(0), leaky(h).T @ g_used, g_used.sum(0)]
            g_used = back @ first.w.T
        gy = g_used - self.diversity * ((near / dist)[:, :, None] * gap).sum(1) * 2 / pairs + self.manifold * d_off
        da = d_out @ used.T + self.regularity * (soft - 1 / k) / (k * rows) + self.sparsity * (np.log(a + 1e-8) + a / (a + 1e-8)) / a.size
        dz = a * (da - (a * da).sum(1, keepdims=True))
        dmu = dz + 0.1 * mu / rows
        dlog = (dz * eps * sd / 2 + 0.1 * 0.5 * (np.exp(logvar) - 1) / rows) * (logvar < 2.0)
        grads, g_norms = [], []
        back = dmu @ self.mu.w.T + dlog @ self.logvar.w.T
        heads = [acts[-1].T @ dmu, dmu.sum(0), acts[-1].T @ dlog, dlog.sum(0)]
        for i in range(len(self.layers) - 1, -1, -1):
            back = back * np.where(acts[i + 1] > 0, 1, 0.01)
            if self.norms:
                h, spread = held[i]
                g_norms[:0] = [(back * h).sum(0), back.sum(0)]
                back = back * self.norms[i].gain
                back = (back - back.mean(0) - h * (back * h).mean(0)) / spread if rows > 1 else back / spread
            grads[:0] = [acts[i].T @ back, back.sum(0)]
            back = back @ self.layers[i].w.T
        self.adam([*grads, *heads, gy, *g_norms, *g_decoder])
        total = 0.9 * loss + 0.1 * kl + self.diversity * near.sum() / pairs + self.regularity * regular + self.sparsity * sparse + self.manifold * off
        if not report:
            return {"loss": float(total)}
        return {
            "loss": float(total), "rmse": float(loss**0.5), "kld": float(kl), "archetypal_loss": float(loss), "diversity_loss": float(near.sum() / pairs), "regularity_loss": regular, "sparsity_loss": sparse,
            "manifold_loss": off, "archetype_entropy": float(-(usage * np.log(usage + 1e-8)).sum()), "max_archetype_usage": float(usage.max()), "min_archetype_usage": float(usage.min()),
            "active_archetypes_per_sample": float((a > 0.01).sum(1).mean()), "mean_archetype_data_distance": float(far.mean()), "max_archetype_data_distance": float(far.max()),
        }

    def adam(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parameters(), grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def r2(x: np.ndarray, fitted: np.ndarray) -> float:
    return float(1 - ((x - fitted) ** 2).sum() / max(((x - x.mean(0)) ** 2).sum(), 1e-8))


def train_autoencoder(x: np.ndarray, k: int, epochs: int = 50, hidden: tuple[int, ...] = (64, 32), batch: int = 128, seed: int = 0, inflation: float = 1.5, patience: int | None = None, rate: float = 3e-3) -> tuple[Autoencoder, list[dict[str, float]]]:
    """A model begun from an inflated principal hull, and a row of metrics for each epoch; stops early after ``patience`` epochs without gain."""
    start = A.inflate(principal_hull(x, k, 50).archetypes.tolist(), inflation)
    model = Autoencoder(np.array(start), hidden, seed, rate)
    rng, history, best, waited = np.random.default_rng(seed), [], np.inf, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        before = model.y.copy()
        steps = [model.step(x[order[i : i + batch]]) for i in range(0, len(x), batch)]
        row = {m: float(np.mean([s[m] for s in steps])) for m in steps[0]}
        row |= {"epoch": epoch, "archetype_r2": r2(x, model.reconstruct(x)), "drift": float(np.linalg.norm(model.y - before, axis=1).mean())}
        history.append(row)
        waited = 0 if row["loss"] < best - 1e-5 else waited + 1
        best = min(best, row["loss"])
        if patience and waited >= patience:
            break
    return model, history
