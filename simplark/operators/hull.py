"""The principal convex hull of all rows: archetypes as sparse convex combinations of cells.

The fit brings S C X close to X: each row of S mixes archetypes, each row of C mixes cells. A round is
one pass over the cells, in Arrow batches. With the archetypes Y given, each task finds its rows' weights
and adds up S'S, S'X, the error and the use of each archetype (k x k and k x d numbers, whatever the
rows). With these sums f(Y) = tr(Y' S'S Y) - 2 tr(Y' S'X) is all that is left of the error. Its gradient at each
archetype is a direction, and in the next pass each task also returns its one cell furthest along it (a
Frank-Wolfe vertex).

The driver keeps the cells that archetypes are made of, some dozens, adds the new ones, and moves each
archetype to the best point of the hull of its own (fully corrective steps), or beyond it towards where it is
going as long as that lowers the error; cells that get no share leave. So C
is sparse, nothing is n x n, and no row is left out: a corner that a single row holds is found. With
``delta`` an archetype may lie off the hull by a factor between 1 - delta and 1 + delta.

Defined cases: cells without a vector are left out; fewer cells than archetypes give as many
archetypes as there are cells; ties go to the smaller cell_id; an archetype that no row uses starts again
from the row with the largest error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.functions import vectors as V
from simplark.operators import archetypes as A
from simplark.operators.model import principal_hull, sample_matrix, simplex_weights
from simplark.sources import tables
from simplark.sources.shared import cut

#: Rows that a task works on at a time.
ROWS = 8192
#: What tasks return: sums by place, or the best cell of a kind with its value.
FOUND = "place int, value double, cell_id long, vec array<double>"


@dataclass
class Member:
    """A cell that an archetype is made of."""

    vec: np.ndarray
    share: float


@dataclass
class HullFit:
    archetypes: np.ndarray
    members: list[dict[int, Member]]
    scale: np.ndarray
    usage: np.ndarray
    r2: float
    history: list[float] = field(default_factory=list)

    def composition(self, spark: SparkSession) -> DataFrame:
        """archetype_idx, cell_id, coefficient: the entries of C that aren't zero."""
        rows = [(j, cell, float(m.share * self.scale[j])) for j, own in enumerate(self.members) for cell, m in own.items()]
        return spark.createDataFrame(rows, "archetype_idx int, cell_id long, coefficient double")


def composition_report(composition: DataFrame, tolerance: float = 1e-3, delta: float = 0.0) -> DataFrame:
    """archetype_idx, n_cells, total, smallest, violated: the sum of each archetype's coefficients, which may be off one by delta, and the smallest."""
    t = composition.groupBy("archetype_idx").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("coefficient").alias("total"), F.min("coefficient").alias("smallest"))
    return t.withColumn("violated", (F.abs(F.col("total") - 1) > delta + tolerance) | (F.col("smallest") < -tolerance))


def matrices(batches):
    """(ids, rows) of batches of (cell_id, vec), a stretch at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)


def found(places, values, ids=None, vectors=None) -> pa.RecordBatch:
    n = len(places)
    return pa.RecordBatch.from_arrays(
        [pa.array(places, pa.int32()), pa.array(values, pa.float64()), pa.array(ids if ids is not None else [None] * n, pa.int64()), pa.array(vectors if vectors is not None else [None] * n, pa.list_(pa.float64()))],
        names=["place", "value", "cell_id", "vec"],
    )


def passed(y: np.ndarray, directions: np.ndarray | None):
    """Of a task's rows: S'S, S'X, the weights' sum, the error and the number, one number a place; the row with the
    largest error (place -1); and for each direction the row with the smallest product (places from -2 down).
    """
    k, d = y.shape
    directions = np.zeros((0, d)) if directions is None else directions

    def run(batches):
        total = np.zeros(k * k + k * d + k + 2)
        best: list[tuple] = [(-np.inf, None, None)] * (1 + len(directions))
        for ids, x in matrices(batches):
            s = simplex_weights(x, y)
            error = ((x - s @ y) ** 2).sum(1)
            total += np.concatenate(((s.T @ s).ravel(), (s.T @ x).ravel(), s.sum(0), [error.sum(), len(x)]))
            for j, score in enumerate((error, *(-(x @ directions.T)).T)):
                at = int(np.lexsort((ids, -score))[0])
                if score[at] > best[j][0]:
                    best[j] = float(score[at]), int(ids[at]), x[at].tolist()
        yield found(np.arange(len(total)), total)
        rows = [(-1 - j, *b) for j, b in enumerate(best) if b[1] is not None]
        if rows:
            yield found(*zip(*rows, strict=True))

    return run


def gathered(rows: DataFrame, run) -> tuple[dict[int, float], dict[int, tuple[int, np.ndarray]]]:
    """(sums by place, best cell by place) over all tasks."""
    out = rows.mapInArrow(run, FOUND).groupBy("place").agg(F.sum("value").alias("total"), F.max_by(F.struct("cell_id", "vec"), F.struct("value", -F.col("cell_id"))).alias("best")).collect()
    return {r.place: r.total for r in out}, {r.place: (r.best.cell_id, np.array(r.best.vec)) for r in out if r.best.cell_id is not None}


def corrected(y: np.ndarray, scale: np.ndarray, members: list[dict[int, Member]], ss: np.ndarray, sx: np.ndarray, delta: float, reach: float = 1.0, sweeps: int = 8) -> None:
    """Move each archetype to the best point of the hull of its members, the others held, a few times round; in place.

    ``reach`` over one aims as much further than that point.
    """
    started = y.copy()
    for _ in range(sweeps):
        before = y.copy()
        for j, own in enumerate(members):
            if ss[j, j] <= 1e-12:
                continue
            target = (sx[j] - ss[j] @ y + ss[j, j] * y[j]) / ss[j, j]
            points = np.array([m.vec for m in own.values()])
            # Weights are found around the members' mean: the products there are as exact as the hull is wide.
            middle = points.mean(0)
            share = simplex_weights((target / scale[j] - middle)[None], points - middle, 2000)[0]
            flat = share @ points
            if delta and (norm := flat @ flat) > 0:
                scale[j] = np.clip(flat @ target / norm, 1 - delta, 1 + delta)
            for m, w in zip(own.values(), share, strict=True):
                m.share = float(w)
            y[j] = scale[j] * flat
        if np.abs(y - before).max() <= 1e-10 * max(1.0, np.abs(y).max()):
            break
    if reach > 1:
        aims = started + reach * (y - started)
        for j, own in enumerate(members):
            points = np.array([m.vec for m in own.values()])
            middle = points.mean(0)
            share = simplex_weights((aims[j] / scale[j] - middle)[None], points - middle, 2000)[0]
            for m, w in zip(own.values(), share, strict=True):
                m.share = float(w)
            y[j] = scale[j] * (share @ points)
    for own in members:
        for cell in [c for c, m in own.items() if m.share < 1e-9]:
            del own[cell]
        total = sum(m.share for m in own.values())
        for m in own.values():
            m.share /= total


def fit_hull(cells: DataFrame, k: int, iterations: int = 60, tolerance: float = 1e-5, delta: float = 0.0, target: float = 0.9999) -> HullFit:
    """The principal hull of (cell_id, vec), begun from the cells furthest from each other; stops when the error falls by less than ``tolerance`` of itself, or r2 reaches ``target``."""
    rows = cut(cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL"))
    n = rows.count()
    if not n:
        raise ValueError("no cells")
    k = min(k, n)
    starts = A.furthest_cells(rows, k)
    members = [{cell: Member(np.array(vec), 1.0)} for cell, vec in starts]
    y, scale = np.array([vec for _, vec in starts]), np.ones(k)
    d = y.shape[1]
    mean = np.array([r.m for r in rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()])  # one for each dimension
    spread = rows.agg(F.sum(F.aggregate(F.zip_with("vec", F.lit(mean.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)).alias("s")).first().s
    history: list[float] = []
    best, directions, reach = None, None, 1.0
    for step in range(iterations + 1):
        sums, cell_of = gathered(rows, passed(y, directions))
        total = np.array([sums[i] for i in range(k * k + k * d + k + 2)])
        ss, sx, usage, sse = total[: k * k].reshape(k, k), total[k * k : k * k + k * d].reshape(k, d), total[-k - 2 : -2], total[-2]
        copies = lambda of: [{c: Member(m.vec, m.share) for c, m in own.items()} for own in of]
        fell = history[-1] - sse if history else np.inf
        if fell >= 0:
            best = float(sse), y.copy(), scale.copy(), copies(members), usage, ss, sx
            history.append(float(sse))
            enough = fell < tolerance * max(history[-2], 1e-12) if len(history) > 1 else False
            if step == iterations or enough and reach == 1 or sse <= (1 - target) * spread:
                break
            reach = 1.0 if enough else min(reach * 1.3, 4.0)  # the last word has a plain step
        else:  # too far: back, and a plain step from there
            if step == iterations or reach == 1:
                break
            _, y, scale, members, usage, ss, sx = best
            y, scale, members, reach = y.copy(), scale.copy(), copies(members), 1.0
        # An archetype that nothing uses begins again where the error is largest.
        for j in np.flatnonzero(usage <= 1e-9 * n)[:1].tolist():
            cell, vec = cell_of[-1]
            members[j], y[j], scale[j] = {cell: Member(vec, 1.0)}, vec, 1.0
        for j in range(k):
            if -2 - j in cell_of:
                cell, vec = cell_of[-2 - j]
                members[j].setdefault(cell, Member(vec, 0.0))
        corrected(y, scale, members, ss, sx, delta, reach)
        directions = ss @ y - sx
    sse, y, scale, members, usage = best[:5]
    order = np.argsort(-usage, kind="stable")
    return HullFit(y[order], [members[j] for j in order], scale[order], usage[order], float(1 - sse / max(spread, 1e-8)), history)


class ArchetypeEstimator(Estimator):
    """Finds k archetypes of (cell_id, vec): ``method`` 'pcha', the hull of all rows, or 'furthest'; ``inflation`` moves them outwards.

    ``sample`` fits the hull of so many rows in one process instead; ``delta`` is that of ``fit_hull``.
    """

    def __init__(self, k: int = 5, method: str = "pcha", inflation: float = 1.0, sample: int | None = None, seed: int = 42, iterations: int = 60, delta: float = 0.0):
        super().__init__()
        self.k, self.method, self.inflation, self.sample, self.seed, self.iterations, self.delta = k, method, inflation, sample, seed, iterations, delta

    def _fit(self, cells: DataFrame) -> ArchetypeModel:
        fit = None
        if self.method == "furthest":
            rows = A.furthest_archetypes(cells, self.k)
        elif self.method == "pcha":
            one = cells.select("vec").first()
            if one is None:
                raise ValueError("no cells")
            if not self.k <= len(one.vec) or len(one.vec) < 3:
                raise ValueError("archetypes need at least 3 dimensions and no more archetypes than dimensions")
            if self.sample:
                rows = principal_hull(sample_matrix(cells, self.sample, self.seed), self.k, self.iterations).archetypes.tolist()
            else:
                fit = fit_hull(cells, self.k, self.iterations, delta=self.delta)
                rows = fit.archetypes.tolist()
        else:
            raise ValueError(self.method)
        return ArchetypeModel(A.inflate(rows, self.inflation) if self.inflation != 1 else rows, fit)


class ArchetypeModel(Model):
    """Archetypes; adds w, the convex weights of every row. ``fit`` is how the hull was found, if it was."""

    def __init__(self, archetypes: list[list[float]], fit: HullFit | None = None):
        super().__init__()
        self.archetypes, self.fit_ = archetypes, fit

    def _transform(self, cells: DataFrame) -> DataFrame:
        held = cells.sparkSession.sparkContext.broadcast(np.array(self.archetypes, float))

        @F.pandas_udf("array<double>")
        def weigh(vec: pd.Series) -> pd.Series:
            y = held.value
            x = np.array(vec.tolist(), float)[:, : y.shape[1]]
            return pd.Series(list(simplex_weights(x, y)))

        return cells.withColumn("w", weigh("vec"))

    def reconstruct(self, weighted: DataFrame) -> DataFrame:
        """The rows with fitted, their weighted archetypes."""
        columns = np.array(self.archetypes).T.tolist()
        return weighted.withColumn("fitted", V.affine(F.col("w"), columns, [0.0] * len(columns)))

    def save(self, spark: SparkSession, path: str) -> None:
        tables.save_model(spark, path, {"k": len(self.archetypes)}, {"archetypes": self.archetypes})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ArchetypeModel:
        return cls(tables.load_model(spark, path)[1]["archetypes"])


def inflation_report(cells: DataFrame, archetypes: list[list[float]], factors: tuple[float, ...] = (1.0, 1.2, 1.5, 2.0, 3.0)) -> DataFrame:
    """factor, archetype_r2, arch_loss (squared error a number), outside_data_count, mean, min and max_arch_distance of the archetypes moved outwards by each factor.

    All factors share one pass over the cells for the fit, and one each for the cells' centre and their radius around it.
    """
    spark = cells.sparkSession
    rows = cut(cells.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL"))
    centre = np.array([r.m for r in rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()])  # one for each dimension
    away = F.sqrt(V.squared_distance(F.col("vec"), V.literal(centre.tolist())))
    n, radius, spread = rows.agg(F.count(F.lit(1)), F.max(away), F.sum(away * away)).first()
    moved = [np.array(A.inflate(archetypes, f)) for f in factors]

    def run(batches):
        sse = np.zeros(len(moved))
        for _, x in matrices(batches):
            sse += [((x - simplex_weights(x, y) @ y) ** 2).sum() for y in moved]
        yield found(np.arange(len(moved)), sse)

    sums, _ = gathered(rows, run)
    out = []
    for i, (f, y) in enumerate(zip(factors, moved, strict=True)):
        d = np.sqrt(((y - centre) ** 2).sum(1))
        out.append((float(f), float(1 - sums[i] / max(spread, 1e-8)), float(sums[i] / (n * len(centre))), int((d > radius + 1e-12).sum()), float(d.mean()), float(d.min()), float(d.max())))
    return spark.createDataFrame(out, "factor double, archetype_r2 double, arch_loss double, outside_data_count long, mean_arch_distance double, min_arch_distance double, max_arch_distance double")


def inflation_sweep(cells: DataFrame, archetypes: list[list[float]], factors: tuple[float, ...] = (1.0, 1.2, 1.5, 2.0, 3.0)) -> list[tuple[float, float]]:
    """(factor, r2) of the archetypes moved outwards by each factor."""
    return [(r.factor, r.archetype_r2) for r in inflation_report(cells, archetypes, factors).orderBy("factor").collect()]  # a row each
