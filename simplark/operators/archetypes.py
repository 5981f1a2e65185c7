"""Archetypes of a table of vectors: choosing them, distances, bins, centroids, weights.

Cells are rows (cell_id, vec). Archetypes are few (k), so they travel as literals in expressions
and no join or broadcast is needed to compare every cell with each of them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplark.functions import vectors as V
from simplark.operators import order as O
from simplark.sources.shared import cut, small

CENTRAL, NONE, UNASSIGNED = "archetype_0", "no_archetype", "unassigned"


def distances_to(vec: Column, archetypes: Sequence[Sequence[float]]) -> Column:
    """The distances of a vector to all archetypes, as an array; vectors that are wider are cut."""
    dims = len(archetypes[0])
    return F.array(*[V.distance(V.truncate(vec, dims), V.literal(a)) for a in archetypes])


def furthest_archetypes(cells: DataFrame, k: int, start: int | None = None) -> list[list[float]]:
    """k cells: the first by id (or ``start``), then each time the one furthest from those taken."""
    return [vec for _, vec in furthest_cells(cells, k, start)]


def furthest_cells(cells: DataFrame, k: int, start: int | None = None) -> list[tuple[int, list[float]]]:
    """The cells of ``furthest_archetypes`` with their ids; every round is one scan that returns one row."""
    first = cells.where(F.col("cell_id") == start) if start is not None else cells
    row = first.orderBy("cell_id").select("cell_id", "vec").first()
    if row is None:
        raise ValueError("no cells")
    found = [(row.cell_id, list(row.vec))]
    while len(found) < k:
        near = F.array_min(distances_to(F.col("vec"), [vec for _, vec in found]))
        best = cells.agg(F.max_by(F.struct("cell_id", "vec"), F.struct(near, -F.col("cell_id"))).alias("best")).first().best
        found.append((best.cell_id, list(best.vec)))
    return found


def inflate(archetypes: Sequence[Sequence[float]], factor: float = 1.5) -> list[list[float]]:
    """Archetypes moved away from their mean."""
    centre = [sum(col) / len(archetypes) for col in zip(*archetypes, strict=True)]
    return [[c + factor * (x - c) for x, c in zip(a, centre, strict=True)] for a in archetypes]


def distance_table(cells: DataFrame, archetypes: Sequence[Sequence[float]]) -> DataFrame:
    """cell_id, archetype_{i}_distance, nearest_archetype, nearest_distance, mean_distance, std_distance."""
    d = F.col("__d")
    return cells.select("cell_id", distances_to(F.col("vec"), archetypes).alias("__d")).select(
        "cell_id",
        *[d[i].alias(f"archetype_{i}_distance") for i in range(len(archetypes))],
        V.argmin(d).cast("int").alias("nearest_archetype"),
        F.array_min(d).alias("nearest_distance"),
        F.round(V.mean(d), 6).alias("mean_distance"),
        F.round(V.std_pop(d), 6).alias("std_distance"),
    )


def bins(cells: DataFrame, archetypes: Sequence[Sequence[float]], share: float = 0.1, central: bool = True) -> DataFrame:
    """cell_id, archetype_label, archetype_idx, distance, rank_in_archetype, multiple_archetypes.

    The floor(n * share) cells nearest to each archetype; with ``central`` also those with the
    smallest mean distance, as archetype_0 (index -1). Cells in no bin follow once, as
    no_archetype (index and rank -1, distance NaN). Ties go to the smaller cell_id.
    """
    k = len(archetypes)
    d = cut(cells.select("cell_id", distances_to(F.col("vec"), archetypes).alias("d")))
    size = int(d.count() * share)
    entries = [F.struct(F.lit(i).alias("archetype_idx"), F.col("d")[i].alias("distance")) for i in range(k)]
    if central:
        entries.append(F.struct(F.lit(-1).alias("archetype_idx"), F.round(V.mean(F.col("d")), 9).alias("distance")))
    long = d.select("cell_id", F.explode(F.array(*entries)).alias("e")).select("cell_id", "e.*")
    # The exact distance of each bin's last cell; only cells up to it are put in order, over all partitions.
    last = long.select("archetype_idx").distinct().select("archetype_idx", F.lit(size - 1).cast("long").alias("k"))
    edges = small(O.kth_values(long, ["archetype_idx"], "distance", last).select("archetype_idx", F.col("value").alias("edge")))
    near = long.join(edges, "archetype_idx").where(F.col("distance") <= F.col("edge")).drop("edge")
    taken = O.places(near, ["archetype_idx"], ["distance", "cell_id"], "rank_in_archetype").where(F.col("rank_in_archetype") < size).withColumn("rank_in_archetype", F.col("rank_in_archetype").cast("int"))
    label = F.concat(F.lit("archetype_"), (F.col("archetype_idx") + 1).cast("string"))
    many = F.count(F.lit(1)).over(Window.partitionBy("cell_id")) > 1
    taken = taken.select("cell_id", label.alias("archetype_label"), "archetype_idx", "distance", "rank_in_archetype", many.alias("multiple_archetypes"))
    rest = d.join(taken.select("cell_id"), "cell_id", "left_anti").select(
        "cell_id", F.lit(NONE).alias("archetype_label"), F.lit(-1).alias("archetype_idx"), F.lit(float("nan")).alias("distance"), F.lit(-1).alias("rank_in_archetype"), F.lit(False).alias("multiple_archetypes")
    )
    return taken.unionByName(rest)


def labels(binned: DataFrame) -> DataFrame:
    """One label for each cell: of several bins the highest archetype_idx."""
    return binned.groupBy("cell_id").agg(F.max_by("archetype_label", "archetype_idx").alias("archetype"))


def select_cells(table: DataFrame, criteria: dict[str, str]) -> DataFrame:
    """The rows that meet all thresholds: {"archetype_1": ">30%", "2": "<=10%", "0": "==50%"}.

    Column of label i is archetype_{i}; == allows a difference of 0.01.
    """
    tests = {">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "==": lambda c, v: F.abs(c - v) <= 0.01, ">": lambda c, v: c > v, "<": lambda c, v: c < v}
    conditions = []
    for label, spec in criteria.items():
        name = label if label.startswith("archetype_") else f"archetype_{label}"
        if name not in table.columns:
            raise ValueError(f"unknown archetype {label}")
        m = re.fullmatch(r"\s*(>=|<=|==|>|<)\s*([\d.]+)\s*%\s*", spec)
        if not m:
            raise ValueError(f"criterion {spec!r}")
        conditions.append(tests[m[1]](F.col(name), float(m[2]) / 100))
    return table.where(reduce(and_, conditions)) if conditions else table


def centroids(cells: DataFrame, condition: str, exclude: Sequence[str] = (NONE, CENTRAL), groupby: str | None = None, label: str | None = None) -> DataFrame:
    """Mean vector and number of cells of each level (and group): [group,] level, centroid, centroid_3d, n_cells."""
    rows = cells.where(F.col(condition).isNotNull())
    if label:
        rows = rows.where(~F.col(label).isin(*exclude))
    keys = [F.col(groupby).alias("group")] if groupby else []
    names = ["group", "level"] if groupby else ["level"]
    long = rows.select(*keys, F.col(condition).cast("string").alias("level"), F.posexplode("vec").alias("pos", "x"))
    means = long.groupBy(*names, "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.round("m", 6).alias("m")))), lambda e: e["m"])
    return means.groupBy(*names).agg(vec.alias("centroid"), F.max("n").alias("n_cells")).withColumn("centroid_3d", F.slice("centroid", 1, 3))


def assign_to_centroids(cells: DataFrame, centres: Sequence[tuple[str, Sequence[float]]], share: float = 0.15, exclude: Sequence[str] = (NONE,), label: str | None = None) -> DataFrame:
    """cell_id, assigned: level by level, the max(1, floor(n * share)) nearest cells still free, ties at the edge included.

    Levels are few and their order matters, so each has its passes over the cells that are left; the distance at the
    edge is an exact order statistic, and nothing is sorted.
    """
    valid = cells.where(~F.col(label).isin(*exclude)) if label else cells
    size = max(1, int(valid.count() * share))
    state = valid.select("cell_id", "vec", F.lit(None).cast("string").alias("assigned"))
    for level, centre in centres:
        d = F.when(F.col("assigned").isNull(), V.distance(F.col("vec"), V.literal(centre)))
        with_d = state.withColumn("d", d)
        free = with_d.where("d IS NOT NULL").select("d")
        last = free.agg((F.least(F.count(F.lit(1)), F.lit(size)) - 1).alias("k"))
        edge = O.kth_values(free, [], "d", last).first()
        if edge is None:  # no cell is left
            break
        state = cut(with_d.withColumn("assigned", F.when(F.col("d") <= edge.value, F.lit(level)).otherwise(F.col("assigned"))).select("cell_id", "vec", "assigned"))  # else each level doubles the plan
    rest = cells.join(valid.select("cell_id"), "cell_id", "left_anti").select("cell_id", F.lit(UNASSIGNED).alias("assigned")) if label else None
    out = state.select("cell_id", F.coalesce("assigned", F.lit(UNASSIGNED)).alias("assigned"))
    return out.unionByName(rest) if rest is not None else out


def archetype_statistics(archetypes: Sequence[Sequence[float]]) -> dict:
    """Mean, population std, smallest, largest and range of pairwise distances; nearest and furthest pair; from three dimensions, the convex hull's volume and area.

    A hull that has no inside (as with no more archetypes than dimensions) has neither. k is small, so plain Python.
    """
    pairs = {(i, j): sum((a - b) ** 2 for a, b in zip(archetypes[i], archetypes[j], strict=True)) ** 0.5 for i, j in combinations(range(len(archetypes)), 2)}
    values = list(pairs.values())
    m = sum(values) / len(values)
    hull = dict(zip(("hull_volume", "hull_area"), hull_size(np.array(archetypes, float)), strict=True)) if len(archetypes[0]) >= 3 else {}
    return hull | {
        "mean": m, "std": (sum((v - m) ** 2 for v in values) / len(values)) ** 0.5, "min": min(values), "max": max(values), "range": max(values) - min(values),
        "nearest": min(pairs, key=pairs.get), "furthest": max(pairs, key=pairs.get),
    }


def hull_size(points: np.ndarray) -> tuple[float | None, float | None]:
    """(volume, area) of the convex hull of a few points, nothing where they span less than their dimensions.

    Facets are the hyperplanes through points with all others on one side. The volume adds up pyramids from
    the points' mean over them; a facet's size is the volume of its own points, one dimension lower.
    """
    n, d = points.shape
    if d == 1:
        return float(np.ptp(points)), None
    middle = points.mean(0)
    x = points - middle
    tiny = 1e-9 * max(np.abs(x).max(initial=0.0), 1e-300)
    if n <= d or np.linalg.matrix_rank(x, tol=tiny) < d:
        return None, None
    facets: dict[frozenset, tuple[float, np.ndarray]] = {}
    for some in combinations(range(n), d):
        _, spread, axes = np.linalg.svd(x[list(some[1:])] - x[some[0]])
        if spread[-1] <= tiny:
            continue
        height = (x - x[some[0]]) @ axes[-1]
        if (height <= tiny).all() or (height >= -tiny).all():
            facets[frozenset(np.flatnonzero(np.abs(height) <= tiny).tolist())] = abs(float(x[some[0]] @ axes[-1])), axes[:-1]
    sizes = [(distance, hull_size(x[sorted(on)] @ axes.T)[0] or 0.0) for on, (distance, axes) in facets.items()]
    return sum(h * size for h, size in sizes) / d, sum(size for _, size in sizes)


def pair_distances(archetypes: DataFrame) -> DataFrame:
    """i, j, distance of all pairs i < j of an archetype table (archetype_idx, y); k rows, so the theta join is small."""
    a, b = archetypes.select(F.col("archetype_idx").alias("i"), F.col("y").alias("a")), archetypes.select(F.col("archetype_idx").alias("j"), F.col("y").alias("b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", V.distance(F.col("a"), F.col("b")).alias("distance"))


def assignment(cost: np.ndarray) -> list[int]:
    """For each row a column of its own at the least total cost (rows at most as many as columns).

    The Hungarian method: rows join one by one along a shortest augmenting path under reduced costs, whose
    search takes all columns at a time.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    of_row, of_column = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, base, column = row, 0.0, -1
        while True:
            step = base + cost[at] - of_row[at] - of_column
            better = ~done & (step < reach)
            reach[better], came[better] = step[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            base = reach[column]
            if owner[column] < 0:
                break
            done[column] = True
            at = owner[column]
        seen = np.flatnonzero(done)
        of_row[owner[seen]] += base - reach[seen]
        of_row[row] += base
        of_column[seen] -= base - reach[seen]
        while column >= 0:  # turn the path round
            before = came[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    out = [0] * n
    for column in np.flatnonzero(owner >= 0).tolist():
        out[owner[column]] = column
    return out


def match_archetypes(true: Sequence[Sequence[float]], found: Sequence[Sequence[float]]) -> list[int]:
    """For each true archetype the found one, at the least total distance; there must be as many found ones at least."""
    a, b = np.array(true, float), np.array(found, float)
    return assignment(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)))


def recovery(true: Sequence[Sequence[float]], found: Sequence[Sequence[float]], tolerance: float = 0.5) -> dict:
    """Mean distance of matched archetypes, normalised by the true ones' std, and the share within tolerance."""
    order = match_archetypes(true, found)
    d = [sum((a - b) ** 2 for a, b in zip(t, found[j], strict=True)) ** 0.5 for t, j in zip(true, order, strict=True)]
    flat = [x for t in true for x in t]
    m = sum(flat) / len(flat)
    std = (sum((x - m) ** 2 for x in flat) / len(flat)) ** 0.5
    return {"mean_distance": sum(d) / len(d), "normalized_error": sum(d) / len(d) / std, "accuracy": sum(x < tolerance * std for x in d) / len(d), "matching": order}


def positions(archetypes: DataFrame) -> DataFrame:
    """archetype_idx and mean, std, min, max, range over the features."""
    y = F.col("y")
    return archetypes.select(
        "archetype_idx", F.round(V.mean(y), 6).alias("mean"), F.round(V.std_pop(y), 6).alias("std"), F.round(F.array_min(y), 6).alias("min"), F.round(F.array_max(y), 6).alias("max"),
        F.round(F.array_max(y) - F.array_min(y), 6).alias("range"),
    )


def weight_table(weights: DataFrame, column: str = "w") -> DataFrame:
    """cell_id, max_weight, dominant_archetype, weight_entropy."""
    w = F.col(column)
    return weights.select("cell_id", F.round(F.array_max(w), 6).alias("max_weight"), V.argmax(w).cast("int").alias("dominant_archetype"), F.round(V.entropy(w), 6).alias("weight_entropy"))


def weight_statistics(weights: DataFrame, column: str = "w") -> DataFrame:
    """archetype_idx, mean, sample std, max, min, share of cells that it dominates."""
    long = weights.select(V.argmax(F.col(column)).alias("top"), F.posexplode(column).alias("archetype_idx", "x"))
    return long.groupBy("archetype_idx").agg(
        F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.round(F.max("x"), 6).alias("max"), F.round(F.min("x"), 6).alias("min"),
        F.round(F.avg((F.col("top") == F.col("archetype_idx")).cast("double")), 6).alias("dominant_share"),
    )


def constraint_report(weights: DataFrame, column: str = "w", tolerance: float = 1e-3) -> DataFrame:
    """One row: how far row sums are from one (mean, max, std, median), negative share, violation rate."""
    w = F.col(column)
    error = F.abs(V.total(w) - 1)
    negative = F.size(F.filter(w, lambda x: x < 0)) / F.size(w)
    rows = cut(weights.select(error.alias("e"), negative.alias("neg")))
    middle = O.quantiles(rows, [], "e", [0.5]).agg(F.round(F.max("value"), 6).alias("median_error"))
    found = rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("e"), 6).alias("mean_error"), F.round(F.max("e"), 6).alias("max_error"), F.round(F.stddev_pop("e"), 6).alias("std_error"),
        F.round(F.avg("neg"), 6).alias("negative_share"), F.round(F.avg((F.col("e") > tolerance).cast("double")), 6).alias("violation_rate"),
    )
    return found.crossJoin(F.broadcast(middle)).select("n_rows", "mean_error", "max_error", "std_error", "median_error", "negative_share", "violation_rate")  # a row each


def r_squared(pairs: DataFrame, x: str = "vec", fitted: str = "fitted") -> DataFrame:
    """One row r2: 1 - residual / total sum of squares around the column means."""
    long = pairs.select(F.posexplode(F.arrays_zip(F.col(x).alias("x"), F.col(fitted).alias("f"))).alias("pos", "e")).select("pos", "e.x", "e.f")
    by = long.groupBy("pos").agg(F.sum((F.col("x") - F.col("f")) ** 2).alias("res"), (F.var_pop("x") * F.count("x")).alias("tot"))
    return by.agg(F.round(1 - F.sum("res") / F.greatest(F.sum("tot"), F.lit(1e-8)), 6).alias("r2"))
