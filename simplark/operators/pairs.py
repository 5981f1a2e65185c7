"""Counts of pairs of labels by distance, from a pyramid of nested squares.

Squares as wide as the largest band meet their neighbours; each next level halves them. A pair of
squares whose points are all within one band counts as a product of label counts, one out of reach
leaves, and only what lies across a border of bands goes on to the next level, or opens to points
once these are few. A dense place becomes deep, never a join of all its points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplark.sources.shared import cut

#: A pair of squares opens to its points when they make at most so many pairs; levels at most.
OPEN_PAIRS, DEPTH = 4096, 40
#: Pairs of points that a task measures at a time.
MEASURED = 1 << 17
SQUARE = ("sx", "sy", "points", "counts", "x0", "x1", "y0", "y1")
COUNTS = "band int, la int, lb int, once boolean, n long"


def band_of(distance: Column, edges: Sequence[float]) -> Column:
    """The first band, from 1, that reaches so far; 0 beyond all."""
    return F.coalesce(F.array_position(F.transform(F.lit(list(edges)), lambda e: distance <= e), True).cast("int"), F.lit(0))


def squares(places: DataFrame, level: int, n_labels: int) -> DataFrame:
    """Squares of a level that have points: distinct places, points by label, and the box around them."""
    sx, sy = (F.floor(F.col(c) * float(2**level)).cast("long") for c in ("qx", "qy"))
    counts = F.array(*[F.sum(F.when(F.col("lab") == i, F.col("n")).otherwise(F.lit(0))) for i in range(n_labels)])
    return places.groupBy(sx.alias("sx"), sy.alias("sy")).agg(
        F.count(F.lit(1)).alias("points"), counts.alias("counts"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )


def side(found: DataFrame, name: str) -> DataFrame:
    return found.toDF(*[f"{name}_{c}" for c in found.columns])


def first_pairs(found: DataFrame) -> DataFrame:
    """Every square with itself and those of its eight neighbours that come after it."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    left = side(found, "a").select("*", steps.alias("to"))
    left = left.select("*", (F.col("a_sx") + F.col("to.x")).alias("b_sx"), (F.col("a_sy") + F.col("to.y")).alias("b_sy")).drop("to")
    return left.join(side(found, "b"), ["b_sx", "b_sy"])


def next_pairs(open_pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of children of pairs of squares; of a square with itself each pair once."""
    parents = open_pairs.select(*[F.col(c).alias(f"p_{c}") for c in ("a_sx", "a_sy", "b_sx", "b_sy")])
    for name in "ab":
        child = side(found, name).select("*", *[F.floor(F.col(f"{name}_{c}") / 2).cast("long").alias(f"p_{name}_{c}") for c in ("sx", "sy")])
        parents = parents.join(child, [f"p_{name}_sx", f"p_{name}_sy"])
    alone = (F.col("p_a_sx") == F.col("p_b_sx")) & (F.col("p_a_sy") == F.col("p_b_sy"))
    return parents.where(~alone | (F.struct("a_sx", "a_sy") <= F.struct("b_sx", "b_sy"))).drop("p_a_sx", "p_a_sy", "p_b_sx", "p_b_sy")


def judged(pairs: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Pairs of squares in reach with the bands of their least and largest possible distance, and whether both are one square (once)."""
    gap = [F.greatest(F.lit(0.0), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"b_{c}1")) for c in "xy"]
    reach = [F.greatest(F.abs(F.col(f"b_{c}1") - F.col(f"a_{c}0")), F.abs(F.col(f"a_{c}1") - F.col(f"b_{c}0"))) for c in "xy"]
    least, most = (F.sqrt(x * x + y * y) for x, y in (gap, reach))
    margin = (most + 1) * 2e-9  # distances are rounded to nine digits
    once = (F.col("a_sx") == F.col("b_sx")) & (F.col("a_sy") == F.col("b_sy"))
    return pairs.select("*", once.alias("once"), band_of(least - margin, edges).alias("from"), band_of(most + margin, edges).alias("to")).where("from > 0")


def products(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs by label of squares that count as a whole, added up by band."""
    sums: dict[tuple[int, bool], np.ndarray] = {}
    for pdf in batches:
        for key, part in pdf.groupby(["band", "once"]):
            a, b = (np.array(part[c].tolist(), np.int64) for c in ("a_counts", "b_counts"))
            sums[key] = sums.get(key, 0) + a.T @ b
    for (band, once), n in sums.items():
        la, lb = np.nonzero(n)
        yield pd.DataFrame({"band": band, "la": la, "lb": lb, "once": once, "n": n[la, lb]})


def opened(pairs: DataFrame, places: DataFrame, level: int, edges: Sequence[float], n_labels: int) -> DataFrame:
    """Pairs by label and band of the points of pairs of squares: each row of a task holds the points of two squares, and is counted in place."""
    keys = pairs.select(F.col("a_sx").alias("sx"), F.col("a_sy").alias("sy")).unionByName(pairs.select(F.col("b_sx").alias("sx"), F.col("b_sy").alias("sy"))).distinct()
    at = [F.floor(F.col(c) * float(2**level)).cast("long").alias(s) for c, s in (("qx", "sx"), ("qy", "sy"))]
    lists = [F.col(f"held.{c}").alias(c) for c in ("x", "y", "lab", "n")]
    inside = places.select("x", "y", "lab", "n", *at).join(keys, ["sx", "sy"], "left_semi").groupBy("sx", "sy").agg(F.collect_list(F.struct("x", "y", "lab", "n")).alias("held")).select("sx", "sy", *lists)
    both = pairs.select("a_sx", "a_sy", "b_sx", "b_sy", "once").join(side(inside, "a"), ["a_sx", "a_sy"]).join(side(inside, "b"), ["b_sx", "b_sy"])
    bands = np.array(edges)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(bands) + 1, n_labels, n_labels, 2), np.int64)
        for batch in batches:
            once = batch.column("once").to_numpy(zero_copy_only=False)
            flat = {s: [batch.column(f"{s}_{c}").flatten().to_numpy(zero_copy_only=False) for c in ("x", "y", "lab", "n")] for s in "ab"}
            sizes = {s: pc.list_value_length(batch.column(f"{s}_x")).to_numpy(zero_copy_only=False).astype(np.int64) for s in "ab"}
            first = {s: np.cumsum(sizes[s]) - sizes[s] for s in "ab"}
            # Every point of a's squares, once for a run of so many points of b's: at most ``MEASURED`` pairs at a time.
            row = np.repeat(np.arange(batch.num_rows), sizes["a"])
            many = sizes["b"][row]
            ends = np.cumsum(many)
            k = 0
            while k < len(row):
                to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + MEASURED, "right")))
                some, reach = row[k:to], many[k:to]
                for skip in range(0, max(1, int(reach.max(initial=0))), MEASURED) if to == k + 1 else (0,):
                    length = np.minimum(reach - skip, MEASURED) if to == k + 1 else reach
                    i = np.repeat(np.arange(k, to), length)
                    j = np.arange(len(i)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first["b"][some] + skip, length)
                    (ax, ay, al, an), (bx, by, bl, bn) = flat["a"], flat["b"]
                    d = np.sqrt((ax[i] - bx[j]) ** 2 + (ay[i] - by[j]) ** 2).round(9)
                    at_once = np.ravel_multi_index((np.searchsorted(bands, d), al[i], bl[j], once[row[i]].astype(int)), sums.shape)
                    np.add.at(sums.ravel(), at_once, an[i] * bn[j])
                k = to
        band, la, lb, alone = np.nonzero(sums[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(band + 1, pa.int32()), pa.array(la, pa.int32()), pa.array(lb, pa.int32()), pa.array(alone == 1), pa.array(sums[band, la, lb, alone], pa.int64())], names=["band", "la", "lb", "once", "n"])

    return both.select("once", *[f"{s}_{c}" for s in "ab" for c in ("x", "y", "lab", "n")]).mapInArrow(measure, COUNTS)


def co_occurrence(points: DataFrame, bands: Sequence[float], label: str = "archetype", open_pairs: int = OPEN_PAIRS) -> DataFrame:
    """band, a, b, n, ratio: how likely label a is at such a distance from label b, over how likely it is there at all.

    ``points`` has ``label``, x and y, a row for each cell; rows without one of them don't count. Ordered pairs of
    different cells count in the first band that reaches their distance, rounded to nine digits; bands without
    a pair of two labels have no row for them. Cells of the same place and label are one row with their number. A pair of
    squares still across a border after ``DEPTH`` halvings opens whatever it holds. Labels are few: their
    counts are an array in each square.
    """
    edges = sorted(float(b) for b in bands)
    if not edges or edges[0] < 0 or edges[-1] <= 0:
        raise ValueError("bands are distances, the last above zero")
    kept = points.select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(c) for c in ("x", "y")]).where("label IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AND x IS NOT NULL AND y IS NOT NULL")
    kept = cut(kept.groupBy("label", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    names = cut(kept.groupBy("label").agg(F.sum("n").alias("cells")).select((F.row_number().over(Window.orderBy("label")) - 1).alias("lab"), "label", "cells"))
    n_labels = names.count()
    width = edges[-1]
    places = cut(kept.join(F.broadcast(names.select("lab", "label")), "label").select("x", "y", "lab", "n", (F.col("x") / width).alias("qx"), (F.col("y") / width).alias("qy"))) if n_labels else None
    # Each cell with itself was counted in the first band.
    counts = names.select(F.lit(1).alias("band"), F.col("lab").alias("la"), F.col("lab").alias("lb"), (-F.col("cells")).alias("n"))
    rest = None
    for level in range(DEPTH + 1) if n_labels else ():
        found = squares(places, level, n_labels)
        pairs = cut(judged(first_pairs(found) if rest is None else next_pairs(rest, found), edges))
        whole = pairs.where("from = to").select(F.col("from").alias("band"), "once", "a_counts", "b_counts").mapInPandas(products, COUNTS)
        few = (F.col("a_points") * F.col("b_points") <= open_pairs) | F.lit(level == DEPTH)
        part = whole.unionByName(opened(pairs.where((F.col("from") != F.col("to")) & few), places, level, edges, n_labels))
        part = cut(part.groupBy("band", "la", "lb", "once").agg(F.sum("n").alias("n")))
        mirrored = part.where("NOT once").select("band", F.col("lb").alias("la"), F.col("la").alias("lb"), "n")
        counts = counts.unionByName(part.drop("once")).unionByName(mirrored)
        rest = pairs.where((F.col("from") != F.col("to")) & ~few)
        if rest.isEmpty():
            break
    counts = counts.groupBy("band", "la", "lb").agg(F.sum("n").alias("n")).where("n > 0")
    for side_name in "ab":
        counts = counts.join(F.broadcast(names.select(F.col("lab").alias(f"l{side_name}"), F.col("label").alias(side_name))), f"l{side_name}")
    total = F.sum("n").over(Window.partitionBy("band"))
    of_a, of_b = F.sum("n").over(Window.partitionBy("band", "a")), F.sum("n").over(Window.partitionBy("band", "b"))
    return counts.select((F.col("band") - 1).cast("int").alias("band"), "a", "b", "n", ((F.col("n") / of_b) / (of_a / total)).alias("ratio"))
