"""Neighbour graphs, spatial statistics, transitions and fates over edge tables (src, dst, w)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from simplark.functions import special
from simplark.functions import vectors as V
from simplark.operators import order as O
from simplark.operators.archetypes import CENTRAL
from simplark.sources.shared import cut, small

#: Points of a part: at least, at most; between them a sixteenth of all, so that points which visit every part are
#: sixteen rows each. Visitors of a part that meet at a time.
BLOCK_ROWS = (500, 20_000)
VISITORS = 20_000
#: Rows of either side that are compared at a time.
TILE = (256, 4096)


def near_pairs(left: np.ndarray, ids: np.ndarray, right: np.ndarray, others: np.ndarray, k: int, bound: np.ndarray | None = None) -> pd.DataFrame:
    """src, dst, d: for each left row its k nearest right rows (at most ``bound`` away), itself left out, ties to the smaller id.

    Distances come from matrix products in tiles of both sides, and what could be among the nearest is measured again.
    A row's k-th distance so far bounds its next tile, so that most of a tile is compared once and dropped.
    """
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    out = [empty]
    if len(left) and len(right):
        right_squares = (right * right).sum(1)
        most = right_squares.max()
        wide = np.hstack((-2 * right, right_squares[:, None])).T
        for at in range(0, len(left), TILE[0]):
            part, own = left[at : at + TILE[0]], ids[at : at + TILE[0]]
            squares, tall = (part * part).sum(1), np.hstack((part, np.ones((len(part), 1))))
            edge = np.full(len(part), np.inf) if bound is None else bound[at : at + TILE[0]].astype(float)
            r, c, d = empty
            for to in range(0, len(right), TILE[1]):
                rough = tall @ wide[:, to : to + TILE[1]]
                width = rough.shape[1]
                # The product form is off by some units of the last place of the squares; distances tie at 9 digits.
                slack = 1e-12 * (squares + most) + 1e-15
                with np.errstate(invalid="ignore"):
                    top = np.where(np.isfinite(edge), edge**2 + 4e-9 * edge - squares, np.inf)
                if width > k and not np.isfinite(edge).all():
                    open_rows = np.flatnonzero(~np.isfinite(edge))
                    # One more than k, for the row itself.
                    kth = np.partition(rough[open_rows], k, axis=1)[:, k]
                    top[open_rows] = kth + 4e-9 * np.sqrt(np.maximum(kth + squares[open_rows], 0))
                x, y = np.divmod(np.flatnonzero(rough <= (top + slack)[:, None]), width)
                y = y + to
                other = own[x] != others[y]
                x, y = x[other], y[other]
                new = np.sqrt(((part[x] - right[y]) ** 2).sum(1)).round(9)
                if not len(new):
                    continue
                r, c, d = np.concatenate((r, x)), np.concatenate((c, y)), np.concatenate((d, new))
                order = np.lexsort((others[c], d, r))
                r, c, d = r[order], c[order], d[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                last = place == k - 1
                edge[r[last]] = np.minimum(edge[r[last]], d[last])
                r, c, d = (v[place < k] for v in (r, c, d))
            out.append((own[r], others[c], d))
    src, dst, d = (np.concatenate(v) for v in zip(*out, strict=True))
    return pd.DataFrame({"src": src, "dst": dst, "d": d})


def rows_of(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Pivots:
    """Points that the others are dealt to, with the number of points, of blocks and the radius of each one's part."""

    def __init__(self, at: np.ndarray):
        self.at, self.squares = at, (at * at).sum(1)
        self.apart = np.sqrt(np.maximum(self.squares[:, None] + self.squares[None, :] - 2 * at @ at.T, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + self.squares[None, :] - 2 * (x @ self.at.T), 0))

    def sized(self, sizes: np.ndarray, radius: np.ndarray, block: int) -> Pivots:
        self.sizes, self.radius, self.blocks = sizes, radius, np.maximum(1, -(-sizes // block))
        return self

    def reached(self, x: np.ndarray, part: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, part) of all parts that may hold a point within the row's bound.

        By the triangle inequality no point of a part is nearer than the distance to its pivot less its radius,
        nor nearer than the plane between its pivot and the row's own.
        """
        d = self.distances(x)
        own = d[np.arange(len(x)), part]
        apart = np.maximum(self.apart[part], 1e-300)
        plane = (d * d - (own * own)[:, None]) / (2 * apart)
        # Distances by products are off by the root of some units of the squares' last place.
        slack = 1e-6 * np.sqrt((x * x).sum(1) + self.squares.max())[:, None] + 1e-8
        away = np.maximum(d - self.radius[None, :], np.where(self.apart[part] > 1e-3, plane - slack, 0))
        return np.nonzero((away <= bound[:, None] + slack) & (self.sizes > 0)[None, :])


def dealt_parts(points: DataFrame, n: int) -> tuple[DataFrame, Pivots]:
    """(cell_id, vec, part, block) of all points, written, and the pivots: points with the smallest hashes of their ids, about one for each part of the wanted size."""
    size = min(max(BLOCK_ROWS[0], n // 16), BLOCK_ROWS[1])
    chosen = points.select("vec", F.xxhash64("cell_id").alias("h"), "cell_id").orderBy("h", "cell_id").limit(max(1, -(-n // size))).select("vec").toPandas()
    pivots = Pivots(rows_of(chosen["vec"]))

    def deal(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                some = pdf.iloc[at : at + 4096]
                d = pivots.distances(rows_of(some["vec"]))
                part = d.argmin(1)
                yield some.assign(part=part.astype(np.int32), away=d[np.arange(len(d)), part])

    dealt = cut(points.select("cell_id", "vec").mapInPandas(deal, "cell_id long, vec array<double>, part int, away double"))
    sizes, radius = np.zeros(len(chosen), np.int64), np.zeros(len(chosen))
    for r in dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():  # a row for each part
        sizes[r.part], radius[r.part] = r.n, r.r
    pivots.sized(sizes, radius, 2 * size)
    block = F.pmod(F.xxhash64("cell_id"), F.get(F.lit(pivots.blocks.tolist()), F.col("part")))
    return dealt.select("cell_id", "vec", "part", block.cast("int").alias("block")), pivots


def visits(bounded: DataFrame, pivots: Pivots) -> DataFrame:
    """(cell_id, vec, bound, part, block) of every block that a point has to visit: those in reach but its own."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                part, block, bound = some["part"].to_numpy(), some["block"].to_numpy(), some["bound"].astype(float).fillna(np.inf).to_numpy()
                row, to = pivots.reached(rows_of(some["vec"]), part, bound)
                copies = pivots.blocks[to]
                k = np.repeat(np.arange(len(row)), copies)
                into = np.arange(len(k)) - np.repeat(np.cumsum(copies) - copies, copies)
                other = (to[k] != part[row[k]]) | (into != block[row[k]])
                k, into = k[other], into[other]
                for i in range(0, len(k), 20_000):
                    here = slice(i, i + 20_000)
                    yield some.iloc[row[k[here]]][["cell_id", "vec"]].assign(bound=bound[row[k[here]]], part=to[k[here]].astype(np.int32), block=into[here].astype(np.int32))

    return bounded.mapInPandas(run, "cell_id long, vec array<double>, bound double, part int, block int")


def own_parts(points: DataFrame, k: int, n: int) -> tuple[DataFrame, DataFrame, Pivots]:
    """(edges within blocks, the points with the distance that their k-th neighbour can't exceed, the pivots)."""
    dealt, pivots = dealt_parts(points, n)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = rows_of(pdf["vec"]), pdf["cell_id"].to_numpy()
        return near_pairs(x, ids, x, ids, k)

    first = cut(dealt.groupBy("part", "block").applyInPandas(inside, "src long, dst long, d double"))
    bounds = first.groupBy(F.col("src").alias("cell_id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).alias("bound"))
    return first, cut(dealt.join(bounds, "cell_id", "left")), pivots


def knn_edges(points: DataFrame, k: int = 30) -> DataFrame:
    """src, dst, w (1): the k nearest other points by Euclidean distance, ties to the smaller id.

    Exact. Points are dealt to the nearest of some pivots and first find the k nearest in their own part (a block
    of it, where many points share a pivot). That bounds the distance of the k-th neighbour, and a point
    visits only the parts that may hold something nearer. Where nothing can be pruned, as with random vectors of
    many dimensions, every point visits every part, which is what comparing all of them takes. Groups
    are bounded: blocks by the size of parts, visitors by slices. Nothing but the pivots passes through the driver.
    """
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], "src long, dst long, w double")
    first, bounded, pivots = own_parts(points, k, n)
    guests = visits(bounded, pivots)
    counts = np.zeros((len(pivots.sizes), int(pivots.blocks.max(initial=1))), np.int64)
    guests = cut(guests)
    for r in guests.groupBy("part", "block").count().collect():  # a row for each block
        counts[r.part, r.block] = r["count"]
    slices = (1 + counts // VISITORS).tolist()
    of = F.get(F.get(F.lit(slices), F.col("part")), F.col("block"))
    guests = guests.withColumn("slice", F.pmod(F.xxhash64("cell_id"), of).cast("int"))
    hosts = bounded.select("cell_id", "vec", "part", "block", F.explode(F.sequence(F.lit(0), (of - 1).cast("int"))).alias("slice"))

    def meet(guest: pd.DataFrame, host: pd.DataFrame) -> pd.DataFrame:
        return near_pairs(rows_of(guest["vec"]), guest["cell_id"].to_numpy(), rows_of(host["vec"]), host["cell_id"].to_numpy(), k, guest["bound"].to_numpy())

    keys = ["part", "block", "slice"]
    second = guests.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInPandas(meet, "src long, dst long, d double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    return cut(first.unionByName(second).withColumn("r", rank).where(F.col("r") <= k).select("src", "dst", F.lit(1.0).alias("w")))


def compared_share(points: DataFrame, k: int = 30) -> DataFrame:
    """One row: n points, parts, and the share of all pairs of points that ``knn_edges`` compares."""
    n = points.count()
    _, bounded, pivots = own_parts(points, k, n)
    blocks = bounded.groupBy("part", "block").agg(F.count(F.lit(1)).alias("hosts"))
    met = visits(bounded, pivots).groupBy("part", "block").agg(F.count(F.lit(1)).alias("guests"))
    t = blocks.join(met, ["part", "block"], "left").select("part", "hosts", F.coalesce("guests", F.lit(0)).alias("guests"))
    pairs = F.sum(F.col("hosts").cast("double") * (F.col("hosts") + F.col("guests")))
    return t.agg(F.lit(n).alias("n"), F.count_distinct("part").alias("parts"), (pairs / (float(n) * n)).alias("share"))


def label_edges(edges: DataFrame, labels: DataFrame, label: str = "archetype") -> DataFrame:
    """a, b, n: how many edges go from label a to label b."""
    one = labels.select(F.col("cell_id").alias("src"), F.col(label).alias("a"))
    two = labels.select(F.col("cell_id").alias("dst"), F.col(label).alias("b"))
    return edges.join(one, "src").join(two, "dst").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def neighbourhood_enrichment(edges: DataFrame, labels: DataFrame, label: str = "archetype") -> DataFrame:
    """a, b, n, mean, std, z of edge counts against all permutations of the labels over the cells.

    Mean and variance under permutation are exact, not drawn: the second moment of a count adds up, over
    all pairs of edges, the chance that both connect the two labels, which depends on the cells that the
    edges share and on the labels' sizes alone. So one pass over the edges gives the number of pairs that
    share a source, a target or a cell between them, and the rest is a row for each pair of labels.
    Edges are distinct and none leads to its own cell.
    """
    observed = label_edges(edges, labels, label)
    sizes = labels.groupBy(F.col(label).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("s"))
    total = labels.agg(F.count(F.lit(1)).cast("double").alias("cells"))
    degrees = (
        edges.select(F.col("src").alias("c"), F.lit(1.0).alias("o"), F.lit(0.0).alias("i"))
        .unionByName(edges.select(F.col("dst").alias("c"), F.lit(0.0).alias("o"), F.lit(1.0).alias("i")))
        .groupBy("c")
        .agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    )
    sums = degrees.agg(F.sum("o").alias("m"), F.sum(F.col("o") * F.col("o")).alias("oo"), F.sum(F.col("i") * F.col("i")).alias("ii"), F.sum(F.col("o") * F.col("i")).alias("oi"))
    way = F.struct(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    both_ways = edges.groupBy(way).agg(F.count(F.lit(1)).alias("n")).agg((2.0 * F.count_if(F.col("n") == 2)).alias("back"))
    few = sizes.select(F.col("x").alias("a"), F.col("s").alias("sa")).crossJoin(F.broadcast(sizes.select(F.col("x").alias("b"), F.col("s").alias("sb"))))  # labels are few
    for one in (total, sums, both_ways):
        few = few.crossJoin(F.broadcast(one))
    sa, sb, n, m, same = F.col("sa"), F.col("sb"), F.col("cells"), F.col("m"), F.col("a") == F.col("b")
    of2, of3, of4 = n * (n - 1), n * (n - 1) * (n - 2), n * (n - 1) * (n - 2) * (n - 3)
    apart = lambda x, of: F.when(of > 0, x / of).otherwise(0.0)
    p = F.when(same, sa * (sa - 1)).otherwise(sa * sb) / of2
    three = sa * (sa - 1) * (sa - 2)
    source = apart(F.when(same, three).otherwise(sa * sb * (sb - 1)), of3)
    target = apart(F.when(same, three).otherwise(sb * sa * (sa - 1)), of3)
    chain = apart(F.when(same, three).otherwise(0.0), of3)
    none = apart(F.when(same, three * (sa - 3)).otherwise(sa * (sa - 1) * sb * (sb - 1)), of4)
    n_source, n_target, n_chain = F.col("oo") - m, F.col("ii") - m, 2 * (F.col("oi") - F.col("back"))
    n_none = m * m - m - F.col("back") - n_source - n_target - n_chain
    square = m * p + F.when(same, F.col("back") * p).otherwise(0.0) + n_source * source + n_target * target + n_chain * chain + n_none * none
    moments = few.select("a", "b", (m * p).alias("mean"), F.sqrt(F.greatest(square - m * p * m * p, F.lit(0.0))).alias("std"))
    out = moments.join(observed, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std")
    return out.withColumn("z", F.when(F.col("std") > 1e-9, (F.col("n") - F.col("mean")) / F.col("std")))


def autocorrelation(edges: DataFrame, values: DataFrame) -> DataFrame:
    """feature, moran_i, geary_c, expected_i, z, pvalue (normal approximation) of long values (cell_id, feature, value)."""
    stats = values.groupBy("feature").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss"))
    pairs = edges.join(values.select(F.col("cell_id").alias("src"), "feature", F.col("value").alias("x")), "src").join(values.select(F.col("cell_id").alias("dst"), "feature", F.col("value").alias("y")), ["dst", "feature"])
    sums = pairs.join(stats.select("feature", "m"), "feature").groupBy("feature").agg(F.sum(F.col("w") * (F.col("x") - F.col("m")) * (F.col("y") - F.col("m"))).alias("zz"), F.sum(F.col("w") * (F.col("x") - F.col("y")) ** 2).alias("dd"), F.sum("w").alias("wsum"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    s1 = both.agg((F.sum(F.col("w") ** 2) / 2).alias("s1"))
    outs, ins = edges.groupBy(F.col("src").alias("c")).agg(F.sum("w").alias("o")), edges.groupBy(F.col("dst").alias("c")).agg(F.sum("w").alias("i"))
    s2 = outs.join(ins, "c", "full").agg(F.sum((F.coalesce("o", F.lit(0.0)) + F.coalesce("i", F.lit(0.0))) ** 2).alias("s2"))
    t = sums.join(stats, "feature").crossJoin(F.broadcast(s1)).crossJoin(F.broadcast(s2))
    n, w = F.col("n").cast("double"), F.col("wsum")
    expected = -1 / (n - 1)
    variance = (n * n * F.col("s1") - n * F.col("s2") + 3 * w * w) / (w * w * (n * n - 1)) - expected * expected
    t = t.select("feature", (n / w * F.col("zz") / F.col("ss")).alias("moran_i"), ((n - 1) / (2 * w) * F.col("dd") / F.col("ss")).alias("geary_c"), expected.alias("expected_i"), variance.alias("v"))
    t = t.withColumn("z", F.when(F.col("v") > 0, (F.col("moran_i") - F.col("expected_i")) / F.sqrt("v")).otherwise(0.0))
    return t.withColumn("pvalue", F.expr(special.two_sided_sql("z"))).drop("v")


def interaction_boundaries(edges: DataFrame, cells: DataFrame, weights: DataFrame, type_a: str | None = None, type_b: str | None = None, cell_type: str = "cell_type") -> DataFrame:
    """cell_id, n_a, n_b, boundary_score: Jensen-Shannon distance of the mean weights of a cell's neighbours of two types.

    Zero where a type is missing. Without types given, the two most frequent.
    """
    if type_a is None or type_b is None:
        top = [r[0] for r in cells.groupBy(cell_type).count().orderBy(F.desc("count"), cell_type).limit(2).collect()]
        type_a, type_b = top
    means = neighbour_means(edges, cells, weights, [type_a, type_b], cell_type)
    both = means.groupBy("cell_id").agg(*[F.max(F.when(F.col("type") == t, F.col("n"))).alias(f"n_{s}") for t, s in ((type_a, "a"), (type_b, "b"))], *[F.max_by("mean", F.when(F.col("type") == t, F.lit(1))).alias(f"mean_{s}") for t, s in ((type_a, "a"), (type_b, "b"))])
    score = F.when(F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), V.jensen_shannon(F.col("mean_a"), F.col("mean_b"))).otherwise(0.0)
    zero = F.lit(0).cast("long")
    return cells.select("cell_id").join(both, "cell_id", "left").select("cell_id", F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"), F.coalesce(score, F.lit(0.0)).alias("boundary_score"))


def neighbour_means(edges: DataFrame, cells: DataFrame, weights: DataFrame, types: Sequence[str], cell_type: str = "cell_type") -> DataFrame:
    """cell_id, type, n, mean: the mean weight vector of a cell's neighbours of each type."""
    attrs = cells.where(F.col(cell_type).isin(*types)).join(weights, "cell_id").select(F.col("cell_id").alias("dst"), F.col(cell_type).alias("type"), "w")
    long = edges.select("src", "dst").join(attrs, "dst").select(F.col("src").alias("cell_id"), "type", F.posexplode("w").alias("pos", "x"))
    by = long.groupBy("cell_id", "type", "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("cell_id", "type").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda e: e["m"]).alias("mean"))


def paga(edges: DataFrame, labels: DataFrame, label: str = "archetype") -> DataFrame:
    """a, b, connectivity: edges between two labels over those of a random graph of the same degrees, at most 1."""
    n = label_edges(edges, labels, label)
    out = n.groupBy("a").agg(F.sum("n").alias("out"))
    sizes = labels.groupBy(F.col(label).alias("b")).agg(F.count(F.lit(1)).alias("size"))
    total = labels.agg(F.count(F.lit(1)).alias("cells"))
    both = n.where("a <> b").unionByName(n.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    t = both.join(out, "a").join(sizes, "b").join(out.select(F.col("a").alias("b"), F.col("out").alias("out_b")), "b").join(sizes.select(F.col("b").alias("a"), F.col("size").alias("size_a")), "a").crossJoin(F.broadcast(total))
    expected = (F.col("out") * F.col("size") + F.col("out_b") * F.col("size_a")) / (F.col("cells") - 1)
    return t.select("a", "b", F.least(F.lit(1.0), F.col("n") / expected).alias("connectivity"))


def high_purity(weights: DataFrame, labels: DataFrame, threshold: float = 0.8, exclude_zero: bool = True) -> DataFrame:
    """cell_id, archetype: cells whose weight of their own archetype reaches the ``threshold`` quantile within it.

    ``weights`` (cell_id, w) counts archetypes from 0, labels from 1.
    """
    number = F.regexp_extract("archetype", r"archetype_(\d+)", 1).cast("int")
    rows = labels.where(F.col("archetype").startswith("archetype_")).join(weights, "cell_id").withColumn("i", number)
    rows = rows.where("i > 0") if exclude_zero else rows
    own = rows.withColumn("own", F.when(F.col("i") > 0, F.get("w", F.col("i") - 1)).otherwise(F.array_max("w")))
    own = cut(own.select("cell_id", "archetype", "own"))
    edge = small(O.quantiles(own, ["archetype"], "own", [threshold]).select("archetype", F.col("value").alias("edge")))
    return own.join(edge, "archetype").where(F.col("own") >= F.col("edge")).select("cell_id", "archetype")


def transition_matrix(edges: DataFrame) -> DataFrame:
    """src, dst, p: edge weights scaled to one for each source."""
    return edges.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p")


def diagnose_transitions(transitions: DataFrame) -> DataFrame:
    """One row: how far row sums are from one, and the largest gap between p(i, j) and p(j, i)."""
    sums = transitions.groupBy("src").agg(F.sum("p").alias("s")).agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("s") - 1)).alias("max_row_error"))
    back = transitions.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    gap = transitions.join(back, ["src", "dst"], "full").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("max_asymmetry"))
    return sums.crossJoin(gap)


def fate_probabilities(transitions: DataFrame, terminal: DataFrame, rounds: int = 2_000, tolerance: float = 1e-6, dense_edges: int = 100_000) -> DataFrame:
    """cell_id, lineage, prob: the chance that a walk from the cell is absorbed by a lineage's terminal cells.

    F solves (I - Q) F = R over the cells that aren't terminal but lead to a terminal. Graphs of up to
    ``dense_edges`` edges are solved at once. Larger ones are solved by BiCGStab on edge tables
    (``krylov_fates``), whose memory and disk are those of the edges and a few vectors. Cells from which no
    terminal can be reached have no fate, terminal cells have their own with certainty. It raises if
    ``rounds`` don't bring the residual of each lineage below a thousandth of ``tolerance``.
    """
    few = transitions.limit(dense_edges + 1).toPandas()
    ends = terminal.select("cell_id", F.col("archetype").alias("lineage")).distinct()
    if len(few) <= dense_edges:
        return solved_fates(transitions.sparkSession, few, terminal.toPandas())  # terminal cells of so few edges
    return krylov_fates(transitions, cut(ends), rounds, tolerance / 1000)


def met(cells: DataFrame) -> DataFrame:
    """``cells`` for joins that are repeated: both sides are shuffled, so no round sends a table of all cells through the driver."""
    return cells.hint("merge")


def leading(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """cell_id of the cells that lead to ``ends``, those included: found backwards, each round from the cells that the last one found."""
    known = new = cut(ends.select("cell_id").distinct())
    while True:
        back = edges.join(met(new.withColumnRenamed("cell_id", "dst")), "dst", "left_semi").select(F.col("src").alias("cell_id")).distinct()
        new = cut(back.join(met(known), "cell_id", "left_anti"))
        if not new.take(1):
            return known
        known = cut(known.unionByName(new))


def krylov_fates(transitions: DataFrame, ends: DataFrame, rounds: int, tolerance: float) -> DataFrame:
    """The fates by BiCGStab, all lineages side by side as columns of one vector table.

    A product with the matrix is one join of the edges with the vectors at their ends and a sum by
    start. Scalar products of all lineages come from one row of sums. Each round writes the vectors twice
    and reads them back; a lineage that has its residual stands still while others go on. No join broadcasts
    the vectors, however few: the driver gets sums and lineages only.
    """
    lineages = [r.lineage for r in ends.select("lineage").distinct().orderBy("lineage").collect()]  # a few
    every = range(len(lineages))
    edges = cut(transitions.select("src", "dst", "p").join(met(ends.select(F.col("cell_id").alias("src"))), "src", "left_anti"))
    moving = cut(leading(edges, ends).join(met(ends), "cell_id", "left_anti"))
    inner = cut(edges.join(met(moving.withColumnRenamed("cell_id", "src")), "src", "left_semi").join(met(moving.withColumnRenamed("cell_id", "dst")), "dst", "left_semi"))
    straight = edges.join(met(ends.select(F.col("cell_id").alias("dst"), "lineage")), "dst").groupBy("src").agg(*[F.sum(F.when(F.col("lineage") == l, F.col("p")).otherwise(0.0)).alias(f"r{i}") for i, l in enumerate(lineages)])
    start = moving.join(met(straight.withColumnRenamed("src", "cell_id")), "cell_id", "left")
    zero = F.lit(0.0)
    now = cut(start.select("cell_id", *[c for i in every for c in (F.coalesce(f"r{i}", zero).alias(f"r{i}"), F.coalesce(f"r{i}", zero).alias(f"h{i}"), zero.alias(f"x{i}"), zero.alias(f"p{i}"), zero.alias(f"v{i}"))]))

    def times(rows: DataFrame, of: str, to: str) -> DataFrame:
        """``rows`` with the product of I - Q and their vectors ``of`` as ``to``."""
        there = rows.select(F.col("cell_id").alias("dst"), *[f"{of}{i}" for i in every])
        sums = inner.join(met(there), "dst").groupBy(F.col("src").alias("cell_id")).agg(*[F.sum(F.col("p") * F.col(f"{of}{i}")).alias(f"y{i}") for i in every])
        return cut(rows.join(met(sums), "cell_id", "left").select(*[c for c in rows.columns if c not in {f"{to}{i}" for i in every}], *[(F.col(f"{of}{i}") - F.coalesce(f"y{i}", zero)).alias(f"{to}{i}") for i in every]))

    def products(rows: DataFrame, *pairs: str) -> list[np.ndarray]:
        r = rows.agg(*[F.coalesce(F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}")), zero) for a, b in pairs for i in every]).first()
        return [np.array(r[k * len(lineages) : (k + 1) * len(lineages)], float) for k in range(len(pairs))]

    ratio = lambda a, b: np.where(np.abs(b) > 1e-300, a / np.where(np.abs(b) > 1e-300, b, 1), 0.0)
    (size,) = products(now, "rr")
    rho, rho0, alpha, omega = size.copy(), np.ones_like(size), np.ones_like(size), np.ones_like(size)
    norm, rest = np.sqrt(size), np.sqrt(size)
    for _ in range(rounds):
        busy = rest > tolerance * np.maximum(norm, 1e-300)
        if not busy.any():
            break
        # Where the shadow vector has become useless, the lineage begins again from its residual.
        again = busy & (np.abs(rho) < 1e-12 * rest * norm)
        rho = np.where(again, rest**2, rho)
        beta = np.where(again, 0.0, ratio(rho, rho0) * ratio(alpha, omega))
        stepped = now.select("cell_id", *[c for i in every for c in (
            F.col(f"r{i}"), F.col(f"r{i}" if again[i] else f"h{i}").alias(f"h{i}"), F.col(f"x{i}"),
            (F.col(f"r{i}") + float(beta[i]) * (F.col(f"p{i}") - float(omega[i]) * F.col(f"v{i}"))).alias(f"p{i}"))])
        half = times(stepped, "p", "v")
        (hv,) = products(half, "hv")
        alpha = np.where(busy, ratio(rho, hv), 0.0)
        half = half.select("cell_id", *[c for i in every for c in (F.col(f"h{i}"), F.col(f"x{i}"), F.col(f"p{i}"), F.col(f"v{i}"), (F.col(f"r{i}") - float(alpha[i]) * F.col(f"v{i}")).alias(f"s{i}"))])
        half = times(half, "s", "t")
        ts, tt, ss, hs, ht = products(half, "ts", "tt", "ss", "hs", "ht")
        omega = np.where(busy, ratio(ts, tt), 0.0)
        now = half.select("cell_id", *[c for i in every for c in (
            (F.col(f"s{i}") - float(omega[i]) * F.col(f"t{i}")).alias(f"r{i}"), F.col(f"h{i}"), (F.col(f"x{i}") + float(alpha[i]) * F.col(f"p{i}") + float(omega[i]) * F.col(f"s{i}")).alias(f"x{i}"), F.col(f"p{i}"), F.col(f"v{i}"))])
        rho0, rho = rho, hs - omega * ht
        rest = np.where(busy, np.sqrt(np.maximum(ss - 2 * omega * ts + omega * omega * tt, 0)), rest)
    else:
        raise RuntimeError(f"fates after {rounds} rounds: a residual of {float(rest.max()):.3g}")
    entries = F.explode(F.array(*[F.struct(F.lit(l).alias("lineage"), F.greatest(F.col(f"x{i}"), zero).alias("prob")) for i, l in enumerate(lineages)])) if lineages else None
    own = ends.select("cell_id", "lineage", F.lit(1.0).alias("prob"))
    return own if entries is None else own.unionByName(now.select("cell_id", entries.alias("e")).select("cell_id", "e.*").where("prob > 1e-12"))


def solved_fates(spark, edges: pd.DataFrame, ends: pd.DataFrame, most: int = 4000, sweeps: int = 1_000_000) -> DataFrame:
    """The fates of a small graph, by sweeps over its edges (more than ``most`` cells) or a dense solution.

    Cells from which no terminal can be reached have no fate. What a cell's fates and its chance to come
    to such cells lack to one bounds the error of a sweep; ``sweeps`` of them that lack more raise.
    """
    lineages = sorted(ends["archetype"].unique())
    cells = np.unique(np.concatenate((edges["src"], edges["dst"], ends["cell_id"])))
    at, n = {c: i for i, c in enumerate(cells.tolist())}, len(cells)
    fate = np.zeros((n, len(lineages)))
    stays = np.array([at[c] for c in ends["cell_id"]], int)
    fate[stays, [lineages.index(x) for x in ends["archetype"]]] = 1
    src, dst, p = edges["src"].map(at).to_numpy(int), edges["dst"].map(at).to_numpy(int), edges["p"].to_numpy(float)
    live, seen = np.zeros(n, bool), -1
    live[stays] = True
    while seen != (seen := int(live.sum())):
        live[src[live[dst]]] = True
    walks = ~np.isin(src, stays) & live[src]
    src, dst, p = src[walks], dst[walks], p[walks]
    if n <= most:
        m = np.eye(n)
        np.add.at(m, (src, dst), -p)
        fate = np.linalg.solve(m, fate)
    else:
        fate = np.column_stack((fate, ~live))
        moving = np.unique(src)
        for i in range(sweeps):
            fate[moving] = np.stack([np.bincount(src, p * fate[dst, k], n) for k in range(fate.shape[1])], axis=1)[moving]
            if i % 10 == 0 and (lacks := (1 - fate.sum(axis=1)).max()) < 1e-9:
                break
        else:
            raise RuntimeError(f"fates after {sweeps} sweeps: a cell lacks {lacks:.3g} of its probability")
    rows = [(int(c), l, float(max(0.0, fate[i, k]))) for i, c in enumerate(cells.tolist()) for k, l in enumerate(lineages) if fate[i, k] > 1e-12]
    return spark.createDataFrame(rows, "cell_id long, lineage string, prob double")


def diagnose_fates(fates: DataFrame) -> DataFrame:
    sums = fates.groupBy("cell_id").agg(F.sum("prob").alias("s"))
    return sums.agg(F.count(F.lit(1)).alias("n_cells"), F.min("s").alias("min_sum"), F.max("s").alias("max_sum")).crossJoin(fates.agg(F.min("prob").alias("min_prob"), F.max("prob").alias("max_prob")))


def pseudotimes(fates: DataFrame, lineages: Sequence[str]) -> DataFrame:
    """cell_id and pseudotime_to_{lineage}: the fate probability."""
    return fates.groupBy("cell_id").agg(*[F.coalesce(F.max(F.when(F.col("lineage") == l, F.col("prob"))), F.lit(0.0)).alias(f"pseudotime_to_{l}") for l in lineages])


def transition_frequencies(weights: DataFrame, labels: DataFrame, fates: DataFrame, start: float = 0.5, fate: float = 0.3) -> DataFrame:
    """source, target, n: cells with a start weight above ``start`` and a fate above ``fate``.

    Sources are archetypes by weight, and archetype_0 by label.
    """
    by_weight = weights.select("cell_id", F.posexplode("w").alias("i", "x")).where(F.col("x") > start).select("cell_id", F.concat(F.lit("archetype_"), (F.col("i") + 1).cast("string")).alias("source"))
    by_label = labels.where(F.col("archetype") == CENTRAL).select("cell_id", F.lit(CENTRAL).alias("source"))
    ends = fates.where(F.col("prob") > fate).select("cell_id", F.col("lineage").alias("target"))
    return by_weight.unionByName(by_label).join(ends, "cell_id").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def single_trajectory(cells: DataFrame, labels: DataFrame, weights: DataFrame, fates: DataFrame, source: str, target: str, method: str = "discrete", weight: float = 0.4, fate: float = 0.4) -> DataFrame:
    """The cells on the way from ``source`` to ``target``: chosen by label, by weight, or both, with a fate of at least ``fate``."""
    i = int(source.rpartition("_")[2]) - 1
    by_label = labels.where(F.col("archetype") == source).select("cell_id")
    by_weight = weights.where(F.get("w", F.lit(i)) >= weight).select("cell_id")
    chosen = {"discrete": by_label, "weight": by_weight, "both": by_label.intersect(by_weight)}[method]
    ends = fates.where((F.col("lineage") == target) & (F.col("prob") >= fate)).select("cell_id", F.col("prob").alias("fate_prob"))
    return cells.join(chosen, "cell_id", "left_semi").join(ends, "cell_id").withColumn("trajectory", F.lit(f"{source}->{target}"))


def midranks(values: DataFrame, by: Sequence[str] = ("feature",), value: str = "value", name: str = "rank") -> DataFrame:
    """The rows with the midrank of their value within ``by``."""
    return O.midranks(values, list(by), value, name)


@F.pandas_udf(DoubleType())
def correlation_tail(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a rank correlation over n rows, by Student's distribution."""
    return pd.Series([special.student_two_sided(x * ((m - 2) / max(1e-300, 1 - x * x)) ** 0.5, m - 2) if x == x and m > 2 else float("nan") for x, m in zip(r, n, strict=True)])


def spearman(values: DataFrame, target: DataFrame, min_n: int = 3) -> DataFrame:
    """feature, correlation, n, pvalue of each feature of (cell_id, feature, value) with target (cell_id, y)."""
    rows = cut(values.join(target, "cell_id"))
    ranked = midranks(midranks(rows, ("feature",), "value", "rx"), ("feature",), "y", "ry")
    out = ranked.groupBy("feature").agg(F.corr("rx", "ry").alias("correlation"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    return out.withColumn("pvalue", correlation_tail("correlation", F.col("n").cast("double")))


def lineage_drivers(values: DataFrame, fates: DataFrame, lineage: str, n_genes: int = 100) -> DataFrame:
    """The features that correlate most with the fate of a lineage."""
    target = fates.where(F.col("lineage") == lineage).select("cell_id", F.col("prob").alias("y"))
    return spearman(values, target).withColumn("lineage", F.lit(lineage)).orderBy(F.desc("correlation"), "feature").limit(n_genes)
