"""Permutation tests and cross-correlations over neighbour graphs.

A permutation of the cells is a keyed bijection of their numbers: a Feistel network over the next even
number of bits, walked on until the number is one of a cell. So each permutation gives a cell its
partner by arithmetic alone; no labels are shuffled, nothing is drawn, and every task, and any
other program, comes to the same partners. All permutations' sums come from one pass over the edges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplark.functions import special
from simplark.operators import graph as G
from simplark.operators import order as O
from simplark.sources.shared import cut

ROUNDS = 4
#: Numbers (cells x features) that travel with tasks; beyond, blocks of so many meet in pairs, of so many cells at least.
HELD, LEAST_ROWS = 4_000_000, 16
#: Edges that a task works on at a time, that are dealt to blocks at a time, and times permutations of a group.
STRETCH, DEALT, GROUP_EDGES = 1024, 65_536, 4_000_000
SUMS = "p int, f int, near double, apart double"


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """The finaliser of a common 64-bit generator, keyed."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def partners(numbers: np.ndarray, n: int, permutation: int, seed: int = 0) -> np.ndarray:
    """Where a permutation of 0 ... n - 1 sends the numbers."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in range(ROUNDS):
            left, right = right, left ^ (mixed(right, (seed << 40) + (permutation << 8) + k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def edge_sums(z_of, permutations: int, features: int):
    """For batches of edges: (permutation, feature, sum of w z z', sum of w (z - z')^2); permutation -1 is the cells as they are."""

    def run(batches):
        near, apart = np.zeros((permutations + 1, features)), np.zeros((permutations + 1, features))
        for batch in (b.slice(i, STRETCH) for b in batches for i in range(0, b.num_rows, STRETCH)):
            for p, w, a, b in z_of(batch):
                near[p + 1] += w @ (a * b)
                apart[p + 1] += w @ (a - b) ** 2
        p, f = np.divmod(np.arange(near.size), features)
        yield pa.RecordBatch.from_arrays([pa.array(p - 1, pa.int32()), pa.array(f, pa.int32()), pa.array(near.ravel()), pa.array(apart.ravel())], names=["p", "f", "near", "apart"])

    return run


def permuted_sums(edges: DataFrame, table: DataFrame, n: int, features: int, permutations: int, seed: int, held: int = HELD) -> DataFrame:
    """p, f, near, apart over all edges (i, j, w: numbers of cells), with the deviations ``z`` of ``table`` (number, z)."""
    spark = edges.sparkSession
    if n * features <= held:
        z = np.zeros((n, features))
        for r in table.toLocalIterator():  # at most ``held`` numbers
            z[r.number] = r.z
        values = spark.sparkContext.broadcast(z)

        def z_of(batch):
            i, j, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            for p in range(-1, permutations):
                a, b = (i, j) if p < 0 else (partners(i, n, p, seed), partners(j, n, p, seed))
                yield p, w, values.value[a], values.value[b]

        return totals(edges.select("i", "j", "w").mapInArrow(edge_sums(z_of, permutations, features), SUMS))
    return totals(dealt_sums(edges, table, n, features, permutations, seed, max(LEAST_ROWS, held // features)))


def totals(sums: DataFrame) -> DataFrame:
    return sums.groupBy("p", "f").agg(F.sum("near").alias("near"), F.sum("apart").alias("apart"))


def dealt_sums(edges: DataFrame, table: DataFrame, n: int, features: int, permutations: int, seed: int, rows: int) -> DataFrame:
    """``permuted_sums`` where no task holds the whole table: blocks of ``rows`` cells meet in pairs.

    An edge goes, for each permutation, to the blocks of its two partners: as two packed numbers and a weight, so that
    values never travel with edges. A group is a pair of blocks and some permutations, about ``GROUP_EDGES`` edges.
    """
    blocks = -(-n // rows)
    chunks = min(permutations + 1, max(1, -(-edges.count() * (permutations + 1) // (GROUP_EDGES * blocks * (blocks + 1) // 2))))
    each = -(-(permutations + 1) // chunks)

    def stretches(batches):
        some, size = [], 0
        for batch in (b.slice(k, DEALT) for b in batches for k in range(0, b.num_rows, DEALT)):
            some.append(batch)
            size += batch.num_rows
            if size >= DEALT:
                yield pa.Table.from_batches(some)
                some, size = [], 0
        if some:
            yield pa.Table.from_batches(some)

    def deal(batches):
        for stretch in stretches(batches):
            i, j, w = (stretch.column(c).to_numpy() for c in range(3))
            (i, of_i), (j, of_j) = (np.unique(x, return_inverse=True) for x in (i, j))
            for first in range(-1, permutations, each):
                for p in range(first, min(first + each, permutations)):
                    a, b = ((x if p < 0 else partners(x, n, p, seed))[at] for x, at in ((i, of_i), (j, of_j)))
                    a, b = np.minimum(a, b), np.maximum(a, b)
                    key = a // rows * blocks + b // rows
                    order = np.argsort(key, kind="stable")
                    key, a, b = key[order], (a % rows).astype(np.int32)[order], (b % rows).astype(np.int32)[order]
                    starts = np.flatnonzero(np.diff(key, prepend=-1))
                    ends, x = np.append(starts[1:], len(key)), w[order]
                    one, two = np.divmod(key[starts], blocks)
                    packed = [[v[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] for v in (a, b, x)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one, pa.int32()), pa.array(two, pa.int32()), pa.array(np.full(len(starts), (first + 1) // each, np.int32)), pa.array(np.full(len(starts), p, np.int32)), *(pa.array(v, pa.binary()) for v in packed)],
                        names=["one", "two", "chunk", "p", "a", "b", "w"],
                    )

    sent = edges.select("i", "j", "w").mapInArrow(deal, "one int, two int, chunk int, p int, a binary, b binary, w binary")
    block = F.floor(F.col("number") / rows).cast("int")
    # A block meets itself and all others, as the first or the second of a pair.
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, block).alias("one"), F.greatest(o, block).alias("two")))
    held = table.select(F.explode(meets).alias("pair"), block.alias("block"), (F.col("number") - block * rows).cast("int").alias("at"), "z")
    held = held.select("pair.*", F.explode(F.sequence(F.lit(0), F.lit(-(-(permutations + 1) // each) - 1))).alias("chunk"), "block", "at", "z")

    def meet(key: tuple, values: pa.Table, links: pa.Table) -> pa.Table:
        one, two = key[0].as_py(), key[1].as_py()
        z = {k: np.zeros((rows if k < blocks - 1 else n - k * rows, features)) for k in (one, two)}
        for batch in values.to_batches():
            own, at, x = batch.column("block").to_numpy(), batch.column("at").to_numpy(), batch.column("z").flatten().to_numpy().reshape(batch.num_rows, features)
            for k in z:
                z[k][at[own == k]] = x[own == k]
        near, apart = np.zeros((permutations + 1, features)), np.zeros((permutations + 1, features))
        for p, *packed in zip(*(links.column(c) for c in ("p", "a", "b", "w")), strict=True):
            a, b, w = (np.frombuffer(v.as_buffer(), t) for v, t in zip(packed, (np.int32, np.int32, float), strict=True))
            for k in range(0, len(w), STRETCH):
                x, y, s = z[one][a[k : k + STRETCH]], z[two][b[k : k + STRETCH]], w[k : k + STRETCH]
                near[p.as_py() + 1] += s @ (x * y)
                apart[p.as_py() + 1] += s @ (x - y) ** 2
        some = np.unique(links.column("p").to_numpy()) if links.num_rows else np.zeros(0, int)
        p, f = np.repeat(some, features), np.tile(np.arange(features), len(some))
        return pa.table({"p": pa.array(p, pa.int32()), "f": pa.array(f, pa.int32()), "near": near[some + 1].ravel(), "apart": apart[some + 1].ravel()})

    keys = ["one", "two", "chunk"]
    return held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, SUMS)


def permutation_test(edges: DataFrame, values: DataFrame, permutations: int = 100, seed: int = 0, held: int = HELD) -> DataFrame:
    """``graph.autocorrelation`` with what the permutations say of each feature.

    Beside its columns: var_random, the exact variance of Moran's I over all permutations; for I and Geary's C the mean
    and population variance over the drawn ones (moran_mean, moran_var, ...), z_sim and its one-sided p, and p_sim: how many
    permutations are as extreme on the side where fewer are, with one added to both. Values are long
    (cell_id, feature, value); a cell without a value of a feature has its mean.
    """
    plain = cut(G.autocorrelation(edges, values))
    names = [r.feature for r in values.select("feature").distinct().orderBy("feature").collect()]
    stats = cut(values.groupBy("feature").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss")))
    cells = cut(O.places(values.select("cell_id").distinct(), [], ["cell_id"], "number"))
    n = cells.count()
    numbered = values.join(F.broadcast(stats.select("feature", "m")), "feature").join(F.broadcast(edges.sparkSession.createDataFrame(list(enumerate(names)), "f int, feature string")), "feature")
    found = numbered.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("f", (F.col("value") - F.col("m")).alias("z")))).alias("z"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: F.coalesce(F.element_at("z", i), F.lit(0.0)))
    table = cut(cells.join(found, "cell_id").select("number", dense.alias("z")))
    by_number = lambda c, to: cells.select(F.col("cell_id").alias(c), F.col("number").alias(to))
    links = cut(edges.join(by_number("src", "i"), "src").join(by_number("dst", "j"), "dst").select("i", "j", F.col("w").cast("double").alias("w")))
    graph = weights_of(links)
    sums = cut(permuted_sums(links, table, n, len(names), permutations, seed, held))
    moments = table.select(F.posexplode("z").alias("f", "x")).groupBy("f").agg(F.sum(F.col("x") ** 4).alias("q4"))
    one = stats.join(edges.sparkSession.createDataFrame(list(enumerate(names)), "f int, feature string"), "feature").join(moments, "f")
    w, s1, s2 = graph
    t = sums.join(F.broadcast(one), "f").select("feature", "p", (F.col("n") / w * F.col("near") / F.col("ss")).alias("moran"), ((F.col("n") - 1) / (2 * w) * F.col("apart") / F.col("ss")).alias("geary"))
    seen = t.where("p < 0").select("feature", F.col("moran").alias("moran_0"), F.col("geary").alias("geary_0"))
    drawn = t.where("p >= 0").join(seen, "feature")
    sides = [F.count_if(F.col(c) >= F.col(f"{c}_0")).alias(f"{c}_over") for c in ("moran", "geary")]
    by = drawn.groupBy("feature", "moran_0", "geary_0").agg(F.count(F.lit(1)).alias("k"), *sides, *[f(c).alias(f"{c}_{name}") for c in ("moran", "geary") for name, f in (("mean", F.avg), ("var", F.var_pop))])
    for c in ("moran", "geary"):
        fewer = F.when(F.col(f"{c}_over") * 2 > F.col("k"), F.col("k") - F.col(f"{c}_over")).otherwise(F.col(f"{c}_over"))
        by = by.withColumn(f"{c}_p_sim", (fewer + 1) / (F.col("k") + 1)).withColumn(f"{c}_z_sim", F.when(F.col(f"{c}_var") > 0, (F.col(f"{c}_0") - F.col(f"{c}_mean")) / F.sqrt(f"{c}_var")).otherwise(0.0))
        by = by.withColumn(f"{c}_p_z_sim", F.expr(special.upper_sql(f"abs({c}_z_sim)")))
    m = F.col("n").cast("double")
    b2 = F.col("q4") / m / (F.col("ss") / m) ** 2
    square = (m * ((m * m - 3 * m + 3) * s1 - m * s2 + 3 * w * w) - b2 * ((m * m - m) * s1 - 2 * m * s2 + 6 * w * w)) / ((m - 1) * (m - 2) * (m - 3) * w * w)
    exact = one.select("feature", F.when(m > 3, square - 1 / (m - 1) ** 2).alias("var_random"))
    return plain.join(exact, "feature").join(by.drop("moran_0", "geary_0", "k", "moran_over", "geary_over"), "feature")


def weights_of(links: DataFrame) -> tuple[float, float, float]:
    """The sum of the weights, and the two sums S1 and S2 of the variance."""
    total = links.agg(F.sum("w")).first()[0] or 0.0
    both = links.unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    s1 = both.agg((F.sum(F.col("w") ** 2) / 2)).first()[0] or 0.0
    s2 = both.groupBy("i").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") ** 2)).first()[0] or 0.0
    return float(total), float(s1), float(s2)


def cross_correlations(edges: DataFrame, cells: DataFrame, weights: DataFrame, types: Sequence[str], cell_type: str = "cell_type", more_than: int = 50) -> DataFrame:
    """archetype, spearman_r, pvalue, n_cells, mean_weight_a, mean_weight_b: rank correlation of the mean weights of a cell's neighbours of two types, by archetype.

    Over the cells that have neighbours of both; with no more than ``more_than`` of them there is no row.
    """
    means = G.neighbour_means(edges, cells, weights, list(types), cell_type)
    long = means.select("cell_id", "type", F.posexplode("mean").alias("i", "x"))
    both = long.groupBy("cell_id", "i").agg(*[F.max(F.when(F.col("type") == t, F.col("x"))).alias(c) for t, c in zip(types, ("a", "b"), strict=True)]).where("a IS NOT NULL AND b IS NOT NULL")
    rows = cut(both.select("cell_id", F.concat(F.lit("archetype_"), F.col("i").cast("string")).alias("feature"), F.col("a").alias("value"), F.col("b").alias("y")))
    ranked = O.midranks(O.midranks(rows, ["feature"], "value", "rx"), ["feature"], "y", "ry")
    found = ranked.groupBy("feature").agg(F.corr("rx", "ry").alias("spearman_r"), F.count(F.lit(1)).alias("n_cells"), F.avg("value").alias("mean_weight_a"), F.avg("y").alias("mean_weight_b")).where(F.col("n_cells") > more_than)
    return found.select(F.col("feature").alias("archetype"), "spearman_r", G.correlation_tail("spearman_r", F.col("n_cells").cast("double")).alias("pvalue"), "n_cells", "mean_weight_a", "mean_weight_b")
