"""Order statistics and ranks of values that no single task could sort.

``kth_values`` finds the k-th smallest values of any number of groups by narrowing counts: a pass
counts the values below and inside each wanted one's range, and splitters of the range, taken from a
mergeable sketch, give the next, some hundreds of times narrower. The counts are exact and decide alone:
where a sketch missed, the range moves to the side where the value is. A range of one value, or
few enough values to gather, ends it. So a thousand million values take three passes, and what is
shuffled is a sketch for each task and range.

``running_totals`` adds columns up along an order within groups, for ranks and distribution
functions: rows are dealt by ranges of (group, order) over all partitions and sorted there, each
partition adds up its own runs in Arrow batches, and a small table of what earlier partitions hold
of each group closes the borders. ``midranks`` ranks rows by that, through the counts of distinct
values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplark.sources.shared import BROADCAST_ROWS, cut, small

#: Splitters of a range, the sketch's accuracy, and how many values of a range are gathered.
SPLITTERS, ACCURACY, GATHERED = 500, 10_000, 10_000


def same(a: str, b: str, columns: Sequence[str]) -> Column:
    """Rows of ``a`` and ``b`` that agree in the columns, null being like null."""
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))


def kth_values(values: DataFrame, by: Sequence[str], column: str, wanted: DataFrame, rounds: int = 60, written: bool = False) -> DataFrame:
    """by, k, value: the k-th smallest value (from 0) of each row of ``wanted`` (by, k: long).

    Values that are null or NaN don't count. Places that a group doesn't have give no row. Values that are ``written``
    already are read again by each pass instead of being written once more.
    """
    x = F.col(column).cast("double")
    rows = values.select(*by, x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    rows = rows if written else cut(rows)
    names = [*by, "k"]
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    asked = wanted.select(*by, F.col("k").cast("long").alias("k")).distinct().alias("w").join(sizes.alias("s"), same("w", "s", by))
    # lo0 and hi0: the widest the range may be, in which the value surely is.
    ends = {"lo": F.col("s.lo"), "hi": F.col("s.hi"), "lo0": F.col("s.lo"), "hi0": F.col("s.hi")}
    asked = cut(asked.where("k >= 0 AND k < size").select(*[F.col(f"w.{c}").alias(c) for c in names], "size", *[v.alias(c) for c, v in ends.items()]))

    def gathered(met: DataFrame, before: str) -> DataFrame:
        """The wanted values among few, which are sorted in place; ``before`` is how many come before those."""
        of = met.groupBy(*[F.col(f"s.{c}").alias(c) for c in names], before).agg(F.sort_array(F.collect_list("x")).alias("values"))
        return of.select(*names, F.get("values", (F.col("k") - F.col(before)).cast("int")).alias("value"))

    few = asked.where(F.col("size") <= GATHERED).withColumn("none", F.lit(0).cast("long"))
    done = gathered(rows.alias("r").join(few.alias("s"), same("r", "s", by)), "none")
    state = asked.where(F.col("size") > GATHERED).drop("size")
    for _ in range(rounds):
        done = done.unionByName(state.where("lo = hi").select(*names, F.col("lo").alias("value")))
        state = state.where("lo < hi")
        n = state.count()
        if not n:
            return cut(done)
        met = rows.alias("r").join(F.broadcast(state).alias("s") if n <= BROADCAST_ROWS else state.alias("s"), same("r", "s", by))
        k, lo, hi = F.col("k"), F.col("lo"), F.col("hi")
        inner = F.when((F.col("x") > lo) & (F.col("x") < hi), F.col("x"))
        # What is below, on either end, and between them; all of it is counted, the splitters alone are rough.
        counts = met.where("x <= hi").groupBy(*[F.col(f"s.{c}").alias(c) for c in (*names, "lo", "hi", "lo0", "hi0")]).agg(
            F.count_if(F.col("x") < lo).alias("below"), F.count_if(F.col("x") <= lo).alias("upto"), F.count(inner).alias("n"), F.count(F.lit(1)).alias("all"),
            F.percentile_approx(inner, [i / SPLITTERS for i in range(SPLITTERS + 1)], ACCURACY).alias("split"),
        )
        counts = cut(counts)
        after = F.col("upto") + F.col("n")
        done = done.unionByName(counts.where((k >= F.col("below")) & (k < F.col("upto"))).select(*names, lo.alias("value")))
        done = done.unionByName(counts.where((k >= after) & (k < F.col("all"))).select(*names, hi.alias("value")))
        between = (k >= F.col("upto")) & (k < after)
        last = counts.where(between & (F.col("n") <= GATHERED)).drop("split")
        last = F.broadcast(last) if n <= BROADCAST_ROWS else last
        done = done.unionByName(gathered(rows.alias("r").join(last.alias("s"), same("r", "s", by)).where("x > lo AND x < hi"), "upto"))
        at = F.floor((k - F.col("upto")) * SPLITTERS / F.col("n")).cast("int")
        lower, upper = F.get("split", F.greatest(at - 1, F.lit(0))), F.get("split", F.least(at + 2, F.lit(SPLITTERS)))
        # Between the ends: the range becomes the widest, its splitters the next. A miss goes to the side where the value is.
        side = lambda inside, below, above: F.when(between, inside).when(k < F.col("below"), below).otherwise(above)
        ends = {"lo": side(lower, F.col("lo0"), hi), "hi": side(upper, lo, F.col("hi0")), "lo0": side(lo, F.col("lo0"), hi), "hi0": side(hi, lo, F.col("hi0"))}
        rest = counts.where(between & (F.col("n") > GATHERED) | (k < F.col("below")) | (k >= F.col("all")))
        state = cut(rest.select(*names, *[v.alias(c) for c, v in ends.items()]))
    raise RuntimeError(f"order statistics haven't been found after {rounds} passes")


def quantiles(values: DataFrame, by: Sequence[str], column: str, shares: Sequence[float], written: bool = False) -> DataFrame:
    """by, share, value: exact quantiles, between two values in proportion; groups without values give no row."""
    x = F.col(column).cast("double")
    sizes = values.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    at = cut(sizes.select(*by, F.explode(F.lit([float(s) for s in shares])).alias("share"), "size").select(*by, "share", ((F.col("size") - 1) * F.col("share")).alias("at")))
    lower, upper = F.floor("at"), F.ceil("at")
    values_at = small(kth_values(values, by, column, at.select(*by, F.explode(F.array(lower, upper)).alias("k")), written=written))
    one = at.alias("a").join(values_at.alias("l"), same("a", "l", by) & (F.floor("a.at") == F.col("l.k")))
    both = one.join(values_at.alias("u"), same("a", "u", by) & (F.ceil("a.at") == F.col("u.k")))
    between = F.when(F.col("l.k") == F.col("u.k"), F.col("l.value")).otherwise((F.col("u.k") - F.col("a.at")) * F.col("l.value") + (F.col("a.at") - F.col("l.k")) * F.col("u.value"))
    return both.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.share").alias("share"), between.alias("value"))


def local_totals(groups: int, columns: int):
    """Adds to sorted batches the partition's number, and before each row what its group had of each column in this partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        key, carried = None, np.zeros(columns)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            starts = np.zeros(n, bool)
            for c in batch.columns[:groups]:
                a, b = c.slice(1), c.slice(0, n - 1)
                differ = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
                starts[1:] |= differ & ~(pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
            first = [c[0].as_py() for c in batch.columns[:groups]]
            starts[0] = first != key
            run_of = np.cumsum(starts)
            at = np.flatnonzero(starts)
            made = []
            for j, c in enumerate(batch.columns[len(batch.columns) - columns :]):
                v = c.to_numpy(zero_copy_only=False).astype(float)
                sums = np.cumsum(v)
                base = np.concatenate(([-carried[j]], sums[at] - v[at]))
                before = sums - v - base[run_of]
                carried[j] = before[-1] + v[-1]
                made.append(pa.array(before))
            key = [c[n - 1].as_py() for c in batch.columns[:groups]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), *made], names=[*batch.schema.names, "part", *[f"before{j}" for j in range(columns)]])

    return run


def running_totals(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``rows`` with ``{c}_before`` of each of ``columns``: its sum (double) over the rows of the group that come earlier.

    Rows that agree in group and order stand in no particular order among themselves. No task holds more than a range of the rows.
    """
    shaped = rows.select(*[c for c in rows.columns if c not in (*by, *columns)], *by, *columns).select(*by, *[c for c in rows.columns if c not in (*by, *columns)], *columns)
    sort = [*by, *order]
    # Arrow functions take plain column names.
    plain = shaped.toDF(*[f"c{i}" for i in range(len(shaped.columns))])
    place = [f"c{shaped.columns.index(c)}" for c in sort]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema), "part int", *(f"before{j} double" for j in range(len(columns)))])
    dealt = plain.repartitionByRange(*place).sortWithinPartitions(*place)
    local = cut(dealt.mapInArrow(local_totals(len(by), len(columns)), schema))
    keys = [f"c{i}" for i in range(len(by))]
    own = [f"c{shaped.columns.index(c)}" for c in columns]
    sums = local.groupBy("part", *keys).agg(*[F.sum(F.col(c).cast("double")).alias(f"s{j}") for j, c in enumerate(own)])
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition and each group: what the partitions before it have of the group.
    border = small(sums.select("part", *keys, *[F.coalesce(F.sum(f"s{j}").over(earlier), F.lit(0.0)).alias(f"s{j}") for j in range(len(columns))]))
    met = local.alias("r").join(border.alias("s"), (F.col("r.part") == F.col("s.part")) & same("r", "s", keys))
    return met.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(shaped.columns)], *[(F.col(f"r.before{j}") + F.col(f"s.s{j}")).alias(f"{c}_before") for j, c in enumerate(columns)]).select(*rows.columns, *[f"{c}_before" for c in columns])


def midrank_table(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, ties, midrank of each distinct value within its group."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return running_totals(counts, by, [value], ["ties"]).select(*by, value, "ties", (F.col("ties_before") + (F.col("ties") + 1) / 2).alias("midrank"))


def midranks(rows: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """The rows with the midrank of their value within ``by``; values that many rows share are split by Spark's skewed joins."""
    table = midrank_table(rows, by, value).select(*by, value, F.col("midrank").alias(name))
    met = rows.alias("r").join(table.alias("t"), same("r", "t", [*by, value]))
    return met.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], F.col(f"t.{name}").alias(name))


def places(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """The rows with their place (from 0) within ``by``, in an order that should be without ties."""
    counted = running_totals(rows.withColumn("one_", F.lit(1)), by, order, ["one_"])
    return counted.select(*rows.columns, F.col("one__before").cast("long").alias(name))
