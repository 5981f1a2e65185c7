"""Order statistics and ranks against numpy, with ties, empty groups and groups over many partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplark.operators import order as O


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [("even", float(rng.randrange(40))) for _ in range(3000)] + [("wide", rng.lognormvariate(0, 30)) for _ in range(2000)] + [("tied", 1.0)] * 1500 + [(None, -float(i)) for i in range(7)]
    rows += [("one", 5.0), ("none", None), ("none", float("nan")), ("tied", 0.0), ("tied", 2.0)]
    return rows, spark.createDataFrame([(g, x, i) for i, (g, x) in enumerate(rows)], "g string, x double, i long").repartition(5).cache()


def grouped(rows):
    out = {}
    for g, x in rows:
        if x is not None and x == x:
            out.setdefault(g, []).append(x)
    return out


@pytest.mark.parametrize("splitters,gathered", [(500, 10_000), (4, 3)])
def test_quantiles_are_exact(spark, values, splitters, gathered, monkeypatch):
    monkeypatch.setattr(O, "SPLITTERS", splitters)
    monkeypatch.setattr(O, "GATHERED", gathered)
    shares = [0.0, 0.01, 0.37, 1.0] if gathered < 100 else [0.0, 0.01, 0.2, 0.5, 0.77, 1.0]
    got = {(r.g, r.share): r.value for r in O.quantiles(values[1], ["g"], "x", shares).collect()}
    assert got == {(g, s): pytest.approx(np.quantile(x, s), rel=1e-12, abs=1e-300) for g, x in grouped(values[0]).items() for s in shares}


def test_kth_of_one_group_and_of_no_rows(spark, values):
    wanted = spark.createDataFrame([(0,), (3500,), (99_999,), (-1,)], "k long")
    flat = sorted(x for xs in grouped(values[0]).values() for x in xs)
    assert {r.k: r.value for r in O.kth_values(values[1], [], "x", wanted).collect()} == {0: flat[0], 3500: flat[3500]}
    assert O.kth_values(values[1].limit(0), ["g"], "x", spark.createDataFrame([("a", 0)], "g string, k long")).count() == 0


def test_a_sketch_that_misses_is_put_right(spark, values, monkeypatch):
    # Splitters of the wrong half: the exact counts move the range back.
    monkeypatch.setattr(O, "SPLITTERS", 4)
    monkeypatch.setattr(O, "GATHERED", 3)
    sketch = F.percentile_approx
    monkeypatch.setattr(O.F, "percentile_approx", lambda c, shares, accuracy: sketch(c, [s / 2 for s in shares], accuracy))
    got = O.quantiles(values[1].where("g = 'even'"), ["g"], "x", [0.9]).first().value
    assert got == np.quantile(grouped(values[0])["even"], 0.9)


def test_ranks_over_many_partitions(spark, values):
    rows = values[1].where("x IS NOT NULL AND NOT isnan(x)")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = O.midranks(rows, ["g"], "x").collect()
        placed = O.places(rows, ["g"], ["x", "i"]).collect()
        # Values that tie, ordered by value alone, lie on both sides of borders between partitions when ids take part.
        totals = O.running_totals(rows.withColumn("two", F.lit(2)), ["g"], ["x", "i"], ["two", "i"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, xs in grouped(values[0]).items():
        xs = sorted(xs)
        for r in (r for r in ranked if r.g == g):
            assert r["rank"] == np.searchsorted(xs, r.x) + (xs.count(r.x) + 1) / 2 if len(xs) < 10 else abs(r["rank"] - (np.searchsorted(xs, r.x, "left") + np.searchsorted(xs, r.x, "right") + 1) / 2) < 1e-9
        own = sorted((r for r in placed if r.g == g), key=lambda r: (r.x, r.i))
        assert [r.place for r in own] == list(range(len(xs)))
        own = sorted((r for r in totals if r.g == g), key=lambda r: (r.x, r.i))
        assert [r.two_before for r in own] == [2 * k for k in range(len(xs))] and [r.i_before for r in own] == np.concatenate(([0], np.cumsum([r.i for r in own])[:-1])).tolist()
