"""Patterns of archetypes: contrasts of some high bins with some low ones."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplark.operators import order as O
from simplark.operators import stats as S
from simplark.operators.archetypes import CENTRAL, NONE
from simplark.sources.shared import cut

#: What the values of a feature add up to for a pattern: sums and squares of both sides, U, ties, values other than zero; largest, smallest positive value.
PARTS = ("s1", "s2", "q1", "q2", "u", "ties", "z1", "z2", "top", "low_value")
#: Rows that are worked on at a time.
STRETCH = 4096
PATTERN_SCHEMA = "pattern_name string, pattern_code string, pattern_type string, complexity int, high array<string>, low array<string>"


def suffix(name: str, position: int) -> str:
    """The archetype's number, or a letter where its name has none."""
    m = re.search(r"(\d+)$", name)
    return m[1] if m else chr(ord("A") + position)


def pattern_code(high: Sequence[str], low: Sequence[str], everyone: Sequence[str]) -> str:
    """Each archetype's number on its side of the underscore, x elsewhere."""
    ordered = sorted(everyone)
    sides = ("".join(suffix(a, i) if a in side else "x" for i, a in enumerate(ordered)) for side in (high, low))
    return "_".join(sides)


def enumerate_patterns(names: Sequence[str], specialization: bool = True, tradeoff: bool = True, max_size: int | None = None, exclude_central: bool = True, specific: Sequence[str] | None = None) -> list[dict]:
    """All patterns over the archetypes ``names``, by type, complexity and code.

    Specialisation sets one archetype against the central bin, tradeoffs set disjoint groups of at
    most ``max_size`` against each other. With the central bin kept there is a second set of
    tradeoffs without it. ``specific`` are specifications like 1v23 (or 1,12v3).
    """
    names = sorted(n for n in names if n != NONE)
    others = [n for n in names if n != CENTRAL]

    def made(high, low, kind, tail="") -> dict:
        code = pattern_code(high, low, names)
        readable = "+".join(high) + "_vs_" + "+".join(low)
        return {"pattern_name": f"{kind}_{readable}{tail}", "pattern_code": code, "pattern_type": kind, "complexity": len(high) + len(low), "high": list(high), "low": list(low)}

    if specific:
        out = []
        for spec in specific:
            sides = [x.split(",") if "," in x else list(x) for x in spec.split("v")]
            groups = [[f"archetype_{i}" for i in side] for side in sides]
            if len(groups) == 2 and all(a in names for g in groups for a in g):
                out.append(made(*groups, "custom"))
        return out
    out = [made([a], [CENTRAL], "specialization") for a in others] if specialization and CENTRAL in names else []
    if tradeoff:
        sets = [(others, "_nonzero")] if CENTRAL in names and exclude_central else [(names, "")]
        if CENTRAL in names and not exclude_central:
            sets.append((others, "_nonzero"))
        for members, tail in sets:
            size = min(len(members) // 2, 3) if max_size is None else max_size
            for h in range(1, size + 1):
                for high in combinations(members, h):
                    rest = [a for a in members if a not in high]
                    for l in range(1, min(size, len(rest)) + 1):
                        out += [made(high, low, "tradeoff", tail) for low in combinations(rest, l)]
    order = {"specialization": 0, "tradeoff": 1}
    return sorted(out, key=lambda p: (order.get(p["pattern_type"], 2), p["complexity"], p["pattern_code"], p["pattern_name"]))


def pattern_table(spark: SparkSession, patterns: list[dict]) -> DataFrame:
    rows = [tuple(p[c] for c in ("pattern_name", "pattern_code", "pattern_type", "complexity", "high", "low")) for p in patterns]
    return spark.createDataFrame(rows, PATTERN_SCHEMA)


def folded(high: np.ndarray, low: np.ndarray):
    """For batches of (feature, value, n of each set of bins, the same before): what each pattern adds up over the rows of a feature.

    ``high`` and ``low`` have a row for each set and a column for each pattern: one where the set is on that side.
    """
    sets, patterns = high.shape

    def run(batches):
        for batch in (b.slice(i, STRETCH) for b in batches for i in range(0, b.num_rows, STRETCH)):
            feature = batch.column(0)
            x = batch.column(1).to_numpy(zero_copy_only=False)[:, None]
            n, before = (np.stack([batch.column(2 + at + j).to_numpy(zero_copy_only=False).astype(float) for j in range(sets)], axis=1) for at in (0, sets))
            a, b, below = n @ high, n @ low, before @ low
            c, there = a + b, x != 0
            starts = np.flatnonzero(np.concatenate(([True], pc.not_equal(feature.slice(1), feature.slice(0, len(feature) - 1)).to_numpy(zero_copy_only=False))))
            total = lambda v: np.add.reduceat(v, starts).ravel()
            made = [total(v) for v in (a * x, b * x, a * x * x, b * x * x, a * (below + b / 2), c * c * c - c, a * there, b * there)]
            made.append(np.maximum.reduceat(np.where(c > 0, x, -np.inf), starts).ravel())
            made.append(np.minimum.reduceat(np.where((c > 0) & (x > 0), x, np.inf), starts).ravel())
            names = feature.take(pa.array(np.repeat(starts, patterns)))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(patterns, dtype=np.int32), len(starts))), *(pa.array(v) for v in made)], names=["feature", "pattern", *PARTS])

    return run


def pattern_associations(values: DataFrame, binned: DataFrame, patterns: DataFrame, min_cells: int = 10, min_effect: float = 0.01, raw: bool = False, min_nonzero: float = 0.05) -> DataFrame:
    """Rank-sum tests of the union of a pattern's high bins with that of its low bins, for every feature.

    ``binned`` has a row for each (cell_id, archetype) membership. Cells are counted by the set of bins
    that they are in, feature and distinct value, with a column for each set; sums along the values
    turn that into cumulative counts (``order.running_totals``). All patterns are worked out from those
    in one pass as products with two small matrices, so a row is made for a feature and a pattern, never
    for a value and a pattern. Patterns and the sets that occur are few and known to the driver.
    log_fold_change is that of ``stats.fold_change`` where ``raw``, else the difference of means. Features
    with less than ``min_nonzero`` of values other than zero on both sides have statistic 0 and p 1.
    """
    spark = values.sparkSession
    sets = cut(binned.groupBy("cell_id").agg(F.sort_array(F.collect_set("archetype")).alias("bins")))
    kinds = [(list(r.bins), r.n) for r in sets.groupBy("bins").agg(F.count(F.lit(1)).alias("n")).orderBy("bins").collect()]
    wanted = patterns.select("pattern_name", "high", "low").orderBy("pattern_name").collect()
    high = np.array([[float(bool(set(bins) & set(p.high))) for p in wanted] for bins, _ in kinds]).reshape(len(kinds), len(wanted))
    low = np.array([[float(bool(set(bins) & set(p.low))) for p in wanted] for bins, _ in kinds]).reshape(len(kinds), len(wanted)) * (1 - high)
    cells = np.array([n for _, n in kinds], float)
    large = np.flatnonzero((cells @ high >= min_cells) & (cells @ low >= min_cells))
    used = np.flatnonzero((high[:, large] + low[:, large]).any(1)) if len(large) else large
    info = patterns.select("pattern_name", "pattern_code", "pattern_type", "complexity", F.array_join("high", ",").alias("high_archetypes"), F.array_join("low", ",").alias("low_archetypes"))
    places = [int(s) for s in used]
    numbered = spark.createDataFrame([(kinds[s][0], j, kinds[s][1]) for j, s in enumerate(places)], "bins array<string>, kind int, cells long")
    known = sets.join(F.broadcast(numbered.select("bins", "kind")), "bins").select("cell_id", "kind")
    seen = cut(values.where("value <> 0").join(known, "cell_id").groupBy("feature", "value", "kind").agg(F.count(F.lit(1)).alias("n")))
    filled = seen.groupBy("feature", "kind").agg(F.sum("n").alias("nnz"))
    grid = filled.select("feature").distinct().crossJoin(F.broadcast(numbered.select("kind", "cells")))
    zeros = grid.join(filled, ["feature", "kind"], "left").select("feature", F.lit(0.0).alias("value"), "kind", (F.col("cells") - F.coalesce("nnz", F.lit(0))).alias("n")).where("n > 0")
    names = [f"n{j}" for j in range(len(places))]
    wide = seen.unionByName(zeros).groupBy(F.col("feature").cast("string").alias("feature"), F.col("value").cast("double").alias("value")).agg(*[F.sum(F.when(F.col("kind") == j, F.col("n")).otherwise(0)).alias(c) for j, c in enumerate(names)])
    totals = O.running_totals(wide, ["feature"], ["value"], names)
    columns = totals.select("feature", "value", *names, *[f"{c}_before" for c in names])
    parts = columns.mapInArrow(folded(high[np.ix_(used, large)], low[np.ix_(used, large)]), "feature string, pattern int, " + ", ".join(f"{c} double" for c in PARTS)) if names else spark.createDataFrame([], "feature string, pattern int, " + ", ".join(f"{c} double" for c in PARTS))
    sums = parts.groupBy("feature", "pattern").agg(*[F.sum(c).alias(c) for c in PARTS[:-2]], F.max("top").alias("top"), F.min("low_value").alias("low_value"))
    sizes = spark.createDataFrame([(i, wanted[p].pattern_name, float(cells @ high[:, p]), float(cells @ low[:, p])) for i, p in enumerate(large.tolist())], "pattern int, pattern_name string, n1 double, n2 double")
    t = sums.join(F.broadcast(sizes), "pattern").withColumn("low_value", F.when(F.col("low_value") < float("inf"), F.col("low_value")))
    n1, n2 = F.col("n1"), F.col("n2")
    t = t.withColumns({"m1": F.col("s1") / n1, "m2": F.col("s2") / n2})
    t = t.where((F.col("q1") / n1 - F.col("m1") ** 2 > 1e-12) | (F.col("q2") / n2 - F.col("m2") ** 2 > 1e-12))
    n = n1 + n2
    t = t.withColumn("sd", F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))))
    z = F.when(F.col("sd") > 0, (F.greatest("u", n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5) / F.col("sd")).otherwise(0.0)
    sparse = (F.col("z1") / n1 < min_nonzero) & (F.col("z2") / n2 < min_nonzero)
    z = F.when(sparse, 0.0).otherwise(z)
    t = t.withColumn("u", F.when(sparse, 0.0).otherwise(F.col("u"))).withColumn("z", F.round(z, 6)).withColumn("pvalue", F.expr(S.special.two_sided_sql("greatest(z, 0.0)")))
    effect = F.round(F.col("m1") - F.col("m2"), 6) + 0.0
    tests = t.select(
        "feature", "pattern_name", n1.cast("long").alias("n_high_cells"), n2.cast("long").alias("n_low_cells"), (F.round("m1", 6) + 0.0).alias("mean_high"), (F.round("m2", 6) + 0.0).alias("mean_low"),
        effect.alias("mean_diff"), (F.round(S.fold_change("m1", "m2", F.col("top"), F.col("low_value"), raw), 6) + 0.0).alias("log_fold_change"), F.col("u").alias("statistic"), "z", "pvalue", F.when(F.col("m1") > F.col("m2"), "higher").otherwise("lower").alias("direction"), (F.abs(effect) >= min_effect).alias("passes_lfc_threshold"),
    )
    return S.fdr(tests.join(F.broadcast(info), "pattern_name"), keys=("feature", "pattern_name"))


def specialization(tests: DataFrame) -> DataFrame:
    """The specialisation tests with the archetype's name from the pattern."""
    return tests.where("pattern_type = 'specialization'").withColumn("archetype", F.concat(F.lit("archetype_"), F.regexp_extract("high_archetypes", r"archetype_(\d+)", 1)))


def code_complexity(code: Column) -> Column:
    """How many archetypes a code names on both sides (their digits)."""
    return F.length(F.regexp_replace(code, "[x_]", ""))


def reversed_code(code: Column) -> Column:
    parts = F.split(code, "_")
    return F.concat_ws("_", parts[1], parts[0])


def canonical_direction(tests: DataFrame) -> DataFrame:
    """Rows whose effect is negative turned round, so every row reads high against low."""
    turn = F.col("mean_diff") < 0
    pick = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    return tests.select(
        "feature", F.when(turn, reversed_code(F.col("pattern_code"))).otherwise(F.col("pattern_code")).alias("pattern_code"), "complexity", pick("high_archetypes", "low_archetypes").alias("high_archetypes"),
        pick("low_archetypes", "high_archetypes").alias("low_archetypes"), pick("mean_high", "mean_low").alias("mean_high"), pick("mean_low", "mean_high").alias("mean_low"), F.abs("mean_diff").alias("mean_diff"),
        "pvalue", "fdr_pvalue", "significant",
    )


def tradeoffs(tests: DataFrame, kind: str = "pairs") -> DataFrame:
    """Tradeoff tests in one direction each: pairs of archetypes, or larger groups; one row for each (feature, code)."""
    rows = tests.where("pattern_type = 'tradeoff'")
    rows = rows.where("complexity = 2") if kind == "pairs" else rows.where("complexity > 2")
    first = F.row_number().over(Window.partitionBy("feature", "pattern_code").orderBy(F.desc("significant"), "complexity", "pvalue", F.desc("mean_diff")))
    return canonical_direction(rows).withColumn("__k", first).where("__k = 1").drop("__k")


def exclusive_pairwise(values: DataFrame, labels: DataFrame, min_effect: float = 0.05, alpha: float = 0.05, min_cells: int = 10) -> DataFrame:
    """Features that exactly one archetype has higher than every other one (one-sided p below ``alpha``, effect of ``min_effect``).

    feature, archetype, min_pairwise_effect, max_pairwise_pvalue, exclusivity_score: the archetype's
    mean over the largest other mean (plus 1e-6).
    """
    bins_ = labels.where(~F.col("archetype").isin(NONE))
    names = [r.archetype for r in bins_.groupBy("archetype").count().where(F.col("count") >= min_cells).orderBy("archetype").collect()]  # a label each
    ordered = [{"pattern_name": f"{a}>{b}", "pattern_code": "", "pattern_type": "pair", "complexity": 2, "high": [a], "low": [b]} for a in names for b in names if a < b]
    if not ordered:
        return values.sparkSession.createDataFrame([], "feature string, archetype string, min_pairwise_effect double, max_pairwise_pvalue double, exclusivity_score double")
    t = pattern_associations(values, bins_, pattern_table(values.sparkSession, ordered), min_cells)
    half = F.col("n_high_cells") * F.col("n_low_cells") / 2
    signed = F.when(F.col("statistic") >= half, F.col("z")).otherwise(-F.col("z"))
    t = t.withColumn("__z", signed)
    up, down = F.expr(S.special.upper_sql("__z")), F.expr(S.special.upper_sql("(-__z)"))
    ends = F.array(
        F.struct(F.col("high_archetypes").alias("archetype"), F.col("mean_diff").alias("effect"), up.alias("p"), F.col("mean_high").alias("own"), F.col("mean_low").alias("other")),
        F.struct(F.col("low_archetypes").alias("archetype"), (-F.col("mean_diff")).alias("effect"), down.alias("p"), F.col("mean_low").alias("own"), F.col("mean_high").alias("other")),
    )
    both = t.select("feature", F.explode(ends).alias("e")).select("feature", "e.*")
    wins = both.groupBy("feature", "archetype").agg(
        F.bool_and((F.col("p") < alpha) & (F.col("effect") >= min_effect)).alias("wins"), F.count(F.lit(1)).alias("n"), F.round(F.min("effect"), 6).alias("min_pairwise_effect"), F.round(F.max("p"), 6).alias("max_pairwise_pvalue"),
        F.round(F.max("own") / (F.max("other") + 1e-6), 4).alias("exclusivity_score"),
    )
    return wins.where("wins").drop("wins", "n")


def exclusive_one_vs_rest(tests: DataFrame) -> DataFrame:
    """Features with exactly one significant higher label."""
    only = tests.where("significant AND direction = 'higher'").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.first("archetype").alias("archetype"), F.first("pvalue").alias("pvalue"))
    return only.where("n = 1").drop("n")


def pattern_analysis(values: DataFrame, labels: DataFrame, binned: DataFrame, min_cells: int = 10, min_effect: float = 0.01, max_size: int | None = None) -> dict[str, DataFrame]:
    """The tests of single archetypes ('individual'), of patterns ('patterns') and the features that patterns pull both ways ('exclusivity')."""
    names = [r.archetype for r in binned.select("archetype").distinct().orderBy("archetype").collect()]  # a label each
    individual = S.pathway_associations(values, labels, min_effect, min_cells)
    tests = pattern_associations(values, binned, pattern_table(values.sparkSession, enumerate_patterns(names, max_size=max_size)), min_cells, min_effect)
    return {"individual": individual, "patterns": tests, "exclusivity": mutual_exclusivity(tests)}


def mutual_exclusivity(tests: DataFrame, min_effect: float = 0.05, effect: str = "mean_diff") -> DataFrame:
    """Features with significant effects both above ``min_effect`` and below -``min_effect``, widest range first."""
    strong = tests.where(F.col("significant") & (F.abs(effect) > min_effect))
    up, down = F.when(F.col(effect) > 0, F.col("pattern_name")), F.when(F.col(effect) < 0, F.col("pattern_name"))
    out = strong.groupBy("feature").agg(
        F.sort_array(F.collect_list(up)).alias("positive_patterns"), F.sort_array(F.collect_list(down)).alias("negative_patterns"), F.max(effect).alias("max_positive_effect"), F.min(effect).alias("min_negative_effect")
    )
    out = out.where((F.size("positive_patterns") > 0) & (F.size("negative_patterns") > 0))
    return out.withColumn("effect_range", F.round(F.col("max_positive_effect") - F.col("min_negative_effect"), 6)).withColumn("tradeoff_score", F.round(F.col("effect_range") / 2, 6))
