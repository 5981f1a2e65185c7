"""Rank-sum tests, false-discovery control and enrichment over long tables.

Values are long rows (cell_id, feature, value), labels are (cell_id, archetype); values that are
missing for a cell are zero. Ranks come from counts of distinct values by label, added up along the
values over range partitions (``order.running_totals``): with continuous scores there are as many
distinct values as cells, and no task sorts those of a whole feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplark.functions import special
from simplark.operators import order as O
from simplark.operators.archetypes import CENTRAL, NONE
from simplark.sources.shared import cut, small


def value_counts(values: DataFrame, labels: DataFrame, labelled_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """((feature, value, archetype, n) with the implicit zeros, (archetype, n_cells)).

    Labels are the cells; with ``labelled_only`` the central bin and unassigned cells leave.
    """
    if labelled_only:
        labels = labels.where(~F.col("archetype").isin(CENTRAL, NONE))
    sizes = small(labels.groupBy("archetype").agg(F.count(F.lit(1)).alias("n_cells")))
    seen = cut(values.where("value <> 0").join(labels, "cell_id").groupBy("feature", "value", "archetype").agg(F.count(F.lit(1)).alias("n")))
    filled = seen.groupBy("feature", "archetype").agg(F.sum("n").alias("nnz"))
    grid = filled.select("feature").distinct().crossJoin(sizes)  # features x labels, both small beside the values
    zeros = grid.join(filled, ["feature", "archetype"], "left").select("feature", F.lit(0.0).alias("value"), "archetype", (F.col("n_cells") - F.coalesce("nnz", F.lit(0))).alias("n")).where("n > 0")
    return cut(seen.unionByName(zeros)), sizes


def rank_sums(
    values: DataFrame, labels: DataFrame, min_cells: int = 10, comparison: str = "all", effect: str = "gene", raw: bool = True, min_nonzero: float = 0.05
) -> DataFrame:
    """One row for each feature and label: sizes, means, effect, U, z, two-sided p, direction.

    ``comparison``: 'all' compares a label with all other cells, 'archetypes_only' with those of
    the other bins. ``effect``: 'gene' takes the log fold change (log2 ratio of raw data, see
    ``fold_change``), 'pathway' the difference of means. A feature without variance in both groups
    is left out; one with less than ``min_nonzero`` of values other than zero in both has statistic 0 and p 1.
    The counts, a table of features x distinct values x labels, are made once.
    """
    counts, sizes = value_counts(values, labels, comparison == "archetypes_only")
    pooled = O.running_totals(counts.groupBy("feature", "value").agg(F.sum("n").alias("c")), ["feature"], ["value"], ["c"])
    ranked = pooled.withColumn("midrank", F.col("c_before") + (F.col("c") + 1) / 2)
    x, n = F.col("value"), F.col("n")
    whole = pooled.groupBy("feature").agg(
        F.sum("c").alias("n_all"), F.sum(x * F.col("c")).alias("s_all"), F.sum(x * x * F.col("c")).alias("q_all"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"),
        F.max("value").alias("top"), F.min(F.when(x > 0, x)).alias("low"), F.sum(F.when(x != 0, F.col("c")).otherwise(0)).alias("nz_all"),
    )
    own = counts.join(ranked.select("feature", "value", "midrank"), ["feature", "value"]).groupBy("feature", "archetype").agg(
        F.sum("n").alias("n1"), F.sum(x * n).alias("s1"), F.sum(x * x * n).alias("q1"), F.sum(F.col("midrank") * n).alias("r1"), F.sum(F.when(x != 0, n).otherwise(0)).alias("nz1")
    )
    tests = own.join(sizes, "archetype").where((F.col("n_cells") >= min_cells) & (F.col("archetype") != NONE)).join(whole, "feature")
    n1, n2 = F.col("n1").cast("double"), (F.col("n_all") - F.col("n1")).cast("double")
    tests = tests.withColumns({"n2": n2, "m1": F.col("s1") / n1, "m2": (F.col("s_all") - F.col("s1")) / n2})
    tests = tests.withColumns({"v1": F.col("q1") / n1 - F.col("m1") ** 2, "v2": (F.col("q_all") - F.col("q1")) / F.col("n2") - F.col("m2") ** 2}).where((F.col("n2") > 0) & ((F.col("v1") > 1e-12) | (F.col("v2") > 1e-12)))
    u = F.col("r1") - n1 * (n1 + 1) / 2
    nn = F.col("n_all").cast("double")
    sd = F.sqrt(n1 * F.col("n2") / 12 * ((nn + 1) - F.col("ties") / (nn * (nn - 1))))
    tests = tests.withColumns({"u": u, "sd": sd}).withColumn("z", F.when(F.col("sd") > 0, (F.greatest("u", n1 * F.col("n2") - F.col("u")) - n1 * F.col("n2") / 2 - 0.5) / F.col("sd")).otherwise(0.0))
    sparse = (F.col("nz1") / n1 < min_nonzero) & ((F.col("nz_all") - F.col("nz1")) / F.col("n2") < min_nonzero)
    tests = tests.withColumns({"u": F.when(sparse, 0.0).otherwise(F.col("u")), "z": F.when(sparse, 0.0).otherwise(F.col("z"))})
    value = fold_change("m1", "m2", F.col("top"), F.col("low"), raw) if effect == "gene" else F.col("m1") - F.col("m2")
    return tests.select(
        "feature", "archetype", F.col("n1").alias("n_archetype_cells"), F.col("n2").cast("long").alias("n_other_cells"), (F.round("m1", 6) + 0.0).alias("mean_archetype"), (F.round("m2", 6) + 0.0).alias("mean_other"),
        (F.round(value, 6) + 0.0).alias("log_fold_change" if effect == "gene" else "mean_diff"), F.col("u").alias("statistic"), F.round("z", 6).alias("z"),
        F.expr(special.two_sided_sql("greatest(round(z, 6), 0.0)")).alias("pvalue"), F.when(F.col("m1") > F.col("m2"), "higher").otherwise("lower").alias("direction"),
    )


def fold_change(m1: str, m2: str, top: Column, low: Column, raw: bool = True) -> Column:
    """log2((m1 + 1) / (m2 + 1)) where the values look like raw counts, the difference of means where they look like logarithms."""
    diff = F.col(m1) - F.col(m2)
    if not raw:
        return diff
    counts = (top > 50) | (F.coalesce(low, F.lit(0.0)) > 0) & (top / F.greatest(F.coalesce(low, F.lit(1.0)), F.lit(1e-300)) > 1000)
    ratio = F.when(F.col(m2) > 0, F.log2((F.col(m1) + 1) / (F.col(m2) + 1))).otherwise(F.log2(F.col(m1) + 1))
    return F.when(counts, ratio).otherwise(diff)


def fdr(tests: DataFrame, p: str = "pvalue", method: str = "benjamini_hochberg", alpha: float = 0.05, scope: str | None = None, keys: tuple[str, ...] = ("feature", "archetype")) -> DataFrame:
    """The tests with fdr_pvalue and significant (strictly below alpha).

    ``scope`` None is all tests together, else the column within which they are corrected. p values
    that are null, NaN or outside [0, 1] count as 1. Ties are ordered by ``keys``. Over all tests
    the window has one partition: tests are features times labels, not cells.
    """
    clean = F.when(F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1), 1.0).otherwise(F.col(p))
    rows = tests.withColumn("__p", clean)
    part = Window.partitionBy(scope) if scope else Window.partitionBy()
    m = F.count(F.lit(1)).over(part)
    if method == "bonferroni":
        q = F.least(F.lit(1.0), F.col("__p") * m)
    elif method == "benjamini_hochberg":
        rows = rows.withColumn("__k", F.row_number().over(part.orderBy("__p", *keys))).withColumn("__m", m)
        back = part.orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
        q = F.least(F.lit(1.0), F.min(F.col("__p") * F.col("__m") / F.col("__k")).over(back))
    else:
        raise ValueError(method)
    return rows.withColumn("fdr_pvalue", q).withColumn("significant", F.col("fdr_pvalue") < alpha).drop("__p", "__k", "__m")


def gene_associations(values: DataFrame, labels: DataFrame, min_logfc: float = 0.01, min_cells: int = 10, comparison: str = "all", scope: str = "global", method: str = "benjamini_hochberg", raw: bool = True, direction: str = "two-sided") -> DataFrame:
    """Rank-sum tests of every feature and label with effects of at least ``min_logfc``, corrected.

    Every ``direction`` is tested two-sided; 'both_legacy' gives two one-sided rows a test instead, with test_direction.
    """
    if scope not in ("global", "per_archetype", "none"):
        raise ValueError(scope)
    if direction not in ("two-sided", "both", "greater", "less", "both_legacy"):
        raise ValueError(direction)
    tests = rank_sums(values, labels, min_cells, comparison, "gene", raw).where(F.abs("log_fold_change") >= min_logfc)
    if direction == "both_legacy":
        tests = one_sided(tests, "greater").unionByName(one_sided(tests, "less"))
    out = fdr(tests, method=method, scope="archetype" if scope == "per_archetype" else None)
    return out.withColumns({"fdr_pvalue": F.col("pvalue"), "significant": F.col("pvalue") < 0.05}) if scope == "none" else out


def pathway_associations(scores: DataFrame, labels: DataFrame, min_effect: float = 0.01, min_cells: int = 10, comparison: str = "all", direction: str = "two-sided", method: str = "benjamini_hochberg") -> DataFrame:
    """Like ``gene_associations`` on scores, by difference of means; one-sided tests keep every effect, and 'both' gives a row for each side."""
    tests = rank_sums(scores, labels, min_cells, comparison, "pathway")
    if direction == "two-sided":
        return fdr(tests.where(F.abs("mean_diff") >= min_effect), method=method)
    if direction == "both":
        both = one_sided(tests, "greater").unionByName(one_sided(tests, "less"))
        return fdr(both, method=method, keys=("feature", "archetype", "test_direction"))
    return fdr(one_sided(tests, direction), method=method)


def one_sided(tests: DataFrame, direction: str) -> DataFrame:
    """The tests with the p of one side, test_direction, and the direction that side means ('greater': higher)."""
    if direction not in ("greater", "less"):
        raise ValueError(direction)
    signed = F.when(F.col("statistic") >= F.col("n_archetype_cells") * F.col("n_other_cells") / 2, F.col("z")).otherwise(-F.col("z"))
    # The correction by one half belongs to the larger side; the other has it the other way round.
    z = signed if direction == "greater" else -signed
    one = tests.withColumn("__z", z).withColumn("pvalue", F.when((F.col("statistic") == 0) & (F.col("z") == 0), 1.0).otherwise(F.expr(special.upper_sql("__z")))).drop("__z")
    return one.withColumns({"test_direction": F.lit(direction), "direction": F.lit("higher" if direction == "greater" else "lower")})


def enrichment(cells: DataFrame, condition: str, archetype: str = "archetype", min_cells: int = 5, alpha: float = 0.05) -> DataFrame:
    """Over-representation of condition levels in labels: counts, expected, odds ratio, hypergeometric tail, corrected.

    Rows without a condition or label don't count; groups, levels and overlaps of fewer than
    ``min_cells`` are left out. odds_ratio is the conditional maximum-likelihood estimate, with the limits of its
    95 % interval; sample_odds_ratio is that of the counts. Without off-diagonal cells both are infinite and the
    limits NaN.
    """
    rows = cells.where(F.col(condition).isNotNull() & (F.col(archetype) != NONE)).select(F.col(archetype).alias("archetype"), F.col(condition).cast("string").alias("condition"))
    both = rows.groupBy("archetype", "condition").agg(F.count(F.lit(1)).alias("observed"))
    # Everything after this is as large as labels x levels.
    a, c = Window.partitionBy("archetype"), Window.partitionBy("condition")
    t = both.withColumns({"total_archetype": F.sum("observed").over(a), "total_condition": F.sum("observed").over(c), "n": F.sum("observed").over(Window.partitionBy())})
    t = t.where((F.col("total_archetype") >= min_cells) & (F.col("total_condition") >= min_cells) & (F.col("observed") >= min_cells))
    off1, off2 = F.col("total_archetype") - F.col("observed"), F.col("total_condition") - F.col("observed")
    rest = F.col("n") - F.col("total_archetype") - off2
    odds = F.when((off1 > 0) & (off2 > 0), F.col("observed") * rest / (off1 * off2)).otherwise(F.lit(float("inf")))
    p = special.hypergeometric_tail(F.col("observed"), F.col("total_archetype"), F.col("total_condition"), F.col("n"))
    out = t.select(
        "archetype", "condition", "observed", F.round(F.col("total_archetype") * F.col("total_condition") / F.col("n"), 6).alias("expected"), "total_archetype", "total_condition",
        F.round(odds, 6).alias("sample_odds_ratio"), special.conditional_odds(F.col("observed"), F.col("total_archetype"), F.col("total_condition"), F.col("n")).alias("__o"), p.alias("pvalue"),
    )
    out = out.select("*", F.col("__o.estimate").alias("odds_ratio"), F.col("__o.lower").alias("ci_lower"), F.col("__o.upper").alias("ci_upper")).drop("__o")
    return fdr(out, alpha=alpha, keys=("archetype", "condition"))
