"""Readers and writers: tables, gene sets, results, checkpoints."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load_cells(spark: SparkSession, path: str, use_raw: bool = True, reduced: str | None = None) -> DataFrame:
    """A Parquet table of cells; with ``use_raw`` false the reduced vectors take the place of x where there are any."""
    df = spark.read.parquet(path)
    return df.withColumn("x", F.col(reduced)) if not use_raw and reduced and reduced in df.columns else df


def load_subsample(spark: SparkSession, path: str, n_cells: int | None = None, seed: int = 0) -> DataFrame:
    """The data set at ``path``, or ``n_cells`` rows of it by the hash of cell_id and the seed; an error names a path without one."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return df if n_cells is None else df.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(n_cells)


def save_search(folds: DataFrame, config: dict, path: str) -> None:
    """A search's folds as Parquet beside its configuration as JSON."""
    folds.write.mode("overwrite").parquet(f"{path}/folds")
    save_model(folds.sparkSession, f"{path}/config", config, {})


def load_search(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/folds"), load_model(spark, f"{path}/config")[0]


def read_gmt(spark: SparkSession, paths: Sequence[str] | str, collection: str = "custom") -> DataFrame:
    """source, target, weight, pathway of a gene-set file: name, description, members, by tabs."""
    parts = F.split("value", "\t")
    rows = spark.read.text(paths).where(F.size(parts) > 2).select(parts[0].alias("source"), F.explode(F.slice(parts, 3, F.size(parts) - 2)).alias("target"))
    return rows.where("target <> ''").select("source", "target", F.lit(1.0).alias("weight"), F.upper(F.lit(collection)).alias("pathway"))


def load_networks(spark: SparkSession, files: dict[str, str], sources: Sequence[str]) -> DataFrame:
    """The union of the named collections; unknown ones are left out, and none at all is an error."""
    out = None
    for name in sources:
        if name in files:
            one = read_gmt(spark, files[name], name)
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"none of {', '.join(sources)} is known")
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_result(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def save_model(spark: SparkSession, path: str, parameters: dict, arrays: dict[str, list]) -> None:
    """Parameters as JSON and arrays as rows, so that any reader of Parquet can load them."""
    rows = [("parameters", json.dumps(parameters, sort_keys=True))] + [(k, json.dumps(v)) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[dict, dict[str, list]]:
    rows = {r.name: json.loads(r.value) for r in spark.read.parquet(path).collect()}
    return rows.pop("parameters"), rows


#: The columns of the results and whether they may be left out.
RESULTS = {
    "association": ("feature", "archetype", "n_archetype_cells", "n_other_cells", "mean_archetype", "mean_other", "statistic", "pvalue", "direction", "fdr_pvalue", "significant"),
    "conditional": ("archetype", "condition", "observed", "expected", "total_archetype", "total_condition", "odds_ratio", "pvalue", "fdr_pvalue", "significant"),
    "pattern": ("feature", "pattern_name", "pattern_code", "pattern_type", "high_archetypes", "low_archetypes", "n_high_cells", "n_low_cells", "mean_high", "mean_low", "statistic", "pvalue", "fdr_pvalue", "significant"),
}


def validate(df: DataFrame, kind: str) -> None:
    """An error that names the columns which a result of this kind lacks."""
    missing = [c for c in RESULTS[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"{kind}: missing {', '.join(missing)}")


def standardize(df: DataFrame, kind: str) -> DataFrame:
    """The result with all columns of its kind: gene and pathway become feature, missing ones are nulls of their type."""
    for old in ("gene", "pathway"):
        if old in df.columns and "feature" not in df.columns:
            df = df.withColumnRenamed(old, "feature")
    return df.withColumns({c: F.lit(None).cast(result_type(c)) for c in RESULTS[kind] if c not in df.columns})


def result_type(column: str) -> str:
    """The type of a result's column."""
    if column.startswith(("n_", "total_")) or column == "observed":
        return "long"
    if column == "significant":
        return "boolean"
    return "double" if column.startswith(("mean_", "fdr_", "odds_")) or column in ("statistic", "pvalue", "expected") else "string"
