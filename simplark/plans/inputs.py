"""How the driver tables play the parts of the domain, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplark.operators import archetypes as A

K = 4
SHARE = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, vec, label) from embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))


def archetypes(spark: SparkSession, sf_dir: str) -> list[list[float]]:
    return A.furthest_archetypes(cells(spark, sf_dir), K)


def archetype_table(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "archetype_idx int, y array<double>")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, archetype): the label of every cell."""
    return A.labels(A.bins(cells(spark, sf_dir), archetypes(spark, sf_dir), SHARE))


def counts(spark: SparkSession, sf_dir: str, feature: str = "p_brand") -> DataFrame:
    """(cell_id, feature, value): quantities that customers bought of each feature of parts."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(feature).alias("feature"))
    joined = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("o_custkey").alias("cell_id"), "feature").agg(F.sum("l_quantity").alias("value"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, archetype): customers by market segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("archetype"))


def dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, feature, value): the components of the embeddings, rounded to two digits so that values tie."""
    long = cells(spark, sf_dir).select("cell_id", F.posexplode("vec").alias("pos", "x"))
    return long.select("cell_id", F.concat(F.lit("d"), F.lpad(F.col("pos").cast("string"), 2, "0")).alias("feature"), F.round("x", 2).alias("value"))


CELLS = "cells AS (SELECT vec_id AS cell_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS VARCHAR) AS label FROM embeddings)"


def archetypes_sql(k: int = K) -> str:
    """CTEs cells, arch (archetype_idx, y) and dist (cell_id, archetype_idx, distance)."""
    parts = [CELLS, "a0 AS (SELECT vec FROM cells ORDER BY cell_id LIMIT 1)", "m0 AS (SELECT cell_id, vec, round(list_distance(vec, (SELECT vec FROM a0)), 9) AS m FROM cells)"]
    for i in range(1, k):
        parts.append(f"a{i} AS (SELECT vec FROM m{i - 1} ORDER BY m DESC, cell_id LIMIT 1)")
        parts.append(f"m{i} AS (SELECT cell_id, vec, least(m, round(list_distance(vec, (SELECT vec FROM a{i})), 9)) AS m FROM m{i - 1})")
    parts.append("arch AS (" + " UNION ALL ".join(f"SELECT {i} AS archetype_idx, vec AS y FROM a{i}" for i in range(k)) + ")")
    parts.append("dist AS (SELECT cell_id, archetype_idx, round(list_distance(vec, y), 9) AS distance FROM cells CROSS JOIN arch)")
    return ", ".join(parts)


def bins_sql(k: int = K, share: float = SHARE) -> str:
    """The CTEs of ``archetypes_sql`` and bins, assigned (cell_id, archetype)."""
    return archetypes_sql(k) + f""",
        alld AS (SELECT cell_id, archetype_idx, distance FROM dist UNION ALL SELECT cell_id, -1, round(avg(distance), 9) FROM dist GROUP BY cell_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY archetype_idx ORDER BY distance, cell_id) - 1 AS rank_in_archetype FROM alld),
        taken AS (SELECT * FROM ranked WHERE rank_in_archetype < (SELECT CAST(floor(count(*) * {share}) AS BIGINT) FROM cells)),
        bins AS (
            SELECT cell_id, 'archetype_' || (archetype_idx + 1) AS archetype_label, archetype_idx, distance, rank_in_archetype, count(*) OVER (PARTITION BY cell_id) > 1 AS multiple_archetypes FROM taken
            UNION ALL SELECT cell_id, 'no_archetype', -1, CAST('NaN' AS DOUBLE), -1, false FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM taken)
        ),
        assigned AS (SELECT cell_id, arg_max(archetype_label, archetype_idx) AS archetype FROM bins GROUP BY cell_id)"""


COUNTS = """counts AS (
    SELECT o_custkey AS cell_id, p_brand AS feature, sum(l_quantity) AS value
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), segments AS (SELECT c_custkey AS cell_id, c_mktsegment AS archetype FROM customer)"""

DIMS = "dims AS (SELECT cell_id, 'd' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') AS feature, round(vec[i], 2) AS value FROM cells, range(1, 65) t(i))"


def ranksum_sql(values: str, labels: str, effect: str, min_cells: int = 10, where: str = "true") -> str:
    """CTE tests: rank-sum statistics by comparing cells, zeros spelled out (a dense grid, unlike the Spark plan)."""
    from simplark.functions import special

    value = "m1 - m2" if effect == "mean_diff" else "CASE WHEN top > 50 OR (coalesce(low, 0) > 0 AND top / low > 1000) THEN CASE WHEN m2 > 0 THEN log2((m1 + 1) / (m2 + 1)) ELSE log2(m1 + 1) END ELSE m1 - m2 END"
    return f"""lab AS (SELECT * FROM {labels} WHERE {where}),
        grid AS (SELECT f.feature, l.cell_id, l.archetype, coalesce(v.value, 0.0) AS value
            FROM (SELECT DISTINCT feature FROM {values} JOIN lab USING (cell_id) WHERE value <> 0) f CROSS JOIN lab l LEFT JOIN {values} v ON v.feature = f.feature AND v.cell_id = l.cell_id),
        ranked_v AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS midrank, count(*) OVER (PARTITION BY feature, value) AS c FROM grid),
        whole AS (SELECT feature, count(*) AS n_all, sum(value) AS s_all, sum(value * value) AS q_all, sum(CAST(c AS DOUBLE) * c - 1) AS ties, max(value) AS top, min(CASE WHEN value > 0 THEN value END) AS low, CAST(count(*) FILTER (value <> 0) AS DOUBLE) AS nz FROM ranked_v GROUP BY feature),
        own AS (SELECT feature, archetype, CAST(count(*) AS DOUBLE) AS n1, sum(value) AS s1, sum(value * value) AS q1, sum(midrank) AS r1, CAST(count(*) FILTER (value <> 0) AS DOUBLE) AS nz1 FROM ranked_v GROUP BY feature, archetype),
        stats AS (SELECT *, CAST(n_all - n1 AS DOUBLE) AS n2, s1 / n1 AS m1, (s_all - s1) / (n_all - n1) AS m2, r1 - n1 * (n1 + 1) / 2 AS u FROM own JOIN whole USING (feature)
            WHERE n1 >= {min_cells} AND archetype <> 'no_archetype' AND n_all > n1),
        zs AS (SELECT *, sqrt(n1 * n2 / 12 * ((n_all + 1) - ties / (CAST(n_all AS DOUBLE) * (n_all - 1)))) AS sd FROM stats WHERE q1 / n1 - m1 * m1 > 1e-12 OR (q_all - q1) / n2 - m2 * m2 > 1e-12),
        zz AS (SELECT * REPLACE (CASE WHEN sparse THEN 0.0 ELSE u END AS u), CASE WHEN sparse THEN 0.0 WHEN sd > 0 THEN (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd ELSE 0.0 END AS z FROM (SELECT *, nz1 / n1 < 0.05 AND (nz - nz1) / n2 < 0.05 AS sparse FROM zs)),
        tests AS (SELECT feature, archetype, CAST(n1 AS BIGINT) AS n_archetype_cells, CAST(n2 AS BIGINT) AS n_other_cells, round(m1, 6) + 0.0 AS mean_archetype, round(m2, 6) + 0.0 AS mean_other,
            round({value}, 6) + 0.0 AS {effect}, u AS statistic, round(z, 6) AS z, {special.two_sided_sql('greatest(round(z, 6), 0.0)')} AS pvalue, CASE WHEN m1 > m2 THEN 'higher' ELSE 'lower' END AS direction FROM zz)"""


def bh_sql(tests: str, keys: str = "feature, archetype", scope: str = "", alpha: float = 0.05) -> str:
    """CTE fdr over a CTE with pvalue."""
    part = f"PARTITION BY {scope} " if scope else ""
    return f"""numbered AS (SELECT *, row_number() OVER ({part}ORDER BY pvalue, {keys}) AS k, count(*) OVER ({part}) AS m FROM {tests}),
        fdr AS (SELECT *, least(1.0, min(pvalue * m / k) OVER ({part}ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS fdr_pvalue FROM numbered)"""
