"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplark.llm.common import BROADCAST_ROWS, cut, join_keys


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long): root is the smallest node of its component.

    Each round points nodes at the smallest neighbour they have seen, first upwards (large star),
    then downwards (small star); the number of rounds grows with the logarithm of the longest
    path. Each round is checkpointed, and nothing but two numbers reaches the driver.
    """

    def state(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], int(r[1])

    def met(rows: DataFrame, found: DataFrame) -> DataFrame:
        # A node may have any number of neighbours; twice the edges bound the nodes.
        return rows.join(F.broadcast(found.drop("n")), "a") if 2 * before[0] <= BROADCAST_ROWS else join_keys(rows, found, ["a"], "n")

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = met(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        down = met(large, low).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(low.select("a", F.col("m").alias("b")).unionByName(down).where("a <> b").distinct())
        if (after := state(now)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components haven't settled after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
