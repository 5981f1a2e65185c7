"""Sharding by fixed virtual slots.

Records hash into ``SLOTS`` virtual slots, for good. A small map says which shard holds which
slot; it has versions, and rebalancing writes a new version that differs from the last only in the
slots it moves. Under the law ``bytes`` version 0 deals the slots out in turn, the bytes of each
slot are added up, and slots move from the fullest to the emptiest shard while that brings the two
closer. Under the law ``key`` the doc_id and the number of shards alone decide: the map of n shards has
grown from one shard, each new one taking its share of slots from each of the others; it is kept as
version n, so calls with the same number find the same map, and one more shard finds the next.

The driver sees one row of totals for each slot (``SLOTS`` of them, whatever the input) and the
map; all that touches records is built-in functions. A record's place in its shard counts on from
the records of the shard's earlier slots, so no window spans more than one virtual slot.

Defined cases: a null text has no bytes (size 1) and the checksum of the empty text; a null doc_id
is placed by its text alone; repeated rows get places of their own, in no particular order among
themselves; an empty table gives no rows. Equal texts under different doc_ids aren't kept in one
shard: both laws are about the records, and a group of copies as large as a third of all rows would
break them. Other columns may have any names; none is read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from simplark.llm.common import cut, named, new_folder

SLOTS = 4096


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0: slots dealt out in turn."""
    return [s % shards for s in range(slots)]


def grown_map(current: list[int], shards: int) -> list[int]:
    """The map with one shard more (``shards`` before): of each shard's slots the same share moves into the new one, none elsewhere."""
    out, seen = list(current), [0] * shards
    for slot, shard in enumerate(current):
        seen[shard] += 1
        if seen[shard] % (shards + 1) == 0:
            out[slot] = shards
    return out


def keyed_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map of the law ``key``: one shard, grown until there are ``shards``."""
    out = [0] * slots
    for n in range(1, shards):
        out = grown_map(out, n)
    return out


def rebalanced_map(current: list[int], sizes: list[int], shards: int) -> list[int]:
    """The map after moving slots, one at a time, from the fullest shard that can be helped to the emptiest, while any can."""
    out, loads, held = list(current), [0] * shards, [[] for _ in range(shards)]  # (size, slot) in order
    for slot, shard in enumerate(out):
        loads[shard] += sizes[slot]
        if sizes[slot]:
            insort(held[shard], (sizes[slot], slot))

    def move(slot: int, to: int) -> None:
        entry = (sizes[slot], slot)
        held[out[slot]].remove(entry)
        loads[out[slot]] -= sizes[slot]
        out[slot] = to
        insort(held[to], entry)
        loads[to] += sizes[slot]

    def nearest(entries: list[tuple[int, int]], size: float) -> list[tuple[int, int]]:
        """The entries around a size, at most one on either side."""
        k = bisect_left(entries, (size, -1))
        return entries[max(0, k - 1) : k + 1]

    def improved(full: int, empty: int) -> bool:
        """Bring two shards closer, by moving one slot or else by exchanging two."""
        gap = loads[full] - loads[empty]
        best = min(nearest(held[full], gap / 2), key=lambda e: (abs(gap - 2 * e[0]), e[1]), default=None)
        if best is not None and abs(gap - 2 * best[0]) < gap:
            move(best[1], empty)
            return True
        pairs = ((abs(gap - 2 * (a[0] - b[0])), a[1], b[1]) for a in held[full] for b in nearest(held[empty], a[0] - gap / 2))
        left, a, b = min(pairs, default=(gap, 0, 0))
        if left >= gap:
            return False
        move(a, empty)
        move(b, full)
        return True

    for _ in range(4 * len(out)):
        order = sorted(range(shards), key=lambda s: (-loads[s], s))
        # A shard that one huge slot fills can't be helped; then the next one is tried.
        if not any(loads[full] - loads[order[-1]] > 1 and improved(full, order[-1]) for full in order[:-1]):
            break
    return out


def save_map(spark: SparkSession, path: str, version: int, current: list[int]) -> None:
    """Write a version of the map beside the others."""
    rows = spark.range(0, len(current), 1, 1).withColumnRenamed("id", "slot")  # one file
    at_slot(rows, F.col("slot"), current, "shard").write.parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> set[int]:
    """The versions under ``path``, from the listing of its files."""
    try:
        files = spark.read.schema("slot long, shard int").parquet(path).inputFiles()
    except AnalysisException:  # no such folder
        return set()
    return {int(m[1]) for f in files if (m := re.search(r"/version=(\d+)/", f))}


def latest_version(spark: SparkSession, path: str) -> int:
    """The highest version under ``path``, -1 where there is none."""
    return max(versions(spark, path), default=-1)


def load_map(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema("slot long, shard int").parquet(f"{path}/version={version}").collect()  # a row for each slot
    return [r.shard for r in sorted(rows)]


def kept_map(spark: SparkSession, path: str, shards: int, slots: int) -> list[int]:
    """The map of the law ``key`` for a number of shards, written when it isn't there yet."""
    if shards not in versions(spark, path):
        save_map(spark, path, shards, keyed_map(shards, slots))
    out = load_map(spark, path, shards)
    if len(out) != slots or not set(out) <= set(range(shards)):
        raise ValueError(f"version {shards} of the map is for other slots or shards")
    return out


def at_slot(df: DataFrame, slot: Column, values: list[int], name: str) -> DataFrame:
    return df.withColumn(name, F.get(F.lit(values), slot.cast("int")))


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    raw = F.coalesce(named(text), F.lit("")).cast("binary")
    shaped = docs.select(named(key).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    by_id = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    return shaped.withColumn("virtual_slot", F.pmod(by_id, F.lit(slots)).cast("int"))


def shard(docs: DataFrame, shards: int = 16, law: str = "bytes", map_path: str | None = None, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the place in the shard), grown_shard, virtual_slot of every record.

    ``map_path`` is where the versions of the map are. Under ``bytes`` the latest one there, or else version 0,
    which is written first, is rebalanced, and the result is written as the next version, unless nothing
    moves. Under ``key`` version ``shards`` holds and the next one says where the grown shards are; either is
    written where it is missing. Records go where the versions say that are then read back.
    """
    if law not in ("bytes", "key"):
        raise ValueError(law)
    spark = docs.sparkSession
    map_path = map_path or new_folder(spark, "slot-map")
    if law == "key":
        first, second = (kept_map(spark, map_path, n, slots) for n in (shards, shards + 1))
    else:
        version = latest_version(spark, map_path)
        if version < 0:
            version = 0
            save_map(spark, map_path, 0, first_map(shards, slots))
        first = load_map(spark, map_path, version)
        if len(first) != slots or not set(first) <= set(range(shards)):
            raise ValueError(f"version {version} of the map is for other slots or shards")
    rows = cut(records(docs, key, text, slots))
    totals = {r.virtual_slot: r for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    sizes = [totals[s].bytes if s in totals else 0 for s in range(slots)]
    if law == "bytes" and (second := rebalanced_map(first, sizes, shards)) != first:
        version += 1
        save_map(spark, map_path, version, second)
        second = load_map(spark, map_path, version)
    now = second if law == "bytes" else first
    before, starts = [0] * shards, []
    for s in range(slots):
        starts.append(before[now[s]])
        before[now[s]] += totals[s].n if s in totals else 0
    place = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    out = at_slot(rows.withColumn("place", place), F.col("virtual_slot"), now, "shard")
    out = at_slot(out, F.col("virtual_slot"), starts, "start")
    out = at_slot(out, F.col("virtual_slot"), second, "grown_shard") if law == "key" else out.withColumn("grown_shard", F.lit(None).cast("int"))
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard", "virtual_slot")
