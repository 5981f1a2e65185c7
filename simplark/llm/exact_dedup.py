"""Exact deduplication with counting quotient filters and byte verification.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints: the high
bits (quotient) choose a block, the low bits (remainder) are stored sorted, each with a count.
As nothing of the fingerprint is lost, filters merge without loss: the sorted remainders of a
block are merged and their counts added. A fingerprint whose merged count exceeds one sends its
documents to byte verification, a grouping by the whole normalised text; only what that grouping
confirms is a duplicate.

Texts are equal when identical after lower-casing A-Z; null counts as the empty text. Of equal
texts the row with the largest doc_id stays (a null doc_id is the smallest). Of repeated rows with
that doc_id exactly one stays. Texts may be as long as a row may be. Other columns may have any
names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplark.llm.common import checked, cut, fresh, join_keys, lower_ascii, named

QUOTIENT_BITS = 14


class CountingQuotientFilter:
    """Fingerprints with counts: sorted remainders under the quotients that occur.

    ``quotients`` are the occupied ones in order, ``ends`` where the run of each ends in
    ``remainders`` and ``counts``.
    """

    def __init__(self, quotients: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int = QUOTIENT_BITS):
        self.quotients, self.ends, self.remainders, self.counts, self.bits = quotients, ends, remainders, counts, bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, bits: int = QUOTIENT_BITS) -> CountingQuotientFilter:
        fingerprints = fingerprints.astype(np.uint64)
        counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
        order = np.argsort(fingerprints, kind="stable")
        f, c = fingerprints[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1]))) if len(f) else np.zeros(0, np.int64)
        f, c = f[first], np.add.reduceat(c, first) if len(first) else c
        low = np.uint64(64 - bits)
        q, r = f >> low, f & ((np.uint64(1) << low) - np.uint64(1))
        run = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        return cls(q[run].astype(np.int64), np.append(run[1:], len(q)).astype(np.int64) if len(run) else run, r, c, bits)

    def fingerprints(self) -> np.ndarray:
        lengths = np.diff(np.concatenate(([0], self.ends)))
        return np.repeat(self.quotients.astype(np.uint64), lengths) << np.uint64(64 - self.bits) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        return self.build(np.concatenate((self.fingerprints(), other.fingerprints())), np.concatenate((self.counts, other.counts)), self.bits)

    def blocks(self):
        """For each occupied quotient: (quotient, remainders, counts)."""
        begin = 0
        for q, end in zip(self.quotients.tolist(), self.ends.tolist(), strict=True):
            yield q, self.remainders[begin:end], self.counts[begin:end]
            begin = end


BLOCKS = "quotient int, remainders binary, counts binary"


def build_filters(fingerprints: DataFrame, column: str = "fp", bits: int = QUOTIENT_BITS) -> DataFrame:
    """A filter for each partition, as a row for each block."""

    def build(batches):
        total, waiting, size = None, [], 0

        def folded():
            new = CountingQuotientFilter.build(np.concatenate(waiting), bits=bits)
            return new if total is None else total.merge(new)

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(waiting[-1])
            if size >= 1 << 20:
                total, waiting, size = folded(), [], 0
        if waiting:
            total = folded()
        rows = list(total.blocks()) if total is not None else []
        for i in range(0, len(rows), 4096):
            q, r, c = zip(*rows[i : i + 4096], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([x.tobytes() for x in r], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary())], ["quotient", "remainders", "counts"])

    return fingerprints.select(F.col(column).alias("fp")).mapInArrow(build, BLOCKS)


def merge_filters(filters: DataFrame, bits: int = QUOTIENT_BITS) -> DataFrame:
    """(fp, n) of the merged filter; a block's rows meet in one task, sorted, and are merged as they pass."""

    def merge(batches):
        held: list[tuple[int, bytes, bytes]] = []

        def flush(rows):
            if not rows:
                return None
            lengths = [len(r) // 8 for _, r, _ in rows]
            q = np.repeat(np.array([x[0] for x in rows], np.uint64), lengths)
            r = np.frombuffer(b"".join(x[1] for x in rows), np.uint64)
            c = np.frombuffer(b"".join(x[2] for x in rows), np.int64)
            whole = CountingQuotientFilter.build(q << np.uint64(64 - bits) | r, c, bits)
            return pa.RecordBatch.from_arrays([pa.array(whole.fingerprints().view(np.int64)), pa.array(whole.counts)], ["fp", "n"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            last = held[-1][0]
            done = [x for x in held if x[0] != last]
            held = [x for x in held if x[0] == last]
            if (out := flush(done)) is not None:
                yield out
        if (out := flush(held)) is not None:
            yield out

    return filters.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(merge, "fp long, n long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, duplicates): a row for each document with its group, and the distinct texts that occur more than once.

    rows: doc_id, fp, sha, row (a number for each row), keep_id, keep_row, group_size.
    duplicates: fp, sha, keep_id.
    """
    shaped = docs.select(named(key).alias("doc_id"), lower_ascii(named(text)).alias("norm"))
    keyed = cut(shaped.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("row")))
    repeated = checked(merge_filters(build_filters(keyed)).where("n > 1").select("fp"))
    # The grouping compares whole texts; its partial step leaves one row of a group in each partition.
    verified = (
        shaped.select(F.xxhash64("norm").alias("fp"), "norm")
        .join(repeated, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"))
    )
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = cut(
        keyed.join(repeated, "fp", "left_semi")
        .groupBy("fp", "sha")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .join(verified, ["fp", "sha"], "left_semi")
        .select("fp", "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size", F.col("group_size").alias("n"))
    )
    rows = join_keys(keyed, groups, ["fp", "sha"], "n", "left")
    return rows, groups.select("fp", "sha", "keep_id")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows, _ = exact_groups(docs, key, text)
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    The dropped (doc_id, text) pairs are anti-joined away. Rows that repeat the doc_id and text of
    one that stays can't be told apart so; where there are any, they are reduced to one apart.
    """
    rows, _ = exact_groups(docs, key, text)
    grouped = rows.where("group_size is not null")
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    sha, d, s, one = (fresh(x, docs.columns) for x in ("sha_of_text", "dropped_id", "dropped_sha", "one_row"))
    pair = [F.col("doc_id").alias(d), F.col("sha").alias(s)]
    dropped = grouped.where(~is_kept).select(*pair).distinct()
    again = grouped.where(is_kept).groupBy("doc_id", "sha").count().where("count > 1").select(*pair)
    marked = docs.withColumn(sha, F.unhex(F.sha2(lower_ascii(named(text)), 256)))
    same = named(key).eqNullSafe(F.col(d)) & (F.col(sha) == F.col(s))
    some = checked(again)
    left = marked.join(checked(dropped), same, "left_anti")
    columns = [named(c) for c in docs.columns]
    once = left.join(some, same, "left_semi").groupBy(named(key), sha).agg(F.first(F.struct(*columns)).alias(one))
    return left.join(some, same, "left_anti").select(*columns).union(once.select(f"{one}.*"))
