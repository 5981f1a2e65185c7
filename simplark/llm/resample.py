"""Importance resampling towards a target: array-scored weights and a distributed radix sort.

Features are the runs of one to ``longest`` consecutive words, hashed into buckets. One pass counts
buckets in the documents, one in the target; the logarithm of the ratio of both shares is a
bucket's gain. A document's weight is the mean gain of its features, looked up in the array of
gains; with Gumbel noise of its id it becomes the score, so that the highest scores are a draw
without replacement.

The ranks come from a radix sort by least significant digits. The key is (score downwards, id
upwards), its parts counted from the smallest and cut into digits of ``DIGIT`` bits. A pass is a stable counting sort:
blocks of rows count their digits; sums over smaller digits, and over earlier blocks for the
same digit, say where each block's rows of each digit begin; a row's place is that offset and
its number among the like rows of its block. Blocks are bounded by ``BLOCK`` rows, so no
task meets all rows of a digit, however many there are; the last pass's places are the ranks.

Texts are read twice (counts, then scores) and never shuffled. What passes through the driver is
bounded by the buckets and by the values of one digit. Each pass is written to the shared folder.

Defined cases: a null text has no words, hence no features, weight 0, and is never drawn; a null
id stands for the empty text in the noise and comes before all others in ties; repeated rows each
take part, and rows that agree in score and id take their places in no particular order; an
empty table gives no rows, and an empty target draws by what is rare in the documents. Ids
are whole numbers. Other columns may have any names; none is read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplark.llm.common import cut, named, small, written
from simplark.llm.licenses import texts_of, words_of

BUCKETS = 10_000
DIGIT = 12
#: Rows of a block; they are counted and numbered by one task.
BLOCK = 1 << 17
#: Words up to so many bytes go through tables; longer ones are rare and hashed one by one.
TABLED = 64


def zero_bytes(most: int) -> np.ndarray:
    """Tables by (number of zero bytes, byte of a checksum's register, its value): the register after those zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    out = np.empty((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, most + 1):
        out[n] = out[n - 1] >> 8 ^ table[out[n - 1] & 255]
    return out


ZEROS = zero_bytes(TABLED)


def joined_crc(front: np.ndarray, back: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The crc32 of two byte strings in a row, from that of each and the second one's length (at most ``TABLED``)."""
    moved = back.copy()
    for k in range(4):
        moved ^= ZEROS[lengths, k, front >> np.uint32(8 * k) & np.uint32(255)]
    return moved


def feature_crcs(texts: list[list[bytes]], longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of features: (checksums, text of each), in order."""
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    word = coded.indices.to_numpy(zero_copy_only=False)
    plain = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32)
    size = np.array([len(w) + 1 for w in distinct], np.int64)
    if not len(word):
        return []
    found = [(plain[word], owner)]
    for n in range(2, longest + 1):
        whole = np.flatnonzero(owner[n - 1 :] == owner[: len(owner) - n + 1])  # runs within one text
        front, last = found[-1][0], word[n - 1 :][whole]
        # The run that is one word shorter has its place before: as many as are left of those that begin here.
        front = front[np.searchsorted(starts, whole)] if n > 2 else front[whole]
        crc = joined_crc(front, spaced[last], np.minimum(size[last], TABLED))
        for i in np.flatnonzero(size[last] > TABLED).tolist():
            crc[i] = zlib.crc32(b" " + distinct[last[i]], int(front[i]))
        starts = whole
        found.append((crc, owner[whole]))
    return found


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = 2) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in small([batch], 0):
                for crc, _ in feature_crcs([words_of(t) for t in texts_of(part.column(0))], longest):
                    seen += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    rows = docs.select(named(text).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most one for each bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's share in the target over that in the source, both smoothed by one, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = len(s)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 2) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    rows = docs.select(named(key).cast("long").alias("doc_id"), named(text).alias("text"))

    def run(batches):
        for batch in small(batches, 1):
            texts = [words_of(t) for t in texts_of(batch.column(1))]
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for crc, owner in feature_crcs(texts, longest):
                sums = np.concatenate(([0], np.cumsum(gain[crc % np.uint32(len(gain))])))
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                n += np.diff(ends)
                total += np.diff(sums[ends])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (np.array([len(t) for t in texts], np.int64), n, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def radix_pass(rows: DataFrame, digit: str) -> DataFrame:
    """``rows`` with ``place`` (their order: distinct, with gaps) renumbered by the digit of the key, stably and without gaps."""
    keyed = rows.withColumn("digit", F.expr(digit)).withColumn("block", F.shiftright("place", BLOCK.bit_length() - 1))
    counts = cut(keyed.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n")))
    totals = np.zeros(1 << DIGIT, np.int64)
    for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect():
        totals[r.digit] = r.n
    smaller = (np.cumsum(totals) - totals).tolist()
    earlier = F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("block", "digit", (F.coalesce(earlier, F.lit(0)) + F.get(F.lit(smaller), F.col("digit"))).alias("offset"))
    like = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place"))
    return keyed.withColumn("like", like).join(offsets, ["block", "digit"]).select(*[c for c in rows.columns if c != "place"], (F.col("offset") + F.col("like") - 1).cast("long").alias("place"))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0, in the order of the keys (long, not null); the first one counts most."""
    if "place" in rows.columns or {"digit", "block", "like", "offset", "n"} & set(rows.columns):
        raise ValueError("the sort needs its own columns")
    now = cut(rows.withColumn("place", F.monotonically_increasing_id()))
    ends = now.agg(*[f(k).alias(f"{name}_{k}") for k in keys for name, f in (("low", F.min), ("high", F.max))]).first()
    passes = 0
    for key in reversed(keys):
        low, high = ends[f"low_{key}"] or 0, ends[f"high_{key}"] or 0
        # Digits are of the distance from the smallest key; where that has no long, flipping the sign bit gives the order of unsigned numbers.
        number, bits = (f"(`{key}` - ({low}L))", (high - low).bit_length()) if high - low < 1 << 63 else (f"(`{key}` ^ (-9223372036854775807L - 1L))", 64)
        for shift in range(0, bits, DIGIT):
            now = cut(radix_pass(now, f"cast(shiftrightunsigned({number}, {shift}) & {(1 << DIGIT) - 1} as int)"))
            passes += 1
    return now if passes else cut(radix_pass(now, "0"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 7, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS, longest: int = 2) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every document; ``percent`` of those with ``least_words`` have a rank."""
    gain = gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, gain, key, text, longest).withColumn("score", (F.col("weight") + gumbel).cast("long")))
    able = scored.where(F.col("n_words") >= least_words)
    # Null ids come first, before the smallest number there is.
    keyed = able.withColumns({"down": -F.col("score"), "no_id": F.col("doc_id").isNotNull().cast("long"), "up": F.coalesce("doc_id", F.lit(0).cast("long"))})
    order = ranked(keyed, ["down", "no_id", "up"])
    drawn = percent * order.count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    out = ("doc_id", "n_features", "weight", "score")
    rest = scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"), "n_words")
    return order.select(*out, rank.alias("rank"), "n_words").unionByName(rest)
