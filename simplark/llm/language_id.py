"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams by language on Spark and folds them into one matrix of log
probabilities, which has a fixed number of rows (the hash buckets) and a column for each
language. The matrix is broadcast; scoring adds up, in numpy, the rows of the n-grams that
occur, for many documents at once.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; with no
labelled row at all every text is ``und``; ties go to the language that sorts first;
repeated rows are each predicted, and each learned from; a null doc_id has no fold, so it is
neither held out nor learned from. Texts count whole, however long. ``predict`` takes any names of
kept columns but those it adds; ``keep_identified`` takes any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplark.llm.common import bounded, extended, fold, fresh, held_by_worker, named, numbered, small, strings

ORDERS = (1, 2, 3)
BITS = 16
UNDETERMINED = "und"


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Starts of the documents, hashed n-grams by order, and whether each document has a letter.

    Every run of other characters is one space, and a space begins and ends each document.
    An n-gram that would leave its document has the bucket 2**BITS, whose weights are zero.
    """
    codes = held_by_worker("letters", letters)[np.frombuffer(("".join(f" {x} " for x in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.array([len(x) + 2 for x in texts])
    ends = np.cumsum(lengths)
    firsts = ends - lengths
    space = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[firsts] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    starts, stops = kept[firsts], kept[ends]
    codes = codes[keep]
    has = np.add.reduceat(codes != 32, starts) > 0 if len(starts) else np.zeros(0, bool)
    hashes, h = [], codes * np.uint32(2654435761)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) ^ (codes[n - 1 :] * np.uint32(2654435761))
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + np.uint32(n)
            bucket = np.full(len(codes), 1 << BITS, np.int32)
            bucket[: len(mixed)] = mixed >> np.uint32(32 - BITS)
            for back in range(1, n):  # these begin in one document and end in the next
                at = stops - back
                bucket[at[at >= starts]] = 1 << BITS
            hashes.append(bucket)
    return starts, hashes, has


@dataclass
class LanguageModel:
    """``weights`` has a row for each bucket and one of zeros after them, a column for each language."""

    languages: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(((1 << BITS) + 1, 0)))

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [], []
        for part in bounded([len(x or "") for x in texts], 1 << 19):
            found, sure = self._block([x or "" for x in texts[part]])
            labels += found
            scores += sure
        return labels, scores

    def _block(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        starts, hashes, has = ngrams(texts)
        logs = np.tile(self.prior, (len(texts), 1))
        for k in range(len(self.languages)):
            column = np.ascontiguousarray(self.weights[:, k])
            for h in hashes:
                logs[:, k] += np.add.reduceat(column[h], starts)
        best = logs.argmax(1)
        top = logs[np.arange(len(texts)), best]
        sure = 1 / np.exp(logs - top[:, None]).sum(1)
        return (
            [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, has, strict=True)],
            [float(s) if ok else 0.0 for s, ok in zip(sure, has, strict=True)],
        )


def train(
    docs: DataFrame,
    learn: Column,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    rows_per_language: int = 20_000,
    alpha: float = 0.1,
    most_languages: int = 1000,
) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and the language isn't null.

    ``rows_per_language`` bounds the labelled rows that are read for each language: where there
    are more, a share of them is taken by the hash of the key. The driver holds a row of
    2**BITS counts for each language, and more than ``most_languages`` are refused.
    """
    labelled = docs.where(learn & named(lang).isNotNull() & named(text).isNotNull()).select(named(key).alias("k"), named(lang).alias("l"), named(text).alias("t"))
    totals = {r.l: r.n for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not totals:
        return LanguageModel()
    share = F.create_map(*[F.lit(x) for l, n in totals.items() for x in (l, min(1.0, rows_per_language / n))])
    sample = labelled.where((F.xxhash64("k") % 1_000_000 + 1_000_000) % 1_000_000 < F.element_at(share, F.col("l")) * 1_000_000)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in small(batches, 1):
            by: dict[str, list[str]] = {}
            for l, t in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                by.setdefault(l, []).append(t)
            for l, texts in by.items():
                total = sums.setdefault(l, np.zeros((1 << BITS) + 1, np.int64))
                for part in bounded([len(x) for x in texts], 1 << 19):
                    for h in ngrams(texts[part])[1]:
                        total += np.bincount(h, minlength=(1 << BITS) + 1)
        for l, total in sums.items():
            at = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["l", "bucket", "n"])

    counts = sample.select("l", "t").mapInArrow(count, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n"))

    def pack(pdf):
        row = np.zeros(1 << BITS)
        row[pdf["bucket"].to_numpy()] = pdf["n"].to_numpy()
        return pdf.iloc[:1][["l"]].assign(row=[row.tobytes()])

    rows = {r.l: np.frombuffer(bytes(r.row)) for r in counts.groupBy("l").applyInPandas(pack, "l string, row binary").collect()}
    languages = sorted(totals)
    weights = np.zeros(((1 << BITS) + 1, len(languages)))
    for k, l in enumerate(languages):
        n = rows.get(l, np.zeros(1 << BITS)) + alpha
        weights[:-1, k] = np.log(n / n.sum())
    prior = np.log(np.array([totals[l] for l in languages]) / sum(totals.values()))
    return LanguageModel(languages, prior, weights)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of each document, with lang_pred and score."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kept = [named(c) for c in keep]
    out = docs.select(*kept, named(text).alias(fresh("text", keep)))
    schema = extended(docs.select(*kept), "lang_pred string, score double")

    def run(batches):
        for batch in small(batches, len(keep)):
            labels, scores = held.value.score(strings(batch.column(batch.num_columns - 1)))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return numbered(out).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.0, text: str = "text") -> DataFrame:
    """The documents with a determined language of at least ``min_score``, all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in small(batches, at):
            labels, scores = held.value.score(strings(batch.column(at)))
            kept = batch.filter(pa.array([l != UNDETERMINED and s >= min_score for l, s in zip(labels, scores, strict=True)], pa.bool_()))
            yield kept.rename_columns(names)

    names = docs.columns
    return numbered(docs).mapInArrow(run, docs.schema)


def learnable(key: str = "doc_id") -> Column:
    return fold(F.col(key), 4) != 2
