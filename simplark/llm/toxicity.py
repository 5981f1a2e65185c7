"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbours and pairs with one word between,
hashed into 2**BITS buckets. Spark extracts the features of a bounded sample in parallel; one task
then runs FTRL-proximal over that sample, as each step needs the last one's weights, with a
learning rate for each coordinate and L1 that leaves most weights at zero. The weights that remain
are broadcast to score whole texts.

Defined cases: null and empty texts get the score of the intercept alone; without labelled rows, or
with one class only, the intercept is what the labels say and no word counts; several labels of a
document are each learned, as are rows that repeat a document, and each row is scored; labels of
unknown documents are ignored. A score of one half is toxic. Texts count whole, however long; the
task that learns holds at most ``most_features`` features. Kept columns may have any names but score
and predicted.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from simplark.llm.common import bounded, checked, cut, extended, fresh, held_by_worker, named, numbered, small, strings

BITS = 18
WORD = re.compile(r"[^\W_]+")
STEP = np.uint64(0x9E3779B97F4A7C15)
MEMO = 200_000


class Words(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxh64_intdigest(word.encode("utf-8", "replace"), 3)
        return h


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all features of the texts, repeats included."""
    known: Words = held_by_worker("toxicity", Words)
    if len(known) > MEMO:
        known.clear()
    found = [WORD.findall(t.lower()) for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    get = known.__getitem__
    h = np.fromiter((get(w) for ws in found for w in ws), np.uint64, counts.sum())
    doc = np.repeat(np.arange(len(texts)), counts)
    out = [(doc, h)]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        pair = (h[:-gap] * STEP + h[gap:] + np.uint64(gap)) * STEP
        out.append((doc[gap:][same], (pair ^ (pair >> np.uint64(29)))[same]))
    docs, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    return docs, (hashes * STEP >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    """Follow the regularised leader, proximal, over sets of buckets; bucket 2**BITS is the intercept."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.intercept)
        for part in bounded([len(x or "") for x in texts], 1 << 21):
            doc, bucket = features([x or "" for x in texts[part]])
            w = self.weights[bucket]
            used = np.flatnonzero(w)
            pairs = np.unique(doc[used] << BITS | bucket[used])
            out[part] += np.bincount(pairs >> BITS, self.weights[pairs & ((1 << BITS) - 1)], part.stop - part.start)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(
    docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", rows_per_class: int = 8_000, epochs: int = 8,
    most_features: int = 32_000_000,
) -> ToxicityModel:
    """Learn from labelled documents whose key satisfies ``learn``.

    ``rows_per_class`` bounds the rows that are read of each class: of more, a share is taken by
    the hash of the key, and the intercept is corrected for it. ``most_features`` bounds the features
    of the sample (4 bytes each); where texts are so long that there are more, a smaller share of
    both classes is learned from.
    """
    known = labels.where(learn & named(label).isin(0, 1)).select(named(key).alias("k"), named(label).cast("int").alias("y"))
    totals = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        odds = (totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)
        return ToxicityModel(np.zeros(1 << BITS), math.log(odds))
    rate = {y: min(1.0, rows_per_class / n) for y, n in totals.items()}
    share = F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])
    sample = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < share * 1_000_000)
    # About 2 * rows_per_class rows, but a document's labels stay together, so that is checked.
    joined = docs.select(named(key).alias("k"), F.coalesce(named(text), F.lit("")).alias("t")).join(checked(sample), "k")

    def extract(batches):
        for batch in small(batches, 0):
            texts = strings(batch.column(0))
            for part in bounded([len(x) for x in texts], 1 << 21):
                doc, bucket = features(texts[part])
                pairs = np.unique(doc << BITS | bucket)
                ends = np.searchsorted(pairs >> BITS, np.arange(part.stop - part.start + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([lists, *(c.slice(part.start, len(lists)) for c in batch.columns[1:])], ["buckets", "y", "o"])

    def learn_all(batches):
        seen = [(np.append(at, np.int32(1 << BITS)), y) for batch in batches for at, y in zip((x.values.to_numpy() for x in batch.column(0)), batch.column(1).to_pylist(), strict=True)]
        model = Ftrl()
        for _ in range(epochs):
            for at, y in seen:
                model.learn(at, y)
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["bucket", "w"])

    examples = cut(joined.select("t", "y", F.xxhash64("k", F.lit(1)).alias("o")).mapInArrow(extract, "buckets array<int>, y int, o long"))
    total = examples.agg(F.sum(F.size("buckets"))).first()[0] or 0
    if total > most_features:
        examples = examples.where(F.pmod(F.xxhash64("o", F.lit(2)), F.lit(1_000_000)) < most_features / total * 1_000_000)
    rows = examples.repartition(1).sortWithinPartitions("o").mapInArrow(learn_all, "bucket int, w double").toPandas()
    weights = np.zeros((1 << BITS) + 1)
    weights[rows["bucket"].to_numpy()] = rows["w"].to_numpy()
    return ToxicityModel(weights[:-1].copy(), float(weights[-1]) - math.log(rate[1] / rate[0]))


def predict(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep``, score and predicted of each document."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [named(c) for c in keep]
    out = docs.select(*kept, named(text).alias(fresh("text", keep)))
    schema = extended(docs.select(*kept), "score double, predicted int")

    def run(batches):
        for batch in small(batches, len(keep)):
            score = held.value.score(strings(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], schema.names)

    return numbered(out).mapInArrow(run, schema)
