"""Importance resampling against a plain loop, its hashes against zlib, its sort against sorted()."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from simplark.llm import resample


def features(text, longest=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target):
    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        words, found = features(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (T + 10000.0)))) for b in map(bucket, found))
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(([*r[:4], rank.get(id(r)), r[4]] for r in rows), key=str)


def test_resample_equals_brute_force(spark):
    rng = random.Random(1)
    words = [*"the of and Haus über 語 x1 1".split(), "w" * 70]
    docs = [(k - 40, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(300)]
    docs += [(900, None), (901, ""), (902, "  . "), (None, docs[1][1] + " the" * 30), (903, "the of " * 20_000), (90_000, "x1 " * 30), (-90_000, "x1 " * 30)]
    target = [" ".join(rng.choices(words[:4], k=30)) for _ in range(20)] + [None]
    df = spark.createDataFrame([(k, t, "a", "b") for k, t in docs], "doc_id long, text string, rank string, weight string").repartition(3)
    got = resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert sorted((list(r) for r in got.collect()), key=str) == brute(docs, target)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(7, "a b c d e " * 5)] * 40 + [(8, "short")], "doc_id long, text string")
    got = resample.resample(docs, docs.limit(0)).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 11)) and len(got) == 41
    assert resample.resample(docs.limit(0), docs).count() == 0


@pytest.mark.parametrize("block,digit,ids", [(1 << 17, 12, [-(1 << 63), (1 << 63) - 1, 0, 77]), (8, 3, [-9, 0, 7, 30])])
def test_the_sort_is_whole_and_stable(spark, block, digit, ids, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "DIGIT", digit)
    rng = random.Random(4)
    rows = [(rng.choice([-5, 0, 3, 40]), rng.choice(ids), i) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(7)
    got = resample.ranked(df, ["a", "b"]).collect()
    assert sorted(r.place for r in got) == list(range(300)) and sorted(r.i for r in got) == list(range(300))
    placed = [(r.a, r.b) for r in sorted(got, key=lambda r: r.place)]
    assert placed == sorted(placed)
    ends = resample.ranked(df, ["a"]).withColumnRenamed("place", "before")
    kept = resample.radix_pass(ends.withColumnRenamed("before", "place"), "0").select("i", "place").collect()
    assert {r.i: r.place for r in kept} == {r.i: r.before for r in ends.collect()}


@pytest.mark.parametrize("longest", [1, 2, 3, 4])
def test_checksums_of_runs(longest):
    rng = np.random.default_rng(0)
    texts = [[bytes(rng.integers(97, 100, rng.integers(1, 90)).astype(np.uint8)) for _ in range(n)] for n in (0, 1, 2, 3, 7, 20)]
    got = Counter((int(c), int(o)) for crcs, owner in resample.feature_crcs(texts, longest) for c, o in zip(crcs, owner, strict=True))
    assert got == Counter((zlib.crc32(b" ".join(t[i : i + n])), k) for k, t in enumerate(texts) for n in range(1, longest + 1) for i in range(len(t) - n + 1))
