"""Exact and SimHash deduplication against brute force, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from simplark.llm import exact_dedup, simhash
from simplark.llm.components import components
from simplark.llm.exact_dedup import CountingQuotientFilter

SCHEMA = "doc_id long, text string, lang string, kept boolean, fp string"  # the last two clash with names of the operators


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", True, "x") for i, t in rows], SCHEMA)


ROWS = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "same"), (7, "same"), (9, "x" * 200_000), (10, "x" * 200_000), (None, "SAME"), (None, None), (12, "alone")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**64, 500, dtype=np.uint64) & np.uint64(0xFFF0_0000_0000_000F) for _ in "ab")
    merged = CountingQuotientFilter.build(a).merge(CountingQuotientFilter.build(b))
    values, counts = np.unique(np.concatenate((a, b)), return_counts=True)
    assert (merged.fingerprints() == values).all() and (merged.counts == counts).all()
    assert all((np.diff(r.astype(object)) > 0).all() for _, r, _ in merged.blocks())
    empty = CountingQuotientFilter.build(np.zeros(0, np.uint64))
    assert len(empty.fingerprints()) == 0 and (empty.merge(merged).counts == counts).all()


def test_exact_groups(spark):
    out = exact_dedup.exact_dedup(table(spark, ROWS)).collect()
    assert len(out) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    for sha in by_sha:
        assert sum(r.kept for r in out if r.text_sha256 == sha) == 1


def test_exact_stage_keeps_one_row_and_all_columns(spark):
    docs = table(spark, ROWS).repartition(3)
    out = exact_dedup.keep_one(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert sorted(lower(r.text) for r in rows) == sorted({lower(t) for _, t in ROWS})
    assert {r.doc_id for r in rows} == {2, 4, 5, 6, 7, 10, 12}


def test_empty_tables(spark):
    docs = table(spark, [])
    assert exact_dedup.exact_dedup(docs).count() == 0 and exact_dedup.keep_one(docs).count() == 0
    assert simhash.near_dedup(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_bit_by_bit(spark):
    texts = ["one two three four five six", "ONE  two\tthree", "a\x0bb\x0cc\rd", "", None, "   ", "é É ß " * 50, "a b c d " * 400]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    native = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    assert native % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def reach(fps, ids, distance=4):
    best = dict(enumerate(ids))
    moved = True
    while moved:
        moved = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= distance and best[j] < best[i]:
                    best[i], moved = best[j], True
    return [best[i] for i in range(len(fps))]


def test_components_match_brute_force(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(120)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(8):
            words = b.split()
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(["iota", "kappa"])
            texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(100, ""), (101, None), (102, " \n")]
    out = {x.doc_id: x for x in simhash.near_dedup(table(spark, rows).repartition(5)).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    want = reach(fps, [i for i, _ in rows])
    assert [out[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [out[i].component_id for i, _ in rows] == want
    kept = sorted(x.doc_id for x in simhash.keep_one(table(spark, rows)).collect())
    assert kept == sorted(set(want))


@pytest.mark.parametrize(("n", "centres", "flips"), [(1, 1, 0), (400, 3, 6), (600, 40, 4), (3000, 1, 5)])
def test_index_finds_what_brute_force_finds(n, centres, flips):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**64, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        m = rng.random(n) < 0.7
        x[m] ^= np.uint64(1) << rng.integers(0, 64, m.sum()).astype(np.uint64)
    x = np.unique(x)
    bucket = np.sort(rng.integers(0, 3, len(x)))
    order = np.lexsort((simhash.gray_rank(x), bucket))
    x, bucket = x[order], bucket[order]
    a, b = simhash.linked(x, bucket, most=1 << 12)
    assert (np.bitwise_count(x[a] ^ x[b]) <= 4).all() and (bucket[a] == bucket[b]).all() and len(a) < max(2, len(x))
    got, want = simhash.Forest(len(x)), simhash.Forest(len(x))
    got.join(a, b)
    for i in range(len(x)):
        j = np.flatnonzero((np.bitwise_count(x[i] ^ x) <= 4) & (bucket == bucket[i]))
        want.join(np.full(len(j), i), j)
    every = np.arange(len(x))
    assert (got.root(every) == want.root(every)).all()


def test_gray_order_changes_one_bit_at_a_time():
    codes = np.arange(256, dtype=np.uint64) ^ (np.arange(256, dtype=np.uint64) >> np.uint64(1))
    assert (simhash.gray_rank(codes) == np.arange(256)).all()


def test_long_paths_settle(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows = components(edges).collect()
    assert len(rows) == 301 and {r.root for r in rows} == {0}
    assert components(edges.limit(0)).count() == 0
