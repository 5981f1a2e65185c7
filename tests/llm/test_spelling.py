"""Spelling variants against brute force, over trees of many leaves and parts."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from simplark.llm import spelling


def edits(word, alphabet):
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :] if i < len(word) else word
        yield word[:i] + word[i + 1 :] if i < len(word) else word


def brute(rows):
    seen = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in seen.items() if len(w) >= 5 and k >= 3}
    alphabet = {c for w in n for c in w}
    near = {w: {e for e in edits(w, alphabet) if e in n and e != w} for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = ["an", "er", "th", "in", "ô", "É", "ss", "a", "×"]
    words = ["".join(rng.choices(parts, k=rng.randrange(3, 6))) for _ in range(300)]
    rows = [(k, " ".join(rng.choices(words, k=40)).title() if k % 3 else "-".join(rng.choices(words, k=40))) for k in range(150)]
    return [*rows, (1, rows[1][1]), (None, rows[2][1]), (500, None), (501, "..."), (502, "Hauses hausen " * 9 + ("z" * 3000 + " ") * 3 + ("z" * 3001 + " ") * 7), (503, "abcdef " * 3 + "abcdefg " * 6 + "abcdefgh " * 12 + "abcdefghi " * 30)]


@pytest.mark.parametrize("leaf,part", [(8192, 262_144), (20, 50)])
def test_spelling_equals_brute_force(spark, rows, leaf, part, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "PART", part)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, word string, n string").repartition(5)
    got = spelling.spelling(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(f != r for _, f, r, *_ in got if f)  # some ways have more than one step


def test_empty_tables_have_no_words(spark):
    assert spelling.spelling(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling(spark.createDataFrame([(1, None), (2, "once only words")], "doc_id long, text string")).count() == 0


def test_trees_lose_no_neighbour():
    rng = np.random.default_rng(3)
    for length in (5, 9, 23, 24, 60):
        points = rng.integers(97, 103, (400, length)).astype(np.uint8)
        same = points.copy()
        same[np.arange(400), rng.integers(0, length, 400)] = rng.integers(97, 123, 400)
        shorter = np.delete(points, length // 2, axis=1)
        tree = spelling.Tree(spelling.vectors(points, length), 8)
        kept = spelling.vectors(points, length)[tree.order]
        starts = tree.start[tree.split < 0]
        tree.boxed(np.bitwise_and.reduceat(kept, starts), np.bitwise_or.reduceat(kept, starts))
        for queries, short in ((same, False), (shorter, True)):
            pairs = [p for a, b in spelling.candidates(tree, spelling.vectors(points, length), spelling.vectors(queries, length), np.full(400, short)) for p in zip(a.tolist(), b.tolist(), strict=True)]
            assert len(pairs) == len(set(pairs)) and {(i, i) for i in range(400)} <= set(pairs)


def test_one_edit():
    def near(a, b):
        return bool(spelling.one_edit(spelling.codes([a]), spelling.codes([b]))[0])

    assert near("haus", "maus") and near("haus", "hauss") and near("aus", "haus") and near("has", "haus")
    assert not near("haus", "haus") and not near("haus", "ahus") and not near("abcd", "bcdea") and not near("abc", "cbad")
