"""License scans against all blocks and all templates."""

import random
import re

import pytest

from simplark.llm import licenses


def brute(text, phrases, notices, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    shares = []
    for label, notice in notices:
        tokens, step = set(notice.split()), len(notice.split())
        for start in range(0, len(words), step):
            share = len(tokens & set(words[start : start + 2 * step])) / len(tokens)
            if share >= threshold - 1e-12:
                shares.append((label, share))
    at = [i for i, _ in places]
    base = sorted({label for _, label in places})
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *(x for x, _ in shares)})), 1.0 if at else max((s for _, s in shares), default=0.0))


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_scan_equals_brute_force(spark, threshold):
    rng = random.Random(2)
    phrases = [("p", "a b"), ("q", "b a a"), ("p", "c")]
    notices = [("n", "a b c d e"), ("m", "e f g h i j k l m n"), ("l", "a a b x ä")]
    texts = [rng.choice([" ", "\n", "-", "\x0b", "!"]).join(rng.choices("abcdefghijklmnxyäÄ0", k=rng.randrange(0, 60))) for _ in range(400)]
    texts += [None, "", " . ", "A B", "e f g h i j k l m n", "CC BY " * 3000, texts[0], texts[0]]
    docs = spark.createDataFrame([(k % 390, t, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, labels string, score int")
    got = licenses.scan(docs, phrases=phrases, notices=notices, threshold=threshold)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((k % 390, *brute(t, phrases, notices, threshold))) for k, t in enumerate(texts))


def test_the_templates_tell_licenses_apart(spark):
    notice = dict(licenses.NOTICES)
    texts = {
        "Licensed under CC BY-NC 4.0.": "cc-by", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "the MIT license": "mit",
        f"x {notice['mit'].upper()}": "mit", notice["bsd"].replace(" ", "\n"): "bsd", notice["isc"]: "isc", notice["cc-by"]: "cc-by", "permission was not granted to use this software": "", "by cc": "",
    }
    got = licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r.doc_id: r.labels for r in got.collect()} == dict(enumerate(texts.values()))
    assert all((r.score > 0) == bool(r.labels) and r.labels.startswith(r.base_labels) for r in got.collect())


def test_an_empty_table_and_templates_without_words(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        licenses.templates([("x", " - ")], [])
