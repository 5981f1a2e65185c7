"""Column names that clash, long texts, ties and repeats, for every operator and stage; brute force for three of them."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from simplark.llm import common, decontaminate, exact_dedup, language_id, lm_score, sentencepiece, sharding, simhash, token_ids, toxicity, warc
from simplark.llm.common import fold

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["__sha", "__text", "__d", "__s", "ids", "ids_in", "gone", "sha_of_text", "dropped_id", "score", "fp", "row", "t", "n", "hash", "we`ird", "a.b"]
LONG = "the quick brown fox and the lazy dog " * 4000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the dog and the fox were here", "en"), (2, "THE dog and the fox were here", "en"), (2, "THE dog and the fox were here", "en"), (3, LONG, "en"), (4, None, "en"), (5, "", "de"), (None, "der hund und die katze", "de"), (6, "der hund und die katze", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for k, name in enumerate(ODD):
        df = df.withColumn(name, F.lit(k))
    return df.cache()


def test_stages_keep_every_column(spark, docs):
    items = spark.createDataFrame([(1, "nothing of this stands in any text at all here")], "item_id long, text string")
    model = language_id.train(docs, F.lit(True))
    for made in (language_id.keep_identified(docs, model), exact_dedup.keep_one(docs), simhash.keep_one(docs), decontaminate.keep_clean(docs, items)):
        assert made.columns == docs.columns
        assert all(r[name] == k for r in made.collect() for k, name in enumerate(ODD))
    assert exact_dedup.keep_one(docs).count() == 4
    out = sentencepiece.encode(docs, MODEL)
    assert out.columns[-4:] == ["ids", "n_ids", "decoded", "round_trip"] and len(set(out.columns)) == len(out.columns)
    assert all(r.round_trip for r in out.collect()) and "ids_in_" in out.columns


def test_queries_take_any_columns(spark, docs, tmp_path):
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, toxic int")
    keep = ["doc_id", "__text", "t", "we`ird", "a.b"]
    model = toxicity.train(docs, labels, F.lit(True))
    assert toxicity.predict(docs, model, keep).count() == 8 and language_id.predict(docs.drop("score"), language_id.train(docs, F.lit(True)), keep).count() == 8
    assert lm_score.score(docs, fold(F.col("doc_id"), 5) != 1, F.lit(False)).count() == 8
    assert token_ids.round_trip(docs, f"file://{tmp_path}/t", BPE).count() == 8
    assert sharding.shard(docs).count() == 8 and simhash.near_dedup(docs).count() == 8 and exact_dedup.exact_dedup(docs).count() == 8
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit("u").alias("url"), *[common.named(c) for c in ODD])
    assert warc.round_trip(pages, f"file://{tmp_path}/w").count() == 8


def test_the_session_stays_as_it_was(spark, docs):
    before = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    simhash.near_dedup(docs).count()
    assert before == {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in before}


def test_batches_are_cut_by_bytes_and_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10] * 7 + ["b" * 1000, None, "c"])], ["t"])
    parts = list(common.small([batch], 0, rows=3, size=25))
    assert [p.num_rows for p in parts] == [2, 2, 2, 1, 1, 2] and pa.Table.from_batches(parts).to_pydict() == {"t": batch.column(0).to_pylist()}


def test_language_ties_go_to_the_first(spark):
    rows = [(i, "same words", l) for i, l in enumerate(["xx", "aa"] * 4)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert model.score(["same words"])[0] == ["aa"]


def plain_ftrl(examples, epochs, alpha=2.0, beta=1.0, l1=6.0):
    """FTRL-proximal with a dictionary, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= (0.0 if i == "bias" else l1):
            return 0.0
        s = np.sign(z[i]) * (0.0 if i == "bias" else l1)
        return -(z[i] - s) / ((beta + np.sqrt(n[i])) / alpha)

    for _ in range(epochs):
        for features, y in examples:
            w = {i: weight(i) for i in [*features, "bias"]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                step = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight


def test_toxicity_against_a_plain_learner(spark):
    r = random.Random(2)
    texts = [" ".join(r.choice("alpha beta gamma delta vile nasty".split()) for _ in range(12)) for _ in range(60)]
    rows = [(i, t, int("vile nasty" in t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.drop("text"), F.lit(True), epochs=3)
    order = [x.doc_id for x in docs.orderBy(F.xxhash64("doc_id", F.lit(1))).collect()]

    def buckets(text):
        return sorted(set(toxicity.features([text])[1].tolist()))

    weight = plain_ftrl([(buckets(texts[i]), rows[i][2]) for i in order], 3)
    want = [1 / (1 + np.exp(-(sum(weight(b) for b in buckets(t)) + weight("bias")))) for t in texts]
    assert np.allclose(model.score(texts), want, atol=1e-9)
    small = toxicity.train(docs.drop("toxic"), docs.drop("text"), F.lit(True), most_features=100)  # learns from fewer rows, and still scores
    assert 0 <= small.score(["alpha"])[0] <= 1


def plain_hits(text, item):
    """Whether a text has at least half of an item's template windows in one alignment's consistent form, by comparing all pairs of windows."""
    def toks(x):
        return decontaminate.TOKEN.findall(x)

    best, any_usable = 0.0, False
    for names in (True, False):
        def form(ts):
            out, before = [], False
            for w in ts:
                number = w[0].isdigit()
                unit = before and w.lower() in decontaminate.UNITS
                slot = 1 if number else 2 if unit else 3 if names and w[0].isupper() and len(w) > 1 else 0
                out.append((slot, w.lower()))
                before = number
            return out

        a, b = form(toks(text)), form(toks(item))
        width = min(8, len(b))
        if width < 5 or sum(s == 0 for s, _ in b) < 5:
            continue
        usable = [p for p in range(len(b) - width + 1) if sum(s == 0 for s, _ in b[p : p + width]) >= (2 if width == 8 else 5)]
        same = lambda x, y: x[0] == y[0] and (x[0] > 0 or x[1] == y[1])
        by_shift = {}
        for p in usable:
            for q in range(len(a) - width + 1):
                if all(same(x, y) for x, y in zip(a[q : q + width], b[p : p + width], strict=True)):
                    by_shift.setdefault(q - p, []).append(p)
        found = set()
        for shift, places in by_shift.items():
            values = {}
            for p in places:
                for k in range(p, p + width):
                    if b[k][0]:
                        values.setdefault(b[k], set()).add(a[k + shift])
            kept = [p for p in places if all(len(values[b[k]]) == 1 for k in range(p, p + width) if b[k][0]) or a[p + shift : p + shift + width] == b[p : p + width]]
            if len({k for p in kept for k in range(p, p + width) if b[k][0] == 0}) >= 5:
                found.update(kept)
        if usable:
            any_usable = True
            best = max(best, len(found) / len(usable))
    if not any_usable:  # looked for as it is
        a, b = ([w.lower() for w in toks(x)] for x in (text, item))
        best = float(any(a[q : q + len(b)] == b for q in range(len(a) - len(b) + 1)))
    return best


def test_decontamination_against_all_pairs(spark):
    r = random.Random(9)
    words = "the a train walks red ball shop how many apples does give to and has more than total river".split()

    def question():
        return " ".join(r.choice([r.choice(words), r.choice(words), r.choice(words), str(r.randint(2, 40)), r.choice(["Anna", "Bob", "Eve"]), f"{r.randint(2, 9)} miles"]) for _ in range(r.randint(9, 13)))

    items = [(i, question()) for i in range(12)]
    texts = []
    for i in range(40):
        ts = r.choice(items)[1].split()
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(ts))
            ts[k] = str(r.randint(2, 40)) if ts[k].isdigit() else r.choice(["Tom", "Zoe", *words]) if ts[k][0].isupper() else r.choice(words)
        texts.append((i, f"{r.choice(words)} {' '.join(ts)} {r.choice(words)}"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.coverage for x in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), coverage=0.5).collect() if x.coverage >= 0.5}
    want = {(d, i): c for d, t in texts for i, q in items if (c := plain_hits(t, q)) >= 0.5}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 15


def test_items_without_words_are_found_as_they_are(spark):
    items = spark.createDataFrame([(1, "what is 12 * 7 + 30 - 4 * 9 + 2 ?"), (2, "13 + 5"), (3, "7 8")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so, What is 12*7+30 - 4 * 9 + 2? It is"), (2, "what is 12 * 7 + 30 - 4 * 9 + 3 ?"), (3, "13 5"), (4, "a 13 + 5 b"), (5, "what is 12 * 7 + 30 and 30 - 4 * 9 + 2")], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs, items).collect()} == {(1, 1), (3, 2)}


def test_shards_against_plain_sums_and_versions(spark, tmp_path):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    out = {r.doc_id: r for r in sharding.shard(docs, 16, "bytes", path).collect()}
    for i, t in rows:
        assert out[i].size == len(t) + 1 and out[i].text_crc32 == zlib.crc32(t.encode())
    loads = [sum(r.size for r in out.values() if r.shard == s) for s in range(16)]
    assert max(loads) - min(loads) <= 2 and sharding.latest_version(spark, path) == 1
    stored = sharding.load_map(spark, path, 1)
    assert all(stored[r.virtual_slot] == r.shard for r in out.values())
    more = docs.unionByName(spark.createDataFrame([(i, "y" * 500) for i in range(5000, 5200)], "doc_id long, text string"))
    again = {r.doc_id: r for r in sharding.shard(more, 16, "bytes", path).collect()}
    assert sharding.latest_version(spark, path) == 2
    moved = sum(again[i].shard != out[i].shard for i in out)
    assert moved < len(out) / 2  # the next version is an edit of the last
    sizes = [0] * 4096
    for r in again.values():
        sizes[r.virtual_slot] += r.size
    assert sharding.load_map(spark, path, 2) == sharding.rebalanced_map(stored, sizes, 16)


def test_more_ranges_find_the_same_links(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 30, dtype=np.uint64)[rng.integers(0, 30, 400)]
    for _ in range(5):
        x ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    x = np.unique(x)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    want = simhash.Forest(len(x))
    for i in range(len(x)):
        j = np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 4)
        want.join(np.full(len(j), i), j)
    for parts in (5, 6, 7):
        got, at = simhash.Forest(len(x)), {int(v): i for i, v in enumerate(x.view(np.int64))}
        edges = simhash.link_buckets(df, parts=parts).collect()
        got.join(np.array([at[e.a] for e in edges], int), np.array([at[e.b] for e in edges], int))
        assert (got.root(np.arange(len(x))) == want.root(np.arange(len(x)))).all()
    assert [simhash.parts_for(n) for n in (10, 1 << 24, 1 << 25, 1 << 34)] == [5, 5, 6, 7]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 20), (2, 3), (3, 6), (4, 1)) for i in range(n)], "k long, i long")
    found = spark.createDataFrame([(1, "a", 20), (2, "b", 3), (3, "c", 6)], "k long, v string, n long")
    assert sorted(map(tuple, common.join_keys(rows, found, ["k"], "n").groupBy("k", "v").count().collect())) == [(1, "a", 20), (2, "b", 3), (3, "c", 6)]
    assert common.join_keys(rows, found, ["k"], "n", "left").where("v IS NULL").count() == 1
