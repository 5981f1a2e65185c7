"""Encoders, language ID, decontamination, toxicity and language-model scoring."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from simplark.llm import decontaminate, language_id, lm_score, token_ids, toxicity
from simplark.llm import sentencepiece as sp
from simplark.llm.common import fold

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " a", "  a", "   hello  world ", "\n\n x\n  y", " 中文 test  中", "▁▁x", "\t\ttab  \t x", "naïve café — “quotes” 123,456.78 <s>", "🙂🙂 e", "    ", "x" * 300, " " * 37 + "z", "word " * 3000, "y" * 20_000]


@pytest.fixture(scope="module")
def encoder():
    return sp.Encoder(sp.PieceModel(MODEL))


def test_pieces_are_the_librarys(encoder):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(0)
    pieces = list(encoder.by_text)
    texts = ODD + ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(3000)] + ["".join(r.choice("etaoinshr dlu ") for _ in range(r.randint(1, 200))) for _ in range(500)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert encoder.decode(ids) == text.replace("▁", " ")


def test_unigram_paths_are_as_good_as_the_librarys(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    rng = np.random.default_rng(0)
    for p in proto.pieces:
        if p.type == 1:
            p.score = float(-abs(rng.normal(8, 2)))
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    ours, library = sp.Encoder(sp.PieceModel(str(path))), sentencepiece.SentencePieceProcessor(model_file=str(path))
    r = random.Random(1)
    texts = ["".join(r.choice("etaoinshr dlu") for _ in range(r.randint(1, 60))) for _ in range(300)]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        mine, theirs = (sum(ours.m.scores[i] for i in x) for x in (ids.tolist(), library.encode(text)))
        assert mine >= theirs - 1e-3


def test_round_trip_table(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*ODD[:9], None])], "doc_id long, text string, ids int")
    rows = sp.encode(docs, MODEL).orderBy("doc_id").collect()
    assert all(r.round_trip for r in rows if "▁" not in (r.text or "")) and rows[-1].ids == [] and rows[0].ids_in == 1
    again = sp.decode(sp.encode(docs, MODEL, ["doc_id"]).drop("decoded"), MODEL).where("doc_id = 4").first()
    assert again.decoded == ODD[4]
    assert sp.encode(docs.limit(0), MODEL).count() == 0


def test_simple8b():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 60, 61, 1023, 1024, 1025, 5000):
        for high in (1, 2, 1000, 50257, 2**33, 2**63):
            x = rng.integers(0, high, n, dtype=np.uint64)
            words, firsts = token_ids.pack(x)
            assert (token_ids.unpack(words, firsts, n) == x).all()
    x = np.full(3000, 2**64 - 1, np.uint64)
    assert (token_ids.unpack(*token_ids.pack(x), 3000) == x).all()
    assert token_ids.pack(np.zeros(1024, np.uint64))[0].nbytes < 160


def test_damaged_file_is_refused():
    raw = bytearray(token_ids.build_file([1, None], np.array([2, 1]), np.array([5, 0, 0], np.uint32)))
    assert token_ids.parse_file(bytes(raw))[0] == [1, None]
    raw[60] ^= 1
    with pytest.raises(ValueError):
        token_ids.parse_file(bytes(raw))


def test_pieces_encode_like_whole_texts():
    e = token_ids.BpeEncoder(open(BPE).read())
    r = random.Random(0)
    alphabet = " \t\n\r\x0b\x0c\x1c\x1d\x85\xa0 　​abcA1'.,!?é中🙂ñ's'll-\u3000\u1680"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["<|endoftext|> x", *ODD, None, "a" * 300 + " b"]
    for size in (1, 7, 1000):
        for i in range(0, len(texts) if size > 1 else 300, size):
            some = texts[i : i + size]
            ids, counts = e.encode(pa.array([*some, "tail"], pa.string()).slice(0, len(some)), 0)
            at = 0
            for text, n in zip(some, counts.tolist(), strict=True):
                assert ids[at : at + n - 1].tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids and ids[at + n - 1] == 0, text
                at += n
            assert at == len(ids)
    assert e.encode(pa.array([], pa.string()), 0)[0].tolist() == [] and e.encode(pa.array([None, ""], pa.string()), 0)[0].tolist() == [0, 0]


def test_token_files_against_the_library(spark, tmp_path):
    rows = [(i * 7 % 50, f"text number {i} " * (i % 5)) for i in range(50)] + [(60, None), (61, "z " * 30_000), (61, "z"), (None, "none")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, o int").repartition(4)
    path = f"file://{tmp_path}/tokens"
    token_ids.write_tokens(docs, path, BPE, segment_ids=500)
    out = token_ids.with_starts(token_ids.read_tokens(spark, path)).collect()
    library = Tokenizer.from_file(BPE)
    assert len(out) == len(rows) and len(list((tmp_path / "tokens").glob("part-*"))) > 1
    out.sort(key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, *sorted(i for i, _ in rows if i is not None)]
    at = 0
    texts = dict(rows)
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 0
        at += r.n_tokens
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id != 61:
            assert r.ids[:-1] == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    assert token_ids.round_trip(docs.limit(0), f"{path}-empty", BPE).count() == 0


LANGS = {"en": "the of and to in that is was he for it with as his on be at by".split(), "de": "der die und das nicht ein eine über für schön größe haus".split(), "fr": "le la et les des une être déjà garçon où à côté".split()}


def corpus(spark, n=240):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(LANGS[l]) for _ in range(12)), l) for i, l in enumerate(r.choice(list(LANGS)) for _ in range(n))]
    return spark.createDataFrame([*rows, (1000, None, "en"), (1001, "123 %%", "de"), (1002, "", None), (None, "the of and to", "en")], "doc_id long, text string, lang string")


def test_languages(spark):
    docs = corpus(spark).withColumn("score", F.lit("clash"))
    model = language_id.train(docs, language_id.learnable())
    out = {r.doc_id: r for r in language_id.predict(docs, model, ["doc_id", "lang"]).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].lang_pred == out[i].lang for i in held) and all(0 <= r.score <= 1 for r in out.values())
    assert {out[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and out[None].lang_pred == "en"
    kept = language_id.keep_identified(docs, model)
    assert kept.schema == docs.schema and kept.count() == 241


def test_language_scores_match_a_plain_loop(spark):
    model = language_id.train(corpus(spark), F.lit(True))
    text = "Das  Haus, was für 3!"
    _, hashes, _ = language_id.ngrams([text])
    logs = model.prior + sum(model.weights[b] for h in hashes for b in h)
    labels, scores = model.score([text, "der die das"])
    assert labels[0] == model.languages[int(np.argmax(logs))] and math.isclose(scores[0], 1 / np.exp(logs - logs.max()).sum())
    alone = model.score(["der die das"])
    assert alone[0][0] == labels[1] and math.isclose(alone[1][0], scores[1])  # neighbours in a batch don't matter


def test_no_labels_and_no_rows(spark):
    docs = corpus(spark)
    assert language_id.train(docs, F.lit(False)).score(["the"]) == (["und"], [0.0])
    empty = language_id.train(docs.limit(0), F.lit(True))
    assert language_id.predict(docs.limit(0), empty, ["doc_id"]).count() == 0


ITEM = "A train travels from Berlin to Munich at 120 km per hour and takes 5 hours so how far did the train travel in total"


def leaks(spark, texts, items=((1, ITEM), (2, None), (3, ""), (4, "two words"))):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, hash string")
    return decontaminate.contaminated(docs, spark.createDataFrame(list(items), "item_id long, text string"))


def test_leaks_and_slots(spark):
    other = ITEM.replace("Berlin", "Paris").replace("Munich", "Lyon").replace("120", "90").replace("5", "7")
    mixed = "A train travels from Paris to Paris at 90 km per hour and takes 7 hours so how far did the train travel in total"
    texts = [f"intro words {ITEM} end", f"intro {other} end", ITEM.lower(), ITEM.replace(" ", "\n"), "unrelated text about trains and hours", None, "", "pad " * 50_000 + ITEM, f"{ITEM[:60]}", mixed]
    out = {r.doc_id: r for r in leaks(spark, texts).collect()}
    assert set(out) - {9} == {0, 1, 2, 3, 7}
    assert out[0].verbatim and not out[1].verbatim and out[0].coverage == 1 and all(r.item_id == 1 for r in out.values())
    rows = leaks(spark, ["x"], ()).collect()
    assert rows == []


def test_inconsistent_slots_are_refused(spark):
    item = "If Ann has 3 red balls and Bob has 3 blue balls then Ann gives Bob 3 balls and we ask how many Ann has now"
    same = item.replace("3", "8").replace("Ann", "Eve").replace("Bob", "Tom")
    clash = "If Eve has 8 red balls and Tom has 9 blue balls then Zoe gives Sam 7 balls and we ask how many Kim has now"
    out = {r.doc_id for r in leaks(spark, [same, clash], [(1, item)]).collect()}
    assert out == {0}


def test_renamed_and_renumbered_questions_and_excerpts(spark):
    apples = "John has 12 apples. Mary has 15 apples. Bill has 7 apples. Who has the most apples?"
    walks = "Maria walks 4 miles on Monday and 6 miles on Tuesday. Peter walks 3 miles each day. How many miles does Maria walk more than Peter?"
    excerpted = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    other_apples = "Tom has 4 apples. Eve has 19 apples. Zoe has 8 apples. Who has the most apples?"
    other_walks = "Clara walks 9 miles on Friday and 2 miles on Sunday. Hugo walks 5 miles each day. How many miles does Clara walk more than Hugo?"
    part = " ".join(excerpted.split()[20:34])
    weak = "Tom has 4 apples. Eve has 19 apples on the table."  # the only common windows have four ordinary words
    short = " ".join(excerpted.split()[20:30])
    items = [(1, apples), (2, walks), (3, excerpted)]
    out = {(r.doc_id, r.item_id): r for r in leaks(spark, [f"see {other_apples} end", f"see {other_walks} end", f"before {part} after", weak, short], items).collect()}
    assert set(out) == {(0, 1), (1, 2), (2, 3)}
    assert out[0, 1].coverage == 1 and out[1, 2].coverage == 1 and out[2, 3].coverage < 0.5
    assert not out[0, 1].verbatim and out[2, 3].verbatim


def test_equal_draws_and_single_edits_are_found(spark):
    cards = "John buys 3 red cards and 4 blue cards in the shop and asks how much he pays for all cards together"
    equal = cards.replace("John", "Tom").replace("3", "5").replace("4", "5")
    birds = "Today Anna counts birds near the old mill by the river and writes each kind down in a thick book before she walks home to tell Anna about them"
    edited = birds.replace("tell Anna", "tell Maria")
    miles = "Miles walks 4 miles to the small shop at the corner and then back to the house where Miles lives"
    kept = miles.replace("Miles", "Peter").replace("4 miles", "9 km")  # a name and a unit that are written alike
    out = {(r.doc_id, r.item_id): r for r in leaks(spark, [equal, edited, kept], [(1, cards), (2, birds), (3, miles)]).collect()}
    assert set(out) == {(0, 1), (1, 2), (2, 3)}
    assert out[0, 1].coverage == 1 and out[2, 3].coverage == 1
    windows = [{"item_slots": a, "doc_slots": b} for a, b in ((["3:anna"], ["3:anna"]), (["3:anna"], ["3:maria"]), (["1:3", "1:4"], ["1:5", "1:5"]))]
    assert decontaminate.consistent(windows) == [windows[0], windows[2]]


def test_decontamination_stage(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM}", "a"), (2, "clean", "b"), (2, "clean", "b"), (None, "clean", "c")], "doc_id long, text string, __d string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontaminate.keep_clean(docs.withColumnRenamed("__d", "n"), items)
    assert sorted(r.n for r in kept.collect()) == ["b", "b", "c"] and kept.columns == ["doc_id", "text", "n"]


def test_an_item_with_few_words_among_numbers_is_found(spark):
    item = "alpha beta 1 2 3 4 5 6 7 8 gamma 1 2 3 4 5 6 7 8 delta 1 2 3 4 5 6 7 8 epsilon 9 9 9 9 9 9 9 9"
    out = {r.doc_id: r for r in leaks(spark, [f"see {item.upper()}, end", item.replace("gamma", "omega"), item[: len(item) // 2]], [(1, item)]).collect()}
    assert set(out) == {0} and out[0].coverage == 1 and out[0].verbatim


def test_texts_of_one_doc_id_or_none_are_judged_apart(spark):
    words = ITEM.split()
    halves = [" ".join(words[:13]), " ".join(words[11:24])]
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(None, halves[0], "a"), (None, halves[1], "b"), (7, halves[0], "c"), (7, halves[1], "d"), (8, halves[0], "e"), (9, halves[1], "f"), (None, f"x {ITEM}", "g"), (8, ITEM, "h"), (9, ITEM, "i"), (9, ITEM, "j"), (8, None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    single = {r.doc_id: r.coverage for r in decontaminate.contaminated(docs.where("row IN ('e', 'f')"), items, coverage=0.1).collect()}
    both = {r.doc_id: r.coverage for r in decontaminate.contaminated(docs.where("row < 'e'"), items, coverage=0.1).collect()}
    assert set(both) == {None, 7} and both[None] == both[7] == max(single.values()) < 1
    kept = decontaminate.keep_clean(docs, items, coverage=0.9)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == ["a", "b", "c", "d", "e", "f", "k"]


def test_a_window_that_all_items_and_documents_have(spark, monkeypatch):
    passage = "this very passage of plain words stands in each and every item and document of all"
    tails = ["the green boat sails over calm water to a far island", "seven grey birds fly north above the cold wide sea", "old clocks tick slowly in the dark hall of stone"]
    items = [(i, f"{passage} {t}") for i, t in enumerate(tails)]
    texts = [f"{passage} {tails[k % 3]}" if k < 6 else f"{passage} filler number {k}" for k in range(40)]
    want = sorted(map(tuple, leaks(spark, texts, items).collect()))
    assert {(d, i) for d, i, c, *_ in want if c == 1} == {(k, k % 3) for k in range(6)}
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 5)
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 10)
    assert sorted(map(tuple, leaks(spark, texts, items).collect())) == want


def test_blocks_of_hashes_give_the_same(spark, monkeypatch):
    want = {(r.doc_id, r.item_id) for r in leaks(spark, [f"a {ITEM} b"] * 3).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK", 5)
    assert {(r.doc_id, r.item_id) for r in leaks(spark, [f"a {ITEM} b"] * 3).collect()} == want and want


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        text = [r.choice(words) for _ in range(30)]
        if i % 4 == 0:
            for _ in range(2):
                text[r.randrange(30)] = r.choice(["Nasty!", "VILE", "awful,"])
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(9000, None, ""), (9001, "", ""), (None, "vile", "")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(777777, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 5) != 0)
    out = {x.doc_id: x for x in toxicity.predict(docs, model, ["doc_id"]).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == y for i, y in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out.values()) and out[9000].score == out[9001].score
    assert 0 < (model.weights != 0).sum() < 3000
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert toxicity.predict(docs.limit(3), none, ["doc_id"]).count() == 3
    assert toxicity.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_ftrl_matches_the_formulas():
    f = toxicity.Ftrl(alpha=0.5, l1=0.1, l2=0.2)
    at = np.array([3, 9])
    f.learn(at, 1)
    g = 0.5 - 1
    z, n = g, g * g
    assert np.allclose(f.z[at], z) and np.allclose(f.weights(at), -(z + 0.1) / ((1 + abs(g)) / 0.5 + 0.2)) and math.isclose(n, f.n[3])


def lm_rows(spark):
    r = random.Random(0)
    words = ["alpha", "beta", "Gamma", "delta,", "ünder"]
    rows = [(i, " ".join(r.choice(words) for _ in range(20)) + (f" rare{i}" if i % 3 == 0 else "")) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "q" * 150_000), (None, "alpha beta"), (5, rows[5][1])]


def test_base_scores_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT", 4)
    monkeypatch.setattr(lm_score.frequent_words, "__defaults__", (4,))
    rows = lm_rows(spark)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    out = lm_score.score(docs, fold(F.col("doc_id"), 5) != 1, F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))).collect()
    counts = Counter()
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    split = lambda t: [*(t or "").encode().lower().split(), None]
    for i, t in rows:
        if train(i):
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    assert len(out) == len(rows)
    for r in out:
        ws = split(texts[r.doc_id])
        assert r.n_tokens == len(ws) and r.train_tokens == n and r.n_known == sum(w in counts for w in ws) and r.held_out == (r.doc_id is not None and not train(r.doc_id))
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def mixing(texts):
    symbols = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=257)
    symbols[256] = len(texts)
    code = lm_score.Code(*lm_score.huffman(symbols))
    learner = lm_score.Learner(code)
    learner.learn(texts[: len(texts) // 2])
    learner.learn(texts[len(texts) // 2 :])
    tables = []
    for t in learner.tables:
        pair = t.reshape(-1, 2) + lm_score.PRIOR
        tables.append(np.clip(np.rint(np.log(pair[:, 1] / pair[:, 0]) * lm_score.SCALE), -127, 127).astype(np.int8))
    return lm_score.MixingModel(code, tables, learner.weights, np.tile((np.arange(lm_score.BUCKETS) - 16) / 2, 257).astype(np.float32)), learner


def slow_bits(model, text):
    """The cost of a text bit by bit, its contexts taken from the text's own bytes."""
    symbols = [*text, lm_score.END]
    total = 0.0
    for i, symbol in enumerate(symbols):
        c = lm_score.Contexts.of(np.array([lm_score.PAD] * 5 + symbols[: i + 1], np.int16))
        hashed = [int(h[-1]) for h in c.hashed]
        for depth in range(int(model.code.length[symbol])):
            node, bit = int(model.code.nodes[symbol, depth]), int(model.code.bits[symbol, depth])
            logits = []
            for table, h, (_, bits) in zip(model.tables, hashed, lm_score.ORDERS, strict=True):
                spread = node * 0x85EBCA77 % 2**32
                at = (h >> 32 - bits) ^ (spread >> 26) if bits > 20 else ((h ^ spread) * 0x9E3779B1 % 2**32) >> 32 - bits
                logits.append(int(table[at]) / lm_score.SCALE)
            gate = 4 * min(depth, 15) + 2 * (logits[2] != 0) + (logits[3] != 0)
            mix = max(-8.0, min(8.0, sum(float(model.weights[gate, k]) * logits[k] for k in range(4))))
            refined = float(model.map[node * lm_score.BUCKETS + int(mix * 2 + 16.5)])
            p = 1 / (1 + math.exp(-(mix + refined) / 2))
            total -= math.log2(p if bit else 1 - p)
    return total


def test_model_matches_a_loop_over_bits_and_learns():
    r = random.Random(0)
    texts = [" ".join(r.choice(["the", "cat", "sat", "mat"]) for _ in range(40)).encode() for _ in range(200)]
    model, learner = mixing(texts)
    assert model.bits([b"the cat sat"])[0] < model.bits([b"xq zvk wpj"])[0] / 3
    assert math.isclose(sum(2.0 ** -int(n) for n in model.code.length[:257]), 1)
    assert np.allclose(model.bits(texts[:5]), [model.bits([t])[0] for t in texts[:5]])
    for text in (b"the cat", b"", b"dog on the mat \xc3\xa9"):
        assert math.isclose(model.bits([text])[0], slow_bits(model, text), rel_tol=1e-3, abs_tol=1e-2)


def test_blocks_count_what_a_loop_counts():
    texts = [b"abc abd", b"abc abd", b"", b"zz abc"]
    _, learner = mixing(texts)
    want = [np.zeros_like(t) for t in learner.tables]
    for text in texts:
        symbols = [*text, lm_score.END]
        for i, symbol in enumerate(symbols):
            c = lm_score.Contexts.of(np.array([lm_score.PAD] * 5 + symbols[: i + 1], np.int16))
            for table, h, (_, bits) in zip(want, c.hashed, lm_score.ORDERS, strict=True):
                for depth in range(int(learner.code.length[symbol])):
                    node, bit = int(learner.code.nodes[symbol, depth]), int(learner.code.bits[symbol, depth])
                    spread = node * 0x85EBCA77 % 2**32
                    at = (int(h[-1]) >> 32 - bits) ^ (spread >> 26) if bits > 20 else ((int(h[-1]) ^ spread) * 0x9E3779B1 % 2**32) >> 32 - bits
                    table[2 * at + bit] += 1
    assert all((a == b).all() for a, b in zip(learner.tables, want, strict=True))
    assert learner.blocks == 2 and learner.map.sum() == sum(int(learner.code.length[s]) for t in texts[2:] for s in [*t, lm_score.END])


def test_long_texts_are_cut_by_themselves(monkeypatch):
    texts = [b"abc def " * 40_000, b"", b"zz", b"q" * 300_000]
    model, _ = mixing([b"abc def " * 50] * 20)
    whole = model.bits(texts)
    assert np.allclose(whole, [model.bits([t])[0] for t in texts])
    owner, context, segment, cost = model.segments(texts)
    assert (np.diff(owner) >= 0).all() and set(owner) == {0, 1, 2, 3} and (context[np.flatnonzero(np.diff(owner)) + 1] == 0).all()
    monkeypatch.setattr(lm_score, "BLOCK", 1 << 14)
    assert np.allclose(model.bits(texts), whole)
    assert sum(len(o[o >= 0]) for _, o, _ in lm_score.blocks(texts)) == sum(len(t) + 1 for t in texts)


def test_segments_cover_texts_and_repeat_with_them():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    passage = " ".join(r.choice(words) for _ in range(200))
    texts = [f"{passage} end".encode(), " ".join(r.choice(words) for _ in range(100)).encode(), f"start {passage} other".encode()]
    model, _ = mixing(texts)
    owner, context, segment, _ = model.segments(texts)
    pairs = [set(zip(context[owner == k].tolist(), segment[owner == k].tolist(), strict=True)) for k in range(3)]
    assert len(pairs[0] & pairs[2]) > 5 and not pairs[0] & pairs[1]
    alone = model.segments(texts[2:])
    assert (alone[1] == context[owner == 2]).all() and (alone[2] == segment[owner == 2]).all()


def first_segments(model, texts):
    """How many symbols (with the end) the first segment of each text has: they must cost one each."""
    owner, _, _, cost = model.segments(texts)
    return np.rint(cost[np.searchsorted(owner, np.arange(len(texts)))]).astype(int)


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_first_segments_are_a_complete_code(monkeypatch, block):
    """Over all texts of three letters, first segments by four equally likely symbols add up to one: bytes before a place alone end a segment."""
    monkeypatch.setattr(lm_score, "LONG", 2)
    monkeypatch.setattr(lm_score, "ANCHOR", 2)
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score.blocks, "__defaults__", (block,))
    model, _ = mixing([b"ab a"] * 4)
    monkeypatch.setattr(lm_score.MixingModel, "costs", lambda self, symbols, hashed: np.ones(len(symbols)))
    longest = 7
    texts = [bytes(t) for n in range(longest + 1) for t in itertools.product(b"ab ", repeat=n)]
    closed, still = set(), set()
    for raw, size in zip(texts, first_segments(model, texts), strict=True):
        if size <= len(raw):
            closed.add(raw[:size])
        else:
            closed.add(raw + b"$")
            if len(raw) == longest:
                still.add(raw)  # three letters more may follow it
    assert any(not s.endswith(b"$") for s in closed)
    assert sum(4.0 ** -len(s) for s in closed) + 3 * sum(4.0 ** -(longest + 1) for _ in still) == 1


def test_probabilities_of_a_small_language(spark, monkeypatch):
    """After both predictions are mixed, all texts up to six letters have a probability of no more than one."""
    monkeypatch.setattr(lm_score, "LONG", 2)
    monkeypatch.setattr(lm_score, "ANCHOR", 1)
    known = [b"ab a b", b"a  b a", b"b  a  "] * 6
    model, _ = mixing(known)
    texts = known + [bytes(t) for n in range(7) for t in itertools.product(b"ab ", repeat=n)]
    owner, context, segment, cost = model.segments(texts)
    rows = [(int(o), int(o) < len(known), [(int(c), int(s), float(b))]) for o, c, s, b in zip(owner, context.view(np.int64), segment.view(np.int64), cost, strict=True)]
    df = spark.createDataFrame(rows, "row long, learned boolean, segments array<struct<context: long, segment: long, bits: float>>")
    bits = np.bincount(owner, cost, len(texts))
    for r in lm_score.repeated_segments(df).groupBy("row").agg(F.sum("saved").alias("saved")).collect():
        bits[r.row] -= r.saved
    assert 0.1 < (2.0 ** -bits[len(known) :]).sum() <= 1  # contexts of two bytes know less than those of five: known texts gain nothing


def test_repeated_texts_cost_less(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(150))) for i in range(80)]
    held = [i for i in range(80, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:8]
    rows += [(i, rows[k][1]) if k % 2 else (i, " ".join(r.choice(words) for _ in range(150))) for k, i in enumerate(held)]
    learned = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 != 1]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {x.doc_id: x.bits_per_byte for x in lm_score.score(docs, fold(F.col("doc_id"), 5) != 1, F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False))).collect()}
    twins = [i for k, i in enumerate(held) if k % 2 and k in learned]
    others = [i for k, i in enumerate(held) if not k % 2]
    assert twins and max(out[i] for i in twins) < 0.5 * min(out[i] for i in others)


def test_segment_counts_against_a_loop(spark):
    r = random.Random(7)
    rows = [(i, bool(r.random() < 0.7), [(r.choice([0, 5, 6]), r.randint(1, 3), 20.0) for _ in range(r.randint(0, 3))]) for i in range(60)]
    df = spark.createDataFrame(rows, "row long, learned boolean, segments array<struct<context: long, segment: long, bits: float>>")
    each = [(i, own, c, s, b) for i, own, found in rows for c, s, b in found]
    made = []
    for i, own, c, s, b in each:
        total = sum(o for _, o, d, _, _ in each if d == c) - own
        times = sum(o for _, o, d, e, _ in each if (d, e) == (c, s)) - own
        if total > 0:
            made.append((i, own, b, total, times, int(math.log2(total))))
    trust = {l: (sum(t > 0 for _, o, _, _, t, m in made if o and m == l) + 0.5) / (sum(1 for _, o, _, _, _, m in made if o and m == l) + 1) for l in {x[5] for x in made}}
    want = Counter()
    for i, _, b, total, times, l in made:
        want[i] += b + math.log2((1 - trust[l]) * 2.0**-b + trust[l] * times / total)
    got = Counter()
    for x in lm_score.repeated_segments(df).collect():
        got[x.row] += x.saved
    assert set(got) == set(want) and all(math.isclose(got[i], want[i], rel_tol=1e-6, abs_tol=1e-9) for i in want)


def test_lm_without_training_documents(spark):
    docs = spark.createDataFrame(lm_rows(spark)[:5], "doc_id long, text string")
    out = lm_score.score(docs, F.lit(False), F.lit(True)).collect()
    assert len(out) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)
    assert lm_score.score(docs.limit(0), F.lit(True), F.lit(False)).count() == 0


def test_places_of_unchecked_lookups_are_within_their_tables(monkeypatch):
    texts = [t.lower().encode() for t in ODD]
    code = lm_score.Code(*lm_score.huffman(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=257)))

    def learned():
        learner = lm_score.Learner(code)
        for _ in range(2):
            learner.learn(texts)
        model = lm_score.MixingModel(code, learner.logits, learner.weights, np.linspace(-1, 1, 257 * lm_score.BUCKETS).astype(np.float32))
        return [*learner.tables, learner.weights, learner.map, model.bits(texts)]

    free = learned()
    assert lm_score.FREE == "wrap"
    monkeypatch.setattr(lm_score, "FREE", "raise")
    assert all((a == b).all() for a, b in zip(free, learned(), strict=True))


def test_bits_laid_depth_by_depth_against_a_loop():
    r = random.Random(8)
    symbols = np.array([r.choice([97, 98, 99, 99, 101, 200, 256]) for _ in range(300)], np.int16)
    code = lm_score.Code(*lm_score.huffman(np.bincount(symbols, minlength=257)))
    hashed = np.array([r.getrandbits(32) for _ in symbols], np.uint32)
    keys = hashed.astype(np.uint64) << np.uint64(32) | symbols.astype(np.uint64)
    both = [np.concatenate((x, x[::2])) for x in (keys, hashed, symbols)]
    dealt = lm_score.Dealt.of(both[0], both[1], code.rank.take(both[2]), 64)
    assert len(dealt.edges) > 3 and dealt.edges[-1] == len(dealt.begins) == len(set(keys.tolist()))
    assert sorted(dealt.place.tolist()) == list(range(450)) and sum(np.diff(dealt.begins, append=450) == 2) == 150
    seen = 0
    for i, j in dealt.parts(50):
        at = dealt.first[i:j]
        some, h = both[2][at], both[1][at]
        assert 0 < j - i <= 50 and (np.diff(code.rank[some]) >= 0).all()
        layers = code.layers(some)
        depths = [d for d in range(code.nodes.shape[1]) for s in some if code.length[s] > d]
        of = [k for d in range(code.nodes.shape[1]) for k, s in enumerate(some) if code.length[s] > d]
        assert layers.of_symbols(h).tolist() == h[of].tolist()
        assert layers.of_nodes(code.bit).tolist() == [code.bits[some[k], d] for k, d in zip(of, depths, strict=True)]
        assert layers.of_nodes(code.base).tolist() == [code.nodes[some[k], d] * lm_score.BUCKETS for k, d in zip(of, depths, strict=True)]
        assert layers.sums(np.ones(len(of))).tolist() == [code.length[s] for s in some]
        seen += j - i
    assert seen == len(dealt.begins)


@pytest.mark.parametrize("same", [False, True])
def test_known_words_are_told_apart_byte_by_byte(monkeypatch, same):
    words = [b"a", b"ab", b"ba", b"\xff\x00", b"a" * 300, b"abc"]
    assert len(set(lm_score.word_hashes(pa.array(words)).tolist())) == len(words)
    if same:  # as if all hashes met
        monkeypatch.setattr(lm_score, "word_hashes", lambda w: np.full(len(w), 7, np.uint64))
    known = lm_score.Known(pa.array(words), np.arange(6.0))
    asked = pa.array([b"no", *words, b"", b"b", b"abc"], pa.binary())
    for found in (asked, asked.slice(2)):
        want = [float(words.index(w)) if w in words else math.nan for w in found.to_pylist()]
        assert np.array_equal(known.of(found), want, equal_nan=True)
    assert np.isnan(lm_score.Known(pa.array([], pa.binary()), np.zeros(0)).of(asked)).all() and len(known.of(asked[:0])) == 0
