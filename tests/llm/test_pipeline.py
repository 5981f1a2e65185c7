"""The pipeline and the registered queries over small tables, against plain versions of each stage."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece as library

import __spark_entry__
import corpus_pipeline
from simplark.llm import queries, simhash

WORDS = {"en": "the of and to in that is was for it with as his on be at by this had not".split(), "de": "der die und das nicht ein eine über für schön größe haus auf ist im".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(4)
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    item = "a quick question asks how many apples remain when nine of twenty apples fall from the old tree"
    rows = []
    for i in range(120):
        l = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[l]) for _ in range(r.randint(30, 60))), l))
    rows += [(200, rows[3][1].upper(), rows[3][2]), (201, rows[3][1], rows[3][2]), (202, rows[10][1] + " x", rows[10][2]), (203, f"{rows[5][1]} {item} {rows[6][1]}", "en"), (204, None, "en"), (205, "12 34 %%", None), (206, "", "de")]
    docs = spark.createDataFrame([(i, t, l, f"src{i % 3}", len(t or "")) for i, t, l in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(i, f"http://x/{i % 4}", f"<p>{i % 3}</p>") for i in range(20)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path, rows, item


def plain(rows, item):
    kept = [(i, t) for i, t, _ in rows if t and re.search(r"[^\W\d_]", t)]
    last = {}
    for i, t in kept:
        last[t.lower()] = max(i, last.get(t.lower(), -1))
    kept = [(i, t) for i, t in kept if last[t.lower()] == i]
    fps = {i: simhash.fingerprint(t) for i, t in kept}
    group = {i: i for i, _ in kept}
    moved = True
    while moved:
        moved = False
        for a in group:
            for b in group:
                if (fps[a] ^ fps[b]).bit_count() <= 4 and group[b] < group[a]:
                    group[a], moved = group[b], True
    kept = [(i, t) for i, t in kept if group[i] == i]
    return {i: t for i, t in kept if item not in t}


def test_pipeline_against_plain_stages(spark, folder):
    path, rows, item = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "decontaminate", "sentencepiece"]
    out = corpus_pipeline.run(spark, path)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    want = plain(rows, item)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(want) and 203 not in got and 201 in got
    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert all(got[i].ids == sp.encode(t) and got[i].decoded == t for i, t in want.items())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0


def test_every_operator_is_registered(spark, folder):
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES} and "pipeline" in names
    path, rows, _ = folder
    for name in ("op1_sentencepiece", "op3_toxicity", "op4_lm_score", "op5_exact_dedup", "op7_token_ids", "op8_sharding", "op9_simhash", "op10_language_id", "op12_licenses", "op13_resample"):
        out = names[name](spark, path)
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(i for i, _, _ in rows), name
    assert [r.doc_id for r in names["op6_decontaminate"](spark, path).collect()] == [203]
    pages = names["op2_warc"](spark, path).collect()
    assert len(pages) == 20 and sum(r.record_type == "response" for r in pages) == 3
