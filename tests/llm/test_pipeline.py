import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import prose
from veritrail.llm import queries
from veritrail.llm.common import written


def small_corpus(spark, tmp_path):
    """Clean documents with one case planted for each stage."""
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1, 301):
        bad = i % 6 == 0
        text = prose(i, rng.randrange(120, 260))
        docs.append((i, " | ".join(w.upper() + "!!" for w in text.split()) if bad else text))
        labels.append((i, int(not bad), 0))
    item, passage = prose(7001, 30), prose(7002, 70)
    docs += [(1001, docs[0][1]), (1002, prose(8002, 100) + " " + passage), (1003, prose(8003, 100) + " " + passage), (1004, prose(8004, 150) + " " + item + " " + prose(8005, 50)), (None, prose(8006, 80))]
    folder = str(tmp_path)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: t for i, t in docs}, passage


def test_each_stage_does_its_work_and_keeps_clean_documents(spark, tmp_path):
    folder, texts, passage = small_corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, written(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == before
            seen.append({r.doc_id: r.text for r in docs.collect()})
    quality, near, cut, clean = seen
    junk = {i for i in range(1, 301) if i % 6 == 0}
    assert len(junk & set(quality)) <= 2 and len(set(texts) - junk - set(quality)) <= 2
    assert set(near) == set(quality) - {1001} and None in near
    assert passage in cut[1002] and passage not in cut[1003] and cut[1003] in texts[1003]
    assert {i: t for i, t in cut.items() if i != 1003} == {i: t for i, t in near.items() if i != 1003}
    assert set(clean) == set(cut) - {1004}
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {}
    for r in docs.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {i: len(encode.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()), key=str) == sorted(
        map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()), key=str
    )


def test_every_operator_has_its_query():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
