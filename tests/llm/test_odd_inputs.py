"""Every operator and stage on odd rows and on an empty table."""

from __future__ import annotations

import pytest

import corpus_pipeline
from triplewright.llm import additive_ann, alignment, bpe, ctph, feistel, hdlang, hilbert, ngram_join, packing, pii, simhash, toxicity

ROWS = 12


def toxic_scores(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (8, 0)], "doc_id long, toxic int")
    return toxicity.score_documents(docs, toxicity.train(docs, labels))


OPERATORS = {
    "pii": lambda d, s: pii.find_personal_data(d),
    "ctph": lambda d, s: ctph.fingerprint_documents(d),
    "toxicity": toxic_scores,
    "hilbert": lambda d, s: hilbert.hilbert_shards(d),
    "bpe": lambda d, s: bpe.digests(bpe.encoded(d)),
    "simhash": lambda d, s: simhash.near_duplicate_classes(d),
    "ngram_join": lambda d, s: ngram_join.similar_classes(d),
    "alignment": lambda d, s: alignment.align_documents(d),
    "language": lambda d, s: hdlang.identify(d, *hdlang.train_profiles(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, odd, empty, name):
    assert len(OPERATORS[name](odd, spark).collect()) == ROWS
    assert OPERATORS[name](empty, spark).collect() == []


def test_packing(odd, empty):
    rows = packing.pack(odd).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert packing.pack(empty).collect() == []


def test_feistel(spark, odd, empty, tmp_path):
    for docs, path in ((odd, "odd"), (empty, "empty")):
        placed = feistel.training_order(feistel.materialise(feistel.sequences(docs), "t"))
        feistel.write_shards(placed, f"file://{tmp_path}/{path}", slots=16)
    got = feistel.read_slots(spark, f"file://{tmp_path}/odd").collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and any(r["doc_id"] is None for r in got)
    assert sorted(r["slot"] for r in feistel.read_slots(spark, f"file://{tmp_path}/odd", 5, 40).collect()) == list(range(5, 40))
    assert feistel.read_slots(spark, f"file://{tmp_path}/empty").collect() == []


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [2.0, 0.0]), (6, [1.0]), (20, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in additive_ann.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[20] == [(0, -1.0), (0, -1.0), (5, -2.0)] or got[20] == [(0, -1.0), (5, -2.0)]
    assert got[0][0] == (5, 2.0)
    assert additive_ann.search(df.limit(0)).collect() == []


def test_stages(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(1, 0), (2, 0), (8, 1), (9, 1)], "doc_id long, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, f"file://{tmp_path}")
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if name == "pii" and rows:
                assert len(rows) == ROWS and any("[EMAIL]" in (r["text"] or "") and "[PHONE]" in r["text"] for r in rows)
            if name == "near_duplicates" and rows:
                assert sum(r["doc_id"] == 1 for r in rows) == 1
            if name == "language" and rows:
                assert all(any(c.isalpha() for c in r["text"]) for r in rows)
