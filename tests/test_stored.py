"""Models, candidates and figures that are written and read again, and generated questions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from triplewright.operators import generated, mediated, models
from triplewright.operators.ranking import rank_by
from triplewright.sources import gold


def test_stored_model_predicts_the_same(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("c_id"), (F.col("id") % 7).cast("double").alias("f"), (F.col("id") % 3).cast("double").alias("g"), F.lit(1).alias("result_size"))
    rows = rows.withColumn("label", (F.col("f") > F.col("g") + 2).cast("double"))
    model = models.fit_pruner(rows, ["f", "g"])
    models.store(model, f"file://{tmp_path}/model")
    models.store(model, f"file://{tmp_path}/model")
    again = models.load(f"file://{tmp_path}/model")
    kept = sorted(r["c_id"] for r in models.prune(rows, model).collect())
    assert kept and kept == sorted(r["c_id"] for r in models.prune(rows, again).collect())


def test_stored_candidates_are_ranked_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (2, 20, 0.1), (2, 21, None)], "q_id long, c_id long, score double")
    path = f"file://{tmp_path}/candidates"
    gold.write_candidates(rows, path)
    order = [F.desc_nulls_last("score"), F.asc("c_id")]
    ranked = rank_by(gold.read_candidates(spark, path), order)
    assert sorted((r["q_id"], r["c_id"], r["rank"]) for r in ranked.collect()) == [(1, 10, 2), (1, 11, 1), (2, 20, 1), (2, 21, 2)]
    gold.write_result_info(ranked.agg(F.count("*").alias("n"), F.max("score").alias("best")), f"file://{tmp_path}/info")
    lines = [x for p in (tmp_path / "info").glob("part-*") for x in p.read_text().splitlines()]
    assert [json.loads(x) for x in lines] == [{"n": 4, "best": 0.9}]


def test_generated_questions(spark):
    known = spark.createDataFrame([("New York", "m.1"), ("Ada", "m.2")], "name string, id string")
    asked = [
        (1, "who was born in [New_York|City|new york] in [1815|Year|1815]", "[Ada|Person|ada l]"),
        (2, "no mention at all", "[Bob|Person|bob]"),
        (3, "cut [off here", "[Ada|Person|ada]"),
        (4, "", "[Ada|Person|ada]"),
    ]
    got = generated.relinked(spark.createDataFrame(asked, "q_id long, text string, answer string"), known)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, "who was born in [m.1|new_york] in [<VALUE>|1815]", "[m.2|ada_l]"),
        (2, "no mention at all", "[UNK|bob]"),
        (3, "cut", "[m.2|ada]"),
        (4, "", "[m.2|ada]"),
    ]


def test_entity_pairs_by_all_mediators(spark):
    held = [("a", "r1", 1), ("a", "r2", 1), ("a", "r1", 2), ("b", "r3", 1), ("b", "r3", 3), ("c", "r1", 2), ("d", "r4", 9)]
    postings = spark.createDataFrame(held, "value string, relation string, mediator long")
    asked = [(1, "a", "b"), (2, "b", "a"), (3, "a", "c"), (4, "a", "d"), (5, "a", "nobody")]
    back = spark.createDataFrame([("r1", "-r1")], "relation string, reverse string")
    got = mediated.entity_pair_relations(postings, spark.createDataFrame(asked, "q_id long, start string, target string"), back)
    reverse = {"r1": "-r1"}
    want = {(q, reverse.get(x, x), x, y) for q, s, t in asked for v, x, m in held for w, y, n in held if v == s and w == t and m == n}
    assert {tuple(r) for r in got.collect()} == want and want


def test_mediated_match_keeps_given_pairs(spark):
    index = spark.createDataFrame([("a", "b", "red_hat", 0.5), ("a", "b", "x", 0.9), ("a", "c", "blue", 0.25)], "rel_a string, rel_b string, word string, score double")
    asked = spark.createDataFrame([(1, "a", None), (2, "a", "z"), (3, "q", None)], "q_id long, rel_a string, rel_b string")
    tokens = spark.createDataFrame([(1, "red-hat"), (1, "red-hat"), (1, "x"), (2, "blue")], "q_id long, lemma string")
    got = {tuple(r) for r in mediated.mediated_match(asked, index, tokens).collect()}
    assert got == {(1, "a", "b", 2, 1.0), (1, "a", "c", 0, 0.0), (2, "a", "z", 0, 0.0)}
    only = mediated.mediated_match(asked, index, tokens, matched_only=True)
    assert [tuple(r) for r in only.collect()] == [(1, "a", "b", 2, 1.0)]
