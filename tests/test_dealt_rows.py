"""Steps whose tasks once grew with the input, or moved rows that need not move: same rows, tasks by rows."""

from __future__ import annotations

import pytest

from triplewright.operators import matching, mediated, patterns, ranking
from triplewright.sources import staging


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hundred(monkeypatch):
    """Tasks of 100 rows where a step deals them, so that 1,000 rows make 10 tasks."""
    monkeypatch.setattr(staging.dealt, "__kwdefaults__", {"each": 100})


def test_postings_are_not_made_distinct(spark):
    rows = [("a", "r", "m"), ("a", "r", "m"), ("b", "s", "m"), ("b", "s", "m"), ("b", "t", "n"), ("c", "r", "n")]
    postings = spark.createDataFrame(rows, "value string, relation string, mediator string")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "b", "c"), (4, "a", "c")], "q_id long, start string, target string")
    back = spark.createDataFrame([("r", "r2")], "relation string, reverse string")
    found = mediated.entity_pair_relations(postings, pairs, back)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line and "mediator#" in line for line in lines)
    assert {tuple(r) for r in found.collect()} == {(1, "r2", "r", "s"), (2, "s", "s", "r"), (3, "t", "t", "r")} and found.count() == 3


def test_few_derived_words_go_to_the_tokens(spark):
    words = spark.createDataFrame([("r", "supplier"), ("s", "orders"), ("t", "none")], "relation string, word string")
    derived = spark.createDataFrame([("supplies.v", "supplier"), ("orders.v", "orders"), ("orders.v", "gone")], "word_pos string, word string")
    rows = [(1, "supplies", "VBZ"), (1, "supplies", "VBZ"), (2, "orders", "VBZ"), (3, "orders", "NN"), (4, "x", "DT")]
    found = matching.match_by_derivation(words, spark.createDataFrame(rows, "q_id long, lemma string, tag string"), derived)
    assert "SortMergeJoin" not in physical(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "r", "supplies"), (2, "s", "orders")]


def test_simple_scores_move_rows_once_to_tasks_by_rows(spark, hundred):
    mentions = spark.createDataFrame([(1, 1, 0.5, 2), (1, 1, 0.25, 1), (1, 2, 1.0, 1)], "q_id long, c_id long, surface_score double, n_tokens int")
    rows = [(1, 1, 0, "name", 0.9), (1, 1, 0, "word", 0.5), (1, 1, 1, "weak", 1.0), (2, 3, 0, "weak", 0.5), (2, 4, 0, "derivation", 1.0)]
    matches = spark.createDataFrame(rows, "q_id long, c_id long, tok int, kind string, score double")
    found = ranking.simple_score(mentions, matches, 1000)
    assert physical(found).count("Exchange") == 1 and ", 10), REPARTITION_BY_NUM" in physical(found)
    got = {(r["q_id"], r["c_id"]): round(r["score"], 9) for r in found.collect()}
    assert got == {(1, 1): 1.25 + 3 * 0.6, (1, 2): 1.0, (2, 3): 0.15}


def test_answer_types_are_matched_in_tasks_by_rows(spark, hundred):
    classes = spark.createDataFrame([(1, "date", 0.5), (2, "region", 0.25)], "q_id long, class string, prob double")
    rows = [(q, r, e, None) for q in (1, 2, 3) for r, e in (("a.date", "type.datetime"), ("geo.region", "x.region"))]
    relations = spark.createDataFrame(rows, "q_id long, relation string, expected string, target_types array<string>")
    found = matching.answer_type_match(classes, relations, 1000)
    assert physical(found).count("Exchange") == 2 and physical(found).count(", 10), REPARTITION_BY_NUM") == 2
    got = {(r["q_id"], r["relation"]): r["match"] for r in found.collect()}
    assert got == {(q, r): {(1, "a.date"): 0.5, (2, "geo.region"): 0.25}.get((q, r), 0.0) for q in (1, 2, 3) for r in ("a.date", "geo.region")}


def test_suggestions_take_tasks_by_rows(spark, hundred):
    facts = spark.createDataFrame([("a", "r", "1"), ("a", "r", "2"), ("a", "s", "3"), ("b", "r", "4"), ("b", "t", "5")], "s string, p string, o string")
    anchors = spark.createDataFrame([(1, "a"), (2, "b")], "q_id long, entity string")
    used = spark.createDataFrame([(1, "back"), (2, "t")], "q_id long, relation string")
    back = spark.createDataFrame([("back", "s"), ("s", "back")], "relation string, reverse string")
    found = patterns.without_used(patterns.relation_suggestions(facts, anchors, rows=1000), used, back, 1000)
    assert physical(found).count(", 10), REPARTITION_BY_NUM") == 4 and "SortMergeJoin [q_id" in physical(found)
    assert {tuple(r) for r in found.select("q_id", "relation").collect()} == {(1, "r"), (2, "r")}
    plain = patterns.without_used(patterns.relation_suggestions(facts, anchors), used, back)
    assert sorted(plain.collect()) == sorted(found.collect())
