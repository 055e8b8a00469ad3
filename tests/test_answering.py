"""Candidates that account for tokens, orders over many tasks, numbered lines and spans without a longest name."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from triplewright.operators import answering, frontier, linking, models, ranking
from triplewright.sources.lines import numbered_lines


@pytest.fixture(scope="module")
def graph(spark):
    # two people married at mediator m1, parents at m2; x lives in a town
    rows = [
        ("ann", "person.marriage", "m1"), ("bob", "person.marriage", "m1"), ("m1", "marriage.spouse", "ann"), ("m1", "marriage.spouse", "bob"), ("m1", "marriage.date", "1990"),
        ("ann", "person.marriage", "m2"), ("cid", "person.marriage", "m2"), ("m2", "marriage.spouse", "ann"), ("m2", "marriage.spouse", "cid"), ("m2", "marriage.place", "rome"),
        ("ann", "person.home", "town"),
    ]
    facts = spark.createDataFrame(rows, "s string, p string, o string").cache()
    media = spark.createDataFrame([("person.marriage",)], "relation string")
    back = spark.createDataFrame([("person.marriage", "marriage.spouse"), ("marriage.spouse", "person.marriage")], "relation string, reverse string")
    return frontier.Graph(facts, media, back)


def mentions_of(spark, rows):
    return spark.createDataFrame(rows, "q_id long, m_id int, entity string, tok_start int, tok_end int")


def test_candidates_of_one_and_two_names(spark, graph):
    mentions = mentions_of(spark, [(1, 1, "ann", 2, 3), (1, 2, "bob", 4, 6), (2, 1, "ann", 0, 2), (2, 2, "bob", 1, 3), (3, 1, "cid", 0, 1)])
    got = {}
    for r in frontier.token_aware_candidates(graph, mentions).collect():
        got.setdefault(r["q_id"], set()).add((r["pattern"], r["entity"], r["other"], tuple(r["rels"]), tuple(r["used"])))
    assert {c for c in got[1] if c[1] == "ann"} == {
        ("ERT", "ann", None, ("person.home",), (2,)),
        ("ERMRT", "ann", None, ("person.marriage", "marriage.date"), (2,)),
        ("ERMRT", "ann", None, ("person.marriage", "marriage.place"), (2,)),
        # only what stands at a mediator that both share
        ("ERMRERT", "ann", "bob", ("person.marriage", "marriage.spouse", "marriage.date"), (2, 4, 5)),
    }
    # overlapping names are never in one candidate
    assert not [c for c in got[2] if c[0] == "ERMRERT"]
    assert {c[3] for c in got[3]} == {("person.marriage", "marriage.place")}


def test_results_of_candidates(spark, graph):
    mentions = mentions_of(spark, [(1, 1, "ann", 2, 3), (1, 2, "bob", 4, 6)])
    found = {r["c_id"]: r["target"] for r in answering.results(graph.facts, frontier.token_aware_candidates(graph, mentions)).collect()}
    assert found["ann person.marriage marriage.spouse marriage.date bob"] == "1990" and found["ann person.home"] == "town"


def test_a_list_in_a_pattern_is_gone_back_over(spark, graph):
    begun = frontier.starts(mentions_of(spark, [(1, 1, "ann", 0, 1)]))
    row = frontier.match(begun, [graph.to_mediator, [graph.leave_mediator]]).first()
    assert (row["at"], row["history"]) == (2, [0, 1])
    row = frontier.match(begun, [[graph.to_mediator, graph.leave_mediator]]).first()
    assert (row["at"], row["history"], len(row["edges"])) == (1, [0], 2)


def test_tokens_of_names_match_no_relation(spark):
    candidates = spark.createDataFrame([(1, "c", [1], ["a.order.part"])], "q_id long, c_id string, used array<int>, rels array<string>")
    content = spark.createDataFrame([(1, 0, "part", "NN"), (1, 1, "order", "NN"), (1, 2, "or", "NN"), (1, 3, "a", "NN")], "q_id long, tok int, lemma string, tag string")
    derived = spark.createDataFrame([("part.n", "order")], "word_pos string, word string")
    beside = spark.createDataFrame([("a.order.part", "or", 0.5)], "relation string, word string, score double")
    how = answering.lemma_matches(candidates.select(F.explode("rels").alias("relation")), content, derived, beside)
    got = sorted((r["tok"], r["kind"], r["score"]) for r in answering.match_table(candidates, content, how).collect())
    assert got == [(0, "derivation", 1.0), (0, "name", 1.0), (2, "name", 1.0), (2, "word", 0.5)]


def test_first_in_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    for most in (0, 1, 60, 499, 500, 900):
        got = ranking.first_in_order(df, [F.desc("a"), F.asc("b")], most).collect()
        assert sorted(map(tuple, got)) == sorted(sorted(rows, key=lambda r: (-r[0], r[1]))[:most])
    assert ranking.first_in_order(df.limit(0), [F.asc("a"), F.asc("b")], 5).collect() == []


def test_selected_ngrams_of_equal_score(spark):
    rows = [(k % 2, f"g{k // 4}") for k in range(400)]
    got = models.select_ngrams(spark.createDataFrame(rows, "label int, gram string"), 0.07).collect()
    assert sorted(r["gram"] for r in got) == sorted(sorted({g for _, g in rows})[:7])


def test_numbered_lines_of_a_file_in_many_blocks(spark, tmp_path):
    lines = [f"{i} " + "x" * (i % 37) for i in range(3000)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        table = numbered_lines(spark, f"file://{tmp_path}")
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 10
        got = sorted((r["file"][-5:], r["line"], r["value"]) for r in table.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(name, i, line) for name in ("a.txt", "b.txt") for i, line in enumerate(lines)]


def test_names_of_many_tokens_are_linked(spark):
    long = "the long and winding road to the old house by the sea of tears"
    df = spark.createDataFrame([(1, f"who wrote {long} - 1 -".split(" ")), (2, ["a"]), (3, [])], "q_id long, tokens array<string>")
    surfaces = spark.createDataFrame([(long.replace(" ", ""),)], "surface string")
    reach = linking.longest_surface(surfaces)
    got = [(r["q_id"], r["span"]) for r in linking.spans(df, reach=reach).collect()]
    assert (1, long) in got and (2, "a") in got
    assert max(len(s.replace(" ", "").replace("-", "")) for _, s in got) <= reach
    assert (1, f"{long} -") in got  # a sign has no letters
    assert not [s for _, s in got if s.startswith("who") and "tears" in s]


def test_linking_takes_the_lax_mentions_only_without_strict_ones(spark):
    entities = spark.createDataFrame([("e1", "red hill", 1), ("e2", "blue hill", 93), ("e3", "blue hill", 7)], "id string, name string, score long")
    tags = {"red": "JJ", "blue": "JJ", "hill": "NN", "is": "VBZ"}
    rows = [(i, t, [(w, tags[w]) for w in t.split(" ")]) for i, t in enumerate(["is blue hill", "is red hill"])]
    got = linking.link_mentions(spark.createDataFrame(rows, "q_id long, text string, tokens array<struct<lemma:string,tag:string>>"), linking.surface_index(entities)).collect()
    assert {(r["q_id"], r["entity"], r["tok_start"], r["tok_end"]) for r in got} == {(0, "e2", 1, 3), (1, "e1", 1, 3)}
