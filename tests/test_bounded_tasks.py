"""Steps whose time or memory of one task once grew faster than what they need: same rows from less work."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import candidates, linking, matching, mediated
from triplewright.plans import learning


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_context_words_are_grouped_before_they_meet_tokens(spark):
    words = spark.createDataFrame([("r", "a", 0.5), ("r", "a", 0.25), ("s", "a", 0.125), ("s", "b", 1.0)], "relation string, word string, score double")
    tokens = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "c")], "q_id long, lemma string")
    for rows in (None, 4):
        found = matching.match_by_context(words, tokens, rows)
        lines = plan(found).splitlines()
        join = next(i for i, line in enumerate(lines) if "Join" in line)
        assert not any("Aggregate" in line for line in lines[:join])
        assert {tuple(r) for r in found.collect()} == {(1, "r", "a", 1.5), (1, "s", "a", 0.25), (2, "r", "a", 0.75), (2, "s", "a", 0.125)}


def test_word_shares_take_tasks_by_texts_and_words(spark, monkeypatch):
    rows = [(i, "s", "de" if i % 2 else None, f"x w{i} x") for i in range(20)] + [(20, "s", "de", None), (21, "t", "de", "")]
    texts = spark.createDataFrame(rows, "id long, rel_a string, rel_b string, text string").where("rel_b is not null")
    monkeypatch.setattr(mediated, "TASK_TEXTS", 1)
    monkeypatch.setattr(mediated, "TASK_WORDS", 3)
    found = mediated.pair_word_shares(texts)
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert ", 12), REPARTITION_BY_NUM" in physical and ", 11), REPARTITION_BY_NUM" in physical  # texts, and 31 words
    got = {(r["rel_a"], r["word"]): r["score"] for r in found.collect()}
    assert got == {("s", "x"): 20 / 30, ("t", ""): 1.0} | {("s", f"w{i}"): 1 / 30 for i in range(1, 20, 2)}


def test_second_entities_are_bound_without_the_other_patterns(spark, monkeypatch):
    rows = [("a", "x.to", "m"), ("a", "x.home", "t"), ("m", "m.date", "1990"), ("m", "m.back", "a"), ("m", "m.part", "b"), ("b", "y.to", "m")]
    facts = spark.createDataFrame(rows, "s string, p string, o string")
    linked = spark.range(3).select(F.col("id").alias("q_id"), F.lit("a").alias("entity"))
    others = spark.createDataFrame([(0, "b"), (1, "b"), (2, "gone")], "q_id long, other string")
    media = spark.createDataFrame([("x.to",), ("y.to",)], "relation string")
    back = spark.createDataFrame([("x.to", "m.back"), ("m.back", "x.to"), ("y.to", "m.part"), ("m.part", "y.to")], "relation string, reverse string")
    whole = candidates.generate(facts, linked, media, back, others).where("pattern = 'ERMRERT'").collect()
    hop, met = candidates.one_hop, []
    monkeypatch.setattr(candidates, "one_hop", lambda f, asked, m, mediated: met.append((mediated, asked.count())) or hop(f, asked, m, mediated))
    found = candidates.generate_bound(facts, linked, media, back, others).collect()
    assert met == [(True, 1)]
    assert sorted(found) == sorted(whole)
    assert {(r["q_id"], r["other"], tuple(r["rels"])) for r in found} == {(q, "b", ("x.to", "m.part", "m.date")) for q in (0, 1)}


def test_words_that_no_question_has_are_not_counted(spark, monkeypatch):
    words = spark.createDataFrame([(d, w, 1) for d in range(4) for w in ("a", "b", "b", f"x{d}", f"y{d}")], "doc_id long, word string, n long")
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "gone"), (3, "x2")], "q_id long, word string")
    keep, kept = linking.written, {}
    monkeypatch.setattr(linking, "written", lambda df, name: kept.setdefault(name, keep(df, name)))
    got = {tuple(r) for r in linking.text_entities(words, wanted, 3).collect()}
    assert got == {(1, 0, 3, 1), (1, 1, 3, 2), (1, 2, 3, 3), (3, 2, 1, 1)}
    assert {(r["doc_id"], r["word"], r["n"]) for r in kept["words-of-texts"].collect()} == {(d, w, n) for d in range(4) for w, n in (("a", 1), ("b", 2))} | {(2, "x2", 1)}


def test_only_labelled_texts_are_taken_apart(spark):
    lines = plan(learning._document_grams(spark, "/root/testdata/sf0.001")[1]).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("array_distinct" in line for line in lines[:join]) and not any("array_distinct" in line for line in lines[join:])
