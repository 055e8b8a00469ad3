"""Joins that must not send a large table through the driver, and tasks that must not grow with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import candidates, frontier, linking, metrics, patterns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_spans_are_not_broadcast(spark, tmp_path):
    # a small file of questions, whose spans are many times as large
    spark.range(1000).select(F.col("id").alias("q_id"), F.lit("who is red bolt").alias("text")).write.parquet(f"{tmp_path}/q")
    questions = spark.read.parquet(f"{tmp_path}/q").select("q_id", F.split("text", " ").alias("tokens"))
    surfaces = spark.createDataFrame([("redbolt", "part:1", "red bolt", 3)], "surface string, id string, name string, score long")
    found = linking.candidates_for(linking.spans(questions), surfaces)
    assert "BroadcastExchange" not in plan(found)
    assert found.count() == 1000


def test_scores_take_tasks_by_rows_and_stay_the_same(spark):
    asked = spark.range(50).select(F.col("id").alias("q_id"))
    gold = spark.range(400).selectExpr("id % 47 as q_id", "concat('t', id % 19) as target")
    pred = spark.range(300).selectExpr("id % 43 as q_id", "concat('t', id % 23) as target")
    dealt = metrics.scores(asked, gold, pred, ["q_id"], rows=2_500_000)
    assert "hashpartitioning(q_id#" in plan(dealt) and ", 10), REPARTITION_BY_NUM" in plan(dealt)
    assert sorted(dealt.collect()) == sorted(metrics.scores(asked, gold, pred, ["q_id"]).collect())


def test_generation_meets_facts_by_entity_and_not_by_question(spark, tmp_path):
    facts = spark.createDataFrame([("a", "x.to", "m"), ("a", "x.home", "t"), ("m", "m.date", "1990"), ("m", "m.back", "a")], "s string, p string, o string")
    linked = spark.range(500).select(F.col("id").alias("q_id"), F.lit("a").alias("entity"))
    media = spark.createDataFrame([("x.to",)], "relation string")
    back = spark.createDataFrame([("x.to", "m.back"), ("m.back", "x.to")], "relation string, reverse string")
    met = []
    hop = candidates.one_hop
    candidates.one_hop = lambda f, asked, *rest: met.append(asked.count()) or hop(f, asked, *rest)
    try:
        found = candidates.generate(facts, linked, media, back)
    finally:
        candidates.one_hop = hop
    assert met == [1, 1]
    got = {(r["pattern"], tuple(r["rels"])): r["n"] for r in found.groupBy("pattern", "rels").agg(F.count_distinct("q_id").alias("n")).collect()}
    assert got == {("ERT", ("x.home",)): 500, ("ERMRT", ("x.to", "m.date")): 500}


def test_relations_are_asked_of_the_staged_ways_and_not_of_all_facts(spark):
    rows = [("a", "x.to", "m"), ("a", "x.home", "t"), ("m", "m.date", "1990"), ("m", "m.back", "a")]
    facts = spark.createDataFrame(rows, "s string, p string, o string")
    media = spark.createDataFrame([("x.to",)], "relation string")
    back = spark.createDataFrame([("x.to", "m.back"), ("m.back", "x.to")], "relation string, reverse string")
    asked = frontier.starts(spark.createDataFrame([(1, 1, "a", 0, 1)], "q_id long, m_id int, entity string, tok_start int, tok_end int"))
    ways = facts.select("s", "p").distinct().where("p != 'x.home'")
    assert frontier.Graph(facts, media, back, ways).to_target(asked).count() == 0
    assert frontier.Graph(facts, media, back).to_target(asked).count() == 1


def test_mediators_without_a_wanted_value_are_not_looked_up(spark):
    # every order holds part a and one of 300 other values; questions ask for a (the rarest by name) with each of the others
    rows = [(v, f"m{i}") for i in range(300) for v in ("a", f"v{i}", f"w{i}")] + [(f"v{i}", f"x{j}") for i in range(300) for j in range(300)]
    postings = spark.createDataFrame(rows, "value string, mediator string").cache()
    marked = patterns.marked(postings).where("value = 'a'").withColumn("v", F.lit("v7"))
    kept = marked.where(patterns.may_hold(patterns.marks(F.col("v")))).select("mediator").collect()
    assert ("m7",) in [tuple(r) for r in kept] and len(kept) < 15
    wanted = [(i, v) for i in range(300) for v in ("a", f"v{i}", f"w{i}")] + [(900, "a"), (901, "a"), (901, "gone"), (902, "v1"), (902, "v2"), (902, "v3")]
    asked = spark.createDataFrame(wanted, "q_id long, value string")
    found = {tuple(r) for r in patterns.nway_intersection(postings, asked).collect()}
    assert found == {(i, f"m{i}") for i in range(300)} | {(900, f"m{i}") for i in range(300)} | {(902, f"x{j}") for j in range(300)}
