"""Pairs that a ranker is fitted on, with their features, from one join inside a question."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import ranking


def test_features_of_training_pairs_are_those_of_the_pairs_looked_up(spark):
    rows = spark.range(400).select(
        (F.col("id") % 23).alias("q_id"), F.col("id").alias("c_id"), (F.col("id") % 7 < 2).cast("int").alias("label"),
        (F.col("id") % 11 / 4.0).alias("x"), (F.col("id") % 5).cast("double").alias("y"),
    )
    for most in (3, 200):
        pairs = ranking.train_pairs(rows.select("q_id", "c_id", "label"), most).where("c_id_a < c_id_b")
        both = ranking.pair_features(ranking.candidate_pairs(rows.drop("label")), ["x", "y"])
        want = pairs.join(both, ["q_id", "c_id_a", "c_id_b"]).select("label", *[f"{f}_{s}" for s in ("diff", "a", "b") for f in "xy"])
        got = ranking.train_pair_features(rows, ["x", "y"], most)
        assert got.columns == want.columns and want.count() > 0
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got._jdf.queryExecution().executedPlan().toString().count("Join") < want._jdf.queryExecution().executedPlan().toString().count("Join")
