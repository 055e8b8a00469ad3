"""Steps that once handed every group to pandas, or made their pairs or matches twice: same rows from less work."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from triplewright.operators import ranking
from triplewright.plans import registry
from triplewright.sources import staging


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_may_lie_across_batches(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("q_id"), F.col("id").alias("v"))
    schema = StructType([StructField("q_id", LongType()), StructField("total", LongType())])
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = staging.group_by_group(rows, "q_id", lambda g: [{"q_id": g[0]["q_id"], "total": sum(r["v"] for r in g)}], schema).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert sorted((r["q_id"], r["total"]) for r in found) == [(q, sum(range(q, 100, 7))) for q in range(7)]
    assert staging.group_by_group(rows.limit(0), "q_id", lambda g: [], schema).collect() == []


def test_pairs_are_made_once_for_both_ends(spark):
    kept = spark.range(6).select((F.col("id") % 2).alias("q_id"), F.col("id").alias("c_id"))
    wins = ranking.candidate_pairs(kept).withColumn("p_a", F.when(F.col("c_id_a") == 2, 0.9).otherwise(0.1))
    ranked = ranking.rank_by_wins(kept, wins)
    assert plan(ranked).count("Range (") == 3  # the candidates, and the two sides of one join
    got = {(r["q_id"], r["c_id"]): (r["wins"], r["rank"]) for r in ranked.collect()}
    assert got == {(0, 0): (0, 3), (0, 2): (2, 1), (0, 4): (1, 2), (1, 1): (0, 3), (1, 3): (1, 2), (1, 5): (2, 1)}


def test_pruning_reads_features_that_are_computed_once(spark):
    found = registry.QUERIES["prune_candidates"](spark, "/root/testdata/sf0.001")
    assert all("labelled-features" in f for f in found.inputFiles())
