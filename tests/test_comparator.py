"""Ranking by a comparison that may go in circles, in the JVM."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from triplewright.operators import ranking
from triplewright.plans import ranking as plans

SF = "/root/testdata/sf0.001"


def test_inserted_order_is_the_sorted_one_where_the_comparison_is_consistent(spark):
    rows = defaultdict(list)
    for r in plans._literal(spark, SF).collect():
        rows[r["q_id"]].append(r.asDict())
    got, other = defaultdict(list), defaultdict(list)
    for r in plans.rank_literal_inserted(spark, SF).orderBy("q_id", "rank").collect():
        got[r["q_id"]].append(r["c_id"])
    for r in plans.rank_literal_exact(spark, SF).orderBy("q_id", "rank").collect():
        other[r["q_id"]].append(r["c_id"])
    assert got.keys() == rows.keys()
    consistent = 0
    for q, items in rows.items():
        items.sort(key=lambda c: c["c_id"])
        placed: list[dict] = []
        for x in items:
            at = next((i for i, y in enumerate(placed) if plans.literal_before(x, y) > 0), len(placed))
            placed.insert(at, x)
        assert got[q] == [c["c_id"] for c in placed]
        # both ways round the same winner, and no two candidates with equally many wins: one order only
        pairs = [(x, y) for x in items for y in items if x is not y]
        wins = [sum(plans.literal_before(x, y) > 0 for y in items if y is not x) for x in items]
        if len(set(wins)) == len(wins) and all((plans.literal_before(x, y) > 0) != (plans.literal_before(y, x) > 0) for x, y in pairs):
            consistent += 1
            assert got[q] == other[q]
    assert consistent > 10


def test_circle_single_and_empty(spark):
    # stone, scissors, paper: 0 beats 1, 1 beats 2, 2 beats 0
    rows = [(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 20, 1)]
    cands = spark.createDataFrame(rows, "q_id long, c_id long, hand int")
    beats = lambda x, y: F.pmod(y["hand"] - x["hand"], F.lit(3)) == 1
    got = {(r["q_id"], r["c_id"]): r["rank"] for r in ranking.rank_by_insertion(cands, beats).collect()}
    # 11 goes behind 10, which it does not beat; 12 beats 10 and goes to the front
    assert got == {(1, 12): 1, (1, 10): 2, (1, 11): 3, (2, 20): 1}
    assert ranking.rank_by_insertion(cands.limit(0), beats).count() == 0
