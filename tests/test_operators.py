from __future__ import annotations

import random

from pyspark.sql import functions as F

from triplewright.operators import features, linking, metrics, patterns, ranking
from triplewright.plans.ranking import literal_before


def merged(a, b):
    """Two cursors over postings sorted by (mediator, relation); both go on after a match."""
    a, b, i, j, out = sorted(a), sorted(b), 0, 0, []
    while i < len(a) and j < len(b):
        if a[i][0] < b[j][0]:
            i += 1
        elif b[j][0] < a[i][0]:
            j += 1
        else:
            out.append((a[i][0], a[i][1], b[j][1]))
            i, j = i + 1, j + 1
    return out


def test_zip_intersection_is_a_two_cursor_merge(spark):
    rnd, left, right, want = random.Random(5), [], [], []
    for case in range(60):
        sides = [[(rnd.randrange(5) + 10 * case, f"r{rnd.randrange(4)}") for _ in range(rnd.randrange(8))] for _ in range(2)]
        want += [(case, *row) for row in merged(*sides)]
        for side, rows in zip((left, right), sides, strict=True):
            side += [(f"v{case}", r, m) for m, r in rows]
    schema = "value string, relation string, mediator long"
    got = patterns.zip_intersection(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    rows = [(int(r["value_a"][1:]), r["mediator"], r["relation_a"], r["relation_b"]) for r in got.collect()]
    assert sorted(rows) == sorted(want)


def test_zip_differs_from_the_product(spark):
    schema = "value string, relation string, mediator long"
    a = spark.createDataFrame([("a", "r1", 1), ("a", "r2", 1), ("a", "r1", 3)], schema)
    b = spark.createDataFrame([("b", "q1", 1), ("b", "q1", 2), ("b", "q1", 3), ("b", "q2", 3)], schema)
    assert sorted((r["mediator"], r["relation_a"], r["relation_b"]) for r in patterns.zip_intersection(a, b).collect()) == [(1, "r1", "q1"), (3, "r1", "q1")]
    assert patterns.intersection(a, b).count() == 4


def test_language_rows(spark):
    rows = spark.createDataFrame([(1, ["en", "en"]), (2, ["de"]), (3, []), (4, [None, "de"])], "id int, l array<string>")
    literals = F.transform("l", lambda x: F.struct(F.lit("t").alias("value"), x.alias("lang")))
    got = patterns.language_rows(rows, literals).groupBy("id").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (3, 1), (4, 1)]
    assert patterns.language_rows(rows, literals, dedup=True).count() == 3


def test_span_rules(spark):
    tokens = [[("the", "DT"), ("big", "JJ"), ("Apple", "NNP"), ("Pie", "NNP"), ("be", "VBZ")]]
    df = spark.createDataFrame([(tokens[0],)], "t array<struct<lemma:string,tag:string>>")
    ok = lambda s, e: df.select(linking.is_entity_occurrence(F.col("t"), F.lit(s), F.lit(e)).alias("x")).first()["x"]
    assert [ok(0, 1), ok(0, 2), ok(1, 2), ok(2, 3), ok(2, 4), ok(4, 5), ok(3, 3)] == [False, True, True, False, True, False, False]


def test_maximal_sets(spark):
    mentions = spark.createDataFrame([(1, 1, 0, 2), (1, 2, 1, 3), (1, 3, 2, 4), (2, 9, 0, 1)], "q_id long, m_id long, tok_start int, tok_end int")
    got = linking.maximal_sets(linking.overlapping(mentions)).collect()
    assert sorted((r["q_id"], r["members"]) for r in got) == [(1, [1, 3]), (1, [2]), (2, [9])]


def test_scores_of_empty_sides(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "q_id long")
    gold = spark.createDataFrame([(2, "a"), (3, "a"), (3, "b")], "q_id long, target string")
    pred = spark.createDataFrame([(3, "a"), (3, "a"), (3, "c")], "q_id long, target string")
    for empty in (0.0, 1.0):
        got = {r["q_id"]: (r["precision"], r["recall"], r["f1"]) for r in metrics.scores(q, gold, pred, ["q_id"], empty).collect()}
        assert got == {1: (1, 1, 1), 2: (empty, 0, 0), 3: (0.5, 0.5, 0.5)}


def test_question_tokens(spark):
    df = spark.createDataFrame(
        [(["Who", "is", "New", "York", "?"], ["X", "X", "X", "X", "PUNCT"], [None, None, "[city]", "[city]", None])], "t array<string>, g array<string>, l array<string>"
    )
    got = df.select(features.question_tokens(F.col("t"), F.col("g"), F.col("l")).alias("x")).first()["x"]
    assert got == ["<start>", "who", "is", "[city]"]
    assert df.select(features.ngrams(F.col("t"), 4).alias("x")).first()["x"] == ["Who_is_New_York", "is_New_York_?"]


def test_comparator_keeps_all(spark):
    base = dict(ent_lit=1, rel_lit=2, is_mediator=True, coverage=1, cover_card=1, entity_score=0.5, relation_score=0.5, popularity=1, rel_length=1, rel_card=1, result_size=1)
    assert literal_before(base, base | {"is_mediator": False, "rel_lit": 1, "popularity": 0}) > 0
    assert literal_before(base, base | {"rel_lit": 1}) > 0


def test_folds_and_pairs(spark):
    df = spark.createDataFrame([(1, i, int(i < 2)) for i in range(8)], "q_id long, c_id long, label int")
    pairs = ranking.train_pairs(df, 3).collect()
    assert len(pairs) == 12 and sum(r["label"] for r in pairs) == 6
    assert ranking.folds(df, "c_id", 3).where("fold between 0 and 2").count() == 8
