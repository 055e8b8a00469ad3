"""Steps that once moved far more rows than their results need: same rows from fewer."""

from __future__ import annotations

from pyspark.sql import functions as F

from triplewright.operators import answering, features, frontier, patterns
from triplewright.sources import staging


def test_thinning_loses_no_row_of_a_key_and_drops_most_others(spark):
    df = spark.range(20_000).select((F.col("id") % 1000).alias("a"), F.concat(F.lit("v"), F.col("id") % 7).alias("b"), "id")
    keys = spark.createDataFrame([(3, "v3"), (3, "v3"), (999, "v1"), (5, None)], "a long, b string")
    kept = staging.thinned(df, keys, "a", "b")
    assert kept.columns == df.columns
    exact = df.join(keys, ["a", "b"], "left_semi").count()
    assert exact and exact <= kept.count() <= exact + 20
    assert staging.thinned(df, keys.limit(0), "a", "b").count() == 0


def test_a_second_entity_is_looked_up_at_the_mediators_of_the_rarer_end(spark, monkeypatch):
    # hub holds 200 mediators; 40 others hold one of them each, and two hold one of their own
    rows = [f for m in range(200) for f in (("hub", "x.to", f"m{m}"), (f"m{m}", "m.x", "hub"), (f"m{m}", "m.date", str(m)))]
    rows += [f for i in range(40) for f in ((f"o{i}", "y.to", f"m{i}"), (f"m{i}", "m.y", f"o{i}"))]
    rows += [f for i in (40, 41) for f in ((f"o{i}", "y.to", f"n{i}"), (f"n{i}", "m.y", f"o{i}"), (f"n{i}", "m.place", "rome"))]
    facts = spark.createDataFrame(rows, "s string, p string, o string")
    media = spark.createDataFrame([("x.to",), ("y.to",)], "relation string")
    back = spark.createDataFrame([r for a, b in (("x.to", "m.x"), ("y.to", "m.y")) for r in ((a, b), (b, a))], "relation string, reverse string")
    named = [(i, k, e, 2 * k, 2 * k + 1) for i in range(42) for k, e in enumerate(("hub", f"o{i}"))]
    mentions = spark.createDataFrame(named, "q_id long, m_id int, entity string, tok_start int, tok_end int")
    keep, sizes = frontier.written, {}

    def counted(df, name):
        table = keep(df, name)
        sizes.setdefault(name, []).append(table.count())
        return table

    monkeypatch.setattr(frontier, "written", counted)
    graph = frontier.Graph(facts, media, back)
    got = {(r["q_id"], r["entity"], tuple(r["rels"])) for r in frontier.token_aware_candidates(graph, mentions).where("pattern = 'ERMRERT'").collect()}
    assert got == {(i, e, rels) for i in range(40) for e, rels in (("hub", ("x.to", "m.y", "m.date")), (f"o{i}", ("y.to", "m.x", "m.date")))}
    # 42 mediators of the rarer ends are tried, 40 are shared, and no pair meets the 200 of the hub
    assert sizes["looked-up"] == [42] and sizes["shared-mediators"] == [80]
    assert max(n for name, found in sizes.items() for n in found if name != "shapes") < 200


def test_results_are_counted_and_looked_up_without_being_written(spark, monkeypatch):
    # e has ten mediators with two targets each, half of them seen twice; b is bound at two of these
    rows = [f for m in range(10) for f in (("e", "x.to", f"m{m}"), (f"m{m}", "m.x", "e"), (f"m{m}", "m.t", f"t{m % 5}"), (f"m{m}", "m.t", f"u{m}"), (f"m{m}", "m.t", "e"))]
    rows += [f for m in range(2) for f in (("b", "y.to", f"m{m}"), (f"m{m}", "m.y", "b"), (f"m{m}", "m.t", "b"))] + [("e", "x.home", "h"), ("e", "x.home", "e")]
    facts = spark.createDataFrame(rows, "s string, p string, o string")
    asked = [
        (1, "c1", "ERT", "e", None, ["x.home"]), (1, "c2", "ERMRT", "e", None, ["x.to", "m.t"]), (2, "c2", "ERMRT", "e", None, ["x.to", "m.t"]),
        (2, "c3", "ERMRERT", "e", "b", ["x.to", "m.y", "m.t"]), (2, "c4", "ERMRT", "e", None, ["x.to", "m.none"]),
    ]
    candidates = spark.createDataFrame(asked, "q_id long, c_id string, pattern string, entity string, other string, rels array<string>")
    want = {("c1", "h")} | {("c2", t) for m in range(10) for t in (f"t{m % 5}", f"u{m}")} | {("c2", "b"), ("c3", "t0"), ("c3", "t1"), ("c3", "u0"), ("c3", "u1")}
    assert {tuple(r) for r in answering.results(facts, candidates).collect()} == want
    shared = spark.createDataFrame([("e", "b", "x.to", "m.y", m) for m in ("m0", "m1")], "entity string, other string, r1 string, r2 string, mediator string")
    assert {tuple(r) for r in answering.results(facts, candidates, shared).collect()} == want
    keep, tables = answering.written, []
    monkeypatch.setattr(answering, "written", lambda df, name: tables.append(keep(df, name)) or tables[-1])
    gold = spark.createDataFrame([(1, "u3"), (1, "gone"), (2, "u3"), (2, "t0"), (2, "t0"), (9, "h")], "q_id long, target string")
    found = answering.result_sizes(facts, candidates, shared, gold)
    assert {tuple(r) for r in found.collect()} == {("c1", None, 1), ("c2", "u3", 1), ("c2", "t0", 1), ("c2", None, 14), ("c3", "t0", 1), ("c3", None, 3)}
    assert max(t.count() for t in tables) < 10 < len(want)
    scores = {(r["q_id"], r["c_id"]): (round(r["precision"], 6), r["recall"]) for r in answering.candidate_scores(candidates, found, gold).collect()}
    assert scores == {(1, "c1"): (0, 0), (1, "c2"): (round(1 / 16, 6), 0.5), (2, "c2"): (round(2 / 16, 6), 1), (2, "c3"): (0.25, 0.5), (2, "c4"): (0, 0)}


def test_only_postings_of_rarest_values_meet_their_marks(spark, monkeypatch):
    # a is held by 300 mediators, each other value by two; postings are repeated
    rows = [(v, f"m{i}") for i in range(300) for v in ("a", f"v{i // 2}")] * 2
    postings = spark.createDataFrame(rows, "value string, mediator string")
    asked = spark.createDataFrame([(i, v) for i in range(150) for v in ("a", f"v{i}", "a")] + [(900, "v1"), (901, "a"), (901, "gone")], "q_id long, value string")
    mark, met = patterns.marked, []
    monkeypatch.setattr(patterns, "marked", lambda held, *rest: met.append(held.where("value = 'a'").count()) or mark(held, *rest))
    got = sorted(tuple(r) for r in patterns.nway_intersection(postings, asked).collect())
    assert got == sorted([(i, f"m{2 * i + k}") for i in range(150) for k in (0, 1)] + [(900, "m2"), (900, "m3")])
    assert met == [0]


def test_neighbours_are_joined_side_by_side(spark):
    texts = [[], ["a"], ["a", "b"], ["a", "", "c", "a"], [f"w{i}" for i in range(40)]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t array<string>")
    for n in (1, 2, 3):
        found = rows.select("id", features.ngrams(F.col("t"), n).alias("g"))
        assert "concat_ws" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert {r["id"]: r["g"] for r in found.collect()} == {i: ["_".join(t[k : k + n]) for k in range(len(t) - n + 1)] for i, t in enumerate(texts)}
