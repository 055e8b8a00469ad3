from __future__ import annotations

import json

from triplewright.sources import gold, lookups


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return f"file://{p}"


def test_lookups(spark, tmp_path):
    p = write(tmp_path, "e", "m.0abc1\tfoo name\t7\tfooly\tfoo\nm.2\tb\t1\n")
    rows = lookups.entity_list(spark, p).orderBy("mid").collect()
    assert [tuple(r) for r in rows] == [("m.0abc1", "foo name", 7, ["fooly", "foo"]), ("m.2", "b", 1, [])]
    p = write(tmp_path, "t", "w\t300\ta:b:20 c:5\nx\t100\ta:20\n")
    assert [tuple(r) for r in lookups.word_type_counts(spark, p).collect()] == [("w", 300, {"a:b": 20.0})]
    p = write(tmp_path, "r", "rel\t-\tw1(1.0) w2(3.0) bad\n")
    assert [(w["word"], w["score"]) for w in lookups.relation_words(spark, p).first()["words"]] == [("w1", 0.25), ("w2", 0.75)]
    p = write(tmp_path, "c", "r\t9\t8\t7\nx\t1\t1\t1\na/key/b\t1\t1\t1\n")
    assert [r["relation"] for r in lookups.relation_counts(spark, p).collect()] == []
    p = write(tmp_path, "v", "a.b\tc.d\n")
    assert lookups.reverse_relations(spark, p).count() == 2
    p = write(tmp_path, "x", "r\tt1\nr\tt2\n")
    assert [tuple(r) for r in lookups.relation_expected_types(spark, p).collect()] == [("r", "t2")]
    p = write(tmp_path, "m", "v\tr\t_\tm\nbroken\trow\n")
    facts = lookups.mediator_facts(spark, p)
    assert facts.count() == 1
    lookups.write_mediator_index(facts, f"file://{tmp_path}/index", 2)
    assert spark.read.parquet(f"file://{tmp_path}/index").count() == 1
    p = write(tmp_path, "o", "New York\tm.1\nnewyork\tm.2\n12 may\t/type/datetime\n")
    got = {r["mention"]: [(i["id"], i["kind"]) for i in r["ids"]] for r in lookups.oracle_entities(spark, p).collect()}
    assert got["NewYork"] == [("m.1", "entity")] and got["12may"] == [("/type/datetime", "date")]


def test_gold(spark, tmp_path):
    p = write(tmp_path, "s.tsv", "www.freebase.com/m/1\twww.freebase.com/a/b\twww.freebase.com/m/2\twhat is it \n" * 2)
    rows = gold.simple_questions(spark, p).collect()
    assert [r["q_id"] for r in rows] == ["0", "1"] and rows[0]["parse"] == ["m.1", "a.b", "m.2"] and rows[0]["text"] == "what is it"
    p = write(tmp_path, "l.json", json.dumps([{"id": 1, "utterance": "q", "result": ["a", "b"]}]))
    assert tuple(gold.list_questions(spark, p).first()) == ("1", "q", ["a", "b"])
    parse = {
        "TopicEntityMid": "m.1", "InferentialChain": ["r1", "r2"], "Answers": [{"AnswerArgument": "m.9"}],
        "Constraints": [{"Operator": "Equal", "SourceNodeIndex": 0, "NodePredicate": "p", "Argument": "m.3"}, {"Operator": "Equal", "SourceNodeIndex": 1, "NodePredicate": "x", "Argument": "y"}],
    }
    p = write(tmp_path, "n.json", json.dumps({"Questions": [{"QuestionId": "Q", "RawQuestion": "t", "Parses": [parse]}]}))
    row = gold.parsed_questions(spark, p).first()
    assert row["parse"] == ["m.1", "r1", None, "r2", None, "p", "m.3"] and row["gold"] == ["m.9"]


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("q", ["a", "b"], []), ("r", [], ["x\"y"])], "text string, gold array<string>, pred array<string>")
    gold.write_results(df, f"file://{tmp_path}/out")
    got = sorted(tuple(r) for r in gold.read_results(spark, f"file://{tmp_path}/out").collect())
    assert got == [("q", ["a", "b"], []), ("r", [], ["x\"y"])]
