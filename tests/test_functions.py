from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from triplewright.functions import names, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (names.normalise_name, "St. John's, N-Y!", "stjohnsny"),
        (names.drop_the, "theodore", "odore"),
        (names.drop_suffixes, "Heat #12", "Heat"),
        (names.drop_suffixes, "Heat (film)", "Heat"),
        (names.remove_namespace, "<http://rdf.freebase.com/ns/m.1>", "m.1"),
        (names.plain_literal, '"1999-00-00"^^xsd:date', "1999"),
        (names.plain_literal, '"a "b" c"@en', 'a "b" c'),
        (names.literal_language, '"x"@en', "en"),
        (names.literal_language, "m.1", None),
        (names.url_to_id, "www.freebase.com/m/04whkz5", "m.04whkz5"),
        (names.relation_domain, "film.actor.film", "film"),
        (names.year_of, "1999ish", "1999"),
        (names.comparable, "0", "0"),
        (names.comparable, "007", "7"),
        (names.comparable, "2/3/1836", "1836-02-03"),
        (names.pattern_complexity, "ERMRERT", 3),
    ],
)
def test_scalars(spark, f, given, want):
    assert one(spark, f(F.col("v")), v=given) == want


def test_edit_distance(spark):
    assert one(spark, names.edit_distance(F.col("a"), F.col("b")), a="this is a house", b="This is not a house") == 4


def test_relation_words(spark):
    assert one(spark, names.relation_words(F.col("r"), 2), r="film.actor.film_role") == ["actor", "film", "role"]
    assert one(spark, names.relation_suffix(F.col("r"), 3), r="a.b") == "a.b"


def test_answer_classes(spark):
    assert one(spark, names.answer_classes(F.col("q")), q="In how many films")[0]["class"] == "count"
    assert one(spark, names.answer_classes(F.col("q")), q="name a film") is None


def test_date_parts(spark):
    assert tuple(one(spark, names.date_parts(F.col("v")), v="2/23/1836")) == (1836, 2, 23)
    assert tuple(one(spark, names.date_parts(F.col("v")), v="1836-02-23T00")) == (1836, 2, 23)
    assert one(spark, names.date_parts(F.col("v")), v="soon") is None


def test_synonyms(spark):
    assert one(spark, vectors.synonym_score(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 0.1]) > 0.9
    assert one(spark, vectors.synonym_score(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 1.0]) == 0
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) == 0
