"""Readers of question sets with gold answers, and writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions.names import url_to_id
from triplewright.sources.lines import numbered_lines

NESTED = (
    "Questions array<struct<QuestionId:string,RawQuestion:string,ProcessedQuestion:string,Parses:array<struct<ParseId:string,"
    "Sparql:string,TopicEntityMid:string,InferentialChain:array<string>,Constraints:array<struct<Operator:string,ArgumentType:string,"
    "Argument:string,SourceNodeIndex:int,NodePredicate:string>>,Answers:array<struct<AnswerType:string,AnswerArgument:string,EntityName:string>>>>>>"
)


def simple_questions(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, text, gold, parse) of tab-separated subject, relation, object and question; the id is the line number from 0."""
    rows = numbered_lines(spark, path)
    # empty lines at the end of a file are no questions
    last = rows.where("value != ''").groupBy("file").agg(F.max("line").alias("last"))
    rows = rows.join(F.broadcast(last), "file").where("line <= last")
    f = F.split("value", "\t")
    ids = [url_to_id(F.get(f, i)) for i in range(3)]
    return rows.select(F.col("line").cast("string").alias("q_id"), F.trim(F.get(f, 3)).alias("text"), F.array(ids[2]).alias("gold"), F.array(*ids).alias("parse"))


def list_questions(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, text, gold) of a JSON list; gold answers are names."""
    raw = spark.read.schema("id string, utterance string, result array<string>").option("multiLine", True).json(path)
    return raw.select(F.col("id").alias("q_id"), F.col("utterance").alias("text"), F.col("result").alias("gold"))


def parsed_questions(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, interp, text, gold, parse) of nested JSON: one row per interpretation of a question."""
    raw = spark.read.schema(NESTED).option("multiLine", True).json(path)
    q = raw.select(F.explode("Questions").alias("q"))
    p = q.select("q.QuestionId", "q.RawQuestion", F.posexplode("q.Parses").alias("interp", "p"))
    chain = F.coalesce("p.InferentialChain", F.array().cast("array<string>"))
    steps = F.flatten(F.transform(chain, lambda r: F.array(r, F.lit(None).cast("string"))))
    equal = F.filter("p.Constraints", lambda c: (c["Operator"] == "Equal") & (c["SourceNodeIndex"] == 0))
    extra = F.flatten(F.transform(equal, lambda c: F.array(c["NodePredicate"], c["Argument"])))
    parse = F.concat(F.array("p.TopicEntityMid"), steps, F.coalesce(extra, F.array().cast("array<string>")))
    return p.select(
        F.col("QuestionId").alias("q_id"),
        "interp",
        F.col("RawQuestion").alias("text"),
        F.transform("p.Answers", lambda a: a["AnswerArgument"]).alias("gold"),
        parse.alias("parse"),
    )


READERS = {"tsv": simple_questions, "list": list_questions, "parsed": parsed_questions}


def write_results(results: DataFrame, path: str) -> None:
    """``text``, gold and predicted answers as JSON lists, tab-separated."""
    results.select("text", F.to_json("gold"), F.to_json("pred")).write.option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(f, 0).alias("text"), F.from_json(F.get(f, 1), "array<string>").alias("gold"), F.from_json(F.get(f, 2), "array<string>").alias("pred")
    )


def write_result_info(summary: DataFrame, path: str) -> None:
    """The figures of a run, one JSON object a row."""
    summary.write.mode("overwrite").json(path)


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Candidates with their features, to be ranked again without linking and matching."""
    candidates.write.mode("overwrite").parquet(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
