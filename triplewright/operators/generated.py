"""Generated questions, whose mentions stand in brackets as ``[name|type|words]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.operators.linking import names_to_ids

VALUE = "<VALUE>"
YEAR = "Year"


def pieces(text: Column) -> Column:
    """Mentions and words of a question in order; a mention that is never closed goes, with all after it."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)\[.*?\](?= |$)|\[.*|[^ ]+"), F.lit(0))
    return F.filter(found, lambda p: ~p.startswith("[") | p.endswith("]"))


def mention(piece: Column) -> Column:
    """The fields (name, type, words) of a mention; null for a word."""
    inner = F.split(piece.substr(F.lit(2), F.length(piece) - 2), r"\|")
    fields = F.struct(F.translate(F.get(inner, 0), "_", " ").alias("name"), F.get(inner, 1).alias("type"), F.translate(F.get(inner, 2), " ", "_").alias("words"))
    return F.when(piece.startswith("[") & piece.endswith("]"), fields)


def relinked(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(q_id, text, answer) with each mention as ``[id|words]``; ``known`` has (name, id), and a year is a value.

    Only mentions are joined; the pieces of one question are put together again in their order.
    """
    rows = questions.select("q_id", F.posexplode(F.concat(pieces(F.col("text")), F.array("answer"))).alias("at", "piece")).withColumn("m", mention(F.col("piece")))
    words = rows.where("m is null").select("q_id", "at", "piece")
    mentions = names_to_ids(rows.where("m is not null").select("q_id", "at", "m.*"), known)
    entity = F.when(F.col("type") == YEAR, VALUE).otherwise(F.col("id"))
    mentions = mentions.select("q_id", "at", F.concat(F.lit("["), entity, F.lit("|"), "words", F.lit("]")).alias("piece"))
    parts = words.unionByName(mentions).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"))
    parts = parts.select("q_id", F.col("p.piece").alias("p"))
    return parts.select("q_id", F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), " ").alias("text"), F.element_at("p", -1).alias("answer"))
