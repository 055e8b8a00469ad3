"""Relations over a mediator: those between two entities, and how well the words of relation pairs fit a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.sources.staging import by_size, dealt, written

TASK_TEXTS = 5_000  # texts whose words a task counts
TASK_WORDS = 500_000  # words before counting that a task of the counts gets


def entity_pair_relations(postings: DataFrame, pairs: DataFrame, reverses: DataFrame) -> DataFrame:
    """(q_id, reverse, rel_a, rel_b): relations of the mediators that both ends of a pair (q_id, start, target) hold.

    ``reverse`` leads from the start to the mediator; where none is known it is the relation itself. Only the postings
    of a pair's rarer end are read out, the other end is looked up at these mediators. Repeated postings are not made
    distinct before: only what is found is.
    """
    held = postings.select("value", "relation", "mediator")
    sizes = held.groupBy("value").agg(F.count("*").alias("n"))
    sized = pairs.join(sizes.select(F.col("value").alias("start"), F.col("n").alias("ns")), "start")
    sized = sized.join(sizes.select(F.col("value").alias("target"), F.col("n").alias("nt")), "target")
    swapped = F.col("nt") < F.col("ns")
    ends = sized.select(
        "q_id",
        swapped.alias("swapped"),
        F.when(swapped, F.col("target")).otherwise(F.col("start")).alias("near"),
        F.when(swapped, F.col("start")).otherwise(F.col("target")).alias("far"),
    )
    near = held.select(F.col("value").alias("near"), F.col("relation").alias("rel_near"), "mediator")
    far = held.select(F.col("value").alias("far"), F.col("relation").alias("rel_far"), "mediator")
    found = ends.join(near, "near").join(far, ["far", "mediator"])
    rel_a, rel_b = F.when(F.col("swapped"), F.col("rel_far")).otherwise(F.col("rel_near")), F.when(F.col("swapped"), F.col("rel_near")).otherwise(F.col("rel_far"))
    found = found.select("q_id", rel_a.alias("rel_a"), rel_b.alias("rel_b")).distinct()
    back = reverses.select(F.col("relation").alias("rel_a"), "reverse")
    return found.join(back, "rel_a", "left").select("q_id", F.coalesce("reverse", "rel_a").alias("reverse"), "rel_a", "rel_b")


def pair_word_shares(texts: DataFrame) -> DataFrame:
    """(rel_a, rel_b, word, score) of texts (id, rel_a, rel_b, text): each word's share of the words of its pair of relations.

    Texts are dealt to tasks of ``TASK_TEXTS``, which count the words of each part of their texts, and these counts are dealt by
    word, so that neither a task's words nor a word that stands in every text make a task grow with the input.
    """
    keys = ["rel_a", "rel_b"]
    # about one row for each pair of relations, joined and not taken from a window, which would hold all words of a pair
    totals = written(texts.groupBy(*keys).agg(F.count("*").alias("texts"), F.sum(F.when(F.col("text").isNotNull(), F.size(F.split("text", " ")))).alias("total")), "pair-totals")
    n_texts, n_words = totals.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    tasks = max(8, -(-n_texts // TASK_TEXTS))
    part = F.pmod(F.xxhash64("id"), F.lit(8 * tasks)).alias("part")
    words = texts.select(part, *keys, "text").repartition(tasks, "part").select("part", *keys, F.explode(F.split("text", " ")).alias("word"))
    counts = dealt(words.groupBy("part", *keys, "word").agg(F.count("*").alias("n")).drop("part"), n_words, "word", each=TASK_WORDS)
    counts = counts.groupBy(*keys, "word").agg(F.sum("n").alias("n"))
    return counts.join(by_size(totals.select(*keys, "total")), keys).select(*keys, "word", (F.col("n") / F.col("total")).alias("score"))


def mediated_match(asked: DataFrame, index: DataFrame, tokens: DataFrame, matched_only: bool = False) -> DataFrame:
    """(q_id, rel_a, rel_b, hits, score): tokens (q_id, lemma) found among the words of relation pairs, and their summed scores.

    ``asked`` has (q_id, rel_a, rel_b). Without a ``rel_b``, every pair of ``rel_a`` in ``index`` (rel_a, rel_b, word, score)
    is tried; a given pair stays even if the index does not know it. Tokens of one letter match nothing.
    """
    keys = ["rel_a", "rel_b"]
    given = asked.where("rel_b is not null").select("q_id", *keys)
    open_ = asked.where("rel_b is null").select("q_id", "rel_a").join(index.select(*keys).distinct(), "rel_a").select("q_id", *keys)
    pairs = given.unionByName(open_).distinct()
    words = tokens.select("q_id", F.translate("lemma", "-", "_").alias("word")).where(F.length("word") > 1)
    hits = pairs.join(words, "q_id").join(index, [*keys, "word"]).groupBy("q_id", *keys).agg(F.count("*").alias("hits"), F.sum("score").alias("score"))
    found = pairs.join(hits, ["q_id", *keys], "inner" if matched_only else "left")
    return found.select("q_id", *keys, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("score", F.lit(0.0)).alias("score"))
