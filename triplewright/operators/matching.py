"""Matching relations with the words of a question, and with the class of its answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplewright.functions.names import derivation_key, relation_suffix, relation_words
from triplewright.functions.vectors import synonym_score
from triplewright.sources.staging import by_size, dealt, written


def relation_word_table(relations: DataFrame, n: int = 3) -> DataFrame:
    """(relation, word): distinct words of the last ``n`` parts of the lemma form, parts of hyphenated words too."""
    lemma = F.coalesce("lemma", "relation") if "lemma" in relations.columns else F.col("relation")
    words = relations.select("relation", F.explode(relation_words(lemma, n)).alias("word"))
    parts = words.where(F.col("word").contains("-")).select("relation", F.explode(F.split("word", "-")).alias("word"))
    return words.unionByName(parts).where("word != ''").distinct()


def match_by_prefix(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(q_id, relation, lemma): relation words that start with a lemma of at least two letters.

    Both sides become equi-joinable: a word meets the lemmas that equal one of its beginnings.
    """
    starts = words.select(
        "relation", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("word"))), lambda k: F.substring("word", F.lit(1), k))).alias("lemma")
    ).distinct()
    # exploded tokens look as small as the file of their questions; they are not to be broadcast
    return tokens.where(F.length("lemma") > 1).hint("merge").join(starts, "lemma").select("q_id", "relation", "lemma").distinct()


def match_by_derivation(words: DataFrame, tokens: DataFrame, derivations: DataFrame) -> DataFrame:
    """(q_id, relation, lemma): relation words derived from a token; ``derivations`` has (word_pos, word).

    Derivations and relation words meet first and are written, so their number says whether tokens must be moved and sorted to meet them.
    """
    keyed = tokens.withColumn("word_pos", derivation_key(F.col("lemma"), F.col("tag"))).where("word_pos is not null")
    derived = written(derivations.join(words, "word").select("word_pos", "relation").distinct(), "derived-words")
    return keyed.join(by_size(derived), "word_pos").select("q_id", "relation", "lemma").distinct()


def match_by_vector(pairs: DataFrame, cutoff: float = 0.4) -> DataFrame:
    """Pairs with columns ``a`` and ``b`` whose cosine is over the cutoff."""
    return pairs.withColumn("score", synonym_score(F.col("a"), F.col("b"), cutoff)).where("score > 0").drop("a", "b")


def match_by_context(relation_words_: DataFrame, tokens: DataFrame, rows: int | None = None) -> DataFrame:
    """(q_id, relation, lemma, score) of context words (relation, word, score).

    Both sides are made distinct before they meet, so a row of the join is a row of the result and nothing is grouped after it.
    With the number of token ``rows``, tokens are dealt to as many tasks as these need.
    """
    asked = dealt(tokens.select("q_id", "lemma"), rows, "lemma").groupBy("q_id", "lemma").agg(F.count("*").alias("times"))
    words = relation_words_.groupBy("relation", F.col("word").alias("lemma")).agg(F.sum("score").alias("score"))
    return asked.join(words, "lemma").select("q_id", "relation", "lemma", (F.col("score") * F.col("times")).alias("score"))


def normalised_word_scores(words: DataFrame, most: int = 1000) -> DataFrame:
    """(relation, word, place, score): the first ``most`` words (relation, word, score) of a relation, from place 0, scores as shares of their sum.

    The limit is on the row number itself, so each task drops what cannot be among the first before words are moved.
    """
    nth = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("score"), "word"))
    kept = words.withColumn("nth", nth).where(F.col("nth") <= most).withColumn("place", (F.col("nth") - 1).cast("long")).drop("nth")
    return kept.withColumn("score", F.col("score") / F.sum("score").over(Window.partitionBy("relation")))


def mediated_index(pairs: DataFrame, reverses: DataFrame) -> DataFrame:
    """(key, target, words): words of a pair under the reverse of either relation, where there is one."""
    a = pairs.join(reverses.withColumnRenamed("relation", "rel_a"), "rel_a").select(F.col("reverse").alias("key"), F.col("rel_b").alias("target"), "words")
    b = pairs.join(reverses.withColumnRenamed("relation", "rel_b"), "rel_b").select(F.col("reverse").alias("key"), F.col("rel_a").alias("target"), "words")
    return a.unionByName(b)


def important_types(types: DataFrame, counts: DataFrame, share: float = 0.1, total: int = 900) -> DataFrame:
    """(relation, type) of (relation, type, n): types of many targets or of a large share; without a total, the ten most common.

    Base types count for base relations only.
    """
    fits = F.col("relation").startswith("base") | ~F.col("type").startswith("base")
    joined = types.join(counts.select("relation", "total"), "relation", "left")
    place = F.row_number().over(Window.partitionBy("relation").orderBy(F.desc("n"), "type"))
    large = F.when(F.col("total").isNotNull(), (F.col("n") > total) | (F.col("n") / F.col("total") >= share)).otherwise(F.col("place") <= 10)
    return joined.withColumn("place", place).where(fits & large).select("relation", "type")


def frequent_types(types: DataFrame, least: int, most: int) -> DataFrame:
    """The ``most`` commonest types of a relation, without base and user types and those under ``least``."""
    good = types.where(~F.col("type").startswith("base") & ~F.col("type").startswith("user") & (F.col("n") >= least))
    w = Window.partitionBy("relation").orderBy(F.desc("n"), "type")
    return good.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def answer_type_match(classes: DataFrame, relations: DataFrame, rows: int | None = None) -> DataFrame:
    """(q_id, relation, match): sum of the probabilities of the answer classes that a relation answers with.

    ``classes`` has (q_id, class, prob); ``relations`` (q_id, relation, expected, target_types).
    Target types, where there are any, keep the expected type from being looked at. With the number of ``rows`` of ``relations``,
    both tables are dealt by question to as many tasks as these need.
    """
    suffix = F.element_at(F.split("class", r"\."), -1)
    by_target = F.exists("target_types", lambda t: t.contains(F.col("class")))
    answers = (
        relation_suffix(F.col("relation")).contains(suffix)
        | F.when(F.col("target_types").isNotNull(), by_target).otherwise(F.coalesce(F.col("expected").contains(suffix), F.lit(False)))
    )
    matches = (
        F.when(F.col("class") == "date", F.coalesce(F.col("expected") == "type.datetime", F.lit(False)))
        .when(F.col("class") == "count", F.coalesce(F.col("expected") == "type.int", F.lit(False)))
        .otherwise(answers)
    )
    return (
        dealt(relations, rows, "q_id")
        .join(dealt(classes, rows, "q_id"), "q_id", "left")
        .groupBy("q_id", "relation")
        .agg(F.sum(F.when(F.coalesce(matches, F.lit(False)), F.col("prob")).otherwise(0.0)).alias("match"))
    )


def fallback_relation(unmatched: DataFrame) -> DataFrame:
    """(q_id, relation): where no token matched, the relation with the most distinct objects."""
    return unmatched.groupBy("q_id").agg(F.max_by("relation", F.struct("objects", "relation")).alias("relation"))
