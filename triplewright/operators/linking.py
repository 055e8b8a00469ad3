"""Linking mentions in questions to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from triplewright.functions.names import is_main_name, normalise_name, year_of
from triplewright.sources.staging import by_size, group_by_group, written

# Word classes and lemmas by which spans and tokens are chosen (fixed values).
IGNORED_LEMMAS = ["be", "of", "the", "and", "or", "a"]
CONTENT_TAGS = ["NN", "NNS", "VB", "VBD", "VBN", "VBZ", "CD", "NNP", "JJ", "VBP", "JJS", "RB"]
SPAN_TAGS = r"^(UH|\.|TO|PRP.?|#|FW|IN|VB.?|RB|CC|HYPH|WP|XX|NNP.?|NN.?|JJ.?|CD|DT|MD|POS)+$"


def spans(questions: DataFrame, tokens: str = "tokens", longest: int = 8, reach: int | None = None) -> DataFrame:
    """(q_id, tok_start, tok_end, span): every run of up to ``longest`` tokens; the end is exclusive.

    With ``reach``, the letters of the longest known surface (see ``longest_surface``), runs end by their normalised letters
    and not by their tokens: no name is too long.
    """
    n = F.size(tokens)
    found = questions.where(n > 0)
    if reach is None:
        last = F.least(F.size(tokens), F.col("tok_start") + longest)
    else:
        # letters up to each token; a run that starts behind a token goes on while it has no more than ``reach``
        letters = F.transform(tokens, lambda t: F.length(normalise_name(t)))
        upto = F.transform(letters, lambda _, i: F.aggregate(F.slice(letters, 1, i + 1), F.lit(0), lambda s, x: s + x))
        found = found.withColumn("__upto", upto)
        before = F.when(F.col("tok_start") > 0, F.get("__upto", F.col("tok_start") - 1)).otherwise(0)
        last = F.greatest(F.col("tok_start") + 1, F.size(F.filter("__upto", lambda x: x <= before + reach)))
    start = found.withColumn("tok_start", F.explode(F.sequence(F.lit(0), n - 1)))
    end = start.withColumn("tok_end", F.explode(F.sequence(F.col("tok_start") + 1, last)))
    return end.select(
        "q_id", "tok_start", "tok_end", F.array_join(F.slice(tokens, F.col("tok_start") + 1, F.col("tok_end") - F.col("tok_start")), " ").alias("span")
    )


def longest_surface(surfaces: DataFrame) -> int:
    """Letters of the longest surface: the one bound that spans need."""
    return surfaces.agg(F.max(F.length("surface"))).first()[0] or 0


def link_mentions(questions: DataFrame, surfaces: DataFrame, most: int = 3, least: float = 0.1) -> DataFrame:
    """(q_id, m_id, entity, name, tok_start, tok_end, surface_score, popularity, perfect): the mentions of questions (q_id, text, tokens).

    ``tokens`` are (lemma, tag) of the words of ``text`` between spaces. Runs of tokens that may name an entity meet the ``most``
    first entities of their surface; a question none of whose mentions reaches the threshold keeps those over half of it.
    """
    worded = questions.select("q_id", "tokens", F.split("text", " ").alias("words"))
    runs = spans(worded, "words", reach=longest_surface(surfaces))
    best = top_per_span(surfaces, ["surface"], [F.desc("score"), F.asc("id")], most).drop("place")
    found = candidates_for(runs, best).join(questions.select("q_id", "tokens"), "q_id")
    valid = is_entity_occurrence(F.col("tokens"), F.col("tok_start"), F.col("tok_end"))
    kept = strict_or_lax(found.withColumn("valid", valid).drop("tokens"), least)
    m_id = F.row_number().over(Window.partitionBy("q_id").orderBy("tok_start", "tok_end", "id"))
    return kept.select(
        "q_id", m_id.alias("m_id"), F.col("id").alias("entity"), "name", "tok_start", "tok_end", "surface_score", F.col("score").alias("popularity"), "perfect"
    )


def is_entity_occurrence(tokens: Column, start: Column, end: Column) -> Column:
    """Whether tokens (lemma, tag) from ``start`` to ``end`` may name an entity."""
    part = F.slice(tokens, start + 1, end - start)
    first = F.element_at(part, 1)
    tag = first["tag"]
    one = end - start == 1
    alone = tag.startswith("N") | tag.startswith("J") | tag.isin("FW", "XX")
    run = F.array_join(F.transform(part, lambda t: t["tag"]), "").rlike(SPAN_TAGS)
    before, behind = F.get(tokens, start - 1)["tag"], F.get(tokens, end)["tag"]
    beside = tag.startswith("NNP") & (
        ((start > 0) & F.coalesce(before.startswith("NNP"), F.lit(False))) | F.coalesce(behind.startswith("NNP"), F.lit(False))
    )
    return (
        (end > start)
        & ~F.forall(part, lambda t: t["lemma"].isin(IGNORED_LEMMAS))
        & (~first["lemma"].isin(IGNORED_LEMMAS) | (first["lemma"] == "the"))
        & F.when(one, alone & ~beside).otherwise(run)
    )


def content_tokens(questions: DataFrame) -> DataFrame:
    """Tokens (lemma, tag) that carry content."""
    kept = F.filter("tokens", lambda t: t["tag"].isin(CONTENT_TAGS) & ~t["lemma"].isin("be", "do", "go"))
    return questions.withColumn("content", kept)


def surface_index(entities: DataFrame) -> DataFrame:
    """(surface, id, name, score, surface_score): an entity's share of the popularity of its normalised name."""
    named = entities.withColumn("surface", normalise_name(F.col("name")))
    # summed and joined back, so that a common surface is not gathered in one task
    totals = named.groupBy("surface").agg(F.sum("score").alias("__total"))
    shared = named.join(totals, "surface", "left")
    return shared.withColumn("surface_score", F.when(F.col("__total") > 0, F.col("score") / F.col("__total")).otherwise(0.0)).drop("__total")


def candidates_for(spans_: DataFrame, surfaces: DataFrame, text: str = "span") -> DataFrame:
    """Join spans with the entities of their normalised surface."""
    # Spark takes exploded spans for as small as the file of their questions, and would send all of them through the driver
    keyed = spans_.withColumn("surface", normalise_name(F.col(text))).hint("merge")
    found = keyed.join(surfaces, "surface")
    return found.withColumn("perfect", is_main_name(F.col(text), F.col("name")))


def strict_or_lax(found: DataFrame, least: float = 0.1) -> DataFrame:
    """Mentions over the threshold; for a question without any, those over half of it, whatever their tags.

    ``found`` has q_id, surface_score and ``valid`` (the span is an entity occurrence).
    """
    strict = found.where(F.col("valid") & (F.col("surface_score") >= least))
    lax = found.where(F.col("surface_score") >= least / 2).join(strict.select("q_id").distinct(), "q_id", "left_anti")
    return strict.unionByName(lax)


def top_per_span(mentions: DataFrame, keys: list[str], order: list[Column], k: int = 3) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return mentions.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def years(questions: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(q_id, at, year) of tokens that start with four digits."""
    t = questions.select("q_id", F.posexplode(tokens).alias("at", "token"))
    return t.withColumn("year", year_of(F.col("token"))).where("year is not null").select("q_id", "at", "year")


def without_subsets(mentions: DataFrame) -> DataFrame:
    """Mentions without those inside another mention of the same entity name that scores higher.

    Mentions have q_id, name, tok_start, tok_end and score.
    """
    m, o = mentions.alias("m"), mentions.alias("o")
    inside = (F.col("m.tok_start") >= F.col("o.tok_start")) & (F.col("m.tok_end") <= F.col("o.tok_end"))
    shorter = F.col("m.tok_end") - F.col("m.tok_start") < F.col("o.tok_end") - F.col("o.tok_start")
    on = (F.col("m.q_id") == F.col("o.q_id")) & (F.col("m.name") == F.col("o.name")) & inside & shorter & (F.col("m.score") < F.col("o.score"))
    return m.join(o, on, "left_anti")


def overlapping(mentions: DataFrame) -> DataFrame:
    """(q_id, m_id, others): for every mention, the others of its question that share a token."""
    a = mentions.select("q_id", "m_id", "tok_start", "tok_end")
    b = mentions.select("q_id", F.col("m_id").alias("o_id"), F.col("tok_start").alias("s"), F.col("tok_end").alias("e"))
    pairs = a.join(b, "q_id").where((F.col("m_id") != F.col("o_id")) & (F.col("tok_start") < F.col("e")) & (F.col("s") < F.col("tok_end")))
    lists = pairs.groupBy("q_id", "m_id").agg(F.sort_array(F.collect_set("o_id")).alias("others"))
    return a.select("q_id", "m_id").join(lists, ["q_id", "m_id"], "left").withColumn("others", F.coalesce("others", F.array().cast("array<long>")))


def disjoint_pairs(mentions: DataFrame) -> DataFrame:
    """Pairs of mentions of a question that share no token, the earlier first."""
    a = mentions.select("q_id", F.col("m_id").alias("a"), F.col("tok_start").alias("as"), F.col("tok_end").alias("ae"))
    b = mentions.select("q_id", F.col("m_id").alias("b"), F.col("tok_start").alias("bs"), F.col("tok_end").alias("be"))
    return a.join(b, "q_id").where(F.col("ae") <= F.col("bs")).select("q_id", "a", "b")


def maximal_sets(overlaps: DataFrame) -> DataFrame:
    """(q_id, members): maximal sets of mentions of a question that do not overlap.

    A question has tens of mentions at most after ``top_per_span``; the sets of one are found in one group.
    """

    def run(rows: list[dict]) -> list[dict]:
        clash = {r["m_id"]: set(r["others"]) for r in rows}
        found: list[list[int]] = []

        def grow(chosen: set[int], open_: set[int], done: set[int]) -> None:
            if not open_ and not done:
                found.append(sorted(chosen))
            for v in sorted(open_):
                free = set(clash) - clash[v] - {v}
                grow(chosen | {v}, open_ & free, done & free)
                open_, done = open_ - {v}, done | {v}

        grow(set(), set(clash), set())
        return [{"q_id": rows[0]["q_id"], "members": members} for members in sorted(found)]

    schema = StructType([StructField("q_id", LongType()), StructField("members", ArrayType(LongType()))])
    return group_by_group(overlaps, "q_id", run, schema)


def entity_types(entities: DataFrame, types: DataFrame, denied: list[str], most: int = 10) -> DataFrame:
    """(id, types): types of an entity by how common they are, denied ones last; unknown without any."""
    counts = types.groupBy("type").agg(F.count("*").alias("n"))
    rank = F.when(F.col("type").isin(denied), F.lit(0)).otherwise(F.col("n"))
    ranked = types.join(counts, "type").select("id", F.struct((-rank).alias("r"), "type").alias("t"))
    lists = ranked.groupBy("id").agg(F.transform(F.slice(F.sort_array(F.collect_set("t")), 1, most), lambda t: t["type"]).alias("types"))
    return entities.join(lists, "id", "left").withColumn("types", F.coalesce("types", F.array(F.lit("UNK"))))


def text_entities(words: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(q_id, doc_id, score): texts that hold all words of a question, by how often they hold them.

    ``words`` has (doc_id, word, n), the n of several rows of a word added up; ``wanted`` has (q_id, word).
    """
    asked = written(wanted.distinct(), "asked-words")
    # words that no question has are dropped before texts are counted; what is left is counted and written once
    words = words.join(by_size(written(asked.select("word").distinct(), "wanted-words")), "word", "left_semi")
    words = written(words.groupBy("doc_id", "word").agg(F.sum("n").alias("n")), "words-of-texts")
    # only the texts with a question's rarest word are looked at; its other words are then looked up in these
    common = asked.join(words.groupBy("word").agg(F.count("*").alias("texts")), "word", "left")
    rare = common.groupBy("q_id").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "word"))["word"].alias("word"), F.count("*").alias("need"))
    tried = rare.join(words, "word").select("q_id", "need", "doc_id")
    hits = tried.join(asked, "q_id").join(words, ["doc_id", "word"]).groupBy("q_id", "doc_id", "need").agg(F.count("*").alias("held"), F.sum("n").alias("score"))
    full = hits.where("held = need")
    w = Window.partitionBy("q_id").orderBy(F.desc("score"), "doc_id")
    return full.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("q_id", "doc_id", "score", "place")


def enrich_with_text(mentions: DataFrame, texts: DataFrame) -> DataFrame:
    """Mentions whose entity a text query found score higher; ``texts`` has (q_id, id, text_score)."""
    last = texts.groupBy("q_id", "id").agg(F.max("text_score").alias("text_score"))
    hit = F.col("text_score").isNotNull()
    return (
        mentions.join(last, ["q_id", "id"], "left")
        .withColumn("score", F.when(hit, F.col("score") + F.col("text_score")).otherwise(F.col("score")))
        .withColumn("surface_score", F.when(hit, F.col("surface_score") * 10).otherwise(F.col("surface_score")))
        .withColumn("text_match", hit)
        .drop("text_score")
    )


def oracle_mentions(spans_: DataFrame, known: DataFrame) -> DataFrame:
    """(q_id, tok_start, tok_end, id, kind): spans whose text without spaces is a known mention (mention, ids)."""
    keyed = spans_.withColumn("mention", F.replace("span", F.lit(" "), F.lit("")))
    return keyed.join(known, "mention").select("q_id", "tok_start", "tok_end", F.explode("ids").alias("e")).select("q_id", "tok_start", "tok_end", "e.id", "e.kind")


def type_mode(types: DataFrame, key: str) -> DataFrame:
    """(key, dominant, second): the two commonest types of a key, equals in order of their names."""
    counts = types.groupBy(key, "type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "type"))
    top = counts.withColumn("place", place).where(F.col("place") <= 2)
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("type")))
    return top.groupBy(key).agg(at(1).alias("dominant"), at(2).alias("second"))


def neighbours(tokens: DataFrame, key: str = "q_id") -> DataFrame:
    """Each token (key, at, token) with the one and the two after it; null past the end."""
    w = Window.partitionBy(key).orderBy("at")
    return tokens.select(key, "at", "token", F.lead("token", 1).over(w).alias("next"), F.lead("token", 2).over(w).alias("after_next"))


def usable_questions(questions: DataFrame, gold: DataFrame) -> DataFrame:
    """Questions (q_id, text) that have a gold answer (q_id) and do not ask how many."""
    return questions.where(~F.lower("text").startswith("how many")).join(gold.select("q_id").distinct(), "q_id", "left_semi")


def names_to_ids(rows: DataFrame, known: DataFrame, unknown: str = "UNK") -> DataFrame:
    """Add the id of each ``name``; ``known`` has (name, id)."""
    return rows.join(known.select("name", "id"), "name", "left").withColumn("id", F.coalesce("id", F.lit(unknown)))


def boost_perfect(mentions: DataFrame, factor: int = 60) -> DataFrame:
    """Mentions whose text is the entity's main name count for more."""
    return mentions.withColumn("score", F.when(F.col("perfect"), F.col("score") * factor).otherwise(F.col("score")))
