"""Graph patterns over facts (s, p, o), mediator joins, and result handling.

E is a linked entity, R a relation, M a mediator and T the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplewright.sources.staging import dealt, thinned, written


def ert(facts: DataFrame, starts: DataFrame) -> DataFrame:
    """(E, r, ?0): ``starts`` has (q_id, entity, relation); returns distinct (q_id, target), never the start itself."""
    f = facts.select(F.col("s").alias("entity"), F.col("p").alias("relation"), F.col("o").alias("target"))
    found = starts.join(f, ["entity", "relation"])
    return found.where(F.col("target") != F.col("entity")).select("q_id", "target").distinct()


def ermrt(facts: DataFrame, starts: DataFrame) -> DataFrame:
    """(E, r1, ?0)(?0, r2, ?1): ``starts`` has (q_id, entity, r1, r2); r1 leads to the mediator."""
    first = facts.select(F.col("s").alias("entity"), F.col("p").alias("r1"), F.col("o").alias("mediator"))
    second = facts.select(F.col("s").alias("mediator"), F.col("p").alias("r2"), F.col("o").alias("target"))
    found = starts.join(first, ["entity", "r1"]).join(second, ["mediator", "r2"])
    return found.where(F.col("target") != F.col("entity")).select("q_id", "target").distinct()


def ermrert(facts: DataFrame, starts: DataFrame) -> DataFrame:
    """(E, r1, ?0)(?0, r2, E2)(?0, r3, ?1): ``starts`` has (q_id, entity, r1, other, r2, r3)."""
    first = facts.select(F.col("s").alias("entity"), F.col("p").alias("r1"), F.col("o").alias("mediator"))
    check = facts.select(F.col("s").alias("mediator"), F.col("p").alias("r2"), F.col("o").alias("other"))
    last = facts.select(F.col("s").alias("mediator"), F.col("p").alias("r3"), F.col("o").alias("target"))
    found = starts.join(first, ["entity", "r1"]).join(check, ["mediator", "r2", "other"], "left_semi").join(last, ["mediator", "r3"])
    return found.where((F.col("target") != F.col("entity")) & (F.col("target") != F.col("other"))).select("q_id", "target").distinct()


def with_names(rows: DataFrame, names: DataFrame, key: str = "target") -> DataFrame:
    """Add the optional name of ``key``; ``names`` has (id, name)."""
    return rows.join(names.select(F.col("id").alias(key), "name"), key, "left")


def zip_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mediators of two values, the k-th relation of one paired with the k-th of the other.

    Both sides are postings (value, relation, mediator). Within a value and
    mediator relations are numbered in order, so this is an equi-join on
    (mediator, number) and not a product of the relations.
    """
    w = Window.partitionBy("value", "mediator").orderBy("relation")

    def numbered(p: DataFrame, side: str) -> DataFrame:
        return p.withColumn("rn", F.row_number().over(w)).select(
            "mediator", "rn", F.col("value").alias(f"value_{side}"), F.col("relation").alias(f"relation_{side}")
        )

    return numbered(a, "a").join(numbered(b, "b"), ["mediator", "rn"])


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mediators of two values with every pair of relations."""
    x = a.select("mediator", F.col("value").alias("value_a"), F.col("relation").alias("relation_a"))
    return x.join(b.select("mediator", F.col("value").alias("value_b"), F.col("relation").alias("relation_b")), "mediator")


def with_posting(results: DataFrame, posting: DataFrame) -> DataFrame:
    """Results whose mediator another value holds too, with its relation as ``relation_c``."""
    return results.join(posting.select("mediator", F.col("value").alias("value_c"), F.col("relation").alias("relation_c")), "mediator")


def text_answer_ratio(results: DataFrame, texts: DataFrame) -> DataFrame:
    """(q_id, ratio): the share of a question's results (q_id, target) that a text query (q_id, id) found too."""
    found = texts.select("q_id", F.col("id").alias("target")).distinct().withColumn("hit", F.lit(1.0))
    return results.join(found, ["q_id", "target"], "left").groupBy("q_id").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("ratio"))


def marks(value: Column) -> list[Column]:
    """Two words of 64 bits with one bit set in each by a hash of ``value``."""
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(64)).cast("int")) for seed in (1, 2)]


def marked(held: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """Postings with ``marks``, the bits of all values of their mediator (in ``postings``, if these are only some of them).

    A value whose bits are missing is not held there, so most mediators are told apart beside a posting, without
    a look-up; the marks are of one size, however many values a mediator has. What they let through is to be looked up.
    """
    bits = marks(F.col("value"))
    of_all = (held if postings is None else postings).groupBy("mediator").agg(*[F.bit_or(b).alias(f"b{i}") for i, b in enumerate(bits)])
    return held.join(of_all.select("mediator", F.struct("b0", "b1").alias("marks")), "mediator")


def may_hold(bits: list[Column]) -> Column:
    """Whether the mediator of a marked posting has all these bits."""
    first, second = (F.col("marks")[f"b{i}"].bitwiseAND(b) == b for i, b in enumerate(bits))
    return first & second


def nway_intersection(postings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(q_id, mediator) where a mediator holds all values that ``wanted`` (q_id, value) names for a question.

    Only the postings of each question's rarest value are read out, and of these only the mediators whose marks have the
    other values; these are looked up there. Repeated postings are not made distinct before: only what is found is. Postings
    are thinned to the rarest values before they meet their marks, and to what is looked up before they are looked up.
    """
    held = postings.select("value", "mediator")
    sizes = held.groupBy("value").agg(F.count("*").alias("n"))
    named = wanted.select("q_id", "value").join(sizes, "value", "left").groupBy("q_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "value"))["value"].alias("value"), F.collect_set("value").alias("all"))
    asked = named.select("q_id", "value", F.array_except("all", F.array("value")).alias("values"))

    def bits(i: int) -> Column:
        return F.aggregate("values", F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(marks(v)[i])).alias(f"w{i}")

    asked = written(asked.select("*", bits(0), bits(1)), "asked-values")
    rare = marked(thinned(held, asked, "value"), held)
    open_ = asked.join(rare, "value").where(may_hold([F.col("w0"), F.col("w1")])).select("q_id", "mediator", "values", F.size("values").alias("need"))
    # repeated postings lie in one task, so what is written is about what is found
    open_ = written(open_, "open-mediators")
    alone = open_.where("need = 0").select("q_id", "mediator").distinct()
    checks = open_.where("need > 0").select("q_id", "mediator", "need", F.explode("values").alias("value"))
    checks = checks.join(thinned(held, checks, "value", "mediator"), ["value", "mediator"], "left_semi")
    whole = checks.groupBy("q_id", "mediator", "need").agg(F.count_distinct("value").alias("held")).where("held = need")
    return alone.unionByName(whole.select("q_id", "mediator"))


def relation_suggestions(facts: DataFrame, anchors: DataFrame, most: int = 300, rows: int | None = None) -> DataFrame:
    """(q_id, relation): relations that lead away from an anchor (q_id, entity), the first ``most`` in order.

    With the number of ``rows`` of the facts, facts and anchors are dealt by entity and what is found by question, to as many tasks as these need.
    """
    ways = facts.select(F.col("s").alias("entity"), F.col("p").alias("relation"))
    # dealt by entity, ways are made distinct where they lie
    ways = ways if rows is None else dealt(ways, rows, "entity").distinct()
    found = dealt(dealt(anchors, rows, "entity").join(ways, "entity").select("q_id", "relation"), rows, "q_id").distinct()
    good = found.where(~F.col("relation").startswith("http") & (F.col("relation") != "type.object.name") & ~F.col("relation").contains(".."))
    w = Window.partitionBy("q_id").orderBy("relation")
    return good.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def in_domains(relations: DataFrame, domains: list[str], reverses: DataFrame) -> DataFrame:
    """Relations whose domain, or whose reverse's domain, is wanted."""
    r = relations.join(reverses, "relation", "left")
    own = F.element_at(F.split("relation", r"\."), 1).isin(domains)
    return r.where(own | F.coalesce(F.element_at(F.split("reverse", r"\."), 1).isin(domains), F.lit(False))).drop("reverse")


def without_used(suggested: DataFrame, used: DataFrame, reverses: DataFrame, rows: int | None = None) -> DataFrame:
    """Suggestions (q_id, relation) that are not on the mediator already, nor the reverse of one that is.

    With a number of ``rows``, both sides are dealt to as many tasks as these need.
    """
    keys = ["q_id", "relation"]
    back = used.join(reverses, "relation").select("q_id", F.col("reverse").alias("relation"))
    taken = dealt(used.select(*keys).unionByName(back), rows, *keys).distinct()
    return dealt(suggested, rows, *keys).join(taken, keys, "left_anti")


def mediator_split(relations: DataFrame, mediators: DataFrame, mediated: bool) -> DataFrame:
    """Relations that lead to a mediator, or those that do not."""
    return relations.join(mediators, "relation", "left_semi" if mediated else "left_anti")


def result_count(results: DataFrame, questions: DataFrame) -> DataFrame:
    """(q_id, n): how many results a question has; a count question has at most one."""
    n = results.groupBy("q_id").agg(F.count("*").alias("n"))
    full = F.coalesce("n", F.lit(0).cast("long"))
    return questions.join(n, "q_id", "left").select("q_id", F.when(F.col("is_count"), F.least(F.lit(1).cast("long"), full)).otherwise(full).alias("n"))


def language_rows(rows: DataFrame, literals: Column, language: str = "en", dedup: bool = False) -> DataFrame:
    """A row once for every literal of it that has no language or the wanted one; rows with foreign literals only go.

    ``literals`` is an array of (value, lang); a row without literals stays once.
    """
    good = F.filter(literals, lambda x: x["lang"].isNull() | (x["lang"] == language))
    times = F.when(F.size(literals) == 0, 1).otherwise(F.size(good))
    held = rows.withColumn("__times", times).where("__times > 0")
    if dedup:
        return held.drop("__times")
    return held.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times")


def canonical_text(candidates: DataFrame) -> DataFrame:
    """Add ``graph``: the triples of a candidate (entity, rels, pattern, other) as one text."""
    r = lambda i: F.get("rels", i)
    return candidates.withColumn(
        "graph",
        F.when(F.col("pattern") == "ERT", F.concat_ws(" ", "entity", r(0), F.lit("?0")))
        .when(F.col("pattern") == "ERMRT", F.concat_ws(" ", "entity", r(0), F.lit("?0 . ?0"), r(1), F.lit("?1")))
        .otherwise(F.concat_ws(" ", "entity", r(0), F.lit("?0 . ?0"), r(1), "other", F.lit(". ?0"), r(2), F.lit("?1"))),
    )
