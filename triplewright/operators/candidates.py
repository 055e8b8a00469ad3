"""Candidate queries from linked entities: every pattern that the facts around an entity allow.

A candidate has q_id, entity, pattern, rels (its relations in order) and, where
a second entity is bound, other. Relations are found by equi-joins on entity and
mediator and made distinct at once, so a candidate is as small as its relations,
however many facts stand behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.operators.patterns import mediator_split, relation_suggestions, without_used
from triplewright.sources.staging import by_size, written


def extend_with_variable(candidates: DataFrame, relations: DataFrame) -> DataFrame:
    """Append a relation and a fresh variable; ``relations`` has (q_id, entity, rels, relation), the rels it goes on from."""
    return candidates.join(relations, ["q_id", "entity", "rels"]).withColumn("rels", F.concat("rels", F.array("relation"))).drop("relation")


def extend_with_entity(candidates: DataFrame, bound: DataFrame) -> DataFrame:
    """Append a relation to a constant; ``bound`` has (q_id, entity, rels, relation, other)."""
    return extend_with_variable(candidates, bound)


def starts(linked: DataFrame) -> DataFrame:
    """A candidate without relations for every linked entity (q_id, entity)."""
    return linked.select("q_id", "entity").distinct().withColumn("rels", F.array().cast("array<string>"))


def one_hop(facts: DataFrame, linked: DataFrame, mediators: DataFrame, mediated: bool) -> DataFrame:
    """Candidates with one relation away from the entity, which leads to a mediator or does not."""
    keyed = by_size(written(linked.select(F.struct("q_id", "entity").alias("q_id"), "entity").distinct(), "keyed"))
    found = relation_suggestions(facts, keyed).select("q_id.q_id", "q_id.entity", "relation")
    kept = mediator_split(found, mediators, mediated).select("q_id", "entity", F.array().cast("array<string>").alias("rels"), "relation")
    return extend_with_variable(starts(linked), kept)


def _at_mediator(facts: DataFrame, first: DataFrame) -> DataFrame:
    """(q_id, entity, rels, mediator) of candidates whose one relation leads to mediators."""
    away = facts.select(F.col("s").alias("entity"), F.col("p").alias("r1"), F.col("o").alias("mediator"))
    return first.withColumn("r1", F.get("rels", 0)).join(away, ["entity", "r1"]).drop("r1")


def two_hops(facts: DataFrame, first: DataFrame, reverses: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Go on from mediators by each relation that is not the way back; ``near`` are the facts of the entities, if at hand."""
    leads = facts.select(F.col("s").alias("mediator"), F.col("p").alias("relation"))
    # written like all that meets the facts here, so that its size is known before they are moved
    at = by_size(written(_at_mediator(facts if near is None else near, first), "at-mediators"))
    found = written(at.join(leads, "mediator").select("q_id", "entity", "rels", "relation").distinct(), "from-mediators")
    key = F.struct("q_id", "entity", "rels")
    free = without_used(found.select(key.alias("q_id"), "relation"), first.select(key.alias("q_id"), F.get("rels", 0).alias("relation")), reverses)
    return extend_with_variable(first, free.select("q_id.*", "relation"))


def shared_mediator(facts: DataFrame, first: DataFrame, others: DataFrame, reverses: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Bind a second entity (q_id, other) at the mediator, then leave it by a relation that is not in use yet.

    ``near`` are the facts of the entities, if at hand. Mediators that hold both entities are written, so that the facts meet them once.
    """
    asked = others.select("q_id", "other").distinct()
    at = _at_mediator(facts if near is None else near, first).join(asked, "q_id").where("entity != other")
    check = facts.select(F.col("s").alias("mediator"), F.col("p").alias("relation"), F.col("o").alias("other"))
    both = at.join(check, ["mediator", "other"]).select("q_id", "entity", "other", F.concat("rels", F.array("relation")).alias("rels"), "mediator")
    both = written(both.distinct(), "shared-mediators")
    bound = both.select("q_id", "entity", "other", "rels").distinct()
    leads = facts.select(F.col("s").alias("mediator"), F.col("p").alias("relation"))
    found = by_size(both).join(leads, "mediator").select("q_id", "entity", "other", "rels", "relation").distinct()
    key = F.struct("q_id", "entity", "other", "rels")
    free = without_used(found.select(key.alias("q_id"), "relation"), bound.select(key.alias("q_id"), F.explode("rels").alias("relation")), reverses)
    return free.select("q_id.q_id", "q_id.entity", "q_id.other", F.concat("q_id.rels", F.array("relation")).alias("rels"))


def generate(facts: DataFrame, linked: DataFrame, mediators: DataFrame, reverses: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(q_id, entity, other, pattern, rels): the bag union of the candidates of all patterns.

    What leads away from an entity is found once for all questions that are linked to it; facts never meet questions.
    """
    none = F.lit(None).cast("string")
    asked = linked.select("q_id", "entity").distinct()
    keys, near = _near(facts, asked)
    first = by_size(written(one_hop(near, keys, mediators, True), "to-mediators"))
    alone = one_hop(near, keys, mediators, False).withColumn("pattern", F.lit("ERT")).unionByName(two_hops(facts, first, reverses, near).withColumn("pattern", F.lit("ERMRT")))
    out = asked.join(by_size(written(alone.drop("q_id"), "entity-candidates")), "entity").withColumn("other", none).select("q_id", "entity", "other", "pattern", "rels")
    if others is None:
        return out
    return out.unionByName(_bound(facts, asked, near, first, others, reverses))


def generate_bound(facts: DataFrame, linked: DataFrame, mediators: DataFrame, reverses: DataFrame, others: DataFrame) -> DataFrame:
    """The candidates of ``generate`` that bind a second entity, without the work of the other patterns."""
    asked = written(linked.select("q_id", "entity").distinct(), "linked")
    keys, near = _near(facts, asked)
    return _bound(facts, asked, near, by_size(written(one_hop(near, keys, mediators, True), "to-mediators")), others, reverses)


def _near(facts: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The linked entities, each as its own q_id, and the facts that lead away from them."""
    keys = written(asked.select(F.col("entity").alias("q_id"), "entity").distinct(), "linked-entities")
    return keys, written(facts.select("s", "p", "o").join(by_size(keys.select(F.col("entity").alias("s"))), "s", "left_semi"), "near-facts")


def _bound(facts: DataFrame, asked: DataFrame, near: DataFrame, first: DataFrame, others: DataFrame, reverses: DataFrame) -> DataFrame:
    """Candidates with a second entity; ``first`` are the ways to a mediator, found once for each entity."""
    ways = asked.join(first.drop("q_id"), "entity").select("q_id", "entity", "rels")
    both = shared_mediator(facts, ways, others, reverses, near).withColumn("pattern", F.lit("ERMRERT"))
    return both.select("q_id", "entity", "other", "pattern", "rels")
