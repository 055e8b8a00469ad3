"""Queries on relations over mediators, on context words of relations, and on generated questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import generated, matching, mediated
from triplewright.plans.base import Group
from triplewright.sources import kb

group = Group()

# The words of a source's documents are the context words of a relation, those of a source and language of a pair of relations.
_INDEX = """w as (select source as rel_a, lang as rel_b, unnest(string_split(text, ' ')) as word from documents where source is not null and lang is not null),
       cnt as (select rel_a, rel_b, word, count(*) as n from w group by all), tot as (select rel_a, rel_b, sum(n) as total from cnt group by all),
       idx as (select rel_a, rel_b, word, n / total::double as score from cnt join tot using (rel_a, rel_b))"""
_TURNS = """tok as (select conv_id * 1000 + turn as q_id, unnest(string_split(text, ' ')) as lemma from conversations where role = 'user')"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kb.table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return mediated.pair_word_shares(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("rel_a"), F.col("lang").alias("rel_b"), "text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("q_id", F.col("conv_id") * 1000 + F.col("turn"))


@group.query(
    "entity_pair_relations",
    """with p as (select o_custkey as q_id, max(l_suppkey) as supp from orders join lineitem on l_orderkey = o_orderkey group by 1)
       select q_id, 'trade.customer.orders' as reverse, 'trade.order.customer' as rel_a, 'trade.order.supplier' as rel_b from p""",
)
def entity_pair_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with one of their suppliers: the relations by which an order joins them."""
    orders, line = kb.table(spark, sf_dir, "orders"), kb.table(spark, sf_dir, "lineitem")
    pairs = orders.join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("q_id")).agg(F.max("l_suppkey").alias("supp"))
    pairs = pairs.select("q_id", kb.node("customer", "q_id").alias("start"), kb.node("supplier", "supp").alias("target"))
    facts = kb.triples(spark, sf_dir).where(F.col("p").isin(kb.MEDIATOR_RELATIONS))
    postings = facts.select(F.col("o").alias("value"), F.col("p").alias("relation"), F.col("s").alias("mediator"))
    return mediated.entity_pair_relations(postings, pairs, F.broadcast(kb.reverses(spark)))


@group.query(
    "mediated_matches",
    f"""with {_INDEX}, {_TURNS},
       ask as (select distinct conv_id * 1000 + turn as q_id, 'src' || (conv_id % 20) as rel_a, case turn when 0 then null when 2 then 'de' else 'xx' end as rel_b from conversations where role = 'user'),
       pr as (select q_id, rel_a, rel_b from ask where rel_b is not null union select q_id, rel_a, tot.rel_b from ask join tot using (rel_a) where ask.rel_b is null),
       tw as (select q_id, replace(lemma, '-', '_') as word from tok),
       h as (select q_id, rel_a, rel_b, count(*) as hits, sum(score) as score from pr join tw using (q_id) join idx using (rel_a, rel_b, word) where length(word) > 1 group by all)
       select q_id, rel_a, rel_b, coalesce(hits, 0) as hits, round(coalesce(score, 0), 9) as score from pr left join h using (q_id, rel_a, rel_b)""",
)
def mediated_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a user against pairs of relations: of the first turn the second relation is open, of later ones it is given."""
    turns = _turns(spark, sf_dir)
    rel_b = F.when(F.col("turn") == 0, F.lit(None)).when(F.col("turn") == 2, "de").otherwise("xx")
    asked = turns.select("q_id", F.concat(F.lit("src"), F.col("conv_id") % 20).alias("rel_a"), rel_b.alias("rel_b"))
    tokens = turns.select("q_id", F.explode(F.split("text", " ")).alias("lemma"))
    return mediated.mediated_match(asked, _index(spark, sf_dir), tokens).withColumn("score", F.round("score", 9))


@group.query(
    "context_word_matches",
    f"""with {_INDEX}, {_TURNS}, one as (select rel_a || '.' || rel_b as relation, word as lemma, score from idx)
       select q_id, relation, lemma, round(sum(score), 9) as score from tok join one using (lemma) group by q_id, relation, lemma""",
)
def context_word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a user against the context words of relations."""
    turns = _turns(spark, sf_dir)
    n = turns.agg(F.coalesce(F.sum(F.size(F.split("text", " "))), F.lit(0))).first()[0]
    tokens = turns.select("q_id", F.explode(F.split("text", " ")).alias("lemma"))
    words = _index(spark, sf_dir).select(F.concat("rel_a", F.lit("."), "rel_b").alias("relation"), "word", "score")
    return matching.match_by_context(words, tokens, n).withColumn("score", F.round("score", 9))


@group.query(
    "generated_questions",
    """with known as (select replace(n_name, '_', ' ') as name, 'nation:' || n_nationkey as id from nation where n_nationkey % 2 = 0
         union all select p_name, 'part:' || min(p_partkey) from part where p_size > 10 group by p_name)
       select p_partkey as q_id, 'who makes [' || coalesce(p.id, 'UNK') || '|' || replace(p_name, ' ', '_') || '] since [<VALUE>|the_year_1995]' as text,
         '[' || coalesce(n.id, 'UNK') || '|' || replace(n_name, ' ', '_') || ']' as answer
       from part join nation on n_nationkey = p_partkey % 25 left join known p on p.name = p_name left join known n on n.name = replace(n_name, '_', ' ')""",
)
def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with mentions in brackets, linked anew to the ids of the names that are known."""
    nation, part = kb.table(spark, sf_dir, "nation"), kb.table(spark, sf_dir, "part")
    known = nation.where("n_nationkey % 2 = 0").select(F.translate("n_name", "_", " ").alias("name"), kb.node("nation", "n_nationkey").alias("id"))
    parts = part.where("p_size > 10").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    known = known.unionByName(parts.select("name", kb.node("part", "k").alias("id")))
    text = F.concat(F.lit("who makes ["), F.translate("p_name", " ", "_"), F.lit("|Part|"), "p_name", F.lit("] since [1995|Year|the year 1995]"))
    answer = F.concat(F.lit("["), "n_name", F.lit("|Nation|"), "n_name", F.lit("]"))
    asked = part.join(nation, F.col("n_nationkey") == F.col("p_partkey") % 25).select(F.col("p_partkey").alias("q_id"), text.alias("text"), answer.alias("answer"))
    return generated.relinked(asked, known)
