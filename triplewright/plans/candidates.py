"""Queries that generate candidates from linked questions, choose one, and fetch its answers; and smaller steps around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import names
from triplewright.operators import candidates, linking, matching, metrics, patterns
from triplewright.operators.ranking import rank_by
from triplewright.plans.base import Group
from triplewright.plans.evaluation import _PRF, _sets, _size
from triplewright.plans.text import _CLASSES, _LINKED, _QUESTIONS, _classes
from triplewright.sources import kb
from triplewright.sources.staging import by_size, written

group = Group()

_TO_MEDIATOR = ["trade.customer.orders", "trade.part.orders", "trade.supplier.orders"]
_FACTS = """f as (select 'customer:' || c_custkey as s, 'org.customer.nation' as p, 'nation:' || c_nationkey as o from customer
         union all select 'nation:' || c_nationkey, 'geo.nation.customers', 'customer:' || c_custkey from customer
         union all select 'supplier:' || s_suppkey, 'org.supplier.nation', 'nation:' || s_nationkey from supplier
         union all select 'nation:' || s_nationkey, 'geo.nation.suppliers', 'supplier:' || s_suppkey from supplier
         union all select 'nation:' || n_nationkey, 'geo.nation.region', 'region:' || n_regionkey from nation
         union all select 'region:' || n_regionkey, 'geo.region.nations', 'nation:' || n_nationkey from nation
         union all select 'orders:' || o_orderkey, 'trade.order.customer', 'customer:' || o_custkey from orders
         union all select 'customer:' || o_custkey, 'trade.customer.orders', 'orders:' || o_orderkey from orders
         union all select 'orders:' || l_orderkey, 'trade.order.part', 'part:' || l_partkey from lineitem
         union all select 'part:' || l_partkey, 'trade.part.orders', 'orders:' || l_orderkey from lineitem
         union all select 'orders:' || l_orderkey, 'trade.order.supplier', 'supplier:' || l_suppkey from lineitem
         union all select 'supplier:' || l_suppkey, 'trade.supplier.orders', 'orders:' || l_orderkey from lineitem
         union all select 'orders:' || o_orderkey, 'trade.order.date', strftime(o_orderdate, '%Y-%m-%d') from orders
         union all select 'part:' || p_partkey, 'trade.part.size', p_size::varchar from part),
       back(there, here) as (values ('trade.customer.orders', 'trade.order.customer'), ('trade.part.orders', 'trade.order.part'), ('trade.supplier.orders', 'trade.order.supplier'))"""
_GENERATED = f"""{_LINKED}, {_FACTS}, l as (select distinct q_id, id, score from sp join surf using (surface)),
       best as (select q_id, id as entity from (select *, row_number() over (partition by q_id order by score desc, id) as n from l) where n = 1),
       cand as (select distinct q_id, entity, 'ERT' as pattern, p as rels from best join f on s = entity where p not in (select there from back)
         union all select distinct q_id, entity, 'ERMRT', a.p || ' ' || b.p from best join f a on a.s = entity join back on a.p = there join f b on b.s = a.o where b.p <> here)"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, entity): the best entity of each template question."""
    tokens = kb.questions(spark, sf_dir).select("q_id", F.split("text", " ").alias("tokens"))
    order = [F.desc("score"), F.asc("id")]
    surfaces = linking.top_per_span(linking.surface_index(kb.entities(spark, sf_dir)), ["surface"], order, 1).drop("place")
    found = linking.candidates_for(linking.spans(tokens), surfaces)
    return linking.top_per_span(found, ["q_id"], order, 1).select("q_id", F.col("id").alias("entity"))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = F.broadcast(spark.createDataFrame([(r,) for r in _TO_MEDIATOR], "relation string"))
    linked = written(_linked(spark, sf_dir), "linked")
    return candidates.generate(kb.triples(spark, sf_dir, reverse=True), linked, media, F.broadcast(kb.reverses(spark)))


@group.query("generated_candidates", f"with {_GENERATED} select q_id, entity, pattern, rels from cand")
def generated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _generated(spark, sf_dir).select("q_id", "entity", "pattern", F.array_join("rels", " ").alias("rels"))


@group.query(
    "two_entity_candidates",
    """with q as (select o_custkey as q_id, min(l_partkey) as part from orders join lineitem on l_orderkey = o_orderkey group by 1)
       select q_id, 'customer:' || q_id as entity, 'part:' || part as other, 'trade.customer.orders trade.order.part ' || r as rels
       from q, (values ('trade.order.supplier'), ('trade.order.date')) v(r)""",
)
def two_entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with one of their parts: all ways on from an order that both share."""
    orders, line = kb.table(spark, sf_dir, "orders"), kb.table(spark, sf_dir, "lineitem")
    pairs = orders.join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("q_id")).agg(F.min("l_partkey").alias("part"))
    media = F.broadcast(spark.createDataFrame([(r,) for r in _TO_MEDIATOR], "relation string"))
    pairs = written(pairs, "pairs")
    linked, others = pairs.select("q_id", kb.node("customer", "q_id").alias("entity")), pairs.select("q_id", kb.node("part", "part").alias("other"))
    found = candidates.generate_bound(kb.triples(spark, sf_dir, reverse=True), linked, media, F.broadcast(kb.reverses(spark)), others)
    return found.select("q_id", "entity", "other", F.array_join("rels", " ").alias("rels"))


@group.query(
    "answered_questions",
    f"""with {_GENERATED}, cw as (select distinct rels, unnest(string_split(regexp_replace(rels, '[. ]', ' ', 'g'), ' ')) as word from cand),
       tok as (select distinct q_id, unnest(string_split(lower(text), ' ')) as lemma from qs),
       hit as (select c.q_id, c.rels, count(distinct lemma) as hits from cand c join tok using (q_id) join cw on cw.rels = c.rels and starts_with(word, lemma) where length(lemma) > 1 group by 1, 2),
       ranked as (select c.*, coalesce(hits, 0) as hits, row_number() over (partition by c.q_id order by coalesce(hits, 0) desc, pattern, c.rels) as n from cand c left join hit using (q_id, rels)),
       best_cand as (select * from ranked where n = 1),
       ans as (select distinct best_cand.q_id, o as target from best_cand join f on s = entity and p = rels where pattern = 'ERT' and o <> entity
         union select distinct best_cand.q_id, b.o from best_cand join f a on a.s = entity and a.p = split_part(rels, ' ', 1) join f b on b.s = a.o and b.p = split_part(rels, ' ', 2) where pattern = 'ERMRT' and b.o <> entity)
       select q_id, rels, hits, count(target) as answers from best_cand left join ans using (q_id) group by 1, 2, 3""",
)
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from text to answers: link, generate candidates, match their relations with words, rank, fetch, count."""
    facts, found = kb.triples(spark, sf_dir, reverse=True), written(_generated(spark, sf_dir).withColumn("relation", F.array_join("rels", " ")), "generated")
    texts = found.select("relation", F.explode(F.split("relation", "[. ]")).alias("word")).distinct()
    tokens = kb.questions(spark, sf_dir).select("q_id", F.explode(F.split(F.lower("text"), " ")).alias("lemma")).distinct()
    hits = matching.match_by_prefix(texts, tokens).groupBy("q_id", "relation").agg(F.count("*").alias("hits"))
    scored = found.join(hits, ["q_id", "relation"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    top = written(rank_by(scored, [F.desc("hits"), F.asc("pattern"), F.asc("relation")]).where("rank = 1"), "first-candidates")
    # a candidate's answers are fetched and counted once for all questions that have it
    graphs = written(top.select(F.struct("entity", "relation").alias("q_id"), "entity", "pattern", "rels").distinct(), "first-graphs")
    near = written(facts.select("s", "p", "o").join(by_size(written(graphs.select(F.col("entity").alias("s")).distinct(), "starts")), "s", "left_semi"), "near-facts")
    media = written(near.where(F.col("p").isin(_TO_MEDIATOR)).select(F.col("o").alias("s")).distinct(), "mediators")
    around = written(facts.select("s", "p", "o").join(by_size(media), "s", "left_semi"), "mediator-facts").unionByName(near)
    one = patterns.ert(near, graphs.where("pattern = 'ERT'").select("q_id", "entity", F.get("rels", 0).alias("relation")))
    two = patterns.ermrt(around, graphs.where("pattern = 'ERMRT'").select("q_id", "entity", F.get("rels", 0).alias("r1"), F.get("rels", 1).alias("r2")))
    count = one.unionByName(two).groupBy("q_id").agg(F.count("*").alias("answers")).select("q_id.entity", "q_id.relation", "answers")
    return top.join(count, ["entity", "relation"], "left").select("q_id", F.col("relation").alias("rels"), "hits", F.coalesce("answers", F.lit(0)).cast("long").alias("answers"))


@group.query(
    "script_summary",
    f"""with {_PRF.format(empty=1)}, m as (select avg(precision) as p, avg(recall) as r, avg(f1) as f, sum((f1 = 1)::int) / count(*)::double as a from prf)
       select round(p, 9) as precision, round(r, 9) as recall, round(f, 9) as f1, round(a, 9) as accuracy, round(2 * p * r / (p + r), 9) as f1_of_means from m""",
)
def script_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.script_summary(metrics.scores(*_sets(spark, sf_dir), ["q_id"], empty_precision=1.0, rows=_size(spark, sf_dir)))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@group.query(
    "top_answer_classes",
    f"""with {_CLASSES}, r as (select *, row_number() over (partition by q_id order by prob desc, class) as place from cls) select q_id, class, prob from r where place <= 3""",
)
def top_answer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.top_per_span(_classes(spark, sf_dir), ["q_id"], [F.desc("prob"), F.asc("class")], 3).select("q_id", "class", "prob")


@group.query(
    "unmatched_tokens",
    f"""with {_QUESTIONS}, t as (select distinct q_id, unnest(string_split(text, ' ')) as w from qs) select q_id, w as token from t where w not in ('region', 'customers', 'orders')""",
)
def unmatched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a question that no relation matched."""
    asked = kb.questions(spark, sf_dir).select("q_id", F.split("text", " ").alias("tokens"))
    matched = F.array(*[F.lit(w) for w in ("region", "customers", "orders")])
    return asked.select("q_id", F.explode(F.array_except("tokens", matched)).alias("token"))


@group.query(
    "usable_questions",
    f"""with {_QUESTIONS}, g as (select distinct 1000000 + l_partkey as q_id from lineitem union select n_nationkey from nation)
       select q_id from qs where text not like 'how many%' and q_id in (select q_id from g)""",
)
def usable_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that have a gold answer and do not ask for a number."""
    line, nation = kb.table(spark, sf_dir, "lineitem"), kb.table(spark, sf_dir, "nation")
    gold = line.select((F.lit(1_000_000) + F.col("l_partkey")).cast("long").alias("q_id")).unionByName(nation.select(F.col("n_nationkey").cast("long").alias("q_id")))
    return linking.usable_questions(kb.questions(spark, sf_dir), gold).select("q_id")


@group.query(
    "names_to_ids",
    """with n as (select n_name as name, 'nation:' || n_nationkey as id from nation where n_nationkey % 2 = 0)
       select c_custkey, coalesce(id, 'UNK') as id from customer join nation on c_nationkey = n_nationkey left join n on name = n_name""",
)
def names_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = kb.table(spark, sf_dir, "nation")
    asked = kb.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    known = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), kb.node("nation", "n_nationkey").alias("id"))
    return linking.names_to_ids(asked, known).select("c_custkey", "id")


@group.query(
    "training_labels",
    """with c as (select o_custkey as q_id, o_orderkey as c_id, (o_orderkey % 5) / 4.0::double as f1, row_number() over (partition by o_custkey order by (o_orderkey % 5) desc, o_orderkey) as place from orders)
       select q_id, c_id, (f1 >= 0.8 or (place = 1 and f1 > 0))::int as label from c""",
)
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate is right if it is the best of its question or nearly so good."""
    rows = kb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q_id"), F.col("o_orderkey").alias("c_id"), ((F.col("o_orderkey") % 5) / F.lit(4.0)).alias("f1"))
    return metrics.training_labels(rows, 0.8).select("q_id", "c_id", "label")


@group.query(
    "boosted_mentions",
    """select p_partkey, case when p_partkey % 4 <> 3 then p_size * 60 else p_size end::bigint as score from part""",
)
def boosted_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("p_partkey") % 4 == 3, F.concat("p_name", F.lit(" x"))).otherwise(F.upper("p_name"))
    rows = kb.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("score"), names.is_main_name(shown, F.col("p_name")).alias("perfect"))
    return linking.boost_perfect(rows).select("p_partkey", F.col("score").cast("long").alias("score"))
