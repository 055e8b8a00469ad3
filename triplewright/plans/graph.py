"""Queries over the graph: patterns, mediators, suggestions, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import linking, matching, patterns
from triplewright.plans.base import Group
from triplewright.sources import kb

group = Group()


def answer_region_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link the nation that a question names, follow its region, add names and rank by surface score and popularity."""
    asked = kb.questions(spark, sf_dir).where("kind = 'nation' and text like 'which region is %'")
    tokens = asked.select("q_id", F.split("text", " ").alias("tokens"))
    surfaces = linking.surface_index(kb.entities(spark, sf_dir))
    found = linking.candidates_for(linking.spans(tokens), surfaces).where("surface_score >= 0.1")
    best = linking.top_per_span(found, ["q_id"], [F.desc("surface_score"), F.desc("score"), F.asc("id")], 1)
    starts = best.select("q_id", F.col("id").alias("entity"), F.lit("geo.nation.region").alias("relation"))
    facts = kb.triples(spark, sf_dir)
    names = facts.where(F.col("p") == kb.NAME).select(F.col("s").alias("id"), F.col("o").alias("name"))
    return patterns.with_names(patterns.ert(facts, starts), names).select("q_id", "target", "name")


@group.query(
    "ert_nation_region",
    """select n_nationkey::bigint as q_id, 'region:' || n_regionkey as target, r_name as name
       from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 = 1""",
)
def ert_nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_region_questions(spark, sf_dir)


@group.query(
    "ermrt_part_customers",
    """select distinct l_partkey as q_id, 'customer:' || o_custkey as target
       from lineitem join orders on l_orderkey = o_orderkey""",
)
def ermrt_part_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = kb.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("q_id"), kb.node("part", "p_partkey").alias("entity"), F.lit("trade.part.orders").alias("r1"), F.lit("trade.order.customer").alias("r2")
    )
    return patterns.ermrt(kb.triples(spark, sf_dir, reverse=True), starts)


@group.query(
    "ermrert_customer_part_suppliers",
    """with q as (select o_custkey as q_id, min(l_partkey) as part from orders join lineitem on l_orderkey = o_orderkey group by 1)
       select distinct q.q_id, 'supplier:' || s.l_suppkey as target
       from q join orders on o_custkey = q.q_id
       join lineitem p on p.l_orderkey = o_orderkey and p.l_partkey = q.part
       join lineitem s on s.l_orderkey = o_orderkey""",
)
def ermrert_customer_part_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, line = kb.table(spark, sf_dir, "orders"), kb.table(spark, sf_dir, "lineitem")
    first = orders.join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.min("l_partkey").alias("part"))
    starts = first.select(
        F.col("o_custkey").alias("q_id"),
        kb.node("customer", "o_custkey").alias("entity"),
        F.lit("trade.customer.orders").alias("r1"),
        kb.node("part", "part").alias("other"),
        F.lit("trade.order.part").alias("r2"),
        F.lit("trade.order.supplier").alias("r3"),
    )
    return patterns.ermrert(kb.triples(spark, sf_dir, reverse=True), starts)


_POSTINGS = """p as (select 'part:' || l_partkey as value, 'trade.order.part.' || l_returnflag as relation, 'orders:' || l_orderkey as mediator from lineitem),
       s as (select 'supplier:' || l_suppkey as value, 'trade.order.supplier.' || l_linestatus as relation, 'orders:' || l_orderkey as mediator from lineitem)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = kb.mediator_facts(spark, sf_dir)
    return facts.where(F.col("value").startswith("part:")), facts.where(F.col("value").startswith("supplier:"))


@group.query(
    "mediator_zip_intersection",
    f"""with {_POSTINGS},
       pn as (select *, row_number() over (partition by value, mediator order by relation) as rn from p),
       sn as (select *, row_number() over (partition by value, mediator order by relation) as rn from s)
       select pn.mediator, pn.value as value_a, pn.relation as relation_a, sn.value as value_b, sn.relation as relation_b
       from pn join sn on pn.mediator = sn.mediator and pn.rn = sn.rn""",
)
def mediator_zip_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.zip_intersection(*_sides(spark, sf_dir)).drop("rn")


@group.query(
    "mediator_plain_intersection",
    f"""with {_POSTINGS}
       select relation_a, relation_b, count(*) as n from (
         select p.mediator, p.relation as relation_a, s.relation as relation_b from p join s on p.mediator = s.mediator) group by 1, 2""",
)
def mediator_plain_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.intersection(*_sides(spark, sf_dir)).groupBy("relation_a", "relation_b").agg(F.count("*").alias("n"))


@group.query(
    "mediator_nway",
    f"""with {_POSTINGS}, posts as (select value, mediator from p union select value, mediator from s),
       first as (select l_orderkey, min(l_partkey) as a, max(l_partkey) as b, min(l_suppkey) as c from lineitem group by 1),
       wanted as (select l_orderkey as q_id, 'part:' || a as value from first union select l_orderkey, 'part:' || b from first
                  union select l_orderkey, 'supplier:' || c from first),
       need as (select q_id, count(*) as need from wanted group by 1)
       select w.q_id, posts.mediator from wanted w join posts on w.value = posts.value join need on need.q_id = w.q_id
       group by w.q_id, posts.mediator, need.need having count(*) = need.need""",
)
def mediator_nway(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = kb.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"), F.min("l_suppkey").alias("c"))
    values = F.explode(F.array(kb.node("part", "a"), kb.node("part", "b"), kb.node("supplier", "c")))
    return patterns.nway_intersection(kb.mediator_facts(spark, sf_dir), first.select(F.col("l_orderkey").alias("q_id"), values.alias("value")))


@group.query(
    "optional_names",
    """with f as (select l_orderkey, min(l_partkey) as part from lineitem group by 1)
       select o_orderkey as q_id, 'part:' || part as target, p_name as name
       from orders left join f on l_orderkey = o_orderkey left join part on p_partkey = part""",
)
def optional_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = kb.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("q_id")).agg(F.min("l_partkey").alias("part"))
    rows = kb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id")).join(first, "q_id", "left")
    names = kb.table(spark, sf_dir, "part").select(kb.node("part", "p_partkey").alias("id"), F.col("p_name").alias("name"))
    return patterns.with_names(rows.select("q_id", kb.node("part", "part").alias("target")), names).select("q_id", "target", "name")


@group.query(
    "relation_suggestions",
    """select c_custkey as q_id, unnest(['org.customer.nation', 'trade.customer.orders']) as relation from customer
       where c_custkey in (select o_custkey from orders)
       union all select c_custkey, 'org.customer.nation' from customer where c_custkey not in (select o_custkey from orders)""",
)
def relation_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = kb.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q_id"), kb.node("customer", "c_custkey").alias("entity"))
    return patterns.relation_suggestions(kb.triples(spark, sf_dir, reverse=True), anchors)


@group.query(
    "unused_suggestions",
    """select distinct o_orderkey as q_id, 'trade.order.supplier' as relation from orders join lineitem on l_orderkey = o_orderkey
       union all select distinct o_orderkey, 'trade.order.part' from orders join lineitem on l_orderkey = o_orderkey""",
)
def unused_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of an order that lead on, without the one that it was reached by (through its reverse)."""
    orders = kb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"))
    facts = kb.triples(spark, sf_dir)
    n = facts.count()
    found = patterns.relation_suggestions(facts, orders.select("q_id", kb.node("orders", "q_id").alias("entity")), rows=n)
    media = spark.createDataFrame([(m,) for m in kb.MEDIATOR_RELATIONS], "relation string")
    used = orders.select("q_id", F.lit("trade.customer.orders").alias("relation"))
    return patterns.without_used(patterns.mediator_split(found, F.broadcast(media), True), used, F.broadcast(kb.reverses(spark)), n).select("q_id", "relation")


@group.query(
    "count_query_answers",
    """with n as (select o_custkey as q_id, count(*) as n from orders group by 1)
       select c_custkey as q_id, case when c_custkey % 2 = 0 then least(1, coalesce(n, 0)) else coalesce(n, 0) end as n
       from customer left join n on q_id = c_custkey""",
)
def count_query_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = kb.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q_id"), (F.col("c_custkey") % 2 == 0).alias("is_count"))
    return patterns.result_count(kb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q_id")), asked)


@group.query(
    "language_filter_multiplicity",
    """select doc_id, case when lang = 'en' and doc_id % 2 = 0 then 2 else 1 end as copies from documents where lang = 'en' or doc_id % 2 = 0""",
)
def language_filter_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kb.table(spark, sf_dir, "documents").select("doc_id", "lang")
    tag = F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("xx"))
    literals = F.array(F.struct(F.lit("t").alias("value"), F.col("lang")), F.struct(F.lit("u").alias("value"), tag.alias("lang")))
    return patterns.language_rows(rows, literals).groupBy("doc_id").agg(F.count("*").cast("int").alias("copies"))


@group.query(
    "candidate_graph_text",
    """select o_orderkey as c_id, case o_orderkey % 3
         when 0 then 'customer:' || o_custkey || ' org.customer.nation ?0'
         when 1 then 'customer:' || o_custkey || ' trade.customer.orders ?0 . ?0 trade.order.part ?1'
         else 'customer:' || o_custkey || ' trade.customer.orders ?0 . ?0 trade.order.part part:1 . ?0 trade.order.supplier ?1' end as graph from orders""",
)
def candidate_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    r1, r2, r3 = F.lit("trade.customer.orders"), F.lit("trade.order.part"), F.lit("trade.order.supplier")
    rows = kb.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("c_id"),
        kb.node("customer", "o_custkey").alias("entity"),
        F.when(k == 0, "ERT").when(k == 1, "ERMRT").otherwise("ERMRERT").alias("pattern"),
        F.when(k == 0, F.array(F.lit("org.customer.nation"))).when(k == 1, F.array(r1, r2)).otherwise(F.array(r1, r2, r3)).alias("rels"),
        F.lit("part:1").alias("other"),
    )
    return patterns.canonical_text(rows).select("c_id", "graph")


@group.query(
    "mediated_index",
    """with m as (select o_orderkey as k, 'trade.order.customer' as p from orders union select o_orderkey, 'trade.order.date' from orders
         union select l_orderkey, 'trade.order.part' from lineitem union select l_orderkey, 'trade.order.supplier' from lineitem),
       pairs as (select a.p as rel_a, b.p as rel_b, count(*) as words from m a join m b on a.k = b.k and a.p < b.p group by 1, 2),
       back(relation, reverse) as (values ('trade.order.customer', 'trade.customer.orders'), ('trade.order.part', 'trade.part.orders'), ('trade.order.supplier', 'trade.supplier.orders'))
       select reverse as key, rel_b as target, words from pairs join back on rel_a = relation union all select reverse, rel_a, words from pairs join back on rel_b = relation""",
)
def mediated_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of relations of the same mediators, by how many mediators have both, under the reverse of either."""
    held = kb.triples(spark, sf_dir).where(F.col("s").startswith("orders:")).groupBy("s").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    # mediators are grouped by their sets of relations before pairs are made
    shapes = held.groupBy("ps").agg(F.count("*").alias("n"))
    first = shapes.select("ps", "n", F.posexplode("ps").alias("i", "rel_a"))
    pairs = first.select("rel_a", F.explode(F.slice("ps", F.col("i") + 2, F.size("ps"))).alias("rel_b"), "n").groupBy("rel_a", "rel_b").agg(F.sum("n").alias("words"))
    return matching.mediated_index(pairs, kb.reverses(spark))


@group.query(
    "posting_filter",
    f"""with {_POSTINGS}, c as (select 'customer:' || o_custkey as value, 'orders:' || o_orderkey as mediator from orders)
       select p.value as value_a, p.relation as relation_a, c.value as value_c from p join c using (mediator)""",
)
def posting_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, _ = _sides(spark, sf_dir)
    posting = kb.table(spark, sf_dir, "orders").select(kb.node("customer", "o_custkey").alias("value"), F.lit("trade.order.customer").alias("relation"), kb.node("orders", "o_orderkey").alias("mediator"))
    found = patterns.with_posting(parts.withColumnsRenamed({"value": "value_a", "relation": "relation_a"}), posting)
    return found.select("value_a", "relation_a", "value_c")


@group.query(
    "text_answer_ratio",
    """select l_orderkey as q_id, round(avg(case when l_partkey % 4 = 0 then 1.0::double else 0 end), 9) as ratio
       from (select distinct l_orderkey, l_partkey from lineitem) group by 1""",
)
def text_answer_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = kb.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.col("l_partkey").alias("target")).distinct()
    return patterns.text_answer_ratio(results, results.where("target % 4 = 0").withColumnRenamed("target", "id")).withColumn("ratio", F.round("ratio", 9))


@group.query(
    "domain_relations",
    """with r as (select 'org.customer.nation' as p, count(*) as n from customer union all select 'geo.nation.customers', count(*) from customer
         union all select 'org.supplier.nation', count(*) from supplier union all select 'geo.nation.suppliers', count(*) from supplier
         union all select 'geo.nation.region', count(*) from nation union all select 'geo.region.nations', count(*) from nation)
       select p as relation, n as facts from r where n > 0""",
)
def domain_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of the geographic domain, or whose reverse is of it."""
    found = kb.triples(spark, sf_dir, reverse=True).groupBy(F.col("p").alias("relation")).agg(F.count("*").alias("facts"))
    return patterns.in_domains(found, ["geo"], F.broadcast(kb.reverses(spark))).select("relation", "facts")
