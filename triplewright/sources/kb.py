"""Knowledge-graph views over the fixture tables.

The order is the mediator: an anonymous fact that joins one customer with many
parts and suppliers. Everything here is a lazy view; filters and column choices
of a query reach the Parquet scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.sources.staging import thinned, written

NAME = "type.object.name"
#: Relation to its reverse.
REVERSES = {
    "org.customer.nation": "geo.nation.customers",
    "org.supplier.nation": "geo.nation.suppliers",
    "geo.nation.region": "geo.region.nations",
    "trade.order.customer": "trade.customer.orders",
    "trade.order.part": "trade.part.orders",
    "trade.order.supplier": "trade.supplier.orders",
}
MEDIATOR_RELATIONS = ["trade.order.customer", "trade.order.part", "trade.order.supplier"]
#: Types that relations are declared to answer with.
EXPECTED_TYPES = {
    "org.customer.nation": "location.nation",
    "org.supplier.nation": "location.nation",
    "geo.nation.region": "location.region",
    "geo.nation.customers": "business.person",
    "geo.nation.suppliers": "business.organization",
    "geo.region.nations": "location.nation",
    "trade.order.date": "type.datetime",
    "trade.part.size": "type.int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _fact(df: DataFrame, s: Column, p: str, o: Column, kind: str = "entity") -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))


def triples(spark: SparkSession, sf_dir: str, reverse: bool = False) -> DataFrame:
    """(s, p, o, o_kind): every fact, and its reverse if asked for."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    edges = [
        (t["customer"], node("customer", "c_custkey"), "org.customer.nation", node("nation", "c_nationkey")),
        (t["supplier"], node("supplier", "s_suppkey"), "org.supplier.nation", node("nation", "s_nationkey")),
        (t["nation"], node("nation", "n_nationkey"), "geo.nation.region", node("region", "n_regionkey")),
        (t["orders"], node("orders", "o_orderkey"), "trade.order.customer", node("customer", "o_custkey")),
        (t["lineitem"], node("orders", "l_orderkey"), "trade.order.part", node("part", "l_partkey")),
        (t["lineitem"], node("orders", "l_orderkey"), "trade.order.supplier", node("supplier", "l_suppkey")),
    ]
    facts = [_fact(*e) for e in edges]
    if reverse:
        facts += [_fact(df, o, REVERSES[p], s) for df, s, p, o in edges]
    facts += [
        _fact(t["orders"], node("orders", "o_orderkey"), "trade.order.date", date, "value"),
        _fact(t["part"], node("part", "p_partkey"), "trade.part.size", F.col("p_size").cast("string"), "value"),
    ]
    facts += [
        _fact(t[n], node(n, k), NAME, F.col(c), "value")
        for n, k, c in (
            ("region", "r_regionkey", "r_name"),
            ("nation", "n_nationkey", "n_name"),
            ("customer", "c_custkey", "c_name"),
            ("supplier", "s_suppkey", "s_name"),
            ("part", "p_partkey", "p_name"),
        )
    ]
    return reduce(DataFrame.unionByName, facts)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, score): entities with their popularity, the number of lines or orders that they occur in."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part = line.groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("score"))
    supplier = line.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("score"))
    customer = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("score"))

    def scored(df: DataFrame, kind: str, key: str, name: str, counts: DataFrame | None) -> DataFrame:
        base = df.select(F.col(key).cast("long").alias("k"), F.col(name).alias("name"))
        base = base.join(counts, "k", "left") if counts is not None else base.withColumn("score", F.lit(1).cast("long"))
        return base.select(node(kind, "k").alias("id"), "name", F.coalesce("score", F.lit(0)).cast("long").alias("score"))

    return reduce(
        DataFrame.unionByName,
        [
            scored(table(spark, sf_dir, "region"), "region", "r_regionkey", "r_name", None),
            scored(table(spark, sf_dir, "nation"), "nation", "n_nationkey", "n_name", None),
            scored(table(spark, sf_dir, "customer"), "customer", "c_custkey", "c_name", customer),
            scored(table(spark, sf_dir, "supplier"), "supplier", "s_suppkey", "s_name", supplier),
            scored(table(spark, sf_dir, "part"), "part", "p_partkey", "p_name", part),
        ],
    )


def mediator_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, relation, mediator): postings of parts and suppliers, several relations to a value and mediator."""
    line = table(spark, sf_dir, "lineitem")
    part = line.select(
        node("part", "l_partkey").alias("value"), F.concat(F.lit("trade.order.part."), "l_returnflag").alias("relation"), node("orders", "l_orderkey").alias("mediator")
    )
    supplier = line.select(
        node("supplier", "l_suppkey").alias("value"), F.concat(F.lit("trade.order.supplier."), "l_linestatus").alias("relation"), node("orders", "l_orderkey").alias("mediator")
    )
    return part.unionByName(supplier)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, text, kind): questions made from names by fixed templates, the template chosen by the key."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_name").alias("name"))
    nation_text = (
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("where is "), "name"))
        .when(F.col("k") % 3 == 1, F.concat(F.lit("which region is "), "name", F.lit(" in")))
        .otherwise(F.concat(F.lit("how many customers has "), "name"))
    )
    part_text = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("who supplies "), "name"))
        .when(F.col("k") % 4 == 1, F.concat(F.lit("when was "), "name", F.lit(" ordered")))
        .when(F.col("k") % 4 == 2, F.concat(F.lit("how many orders has "), "name"))
        .otherwise(F.concat(F.lit("what year came "), "name"))
    )
    return nation.select("k", nation_text.alias("text"), F.lit("nation").alias("kind")).unionByName(
        part.select((F.col("k") + 1_000_000).alias("k"), part_text.alias("text"), F.lit("part").alias("kind"))
    ).withColumnRenamed("k", "q_id")


# Words of the question templates with their lemmas and tags; all other words are names.
LEXICON = {
    "which": ("which", "WDT"), "when": ("when", "WRB"), "where": ("where", "WRB"), "did": ("do", "VBD"), "is": ("be", "VBZ"),
    "send": ("send", "VB"), "order": ("order", "VB"), "parts": ("part", "NNS"), "to": ("to", "TO"), "from": ("from", "IN"),
}
#: (word and its part of speech, words derived from it)
DERIVATIONS = [("send.v", "supplier"), ("order.v", "orders")]
#: (relation, word, score): words that stand beside facts of a relation
CONTEXT_WORDS = [("trade.order.part", "send", 0.25), ("trade.order.date", "order", 0.5), ("trade.order.supplier", "send", 0.125)]


def trade_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_id, text, customer, supplier): a question for each customer that has ordered, most with a supplier of the first order as second name."""
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    # lines are put together by order before they are moved
    suppliers = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("l_suppkey"))
    first = orders.join(suppliers, "o_orderkey").groupBy(F.col("o_custkey").alias("c")).agg(F.min(F.struct("o_orderkey", "l_suppkey")).alias("f"))
    named = (
        first.select("c", F.col("f.l_suppkey").alias("s"))
        .join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_name"), "c")
        .join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), "s_name"), "s")
    )
    text = (
        F.when(F.col("c") % 3 == 0, F.concat(F.lit("which parts did "), "s_name", F.lit(" send to "), "c_name"))
        .when(F.col("c") % 3 == 1, F.concat(F.lit("when did "), "c_name", F.lit(" order from "), "s_name"))
        .otherwise(F.concat(F.lit("where is "), "c_name"))
    )
    return named.select(F.col("c").cast("long").alias("q_id"), text.alias("text"), node("customer", "c").alias("customer"), node("supplier", "s").alias("supplier"))


def trade_answers(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None) -> DataFrame:
    """(q_id, target): what the tables say, line by line: parts that the supplier delivered, days on which it was ordered from, the nation.

    ``asked`` are the questions, if they are staged. Orders of their customers meet them first, and only the lines of these orders
    and suppliers are moved.
    """
    asked = (trade_questions(spark, sf_dir) if asked is None else asked).select("q_id", "supplier")
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    wanted = asked.where("q_id % 3 != 2").join(orders.select(F.col("o_custkey").cast("long").alias("q_id"), "o_orderkey", "o_orderdate"), "q_id")
    wanted = written(wanted, "asked-orders")
    lines = line.select(F.col("l_orderkey").alias("o_orderkey"), node("supplier", "l_suppkey").alias("supplier"), "l_partkey")
    answer = F.when(F.col("q_id") % 3 == 0, node("part", "l_partkey")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    traded = wanted.join(thinned(lines, wanted, "o_orderkey", "supplier"), ["o_orderkey", "supplier"]).select("q_id", answer.alias("target"))
    lives = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("q_id"), node("nation", "c_nationkey").alias("target"))
    return traded.unionByName(lives.where("q_id % 3 = 2").join(asked.select("q_id"), "q_id")).distinct()


def tagged(questions: DataFrame) -> DataFrame:
    """Add ``tokens``, the (lemma, tag) of each word between spaces, by the lexicon."""
    entries = F.create_map(*[x for w, (lemma, tag) in LEXICON.items() for x in (F.lit(w), F.struct(F.lit(lemma).alias("lemma"), F.lit(tag).alias("tag")))])
    name = lambda w: F.struct(F.lower(w).alias("lemma"), F.lit("NNP").alias("tag"))
    return questions.withColumn("tokens", F.transform(F.split("text", " "), lambda w: F.coalesce(F.element_at(entries, F.lower(w)), name(w))))


def reverses(spark: SparkSession) -> DataFrame:
    """(relation, reverse), both ways."""
    rows = [*REVERSES.items(), *((b, a) for a, b in REVERSES.items())]
    return spark.createDataFrame(rows, "relation string, reverse string")
