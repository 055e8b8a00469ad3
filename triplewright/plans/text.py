"""Queries over questions and texts: linking, answer types, relation words, n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from triplewright.functions import names, vectors
from triplewright.operators import features, linking, matching
from triplewright.plans.base import Group
from triplewright.sources import kb

group = Group()

_NORM = "translate(lower({0}), '!.,-_ ''', '')"
_ENTITIES = """counts as (select 'part:' || l_partkey as id, count(*) as score from lineitem group by 1
         union all select 'supplier:' || l_suppkey, count(*) from lineitem group by 1
         union all select 'customer:' || o_custkey, count(*) from orders group by 1
         union all select 'region:' || r_regionkey, 1 from region union all select 'nation:' || n_nationkey, 1 from nation),
       named as (select 'part:' || p_partkey as id, p_name as name from part union all select 'supplier:' || s_suppkey, s_name from supplier
         union all select 'customer:' || c_custkey, c_name from customer union all select 'region:' || r_regionkey, r_name from region
         union all select 'nation:' || n_nationkey, n_name from nation),
       ents as (select id, name, coalesce(score, 0) as score from named left join counts using (id))"""
_QUESTIONS = """qs as (select n_nationkey::bigint as q_id, case n_nationkey % 3 when 0 then 'where is ' || n_name when 1 then 'which region is ' || n_name || ' in'
           else 'how many customers has ' || n_name end as text from nation
         union all select p_partkey + 1000000, case p_partkey % 4 when 0 then 'who supplies ' || p_name when 1 then 'when was ' || p_name || ' ordered'
           when 2 then 'how many orders has ' || p_name else 'what year came ' || p_name end from part)"""


@group.query(
    "surface_candidates_top3",
    f"""with {_ENTITIES}, s as (select *, {_NORM.format("name")} as surface from ents),
       r as (select *, row_number() over (partition by surface order by score desc, id) as place from s)
       select surface, id, score, place from r where place <= 3""",
)
def surface_candidates_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linking.surface_index(kb.entities(spark, sf_dir))
    return linking.top_per_span(found, ["surface"], [F.desc("score"), F.asc("id")]).select("surface", "id", "score", F.col("place").cast("long").alias("place"))


@group.query(
    "perfect_match_names",
    """select p_partkey, (p_partkey % 4) <> 3 as same from part""",
)
def perfect_match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = kb.table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    shown = F.when(k == 0, F.concat(F.lit("The "), "p_name")).when(k == 1, F.upper("p_name")).when(k == 2, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" x")))
    name = F.when(k == 0, F.concat("p_name", F.lit(" #12"))).when(k == 1, F.concat("p_name", F.lit(" (part)"))).otherwise(F.col("p_name"))
    return part.select("p_partkey", names.is_main_name(shown, name).alias("same"))


@group.query(
    "name_scalars",
    """select p_partkey, regexp_replace(lower(p_name), '^the', '') as no_the,
         regexp_extract('trade.part.' || p_name, '[^.]+$') as suffix, 'trade' as domain,
         'http://rdf.freebase.com/ns/' || p_partkey as full_id, p_partkey::varchar as short_id,
         p_name as literal, 'm.' || p_partkey as url_id, levenshtein(lower(p_name), lower(p_brand))::int as distance,
         case p_partkey % 3 when 0 then p_name || '.n' when 1 then p_name || '.v' end as derivation, 4 as complexity
       from part""",
)
def name_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = kb.table(spark, sf_dir, "part")
    k, relation = F.col("p_partkey") % 3, F.concat(F.lit("trade.part."), "p_name")
    full = names.add_namespace(F.col("p_partkey").cast("string"))
    return part.select(
        "p_partkey",
        names.drop_the(F.lower("p_name")).alias("no_the"),
        names.relation_suffix(relation).alias("suffix"),
        names.relation_domain(relation).alias("domain"),
        full.alias("full_id"),
        names.remove_namespace(F.concat(F.lit("<"), full, F.lit(">"))).alias("short_id"),
        names.plain_literal(F.concat(F.lit('"'), "p_name", F.lit('"@en'))).alias("literal"),
        names.url_to_id(F.concat(F.lit("www.freebase.com/m/"), "p_partkey")).alias("url_id"),
        names.edit_distance(F.col("p_name"), F.col("p_brand")).alias("distance"),
        names.derivation_key(F.col("p_name"), F.when(k == 0, "NNS").when(k == 1, "VBD").otherwise("DT")).alias("derivation"),
        names.pattern_complexity(F.lit("ERMRERRT")).alias("complexity"),
    )


@group.query(
    "date_values",
    """select o_orderkey, year(o_orderdate)::int as y, month(o_orderdate)::int as m, day(o_orderdate)::int as d,
         case o_orderkey % 3 when 2 then o_orderkey::varchar else strftime(o_orderdate, '%Y-%m-%d') end as value, year(o_orderdate)::varchar as year
       from orders""",
)
def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = kb.table(spark, sf_dir, "orders")
    ymd, mdy = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "M/d/yyyy")
    k = F.col("o_orderkey") % 3
    shown = F.when(k == 0, ymd).otherwise(mdy)
    mixed = F.when(k == 2, F.col("o_orderkey").cast("string")).otherwise(shown)
    return orders.select("o_orderkey", names.date_parts(shown).alias("p"), names.comparable(mixed).alias("value"), names.year_of(ymd).alias("year")).select(
        "o_orderkey", "p.*", "value", "year"
    )


@group.query(
    "mention_span_explode",
    """with t as (select item_id, string_split(text, ' ') as w from benchmark),
       s as (select item_id, w, unnest(range(0, len(w))) as i from t), e as (select item_id, w, i, unnest(range(i + 1, least(len(w), i + 8) + 1)) as j from s)
       select item_id as q_id, i::int as tok_start, j::int as tok_end, array_to_string(w[i + 1 : j], ' ') as span from e""",
)
def mention_span_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.spans(kb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.split("text", " ").alias("tokens")))


_LINKED = f"""{_ENTITIES}, {_QUESTIONS}, surf as (select *, {_NORM.format("name")} as surface from ents),
       t as (select q_id, string_split(text, ' ') as w from qs), s as (select q_id, w, unnest(range(0, len(w))) as i from t),
       e as (select q_id, w, i, unnest(range(i + 1, least(len(w), i + 8) + 1)) as j from s),
       sp as (select q_id, i::int as tok_start, j::int as tok_end, {_NORM.format("array_to_string(w[i + 1 : j], ' ')")} as surface from e)"""


@group.query(
    "link_questions",
    f"""with {_LINKED}, l as (select q_id, tok_start, tok_end, id, score,
         row_number() over (partition by q_id, tok_start, tok_end order by score desc, id) as place from sp join surf using (surface))
       select q_id, tok_start, tok_end, id, score, place from l where place <= 3""",
)
def link_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a span has one surface, so the best three of a surface are those of each of its spans
    best = linking.top_per_span(linking.surface_index(kb.entities(spark, sf_dir)), ["surface"], [F.desc("score"), F.asc("id")], 3)
    tokens = kb.questions(spark, sf_dir).select("q_id", F.split("text", " ").alias("tokens"))
    return linking.candidates_for(linking.spans(tokens), best).select("q_id", "tok_start", "tok_end", "id", "score", F.col("place").cast("long").alias("place"))


@group.query(
    "strict_or_lax_mentions",
    """with m as (select o_custkey as q_id, o_orderkey as m_id, (o_orderkey % 10) / 40.0::double as surface_score, o_orderkey % 4 = 0 as valid from orders),
       strict as (select * from m where valid and surface_score >= 0.1)
       select q_id, m_id from strict union all select q_id, m_id from m where surface_score >= 0.05 and q_id not in (select q_id from strict)""",
)
def strict_or_lax_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = kb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("q_id"), k.alias("m_id"), ((k % 10) / F.lit(40.0)).alias("surface_score"), (k % 4 == 0).alias("valid")
    )
    return linking.strict_or_lax(found).select("q_id", "m_id")


# Mentions of synthetic questions: each customer's orders, placed by their keys.
_MENTIONS = """m as (select o_custkey as q_id, o_orderkey as m_id, 'n' || (o_orderkey % 3) as name, (o_orderkey % 7)::int as tok_start,
         (o_orderkey % 7 + 1 + o_orderkey % 4)::int as tok_end, (o_orderkey % 11)::double as score from orders)"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return kb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("q_id"),
        k.alias("m_id"),
        F.concat(F.lit("n"), k % 3).alias("name"),
        (k % 7).cast("int").alias("tok_start"),
        (k % 7 + 1 + k % 4).cast("int").alias("tok_end"),
        (k % 11).cast("double").alias("score"),
    )


@group.query(
    "mention_subset_antijoin",
    f"""with {_MENTIONS} select q_id, m_id from m where not exists (select 1 from m o where o.q_id = m.q_id and o.name = m.name and m.tok_start >= o.tok_start
         and m.tok_end <= o.tok_end and m.tok_end - m.tok_start < o.tok_end - o.tok_start and m.score < o.score)""",
)
def mention_subset_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.without_subsets(_mentions(spark, sf_dir)).select("q_id", "m_id")


@group.query(
    "overlapping_mentions",
    f"""with {_MENTIONS}, o as (select a.q_id, a.m_id, array_to_string(list_sort(list(b.m_id)), ',') as others from m a join m b
         on a.q_id = b.q_id and a.m_id <> b.m_id and a.tok_start < b.tok_end and b.tok_start < a.tok_end group by 1, 2)
       select m.q_id, m.m_id, coalesce(others, '') as others from m left join o using (q_id, m_id)""",
)
def overlapping_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linking.overlapping(_mentions(spark, sf_dir))
    return found.select("q_id", "m_id", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


@group.query(
    "disjoint_mention_pairs",
    f"""with {_MENTIONS} select a.q_id, a.m_id as a, b.m_id as b from m a join m b on a.q_id = b.q_id and a.tok_end <= b.tok_start""",
)
def disjoint_mention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.disjoint_pairs(_mentions(spark, sf_dir))


# a maximal set is a chain of mentions with no other mention before the first, between two neighbours or after the last
@group.query(
    "maximal_mention_sets",
    f"""with recursive {_MENTIONS}, first as (select * from m where not exists (select 1 from m k where k.q_id = m.q_id and k.tok_end <= m.tok_start)),
       next as (select a.m_id as a, b.m_id as b, b.tok_end from m a join m b on a.q_id = b.q_id and a.tok_end <= b.tok_start
         where not exists (select 1 from m k where k.q_id = a.q_id and a.tok_end <= k.tok_start and k.tok_end <= b.tok_start)),
       chain as (select q_id, m_id as last, tok_end, [m_id] as members from first
         union all select c.q_id, n.b, n.tok_end, list_append(c.members, n.b) from chain c join next n on n.a = c.last)
       select q_id, array_to_string(list_sort(members), ',') as members from chain c
       where not exists (select 1 from m k where k.q_id = c.q_id and c.tok_end <= k.tok_start)""",
)
def maximal_mention_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = linking.maximal_sets(linking.overlapping(_mentions(spark, sf_dir)))
    return sets.select("q_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@group.query(
    "entity_type_lists",
    """with t as (select 'part:' || p_partkey as id, unnest([p_type, p_brand]) as type from part), n as (select type, count(*) as n from t group by 1),
       r as (select distinct id, type, case when type in ('Brand#11', 'Brand#12') then 0 else n end as r from t join n using (type))
       select id, array_to_string(list(type order by r desc, type), ',') as types from r group by id""",
)
def entity_type_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = kb.table(spark, sf_dir, "part")
    ids = part.select(kb.node("part", "p_partkey").alias("id"))
    types = part.select(kb.node("part", "p_partkey").alias("id"), F.explode(F.array("p_type", "p_brand")).alias("type"))
    return linking.entity_types(ids, types, ["Brand#11", "Brand#12"]).select("id", F.array_join("types", ",").alias("types"))


_CLASSES = f"""{_QUESTIONS}, cls as (select q_id, unnest(case when text like 'how many%' then ['count'] when text like 'where%' then ['location', 'event', 'conference']
           when text like 'who%' then ['person', 'organization', 'employer', 'character'] when text like 'when%' or text like 'what year%' then ['date'] end) as class,
         unnest(case when text like 'how many%' then [1.0::double] when text like 'where%' then [0.7::double, 0.6, 0.6]
           when text like 'who%' then [0.7::double, 0.5, 0.4, 0.5] when text like 'when%' or text like 'what year%' then [0.99::double] end) as prob from qs)"""


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = kb.questions(spark, sf_dir).select("q_id", F.explode(names.answer_classes(F.col("text"))).alias("c"))
    return asked.select("q_id", "c.*")


@group.query("answer_type_heuristics", f"with {_CLASSES} select q_id, class, prob from cls")
def answer_type_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classes(spark, sf_dir)


@group.query(
    "answer_type_match",
    f"""with {_CLASSES}, rel as (select * from (values ('geo.nation.region', 'location.region', null), ('trade.order.date', 'type.datetime', null),
         ('trade.part.size', 'type.int', null), ('geo.nation.customers', 'business.person', ['x.employer'])) r(relation, expected, target_types)),
       c as (select * from qs cross join rel)
       select c.q_id, c.relation, round(sum(case when class = 'date' then case when expected = 'type.datetime' then prob else 0 end
         when class = 'count' then case when expected = 'type.int' then prob else 0 end
         when class is not null and (contains(regexp_extract(relation, '[^.]+$'), class) or case when target_types is not null
           then len(list_filter(target_types, lambda t: contains(t, class))) > 0 else contains(expected, class) end) then prob else 0 end), 9) as match
       from c left join cls using (q_id) group by 1, 2""",
)
def answer_type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("geo.nation.region", "location.region", None), ("trade.order.date", "type.datetime", None), ("trade.part.size", "type.int", None), ("geo.nation.customers", "business.person", ["x.employer"])]
    four = F.array(*[
        F.struct(F.lit(r).alias("relation"), F.lit(e).alias("expected"), (F.array(*[F.lit(x) for x in t]) if t else F.lit(None).cast("array<string>")).alias("target_types"))
        for r, e, t in rows
    ])
    asked = kb.questions(spark, sf_dir)
    relations = asked.select("q_id", F.explode(four).alias("r")).select("q_id", "r.*")
    found = matching.answer_type_match(_classes(spark, sf_dir), relations, len(rows) * asked.count())
    return found.withColumn("match", F.round("match", 9))


@group.query(
    "content_tokens",
    """with t as (select item_id as q_id, unnest(string_split(lower(text), ' ')) as w from benchmark)
       select q_id, count(*) as n from t where length(w) % 3 <> 0 and w not in ('be', 'do', 'go') group by 1""",
)
def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags follow from the length of a word here, as no tagger is at hand."""
    words = F.split(F.lower("text"), " ")
    tagged = F.transform(words, lambda w: F.struct(w.alias("lemma"), F.when(F.length(w) % 3 == 0, "DT").when(F.length(w) % 3 == 1, "NN").otherwise("VBD").alias("tag")))
    asked = kb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), tagged.alias("tokens"))
    return linking.content_tokens(asked).select("q_id", F.explode("content")).groupBy("q_id").agg(F.count("*").alias("n"))


_RELATIONS = "['org.customer.nation', 'geo.nation.region', 'trade.part.orders', 'trade.order.customer', 'geo.nation.customers', 'trade.order.order_date']"


@group.query(
    "relation_token_match",
    f"""with {_QUESTIONS}, rel as (select unnest({_RELATIONS}) as relation),
       words as (select distinct relation, unnest(string_split(replace(relation, '_', '.'), '.')) as word from rel),
       tok as (select distinct q_id, unnest(string_split(text, ' ')) as lemma from qs)
       select distinct q_id, relation, lemma from tok join words on starts_with(word, lemma) where length(lemma) > 1""",
)
def relation_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [(r,) for r in ("org.customer.nation", "geo.nation.region", "trade.part.orders", "trade.order.customer", "geo.nation.customers", "trade.order.order_date")]
    tokens = kb.questions(spark, sf_dir).select("q_id", F.explode(F.split("text", " ")).alias("lemma"))
    return matching.match_by_prefix(matching.relation_word_table(spark.createDataFrame(listed, "relation string")), tokens)


@group.query(
    "relation_derivations",
    f"""with {_QUESTIONS}, tok as (select distinct q_id, unnest(string_split(text, ' ')) as lemma from qs)
       select distinct q_id, relation, lemma from tok join (values ('supplies', 'trade.order.supplier'), ('ordered', 'trade.part.orders'),
         ('orders', 'trade.part.orders')) v(lemma, relation) using (lemma)""",
)
def relation_derivations(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = matching.relation_word_table(spark.createDataFrame([("trade.order.supplier",), ("trade.part.orders",)], "relation string"), 1)
    derived = spark.createDataFrame([("supplies.v", "supplier"), ("ordered.v", "orders"), ("orders.v", "orders"), ("orders.n", "nothing")], "word_pos string, word string")
    tokens = kb.questions(spark, sf_dir).select("q_id", F.explode(F.split("text", " ")).alias("lemma")).withColumn("tag", F.lit("VBZ"))
    return matching.match_by_derivation(words, tokens, derived)


@group.query(
    "embedding_synonyms",
    """with e as (select vec_id, vec_id // 10 as q_id, embedding::double[] as v from embeddings)
       select a.q_id, a.vec_id as a_id, b.vec_id as b_id from e a join e b on a.q_id = b.q_id and a.vec_id < b.vec_id
       where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) > 0.25""",
)
def embedding_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a question are ten neighbouring vectors."""
    e = kb.table(spark, sf_dir, "embeddings").withColumn("q_id", F.floor(F.col("vec_id") / 10))
    a = e.select("q_id", F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = e.select("q_id", F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return matching.match_by_vector(a.join(b, "q_id").where("a_id < b_id"), 0.25).select("q_id", "a_id", "b_id")


@group.query(
    "relation_word_scores",
    """with w as (select source as relation, unnest(string_split(lower(text), ' ')) as word from documents), n as (select relation, word, count(*)::double as n from w group by 1, 2),
       r as (select *, row_number() over (partition by relation order by n desc, word) - 1 as place from n), k as (select * from r where place < 50)
       select relation, word, place, round(n / sum(n) over (partition by relation), 9) as score from k""",
)
def relation_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = kb.table(spark, sf_dir, "documents").select(F.col("source").alias("relation"), F.explode(F.split(F.lower("text"), " ")).alias("word"))
    counts = words.groupBy("relation", "word").agg(F.count("*").cast("double").alias("score"))
    return matching.normalised_word_scores(counts, 50).withColumn("score", F.round("score", 9))


_TYPES = """ty as (select p_brand as relation, case when p_size % 5 = 0 then 'base.' || p_type else p_type end as type, count(*) as n from part group by 1, 2),
       tot as (select p_brand as relation, count(*) as total from part where p_brand <> 'Brand#11' group by 1)"""


def _types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = kb.table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("base."), "p_type")).otherwise(F.col("p_type"))
    types = part.groupBy(F.col("p_brand").alias("relation"), kind.alias("type")).agg(F.count("*").alias("n"))
    return types, part.where("p_brand != 'Brand#11'").groupBy(F.col("p_brand").alias("relation")).agg(F.count("*").alias("total"))


@group.query(
    "important_types",
    f"""with {_TYPES}, r as (select ty.*, total, row_number() over (partition by relation order by n desc, type) as place from ty left join tot using (relation))
       select relation, type from r where type not like 'base%' and case when total is not null then n > 900 or n / total::double >= 0.1 else place <= 10 end""",
)
def important_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.important_types(*_types(spark, sf_dir))


@group.query(
    "frequent_types",
    f"""with {_TYPES}, r as (select *, row_number() over (partition by relation order by n desc, type) as place from ty where type not like 'base%' and type not like 'user%' and n >= 2)
       select relation, type, n, place from r where place <= 5""",
)
def frequent_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.frequent_types(_types(spark, sf_dir)[0], 2, 5).withColumn("place", F.col("place").cast("long"))


@group.query(
    "text_entity_topk",
    """with w as (select doc_id, unnest(string_split(lower(text), ' ')) as word from documents), n as (select doc_id, word, count(*) as n from w group by 1, 2),
       q as (select distinct item_id as q_id, unnest(string_split(lower(text), ' ')) as word from benchmark), need as (select q_id, count(*) as need from q group by 1),
       h as (select q_id, doc_id, count(*) as held, sum(n)::bigint as score from q join n using (word) group by 1, 2),
       r as (select q_id, doc_id, score, row_number() over (partition by q_id order by score desc, doc_id) as place from h join need using (q_id) where held = need)
       select * from r where place <= 10""",
)
def text_entity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = kb.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word"), F.lit(1).cast("long").alias("n"))
    wanted = kb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return linking.text_entities(words, wanted, 10).withColumn("place", F.col("place").cast("long"))


@group.query(
    "ngram_features",
    """with t as (select item_id as q_id, list_prepend('<start>', string_split(lower(text), ' ')) as w from benchmark),
       b as (select q_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) as g from t union select q_id, unnest(w) from t)
       select distinct q_id, 'rel:a.b_c.d+word:' || g as feature from b
       where len(list_filter(string_split(g, '_'), lambda x: x not in ('the', 'of', 'and'))) > 0""",
)
def ngram_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = kb.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("q_id"),
        F.lit(1).alias("c_id"),
        F.array(F.lit("c.d"), F.lit("a.b")).alias("rels"),
        F.concat(F.array(F.lit("<start>")), F.split(F.lower("text"), " ")).alias("tokens"),
    )
    return features.ngram_features(asked, ["the", "of", "and"]).select("q_id", "feature")


def _shares(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = kb.table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").cast("double").alias("w"))
    whole = kb.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("double").alias("w"))
    langs = d.select("lang").distinct()
    return d, whole.join(langs)


_SHARES = """d as (select lang, source, count(*)::double as w from documents group by 1, 2), s as (select source, count(*)::double as w from documents group by 1),
       a as (select lang, s.source, s.w from s cross join (select distinct lang from d))"""


@group.query(
    "map_cosine",
    f"""with {_SHARES} select lang, round(sum(coalesce(d.w, 0) * a.w) / (sqrt(sum(coalesce(d.w, 0) * coalesce(d.w, 0))) * sqrt(sum(a.w * a.w))), 9) as cosine
       from a left join d using (lang, source) group by 1""",
)
def map_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.map_cosine(*_shares(spark, sf_dir), ["lang"], "source").withColumn("cosine", F.round("cosine", 9))


@group.query(
    "kl_divergence",
    f"""with {_SHARES}, f as (select lang, coalesce(d.w, 0) + 1 as p, a.w + 1 as q from a left join d using (lang, source)), t as (select lang, sum(p) as sp, sum(q) as sq from f group by 1)
       select lang, round(sum(p / sp * (ln(p / sp) - ln(q / sq))), 9) as kl from f join t using (lang) group by 1""",
)
def kl_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.kl_divergence(*_shares(spark, sf_dir), ["lang"], "source").withColumn("kl", F.round("kl", 9))


@group.query(
    "feature_difference",
    """with e as (select vec_id, embedding[1]::double as a, embedding[2]::double as b, embedding[3]::double as c from embeddings) select vec_id, round(a, 6) as x, round(b - c, 6) as y, round(-a, 6) as z from e""",
)
def feature_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    left = F.create_map(F.lit("x"), e[0], F.lit("y"), e[1])
    right = F.create_map(F.lit("y"), e[2], F.lit("z"), e[0])
    diff = vectors.feature_diff(left, right)
    return kb.table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(diff[k], 6).alias(k) for k in "xyz"])


@group.query(
    "event_properties",
    """select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value from events""",
)
def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = kb.table(spark, sf_dir, "events")
    return events.select("event_id", F.get(F.map_values(F.from_json("props", "map<string,string>")), 0).alias("first_value"))


@group.query(
    "oracle_spans",
    f"""with {_QUESTIONS}, t as (select q_id, string_split(text, ' ') as w from qs), s as (select q_id, w, unnest(range(0, len(w))) as i from t),
       e as (select q_id, w, i, unnest(range(i + 1, least(len(w), i + 8) + 1)) as j from s),
       k as (select distinct replace(n_name, ' ', '') as mention, 'nation:' || n_nationkey as id from nation)
       select q_id, i::int as tok_start, j::int as tok_end, id, 'entity' as kind from e join k on mention = array_to_string(w[i + 1 : j], '')""",
)
def oracle_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = kb.questions(spark, sf_dir).select("q_id", F.split("text", " ").alias("tokens"))
    nation = kb.table(spark, sf_dir, "nation")
    ids = F.array(F.struct(kb.node("nation", "n_nationkey").alias("id"), F.lit("entity").alias("kind")))
    known = nation.select(F.replace("n_name", F.lit(" "), F.lit("")).alias("mention"), ids.alias("ids"))
    return linking.oracle_mentions(linking.spans(tokens), known)


@group.query(
    "type_modes",
    """with n as (select p_brand, p_type as type, count(*) as n from part group by 1, 2),
       r as (select *, row_number() over (partition by p_brand order by n desc, type) as place from n)
       select p_brand, max(case when place = 1 then type end) as dominant, max(case when place = 2 then type end) as second from r group by 1""",
)
def type_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.type_mode(kb.table(spark, sf_dir, "part").select("p_brand", F.col("p_type").alias("type")), "p_brand")


@group.query(
    "token_neighbours",
    """with t as (select item_id as q_id, unnest(string_split(text, ' ')) as token, unnest(range(0, len(string_split(text, ' '))))::int as position from benchmark)
       select q_id, position, token, lead(token, 1) over w as next_token, lead(token, 2) over w as after_next from t window w as (partition by q_id order by position)""",
)
def token_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = kb.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q_id"), F.posexplode(F.split("text", " ")).alias("at", "token"))
    return linking.neighbours(tokens).withColumnsRenamed({"at": "position", "next": "next_token"})


@group.query(
    "question_years",
    """with t as (select event_id as q_id, strftime(ts, '%Y-%m-%d') as token from events) select q_id, 1 as position, token[1:4] as year from t""",
)
def question_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = kb.table(spark, sf_dir, "events").select(F.col("event_id").alias("q_id"), F.array(F.lit("in"), F.date_format("ts", "yyyy-MM-dd")).alias("tokens"))
    return linking.years(tokens).withColumnRenamed("at", "position")


@group.query(
    "text_enriched_mentions",
    f"""with {_MENTIONS} select q_id, m_id, case when m_id % 2 = 0 then score + 5 else score end as score, case when m_id % 2 = 0 then 0.2::double * 10 else 0.2::double end as surface_score,
         m_id % 2 = 0 as text_match from m""",
)
def text_enriched_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mentions(spark, sf_dir).withColumn("id", F.col("m_id")).withColumn("surface_score", F.lit(0.2))
    texts = m.where("m_id % 2 = 0").select("q_id", "id", F.lit(5.0).alias("text_score"))
    return linking.enrich_with_text(m, texts).select("q_id", "m_id", "score", "surface_score", "text_match")
