"""Queries over candidates: features, pruning, ranking, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import features, matching, models, ranking
from triplewright.plans.base import Group
from triplewright.sources import kb
from triplewright.sources.staging import dealt, written

group = Group()

# Candidates of synthetic questions: the orders of a customer, with values that follow from their keys.
_CANDS = """c as (select o_custkey as q_id, o_orderkey as c_id, case o_orderkey % 3 when 0 then 'ERT' when 1 then 'ERMRT' else 'ERMRERT' end as pattern,
         (o_orderkey % 3 + 1)::int as n_relations, (o_orderkey % 6 + 4)::int as n_tokens, (o_orderkey % 37 - 5)::int as r0, o_orderkey % 1000 as cardinality,
         (o_orderkey % 8) / 8.0::double as answer_match from orders), cands as (select *, greatest(r0, 0) as result_size from c)"""
_EMS = """ems as (select o_custkey as q_id, l_orderkey as c_id, (l_partkey % 3 + 1)::int as n_tokens, (l_suppkey % 16) / 16.0::double as surface_score,
         l_partkey % 7 = 0 as perfect, l_suppkey % 50 as popularity from lineitem join orders on o_orderkey = l_orderkey)"""
_RMS = """rms as (select o_custkey as q_id, l_orderkey as c_id, 'r' || (l_suppkey % 2) as relation, (l_linenumber % 5)::int as tok,
         case l_partkey % 4 when 0 then 'name' when 1 then 'word' when 2 then 'weak' else 'derivation' end as kind, (l_partkey % 32) / 32.0::double as score
         from lineitem join orders on o_orderkey = l_orderkey)"""


def _cands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return kb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("q_id"),
        k.alias("c_id"),
        F.when(k % 3 == 0, "ERT").when(k % 3 == 1, "ERMRT").otherwise("ERMRERT").alias("pattern"),
        (k % 3 + 1).cast("int").alias("n_relations"),
        (k % 6 + 4).cast("int").alias("n_tokens"),
        F.greatest(k % 37 - 5, F.lit(0)).cast("int").alias("result_size"),
        (k % 1000).alias("cardinality"),
        ((k % 8) / F.lit(8.0)).alias("answer_match"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = kb.table(spark, sf_dir, "lineitem")
    n = line.count()
    return dealt(line, n, "l_orderkey").join(dealt(kb.table(spark, sf_dir, "orders"), n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))


def _ems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("q_id"),
        F.col("l_orderkey").alias("c_id"),
        (F.col("l_partkey") % 3 + 1).cast("int").alias("n_tokens"),
        ((F.col("l_suppkey") % 16) / F.lit(16.0)).alias("surface_score"),
        (F.col("l_partkey") % 7 == 0).alias("perfect"),
        (F.col("l_suppkey") % 50).alias("popularity"),
    )


def _rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 4
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("q_id"),
        F.col("l_orderkey").alias("c_id"),
        F.concat(F.lit("r"), F.col("l_suppkey") % 2).alias("relation"),
        (F.col("l_linenumber") % 5).cast("int").alias("tok"),
        F.when(k == 0, "name").when(k == 1, "word").when(k == 2, "weak").otherwise("derivation").alias("kind"),
        ((F.col("l_partkey") % 32) / F.lit(32.0)).alias("score"),
    )


_COUNTS = [
    "n_literal_entities", "n_entity_matches", "n_literal_entity_tokens", "n_literal_relations", "n_literal_relation_tokens",
    "n_word_relation_tokens", "n_weak_relation_tokens", "n_derivation_relation_tokens", "n_total_literal_tokens", "cardinality",
]
_REALS = [
    "coverage", "matches_answer_type", "avg_em_surface_score", "sum_em_surface_score", "avg_em_popularity", "sum_em_popularity",
    "sum_weak_relation_tokens", "sum_context_relation_tokens",
]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.candidate_features(_cands(spark, sf_dir), _ems(spark, sf_dir), _rms(spark, sf_dir))


_FEATURES_SQL = f"""{_CANDS}, {_EMS}, {_RMS}, lit as (select *, perfect or surface_score > 0.8 as l, case when popularity > 0 then ln(popularity) else 0 end as pop from ems),
       e as (select q_id, c_id, sum(case when l then 1 else 0 end) as n_literal_entities, count(*) as n_entity_matches, sum(case when l then n_tokens else 0 end) as n_literal_entity_tokens,
         sum(n_tokens) as net, avg(surface_score) as avg_em_surface_score, sum(surface_score) as sum_em_surface_score, avg(pop) as avg_em_popularity, sum(pop) as sum_em_popularity from lit group by 1, 2),
       r as (select q_id, c_id, count(distinct case when kind = 'name' then relation end) as n_literal_relations, count(distinct case when kind = 'name' then tok end) as n_literal_relation_tokens,
         count(distinct case when kind = 'word' then tok end) as n_word_relation_tokens, count(distinct case when kind = 'weak' then tok end) as n_weak_relation_tokens,
         sum(case when kind = 'derivation' then 1 else 0 end) as n_derivation_relation_tokens, sum(case when kind = 'weak' then score else 0 end) as sum_weak_relation_tokens,
         sum(case when kind = 'word' then score else 0 end) as sum_context_relation_tokens, count(distinct tok) as nrt from rms group by 1, 2),
       f as (select c.q_id, c.c_id, (length(pattern) - length(replace(pattern, 'R', '')))::int as pattern_complexity, (coalesce(nrt, 0) + coalesce(net, 0)) / n_tokens::double as coverage,
         answer_match as matches_answer_type, (result_size = 0)::int as result_size_0, (result_size > 0 and result_size < 20)::int as result_size_1_to_20, (result_size >= 20)::int as result_size_gte_20,
         coalesce(n_literal_entity_tokens, 0) + coalesce(n_literal_relation_tokens, 0) as n_total_literal_tokens, coalesce(n_literal_entities, 0) as n_literal_entities,
         coalesce(n_entity_matches, 0) as n_entity_matches, coalesce(n_literal_entity_tokens, 0) as n_literal_entity_tokens, coalesce(avg_em_surface_score, 0) as avg_em_surface_score,
         coalesce(sum_em_surface_score, 0) as sum_em_surface_score, coalesce(avg_em_popularity, 0) as avg_em_popularity, coalesce(sum_em_popularity, 0) as sum_em_popularity,
         coalesce(n_literal_relations, 0) as n_literal_relations, coalesce(n_literal_relation_tokens, 0) as n_literal_relation_tokens, coalesce(n_word_relation_tokens, 0) as n_word_relation_tokens,
         coalesce(n_weak_relation_tokens, 0) as n_weak_relation_tokens, coalesce(n_derivation_relation_tokens, 0) as n_derivation_relation_tokens,
         coalesce(sum_weak_relation_tokens, 0) as sum_weak_relation_tokens, coalesce(sum_context_relation_tokens, 0) as sum_context_relation_tokens, n_relations,
         case when cardinality > 0 then floor(ln(cardinality)) else cardinality end as cardinality
         from cands c left join e using (q_id, c_id) left join r using (q_id, c_id))"""


@group.query(
    "candidate_features",
    f"""with {_FEATURES_SQL} select q_id, c_id, pattern_complexity, result_size_0, result_size_1_to_20, result_size_gte_20, n_relations,
         {", ".join(f"{c}::bigint as {c}" for c in _COUNTS)}, {", ".join(f"round({c}, 9) as {c}" for c in _REALS)} from f""",
)
def candidate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _features(spark, sf_dir)
    return found.select(
        "q_id", "c_id", "pattern_complexity", "result_size_0", "result_size_1_to_20", "result_size_gte_20", "n_relations",
        *[F.col(c).cast("long").alias(c) for c in _COUNTS], *[F.round(c, 9).alias(c) for c in _REALS],
    )


@group.query(
    "rank_simple",
    f"""with {_EMS}, {_RMS}, e as (select q_id, c_id, sum(surface_score * n_tokens) as ent from ems group by 1, 2),
       b as (select q_id, c_id, tok, max(case kind when 'name' then 0.3::double when 'word' then score else score * 0.1::double end) as best from rms where kind in ('name', 'word', 'weak') group by 1, 2, 3),
       r as (select q_id, c_id, sum(best) as rel from b group by 1, 2),
       s as (select q_id, c_id, round(coalesce(ent, 0) + coalesce(rel, 0) * 3, 9) as score from e full join r using (q_id, c_id))
       select q_id, c_id, score, row_number() over (partition by q_id order by score desc, c_id) as rank from s""",
)
def rank_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 2 * kb.table(spark, sf_dir, "lineitem").count()
    scored = ranking.simple_score(_ems(spark, sf_dir), _rms(spark, sf_dir), n).withColumn("score", F.round("score", 9))
    return ranking.rank_by(scored, [F.desc("score"), F.asc("c_id")]).withColumn("rank", F.col("rank").cast("long"))


_LITERAL = """l as (select o_custkey as q_id, o_orderkey as c_id, (o_orderkey % 3)::int as ent_lit, (o_orderkey % 4)::int as rel_lit, o_orderkey % 5 = 0 as is_mediator,
         (o_orderkey % 3)::int as coverage, (o_orderkey % 3 + o_orderkey % 2)::int as cover_card, (o_orderkey % 16) / 16.0::double as entity_score, (o_orderkey % 8) / 8.0::double as relation_score,
         o_orderkey % 13 as popularity, (o_orderkey % 17)::int as rel_length, (o_orderkey % 19)::int as rel_card, (o_orderkey % 23)::int as result_size from orders)"""


def _literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    mod = lambda n: (k % n).cast("int")
    return kb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("q_id"), k.alias("c_id"), mod(3).alias("ent_lit"), mod(4).alias("rel_lit"), (k % 5 == 0).alias("is_mediator"), mod(3).alias("coverage"),
        (k % 3 + k % 2).cast("int").alias("cover_card"), ((k % 16) / F.lit(16.0)).alias("entity_score"), ((k % 8) / F.lit(8.0)).alias("relation_score"),
        (k % 13).alias("popularity"), mod(17).alias("rel_length"), mod(19).alias("rel_card"), mod(23).alias("result_size"),
    )


@group.query(
    "rank_literal",
    f"""with {_LITERAL}, k as (select *, least(rel_lit, 1) as rl, entity_score + 3 * relation_score as sc, case when is_mediator then 0 else 1 end as plain from l)
       select q_id, c_id, row_number() over (partition by q_id order by ent_lit + rl + coverage desc, ent_lit + rl desc, coverage desc, cover_card - coverage desc,
         case when ent_lit + rl > 0 then popularity::double else sc end desc, case when ent_lit + rl > 0 then plain::double else popularity::double end desc,
         case when ent_lit + rl > 0 then sc else plain::double end desc, case when is_mediator then rel_card else -rel_length end desc,
         case when is_mediator then -rel_length else rel_card end desc, result_size desc, c_id) as rank from k""",
)
def rank_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_by(_literal(spark, sf_dir), ranking.literal_order()).select("q_id", "c_id", F.col("rank").cast("long").alias("rank"))


def literal_before(x: dict, y: dict) -> float:
    """The pairwise comparison: above 0 if ``x`` comes first. Relation matches are clamped only between unlike kinds."""
    xr, yr = x["rel_lit"], y["rel_lit"]
    if x["is_mediator"] != y["is_mediator"]:
        xr, yr = min(xr, 1), min(yr, 1)

    def weak(c: dict) -> int:
        return c["cover_card"] - c["coverage"]

    firsts = (
        (x["ent_lit"] + xr + x["coverage"], y["ent_lit"] + yr + y["coverage"]),
        (x["ent_lit"] + xr, y["ent_lit"] + yr),
        (x["coverage"], y["coverage"]),
        (weak(x), weak(y)),
    )
    for a, b in firsts:
        if a != b:
            return a - b
    pop_first = x["ent_lit"] == y["ent_lit"] and xr == yr and (x["ent_lit"] >= 1 or xr >= 1)

    def key(c: dict) -> tuple:
        score, plain = c["entity_score"] + 3 * c["relation_score"], not c["is_mediator"]
        length = (-c["rel_length"], c["rel_card"])
        head = (c["popularity"], plain, score) if pop_first else (score, c["popularity"], plain)
        return (*head, *(length[::-1] if c["is_mediator"] else length), c["result_size"])

    return -1 if key(x) < key(y) else 1


def literal_first(x: Column, y: Column) -> Column:
    """``literal_before`` as an expression: whether ``x`` comes first."""
    unlike = x["is_mediator"] != y["is_mediator"]

    def kept(c: Column) -> Column:
        return F.when(unlike, F.least(c["rel_lit"], F.lit(1))).otherwise(c["rel_lit"])

    def firsts(c: Column) -> Column:
        literal = c["ent_lit"] + kept(c)
        return F.array(literal + c["coverage"], literal, c["coverage"], c["cover_card"] - c["coverage"])

    some = (x["ent_lit"] == y["ent_lit"]) & (kept(x) == kept(y)) & ((x["ent_lit"] >= 1) | (kept(x) >= 1))

    def key(c: Column) -> Column:
        score, plain = c["entity_score"] + 3 * c["relation_score"], F.when(c["is_mediator"], 0.0).otherwise(1.0)
        pop, length, card = c["popularity"].cast("double"), -c["rel_length"].cast("double"), c["rel_card"].cast("double")
        return F.array(
            F.when(some, pop).otherwise(score),
            F.when(some, plain).otherwise(pop),
            F.when(some, score).otherwise(plain),
            F.when(c["is_mediator"], card).otherwise(length),
            F.when(c["is_mediator"], length).otherwise(card),
            c["result_size"].cast("double"),
        )

    return F.when(firsts(x) != firsts(y), firsts(x) > firsts(y)).otherwise(key(x) >= key(y))


def _sql_firsts(c: str) -> str:
    lit = f"{c}.ent_lit + case when x.is_mediator <> y.is_mediator then least({c}.rel_lit, 1) else {c}.rel_lit end"
    return f"[{lit} + {c}.coverage, {lit}, {c}.coverage, {c}.cover_card - {c}.coverage]"


def _sql_key(c: str) -> str:
    kept = "case when x.is_mediator <> y.is_mediator then least({0}.rel_lit, 1) else {0}.rel_lit end"
    some = f"x.ent_lit = y.ent_lit and {kept.format('x')} = {kept.format('y')} and (x.ent_lit >= 1 or {kept.format('x')} >= 1)"
    score, plain, pop = f"{c}.entity_score + 3 * {c}.relation_score", f"(not {c}.is_mediator)::int::double", f"{c}.popularity::double"
    length, card, mediator = f"(-{c}.rel_length)::double", f"{c}.rel_card::double", f"{c}.is_mediator"
    return f"""[case when {some} then {pop} else {score} end, case when {some} then {plain} else {pop} end, case when {some} then {score} else {plain} end,
         case when {mediator} then {card} else {length} end, case when {mediator} then {length} else {card} end, {c}.result_size::double]"""


@group.query("rank_literal_exact")
def rank_literal_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_with_comparator(_literal(spark, sf_dir), literal_before).select("q_id", "c_id", "rank")


@group.query(
    "rank_literal_inserted",
    f"""with recursive {_LITERAL}, i as (select q_id, list(l order by c_id) as items from l group by 1),
       s as (select q_id, 1 as k, items, items[1:1] as done from i
         union all select q_id, k + 1, items, case when pos = 0 then list_append(done, x) else list_concat(list_append(done[1:pos - 1], x), done[pos:len(done)]) end
         from (select q_id, k, items, done, x, coalesce(list_position(list_transform(done, lambda y: case when {_sql_firsts("x")} <> {_sql_firsts("y")}
             then {_sql_firsts("x")} > {_sql_firsts("y")} else {_sql_key("x")} >= {_sql_key("y")} end), true), 0) as pos
           from (select *, items[k + 1] as x from s where k < len(items)) as n) as p)
       select q_id, u.c_id as c_id, rank::int as rank from (select q_id, unnest(done) as u, generate_subscripts(done, 1) as rank from s where k = len(items)) as d""",
)
def rank_literal_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_by_insertion(_literal(spark, sf_dir), literal_first)


@group.query(
    "candidate_pairs",
    f"""with {_CANDS} select a.q_id, a.c_id as c_id_a, b.c_id as c_id_b, a.result_size - b.result_size as result_size_diff, a.result_size as result_size_a, b.result_size as result_size_b
       from cands a join cands b on a.q_id = b.q_id and a.c_id < b.c_id where a.result_size > 0 and b.result_size > 0""",
)
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _cands(spark, sf_dir).where("result_size > 0").select("q_id", "c_id", "result_size")
    return ranking.pair_features(ranking.candidate_pairs(kept), ["result_size"])


@group.query(
    "rank_by_wins",
    f"""with {_CANDS}, w as (select a.q_id, a.c_id as x, b.c_id as y, (a.cardinality * 7 + b.cardinality) % 10 > 4 as first from cands a join cands b on a.q_id = b.q_id and a.c_id < b.c_id),
       t as (select q_id, x as c_id, first::int as won from w union all select q_id, y, (not first)::int from w), s as (select q_id, c_id, sum(won) as wins from t group by 1, 2)
       select q_id, c_id, coalesce(wins, 0)::bigint as wins, row_number() over (partition by q_id order by coalesce(wins, 0) desc, c_id) as rank from cands left join s using (q_id, c_id)""",
)
def rank_by_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _cands(spark, sf_dir).select("q_id", "c_id", "cardinality")
    p = ((F.col("cardinality_a") * 7 + F.col("cardinality_b")) % 10) / F.lit(9.0)
    won = ranking.candidate_pairs(kept).withColumn("p_a", p)
    return ranking.rank_by_wins(kept.select("q_id", "c_id"), won).select("q_id", "c_id", "wins", F.col("rank").cast("long").alias("rank"))


@group.query(
    "class_weights",
    """with c as (select count(*) as n, sum(quality) as pos from labels), i as (select n / pos as p, n / (n - pos) as q from c)
       select 1 as label, round(p / (p + q) * 1.5, 9) as weight from i union all select 0, round(q / (p + q), 9) from i""",
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.class_weights(kb.table(spark, sf_dir, "labels"), "quality").withColumn("weight", F.round("weight", 9))


@group.query(
    "top_candidates",
    f"""with {_CANDS}, r as (select q_id, c_id, row_number() over (partition by q_id order by result_size desc, c_id) as rank from cands) select * from r where rank <= 5""",
)
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.rank_by(_cands(spark, sf_dir), [F.desc("result_size"), F.asc("c_id")], 5)
    return top.select("q_id", "c_id", F.col("rank").cast("long").alias("rank"))


@group.query(
    "fallback_relations",
    f"""with {_CANDS}, r as (select q_id, pattern as relation, sum(cardinality) as objects from cands group by 1, 2)
       select q_id, arg_max(relation, objects * 10 + length(relation)) as relation from r group by 1""",
)
def fallback_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _cands(spark, sf_dir).groupBy("q_id", F.col("pattern").alias("relation")).agg(F.sum("cardinality").alias("objects"))
    return matching.fallback_relation(r.withColumn("objects", F.col("objects") * 10 + F.length("relation")))


_WRONG = 200  # wrong candidates that a question gives to the training pairs at most
_SHUFFLED = "('0x' || substr(md5({} || ':999'), 1, 8))::bigint"


@group.query(
    "fold_sizes",
    f"""with {_CANDS}, f as (select distinct q_id, ({_SHUFFLED.format("q_id")} % 6)::int as fold from cands) select fold, count(*) as n from f group by 1""",
)
def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.folds(_cands(spark, sf_dir).select("q_id").distinct(), "q_id").groupBy("fold").agg(F.count("*").alias("n"))


@group.query(
    "train_pairs",
    f"""with {_CANDS}, l as (select q_id, c_id, answer_match > 0.8 as good, row_number() over (partition by q_id, answer_match > 0.8
         order by {_SHUFFLED.format("c_id")}, c_id) as n from cands),
       p as (select a.q_id, a.c_id as x, b.c_id as y from l a join l b on a.q_id = b.q_id and a.good and not b.good and b.n <= 200)
       select q_id, x as c_id_a, y as c_id_b, 1::int as label from p union all select q_id, y, x, 0::int from p""",
)
def train_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _cands(spark, sf_dir).select("q_id", "c_id", (F.col("answer_match") > 0.8).cast("int").alias("label"))
    return ranking.train_pairs(labelled, _WRONG)


_SIMPLE = ["coverage", "avg_em_surface_score", "n_literal_entities", "n_word_relation_tokens", "matches_answer_type"]


def _labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.col("matches_answer_type") + F.col("avg_em_surface_score") > 1.0
    return _features(spark, sf_dir).withColumn("label", wanted.cast("int")).withColumn("result_size", F.lit(1) - F.col("result_size_0"))


@group.query("prune_candidates")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the features are computed once, for all passes of the fit and for what is pruned
    rows = written(_labelled_features(spark, sf_dir).select("q_id", "c_id", "result_size", "label", *_SIMPLE), "labelled-features")
    model = models.fit_pruner(rows.where("q_id % 2 = 0").select("label", *_SIMPLE), _SIMPLE)
    return models.prune(rows, model).select("q_id", "c_id")


@group.query("rank_pairwise_forest")
def rank_pairwise_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the features are computed once, for the pairs of the fit and for all pairs
    rows = written(_labelled_features(spark, sf_dir).select("q_id", "c_id", "label", *_SIMPLE), "labelled-features")
    names = [f"{f}_{s}" for s in ("diff", "a", "b") for f in _SIMPLE]
    chosen = written(ranking.train_pair_features(rows.where("q_id % 2 = 0"), _SIMPLE, _WRONG), "training-pairs")
    model = models.fit_pair_ranker(chosen.select("label", *names), names)
    ab = ranking.pair_features(ranking.candidate_pairs(rows.drop("label")), _SIMPLE)
    won = models.positive_share(model.transform(ab)).select("q_id", "c_id_a", "c_id_b", "p_a")
    return ranking.rank_by_wins(rows.select("q_id", "c_id"), won)


@group.query("answer_type_model")
def answer_type_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.split("text", " ")
    asked = kb.questions(spark, sf_dir).select("q_id", *[F.coalesce(F.get(t, i), F.lit("")).alias(f"tok_{i}") for i in range(3)], F.col("kind").alias("answer_type"))
    model = models.fit_answer_types(asked, ["tok_0", "tok_1", "tok_2"])
    return models.positive_share(model.transform(asked), "p").select("q_id", F.round("p", 3).alias("p"))


@group.query(
    "selected_ngrams",
    """with w as (select doc_id, unnest(list_distinct(string_split(lower(text), ' '))) as gram from documents),
       t as (select gram, count(*) as n, sum(toxic)::bigint as pos from w join labels using (doc_id) group by 1),
       b as (select sum(pos)::bigint as p, sum(n)::bigint as total from t), e as (select gram, n, pos, n * p / total as want from t, b),
       c as (select gram, pow(pos - want, 2) / want + pow(want - pos, 2) / (n - want) as chi2, count(*) over () as grams from e),
       r as (select gram, chi2, row_number() over (order by chi2 desc, gram) as place, grams from c)
       select gram, round(chi2, 6) as chi2 from r where place <= greatest(1, floor(0.01 * grams))""",
)
def selected_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = kb.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    grams = kb.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("gram"))
    return models.select_ngrams(grams.join(labels, "doc_id").select("label", "gram"), 0.01).withColumn("chi2", F.round("chi2", 6))


@group.query(
    "candidate_quality",
    """with m as (select o_custkey as q_id, o_custkey % 10 as c_id, (o_orderkey % 7)::int as s, (o_orderkey % 7 + 1 + o_orderkey % 4)::int as e, (o_orderkey % 11)::double as score from orders),
       t as (select q_id, c_id, unnest(range(s, e)) as t from m), c as (select q_id, c_id, count(distinct t)::int as covered from t group by 1, 2)
       select q_id, c_id, covered, sum(score) as score from m join c using (q_id, c_id) group by 1, 2, 3""",
)
def candidate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    mentions = kb.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("q_id"), (F.col("o_custkey") % 10).alias("c_id"), (k % 7).cast("int").alias("tok_start"),
        (k % 7 + 1 + k % 4).cast("int").alias("tok_end"), (k % 11).cast("double").alias("score"),
    )
    return features.quality(mentions)
