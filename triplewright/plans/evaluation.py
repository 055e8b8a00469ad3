"""Queries over predicted and gold answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import metrics
from triplewright.operators.ranking import rank_by
from triplewright.plans.base import Group
from triplewright.sources import kb

group = Group()

# Each order is a question; its parts are gold, and those that a rule on the keys picks, with the suppliers of some, are predicted.
_SETS = """q as (select o_orderkey as q_id from orders), gold as (select distinct l_orderkey as q_id, 'part:' || l_partkey as target from lineitem where l_orderkey % 11 <> 0),
       pred as (select distinct l_orderkey as q_id, 'part:' || l_partkey as target from lineitem where l_partkey % 3 <> 0 and l_orderkey % 13 <> 0
         union select distinct l_orderkey, 'supplier:' || l_suppkey from lineitem where l_suppkey % 5 = 0 and l_orderkey % 13 <> 0)"""
_PRF = f"""{_SETS}, f as (select coalesce(g.q_id, p.q_id) as q_id, (g.target is not null and p.target is not null)::int as tp, (g.target is null)::int as fp, (p.target is null)::int as fn
         from gold g full join pred p on g.q_id = p.q_id and g.target = p.target),
       s as (select q.q_id, coalesce(sum(tp), 0)::bigint as tp, coalesce(sum(fp), 0)::bigint as fp, coalesce(sum(fn), 0)::bigint as fn from q left join f using (q_id) group by 1),
       pr as (select *, case when tp + fp + fn = 0 then 1 when tp + fp = 0 then {{empty}} else tp / (tp + fp)::double end as precision,
         case when tp + fp + fn = 0 then 1 when tp + fn = 0 then 0 else tp / (tp + fn)::double end as recall from s),
       prf as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from pr)"""


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = kb.table(spark, sf_dir, "lineitem")
    asked = kb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"))
    key = F.col("l_orderkey").alias("q_id")
    gold = line.where("l_orderkey % 11 != 0").select(key, kb.node("part", "l_partkey").alias("target"))
    shown = line.where("l_orderkey % 13 != 0")
    pred = shown.where("l_partkey % 3 != 0").select(key, kb.node("part", "l_partkey").alias("target"))
    return asked, gold, pred.unionByName(shown.where("l_suppkey % 5 = 0").select(key, kb.node("supplier", "l_suppkey").alias("target")))


def _size(spark: SparkSession, sf_dir: str) -> int:
    """Rows behind the gold answers, from the footers of the files."""
    return kb.table(spark, sf_dir, "lineitem").count()


def _rounded(df: DataFrame, names: tuple[str, ...] = ("precision", "recall", "f1")) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in names})


_OUT = "q_id, tp, fp, fn, round(precision::double, 9) as precision, round(recall::double, 9) as recall, round(f1::double, 9) as f1"


@group.query("prf_per_question", f"with {_PRF.format(empty=0)} select {_OUT} from prf")
def prf_per_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.scores(*_sets(spark, sf_dir), ["q_id"], rows=_size(spark, sf_dir)))


@group.query("prf_script", f"with {_PRF.format(empty=1)} select {_OUT} from prf")
def prf_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.scores(*_sets(spark, sf_dir), ["q_id"], empty_precision=1.0, rows=_size(spark, sf_dir)))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.scores(*_sets(spark, sf_dir), ["q_id"], rows=_size(spark, sf_dir))
    return found.withColumn("answered", F.col("tp") + F.col("fp") > 0).withColumn("has_gold", F.col("tp") + F.col("fn") > 0).withColumn("n_candidates", F.col("q_id") % 7)


_MEANS = ["avg_precision", "avg_recall", "avg_f1", "accuracy", "avg_precision_xao", "precision_kw", "recall_kw", "avg_num_candidates", "macro_f1", "macro_f1_xao", "f1_kw"]


@group.query(
    "metrics_summary",
    f"""with {_PRF.format(empty=0)}, b as (select count(*) as num_questions, sum((tp + fn = 0)::int)::bigint as num_questions_no_answer, avg(precision) as avg_precision, avg(recall) as avg_recall, avg(f1) as avg_f1,
         sum((f1 > 0.99)::int) / count(*)::double as accuracy, sum(precision) / sum((tp + fp > 0)::int)::double as avg_precision_xao, sum((f1 > 0.99)::int) / sum((tp + fp > 0)::int)::double as precision_kw,
         sum((f1 > 0.99)::int) / count(*)::double as recall_kw, avg(q_id % 7) as avg_num_candidates from prf),
       m as (select *, 2 * avg_precision * avg_recall / (avg_precision + avg_recall) as macro_f1, 2 * avg_precision_xao * avg_recall / (avg_precision_xao + avg_recall) as macro_f1_xao,
         2 * precision_kw * recall_kw / (precision_kw + recall_kw) as f1_kw from b)
       select num_questions, num_questions_no_answer, {", ".join(f"round({c}, 9) as {c}" for c in _MEANS)} from m""",
)
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.summary(_scored(spark, sf_dir))
    return found.select("num_questions", F.col("num_questions_no_answer").cast("long").alias("num_questions_no_answer"), *[F.round(c, 9).alias(c) for c in _MEANS])


_RANKED = """r as (select o_custkey as q_id, (o_orderkey % 5) / 4.0::double as f1, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kb.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q_id"), "o_orderkey", ((F.col("o_orderkey") % 5) / F.lit(4.0)).alias("f1"))
    return rank_by(rows, [F.asc("o_orderkey")])


_POSITIONS = f"""{_RANKED}, b as (select *, max(f1) over (partition by q_id) as best from r),
       o as (select q_id, max(best) as oracle_f1, min(case when f1 = best and best > 0 then rank end) as oracle_position from b group by 1)"""


@group.query("oracle_positions", f"with {_POSITIONS} select q_id, oracle_f1, oracle_position from o")
def oracle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.oracle_positions(_ranked(spark, sf_dir))
    return found.withColumn("oracle_position", F.col("oracle_position").cast("long"))


_TOPS = (2, 3, 5, 10, 100)


@group.query(
    "oracle_summary",
    f"""with {_POSITIONS} select round(avg(oracle_f1), 9) as oracle_avg_f1, round(sum((oracle_f1 > 0.99)::int) / count(*)::double, 9) as oracle_accuracy, round(avg(oracle_position), 9) as avg_oracle_position,
         {", ".join(f"round(sum((oracle_position <= {k})::int) / count(*)::double, 9) as oracle_top_{k}" for k in _TOPS)} from o""",
)
def oracle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.oracle_summary(metrics.oracle_positions(_ranked(spark, sf_dir)))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@group.query(
    "best_interpretation",
    """with t as (select o_custkey as q_id, (o_orderkey % 4)::int as interp, max((o_orderkey % 9) / 8.0::double) as f1 from orders group by 1, 2),
       r as (select *, row_number() over (partition by q_id order by f1 desc, interp) as n from t) select q_id, interp, f1 from r where n = 1""",
)
def best_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = kb.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("q_id"), (k % 4).cast("int").alias("interp")).agg(F.max((k % 9) / F.lit(8.0)).alias("f1"))
    full = rows.withColumn("precision", F.col("f1")).withColumn("recall", F.col("f1"))
    return metrics.best_interpretation(full).select("q_id", "interp", "f1")


@group.query(
    "run_compare",
    """with a as (select doc_id from labels where quality = 1), b as (select doc_id from labels where toxic = 0)
       select doc_id as q_id, 'a' as better from a where doc_id not in (select doc_id from b) union all select doc_id, 'b' from b where doc_id not in (select doc_id from a)""",
)
def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = kb.table(spark, sf_dir, "labels")
    a = labels.select(F.col("doc_id").alias("q_id"), F.col("quality").cast("double").alias("f1"))
    return metrics.compare_runs(a, labels.select(F.col("doc_id").alias("q_id"), (1 - F.col("toxic")).cast("double").alias("f1")))


@group.query(
    "parse_match",
    """select o_orderkey as q_id, case o_orderkey % 3 when 0 then 1.0::double when 1 then 0.6::double else 0.4::double end as share from orders""",
)
def parse_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    parse = F.array(F.lit("m.1"), F.lit("r.a"), F.lit(None).cast("string"), F.lit("r.b"), F.lit("m.2"))
    ents = F.when(k == 2, F.array(F.lit("m.3"))).otherwise(F.array(F.lit("m.1"), F.lit("m.2")))
    rels = F.when(k == 0, F.array(F.lit("r.a"), F.lit("r.b"))).when(k == 1, F.array(F.lit("r.x"))).otherwise(F.array(F.lit("r.b")))
    return kb.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q_id"), metrics.parse_match(parse, ents, rels).alias("share"))


@group.query(
    "fold_averages",
    f"""with {_PRF.format(empty=0)}, per as (select q_id % 6 as fold, avg(precision) as precision, avg(recall) as recall, avg(f1) as f1 from prf group by 1)
       select round(avg(precision), 9) as precision, round(avg(recall), 9) as recall, round(avg(f1), 9) as f1 from per""",
)
def fold_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["precision", "recall", "f1"]
    per_fold = _scored(spark, sf_dir).groupBy((F.col("q_id") % 6).alias("fold")).agg(*[F.avg(c).alias(c) for c in names])
    return _rounded(metrics.fold_averages(per_fold, names))
