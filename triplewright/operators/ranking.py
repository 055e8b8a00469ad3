"""Ranking, pair construction and sampling of candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from triplewright.sources.staging import dealt, group_by_group, written


def rank_by(candidates: DataFrame, order: list[Column], most: int | None = None) -> DataFrame:
    """Add ``rank`` inside each question; keep the first ``most``."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(*order)))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def first_in_order(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of an order that ties no rows, over as many tasks as the table needs.

    Rows are dealt by ranges of the order and numbered inside their range; a range's first number is what stands before it,
    one count for each range.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before")).where(F.col("__before") < most)
    kept = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return kept.where(F.col("__before") + place < most).drop("__at", "__part", "__before")


def shuffled(key: str, seed: int) -> Column:
    """A fixed order that follows nothing in the data."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def simple_score(mentions: DataFrame, matches: DataFrame, rows: int | None = None) -> DataFrame:
    """(q_id, c_id, score): surface score times length of the mentions, and three times the best score of each matched token.

    A token matched by name counts 0.3 at least, a weak match a tenth of its score. Both tables lie one below the other, so
    they are moved once; with the number of ``rows`` of both, to as many tasks by question as these need.
    """
    keys = ["q_id", "c_id"]
    value = F.when(F.col("kind") == "name", F.lit(0.3)).when(F.col("kind") == "word", F.col("score")).when(F.col("kind") == "weak", F.col("score") * 0.1)
    found = matches.where(F.col("kind").isin("name", "word", "weak")).select(*keys, "tok", value.alias("value"))
    surface = mentions.select(*keys, (F.col("surface_score") * F.col("n_tokens")).alias("ent"))
    parts = dealt(surface.unionByName(found, allowMissingColumns=True), rows, "q_id")
    best = parts.groupBy(*keys, "tok").agg(F.sum("ent").alias("ent"), F.max("value").alias("best"))
    zero = F.lit(0.0)
    whole = best.groupBy(*keys).agg(F.sum("ent").alias("ent"), F.sum("best").alias("rel"))
    return whole.select(*keys, (F.coalesce("ent", zero) + F.coalesce("rel", zero) * 3).alias("score"))


def literal_order() -> list[Column]:
    """Sort keys of the literal ranker, best first: a total order in which relation matches are clamped for each candidate alone.

    Candidates need ent_lit, rel_lit, is_mediator, coverage, cover_card, entity_score, relation_score, popularity,
    rel_length, rel_card, result_size and c_id.
    """
    rel = F.least(F.col("rel_lit"), F.lit(1))
    literal = F.col("ent_lit") + rel
    score = F.col("entity_score") + 3 * F.col("relation_score")
    some = literal > 0
    plain = F.when(F.col("is_mediator"), 0).otherwise(1)
    by_length, by_card = -F.col("rel_length"), F.col("rel_card")
    first = F.when(F.col("is_mediator"), by_card).otherwise(by_length)
    second = F.when(F.col("is_mediator"), by_length).otherwise(by_card)
    pop = F.col("popularity").cast("double")
    keys = [
        literal + F.col("coverage"),
        literal,
        F.col("coverage"),
        F.col("cover_card") - F.col("coverage"),
        F.when(some, pop).otherwise(score),
        F.when(some, plain.cast("double")).otherwise(pop),
        F.when(some, score).otherwise(plain.cast("double")),
        first,
        second,
        F.col("result_size"),
    ]
    return [*[k.desc() for k in keys], F.col("c_id").asc()]


def rank_with_comparator(candidates: DataFrame, before: Callable[[dict, dict], float]) -> DataFrame:
    """Rank each question's candidates with a comparator that need not be a consistent order.

    Candidates are put in order of c_id first; those of one question are held together, a few hundred at most.
    """

    def run(rows: list[dict]) -> list[dict]:
        ranked = sorted(sorted(rows, key=lambda r: r["c_id"]), key=cmp_to_key(lambda x, y: -before(x, y)))
        return [{**r, "rank": n} for n, r in enumerate(ranked, 1)]

    schema = StructType([StructField(f.name, f.dataType) for f in candidates.schema] + [StructField("rank", IntegerType())])
    return group_by_group(candidates, "q_id", run, schema)


def rank_by_insertion(candidates: DataFrame, before: Callable[[Column, Column], Column]) -> DataFrame:
    """(q_id, c_id, rank) by a comparison that need not be a consistent order, without a Python worker.

    A question's candidates, in order of c_id, are inserted one after another, each before the first that it comes before.
    ``before`` takes two structs of all columns but q_id and gives a boolean, never null. Every insertion meets all that are
    in place, so the work of a question grows with the square of its candidates: prune first.
    """
    others = [c for c in candidates.columns if c not in ("q_id", "c_id")]
    items = candidates.groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("c_id", *others))).alias("items"))

    def insert(done: Column, x: Column) -> Column:
        at = F.array_position(F.transform(done, lambda y: before(x, y)), True).cast("int")
        inside = F.concat(F.slice(done, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(x), F.slice(done, F.greatest(at, F.lit(1)), F.size(done)))
        return F.when(at == 0, F.concat(done, F.array(x))).otherwise(inside)

    done = F.aggregate(F.slice("items", F.lit(2), F.size("items")), F.slice("items", 1, 1), insert)
    placed = items.select("q_id", F.posexplode(F.transform(done, lambda c: c["c_id"])).alias("rank", "c_id"))
    return placed.select("q_id", "c_id", (F.col("rank") + 1).cast("int").alias("rank"))


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """Unordered pairs of a question's candidates, with the columns of both; prune before, as pairs grow with the square."""
    a = candidates.select("q_id", *[F.col(c).alias(f"{c}_a") for c in candidates.columns if c != "q_id"])
    b = candidates.select("q_id", *[F.col(c).alias(f"{c}_b") for c in candidates.columns if c != "q_id"])
    return a.join(b, "q_id").where(F.col("c_id_a") < F.col("c_id_b"))


def pair_features(pairs: DataFrame, features: list[str]) -> DataFrame:
    """The difference, the first and the second of every feature."""
    return pairs.select(
        "q_id",
        "c_id_a",
        "c_id_b",
        *[(F.col(f"{f}_a") - F.col(f"{f}_b")).alias(f"{f}_diff") for f in features],
        *[f"{f}_{s}" for s in ("a", "b") for f in features],
    )


def rank_by_wins(candidates: DataFrame, wins: DataFrame) -> DataFrame:
    """Rank by won pairs (q_id, c_id_a, c_id_b, p_a), where ``p_a`` is the chance that the first is better."""
    first = F.when(F.col("p_a") > 0.5, 1).otherwise(0)
    # both ends of a pair from one reading of it, so that pairs are made once
    ends = F.array(F.struct(F.col("c_id_a").alias("c_id"), first.alias("won")), F.struct(F.col("c_id_b").alias("c_id"), (1 - first).alias("won")))
    total = wins.select("q_id", F.explode(ends).alias("e")).groupBy("q_id", "e.c_id").agg(F.sum("e.won").alias("wins"))
    scored = candidates.join(total, ["q_id", "c_id"], "left").fillna(0, ["wins"])
    return rank_by(scored, [F.desc("wins"), F.asc("c_id")])


def hash_sample(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    return df.orderBy(shuffled(key, seed), key).limit(most)


def folds(df: DataFrame, key: str, k: int = 6, seed: int = 999) -> DataFrame:
    return df.withColumn("fold", F.pmod(shuffled(key, seed), F.lit(k)).cast("int"))


def train_pairs(labelled: DataFrame, most: int, seed: int = 999) -> DataFrame:
    """Correct candidates of a question with up to ``most`` wrong ones, both ways round (label 1: the first is correct)."""
    w = Window.partitionBy("q_id").orderBy(shuffled("c_id", seed), "c_id")
    wrong = labelled.where("label = 0").withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
    right = labelled.where("label = 1")
    a = right.select("q_id", F.col("c_id").alias("x")).join(wrong.select("q_id", F.col("c_id").alias("y")), "q_id")
    return a.select("q_id", F.col("x").alias("c_id_a"), F.col("y").alias("c_id_b"), F.lit(1).alias("label")).unionByName(
        a.select("q_id", F.col("y").alias("c_id_a"), F.col("x").alias("c_id_b"), F.lit(0).alias("label"))
    )


def train_pair_features(rows: DataFrame, features: list[str], most: int, seed: int = 999) -> DataFrame:
    """(label, features of the pair) of the ``train_pairs`` of rows (q_id, c_id, label, features) whose first has the smaller c_id.

    The pairs are those of one join inside a question; nothing is looked up by pair.
    """
    w = Window.partitionBy("q_id").orderBy("label", shuffled("c_id", seed), "c_id")
    kept = rows.withColumn("__n", F.row_number().over(w)).where((F.col("label") == 1) | (F.col("__n") <= most)).drop("__n")
    pairs = candidate_pairs(kept).where("label_a != label_b")
    return pairs.select(
        F.col("label_a").alias("label"),
        *[(F.col(f"{f}_a") - F.col(f"{f}_b")).alias(f"{f}_diff") for f in features],
        *[f"{f}_{s}" for s in ("a", "b") for f in features],
    )


def class_weights(labels: DataFrame, label: str = "label", boost: float = 1.5) -> DataFrame:
    """(label, weight): weights inverse to how common a label is, shares of their sum, the positive one boosted."""
    counts = labels.agg(F.count("*").alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"))
    inverse = counts.select((F.col("n") / F.col("pos")).alias("p"), (F.col("n") / (F.col("n") - F.col("pos"))).alias("q"))
    rows = F.array(
        F.struct(F.lit(1).alias("label"), (F.col("p") / (F.col("p") + F.col("q")) * boost).alias("weight")),
        F.struct(F.lit(0).alias("label"), (F.col("q") / (F.col("p") + F.col("q"))).alias("weight")),
    )
    return inverse.select(F.explode(rows).alias("r")).select("r.*")
