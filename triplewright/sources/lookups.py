"""Readers of tab-separated lookup files, each with its schema and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _tsv(spark: SparkSession, path: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", mode).csv(path)


def _last_of(df: DataFrame, key: str) -> DataFrame:
    """The row of a key that stands last in the file."""
    placed = df.withColumn("__at", F.monotonically_increasing_id())
    last = placed.groupBy(key).agg(F.max_by(F.struct(*df.columns), "__at").alias("r"))
    return last.select("r.*")


def relation_expected_types(spark: SparkSession, path: str) -> DataFrame:
    return _last_of(_tsv(spark, path, "relation string, type string"), "relation")


def relation_lemmas(spark: SparkSession, path: str) -> DataFrame:
    return _last_of(_tsv(spark, path, "relation string, lemma string"), "relation")


def _counted(items: Column) -> Column:
    """``name:count`` items, cut at the last colon, as a map."""
    pairs = F.transform(
        F.filter(items, lambda x: x.rlike(r":[0-9.]+$")),
        lambda x: F.struct(F.regexp_extract(x, r"^(.*):[^:]*$", 1).alias("k"), F.regexp_extract(x, r":([^:]*)$", 1).cast("double").alias("v")),
    )
    return F.map_from_entries(pairs)


def word_type_counts(spark: SparkSession, path: str, least_total: int = 200, least_count: int = 10) -> DataFrame:
    raw = _tsv(spark, path, "word string, total long, items string").where(F.col("total") >= least_total)
    types = F.map_filter(_counted(F.split("items", " ")), lambda _, v: v >= least_count)
    return raw.select("word", "total", types.alias("types"))


def word_derivations(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, "word_pos string, items string")
    return raw.select("word_pos", F.array_distinct(F.filter(F.split("items", " "), lambda x: x != "")).alias("derivations"))


def relation_target_types(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, "relation string, total long, items string")
    types = F.map_filter(_counted(F.split("items", " ")), lambda k, _: k != "common.topic")
    return raw.select("relation", "total", types.alias("types")).where(F.size("types") > 0)


def _scored_words(items: Column, most: int) -> Column:
    found = F.filter(F.slice(F.split(items, " "), 1, most), lambda x: x.rlike(r"^[^(]+\([^)]+\)$"))
    words = F.transform(
        found, lambda x: F.struct(F.regexp_extract(x, r"^([^(]+)\(", 1).alias("word"), F.regexp_extract(x, r"\(([^)]+)\)", 1).cast("double").alias("score"))
    )
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + w["score"])
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), (w["score"] / total).alias("score")))


def relation_words(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    raw = _tsv(spark, path, "relation string, unused string, items string")
    return raw.select("relation", _scored_words(F.col("items"), most).alias("words"))


def mediated_relation_words(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    raw = _tsv(spark, path, "pair string, unused string, items string")
    pair = F.split("pair", " ")
    return raw.select(F.get(pair, 0).alias("rel_a"), F.get(pair, 1).alias("rel_b"), _scored_words(F.col("items"), most).alias("words"))


def reverse_relations(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, "name string, reverse string")
    return raw.unionByName(raw.select(F.col("reverse").alias("name"), F.col("name").alias("reverse"))).distinct()


def relation_counts(spark: SparkSession, path: str) -> DataFrame:
    raw = _tsv(spark, path, "relation string, total long, subjects long, objects long")
    return raw.where((F.length("relation") > 1) & ~F.col("relation").contains("/key/"))


def mediator_names(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "mid string, name string")


def mediator_relations(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "relation string").distinct()


def entity_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of any width: id, name, popularity and then aliases."""
    f = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(f, 0).alias("mid"), F.get(f, 1).alias("name"), F.get(f, 2).cast("int").alias("score"), F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0))).alias("aliases")
    )


def surface_map(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "surface string, score double, mid string")


def surface_index(surfaces: DataFrame) -> DataFrame:
    """One row per surface with all its (mid, score)."""
    return surfaces.groupBy("surface").agg(F.sort_array(F.collect_list(F.struct("score", "mid")), asc=False).alias("entries"))


def entity_types(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "mid string, items string").select("mid", F.filter(F.split("items", " "), lambda x: x != "").alias("types"))


def entity_categories(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "mid string, category string")


def mediator_facts(spark: SparkSession, path: str) -> DataFrame:
    """Rows that do not have exactly four columns are skipped."""
    f = F.split("value", "\t")
    return spark.read.text(path).where(F.size(f) == 4).select(*[F.get(f, i).alias(n) for i, n in enumerate(("value", "relation", "aux", "mediator"))])


def without_relations(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines of a fact file that do not match a pattern."""
    return lines.where(~F.col("value").rlike(pattern))


def oracle_entities(spark: SparkSession, path: str) -> DataFrame:
    """(mention, ids): mentions without spaces; an id of a date or a literal becomes a date."""
    raw = _tsv(spark, path, "mention string, id string").select(F.replace("mention", F.lit(" "), F.lit("")).alias("mention"), "id")
    kind = F.when(F.col("id").startswith("/type/datetime") | F.col("id").startswith("/un/"), "date").otherwise("entity")
    return raw.groupBy("mention").agg(F.collect_list(F.struct("id", kind.alias("kind"))).alias("ids"))


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "word string").distinct()


def write_mediator_index(facts: DataFrame, path: str, partitions: int = 200) -> None:
    """Postings sorted by value, mediator and relation in files that each hold a range of values."""
    facts.repartitionByRange(partitions, "value", "mediator").sortWithinPartitions("value", "mediator", "relation").write.parquet(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table of an index that is not there yet."""
    for name, df in tables.items():
        df.write.mode("ignore").parquet(f"{path}/{name}")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
