"""Lines of text files with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 0 in each file, however many tasks read it.

    A scan cuts files into blocks and keeps the order of a block's lines. A line's number is its place in its block and the
    lines in the blocks before it; one count for each block is all that is added up.
    """
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select("value", block.alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("block.file").orderBy("block.start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(F.col("block").alias("of"), "first", before.alias("before"))
    numbered = lines.join(starts, F.col("block") == F.col("of"))
    return numbered.select(F.col("block.file").alias("file"), (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")
