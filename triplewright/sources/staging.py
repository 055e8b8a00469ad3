"""Tables that are written once and read by several steps of a query."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FEW = 10_000  # rows of a staged table that may be broadcast
TASK_ROWS = 250_000  # rows that a task gets where a step deals them itself
PLACES = 1 << 26  # bits of the bitmap of keys that thins a table before it is moved, in words of 64
_LOCAL_DIRS: dict[str, str] = {}  # by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL_DIRS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="triplewright-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later steps scan it instead of computing it again."""
    path = f"{shared_folder(df.sparkSession)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_size(staged: DataFrame) -> DataFrame:
    """A staged table for a join: broadcast up to ``FEW`` rows, else never, as its file says little about its size in memory."""
    return F.broadcast(staged) if staged.count() <= FEW else staged.hint("merge")


def dealt(df: DataFrame, rows: int | None, *keys: str | Column, each: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by keys to as many tasks of ``each`` rows as ``rows`` rows need, so that the memory of one does not grow with the input; as it is without a number.

    Spark itself joins small partitions to as many as there are cores, up to 64 MB of compressed rows each.
    """
    return df if rows is None else df.repartition(max(8, -(-rows // each)), *keys)


def thinned(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``df`` without most of the rows whose columns stand in no row of ``keys``, told apart where they lie.

    No row of the keys goes, and a few others stay, so a join with the keys must follow; it then moves little. What is sent to
    every task is a bitmap of hashes, a million words at most, however many keys there are.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(PLACES))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = df.withColumn("__word", word).join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(bit) != 0)
    return held.select(*df.columns)


def group_by_group(df: DataFrame, key: str, run: Callable[[list[dict]], list[dict]], schema: StructType) -> DataFrame:
    """The rows that ``run`` gives for the rows of each key, which Spark deals and sorts by key.

    For many small groups: handing each of them to pandas costs far more than the work inside.
    """
    arrow = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield from b.to_pylist()

    def batch(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(found, schema=arrow)

    def all_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        for _, group in groupby(rows(batches), key=lambda r: r[key]):
            found += run(list(group))
            if len(found) >= 10_000:
                yield batch(found)
                found = []
        yield batch(found)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(all_groups, schema)
