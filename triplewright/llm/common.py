"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_PID_SHIFT = 33  # monotonically_increasing_id() keeps the partition above this bit


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_LOCAL_DIRS: dict[str, str] = {}  # by application
_WRITTEN: list[list[str]] = []  # folders of the scopes that are open


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where a cluster's session names none, one in a warehouse that all machines see.

    A local session without the setting, as in tests, gets a temporary folder: there driver and tasks share the machine.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.conf.get("spark.master", "local").startswith("local"):
        return _LOCAL_DIRS.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="triplewright-"))
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_triplewright"


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage; ``keep`` it after ``temporary_tables``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/triplewright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _WRITTEN and not keep:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside, but for those to keep, are deleted at the end; nothing that reads them may be used after it."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that a task holds few texts as Python values."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_slots(df: DataFrame, order: list[Column], name: str, slot: str = "slot") -> tuple[DataFrame, int]:
    """Number all rows from 0 without a gap, in the given order; returns the numbered rows and their count.

    Rows are range-partitioned and sorted inside partitions, written once, and
    numbered by (rows in earlier partitions) + (position in the partition).
    The only thing gathered is one count per partition. ``order`` should end in
    columns that tell rows apart, so that a hot value spreads over partitions.
    """
    spark = df.sparkSession
    mid = f"__{slot}_mid"
    placed = materialise(
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn(mid, F.monotonically_increasing_id()),
        name,
    )
    counts = placed.groupBy(F.shiftright(mid, _PID_SHIFT).alias("pid")).agg(F.count("*").alias("n"))
    sizes = sorted((r["pid"], r["n"]) for r in counts.collect())  # one row a partition
    base, starts = 0, []
    for pid, n in sizes:
        starts.append((pid, base))
        base += n
    offsets = spark.createDataFrame(starts or [(0, 0)], "__pid long, __base long")
    numbered = (
        placed.withColumn("__pid", F.shiftright(mid, _PID_SHIFT))
        .join(F.broadcast(offsets), "__pid")
        .withColumn(slot, F.col("__base") + F.col(mid).bitwiseAND((1 << _PID_SHIFT) - 1))
        .drop("__pid", "__base", mid)
    )
    return numbered, base


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


__all__ = ["Window", "fold", "materialise", "ordered_slots", "partitions", "read", "shared_dir", "slices", "temporary_tables"]
