"""Packing by power-of-two decomposition.

The ids of a document, closed by one end id, are cut into pieces of binary
length: as many of ``MAX_LENGTH`` as fit, then one for each set bit of the
rest, longest first. Every piece is a sequence of its own and pieces of equal
length share a bucket, so no sequence crosses documents and none is padded.
Sequences are numbered bucket by bucket.

Defined results: a null text is empty and gives one piece, its end id; repeated
rows give pieces of their own; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplewright.llm.common import materialise, read
from triplewright.llm.tokens import default_path, doc_texts, encoded_batches

MAX_LENGTH = 1024
END_ID = 0
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, task int, nth long"
_PIECES_AT_ONCE = 4096


def binary_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """``n`` as a sum of powers of two up to ``longest``, the largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its ids (little-endian unsigned 32-bit); ``nth`` counts a length inside a task."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = path or default_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "task", "nth"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            return batch

        for doc_ids, encoded in encoded_batches(batches, path):
            for doc_id, ids in zip(doc_ids.to_pylist(), encoded, strict=True):
                data = ids + end
                total, start = len(data) // 4, 0
                for length in binary_lengths(total, longest):
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((doc_id, start, length, data[4 * start : 4 * (start + length)], total, task, nth))
                    start += length
                    if len(rows) >= _PIECES_AT_ONCE:
                        yield flush()
        yield flush()

    return doc_texts(docs).mapInArrow(run, _SCHEMA)


def numbered(placed: DataFrame) -> DataFrame:
    """Add sequence_id: longer buckets first, then by task and place in it. Takes a written table."""
    counts = placed.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))
    # a row per bucket: eleven for 1024
    sizes = sorted(((r["length"], r["total"]) for r in totals.collect()), reverse=True)
    first, at = [], 0
    for length, total in sizes:
        first.append((length, at))
        at += total
    bases = placed.sparkSession.createDataFrame(first or [(1, 0)], "length long, bucket_base long")
    within = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # a row per bucket and task of the scan
    offsets = counts.join(F.broadcast(bases), "length").select(
        "length", "task", (F.col("bucket_base") + F.coalesce(within, F.lit(0))).alias("base")
    )
    return placed.join(offsets, ["length", "task"]).withColumn("sequence_id", F.col("base") + F.col("nth")).drop("base", "task", "nth")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digest of the packed pieces: place, length, checksum and sequence of each."""
    rows = pieces(docs, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "task", "nth")
    found = numbered(materialise(rows, "packing-pieces"))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))


def op7_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
