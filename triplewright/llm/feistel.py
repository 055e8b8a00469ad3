"""Training-order materialisation: a keyed Feistel permutation and fixed-stride shards.

Documents become token-id sequences of ``LENGTH`` ids. All sequences are
numbered without gaps, and a keyed Feistel network over the next even power of
two, walked along its cycle until it lands inside, permutes the numbers: every
sequence has one global slot and no table of the order is kept. Rows are
range-partitioned by shard, sorted by slot, and each shard is written as one
binary value of records with the same stride, so the record of a slot is found
by arithmetic and a reader can start again from any slot.

Defined results: a null or empty text gives one sequence, its end id; a null id
is kept as null; repeated rows have slots of their own; an empty table gives no
shards; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triplewright.llm.common import materialise, partitions, read, shared_dir
from triplewright.llm.tokens import doc_texts, encoded_batches, ranks_path

LENGTH = 512
SHARD_SLOTS = 2048
KEY = 0x5EED
ROUNDS = 6
END_ID = 50256
_ROWS_AT_ONCE = 1024
_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Slots of the given numbers under the keyed permutation of 0..total-1."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & _M64) for r in range(ROUNDS)]
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(total)]
    return out.astype(np.int64)


def record(length: int = LENGTH) -> np.dtype:
    """Layout of one slot: who it is, how many ids count, and the ids, padded with zeros."""
    return np.dtype([("doc_id", "<i8"), ("seq", "<u4"), ("n", "<u2"), ("has_id", "<u2"), ("ids", "<u2", (length,))])


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per sequence: ids as little-endian unsigned 16-bit, and its place in its task."""
    path = path or ranks_path()
    end = np.array([end_id], "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, rows = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "seq", "ids", "task", "nth"]
            )
            rows.clear()
            return batch

        for doc_ids, encoded in encoded_batches(batches, path):
            for doc_id, ids in zip(doc_ids.to_pylist(), encoded, strict=True):
                wide = np.frombuffer(ids, "<u4")
                if len(wide) and wide.max() > 0xFFFF:
                    raise ValueError("ids over 65535 do not fit the record")
                data = np.concatenate([wide.astype("<u2"), end]).tobytes()
                for seq, at in enumerate(range(0, len(data), 2 * length)):
                    rows.append((doc_id, seq, data[at : at + 2 * length], task, nth))
                    nth += 1
                    if len(rows) >= _ROWS_AT_ONCE:
                        yield flush()
        yield flush()

    return doc_texts(docs).mapInArrow(run, "doc_id long, seq long, ids binary, task int, nth long")


def training_order(rows: DataFrame, key: int = KEY) -> DataFrame:
    """Add slot to a written table of sequences."""
    counts = rows.groupBy("task").agg(F.count("*").alias("n"))  # a row per task of the scan
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("task", F.coalesce(before, F.lit(0)).alias("base"))
    total = rows.count()

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    return rows.join(F.broadcast(offsets), "task").withColumn("slot", slot(F.col("base") + F.col("nth"))).drop("base", "task", "nth")


def write_shards(placed: DataFrame, path: str, length: int = LENGTH, slots: int = SHARD_SLOTS) -> None:
    """Write (shard, first_slot, records, stride, payload, crc32), one row per shard, to ``path``."""
    kind = record(length)

    def pack(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        payload = rows.tobytes()
        values = [shard, shard * slots, len(rows), kind.itemsize]
        columns = [pa.array([v], pa.int64()) for v in values] + [pa.array([payload], pa.binary()), pa.array([zlib.crc32(payload)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "first_slot", "records", "stride", "payload", "crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.zeros(b.num_rows, kind)
            doc_id, ids = b.column(0), b.column(2)
            rows["doc_id"] = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            rows["has_id"] = doc_id.is_valid().to_numpy(zero_copy_only=False)
            rows["seq"] = b.column(1).to_numpy(zero_copy_only=False)
            data = ids.to_pylist()
            rows["n"] = [len(x) // 2 for x in data]
            rows["ids"][np.arange(length) < rows["n"][:, None]] = np.frombuffer(b"".join(data), "<u2")
            of = b.column(3).to_numpy(zero_copy_only=False) // slots
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
            for start, end in zip(cuts, cuts[1:], strict=False):
                if of[start] != shard:
                    if shard is not None:
                        yield pack(shard, parts)
                    shard, parts = int(of[start]), []
                parts.append(rows[start:end])
        if shard is not None:
            yield pack(shard, parts)

    n = partitions(placed.sparkSession)
    ordered = placed.withColumn("shard", F.expr(f"slot div {slots}")).repartitionByRange(n, "shard").sortWithinPartitions("slot")
    out = ordered.select("doc_id", "seq", "ids", "slot").mapInArrow(
        run, "shard long, first_slot long, records long, stride long, payload binary, crc32 long"
    )
    out.write.option("compression", "zstd").parquet(path)


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, length: int = LENGTH) -> DataFrame:
    """Records of slots ``start`` to ``stop`` (exclusive), whatever was read before: (slot, shard, offset, doc_id, seq, ids)."""
    kind = record(length)
    end = _M64 >> 1 if stop is None else stop
    shards = spark.read.parquet(path).where((F.col("first_slot") + F.col("records") > start) & (F.col("first_slot") < end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, payload, crc in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"shard {shard} is damaged")
                rows = np.frombuffer(payload, kind)
                offset = np.arange(len(rows))
                keep = (first + offset >= start) & (first + offset < end)
                rows, offset = rows[keep], offset[keep]
                flat = rows["ids"][np.arange(length) < rows["n"][:, None]]
                ends = 2 * np.concatenate([[0], np.cumsum(rows["n"], dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first + offset, pa.int64()),
                        pa.array(np.full(len(rows), shard), pa.int64()),
                        pa.array(offset, pa.int64()),
                        pa.array(rows["doc_id"].astype(np.int64), pa.int64(), mask=rows["has_id"] == 0),
                        pa.array(rows["seq"].astype(np.int64)),
                        pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(flat)]),
                    ],
                    names=["slot", "shard", "offset", "doc_id", "seq", "ids"],
                )

    return shards.select("shard", "first_slot", "payload", "crc32").mapInArrow(
        run, "slot long, shard long, offset long, doc_id long, seq long, ids binary"
    )


def op4_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = training_order(materialise(sequences(read(spark, sf_dir, "documents")), "feistel-sequences"))
    path = f"{shared_dir(spark)}/triplewright/shards-{uuid.uuid4().hex}"
    write_shards(placed, path)
    return read_slots(spark, path).select(
        "doc_id", "seq", "slot", "shard", "offset", (F.octet_length("ids") / 2).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
