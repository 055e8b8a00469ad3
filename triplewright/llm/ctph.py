"""Context-triggered piecewise hashing of documents.

A rolling hash over seven bytes marks the ends of chunks: a place ends a chunk
if the hash is ``block - 1`` modulo the block size. Each chunk gives one of 64
letters; a fingerprint is ``block:letters:letters at twice the block``. The
block size follows the length of the text, so that about 32 to 64 letters come
out, and whole texts are hashed. An edit changes the letters near it only.

Fingerprints are compared at equal or doubled block sizes by the edit distance
of their letters, where both share a run of letters; otherwise they are not
alike (0).

Defined results: a null text is empty; the empty text has the fingerprint
``3::``; equal texts have equal fingerprints and likeness 1; null ids come last
in descending order and repeated ids are ordered by their texts; a table of one
row follows itself; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, partitions, read
from triplewright.llm.tokens import doc_texts

WINDOW = 7
LEAST_BLOCK = 3
LETTERS = 64
MOST_LETTERS = 128
SHARED_RUN = 4
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_BASE = 0x01000193
_FACTORS = [np.uint32(pow(_BASE, k, 1 << 32)) for k in range(WINDOW)]
_RUN = re.compile(r"(.)\1{3,}")
_BYTES_AT_ONCE = 1 << 22


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each place; zeros stand before the first."""
    out = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32)
    for back, factor in enumerate(_FACTORS):
        out[back:] += wide[: len(data) - back] * factor
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out ^ (out >> np.uint32(12))


def _letters(rolled: np.ndarray, summed: np.ndarray, block: int) -> np.ndarray:
    ends = np.flatnonzero(rolled % np.uint32(block) == block - 1) + 1
    starts = np.concatenate([[0], ends])
    if starts[-1] == len(rolled):
        starts = starts[:-1]
    return _ALPHABET[(np.add.reduceat(summed, starts) >> np.uint32(13)) & np.uint32(63)]


def _text(letters: np.ndarray) -> str:
    return _RUN.sub(r"\1\1\1", letters.tobytes().decode("ascii"))


def _signature(rolled: np.ndarray, summed: np.ndarray) -> str:
    if not len(rolled):
        return f"{LEAST_BLOCK}::"
    block = LEAST_BLOCK
    while block * LETTERS < len(rolled):
        block *= 2
    first = _letters(rolled, summed, block)
    while len(first) < LETTERS // 2 and block > LEAST_BLOCK:
        block //= 2
        first = _letters(rolled, summed, block)
    while len(first) > MOST_LETTERS:
        block *= 2
        first = _letters(rolled, summed, block)
    return f"{block}:{_text(first)}:{_text(_letters(rolled, summed, 2 * block))}"


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprint of each text, given in UTF-8."""
    out: list[str] = []
    at = 0
    gap = bytes(WINDOW)
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= _BYTES_AT_ONCE):
            size += len(texts[end]) + WINDOW
            end += 1
        rolled = _rolling(np.frombuffer(gap.join(texts[at:end]), np.uint8))
        summed = rolled * np.uint32(0x9E3779B1)
        summed ^= summed >> np.uint32(16)
        start = 0
        for t in texts[at:end]:
            out.append(_signature(rolled[start : start + len(t)], summed[start : start + len(t)]))
            start += len(t) + WINDOW
        at = end
    return out


def _alike(x: Column, y: Column) -> Column:
    """1 less the edit distance over the longer length, or 0 without a shared run of letters."""
    run = F.least(F.lit(SHARED_RUN), F.length(x), F.length(y))
    shares = F.exists(F.sequence(F.lit(1), F.length(x) - run + 1), lambda i: F.contains(y, F.substring(x, i, run)))
    longest = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) == 0) | (F.length(y) == 0), F.lit(0.0)).when(shares, 1 - F.levenshtein(x, y) / longest).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    pa_, pb = F.split(a, ":"), F.split(b, ":")
    ba, bb = pa_[0].cast("long"), pb[0].cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when(ba == bb, F.greatest(_alike(pa_[1], pb[1]), _alike(pa_[2], pb[2])))
        .when(ba == 2 * bb, _alike(pa_[1], pb[2]))
        .when(bb == 2 * ba, _alike(pa_[2], pb[1]))
        .otherwise(0.0)
    )


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as much of ``following``, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_FIELDS = [
    ("part", pa.int32(), "int"),
    ("task", pa.int32(), "int"),
    ("doc_id", pa.int64(), "long"),
    ("n_chars", pa.int64(), "long"),
    ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.string(), "string"),
    ("edited_fingerprint", pa.string(), "string"),
    ("next_fingerprint", pa.string(), "string"),
    ("text", pa.string(), "string"),
]
_SCHEMA = ", ".join(f"{n} {k}" for n, _, k in _FIELDS)
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, _FIELDS, strict=True)], names=[f[0] for f in _FIELDS])


def _compare(items: list[tuple], task: int) -> Iterator[tuple]:
    """Rows for all of ``items`` (doc_id, text, fingerprint) but the last, each against the one after it."""
    changed = [edited(a[1], b[1]).encode() for a, b in zip(items, items[1:], strict=False)]
    for (doc_id, text, own), data, fp, follower in zip(items, changed, fingerprints(changed), items[1:], strict=False):
        yield (_WHOLE, task, doc_id, len(text), hashlib.sha256(data).hexdigest(), own, fp, follower[2], None)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the next; its first and last row come out whole, for the seams."""
    task, last = TaskContext.get().partitionId(), None
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            ids, texts = part.column(0).to_pylist(), [x or "" for x in part.column(1).to_pylist()]
            items = list(zip(ids, texts, fingerprints([t.encode() for t in texts]), strict=True))
            rows = []
            if last is None:
                rows.append((_HEAD, task, None, None, None, items[0][2], None, None, items[0][1]))
            else:
                items = [last, *items]
            rows += _compare(items, task)
            last = items[-1]
            yield _batch(rows)
    if last is not None:
        yield _batch([(_TAIL, task, last[0], None, None, last[2], None, None, last[1])])


def _at_seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for doc_id, text, own, head, head_fp in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            rows += _compare([(doc_id, text, own), (None, head, head_fp)], 0)
        yield _batch(rows)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, in descending order of doc_id."""
    rows = doc_texts(docs)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")
    done = materialise(placed.mapInArrow(_in_order, _SCHEMA), "ctph")
    # a row per partition: which one follows which; the last is followed by the first
    tasks = sorted(r["task"] for r in done.where(f"part = {_TAIL}").select("task").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, following int")
    tails = done.where(f"part = {_TAIL}").join(F.broadcast(follows), "task")
    heads = done.where(f"part = {_HEAD}").select(F.col("task").alias("following"), F.col("text").alias("head"), F.col("fingerprint").alias("head_fp"))
    seams = tails.join(heads, "following").select("doc_id", "text", "fingerprint", "head", "head_fp").mapInArrow(_at_seams, _SCHEMA)
    return done.where(f"part = {_WHOLE}").unionByName(seams).drop("part", "task", "text")


def op2_ctph(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
