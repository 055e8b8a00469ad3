"""SimHash near-duplicate classes by tiled exact comparison.

A fingerprint is the bitwise majority of the XXH64 (seed 42) of a document's
word shingles. Equal fingerprints are merged first; the distinct ones are laid
out in tiles keyed by the population counts of their two halves. Two
fingerprints within ``radius`` bits have halves whose population counts differ
by at most ``radius`` in total, so only neighbouring tiles can hold a link. A
tile is split into hash blocks of about ``block_rows`` rows, every pair of
blocks of neighbouring tiles is compared exactly with numpy (exclusive-or and
bit counts), and inside a pair the same bound on the four 16-bit quarters skips
sub-tiles. A comparison task returns a spanning forest of the links it found,
never all pairs, which keeps components whole and dense groups linear.

Defined results: a null text is empty; texts without words have fingerprint
zero and are linked like any other; repeated rows get the same class; a class
whose documents all lack an id has a null ``component_id``; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, read

WORDS = 3
RADIUS = 3
SEED = 42
BLOCK_ROWS = 1 << 16  # half a megabyte; a larger block is sent to fewer pairs
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)
_HASHES_AT_ONCE = 1 << 16
_SUBTILE = 256


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """Hashes of the word shingles, repeats included; of the whole sequence if it is shorter."""
    # bytes.split() without an argument cuts at exactly \x20 and \x09-\x0D
    w = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not w:
        return []
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    h = xxhash.xxh64_intdigest
    return [h(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """One fingerprint per text: a bit is set if it is set in over half of the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, words)
        if not hashes:
            continue
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _HASHES_AT_ONCE):
            part = np.array(hashes[at : at + _HASHES_AT_ONCE], "<u8")
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprint_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints([x or "" for x in b.column(1).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], axis=1).astype(np.int16)


def _sorted_by_quarters(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q = _quarters(x)
    order = np.lexsort((x, q[:, 2], q[:, 0]))
    x, q = x[order], q[order]
    starts = np.arange(0, len(x), _SUBTILE)
    return x, np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)


def _flatten(parent: np.ndarray) -> None:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return
        parent[:] = up


def spanning_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within ``radius`` bits between ``a`` and ``b`` (inside ``a`` if b is None), thinned to a spanning forest."""
    xa, lo_a, hi_a = _sorted_by_quarters(a)
    same = b is None
    xb, lo_b, hi_b = (xa, lo_a, hi_a) if same else _sorted_by_quarters(b)
    base = 0 if same else len(xa)
    parent = np.arange(base + len(xb))
    kept: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(lo_a)):
        gap = np.maximum(0, np.maximum(lo_b - hi_a[i], lo_a[i] - hi_b)).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            ra, rb = i * _SUBTILE, j * _SUBTILE
            near = np.bitwise_count(xa[ra : ra + _SUBTILE, None] ^ xb[None, rb : rb + _SUBTILE]) <= radius
            r, c = np.nonzero(near)
            r, c = r + ra, c + rb
            if same:
                up = r < c
                r, c = r[up], c[up]
            pr, pc = parent[r], parent[c + base]
            open_ = pr != pc
            if not open_.any():
                continue
            r, c, pr, pc = r[open_], c[open_], pr[open_], pc[open_]
            _, first = np.unique(pr.astype(np.int64) * len(parent) + pc, return_index=True)
            for k in first:
                u, v = root(pr[k]), root(pc[k])
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    kept.append((int(xa[r[k]]), int(xb[c[k]])))
            _flatten(parent)
    return kept


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Spanning links (a, b), a < b, between the distinct fingerprints in column fp."""
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))).cast("int")
    laid = distinct.select("fp", high.alias("high"), low.alias("low"))
    # at most 33 x 33 tiles exist, however many rows there are
    tiles = laid.groupBy("high", "low").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("subs"))
    tiles = distinct.sparkSession.createDataFrame([tuple(r) for r in tiles.collect()], "high int, low int, subs int")
    placed = laid.join(F.broadcast(tiles), ["high", "low"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        return pd.DataFrame({"high": [head["high"]], "low": [head["low"]], "sub": [head["sub"]], "fps": [rows["fp"].to_numpy(np.int64).tobytes()]})

    blocks = materialise(
        placed.select("high", "low", "sub", "fp").groupBy("high", "low", "sub").applyInPandas(pack, "high int, low int, sub int, fps binary"),
        "simhash-blocks",
    )
    # half of the neighbour offsets, so that each pair of tiles meets once
    offsets = [
        (dh, dl) for dh in range(-radius, radius + 1) for dl in range(-radius, radius + 1) if abs(dh) + abs(dl) <= radius and (dh, dl) >= (0, 0)
    ]
    near = F.explode(F.array(*[F.struct(F.lit(h).alias("dh"), F.lit(l).alias("dl")) for h, l in offsets]))
    left = tiles.select(F.col("high").alias("ha"), F.col("low").alias("la"), F.col("subs").alias("na"), near.alias("o"))
    left = left.select("ha", "la", "na", (F.col("ha") + F.col("o.dh")).alias("hb"), (F.col("la") + F.col("o.dl")).alias("lb"))
    right = tiles.select(F.col("high").alias("hb"), F.col("low").alias("lb"), F.col("subs").alias("nb"))
    pairs = (
        left.join(F.broadcast(right), ["hb", "lb"])
        .withColumn("sa", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
        .withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .where((F.col("ha") != F.col("hb")) | (F.col("la") != F.col("lb")) | (F.col("sa") <= F.col("sb")))
    )
    a = blocks.select(F.col("high").alias("ha"), F.col("low").alias("la"), F.col("sub").alias("sa"), F.col("fps").alias("fa"))
    b = blocks.select(F.col("high").alias("hb"), F.col("low").alias("lb"), F.col("sub").alias("sb"), F.col("fps").alias("fb"))
    twin = (F.col("ha") == F.col("hb")) & (F.col("la") == F.col("lb")) & (F.col("sa") == F.col("sb"))
    work = (
        pairs.join(a, ["ha", "la", "sa"])
        .join(b, ["hb", "lb", "sb"])
        .select(twin.alias("same"), "fa", "fb", F.xxhash64("ha", "la", "sa", "hb", "lb", "sb").alias("at"))
        .repartition(4 * int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for same, fa, fb in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out += spanning_links(np.frombuffer(fa, np.uint64), None if same else np.frombuffer(fb, np.uint64), radius)
            ends = [sorted((_signed(u), _signed(v))) for u, v in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in ends], pa.int64()), pa.array([e[1] for e in ends], pa.int64())], names=["a", "b"]
            )

    return work.select("same", "fa", "fb").mapInArrow(compare, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable.

    Alternates large-star and small-star steps, each an aggregation with partial
    sums and one equi-join, and writes the edges between steps. No adjacency list
    is ever gathered.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        flipped = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if larger:
            spread = both.unionByName(flipped)
            least = spread.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
            moved = spread.where("v > u").join(least, "u").select("m", "v")
        else:
            least = flipped.groupBy("u").agg(F.min("v").alias("m"))
            moved = flipped.join(least, "u").select("m", "v")
            moved = moved.unionByName(least.select("m", F.col("u").alias("v")))
        moved = moved.where("m != v")
        return moved.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()

    state = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), name)
    seen = None
    while True:
        mark = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        seen = mark
        state = materialise(star(star(state, True), False), name)


def near_duplicate_classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    table = materialise(fingerprint_table(docs, words), "simhash-fingerprints")
    distinct = materialise(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = materialise(components(links(distinct, radius, block_rows), "simhash-links"), "simhash-roots")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.select("fp", "root").join(ids, "root").select("fp", "component_id"), "simhash-named")
    return table.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
