"""Near-copy classes by SimHash with exact confirmation; the pipeline's stage.

A document is the set of its five-word shingles. Two documents are linked if
the sets' Jaccard similarity is ``LEAST`` (four fifths) or more, and classes are
the connected components of these links. Equal sets are merged first. Links are
found by operator 8's tiled comparison on SimHash fingerprints of ``64 * LANES``
bits over the sets: fingerprints are laid out in tiles by size (sets so much
alike differ by a quarter in size at most), split into blocks, and every pair of
blocks that can hold a link is compared with exclusive-or and bit counts,
skipping sub-tiles whose sizes or population counts are too far apart. Every
candidate is confirmed on the whole sets.

A dense group is not paired out. A task returns a minimum spanning forest of
its candidates, nearest first; these are confirmed, and only between components
that a refused candidate touches are all pairs of fingerprints looked at in a
second round. There blocks carry the whole sets, so that a task confirms its
pairs itself and returns only links that join components. So each pair within the radius is confirmed or
joined by confirmed links. The radius is the one part that can miss. It comes
from the exact law of the majority bits: for every way in which a set of a given
size can be alike with one as large or larger, the chance that a bit differs is
summed over what the shared shingles can add up to, and the radius of that size
is the number of bits that the least favourable pair exceeds with a chance of
``MISSED`` at most (so is the number for the first lane, which is looked at first
and saves work on the others). Small sets differ in more bits (a set of 4 and one
of 5 that holds it in 48 on average) than large ones (39 at a similarity of 0.8).

Defined results: a null text is empty; texts without words are one class;
repeated rows get the same class; rows without an id belong to the classes of
their texts like any other, and a class of such rows alone has a null
``component_id``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, slices
from triplewright.llm.simhash import components, shingle_hashes

WORDS = 5
LEAST = (4, 5)
LANES = 4  # 64-bit words of a fingerprint
MISSED = 1e-4  # chance that two sets which are only just alike are further apart than the radius
MISSED_FIRST = 1e-5  # the same for the first lane alone
_EXACT_SIZES = 64  # radii of larger sets are the one of this size: the chances hardly change beyond it
BLOCK_ROWS = 1 << 15
BLOCK_HASHES = 1 << 21  # shingle hashes of a block in the second round (16 MB), or one set
SUBTILE = 256
_HASHES_AT_ONCE = 1 << 14
_EDGES_AT_ONCE = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def set_id(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is ``LEAST`` or more; of two empty ones it is 1."""
    p, q = LEAST
    if min(len(a), len(b)) * q < max(len(a), len(b)) * p:
        return False
    return (p + q) * len(np.intersect1d(a, b, assume_unique=True)) >= p * (len(a) + len(b))


def _lanes(x: np.ndarray) -> np.ndarray:
    """``LANES`` independent hashes of each shingle hash: the hash itself and mixtures of it."""
    out = np.empty((len(x), LANES), np.uint64)
    out[:, 0] = x
    for k in range(1, LANES):
        z = x + np.uint64(_ODD * k % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def wide_fingerprint(x: np.ndarray) -> bytes:
    """A bit is set if it is set in over half of the hashes of the set."""
    counts = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(x), _HASHES_AT_ONCE):
        counts += np.unpackbits(_lanes(x[at : at + _HASHES_AT_ONCE]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(x), bitorder="little").tobytes()


@lru_cache(maxsize=1 << 14)
def _one_of(k: int) -> np.ndarray:
    """Chances that k fair bits add up to 0 … k."""
    return np.array([math.comb(k, i) for i in range(k + 1)], float) / 2.0**k


def bit_differs(both: int, left: int, right: int) -> float:
    """Chance that a majority bit differs between sets that share ``both`` hashes and have ``left`` and ``right`` of their own."""

    def set_given(own: int) -> np.ndarray:
        # a bit is set if more than half of both + own hashes have it
        need = np.maximum(0, (both + own) // 2 + 1 - np.arange(both + 1))
        above = np.append(np.cumsum(_one_of(own)[::-1])[::-1], 0.0)
        return above[np.minimum(need, own + 1)]

    a, b = set_given(left), set_given(right)
    return float((_one_of(both) * (a * (1 - b) + b * (1 - a))).sum())


def _exceeded(bits: int, p: float, chance: float) -> int:
    """Least r for which more than r of ``bits`` differ with at most this chance."""
    mass, tail = [math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(bits + 1)], 0.0
    for r in range(bits, 0, -1):
        tail += mass[r]
        if tail > chance:
            return r
    return 0


@lru_cache(maxsize=1)
def radii() -> tuple[np.ndarray, np.ndarray]:
    """Bits in which sets may differ, of all lanes and of the first, by the size of the smaller set (the last for all larger sizes)."""
    p, q = LEAST
    worst = np.zeros(_EXACT_SIZES + 1)
    for n in range(1, _EXACT_SIZES + 1):
        for both in range(-(-n * p // q), n + 1):
            own = n - both
            # the other set is as large or larger, and q * both >= p * (size of the union)
            for more in range(own, both * q // p - n + 1):
                worst[n] = max(worst[n], bit_differs(both, own, more))
    # never less than for any larger size
    worst = np.maximum.accumulate(worst[::-1])[::-1]
    lanes = [(64 * LANES, MISSED), (64, MISSED_FIRST)]
    whole, first = (np.array([_exceeded(bits, x, chance) for x in worst], np.int32) for bits, chance in lanes)
    return whole, first


def _keyed(docs: DataFrame) -> list[Column]:
    """Of each row: its id, a hash of its text by which the text is found again, and one of all its columns that tells rows apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # maps have no hash of their own
    told = [F.to_json(F.struct(c)) if "map<" in docs.schema[c].dataType.simpleString() else F.col(c) for c in docs.columns]
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.xxhash64(*told).alias("tie")]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*_keyed(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, copy, tie, id, n, print) for every row: the set's id, its size and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, sizes, prints = [], [], []
            for t in b.column(3).to_pylist():
                x = shingle_set(t, words)
                ids.append(set_id(x))
                sizes.append(len(x))
                prints.append(wide_fingerprint(x))
            found = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *found], names=["doc_id", "copy", "tie", "id", "n", "print"])

    return _texts(docs).mapInArrow(run, "doc_id long, copy long, tie long, id long, n int, print binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, held): the whole sets, as bytes, of the texts named by ``wanted`` (copy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sets = [shingle_set(t, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "held"]
            )

    texts = _texts(docs).join(wanted, "copy", "left_semi").dropDuplicates(["copy"])
    return texts.select("text").mapInArrow(run, "id long, held binary").dropDuplicates(["id"])


def confirmed(docs: DataFrame, pairs: DataFrame, distinct: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are alike; ``distinct`` has (id, copy)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # written, so that its size is known: a small table is sent to the texts, for a large one the texts are shuffled
    texts = materialise(distinct.join(wanted, "id", "left_semi").select("copy"), "near-wanted")
    sets = materialise(whole_sets(docs, texts, words), "near-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            held = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            yield b.filter(pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in held], pa.bool_())).select(["a", "b"])

    a, b = (sets.select(F.col("id").alias(k), F.col("held").alias(h)) for k, h in (("a", "x"), ("b", "y")))
    return materialise(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "near-links")


def forest(nodes: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges (i, j) that make a minimum spanning forest by length ``d``, ties by place."""
    order, comp, kept = np.argsort(d, kind="stable"), np.arange(nodes), [np.zeros(0, np.int64)]
    while True:
        ci, cj = comp[i[order]], comp[j[order]]
        open_ = ci != cj
        order, ci, cj = order[open_], ci[open_], cj[open_]
        if not len(order):
            return np.concatenate(kept)
        # the shortest edge of each component: the last write wins, so the first place is written last
        first, back = np.full(nodes, len(order)), np.arange(len(order))[::-1]
        first[ci[::-1]] = back
        other = np.full(nodes, len(order))
        other[cj[::-1]] = back
        first = np.minimum(first, other)
        of = np.flatnonzero(first < len(order))
        at = first[of]
        kept.append(order[np.unique(at)])
        link = np.arange(nodes)
        link[of] = np.where(ci[at] == of, cj[at], ci[at])
        # two components that chose each other: the smaller is the root
        mutual = (link[link] == np.arange(nodes)) & (np.arange(nodes) < link)
        link[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(link, link[link]):
            link = link[link]
        comp = link[comp]


class Block:
    """Sets of a block in order of size, as arrays; ``label`` tells components apart in the second round."""

    def __init__(self, ids: bytes, sizes: bytes, prints: bytes, labels: bytes, held: bytes = b"") -> None:
        self.ids, self.sizes, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32), np.frombuffer(labels, np.int64)
        self.prints = np.frombuffer(prints, np.uint64).reshape(-1, LANES)
        self.held, self.ends = np.frombuffer(held, np.uint64), np.cumsum(self.sizes, dtype=np.int64)
        starts = np.arange(0, len(self.ids), SUBTILE)
        ones = np.bitwise_count(self.prints).astype(np.int16)
        self.low, self.high = np.minimum.reduceat(ones, starts), np.maximum.reduceat(ones, starts)
        self.least, self.most = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)

    def whole(self, k: int) -> np.ndarray:
        """The set at place ``k``; only where the block carries the sets."""
        return self.held[self.ends[k] - self.sizes[k] : self.ends[k]]


def near_pairs(a: Block, b: Block | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i in a, j in b) of sets that can be alike and lie within the radius of their sizes, and their distances, sub-tile by sub-tile."""
    p, q = LEAST
    whole, first = radii()
    same = b is None
    b = a if same else b
    for s in range(len(a.least)):
        sized = (b.least.astype(np.int64) * p <= int(a.most[s]) * q) & (int(a.least[s]) * p <= b.most.astype(np.int64) * q)
        gap = np.maximum(0, np.maximum(b.low - a.high[s], a.low[s] - b.high)).sum(axis=1)
        # radii fall with the size, so those of the least size hold for the whole sub-tile
        least = np.minimum(np.minimum(b.least, a.least[s]), _EXACT_SIZES)
        for t in np.flatnonzero(sized & (gap <= whole[least])):
            if same and t < s:
                continue
            x, y = a.prints[s * SUBTILE : (s + 1) * SUBTILE], b.prints[t * SUBTILE : (t + 1) * SUBTILE]
            i, j = np.nonzero(np.bitwise_count(x[:, None, 0] ^ y[None, :, 0]) <= first[least[t]])
            if same and s == t:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            d = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int32)
            i, j = i + s * SUBTILE, j + t * SUBTILE
            m, n = a.sizes[i].astype(np.int64), b.sizes[j].astype(np.int64)
            ok = (d <= whole[np.minimum(np.minimum(m, n), _EXACT_SIZES)]) & (np.minimum(m, n) * q >= np.maximum(m, n) * p) & (a.labels[i] != b.labels[j])
            if ok.any():
                yield i[ok], j[ok], d[ok]


def thinned(a: Block, b: Block | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the ends of a minimum spanning forest of ``near_pairs``."""
    base = 0 if b is None else len(a.ids)
    nodes = len(a.ids) + (0 if b is None else len(b.ids))
    held = [np.zeros((3, 0), np.int64)]
    size = 0
    for i, j, d in near_pairs(a, b):
        if len(d) > 2 * SUBTILE:
            ends, places = np.unique(np.concatenate([i, j + base]), return_inverse=True)
            keep = forest(len(ends), places[: len(i)], places[len(i) :], d)
            i, j, d = i[keep], j[keep], d[keep]
        held.append(np.stack([i, j + base, d]).astype(np.int64))
        size += len(d)
        if size > nodes + _EDGES_AT_ONCE:
            whole = np.concatenate(held, axis=1)
            held = [whole[:, forest(nodes, *whole)]]
            size = held[0].shape[1]
    whole = np.concatenate(held, axis=1)
    i, j, _ = whole[:, forest(nodes, *whole)]
    return a.ids[i], (a.ids if b is None else b.ids)[j - base]


def joining(a: Block, b: Block | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the ends of links, confirmed on the whole sets, that join the labels of the blocks as far as links do."""
    other = a if b is None else b
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found: list[tuple[int, int]] = []
    for i, j, d in near_pairs(a, b):
        for k in np.argsort(d, kind="stable"):
            x, y = root(int(a.labels[i[k]])), root(int(other.labels[j[k]]))
            if x != y and alike(a.whole(i[k]), other.whole(j[k])):
                parent[x] = y
                found.append((int(a.ids[i[k]]), int(other.ids[j[k]])))
    ends = np.array(found, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def candidates(sets: DataFrame, thin: bool = True, block_rows: int = BLOCK_ROWS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Pairs (a, b), a < b, of sets (id, n, print, label) within the radius and with different labels.

    ``thin``: only a spanning forest for each pair of blocks (otherwise every pair, for small tables). Where ``sets`` has the
    sets themselves (held), only confirmed links are returned, those that join labels.
    """
    spark = sets.sparkSession
    whole = "held" in sets.columns
    # sets that are alike lie in the same or in neighbouring bands of size
    band = F.floor(F.log(F.col("n")) / math.log(LEAST[1] / LEAST[0] * (1 + 1e-9))).cast("int")
    banded = sets.where("n > 0").withColumn("band", band)
    # about a hundred bands exist, however many rows there are
    blocks_of = F.ceil(F.count("*") / block_rows)
    blocks_of = F.greatest(blocks_of, F.ceil(F.sum("n") / block_hashes)) if whole else blocks_of
    counts = banded.groupBy("band").agg(blocks_of.cast("int").alias("subs")).collect()
    bands = spark.createDataFrame([tuple(r) for r in counts], "band int, subs int")
    placed = banded.join(F.broadcast(bands), "band").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "id"])
        held = {k: [rows[c].to_numpy(t).tobytes()] for k, c, t in (("ids", "id", np.int64), ("sizes", "n", np.int32), ("labels", "label", np.int64))}
        held |= {k: [b"".join(rows[c])] for k, c in (("prints", "print"), ("held", "held"))}
        return pd.DataFrame({"band": rows["band"].iloc[:1].to_list(), "sub": rows["sub"].iloc[:1].to_list(), **held})

    schema = "band int, sub int, ids binary, sizes binary, labels binary, prints binary, held binary"
    held = F.col("held") if whole else F.lit(b"").alias("held")
    blocks = placed.select("band", "sub", "id", "n", "print", "label", held).groupBy("band", "sub").applyInPandas(pack, schema)
    blocks = materialise(blocks, "near-blocks").select("band", "sub", F.struct("ids", "sizes", "prints", "labels", "held").alias("block"))
    near = bands.select(F.col("band").alias("u"), F.col("subs").alias("nu"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("v"))
    work = (
        near.join(F.broadcast(bands.select(F.col("band").alias("v"), F.col("subs").alias("nv"))), "v")
        .withColumn("su", F.explode(F.sequence(F.lit(0), F.col("nu") - 1)))
        .withColumn("sv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
        .where("u != v or su <= sv")
        .join(blocks.select(F.col("band").alias("u"), F.col("sub").alias("su"), F.col("block").alias("x")), ["u", "su"])
        .join(blocks.select(F.col("band").alias("v"), F.col("sub").alias("sv"), F.col("block").alias("y")), ["v", "sv"])
        .select(F.expr("u = v and su = sv").alias("same"), "x", "y", F.xxhash64("u", "su", "v", "sv").alias("at"))
        .repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "at")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for k in range(rows.num_rows):
                same, x, y = (rows.column(c)[k].as_py() for c in range(3))
                a, b = Block(**{n: x[n] for n in x}), None if same else Block(**{n: y[n] for n in y})
                if whole or thin:
                    left, right = (joining if whole else thinned)(a, b)
                else:
                    every = [(a.ids[i], (a if b is None else b).ids[j]) for i, j, _ in near_pairs(a, b)]
                    left, right = (np.concatenate([np.zeros(0, np.int64), *ends]) for ends in ([x for x, _ in every], [y for _, y in every]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])

    return work.select("same", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def linked_sets(docs: DataFrame, distinct: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, root) of the sets (id, n, print, copy) that are linked with others: root is the least id reachable."""
    tried = materialise(candidates(distinct.withColumn("label", F.col("id"))), "near-first")
    links = confirmed(docs, tried, distinct, words)
    roots = materialise(components(links, "near-components"), "near-roots").select(F.col("node").alias("id"), "root")
    refused = tried.join(links, ["a", "b"], "left_anti")
    for end in "ab":
        refused = refused.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    ends = refused.select(F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra != rb")
    touched = materialise(ends.select(F.explode(F.array("ra", "rb")).alias("label")).distinct(), "near-touched")
    if touched.isEmpty():
        return roots
    # a pair that was never tried lies between two components that refused candidates touch
    labelled = distinct.join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    left = materialise(labelled.join(touched, "label", "left_semi"), "near-left")
    held = materialise(whole_sets(docs, left.select("copy"), words), "near-sets")
    found = materialise(candidates(left.join(held, "id")), "near-second")
    if found.isEmpty():
        return roots
    return materialise(components(links.unionByName(found), "near-components"), "near-roots").select(F.col("node").alias("id"), "root")


def distinct_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, n, print, copy, kept) of the different sets; kept is the first of its rows by id (rows without one last), text and other columns."""
    table = shingle_sets(docs, words)
    row = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "copy", "tie")
    found = table.groupBy("id").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.min("copy").alias("copy"), F.min(row).alias("kept"))
    return materialise(found, "near-distinct")


def first_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(root, kept): for each class its first row, as in ``distinct_sets``."""
    distinct = distinct_sets(docs, words)
    rooted = distinct.join(linked_sets(docs, distinct, words), "id", "left").select(F.coalesce("root", "id").alias("root"), "kept")
    return rooted.groupBy("root").agg(F.min("kept").alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, then the smallest text hash; rows without an id come last.

    Of rows with the same id and text, the one whose columns hash least stays. Columns of any name and nulls in them are kept.
    """
    chosen = materialise(first_rows(docs, words).select("kept.doc_id", "kept.copy", "kept.tie"), "near-chosen")
    rows = docs.select(F.struct(*_keyed(docs)).alias("k"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    same = rows["k.doc_id"].eqNullSafe(chosen["doc_id"]) & (rows["k.copy"] == chosen["copy"]) & (rows["k.tie"] == chosen["tie"])
    held = rows.join(chosen, same, "left_semi")
    whole = [F.col("row").getField(c).alias(c) for c in docs.columns]
    # rows equal in all columns are left; only these are moved
    again = materialise(held.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("again")), "near-again")
    if again.isEmpty():
        return held.select(*whole)
    repeated = held["k"].eqNullSafe(again["again"])
    one = held.join(again, repeated, "left_semi").groupBy("k").agg(F.first("row").alias("row"))
    return held.join(again, repeated, "left_anti").select(*whole).unionByName(one.select(*whole))
