"""Jaccard self-join of documents' word n-gram sets by T-occurrence search.

Two documents link when their sets have a similarity of ``LEAST`` or more.
Equal sets are merged first. The join has two parts.

*Who can meet.* Sets of at most m n-grams that link differ in at most
H = (1 - t) / (1 + t) * 2m places. The n-grams' hash space is cut into H + 1 + s
parts, so linked sets agree on s + 1 parts or more. A set emits a signature of
each part that holds ``SPARSE`` n-grams or more, and of its other parts too if
it has more than s of these; so linked sets always share a signature. A part holds a random
handful of the whole text's n-grams, so passages that many documents share do
not make signatures equal. Sizes are cut into ranges, each with its own number
of parts; a set also emits in the next range if it can link into it. Sets that
share a signature are joined to the least of them, and the connected groups of
these joins are dealt to blocks: small groups whole, several to a block, large
ones cut by hash.

*Who links.* A block is an inverted index from n-gram to sets in order of size.
Each set searches for the later ones that occur in at least T of its lists. As in
DivideSkip its L longest lists are left out, L = T / (mu * log2 of the longest +
1); the short ones are merged by a heap, sets that occur T - L times in them are
looked up in the long lists by binary search, and those that reach the overlap
that the two sizes require are links. (More than ``_HEAP`` list entries are
counted in an array instead of a heap, with the same counts.) Sets known to be in
one class are not looked at again, so a dense group costs links in proportion to
its sets, and a block returns a spanning forest.

A group that was cut is dealt anew by another hash, so that its pieces join up.
Where classes still meet in a signature, their sets are compared with all others
of the group, block by block; blocks that hold only the largest class of their
group are not compared with each other.

Defined results: a null text is empty; a text without words has an empty set, is
linked with nothing, not even its like, and its class is its own id; a text with
fewer words than an n-gram has one, its whole sequence; repeated rows count each
and link; rows without an id belong to their classes, and a class of such rows
alone has a null ``component_id``; an empty table gives an empty result; other
columns of the input are ignored. N-grams are told apart by 64-bit hashes, sets
by 64-bit hashes of these.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, read, slices
from triplewright.llm.near_copies import set_id, shingle_set
from triplewright.llm.simhash import components

WORDS = 3
LEAST = (9, 10)
SPARSE = 3
MU = 0.0085
BLOCK_HASHES = 1 << 21  # n-grams of a block (16 MB), or one set
_RANGE = (5, 4)  # ratio of the sizes of a range
_HEAP = 1 << 12
_MIX = 0x9E3779B97F4A7C15


def required(n: int, m: int) -> int:
    """Least overlap of linked sets of n and m n-grams."""
    p, q = LEAST
    return -(-p * (n + m) // (p + q))


def size_ranges(n: int) -> list[tuple[int, int, int]]:
    """(range, parts, spare parts) in which a set of n n-grams emits; none if it can link with equal sets only."""
    p, q = LEAST
    low = -(-p // (q - p))  # smaller sets that differ never link
    if n < low:
        return []
    at, out = 0, []
    while low <= n * q // p:
        high = -(-low * _RANGE[0] // _RANGE[1])
        if n < high:
            apart = 2 * (high - 1) * (q - p) // (p + q)
            spare = 1 + (apart + 1) // 16
            out.append((at, apart + 1 + spare, spare))
        low, at = high, at + 1
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    z = x + np.uint64(_MIX * (salt + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signatures(x: np.ndarray) -> np.ndarray:
    """Signatures of a set of n-gram hashes."""
    found = [np.zeros(0, np.uint64)]
    for at, parts, spare in size_ranges(len(x)):
        part = (_mixed(x, 0) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        held = np.flatnonzero(counts)
        sums = np.zeros(parts, np.uint64)
        sums[held] = np.add.reduceat(_mixed(x, 1)[order], (np.cumsum(counts) - counts)[held])
        sparse = counts < SPARSE
        emit = np.arange(parts) if sparse.sum() > spare else np.flatnonzero(~sparse)
        found.append(_mixed(sums[emit] ^ _mixed(emit.astype(np.uint64), 2 + at), 1))
    return np.concatenate(found)


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def set_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, copy, id, n, marks) of every row: a hash of its text, the set's id, its size and its signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            ids, sizes, marks = [], [], []
            for t in b.column(2).to_pylist():
                x = shingle_set(t, words)
                ids.append(set_id(x))
                sizes.append(len(x))
                marks.append(signatures(x).view(np.int64))
            found = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *found], names=["doc_id", "copy", "id", "n", "marks"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(_text()).alias("copy"), _text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, copy long, id long, n long, marks array<long>")


class Block:
    """Sets in order of size, with the inverted index of their n-grams."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None = None) -> None:
        sizes = np.array([len(s) for s in sets], np.int64)
        order = np.lexsort((ids, sizes))
        self.ids, self.sizes = ids[order], sizes[order]
        self.sides = sides[order] if sides is not None else None
        _, self.label = np.unique(labels[order], return_inverse=True)
        self.members: dict[int, list[int]] = {}
        for i, x in enumerate(self.label.tolist()):
            self.members.setdefault(x, []).append(i)
        whole = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in order)])
        by_gram = np.argsort(whole, kind="stable")
        self.postings = np.repeat(np.arange(len(sets)), self.sizes)[by_gram]
        first = np.diff(whole[by_gram], prepend=whole[by_gram][:1] - np.uint64(1)) != 0
        term = np.cumsum(first) - 1
        # one ascending array of all (n-gram, set), in which any list is looked up by binary search
        self.keys = term * len(sets) + self.postings
        lists = np.append(np.flatnonzero(first), len(whole))
        self.place = np.empty(len(whole), np.int64)
        self.place[by_gram] = np.arange(len(whole))  # of each set's n-grams in the postings
        self.term = term[self.place]
        self.stop = lists[self.term + 1]  # where the n-gram's list ends
        self.starts = np.cumsum(self.sizes) - self.sizes

    def join(self, i: int, j: int) -> None:
        """Put two sets, and all of their classes, in one class."""
        keep, gone = sorted((int(self.label[i]), int(self.label[j])), key=lambda x: -len(self.members[x]))
        moved = self.members.pop(gone)
        self.label[moved] = keep
        self.members[keep] += moved

    def open(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether each of the other sets is to be looked at from set i."""
        ok = self.label[others] != self.label[i]
        return ok if self.sides is None else ok & (self.sides[others] != self.sides[i])

    def occurring(self, i: int, places: np.ndarray, stops: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that stand at least ``least`` times in the lists' rests after set i, and how often."""
        entries = int((stops - places).sum())
        runs = [self.postings[a:b] for a, b in zip(places.tolist(), stops.tolist(), strict=True)]
        if entries > _HEAP:
            every = np.concatenate(runs)
            counts = np.bincount(every[self.open(i, every)] - i) if entries else np.zeros(0, np.int64)
            found = np.flatnonzero(counts >= least)
            return found + i, counts[found]
        heads = (r[self.open(i, r)].tolist() for r in runs)
        counted = [(j, sum(1 for _ in same)) for j, same in groupby(heapq.merge(*heads))]
        hits = np.array([c for c in counted if c[1] >= least], np.int64).reshape(-1, 2)
        return hits[:, 0], hits[:, 1]

    def linked(self, i: int, others: np.ndarray, counts: np.ndarray, long: np.ndarray) -> np.ndarray:
        """Which of the other sets, with their counts in the short lists, reach the overlap that links them with set i."""
        p, q = LEAST
        wanted = (long[:, None] * len(self.ids) + others[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        overlap = counts + (self.keys[at] == wanted).reshape(len(long), len(others)).sum(axis=0)
        return (p + q) * overlap >= p * (self.sizes[i] + self.sizes[others])

    def search(self, i: int) -> list[int]:
        """Later sets that set i links with, one at least for each class that it links with."""
        p, q = LEAST
        n = int(self.sizes[i])
        span = slice(int(self.starts[i]), int(self.starts[i]) + n)
        place, stop, term = self.place[span] + 1, self.stop[span], self.term[span]
        last = int(np.searchsorted(self.sizes, n * q // p, side="right"))
        if last < len(self.ids):
            # later sets that are too large stand at the ends of the lists
            stop = np.minimum(stop, np.searchsorted(self.keys, term * len(self.ids) + last))
        full = stop > place
        least = required(n, n)  # the others are at least as large
        if int(full.sum()) < least:
            return []
        place, stop, term = place[full], stop[full], term[full]
        length = stop - place
        order = np.argsort(length, kind="stable")
        long = min(least - 1, int(least / (MU * np.log2(max(2, int(length.max()))) + 1)))
        short, long = order[: len(order) - long], order[len(order) - long :]
        others, counts = self.occurring(i, place[short], stop[short], least - len(long))
        found, tries = [], 1
        while len(others):
            # the most promising of each class first: once it links, the rest of its class needs no look
            rank = np.lexsort((-counts, self.label[others]))
            classes = self.label[others][rank]
            head = np.flatnonzero(np.diff(classes, prepend=-1))
            nth = np.arange(len(rank)) - np.repeat(head, np.diff(np.append(head, len(rank))))
            now, later = rank[nth < tries], rank[nth >= tries]
            for j in others[now][self.linked(i, others[now], counts[now], term[long])].tolist():
                if self.label[i] != self.label[j]:
                    self.join(i, j)
                    found.append(j)
            others, counts = others[later], counts[later]
            still = self.open(i, others)
            others, counts, tries = others[still], counts[still], 2 * tries
        return found

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ends of links that join the labels of the sets as far as links do."""
        ends: list[tuple[int, int]] = []
        if len(self.ids):
            # most sets share too few n-grams with any later set
            shared = np.append(0, np.cumsum(self.stop - self.place > 1))
            tried = shared[self.starts + self.sizes] - shared[self.starts]
            p, q = LEAST
            for i in np.flatnonzero((p + q) * tried >= 2 * p * self.sizes).tolist():
                ends += [(i, j) for j in self.search(i)]
        pairs = np.array(ends, np.int64).reshape(-1, 2)
        return self.ids[pairs[:, 0]], self.ids[pairs[:, 1]]


def _sets(held: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in held.to_pylist()]


def _ends(a: np.ndarray, b: np.ndarray) -> dict[str, pa.Array]:
    return {"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))}


def links_in_cells(sets: DataFrame) -> DataFrame:
    """Links (a, b) between the sets (cell, id, label, held) of each cell."""

    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows.column("id").to_numpy(), _sets(rows.column("held")), rows.column("label").to_numpy())
        return pa.table(_ends(*block.links()))

    return sets.select("cell", "id", "label", "held").groupBy("cell").applyInArrow(run, "a long, b long")


def links_between_blocks(sets: DataFrame, block_hashes: int) -> DataFrame:
    """Links (a, b) between sets (root, id, n, label, held) of a root with different labels, all pairs of blocks but those of its largest label."""
    spark = sets.sparkSession
    weights = sets.groupBy("root", "label").agg(F.sum("n").alias("w"))
    largest = weights.groupBy("root").agg(F.max(F.struct("w", "label")).alias("m")).select("root", F.col("m.label").alias("main"))
    split = sets.join(largest, "root").withColumn("pure", (F.col("label") == F.col("main")).cast("int"))
    subs = split.groupBy("root", "pure").agg(F.ceil(F.sum("n") / block_hashes).cast("int").alias("subs"))
    split = split.join(subs, ["root", "pure"]).withColumn("sub", F.pmod(F.xxhash64("id", F.lit(2)), F.col("subs")).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        first = {c: [rows.column(c)[0].as_py()] for c in ("root", "pure", "sub")}
        arrays = {c: [rows.column(c).to_numpy().astype("<i8").tobytes()] for c in ("id", "n", "label")}
        packed = pa.table({**first, **arrays, "held": [b"".join(rows.column("held").to_pylist())]})
        return packed.cast(pa.schema([("root", pa.int64()), ("pure", pa.int32()), ("sub", pa.int32()), *((c, pa.binary()) for c in ("id", "n", "label", "held"))]))

    blocks = split.select("root", "pure", "sub", "id", "n", "label", "held").groupBy("root", "pure", "sub")
    blocks = materialise(blocks.applyInArrow(pack, "root long, pure int, sub int, id binary, n binary, label binary, held binary"), "join-blocks")
    keys = blocks.select("root", "pure", "sub")
    x, y = (keys.select("root", F.col("pure").alias(f"p{k}"), F.col("sub").alias(f"s{k}")) for k in "xy")
    # each unordered pair once; blocks of the largest label hold no pair to look at
    pairs = x.join(y, "root").where("px = 0 and (py = 1 or sx <= sy)")
    for k in "xy":
        packed = blocks.select("root", F.col("pure").alias(f"p{k}"), F.col("sub").alias(f"s{k}"), F.struct("id", "n", "label", "held").alias(k))
        pairs = pairs.join(packed, ["root", f"p{k}", f"s{k}"])
    work = pairs.select(F.expr("px = py and sx = sy").alias("same"), "x", "y", F.xxhash64("root", "px", "sx", "py", "sy").alias("at"))
    work = work.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), "at").select("same", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, *sides = (batch.column(c)[k].as_py() for c in range(3))
                sides = sides[:1] if same else sides
                ids, sizes, labels = (np.concatenate([np.frombuffer(s[c], "<i8") for s in sides]) for c in ("id", "n", "label"))
                side = np.repeat(np.arange(len(sides)), [len(s["id"]) // 8 for s in sides])
                held = np.split(np.concatenate([np.frombuffer(s["held"], "<u8") for s in sides]), np.cumsum(sizes)[:-1])
                block = Block(ids, held, labels, None if same else side)
                yield pa.RecordBatch.from_pydict(_ends(*block.links()))

    return work.mapInArrow(run, "a long, b long")


def candidate_groups(distinct: DataFrame) -> DataFrame:
    """(id, root) of the sets (id, marks) that share a signature with another: linked sets have the same root."""
    marks = distinct.select("id", F.explode("marks").alias("mark"))
    hubs = marks.groupBy("mark").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("mark", "hub")
    edges = marks.join(hubs, "mark").where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    return components(edges, "join-groups").select(F.col("node").alias("id"), "root")


def searched_sets(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """``wanted`` (copy, id, ...) with the whole sets, as bytes, in column held."""
    columns = [c for c in wanted.columns if c != "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sets = [shingle_set(t, words).astype("<u8").tobytes() for t in b.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets, pa.binary())], names=[*columns, "held"])

    texts = docs.select(F.xxhash64(_text()).alias("copy"), _text().alias("text"))
    # one text of each copy, each task keeping one of its own before they are moved, and of these the wanted ones
    texts = texts.dropDuplicates(["copy"])
    schema = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in columns)
    return texts.join(wanted, "copy").select(*columns, "text").mapInArrow(run, f"{schema}, held binary")


def links(docs: DataFrame, distinct: DataFrame, words: int = WORDS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """Spanning links (a, b) between the distinct sets (id, n, copy, marks)."""
    groups = materialise(distinct.select("id", "n", "copy").join(candidate_groups(distinct), "id"), "join-rooted")
    weights = materialise(groups.groupBy("root").agg(F.sum("n").alias("w")), "join-weights")
    large = weights.where(F.col("w") > block_hashes)
    small = weights.where(F.col("w") <= block_hashes).agg(F.sum("w")).first()[0] or 0
    bins = 1 + 2 * small // block_hashes
    first = groups.join(large, "root", "left").withColumn("label", F.col("id"))
    sub = F.pmod(F.xxhash64("id", F.lit(0)), F.ceil(F.col("w") / block_hashes))
    cell = F.when(F.col("w").isNull(), F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", sub))
    sets = materialise(searched_sets(docs, first.select("copy", "id", "n", "root", "label", cell.alias("cell"), "w"), words), "join-sets")
    found = materialise(links_in_cells(sets), "join-links")
    if large.isEmpty():
        return found
    cut = sets.where(F.col("w").isNotNull()).drop("label", "cell")

    def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
        roots = components(edges, "join-labels").select(F.col("node").alias("id"), F.col("root").alias("label"))
        return rows.join(roots, "id", "left").withColumn("label", F.coalesce("label", "id"))

    # again by another hash: pieces of one class join up
    sub = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("w") / block_hashes))
    again = labelled(cut, found).withColumn("cell", F.xxhash64("root", sub))
    found = materialise(found.unionByName(links_in_cells(again)), "join-links")
    whole = labelled(cut.select("id"), found)
    # a link that is still missing lies between two classes that share a signature
    marks = distinct.select("id", F.explode("marks").alias("mark")).join(whole, "id")
    meet = marks.groupBy("mark").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("mark")
    left = materialise(marks.join(meet, "mark", "left_semi").select("id", "label").distinct(), "join-left")
    if left.isEmpty():
        return found
    return materialise(found.unionByName(links_between_blocks(cut.join(left, "id"), block_hashes)), "join-links")


def similar_classes(docs: DataFrame, words: int = WORDS, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    rows = materialise(set_rows(docs, words), "join-rows")
    filled = rows.where("n > 0")
    distinct = filled.groupBy("id").agg(F.first("n").alias("n"), F.min("copy").alias("copy"), F.min("doc_id").alias("least"), F.first("marks").alias("marks"))
    distinct = materialise(distinct, "join-distinct")
    roots = components(links(docs, distinct, words, block_hashes), "join-components").select(F.col("node").alias("id"), "root")
    rooted = materialise(distinct.select("id", "least").join(roots, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root")), "join-classes")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("id", "root").join(least, "root").select("id", "component_id")
    linked = filled.select("doc_id", "n", "id").join(named, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(read(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = rf"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS MATERIALIZED (
    SELECT r, doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
    FROM words
),
unlike AS MATERIALIZED (SELECT min(r) AS u, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS MATERIALIZED (SELECT u, n, unnest(s) AS g FROM unlike),
pairs AS MATERIALIZED (
    SELECT a.u AS u, b.u AS v FROM grams a JOIN grams b ON a.g = b.g AND a.u < b.u AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
edges AS MATERIALIZED (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach(u, v) AS (SELECT u, u FROM unlike UNION SELECT e.u, reach.v FROM reach JOIN edges e ON reach.u = e.v),
class AS (SELECT u, min(v) AS root FROM reach GROUP BY u),
of_row AS (SELECT sets.r, sets.doc_id, len(sets.s) AS n, class.root FROM sets LEFT JOIN unlike USING (s) LEFT JOIN class USING (u))
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles,
    CAST(CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS BIGINT) AS component_id
FROM of_row"""
