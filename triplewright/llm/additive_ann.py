"""Approximate nearest neighbours by additive quantisation.

A vector is divided by its norm (by its largest component first, so that no
finite vector overflows) and approximated by a sum of one full-dimensional
codeword from each codebook. Codebooks start from k-means on residuals and are
refitted by least squares; encoding is a beam search over the codebooks in turn.
The norm of each vector is stored with its codes, in double precision, and the
approximation is scaled to it. A query
builds one table of inner products per codebook; a block of codes is scored by
looking its codes up and adding, and the best ``RERANK`` of a block are scored
again exactly, in double precision, on the original vectors.

Equal vectors are indexed once and carry their ``k + 1`` smallest ids, which is
all that any answer can need of them, so a vector shared by a third of all rows
costs one entry. Query vectors meet vectors in blocks of fixed size: a pair of
blocks moves their vectors once and makes ``QUERY_ROWS * BLOCK_ROWS`` scores from
them. The share that is reranked, ``RERANK`` of ``BLOCK_ROWS``, is the same at
every size; recall depends on how well the sampled codebooks fit the other rows.

Fitted on at most ``SAMPLE`` vectors; every row is indexed.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, nor do ids that are null or vectors of another length
than the most common; ties go to the smaller id; repeated rows count as rows of
their own; fewer candidates than ``k`` give all of them; an empty table gives
an empty result; other columns of the input are ignored. An inner product that
overflows a double is infinite, and one that is no number counts as the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, read

CODEBOOKS = 12
CODEWORDS = 256
BEAM = 4
SAMPLE = 8192
RERANK = 320
BLOCK_ROWS = 4096
QUERY_ROWS = 4096
NEIGHBOURS = 20
_MERGED = 64  # answers of a question that are merged at once


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and a 1,024th of each row's norm, which a double holds whatever the finite components are."""
    scale = np.abs(x).max(axis=1)
    y = x / scale[:, None]
    length = np.sqrt((y * y).sum(axis=1))
    return y / length[:, None], scale / 1024 * length


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), x[rng.choice(len(x), k)])
    return centres


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (row, codebook) whose codewords add up closest to each row, by beam search."""
    m, k, d = books.shape
    n = len(x)
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = x[:, None, :].astype(np.float32)
    for book in books.astype(np.float32):
        width = rest.shape[1]
        cost = (rest**2).sum(axis=2, keepdims=True) - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, width, k) + (book**2).sum(axis=1)
        cost = cost.reshape(n, width * k)
        keep = min(beam, width * k)
        pick = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(width * k), (n, 1))
        parent, word = pick // k, pick % k
        rest = np.take_along_axis(rest, parent[:, :, None], axis=1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    best = (rest**2).sum(axis=2).argmin(axis=1)
    return codes[np.arange(n), best]


def fit(x: np.ndarray, books: int = CODEBOOKS, words: int = CODEWORDS, beam: int = BEAM, rounds: int = 10, refits: int = 2) -> np.ndarray:
    """Codebooks (codebook, codeword, dimension) for the rows of ``x``."""
    rng = np.random.default_rng(7)
    rest, out = x.astype(np.float64), []
    for _ in range(books):
        centres = _kmeans(rest, words, rounds, rng)
        rest = rest - centres[(rest @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)]
        out.append(centres)
    found = np.stack(out)
    for _ in range(refits):
        at = encode(x, found, beam).astype(np.int64) + np.arange(books) * words
        gram, moment = np.zeros((books * words, books * words)), np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(moment, at[:, i], x)
            for j in range(books):
                np.add.at(gram, (at[:, i], at[:, j]), 1.0)
        gram[np.diag_indices(books * words)] += 0.1
        # codewords that no row uses stay what they are
        solved = np.linalg.solve(gram, moment + 0.1 * found.reshape(books * words, -1))
        found = solved.reshape(found.shape)
    return found


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): vectors that take part, as little-endian doubles."""
    whole = F.col("embedding").cast("array<double>")
    ok = (
        F.col("vec_id").isNotNull()
        & whole.isNotNull()
        & F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(whole, lambda v: v != 0)
    )
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids, asked): one row per distinct vector with its ``keep`` smallest ids and whether any id is a query.

    Each task merges its own copies before the shuffle, so a common vector sends one row a batch.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1) + 0.0
            groups: dict[bytes, list[int]] = {}
            for i, v in zip(ids.tolist(), values, strict=True):
                groups.setdefault(v.tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(groups), pa.binary()),
                    pa.array([sorted(g)[:keep] for g in groups.values()], pa.list_(pa.int64())),
                    pa.array([any(i % 20 == 0 for i in g) for g in groups.values()], pa.bool_()),
                ],
                names=["vec", "ids", "asked"],
            )

    parts = rows.mapInArrow(merge, "vec binary, ids array<long>, asked boolean")
    ids = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep)
    # in two steps, so that no row gathers the lists of all tasks
    some = parts.groupBy("vec", F.pmod(F.spark_partition_id(), F.lit(1024)).alias("of")).agg(ids.alias("ids"), F.max("asked").alias("asked"))
    return some.groupBy("vec").agg(ids.alias("ids"), F.max("asked").alias("asked"))


def fit_sample(distinct: DataFrame, total: int, sample: int = SAMPLE, **kwargs) -> np.ndarray:
    """Codebooks from at most ``sample`` distinct vectors, chosen by hash."""
    place = F.pmod(F.xxhash64("vec"), F.lit(1 << 48))
    # a fifth more than needed lies below the bound, and the first of these by hash are taken, so that every run takes the same
    bound = min(1 << 48, -(-12 * sample * (1 << 48) // (10 * max(total, 1))))
    chosen = distinct.select("vec", place.alias("place")).where(F.col("place") < F.lit(bound)).orderBy("place", "vec").limit(sample)
    x = np.stack([np.frombuffer(r["vec"], "<f8") for r in chosen.collect()])
    return fit(unit(x)[0], **kwargs)


def search_block(
    queries: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, books: np.ndarray, rerank: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each query: rows of the block chosen by table look-up, and their exact inner products."""
    # the length of a query changes no order
    table = np.einsum("qd,mkd->mqk", unit(queries)[0].astype(np.float32), books)
    near = np.zeros((len(queries), len(vectors)), np.float32)
    for m in range(len(books)):
        near += table[m][:, codes[:, m]]
    rough = near * norms
    if rerank < len(vectors):
        rows = np.argpartition(-rough, rerank - 1, axis=1)[:, :rerank]
    else:
        rows = np.tile(np.arange(len(vectors)), (len(queries), 1))
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("qd,qrd->qr", queries, vectors[rows])
    return rows, np.where(np.isnan(score), -np.inf, score)


def search(
    vectors: DataFrame,
    k: int = NEIGHBOURS,
    rerank: int = RERANK,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each id divisible by 20."""
    rows = _usable(vectors)
    distinct = materialise(distinct_vectors(rows, k + 1), "ann-distinct")
    spark = vectors.sparkSession
    total, asked = distinct.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = fit_sample(distinct, total, sample).astype(np.float32)
    blocks, question_blocks = -(-total // block_rows), -(-asked // query_rows)

    def index(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, "<f8") for v in group["vec"]])
        direction, length = unit(x)
        codes = encode(direction, books)
        near = sum(books[m][codes[:, m]] for m in range(len(books)))
        # the stored factor brings the approximation to the norm of the vector
        norms = length / np.maximum(np.linalg.norm(near, axis=1), 1e-12)
        ids = [np.asarray(i, "<i8") for i in group["ids"]]
        return pd.DataFrame(
            {
                "block": [group["block"].iloc[0]],
                "vecs": [x.tobytes()],
                "codes": [codes.tobytes()],
                "norms": [norms.astype("<f8").tobytes()],
                "ids": [np.concatenate(ids).tobytes()],
                "sizes": [np.array([len(i) for i in ids], "<i8").tobytes()],
            }
        )

    spread = distinct.withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(blocks)))
    indexed = materialise(
        spread.select("block", "vec", "ids")
        .groupBy("block")
        .applyInPandas(index, "block long, vecs binary, codes binary, norms binary, ids binary, sizes binary"),
        "ann-index",
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"questions": [b"".join(group["vec"])], "n": [len(group)]})

    questions = (
        distinct.where("asked")
        .select("vec", F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(question_blocks)).alias("part"))
        .groupBy("part")
        .applyInPandas(pack, "questions binary, n long")
    )
    questions = materialise(questions, "ann-questions")
    work = questions.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(indexed, "block")
    work = work.repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("block", "questions"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, q, n, vecs, codes, norms, ids, sizes in zip(*(b.column(c).to_pylist() for c in range(8)), strict=True):
                queries = np.frombuffer(q, "<f8").reshape(n, -1)
                norm = np.frombuffer(norms, "<f8")
                x = np.frombuffer(vecs, "<f8").reshape(len(norm), -1)
                member, size = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
                start = np.cumsum(size) - size
                near: list[list[dict]] = []
                for at in range(0, n, 64):
                    part = queries[at : at + 64]
                    found, score = search_block(part, x, np.frombuffer(codes, np.uint8).reshape(len(norm), -1), norm, books, rerank)
                    for r, s in zip(found, score, strict=True):
                        # rows that tie with the last that can count are all looked at
                        last = np.sort(s)[::-1][min(k, len(s) - 1)]
                        pairs = [(-v, int(i)) for row, v in zip(r, s, strict=True) if v >= last for i in member[start[row] : start[row] + size[row]]]
                        near.append([{"far": f, "id": i} for f, i in sorted(pairs)[: k + 1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * n, pa.int64()),
                        pa.array([queries[i].tobytes() for i in range(n)], pa.binary()),
                        pa.array(near, pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))),
                    ],
                    names=["block", "vec", "near"],
                )

    found = work.select("block", "questions", "n", "vecs", "codes", "norms", "ids", "sizes").mapInArrow(
        answer, "block long, vec binary, near array<struct<far: double, id: long>>"
    )
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
    # some blocks' answers at a time, so that no row gathers those of all blocks
    while blocks > _MERGED:
        found = found.groupBy("vec", F.expr(f"block div {_MERGED}").alias("block")).agg(best.alias("near"))
        blocks = -(-blocks // _MERGED)
    best = materialise(found.groupBy("vec").agg(best.alias("near")), "ann-answers")
    asking = query_rows_of(rows)
    own = asking.join(best, "vec").select("query_id", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )


def query_rows_of(rows: DataFrame) -> DataFrame:
    """(query_id, vec) of the rows whose id is divisible by 20."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows, -1) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in values], pa.binary())], names=["query_id", "vec"])

    return rows.where(F.col("vec_id") % 20 == 0).mapInArrow(run, "query_id long, vec binary")


def op9_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
