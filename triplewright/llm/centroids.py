"""Centroid clustering of integer vectors with block-norm screening.

Every component x becomes the integer floor(1024 * x). A vector is kept with
the norms of its ``SEGMENTS`` segments, computed once, as its compressed form;
so are the centroids of a round. By Cauchy-Schwarz the squared distance is at
least the sum over the segments of (norm - norm)^2. The centroid of the least
bound gets its exact distance first; then only those whose bound, less a margin
for rounding, is not above that distance get one. All exact distances are of
integers, and ties go to the smaller number, so screening changes no result.

A round is one pass over the written vectors: each task sums its vectors by
cluster, and Spark adds the sums up. At most eight centroids are held by the
driver, whatever the number of rows; a round that moves no centroid is the last,
as all after it would be the same.

Defined results: vectors that are null, not of 64 components, or hold null or
non-finite components take no part; repeated rows count each; rows without an
id are clustered like others and can start a centroid only after all rows with
one; equal hashes start in the order of their components; fewer vectors than
clusters give fewer clusters; an empty table gives an empty result; other
columns of the input are ignored. Components of any size are summed and compared
exactly; a ``distance`` or an inertia beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, read

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
SEGMENTS = 16
_NARROW = 1 << 26  # up to this the squared distance of two vectors fits a long
_LIMB = 40  # bits of a limb of a sum
_LONG = (1 << 63) - 1
_ROWS_AT_ONCE = 4096
_SLACK = 1e-9  # of the squared norms: far above the rounding of the bounds


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    whole = F.col("embedding").cast("array<double>")
    finite = F.forall(whole, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where((F.size("embedding") == dimensions) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("embedding"))


def _exact_integer(x: float, scale: int) -> int:
    over, under = x.as_integer_ratio()
    return over * scale // under


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Norms of the segments of each row of integers (at most ``_NARROW`` in size), from exact sums of squares."""
    return np.sqrt((x.reshape(len(x), segments, -1) ** 2).sum(axis=2).astype(np.float64))


def compressed(kept: DataFrame, scale: int = SCALE, segments: int = SEGMENTS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, vec, norms, wide): integers of 32 bits and segment norms as bytes, or the integers as text where one is too large for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dimensions)
            with np.errstate(over="ignore"):
                y = np.floor(x * scale)
            narrow = (np.abs(y) <= _NARROW).all(axis=1)
            ints = np.where(narrow[:, None], y, 0).astype(np.int64)
            norms = segment_norms(ints, segments)
            vec = [row.astype("<i4").tobytes() if ok else None for row, ok in zip(ints, narrow, strict=True)]
            wide = [None if ok else ",".join(str(_exact_integer(v, scale)) for v in row.tolist()) for row, ok in zip(x, narrow, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(vec, pa.binary()),
                    pa.array([n.astype("<f8").tobytes() if ok else None for n, ok in zip(norms, narrow, strict=True)], pa.binary()),
                    pa.array(wide, pa.string()),
                ],
                names=["vec_id", "vec", "norms", "wide"],
            )

    return kept.mapInArrow(run, "vec_id long, vec binary, norms binary, wide string")


class Centroids:
    """Centroids of a round: exact integers, and the norms of their segments."""

    def __init__(self, rows: list[list[int]], segments: int = SEGMENTS) -> None:
        self.rows, self.segments = rows, segments
        self.wide = np.array([max(map(abs, r)) > _NARROW for r in rows], bool)
        self.ints = np.array([[0] * len(r) if w else r for r, w in zip(rows, self.wide, strict=True)], np.int64)
        self.norms = segment_norms(self.ints, segments)

    def _far(self, row: list[int], c: int) -> int:
        return sum((p - q) ** 2 for p, q in zip(row, self.rows[c], strict=True))

    def nearest_of(self, row: list[int]) -> tuple[int, int]:
        """(distance, number) for one vector of integers of any size."""
        return min((self._far(row, c), c) for c in range(len(self.rows)))

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, list[int], int]:
        """Numbers and distances for narrow vectors, and how many exact distances were taken."""
        squares = (norms**2).sum(axis=1)[:, None] + (self.norms**2).sum(axis=1)
        # the bound, less what rounding can have added to it
        least = squares * (1 - _SLACK) - 2 * (norms @ self.norms.T) - 1
        # a centroid that holds a component too large for this is nearer than none unless all are such
        least[:, self.wide] = -1 if self.wide.all() else np.inf
        near = least.argmin(axis=1)
        best = ((x - self.ints[near]) ** 2).sum(axis=1)
        taken = len(x)
        if self.wide.any():
            return *self._with_wide(x), len(x) * len(self.rows)
        open_ = least <= best[:, None]
        open_[np.arange(len(x)), near] = False
        for c in range(len(self.rows)):
            rows = np.flatnonzero(open_[:, c])
            taken += len(rows)
            far = ((x[rows] - self.ints[c]) ** 2).sum(axis=1)
            better = (far < best[rows]) | ((far == best[rows]) & (c < near[rows]))
            near[rows[better]], best[rows[better]] = c, far[better]
        return near, best.tolist(), taken

    def _with_wide(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        found = [self.nearest_of(r) for r in x.tolist()]
        return np.array([c for _, c in found], np.int64), [d for d, _ in found]


def _parts(b: pa.RecordBatch, dimensions: int, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, list[int]]]]]:
    """Of a batch (vec_id, vec, norms, wide), some rows at a time: places, integers and norms of the narrow rows, and the wide rows."""
    for at in range(0, b.num_rows, _ROWS_AT_ONCE):
        part = b.slice(at, _ROWS_AT_ONCE)
        vec, norms, wide = (part.column(c).to_pylist() for c in (1, 2, 3))
        places = np.array([i for i, v in enumerate(vec) if v is not None], np.int64)
        x = np.frombuffer(b"".join(v for v in vec if v is not None), "<i4").astype(np.int64).reshape(-1, dimensions)
        n = np.frombuffer(b"".join(v for v in norms if v is not None), "<f8").reshape(-1, segments)
        yield places + at, x, n, [(i + at, list(map(int, w.split(",")))) for i, w in enumerate(wide) if w is not None]


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << _LIMB) - 1)))
        value >>= _LIMB
    return out


def moved(table: DataFrame, centres: list[list[int]], segments: int = SEGMENTS) -> list[list[int]]:
    """The centroids after one round: exact means, rounded down, of the vectors assigned to each; empty ones stay."""
    k, dimensions = len(centres), len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Centroids(centres, segments)
        # 2^26 a component: a long holds the sums of 2^36 vectors
        counts, sums, large = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), [[0] * dimensions for _ in range(k)]
        for b in batches:
            for _, x, norms, wide in _parts(b, dimensions, segments):
                if len(x):
                    near, _, _ = held.nearest(x, norms)
                    counts += np.bincount(near, minlength=k)
                    for c in range(k):
                        sums[c] += x[near == c].sum(axis=0)
                for _, row in wide:
                    _, c = held.nearest_of(row)
                    counts[c] += 1
                    large[c] = [p + q for p, q in zip(large[c], row, strict=True)]
        out = [(c, -1, 0, int(counts[c])) for c in range(k) if counts[c]]
        out += [
            (c, d, limb, value)
            for c in range(k)
            for d in range(dimensions)
            for limb, value in enumerate(_limbs(int(sums[c, d]) + large[c][d]))
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "place", "limb", "value"],
        )

    sums = table.mapInArrow(run, "cluster int, place int, limb int, value long").groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value"))
    # at most (64 + 1) * limbs rows for each of the eight clusters
    total = [[0] * dimensions for _ in range(k)]
    count = [0] * k
    for r in sums.collect():
        if r["place"] < 0:
            count[r["cluster"]] = r["value"]
        else:
            total[r["cluster"]][r["place"]] += r["value"] << (_LIMB * r["limb"])
    return [[s // n for s in t] if n else old for t, n, old in zip(total, count, centres, strict=True)]


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, scale: int = SCALE, seed: int = SEED) -> list[list[int]]:
    """The vectors whose ``seed:id`` hashes least, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.orderBy(F.col("vec_id").isNull(), mark, "embedding").limit(clusters).collect()
    return [[_exact_integer(v, scale) for v in r["embedding"]] for r in rows]


def assigned(table: DataFrame, centres: list[list[int]], segments: int = SEGMENTS) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a distance beyond a long is null."""
    dimensions = len(centres[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Centroids(centres, segments)
        for b in batches:
            cluster, distance = np.zeros(b.num_rows, np.int32), [0] * b.num_rows
            for places, x, norms, wide in _parts(b, dimensions, segments):
                if len(x):
                    near, far, _ = held.nearest(x, norms)
                    cluster[places] = near
                    for i, d in zip(places.tolist(), far, strict=True):
                        distance[i] = d
                for i, row in wide:
                    distance[i], cluster[i] = held.nearest_of(row)
            far = pa.array([d if d <= _LONG else None for d in distance], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), far], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dimensions)
    table = materialise(compressed(kept, dimensions=dimensions), "centroids-vectors")
    centres = first_centroids(kept, clusters)
    if not centres:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        after = moved(table, centres)
        if after == centres:
            break
        centres = after
    found = materialise(assigned(table, centres), "centroids-assigned")
    far = F.col("distance").cast("decimal(38,0)")
    sums = found.groupBy("cluster").agg(F.sum(far).alias("far"), F.count(F.when(F.col("distance").isNull(), 1)).alias("beyond")).collect()
    inertia = {r["cluster"]: None if r["beyond"] else int(r["far"]) for r in sums}  # eight rows at most

    def fit(x: int | None) -> int | None:
        return x if x is not None and x <= _LONG else None

    whole = None if None in inertia.values() else sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    facts = [(c, fit(x), fit(whole), digests[c]) for c, x in sorted(inertia.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same rows in SQL: ten rounds, one after the other."""
    far = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
    FROM embeddings
    WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}
)""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS n, v
    FROM (SELECT v, sha256('{SEED}:' || CAST(vec_id AS VARCHAR)) AS h FROM kept ORDER BY h LIMIT {CLUSTERS})
)""",
    ]
    for r in range(ROUNDS + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
    SELECT k.vec_id, min(struct_pack(d := CAST({far} AS HUGEINT), n := c.n)) AS best
    FROM kept k CROSS JOIN c{r} c GROUP BY k.vec_id
)"""
        )
        if r < ROUNDS:
            steps.append(
                f"""m{r} AS (
    SELECT a.best.n AS n, i, sum(k.v[i]) AS s, count(*) AS m
    FROM kept k JOIN a{r} a USING (vec_id) CROSS JOIN range(1, {DIMENSIONS + 1}) AS t(i) GROUP BY 1, 2
),
c{r + 1} AS MATERIALIZED (
    SELECT c.n, coalesce(m.v, c.v) AS v
    FROM c{r} c LEFT JOIN (
        SELECT n, list(CAST(s AS HUGEINT) // m - CASE WHEN s % m < 0 THEN 1 ELSE 0 END ORDER BY i) AS v FROM m{r} GROUP BY n
    ) m USING (n)
)"""
            )
    last = f"a{ROUNDS}", f"c{ROUNDS}"
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT a.vec_id, CAST(a.best.n AS INTEGER) AS cluster, CAST(a.best.d AS BIGINT) AS distance,
    CAST(sum(a.best.d) OVER (PARTITION BY a.best.n) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM {last[0]} a JOIN {last[1]} c ON a.best.n = c.n"""
    )


ORACLE = _oracle()
