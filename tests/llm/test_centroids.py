"""Centroid clustering against plain integers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np

from triplewright.llm import centroids

SF = "/root/testdata/sf0.001"


def plain(rows, clusters=8, rounds=10):
    """(id, cluster, distance) for each row, inertias by cluster, and the digests."""
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{r[0]}".encode()).hexdigest())
    centres = [v for _, v in order[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            far = [sum((p - q) ** 2 for p, q in zip(v, c, strict=True)) for c in centres]
            out.append((i, far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        near = [c for _, c, _ in assign()]
        for c in range(len(centres)):
            mine = [v for (_, v), n in zip(kept, near, strict=True) if n == c]
            if mine:
                centres[c] = [sum(p) // len(mine) for p in zip(*mine, strict=True)]
    found = assign()
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    return found, inertia, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]


def check(got, rows):
    found, inertia, digests = plain(rows)

    def fit(x):
        return x if x < 1 << 63 else None

    want = sorted((i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), digests[c]) for i, c, d in found)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(centroids.op13_centroids(spark, SF), rows)


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = centroids.op13_centroids(spark, SF)
    rows = con.sql(centroids.ORACLE).project(", ".join(got.columns)).fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in got.collect())


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, 64)) * rng.choice([0.1, 1, 4], size=(5, 64))
    return [(i, (middle[i % 5] + 0.01 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


def test_odd_vectors(spark):
    rnd = random.Random(2)
    rows = clustered(60)
    rows += [(100, rows[0][1]), (101, [0.0] * 64), (102, [-0.0001] * 64), (103, [7e4] * 64), (104, [-3e9] + [0.5] * 63), (105, [1e20] * 64), (106, [rnd.uniform(-1e38, 1e38) for _ in range(64)])]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    left_out = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [None] + [1.0] * 63), (205, [float("nan")] * 64), (206, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows + left_out, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS cluster", "1 AS distance")
    check(centroids.cluster_vectors(df), rows)
    assert centroids.cluster_vectors(df.limit(0)).collect() == []


def test_few_repeated_and_without_id(spark):
    rows = clustered(3)
    df = spark.createDataFrame([*rows, rows[1], (None, rows[2][1])], "vec_id long, embedding array<double>")
    got = centroids.cluster_vectors(df).collect()
    assert len(got) == 5 and {r["distance"] for r in got} == {0} and {r["inertia"] for r in got} == {0}
    assert [r["cluster"] for r in got if r["vec_id"] is None] == [r["cluster"] for r in got if r["vec_id"] == 2]


def test_screening_spares_exact_distances():
    x = np.floor(np.array([v for _, v in clustered(2000)]) * 1024).astype(np.int64)
    held = centroids.Centroids(x[:8].tolist())
    near, far, taken = held.nearest(x, centroids.segment_norms(x))
    whole = ((x[:, None] - x[None, :8]) ** 2).sum(axis=2)
    assert near.tolist() == whole.argmin(axis=1).tolist() and far == whole.min(axis=1).tolist()
    # the eight start in five bunches of the same distance, so more than one is looked at; without screening it would be eight
    assert taken < 2.5 * len(x)
