"""The stage's near-copy classes against all pairs in plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from triplewright.llm import near_copies

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_all_pairs(texts):
    """Ids of the least members of the components; ``texts`` is a dict by id."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {root(i) for i in ids}


def test_stage_drops_the_near_copies_of_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = kept_by_all_pairs({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == want


def test_stage_on_chains_groups_and_common_lines(spark):
    rnd = random.Random(7)
    word = lambda: f"w{rnd.randrange(5000)}"
    line = " ".join(word() for _ in range(12))
    texts = [" ".join(word() for _ in range(rnd.randrange(1, 50))) + " " + line for _ in range(60)] + ["", " ", "a b", "A  b", "a b c"]
    for size in (30, 80, 200):
        base = [word() for _ in range(size)]
        for _ in range(30):
            near = list(base)
            for _ in range(rnd.randrange(1, 4)):
                near[rnd.randrange(size)] = word()
            texts.append(" ".join(near))
        for _ in range(30):  # a chain, each one a little further from the first
            base[rnd.randrange(size)] = word()
            texts.append(" ".join(base))
    rnd.shuffle(texts)
    by_id = dict(enumerate(texts))
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    got = [r["doc_id"] for r in near_copies.keep_one_of_each(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_all_pairs(by_id)


def test_rows_without_ids_and_repeated_ids(spark):
    a = " ".join(f"w{i}" for i in range(60))
    for rows, want in (
        ([(None, a), (None, a + " x"), (None, "other"), (None, "other"), (3, "kept"), (None, "kept")], [("kept", 3), ("othe", None), ("w0 w", None)]),
        ([(5, "text a"), (5, "text b"), (9, "text b")], [("text", 5), ("text", 5)]),
        ([(1, "t"), (None, "t"), (None, "u")], [("t", 1), ("u", None)]),
        ([(2, "t"), (2, "t"), (1, "t")], [("t", 1)]),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_copies.keep_one_of_each(docs).collect()
        assert sorted((r["text"][:4], r["doc_id"]) for r in got) == want


def test_forest_is_minimal():
    rng = np.random.default_rng(3)
    for n, m in ((2, 1), (5, 20), (60, 100), (60, 900)):
        i, j, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        parent = list(range(n))

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        want = []
        for k in np.argsort(d, kind="stable").tolist():
            u, v = root(i[k]), root(j[k])
            if u != v:
                parent[u] = v
                want.append(k)
        got = near_copies.forest(n, i, j, d)
        assert sorted(got.tolist()) == sorted(want)


def test_blocks_and_second_round_find_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(near_copies, "SUBTILE", 8)
    sets = [rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    for _ in range(99):
        x = sets[rng.integers(0, len(sets))].copy()
        x[rng.integers(0, len(x), 12)] = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
        sets.append(x if rng.random() < 0.7 else rng.integers(0, 1 << 63, int(rng.integers(80, 120)), dtype=np.uint64))
    sets = [np.unique(x) for x in sets]
    prints = [np.frombuffer(near_copies.wide_fingerprint(x), np.uint64) for x in sets]
    whole, first = near_copies.radii()

    def within(i, j):
        m, n = sorted((len(sets[i]), len(sets[j])))
        apart = np.bitwise_count(prints[i] ^ prints[j])
        return apart.sum() <= whole[min(m, 64)] and apart[0] <= first[min(m, 64)] and 5 * m >= 4 * n

    near = {(i, j) for i in range(100) for j in range(i + 1, 100) if within(i, j)}
    rows = [(i, len(x), bytearray(p.tobytes()), i) for i, (x, p) in enumerate(zip(sets, prints, strict=True))]
    df = spark.createDataFrame(rows, "id long, n int, print binary, label long")
    assert {tuple(r) for r in near_copies.candidates(df, thin=False, block_rows=7).collect()} == near
    forest = {tuple(r) for r in near_copies.candidates(df, thin=True, block_rows=7).collect()}
    assert forest <= near
    for edges in (near, forest):
        parent = list(range(100))
        for _ in range(100):
            for i, j in edges:
                parent[i] = parent[j] = min(parent[i], parent[j])
        if edges is near:
            want = parent
    assert parent == want


def test_second_round_joins_what_confirmed_links_join(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(near_copies, "SUBTILE", 8)
    sets = [rng.integers(0, 1 << 63, 100, dtype=np.uint64)]
    for _ in range(59):
        x = sets[rng.integers(0, len(sets))].copy()
        x[rng.integers(0, len(x), 11)] = rng.integers(0, 1 << 63, 11, dtype=np.uint64)
        sets.append(x)
    sets = [np.unique(x) for x in sets]
    rows = [(i, len(x), bytearray(near_copies.wide_fingerprint(x)), i // 2, bytearray(x.tobytes())) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, n int, print binary, label long, held binary")
    got = {tuple(r) for r in near_copies.candidates(df, block_hashes=900).collect()}
    alike = {(i, j) for i in range(60) for j in range(i + 1, 60) if near_copies.alike(sets[i], sets[j])}
    assert got and got <= alike

    def roots(edges):
        parent = list(range(60))
        for _ in range(60):
            for i, j in [*edges, *((i, i + 1) for i in range(0, 60, 2))]:
                parent[i] = parent[j] = min(parent[i], parent[j])
        return parent

    assert roots(got) == roots(alike)


@pytest.mark.parametrize("small, large", [(4, 5), (5, 6), (8, 10), (12, 15), (31, 38), (64, 80), (150, 187)])
def test_short_and_long_sets_that_are_just_alike_are_compared(small, large):
    rng = np.random.default_rng(small)
    missed, tries = 0, 500
    for _ in range(tries):
        y = np.unique(rng.integers(0, 1 << 63, large, dtype=np.uint64))
        x = np.sort(rng.permutation(y)[:small])
        assert near_copies.alike(x, y)
        rows = [(i, len(s), near_copies.wide_fingerprint(s)) for i, s in enumerate((x, y))]
        ids, sizes = np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.int32).tobytes()
        missed += not list(near_copies.near_pairs(near_copies.Block(ids, sizes, b"".join(r[2] for r in rows), ids), None))
    assert missed == 0


def test_chance_of_a_bit_by_counting():
    for both, left, right in [(4, 0, 1), (3, 1, 0), (5, 1, 1), (0, 2, 3), (6, 2, 1)]:
        n, total = both + left + right, 0
        for bits in range(1 << n):
            at = [bits >> k & 1 for k in range(n)]
            a, b = at[: both + left], at[:both] + at[both + left :]
            total += (2 * sum(a) > len(a)) != (2 * sum(b) > len(b))
        assert abs(near_copies.bit_differs(both, left, right) - total / (1 << n)) < 1e-12


def test_stage_keeps_one_of_each_pair_of_short_texts(spark):
    # eight words and the same with one more: 4 and 5 shingles
    rnd = random.Random(9)
    texts = []
    for _ in range(400):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(9)]
        texts += [" ".join(words[:8]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one_of_each(docs).collect()) == list(range(0, 800, 2))


def test_rows_that_differ_in_a_map(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, {"a": k, "b": 0}) for k in (3, 1, 2)]
    kept = [near_copies.keep_one_of_each(spark.createDataFrame(order, "doc_id long, text string, m map<string,int>")).collect() for order in (rows, rows[::-1])]
    assert len(kept[0]) == 1 and kept[0] == kept[1]
