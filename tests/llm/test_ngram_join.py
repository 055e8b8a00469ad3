"""The Jaccard join against all pairs in plain Python."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from triplewright.llm import ngram_join

SF = "/root/testdata/sf0.001"


def gram_set(text, words=3):
    w = (text or "").encode("utf-8", "surrogatepass")
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
    w = [x for x in w.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\v", b" ").replace(b"\f", b" ").replace(b"\r", b" ").split(b" ") if x]
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def links(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def classes(sets, ids):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if links(sets[i], sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(sets)):
        if ids[i] is not None:
            least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return [least.get(root(i)) for i in range(len(sets))]


def check(spark, texts, ids=None, **sizes):
    ids = ids or list(range(len(texts)))
    sets = [gram_set(t) for t in texts]
    want = sorted(zip(map(str, ids), map(len, sets), map(str, classes(sets, ids)), strict=True))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, id string, n int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in ngram_join.similar_classes(df, **sizes).collect())
    assert got == want


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = classes([gram_set(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.op11_ngram_join(spark, SF).collect()}
    assert [got[r["doc_id"]] for r in rows] == want


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = ngram_join.op11_ngram_join(spark, SF)
    rows = con.sql(ngram_join.ORACLE).project(", ".join(got.columns)).fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in got.collect())


def words(rnd, n, vocabulary=10**6):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def near_threshold(seed, bases, copies):
    """Texts with copies that differ in so many n-grams that about half of them link, and a passage that all share."""
    rnd = random.Random(seed)
    passage = words(rnd, 30)
    out = []
    for _ in range(bases):
        base = words(rnd, rnd.choice([9, 11, 12, 13, 20, 40, 90, 150, 300]))
        if rnd.random() < 0.5:
            base = base + passage
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randrange(0, 2 + len(t) // 30)):
                k = rnd.randrange(len(t))
                kind = rnd.randrange(4)
                if kind == 0:
                    t[k] = f"x{rnd.randrange(50)}"
                elif kind == 1:
                    t = t[: len(t) - 1 - k // 40] if rnd.random() < 0.5 else t + words(rnd, 1 + k // 40)
                elif kind == 2:
                    t.insert(k, f"y{rnd.randrange(50)}")
                else:
                    del t[k]
            out.append(" ".join(t))
    return out


ODD = [None, "", " \t\n", "a", "A", "a b", "a  b", "a b c", "a\vb\x0cc", "a b c d", "x " * 3000, "x " * 4000, "ä ö ü ß", "Ä ö ü ß", " ".join(map(str, range(40_000))), " ".join(map(str, range(39_000)))]


def test_odd_texts(spark):
    ids = [None if i % 5 == 3 else i // 2 for i in range(2 * len(ODD))]
    check(spark, ODD + ODD, ids)
    assert ngram_join.similar_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_classes_of_rows_without_id(spark):
    check(spark, ["a b c d e f"] * 3 + ["q r s"], [None, None, None, None])


def test_near_the_threshold(spark):
    check(spark, near_threshold(1, 60, 8))


@pytest.mark.parametrize("block_hashes", [60, 600, 3000])
def test_groups_cut_into_blocks(spark, block_hashes):
    check(spark, near_threshold(2, 25, 14), block_hashes=block_hashes)


def test_a_chain_over_many_blocks(spark):
    # each text links with the next few only: the classes join up over all blocks
    line = [f"w{i}" for i in range(400)]
    texts = [" ".join(line[i : i + 100]) for i in range(0, 300, 2)]
    random.Random(3).shuffle(texts)
    check(spark, texts, block_hashes=500)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(30):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            if rng.random() < 0.3:
                a = a[ngram_join._mixed(a, 0) % np.uint64(97) < 30]  # some parts stay empty
            drop = rng.integers(0, len(a) // 9 + 2)
            b = np.concatenate([a[min(drop, len(a)) :], rng.integers(0, 1 << 63, rng.integers(0, len(a) // 9 + 2), dtype=np.uint64)])
            x, y = np.unique(a), np.unique(b)
            both = len(np.intersect1d(x, y))
            if 10 * both >= 9 * (len(x) + len(y) - both) and both and not np.array_equal(x, y):
                assert set(ngram_join.signatures(x).tolist()) & set(ngram_join.signatures(y).tolist())


@pytest.mark.parametrize("heap", [0, 40, 1 << 12])
def test_search_of_a_block(monkeypatch, heap):
    monkeypatch.setattr(ngram_join, "_HEAP", heap)
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 500, rng.integers(9, 120))
        for _ in range(15):
            x = np.concatenate([base[rng.random(len(base)) > 0.04], rng.integers(0, 500, rng.integers(0, 4))])
            sets.append(np.unique(x).astype(np.uint64))
    sets = [s for k, s in enumerate(sets) if not any(np.array_equal(s, t) for t in sets[:k])]
    ids = rng.permutation(len(sets)).astype(np.int64)
    plain = [set(s.tolist()) for s in sets]
    want = classes(plain, ids.tolist())
    a, b = ngram_join.Block(ids, sets, ids).links()
    of = {int(i): p for i, p in zip(ids, plain, strict=True)}
    assert all(links(of[x], of[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    least = {int(i): int(i) for i in ids}
    for _ in range(len(ids)):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            least[x] = least[y] = min(least[x], least[y])
    assert [least[int(i)] for i in ids] == want
    assert len(a) == len(ids) - len(set(want))  # a forest


def test_long_lists_are_probed_and_a_dense_group_stays_linear(monkeypatch):
    rng = np.random.default_rng(6)
    base = np.arange(1000, dtype=np.uint64)
    sets = [np.concatenate([np.delete(base, rng.integers(0, 1000, 20)), np.array([2000 + i], np.uint64)]) for i in range(400)]
    looked = []
    inner = ngram_join.Block.linked

    def counted(self, i, others, counts, long):
        looked.append(len(others))
        assert len(long) > 0
        return inner(self, i, others, counts, long)

    monkeypatch.setattr(ngram_join.Block, "linked", counted)
    a, _ = ngram_join.Block(np.arange(400), sets, np.arange(400)).links()
    assert len(a) == 399 and sum(looked) < 4 * 400
