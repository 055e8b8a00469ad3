"""Operators against plain Python on small inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright.llm import additive_ann, bpe, ctph, feistel, hdlang, hilbert, packing, pii, simhash, tokens, toxicity

SF = "/root/testdata/sf0.001"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def strict_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            if k == 2 and 13 <= len(digits) <= 19 and luhn(digits) or k == 3 and 9 <= len(digits) <= 15:
                out.append((k, *m.span()))
    return sorted(out)


def test_pii_base(spark):
    rnd = random.Random(3)
    parts = ["@", ".", "a", "b1", "+", "-", " ", "(", ")", "1", "22", "255", "256", "é", "😀", "x@y.z", "_", "%", "4111111111111111", "+1 (980) 555-6268", ".com", "1.2.3.4", "a@b.c_d@e.f"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(600)] + ["1" * 50_000, "1 " * 20_000, "a." * 20_000 + "@b.c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(docs).collect():
        base, spans = [tuple(x) for x in r["base"]], [tuple(x) for x in r["spans"]]
        assert base == strict_spans(texts[r["doc_id"]])
        assert set(base) <= set(spans)


def test_pii_method_adds(spark):
    texts = ["mail me: joe [at] mail.example [dot] com", "call (212) 555-0199 now", "card 4111111111111111 4111111111111111"] * 5 + ["call +1 (212) 555-0199 now", "card 4111111111111111", "mail: a.b@c.com", "no data here 12"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.find_personal_data(docs).collect()}
    assert got[0] and got[0][0][0] == 0
    assert got[1] == [(3, 5, 19)]
    assert got[2] == [(2, 5, 21), (2, 22, 38)]
    assert got[len(texts) - 1] == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.co x +1 (980) 555-6268.", 9)] * 3 + [(2, "clean", 5)], "doc_id long, text string, n_chars long")
    rows = pii.redact(docs).orderBy("doc_id").collect()
    assert rows[0]["text"] == "é [EMAIL] x [PHONE]." and rows[0]["n_chars"] == len(rows[0]["text"]) and rows[3]["text"] == "clean"


def test_ctph(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in ctph.op2_ctph(spark, SF).collect()}
    assert len(got) == len(texts)
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        k = len(t) // 3
        want = t[: len(t) - k] + after[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == tuple(ctph.fingerprints([t.encode(), want.encode()]))
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5
    assert np.mean([r["near_next"] for r in got.values()]) < 0.05


def test_ctph_likeness(spark):
    long = " ".join(str(i * i) for i in range(900))
    pairs = [(long, long, 1.0, 1.0), (long, long[:3000] + "inserted" + long[3000:], 0.8, 1.0), (long, "x".join(reversed(long)), 0.0, 0.2), ("", "", 1.0, 1.0), ("", "abc", 0.0, 0.0)]
    rows = [(*ctph.fingerprints([a.encode(), b.encode()]), lo, hi) for a, b, lo, hi in pairs]
    for r in spark.createDataFrame(rows, "a string, b string, lo double, hi double").withColumn("x", ctph.likeness(F.col("a"), F.col("b"))).collect():
        assert r["lo"] <= r["x"] <= r["hi"]


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(total):
    assert sorted(feistel.permute(np.arange(total), total)) == list(range(total))
    if total > 64:
        assert list(feistel.permute(np.arange(total), total)) != list(feistel.permute(np.arange(total), total, key=9))


def test_feistel_round_trip(spark):
    rows = feistel.op4_feistel_order(spark, SF).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    path, docs = tokens.ranks_path(), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    encoder = tokens.library_encoder(path)
    want = {}
    for r in docs:
        ids = np.concatenate([np.frombuffer(encoder.encode([r["text"] or ""])[0], "<u4"), [feistel.END_ID]]).astype("<u2")
        for seq, at in enumerate(range(0, len(ids), feistel.LENGTH)):
            want[r["doc_id"], seq] = zlib.crc32(ids[at : at + feistel.LENGTH].tobytes())
    assert {(r["doc_id"], r["seq"]): r["ids_crc32"] for r in rows} == want


def test_hilbert_curve(spark):
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        grid = spark.range(side**n).select(*[F.expr(f"(id div {side**i}) % {side}").alias(f"x{i}") for i in range(n)])
        rows = grid.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(side**n))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_hilbert_shards(spark):
    placed = hilbert.hilbert_shards(spark.read.parquet(f"{SF}/documents.parquet")).cache()
    rows = placed.collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = sorted(rows, key=lambda r: r["curve_slot"])
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in rows)
    assert len({r["size_cell"] for r in rows}) > 8
    boxes = hilbert.shard_boxes(placed).collect()
    widths = [b["max_size"] - b["min_size"] for b in boxes]
    assert len(boxes) == 16 and np.median(widths) < max(r["size"] for r in rows) - min(r["size"] for r in rows)


def test_bpe_same_as_the_library():
    import public_tokenizers
    import tiktoken

    vocab = bpe.vocabulary(public_tokenizers.path(bpe.RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    rnd, signs = random.Random(1), " \n\t\r  's'tab12€é 　ß你̀😀-_.,'d!?$%&*#|\"()ʰⅫ²\0\x1c<|endoftext|>"
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["a" * 5000 + "b" * 100, "the cat's  hat ", ""]
    want = [library.encode_ordinary(t) for t in texts]
    for e in [bpe.replay_encoder(public_tokenizers.path(bpe.RANKS)), tokens.library_encoder(tokens.ranks_path())]:
        for at in range(0, len(texts), 100):
            for t, ids, w in zip(texts[at:], e.encode(texts[at : at + 100]), want[at:], strict=False):
                assert np.frombuffer(ids, "<u4").tolist() == w
                assert bpe.decode(ids, vocab) == t.encode()


def test_settled_texts_have_the_ids_of_the_library():
    from tokenizers import Tokenizer

    path = tokens.default_path()
    library = Tokenizer.from_file(path)
    assert library.encode("hello <|endoftext|> world", add_special_tokens=False).ids == [31373, 220, 50256, 995]
    ranks = tokens.byte_ranks(path)
    assert ranks == bpe.vocabulary(tokens.ranks_path()).ranks
    rnd = random.Random(8)
    signs = [chr(c) for c in range(0x250)] + list("  's aeiouth\n\t.,019") * 20
    signs += ["<|endoftext|>"] * 3
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(4000)] + ["it\u2019s \u4f60\u597d  <|endoftext|>\u4f60", ""]
    for text, ids in zip(texts, tokens.library_encoder(path).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_every_code_point_is_cut_as_the_libraries_cut_it():
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    vocab = bpe.vocabulary(public_tokenizers.path(bpe.RANKS))
    ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    library = Tokenizer.from_file(tokens.default_path())
    mine, other = bpe.replay_encoder(public_tokenizers.path(bpe.RANKS)), tokens.library_encoder(tokens.default_path())
    points = [*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]
    for at in range(0, len(points), 4096):
        texts = [f"a {chr(c)}'s {chr(c)}a1{chr(c)}1 \u4f60{chr(c)}. {chr(c)}  {chr(c)}" for c in points[at : at + 4096]]
        for t, ids, w in zip(texts, mine.encode(texts), ranked.encode_ordinary_batch(texts, num_threads=4), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w, hex(ord(t[2]))
        for t, ids, w in zip(texts, other.encode(texts), library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w.ids, hex(ord(t[2]))


def test_replay_is_one_merge_after_another():
    import public_tokenizers

    vocab = bpe.vocabulary(public_tokenizers.path(bpe.RANKS))
    rnd = random.Random(5)
    words = [bytes(rnd.choice(b"ababcaeth n") for _ in range(rnd.randrange(30))) for _ in range(4000)]
    words += [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 12))) for _ in range(4000)]
    words += [b"a" * k for k in range(60)] + [b"ab" * k + b"a" for k in range(40)] + [b" " * k for k in range(80)]
    words += [b"".join(rnd.choice(vocab.tokens) for _ in range(3)) for _ in range(8000)]
    for word, ids in zip(words, bpe.replay(words, vocab), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == bpe._one_by_one(word, vocab)
    assert bpe.replay([], vocab) == [] and bpe.replay([b""], vocab) == [b""]


def test_bpe_memo_generations():
    seen = []
    e = bpe.ChunkEncoder(lambda chunks: (seen.append(chunks), [c.encode() for c in chunks])[1], entries=3)
    for t in ("a b c d", "a b", "e f, g.", "a e", ""):
        assert e.encode([t]) == [t.encode()]
    assert len(e.memo) <= 3 + 6


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.op7_power_of_two(spark, SF).collect()
    library = Tokenizer.from_file(tokens.default_path())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r["start"]):
            n = r["length"]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and n & (n - 1) == 0 and n <= 1024 and r["offset"] == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    order = [r["length"] for r in sorted(rows, key=lambda r: r["sequence_id"])]
    assert order == sorted(order, reverse=True)


def components(fps, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_classes(spark):
    rows = simhash.op8_simhash(spark, SF).orderBy("doc_id").collect()
    fps = [int(r["fingerprint"], 16) for r in rows]
    assert [rows[k]["doc_id"] for k in components(fps)] == [r["component_id"] for r in rows]


def test_simhash_fingerprint(spark):
    text = "Ä One TWO\tthree\x0bone two three"
    words = text.encode().decode().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [r["h"] % (1 << 64) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert int(simhash.fingerprints([text])[0]) == want
    assert simhash.fingerprints(["", " \n"]).tolist() == [0, 0]


def test_spanning_links_keep_components():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centres]))
    links = simhash.spanning_links(x, None)
    half = len(x) // 2
    split = simhash.spanning_links(x[:half], None) + simhash.spanning_links(x[half:], None) + simhash.spanning_links(x[:half], x[half:])
    want = components(x.tolist())
    for found in (links, split):
        parent = {v: v for v in x.tolist()}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for a, b in found:
            assert bin(a ^ b).count("1") <= 3
            parent[root(a)] = root(b)
        mine = [root(v) for v in x.tolist()]
        assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))
    assert len(links) < len(x)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1000, 1002)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1002] == 1000 == got[1000]


def test_ann_recall(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:400] = x[7]  # one common vector
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in additive_ann.search(df, block_rows=800, query_rows=64).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    wide, hit = x.astype(float), 0
    for q in range(0, 3000, 20):
        score = wide @ wide[q]
        order = [i for i in np.lexsort((np.arange(3000), -np.round(score, 9))) if i != q][:20]
        hit += len(set(order) & {v for v, _ in got[q].values()})
        assert sorted(got[q]) == list(range(1, 21))
        assert all(abs(score[v] - s) < 1e-9 for v, s in got[q].values())
        if 100 <= q < 400:
            assert [got[q][k][0] for k in (1, 2)] == [7, 100 if q != 100 else 101]
    assert hit / (150 * 20) >= 0.9


@pytest.mark.parametrize("large", [1e20, 1e39, 1e200])
def test_ann_recall_beside_a_large_vector(spark, large):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(4000, 32))
    x[3, 5] = large
    x[8] = 1e-200 * x[8]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in additive_ann.search(df, rerank=400).collect():  # a tenth of the one block
        got.setdefault(r["query_id"], set()).add((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 4000, 20):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(4000), -score)) if i != q][:20]
        hit += len(set(order) & {v for v, _ in got[q]})
        assert all(np.isclose(score[v], s, rtol=1e-9) for v, s in got[q]) and len(got[q]) == 20
    assert hit / (200 * 20) >= 0.9


def test_ann_answers_are_merged_in_levels(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = rng.integers(-3, 4, size=(600, 8)).astype(float)  # many ties
    x[0] = 1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").where("vec_id != 60")
    monkeypatch.setattr(additive_ann, "_MERGED", 3)
    found = additive_ann.search(df, k=5, block_rows=20, rerank=20).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    usable = [i for i in range(600) if i != 60 and x[i].any()]
    assert sorted(got) == [q for q in usable if q % 20 == 0]
    for q, rows in got.items():
        assert rows == sorted(((i, float(x[i] @ x[q])) for i in usable if i != q), key=lambda r: (-r[1], r[0]))[:5]


def test_language(spark):
    rows = [r for r in hdlang.op10_hd_language(spark, SF).collect()]
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([langs[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_vectors_follow_the_definition():
    dims = 64
    text = "Ab  c1a"
    total = np.zeros(dims)
    padded = " ab c a "
    for i in range(1, len(padded) - 1):
        if padded[i] != " ":
            a, b, c = (hdlang._letter_vector(ord(x) if x != " " else 0, dims) for x in padded[i - 1 : i + 2])
            total += np.roll(a, 2) * np.roll(b, 1) * c
    got, has = hdlang.document_vectors([text, "", "12"], dims)
    assert np.allclose(got[0], total / np.linalg.norm(total), atol=1e-5) and has.tolist() == [True, False, False]
    again, _ = hdlang.document_vectors(["xyz", text], dims)
    assert np.allclose(again[1], got[0], atol=1e-5)


def test_restoring_disguised_words(spark):
    words = "idiot stupid loser moron trash the and other words here pathetic worthless"
    docs = spark.createDataFrame([(i, words) for i in range(30)], "doc_id long, text string")
    model = toxicity.language_model(toxicity.trigram_counts(docs)).tolist()
    for given in ("1d10t", "i d i o t", "i.d.i.o.t", "iiidiiiot", "ID!OT", "idi0t###"):
        assert toxicity.restore(given, model, {}) == ["idiot"], given
    assert toxicity.restore("the other 12.5 words", model, {}) == ["the", "other", "12.5", "words"]


def test_toxicity_held_out(spark):
    rows = toxicity.op3_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.85
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_language_of_many_characters(monkeypatch):
    rnd = random.Random(6)
    texts = ["".join(chr(rnd.randrange(0x4E00, 0x9000)) if rnd.random() < 0.9 else " " for _ in range(200)) for _ in range(9)] + ["", "the cat"]
    whole, _ = hdlang.document_vectors(texts, 64)
    monkeypatch.setattr(hdlang, "_CELLS_AT_ONCE", 640)
    cut, has = hdlang.document_vectors(texts, 64)
    assert np.array_equal(whole, cut) and has.tolist() == [True] * 9 + [False, True]


def test_language_is_that_of_the_nearest_prototype(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    vectors, has = hdlang.document_vectors([r["text"] or "" for r in docs])
    learned = [zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None for r in docs]
    names = sorted({r["lang"] for r, k in zip(docs, learned, strict=True) if k})
    sums = np.array([sum(v.astype(float) for v, r, k in zip(vectors, docs, learned, strict=True) if k and r["lang"] == n) for n in names])
    cosine = vectors @ (sums / np.linalg.norm(sums, axis=1, keepdims=True)).T
    got = {r["doc_id"]: r for r in hdlang.op10_hd_language(spark, SF).collect()}
    for r, h, c in zip(docs, has, cosine, strict=True):
        first, second = np.sort(c)[::-1][:2]
        assert not h and got[r["doc_id"]]["lang_pred"] == "und" or h and (first - second < 1e-5 or got[r["doc_id"]]["lang_pred"] == names[c.argmax()])
        assert not h or abs(got[r["doc_id"]]["cosine"] - first) < 1e-4


def test_language_of_a_long_text_in_pieces(monkeypatch):
    text = "the cat, and  the dog é " * 40
    whole, _ = hdlang.document_vectors([text, "x"], 64)
    monkeypatch.setattr(hdlang, "_CHARS_AT_ONCE", 50)
    cut, has = hdlang.document_vectors([text, "x"], 64)
    assert np.allclose(whole, cut, atol=1e-5) and has.tolist() == [True, True]
