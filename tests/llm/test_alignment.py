"""Alignment of two tokenizers against plain loops over bytes and occurrences."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from triplewright.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}
    return a, b, byte


def plain_document(text, libraries):
    """Ids of both sides, and the groups as lists of places."""
    a, b, byte = libraries
    if not text:
        return [], [], []
    e = a.encode(" " + text, add_special_tokens=False)
    ids_b = b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in e.ids]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], []
    groups, at_a, at_b, i, j = [], 0, 0, 0, 0
    from_i, from_j = 0, 0
    while i < len(bytes_a):
        if at_a <= at_b:
            at_a += len(bytes_a[i])
            i += 1
        while at_b < at_a:
            at_b += len(bytes_b[j])
            j += 1
        if at_a == at_b:
            groups.append((range(from_i, i), range(from_j, j)))
            from_i, from_j = i, j
    return e.ids, ids_b, groups


def plain(texts, libraries):
    whole = [plain_document(t, libraries) for t in texts]
    links = [Counter((a[i], b[j]) for g, h in groups for i in g for j in h) for a, b, groups in whole]
    count = Counter(p for link in links for p in link)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (a, b, groups), link in zip(whole, links, strict=True):
        text = ";".join(",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups)
        out.append(
            (
                len(a), len(b), len(groups), link.total(),
                sum(n for p, n in link.items() if count[p] == most[p[0]]),
                sum(n * count[p] for p, n in link.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return out


def check(spark, texts, libraries, **sizes):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, pairs string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in alignment.align_documents(df, **sizes).collect()}
    want = plain(texts, libraries)
    assert [got[i] for i in range(len(texts))] == want


def test_whole_table(spark, libraries):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in alignment.op12_token_alignment(spark, SF).collect()}
    want = plain([r["text"] for r in rows], libraries)
    assert [got[r["doc_id"]] for r in rows] == want


ODD = [
    None, "", " ", "\n", "a", "▁", "a ▁ b", "<|endoftext|> <s> <0x41>", "é😀ß 漢字かな", "z" * 3000, " " * 500, "\t x \r\n\x00", "aaa bbb" * 400,
    "the cat", "the cat", "  leading", "trailing  ", "é‍ﬁ x", "日本語" * 200, "1234567890" * 30,
]


def test_odd_texts(spark, libraries):
    rnd = random.Random(4)
    parts = ["a", "the ", " of", "ing", "\n", "  ", "é", "😀", "漢", "0", "12", "<s>", "_", "▁", "Straße", ".", "zz", " "]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(300)]
    check(spark, texts, libraries)


def test_small_buckets_and_pieces(spark, libraries, monkeypatch):
    texts = ["the cat sat on the mat " * 20 + str(i % 7) for i in range(120)] + ODD
    check(spark, texts, libraries, bucket_pairs=3, piece_pairs=40)


def test_large_groups_are_expanded_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    ids_a, ids_b = rng.integers(0, 50, 900), rng.integers(0, 40, 800)
    cut = tuple(np.array(x) for x in ([0, 300, 301], [300, 1, 599], [0, 500, 501], [500, 1, 299]))
    doc = np.array([0, 0, 1])
    want = Counter((int(d), int(a) * 40 + int(b)) for d, i, n, j, m in zip(doc, *cut, strict=True) for a in ids_a[i : i + n] for b in ids_b[j : j + m])
    for step in (1, 70, 1 << 20):
        monkeypatch.setattr(alignment, "_LINKS_AT_ONCE", step)
        d, p, n = alignment.pair_counts(doc, ids_a, ids_b, cut, 50, 40)
        assert {(x, y): z for x, y, z in zip(d.tolist(), p.tolist(), n.tolist(), strict=True)} == want


def test_counts_flushed_by_a_task(spark, libraries, monkeypatch):
    # a task that may hold few pairs hands them on more often; closures carry the module's value to the workers
    monkeypatch.setattr(alignment, "_HELD", 50)
    check(spark, ["the cat sat on the mat", "a mat", "the mat and the cat"] * 30, libraries)
