"""Texts that resemble no learned language are told from short ones."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq

from triplewright.llm import hdlang


def test_an_unlearned_script_is_no_language():
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text", "lang"]).to_pylist()
    rows = [r for r in rows if r["text"] and r["lang"]]
    vectors, _ = hdlang.document_vectors([r["text"] for r in rows])
    names = sorted({r["lang"] for r in rows})
    sums = np.stack([vectors[[r["lang"] == n for r in rows]].sum(axis=0) for n in names])
    predict = hdlang.predictor(names, sums / np.linalg.norm(sums, axis=1, keepdims=True))

    def kept(texts):
        lang, _, cosine = predict(texts)
        return np.array(lang) != hdlang.UNKNOWN, np.array(hdlang.resembles(texts, cosine, hdlang.DIMENSIONS))

    rnd = random.Random(2)
    for letters in ("абвгдежзийклмнопрстуфхцчшщыэюя", "bcdfghjklmnpqrstvwxz"):
        noise = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(rnd.randrange(8, 200))) for _ in range(200)]
        assert kept(noise)[1].mean() < 0.02
    letters, like = kept([r["text"] for r in rows])
    assert like[letters].mean() > 0.995
    assert kept(["Re.", "A.", "я"])[1].all()
    assert hdlang.distinct_trigrams("Ab, ab 12 ab!", 99) == 2
