"""Disguised words inside runs: set apart, without spaces, or stretched over any length."""

from __future__ import annotations

import math

import numpy as np
import pytest

from triplewright.llm import toxicity

TEXT = "you are a stupid idiot and a pathetic loser but the other words here are fine"


@pytest.fixture(scope="module")
def known(spark):
    docs = spark.createDataFrame([(i, TEXT) for i in range(30)], "doc_id long, text string")
    return toxicity.language_model(toxicity.trigram_counts(docs)).tolist(), toxicity.word_shares(docs)


@pytest.mark.parametrize(
    "given, words",
    [
        ("a i d i o t", {"a", "idiot"}),
        ("a s t u p i d i d i o t", {"a", "stupid", "idiot"}),
        ("s.t.u.p.i.d.i.d.i.o.t", {"stupid", "idiot"}),
        ("a " + "5 t u p 1 d 1 d 1 0 t", {"stupid", "idiot"}),
        ("idi" + "o" * 60 + "t", {"idiot"}),
        ("5tupi" + "d" * 60, {"stupid"}),
        ("youareastupididiotandapatheticloserbuttheotherwords", {"stupid", "idiot", "loser"}),
        (".".join("youareastupididiotandapatheticloser"), {"stupid", "idiot", "loser"}),
    ],
)
def test_words_of_a_run(known, given, words):
    model, shares = known
    got = {w for t in toxicity.restore(given, model, {}, shares) for w in t.split(" ")}
    assert words <= got


@pytest.fixture(scope="module")
def larger(spark):
    """Counted words and letters of a table of documents, with some sentences in it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10**6 + i, f"you are {w} and my friend is really {w} too") for i in range(4) for w in ("idiot", "stupid", "worthless")], "doc_id long, text string"))
    return toxicity.language_model(toxicity.trigram_counts(docs)).tolist(), toxicity.word_shares(docs)


@pytest.mark.parametrize("spare", range(0, 30))
def test_no_length_decides(larger, spare):
    # 36 letters and more: the words are found whatever the length of the run
    model, shares = larger
    for run in ("youareanidiotandyouarestupidmyfriend" + "really"[: spare % 7], "stupididiot" + "and" * (spare // 3) + "worthless"):
        got = set(toxicity.restore_token(run, model, shares).split(" "))
        assert "idiot" in got and got & {"stupid", "worthless"}, (run, got)


def test_a_word_of_any_length(larger):
    model, shares = larger
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    assert toxicity.restore_token(long, model, toxicity.CountedWords({**shares, long: -9.0})) == long
    assert long in toxicity.restore_token("stupid" + long, model, toxicity.CountedWords({**shares, long: -9.0})).split(" ")


def test_counted_words_stay_whole(larger):
    model, shares = larger
    for word in shares:
        assert toxicity.restore_token(word, model, shares) == word


def test_a_single_word_stays_whole(known):
    model, shares = known
    for word in ("idiot", "pathetic", "loser", "stupid"):
        assert toxicity.restore(" ".join(word), model, {}, shares) == [word]


def test_long_tokens_end(known):
    model, shares = known
    for token in ("!" * 100_000 + "a1" + "?" * 100_000 + "b", "z" * 150_000, "1" * 50_000 + "a", "-a" * 30_000):
        assert toxicity.restore(token, model, {}, shares) is not None
    assert math.isclose(sum(map(math.exp, shares.values())), 1.0)


@pytest.mark.parametrize("no_spaces", [0.0, toxicity.NO_SPACES])
def test_runs_split_together_are_split_as_alone(larger, no_spaces):
    model, shares = larger
    rng, some = np.random.default_rng(7), sorted(shares)
    runs = ["".join(rng.choice(some, rng.integers(1, 9))) for _ in range(300)]
    runs += ["".join(rng.choice(list("aeinrstäßжŋ語"), rng.integers(0, 12))) for _ in range(300)]
    runs += ["", "a", "ab", "youareanidiot", "x" * toxicity.LONG_RUN, "youareanidiotandyouarestupid" * 3, *runs[:20]]
    for words in (shares, {}, {"idiot": -2.0, "an": -2.0}):
        got = toxicity.split_many(runs, np.array(model, float), words, no_spaces)
        assert got == [toxicity.split_words(r, model, words, no_spaces) for r in runs]
    assert toxicity.split_many([], np.array(model, float), shares) == []


def test_tokens_restored_together_are_restored_as_alone(larger):
    model, shares = larger
    tokens = sorted({t for text in (TEXT, "Y0u are st00000pid, (idiot) s.t.u.p.i.d youareanidiot! @idiot idiot$$$ ...idiot... !!!wow!!! http://a.b/c 12.5 naïve… ") for t in text.split()})
    tokens += ["youareanidiot.", "“idiot”", "idiot'", "'", ".", "a.", "İdiot", "ſtupid", "iiiidiot)"]
    got = toxicity.restore_tokens(tokens, model, np.array(model, float), shares)
    assert got == [toxicity.restore_token(t, model, shares) for t in tokens]


def test_blocks_hold_all_texts_in_order():
    texts = ["", "a" * toxicity.CELLS, "b", "c" * (2 * toxicity.CELLS), "d" * 10, ""]
    found = list(toxicity.blocks(texts))
    assert [t for b in found for t in b] == texts and len(found) > 2
    assert all(len(b) == 1 or sum(map(len, b)) <= toxicity.CELLS for b in found)
    assert list(toxicity.blocks([])) == []
