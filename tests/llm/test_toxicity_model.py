"""The decoder against all paths of a lattice, and weights and scores against plain Python."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright.llm import toxicity

SF = "/root/testdata/sf0.01"


def spelled(letters, model):
    p = q = total = 0
    for c in letters + "\0":
        k = 0 if c == "\0" else toxicity._CODE.get(c, toxicity.OTHER)
        total += model[p][q][k]
        p, q = q, k
    return total


@pytest.mark.parametrize("token", ["1d10t", "$tup1d", "m0r*n", "iiidddiot!", "l0o0o5er", "ssttuuppid", "#!|d", "é1£", "b00kk33p3r", "(4+", "----a", "1"])
def test_viterbi_is_the_best_of_all_paths(spark, token):
    docs = spark.createDataFrame([(i, "idiot stupid moron loser bookkeeper cat and the other words tool oil lie") for i in range(30)], "doc_id long, text string")
    model = toxicity.language_model(toxicity.trigram_counts(docs)).tolist()
    paths = [("".join(x for x, _ in path), -sum(cost for _, cost in path)) for path in itertools.product(*toxicity.lattice(token))]
    best = max(spelled(letters, model) + cost for letters, cost in paths)
    got = toxicity.viterbi(token, model)
    assert math.isclose(max(spelled(letters, model) + cost for letters, cost in paths if letters == got), best, abs_tol=1e-6)


@pytest.mark.parametrize("run", ["youareanidiot", "catstool", "xq", "a", "lieslie", "idiotidiotz", "éalie"])
@pytest.mark.parametrize("no_spaces", [0.0, 3.0, 7.0])
def test_split_is_the_best_of_all_cuts(spark, run, no_spaces):
    docs = spark.createDataFrame([(i, "you are an idiot and the cat is on a tool and oil is a lie; cats lie") for i in range(5)], "doc_id long, text string")
    model, words = toxicity.language_model(toxicity.trigram_counts(docs)).tolist(), toxicity.word_shares(docs)

    def chance(word):
        other = math.log(1 - toxicity.KNOWN) + spelled(word, model)
        share = words.get(word)
        return max(other, share + math.log(toxicity.KNOWN)) if share is not None else other

    def total(cut):
        return sum(map(chance, cut))

    cuts = []
    for at in itertools.product([False, True], repeat=len(run) - 1):
        ends = [i + 1 for i, x in enumerate(at) if x] + [len(run)]
        cuts.append([run[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    best, whole = max(map(total, cuts)), math.log(1 - toxicity.KNOWN) + spelled(run, model)
    got = toxicity.split_words(run, model, words, no_spaces)
    assert got == [run] if best - whole < no_spaces else math.isclose(total(got), best, abs_tol=1e-6)


def test_signs_around_and_inside_words(spark):
    docs = spark.createDataFrame([(i, "idiot moron and the other words here") for i in range(30)], "doc_id long, text string")
    model = toxicity.language_model(toxicity.trigram_counts(docs)).tolist()
    for given, words in (('"1d10t"', "idiot"), ("1d10t:", "idiot"), ("1d10t/m0r0n", "idiot moron"), ("word=1d10t", "word idiot"), ("https://1d10t.com/a", "https://1d10t.com/a")):
        assert toxicity.restore(given, model, {}) == [words], given


def test_weights_and_scores(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.train(docs, labels)
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5}
    rows = docs.select("doc_id", "text").collect()
    sample = {}
    for r in rows:
        if r["doc_id"] in marks and r["text"] is not None:
            sample[r["text"]] = max(sample.get(r["text"], 0), marks[r["doc_id"]])
    counts, sizes = (Counter(), Counter()), Counter(sample.values())
    for text, y in sample.items():
        words = {w for t in toxicity.restore(text, scorer.model, {}, scorer.words) for w in re.findall(r"[^\W\d_]+", t)}
        counts[y].update({f for w in words for f in [w[:k] for k in range(3, 11) if len(w) >= k] + [w + "$"]})
    base = sizes[1] / len(sample)
    want = {}
    for f in counts[1]:
        n, p = counts[0][f], counts[1][f]
        share = (p + base) / (n + p + 1)
        if share > base and 2 * p * math.log(share / base) >= toxicity.LEAST_SUPPORT:
            want[f] = math.log(((p + base) / sizes[1]) / ((n + 1 - base) / sizes[0]))
    assert want.keys() == scorer.weights.keys() and all(math.isclose(want[f], w, rel_tol=1e-9) for f, w in scorer.weights.items())

    def features(text):
        tokens = set(toxicity.restore(text, scorer.model, {}, scorer.words))
        held = []
        for t in tokens:
            fs = [f for w in re.findall(r"[^\W\d_]+", t) for f in [w[:k] for k in range(3, 11) if len(w) >= k] + [w + "$"]]
            held.append(max((want.get(f, 0.0) for f in fs), default=0.0))
        held.sort(reverse=True)
        return np.array([1.0, held[0] if held else 0.0, sum(held[:5]), math.log(1 + len(tokens))])

    x, y = np.array([features(t) for t in sample]), np.array(list(sample.values()))
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ scorer.beta))) - np.array([1e-3, 1, 1, 1]) * scorer.beta
    assert np.abs(slope).max() < 1e-3  # the ridge objective is flat at the fitted values
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, scorer).collect()}
    for r in rows:
        assert math.isclose(got[r["doc_id"]], 1 / (1 + math.exp(-features(r["text"] or "") @ scorer.beta)), abs_tol=1e-9)


def test_scores_do_not_depend_on_which_tokens_are_split_early(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scorer = toxicity.train(docs, labels)

    class Plain(toxicity.Scorer):
        def restored(self, text):
            return toxicity.restore(text, self.model, self.memo, self.words)

    texts = [r["text"] or "" for r in docs.limit(200).collect()] + ["", "youareastupididiot", "xq"]
    plain = Plain(scorer.model, scorer.weights, scorer.beta, scorer.prior, words=scorer.words)
    assert np.array_equal(scorer.scores(texts), plain.scores(texts))
    none = toxicity.Scorer(scorer.model, {}, scorer.beta, scorer.prior, words=scorer.words)
    assert len(none.scores(texts)) == len(texts)


def test_all_labelled_texts_are_learnt_from(spark):
    docs = spark.range(27_000).selectExpr("id as doc_id", "concat('text ', id div 2 * 2, if(id = 26998, ' rareinsult', '')) as text")
    labels = spark.range(27_000).selectExpr("id as doc_id", "cast(id % 50 = 0 as int) as toxic")
    got = {r["text"]: r["toxic"] for r in toxicity.labelled(docs, labels).collect()}
    want = {}
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5:
            want[r["text"]] = max(want.get(r["text"], 0), int(r["doc_id"] % 50 == 0))
    assert got == want
    doubled = docs.unionByName(docs)
    assert toxicity.labelled(doubled, labels).count() == len(want)


def test_words_of_all_texts_are_counted(spark):
    docs = spark.range(25_000).selectExpr("id as doc_id", "concat('some words ', if(id >= 24997, 'seldom', 'often')) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    words = toxicity.train(docs.withColumn("text", F.concat("text", F.lit(" "), "doc_id")), labels).words
    kept = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in (24_997, 24_998, 24_999))
    assert ("seldom" in words) == (kept >= toxicity.WORD_SUPPORT) and kept == 3


def test_weights_are_those_of_all_features_counted_over_all_texts(spark, monkeypatch):
    rows = [(f"vile vilest word{i % 7} the", 1) for i in range(30)] + [(f"the mild{i} word{i % 5} vigour w o r d", 0) for i in range(60)]
    known = spark.createDataFrame(rows, "text string, toxic int")
    table = toxicity.language_model(toxicity.trigram_counts(known)).tolist()
    words, base = toxicity.word_shares(known), 30 / 90
    p, n = Counter(), Counter()
    for text, toxic in rows:
        found = {f for t in toxicity.restore(text, table, {}, words) for w in toxicity._WORDS.findall(t) for f in toxicity.word_features(w)}
        (p if toxic else n).update(found)
    want = {}
    for f in p:
        share = (p[f] + base) / (p[f] + n[f] + 1)
        if share > base and 2 * p[f] * math.log(share / base) >= toxicity.LEAST_SUPPORT:
            want[f] = math.log(((p[f] + base) / 30) / ((n[f] + 1 - base) / 60))
    assert "vile$" in want and "the" not in want
    count, told = toxicity.feature_counts, []
    monkeypatch.setattr(toxicity, "feature_counts", lambda texts, table, words, kept=None: told.append(kept) or count(texts, table, words, kept))
    for most in (toxicity.MOST_KEPT, 1):  # with the features that may gain enough, and with all
        monkeypatch.setattr(toxicity, "MOST_KEPT", most)
        assert toxicity.feature_weights(known, table, words, 30, 60) == pytest.approx(want)
    assert want.keys() <= told[1] and not any(f.startswith("mild") for f in told[1]) and told[3] is None


def test_texts_are_described_once_for_the_fit_and_the_score(spark, monkeypatch):
    rows = [(i, "vile words here" if i % 4 == 0 else f"mild words {i % 9}") for i in range(80)] + [(3, None), (7, "mild words 7"), (7, "mild words 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic")).distinct()
    want = sorted(toxicity.score_documents(docs, toxicity.train(docs, labels)).collect())
    describe, told = toxicity.described, []
    monkeypatch.setattr(toxicity, "described", lambda texts, *rest: told.append(texts.count()) or describe(texts, *rest))
    got = sorted(toxicity.trained_scores(docs, labels).collect())
    assert told == [83]
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in want], abs=1e-12)
