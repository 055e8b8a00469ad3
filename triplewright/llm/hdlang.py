"""Language identification with hyperdimensional profiles.

Every letter has a fixed pseudo-random vector of +1 and -1. A trigram is the
elementwise product of its letters' vectors, each rotated by its place; a
document is the sum of the vectors of its trigrams, each word closed by a space
on both sides. The prototype of a language is the sum of the unit vectors of
its training documents. A document gets the language whose prototype has the largest cosine.

All labelled training rows are used. Partial sums are built per task, so what
is shuffled is one vector per language and task.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and no cosine; without any training row every text is ``und``; ties go to the
language first in order; repeated rows get the same answer; an empty table
gives an empty result; other columns of the input are ignored. More than
``MAX_LANGUAGES`` different languages raise an error, never drop one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import fold, read, slices

DIMENSIONS = 1024
SHARPNESS = 20.0
UNKNOWN = "und"
NOISE = 4.0  # standard deviations of the cosine of unrelated vectors; less is no likeness
JUDGED = 20  # distinct trigrams below which a text is too short to be called unlike every language
MAX_LANGUAGES = 4096  # bound on what is broadcast: so many vectors of DIMENSIONS floats
_CHARS_AT_ONCE = 1 << 18
_TEXTS_AT_ONCE = 256
_CELLS_AT_ONCE = 1 << 20
_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to the code point of its lower-case letter, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


@lru_cache(maxsize=20_000)
def _letter_vector(code: int, dims: int) -> np.ndarray:
    return (np.random.default_rng([code, dims]).integers(0, 2, dims, dtype=np.int8) * 2 - 1).astype(np.int8)


def _trigram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    """One row per trigram (three code points): permuted letter vectors, bound by product."""
    codes, at = np.unique(grams, return_inverse=True)
    at = at.reshape(grams.shape)
    table = np.stack([_letter_vector(int(c), dims) for c in codes])
    return np.roll(table, 2, axis=1)[at[:, 0]] * np.roll(table, 1, axis=1)[at[:, 1]] * table[at[:, 2]]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct trigrams of the texts, and for every occurrence the place of its trigram among them and its text."""
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths)
    low = _letters()[codes]
    # runs of what is no letter become one space, so words are closed on both sides
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 0) | (low[:-1] != 0)
    low = low[keep]
    owner = np.concatenate([[0], owner])[keep] if len(texts) else owner
    alphabet, dense = np.unique(low, return_inverse=True)
    size = len(alphabet)
    # windows of three with a letter in the middle or two letters; a window belongs to the text of its middle
    mid = dense[1:-1]
    ok = low[1:-1] != 0
    key = (dense[:-2] * size + mid) * size + dense[2:]
    key, own = key[ok], owner[1:-1][ok]
    if size**3 <= 1 << 24:
        present = np.zeros(size**3, bool)
        present[key] = True
        used = np.flatnonzero(present)
        column = np.zeros(size**3, np.int32)
        column[used] = np.arange(len(used))
        column = column[key]
    else:
        used, column = np.unique(key, return_inverse=True)
    return alphabet[np.stack([used // (size * size), used // size % size, used % size], axis=1)], column, own


def _gram_sums(texts: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors of each text's trigrams, and whether it has a letter.

    Counts are a dense matrix of texts and trigrams, some trigrams at a time: at most twice ``_CELLS_AT_ONCE`` cells,
    however many different characters the texts hold.
    """
    grams, column, own = _grams(texts)
    n, sums = len(texts), np.zeros((len(texts), dims), np.float32)
    step = max(1, _CELLS_AT_ONCE // max(dims, n))
    width = len(grams) if n * len(grams) <= 2 * _CELLS_AT_ONCE else step  # trigrams counted at once
    if width < len(grams):
        order = np.argsort(column, kind="stable")
        column, own = column[order], own[order]
    for at in range(0, len(grams), width):
        begin, end = np.searchsorted(column, (at, at + width)) if width < len(grams) else (0, len(column))
        some = min(width, len(grams) - at)
        counts = np.bincount(own[begin:end] * some + (column[begin:end] - at), minlength=n * some).reshape(n, some).astype(np.float32)
        for k in range(0, some, step):
            sums += counts[:, k : k + step] @ _trigram_vectors(grams[at + k : at + min(k + step, some)], dims).astype(np.float32)
    return sums, np.bincount(own, minlength=n) > 0


def _pieces(text: str) -> Iterator[str]:
    """A long text cut at spaces; no trigram with a letter in the middle reaches across one."""
    while len(text) > _CHARS_AT_ONCE:
        at = text.rfind(" ", 0, _CHARS_AT_ONCE)
        at = at if at > 0 else text.find(" ", _CHARS_AT_ONCE)
        if at < 0:
            break
        yield text[:at]
        text = text[at:].lstrip(" ")
    yield text


def document_vectors(texts: list[str], dims: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the texts (zero without letters), and whether each has a letter."""
    out, has = np.zeros((len(texts), dims), np.float32), np.zeros(len(texts), bool)
    parts = [(n, p) for n, t in enumerate(texts) for p in _pieces(t)]
    at = 0
    while at < len(parts):
        end, chars = at, 0
        while end < len(parts) and end - at < _TEXTS_AT_ONCE and (end == at or chars + len(parts[end][1]) <= _CHARS_AT_ONCE):
            chars += len(parts[end][1])
            end += 1
        if chars:
            owners = np.array([n for n, _ in parts[at:end]])
            sums, letters = _gram_sums([p for _, p in parts[at:end]], dims)
            np.add.at(out, owners, sums)
            np.logical_or.at(has, owners, letters)
        at = end
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm), has


def train_profiles(rows: DataFrame, dims: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names and their prototypes, from all rows of (text, lang) with a text and a language."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, 2048):
            vectors, _ = document_vectors(b.column(0).to_pylist(), dims)
            langs = np.array(b.column(1).to_pylist(), object)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"]
        )

    known = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null")
    parts = known.mapInArrow(partial, "lang string, v array<double>")
    # summed place by place, so that no task holds the partial vectors of a language together
    cells = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"])
    summed = cells.groupBy("lang").agg(whole.alias("v"))
    got = summed.limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    got.sort(key=lambda r: r["lang"])
    names = [r["lang"] for r in got]
    m = np.array([r["v"] for r in got], np.float64).reshape(len(names), dims)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return names, (m / np.where(norm == 0, 1, norm)).astype(np.float32)


def predictor(names: list[str], profiles: np.ndarray, sharpness: float = SHARPNESS) -> Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]]:
    """A function from texts to (language, score in 0..1, cosine)."""
    dims = profiles.shape[1]

    def predict(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        vectors, has = document_vectors(texts, dims)
        if not names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        cosine = (vectors @ profiles.T).astype(np.float64)
        best = cosine.argmax(axis=1) if len(texts) else np.zeros(0, int)
        top = cosine[np.arange(len(texts)), best]
        score = 1 / np.exp(sharpness * (cosine - top[:, None])).sum(axis=1)
        return [names[k] if h else UNKNOWN for k, h in zip(best, has, strict=True)], np.where(has, score, 0.0), np.where(has, top, 0.0)

    return predict


def identify(docs: DataFrame, names: list[str], profiles: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, cosine) for every row."""
    predict = predictor(names, profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            lang, score, cosine = predict([x or "" for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(cosine)], names=["doc_id", "lang_pred", "score", "cosine"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, cosine double")


def distinct_trigrams(text: str, most: int) -> int:
    """How many different trigrams a text has, counted up to ``most``."""
    low, seen = _letters(), set()
    for word in _LETTERS.findall(text):
        codes = [0, *(int(low[ord(c)]) for c in word), 0]
        seen.update(zip(codes, codes[1:], codes[2:], strict=False))
        if len(seen) >= most:
            return most
    return len(seen)


def resembles(texts: list[str], cosine: np.ndarray, dims: int) -> list[bool]:
    """Whether each text's largest cosine is above the noise, or the text has too few distinct trigrams to be judged.

    Unrelated vectors have cosines of standard deviation ``1 / sqrt(dims)``, and few trigrams, often repeated, come close to
    a prototype only by chance even in their own language.
    """
    bound = NOISE / np.sqrt(dims)
    return [bool(c > bound or distinct_trigrams(t, JUDGED) < JUDGED) for t, c in zip(texts, cosine.tolist(), strict=True)]


def keep_known(docs: DataFrame, names: list[str], profiles: np.ndarray) -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language: it has letters and resembles a prototype.

    Null and empty texts have none and go; repeated rows stay or go together; a row is judged by its text alone, so nulls and
    clashing names in other columns do not matter; without any prototype no row stays; an empty table gives an empty result.
    """
    predict, at, dims = predictor(names, profiles), docs.columns.index("text"), profiles.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            texts = [x or "" for x in b.column(at).to_pylist()]
            lang, _, cosine = predict(texts)
            yield b.filter(pa.array([k != UNKNOWN and r for k, r in zip(lang, resembles(texts, cosine, dims), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 4) != 2)


def op10_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    names, profiles = train_profiles(training_rows(docs))
    found = identify(docs, names, profiles)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "cosine")
