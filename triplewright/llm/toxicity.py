"""Toxicity scoring after noisy-channel deobfuscation.

A character trigram model is counted over all documents. A token that may be
disguised (leetspeak, letters set apart, letters repeated, masked letters)
becomes a lattice, however long it is: each character offers the letters that it may stand for, or
nothing, at a channel cost. Viterbi search finds the path with the best sum of
language-model and channel scores, and the text restored from these paths is
scored. Letters set apart, and every token that is no counted word, whatever its
length, may hold several words: they are split where counted words, the letter
model and the channel cost of leaving out spaces make it likeliest, and scored as
these words and as one. Tokens without a sign of disguise have one path, themselves.
Never decoded, but scored as they stand: tokens without a letter, and addresses and markup (``ADDRESS``).

The score is a logistic function of how strongly the words of the restored text
are tied to the toxic label: every word has the largest log-odds weight among
its beginnings and itself, and the model sees the largest, the sum of the
largest five, and the number of words. Weights, counted words and the score are fitted on
all distinct labelled texts.

Defined results: a null or empty text has no words and gets the model's score
for that; without both labels in training every score is the share of toxic
training rows (0 without any); repeated rows get equal scores; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import fold, materialise, read, slices

LEAST_SUPPORT = 20.0  # twice the log-likelihood that a weight must explain
THRESHOLD = 0.5
WORD_SUPPORT = 3  # times that a word must stand in the labelled texts to be a counted word
LEAST_SHARE = 3e-7  # share of all words that a counted word must have, which bounds the dictionary of a task
MEMO = 200_000  # tokens that a task remembers
MOST_KEPT = 200_000  # features of toxic texts that a task tells apart while it counts those of clean texts
CELLS = 1 << 19  # places of runs that are split together, which bounds the arrays
LONG_RUN = 64  # runs of more letters are split one at a time, with the same result
PREFIXES = range(3, 11)

_OPEN = [chr(c) for c in range(ord("a"), ord("z") + 1)] + [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
SIZE = 64
_CODE = {c: i + 1 for i, c in enumerate(_OPEN)}  # 0 is the edge of a word
OTHER = SIZE - 1

# What a character may stand for beside itself (fixed values of the channel).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou",
}
SUBSTITUTE, MASK, DROP, DROP_SIGN, SQUEEZE, UNDOUBLE, NO_SPACES = 1.0, 2.5, 7.0, 2.0, 0.5, 5.0, 7.0
KNOWN = 0.95  # weight of the counted words, beside the letter model, where a run of letters is split into words

_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .*_-][^\W_]){2,}(?!\S)")
_APART = re.compile(r"[^\W_](?:([.*_\-,~])[^\W_])(?:\1[^\W_])+")
_REPEAT = re.compile(r"([^\W\d_])\1\1")
_RUNS = re.compile(r"(.)\1{2,}")
_WORDS = re.compile(r"[^\W\d_]+")
_MARKS = ".,;:!?()\"'"  # signs that disguise nothing at the ends of a word
ADDRESS = re.compile(r"://|=[\"']|/[^/]*/|^www\.")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point to model letter: 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = _CODE.get(chr(c).lower()[0], OTHER)
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams, word edges included, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 256):
                joined = "  ".join(["", *(t or "" for t in texts[at : at + 256]), ""])
                x = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
                # between words two edges stand, so that each word begins and ends in the same way
                gap = np.flatnonzero(x == 0)
                x = np.insert(x, gap, 0)
                total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["gram", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram int, n long")
    out = np.zeros(SIZE**3)
    for r in parts.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most SIZE ** 3 rows
        out[r["gram"]] = r["n"]
    out = out.reshape(SIZE, SIZE, SIZE)
    out[0, 0, 0] = 0
    return out


def language_model(counts: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """Log-probability of a letter after two others, backed off to shorter histories."""
    one = counts.sum(axis=(0, 1)) + 1.0
    one /= one.sum()
    pairs = counts.sum(axis=0)
    two = (pairs + strength * one) / (pairs.sum(axis=1, keepdims=True) + strength)
    three = (counts + strength * two[None]) / (counts.sum(axis=2, keepdims=True) + strength)
    return np.log(three).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-case token, the letters it may stand for and their channel costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c = token[i]
        run = 1
        while i + run < len(token) and token[i + run] == c:
            run += 1
        if c.isalpha():
            if run == 1:
                out.append([(c, 0.0)])
            elif run == 2:
                out.append([(c + c, 0.0), (c, UNDOUBLE)])
            else:
                out.append([(c, SQUEEZE), (c + c, SQUEEZE + 0.5)])
        elif c in LEET:
            cost = MASK if len(LEET[c]) > 2 else SUBSTITUTE
            for _ in range(min(run, 2)):
                out.append([(x, cost) for x in LEET[c]] + [("", DROP if c.isdigit() or c in "@$" else DROP_SIGN)])
        else:
            out.append([("", 0.2)])
        i += run
    return out


def viterbi(token: str, model: list) -> str:
    """The letters that the token most likely disguises. ``model`` is ``language_model().tolist()``."""
    # state: the last two letters; value: score so far and the letters as a chain, so that long tokens cost no more a letter
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in [*lattice(token), [("\0", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in states.items():
            for letters, cost in options:
                p, q, s = a, b, score - cost
                for c in letters:
                    k = 0 if c == "\0" else _CODE.get(c, OTHER)
                    s += model[p][q][k]
                    p, q = q, k
                got = after.get((p, q))
                if got is None or s > got[0]:
                    after[p, q] = (s, (chain, letters) if letters else chain)
        states = after
    best = max(score for score, _ in states.values())
    return max(_chained(chain) for score, chain in states.values() if score == best).rstrip("\0")


def _chained(chain: tuple | None) -> str:
    out = []
    while chain:
        chain, letters = chain
        out.append(letters)
    return "".join(reversed(out))


def _without_junk(token: str) -> str:
    """The token without a sign that stands three times or more at its beginning or end."""
    for at in (0, -1):
        if token and not token[at].isalnum() and token[at] != "_":
            short = token.lstrip(token[0]) if at == 0 else token.rstrip(token[-1])
            token = short if len(token) - len(short) > 2 else token
    return token


def _core(token: str) -> str:
    """The token without what is no letter or digit at both ends."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b]


class CountedWords(dict):
    """Log-shares by word, and where the words stand in a run of letters."""

    _found = None
    _undisguised = None

    @property
    def undisguised(self) -> frozenset[str]:
        """The words that show no sign of disguise, which stay as they are."""
        if self._undisguised is None:
            self._undisguised = frozenset(w for w in self if w.isalpha() and not _REPEAT.search(w))
        return self._undisguised

    def __reduce__(self):
        return CountedWords, (dict(self),)

    def _automaton(self) -> ahocorasick.Automaton:
        if self._found is None:
            self._all = list(self)
            self._lengths = np.array([len(w) for w in self._all], np.int64)
            self._shares = np.array(list(self.values()), float) + math.log(KNOWN)
            self._found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for at, word in enumerate(self._all):
                self._found.add_word(word, at)
            self._found.make_automaton()
        return self._found

    def inside(self, letters: str) -> Iterator[tuple[int, str]]:
        """(place of the last letter, word) for every counted word inside a run, in time linear in both, by an automaton over all words."""
        if self:
            found = self._automaton()
            for j, at in found.iter(letters):
                yield j, self._all[at]

    def places(self, joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last places, lengths and weighted log-shares of all counted words inside a text, in the order of ``inside``."""
        found = np.fromiter(self._automaton().iter(joined) if self else (), [("end", np.int64), ("word", np.int64)])
        at = found["word"]
        return (found["end"], self._lengths[at], self._shares[at]) if len(at) else (at, at, np.zeros(0))


def split_words(letters: str, model: list, words: dict[str, float], no_spaces: float = 0.0) -> list[str]:
    """The words that a run of letters most likely holds, an edge being possible at every place; one, if several gain less than ``no_spaces``.

    A word's chance is the better of its share among the counted ``words`` and that of the letter model. Words of any length
    are tried: what the letter model says of a word is a difference of sums along the run, so the best start of a word that
    is not counted is one running maximum, and counted words are found by an automaton.
    """
    n, codes = len(letters), [_CODE.get(c, OTHER) for c in letters]
    if not n:
        return []
    words = words if isinstance(words, CountedWords) else CountedWords(words)
    begin = model[0][0]
    spell, count = math.log(1 - KNOWN), math.log(KNOWN)
    known: list[list[tuple[int, float]] | None] = [None] * n
    for j, word in words.inside(letters):
        found = (j - len(word) + 1, words[word] + count)
        if known[j] is None:
            known[j] = [found]
        else:
            known[j].append(found)
    first = codes[0]
    best, back = [0.0, spell + begin[first] + model[0][first][0]], [0, 0]
    for i, share in known[0] or ():
        if share > best[1]:
            best[1] = share
    run, far, begun = 0.0, -math.inf, 0  # the letter model along the run from the third letter on; the best start of a word that is not counted
    p = first
    for j in range(1, n):
        q = codes[j]
        after = model[p][q]
        if j > 1:
            run += model[codes[j - 2]][p][q]
        opened = best[j - 1] + spell + begin[p] + model[0][p][q] - run
        if opened > far:
            far, begun = opened, j - 1
        top, at = far + run + after[0], begun
        alone = best[j] + spell + begin[q] + model[0][q][0]
        if alone > top:
            top, at = alone, j
        if known[j] is not None:
            for i, share in known[j]:
                if best[i] + share > top:
                    top, at = best[i] + share, i
        best.append(top)
        back.append(at)
        p = q
    whole = best[1] if n == 1 else spell + begin[first] + model[0][first][codes[1]] + run + model[codes[-2]][codes[-1]][0]
    if best[n] - whole < no_spaces:
        return [letters]
    out = []
    while n:
        out.append(letters[back[n] : n])
        n = back[n]
    return out[::-1]


def split_many(runs: list[str], model: np.ndarray, words: dict[str, float], no_spaces: float = 0.0) -> list[list[str]]:
    """``split_words`` of many runs, all at one place of their letters at a time; ``model`` is an array of doubles."""
    words = words if isinstance(words, CountedWords) else CountedWords(words)
    out: list[list[str]] = [[r] if r else [] for r in runs]
    order = sorted((k for k, r in enumerate(runs) if 0 < len(r) <= LONG_RUN), key=lambda k: -len(runs[k]))
    for k, r in enumerate(runs):
        if len(r) > LONG_RUN:
            out[k] = split_words(r, model, words, no_spaces)
    while order:
        most = max(1, CELLS // len(runs[order[0]]))
        for k, split in zip(order[:most], _split_block([runs[k] for k in order[:most]], model, words, no_spaces), strict=True):
            out[k] = split
        order = order[most:]
    return out


def _split_block(runs: list[str], model: np.ndarray, words: CountedWords, no_spaces: float) -> list[list[str]]:
    """Runs of falling length, none empty; the sums are those of ``split_words``, in the same order."""
    lengths = np.array([len(r) for r in runs])
    rows, width = len(runs), int(lengths[0])
    joined = "\n".join(runs)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = np.full(0x101, OTHER, np.int64)
    letter[[ord(c) for c in _CODE]] = list(_CODE.values())
    codes = np.zeros((rows, width), np.int64)
    inside = np.arange(width) < lengths[:, None]
    codes[inside] = letter[np.minimum(points[points != 10], 0x100)]

    ends, sizes, shares = words.places(joined)
    owner = np.searchsorted(starts, ends, "right") - 1
    ends = ends - starts[owner] if len(ends) else ends
    by_end = np.argsort(ends, kind="stable")
    cuts = np.searchsorted(ends[by_end], np.arange(width + 1))

    spell = math.log(1 - KNOWN)
    begin = model[0][0]
    best, back = np.zeros((rows, width + 1)), np.zeros((rows, width + 1), np.int64)
    first = codes[:, 0]
    best[:, 1] = spell + begin[first] + model[0, first, 0]
    at = by_end[cuts[0] : cuts[1]]
    np.maximum.at(best[:, 1], owner[at], shares[at])
    run, far, begun = np.zeros(rows), np.full(rows, -np.inf), np.zeros(rows, np.int64)
    for j in range(1, width):
        n = int(np.searchsorted(-lengths, -j, "left"))  # runs with more than j letters stand first
        p, q = codes[:n, j - 1], codes[:n, j]
        if j > 1:
            run[:n] += model[codes[:n, j - 2], p, q]
        opened = best[:n, j - 1] + spell + begin[p] + model[0, p, q] - run[:n]
        better = opened > far[:n]
        far[:n][better], begun[:n][better] = opened[better], j - 1
        top, where = far[:n] + run[:n] + model[p, q, 0], begun[:n].copy()
        alone = best[:n, j] + spell + begin[q] + model[0, q, 0]
        better = alone > top
        top[better], where[better] = alone[better], j
        at = by_end[cuts[j] : cuts[j + 1]]
        if len(at):
            row, start = owner[at], j + 1 - sizes[at]
            value = best[row, start] + shares[at]
            put = np.lexsort((-value, row))  # the best of a run first, the first found of equal ones
            put = put[np.concatenate([[True], row[put][1:] != row[put][:-1]])]
            put = put[value[put] > top[row[put]]]
            top[row[put]], where[row[put]] = value[put], start[put]
        best[:n, j + 1], back[:n, j + 1] = top, where
    whole = best[:, 1].copy()
    more = lengths > 1
    if width > 1:
        last = np.arange(rows), lengths - 1
        ending = model[codes[np.arange(rows), np.maximum(lengths - 2, 0)], codes[last], 0]
        whole[more] = (spell + begin[first] + model[0, first, codes[:, 1]] + run + ending)[more]
    several = best[np.arange(rows), lengths] - whole >= no_spaces
    out = []
    for k, r in enumerate(runs):
        if not several[k]:
            out.append([r])
            continue
        n, parts = len(r), []
        while n:
            parts.append(r[back[k, n] : n])
            n = int(back[k, n])
        out.append(parts[::-1])
    return out


def restore_run(run: str, model: list, words: dict[str, float], no_spaces: float = 0.0) -> str:
    """A run without spaces: the words it holds and, if they are several, the run as one word too."""
    one = viterbi(run, model) if not run.isalpha() or _REPEAT.search(run) else run
    split = split_words(one, model, words, no_spaces)
    return one if len(split) < 2 else " ".join([*split, one])


def restore_token(token: str, model: list, words: dict[str, float] | None = None, telling: ahocorasick.Automaton | None = None) -> str:
    """A white-space token in lower case, restored if it may be disguised.

    With ``telling``, an automaton, only tokens that hold one of its strings are split into words: no other can have a part that starts with one.
    """
    low, words = token.lower(), words or {}
    if low.isalpha() and not _REPEAT.search(low):
        return _split(low, model, words, telling)
    low = _without_junk(low)
    core = _core(low)
    if core.isalpha() and not _REPEAT.search(core):
        rest = low[low.find(core) + len(core) :] if core else ""
        if not any(c in "@$|+€" for c in rest) and not any(c in "@$€" for c in low[: low.find(core)]):
            return _split(core, model, words, telling)
    if _APART.fullmatch(core):
        return restore_run("".join(c for c in core if c.isalnum() or c in LEET and c != "*"), model, words)
    if ADDRESS.search(low) or not any(c.isalpha() for c in low):
        return low
    inner = low if any(c in "@$|+€" for c in low) else core
    if any(c in LEET for c in inner) or _REPEAT.search(inner):
        return " ".join(_part(p, model, words, telling) for p in re.split(r"[-.,;_?&'/:=\"]+", inner) if p)
    return low


def _part(part: str, model: list, words: dict[str, float], telling: ahocorasick.Automaton | None = None) -> str:
    """A part of a token, restored where it is disguised, and split into words where it is none that is counted."""
    one = viterbi(part, model) if any(x in LEET for x in part) or _REPEAT.search(part) else part
    return _split(one, model, words, telling) if one.isalpha() else one


def _split(one: str, model: list, words: dict[str, float], telling: ahocorasick.Automaton | None = None) -> str:
    """A token of letters, split where it is no counted word."""
    if not words or one in words or telling is not None and next(telling.iter(one), None) is None:
        return one
    return restore_run(one, model, words, NO_SPACES)


def restore_tokens(
    tokens: list[str], model: list, grid: np.ndarray, words: dict[str, float], telling: ahocorasick.Automaton | None = None
) -> list[str]:
    """``restore_token`` of many tokens; words without a sign of disguise are split together. ``grid`` is ``model`` as an array."""
    out: list[str | None] = []
    runs: list[str] = []
    undisguised = words.undisguised if isinstance(words, CountedWords) else frozenset()
    for t in tokens:
        core = t.lower().strip(_MARKS)
        if core in undisguised:
            out.append(core)
        elif not core.isalpha() or _REPEAT.search(core):
            out.append(restore_token(t, model, words, telling))
        elif not words or core in words or telling is not None and next(telling.iter(core), None) is None:
            out.append(core)
        else:
            out.append(None)
            runs.append(core)
    splits = iter(zip(runs, split_many(runs, grid, words, NO_SPACES), strict=True))
    for k, r in enumerate(out):
        if r is None:
            core, split = next(splits)
            out[k] = core if len(split) < 2 else " ".join([*split, core])
    return out


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, those of up to ``CELLS`` characters together."""
    block: list[str] = []
    size = 0
    for text in texts:
        if block and size + len(text) > CELLS:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def restore_ahead(
    texts: list[str], model: list, grid: np.ndarray, memo: dict[str, str], words: dict[str, float], telling: ahocorasick.Automaton | None = None
) -> None:
    """Put the tokens of a block of texts into ``memo``, all at once."""
    if len(memo) > MEMO:
        memo.clear()
    new = list(set().union(*(t.split() for t in texts)).difference(memo))
    memo.update(zip(new, restore_tokens(new, model, grid, words, telling), strict=True))


def restore(
    text: str, model: list, memo: dict[str, str], words: dict[str, float] | None = None, telling: ahocorasick.Automaton | None = None
) -> list[str]:
    """Restored tokens of a text."""
    tokens, apart = _taken_apart(text, model, words)
    for t in set(tokens).difference(memo):
        memo[t] = restore_token(t, model, words, telling)
    return [memo[t] for t in tokens] + apart


def restored_set(text: str, model: list, memo: dict[str, str], words: dict[str, float] | None = None, telling: ahocorasick.Automaton | None = None) -> set[str]:
    """The different tokens among those of ``restore``."""
    tokens, apart = _taken_apart(text, model, words)
    different = set(tokens)
    for t in different.difference(memo):
        memo[t] = restore_token(t, model, words, telling)
    return {memo[t] for t in different}.union(apart)


def _taken_apart(text: str, model: list, words: dict[str, float] | None) -> tuple[list[str], list[str]]:
    """The tokens of a text without its spaced words, and the words restored from these."""
    apart = []

    def join(m: re.Match) -> str:
        apart.extend(restore_run("".join(c for c in m[0].lower() if c.isalnum()), model, words or {}).split(" "))
        return " "

    return _SPACED.sub(join, text).split(), apart


def restored_texts(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """(doc_id, restored): the text that is scored, tokens in order, spaced words at the end."""
    table, grid = model.tolist(), model.astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for b in slices(batches):
            out = []
            for texts in blocks([t or "" for t in b.column(1).to_pylist()]):
                restore_ahead(texts, table, grid, memo, {})
                out += [" ".join(restore(t, table, memo)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, restored string")


def word_features(word: str) -> list[str]:
    """Beginnings of a word, and the word with a closing mark."""
    return [word[:k] for k in PREFIXES if k <= len(word)] + [word + "$"]


@dataclass
class Scorer:
    """Everything that scoring a text needs."""

    model: list
    weights: dict[str, float]
    beta: np.ndarray | None
    prior: float
    memo: dict[str, str] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)
    strong: dict[str, float] = field(default_factory=dict)  # the known tokens whose weight is not 0
    words: dict[str, float] = field(default_factory=dict)
    telling: ahocorasick.Automaton | None = None
    grid: np.ndarray | None = None
    starts: frozenset[str] = frozenset()  # beginnings of the features, from three letters on, and the features that are shorter

    def __post_init__(self) -> None:
        bare = [f.rstrip("$") for f in self.weights]
        self.starts = frozenset(f[:k] for f in bare for k in range(min(3, len(f)), len(f) + 1))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "known": {}, "strong": {}, "telling": None, "grid": None}

    def _ahead(self, texts: list[str]) -> None:
        """Restore the tokens of a block of texts; those that hold nothing with a weight are not split, which changes no score."""
        if self.telling is None:
            self.grid = np.array(self.model, float)
            self.telling = ahocorasick.Automaton()
            for feature in self.weights or {"\0": 0.0}:
                self.telling.add_word(feature.rstrip("$"), 1)
            self.telling.make_automaton()
        restore_ahead(texts, self.model, self.grid, self.memo, self.words, self.telling)

    def restored(self, text: str) -> list[str]:
        """Restored tokens of a text."""
        return restore(text, self.model, self.memo, self.words, self.telling)

    def word(self, restored: str) -> float:
        """The largest weight among the features of its words."""
        if restored.isalpha():
            return self._weight(restored)
        return max((self._weight(w) for w in _WORDS.findall(restored)), default=0.0)

    def _weight(self, word: str) -> float:
        """The largest weight among ``word_features``, 0 without any; it ends where no feature goes on as the word does."""
        best, starts, weights = 0.0, self.starts, self.weights
        for k in range(3, len(word) + 1):
            start = word[:k]
            if start not in starts:
                return best
            if start in weights and k in PREFIXES and weights[start] > best:
                best = weights[start]
        return max(best, weights.get(word + "$", 0.0))

    def features(self, text: str) -> list[float]:
        tokens = restored_set(text, self.model, self.memo, self.words, self.telling)
        known, strong = self.known, self.strong
        if len(known) > MEMO:
            known.clear()
            strong.clear()
        for t in tokens.difference(known):
            v = known[t] = self.word(t)
            if v:
                strong[t] = v
        top = sorted((strong[t] for t in strong.keys() & tokens), reverse=True)
        return [1.0, top[0] if top else 0.0, sum(top[:5]), math.log1p(len(tokens))]

    def rows(self, texts: list[str]) -> np.ndarray:
        """A row of features for each text."""
        out = []
        for block in blocks(texts):
            self._ahead(block)
            out += [self.features(t) for t in block]
        return np.array(out, float).reshape(-1, 4)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.beta is None or not texts:
            return np.full(len(texts), self.prior)
        x = self.rows(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _logistic(rows: DataFrame, names: list[str], label: str, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first feature is the constant. A round moves the sums of a step only."""
    beta = np.zeros(len(names))
    penalty = np.full(len(names), ridge)
    penalty[0] = 1e-3
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    for _ in range(rounds):
        z = sum((F.col(n) * float(b) for n, b in zip(names, beta, strict=True)), F.lit(0.0))
        p = rows.select(*names, (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("__p"), F.col(label).alias("__y"))
        p = p.withColumn("__w", F.greatest(F.col("__p") * (1 - F.col("__p")), F.lit(1e-6)))
        slopes = [F.sum(F.col(n) * (F.col("__y") - F.col("__p"))) for n in names]
        got = np.array(p.agg(*slopes, *[F.sum(F.col("__w") * F.col(names[i]) * F.col(names[j])) for i, j in pairs]).first(), float)
        curve = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, got[len(names) :], strict=True):
            curve[i, j] = curve[j, i] = v
        step = np.linalg.solve(curve + np.diag(penalty), got[: len(names)] - penalty * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, doc_id, copy): all distinct texts with a label, of documents that are not held out; copies count once, as toxic if one of them is.

    ``doc_id`` is the first document of a text, ``copy`` the digest of the text.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("copy"), text.alias("text"))
    texts = texts.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    # one document of each text is chosen by digests, so that texts are moved once
    chosen = texts.select("doc_id", "copy").join(marks, "doc_id").groupBy("copy").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return texts.join(chosen, ["doc_id", "copy"]).groupBy("doc_id", "copy").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic", "doc_id", "copy")


def word_shares(texts: DataFrame) -> CountedWords:
    """Log-shares of the words that stand ``WORD_SUPPORT`` times or more and have ``LEAST_SHARE``, letters that are set apart left out.

    All words of all texts are counted; the share bounds what each task holds, whatever the input, to 1 / ``LEAST_SHARE`` words.
    """
    text = F.regexp_replace(F.lower("text"), "(?U)" + _SPACED.pattern, " ")
    words = texts.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).where("word != ''")
    counts = materialise(words.groupBy("word").agg(F.count("*").alias("n")), "toxicity-words")
    most = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(WORD_SUPPORT, LEAST_SHARE * most)).collect()
    total = sum(r["n"] for r in rows)
    return CountedWords({r["word"]: math.log(r["n"] / total) for r in rows})


def feature_counts(texts: DataFrame, table: list, words: CountedWords, kept: frozenset[str] | None = None) -> DataFrame:
    """(feature, n): in how many texts a feature stands.

    With ``kept``, only these are counted: with a feature it must hold all of its beginnings that are features, so that a
    word is left at its first beginning that is not kept.
    """
    grid = np.array(table, float)

    def of_word(word: str) -> list[str]:
        if kept is None:
            return word_features(word)
        out = []
        for k in PREFIXES:
            if k > len(word):
                break
            if word[:k] not in kept:
                return out
            out.append(word[:k])
        return [*out, word + "$"] if word + "$" in kept else out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        held: dict[str, list[str]] = {}
        seen: set[str] = set()
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["feature", "n"])
            counts.clear()
            return batch

        for b in slices(batches):
            for block in blocks(b.column(0).to_pylist()):
                restore_ahead(block, table, grid, memo, words)
                for text in block:
                    tokens = restored_set(text, table, memo, words)
                    if len(held) > MEMO // 4 or len(seen) > MEMO:
                        held.clear()
                        seen.clear()
                    new = tokens - seen
                    seen |= new
                    for t in new:
                        found = [f for w in _WORDS.findall(t) for f in of_word(w)]
                        if found:
                            held[t] = found
                    counts.update(set().union(*(held[t] for t in held.keys() & tokens)))
                    if len(counts) > 150_000:
                        yield flush()
        yield flush()

    return texts.select("text").mapInArrow(count, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def feature_weights(known: DataFrame, table: list, words: CountedWords, pos: int, neg: int) -> dict[str, float]:
    """The features tied to the toxic label, with their weights.

    All features of the toxic texts are counted first. More clean texts with a feature make its gain smaller, so a feature that
    would gain too little if no clean text had it need not be counted in these; if very many are left, all are counted there.
    """
    base = pos / (pos + neg)
    gain = lambda share: 2 * F.col("p") * F.log(share / base)
    marked = feature_counts(known.where("toxic = 1"), table, words).withColumnRenamed("n", "p")
    marked = materialise(marked.where(gain((F.col("p") + base) / (F.col("p") + 1)) >= LEAST_SUPPORT), "toxicity-marked")
    some = marked.select("feature").limit(MOST_KEPT + 1).collect()
    kept = frozenset(r["feature"] for r in some) if len(some) <= MOST_KEPT else None
    clean = feature_counts(known.where("toxic = 0"), table, words, kept)
    totals = marked.join(clean, "feature", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = (F.col("p") + base) / (F.col("p") + F.col("n") + 1)
    weight = F.log(((F.col("p") + base) / pos) / ((F.col("n") + 1 - base) / neg))
    found = totals.where((gain(share) >= LEAST_SUPPORT) & (share > base)).select("feature", weight.alias("weight")).collect()
    return {r["feature"]: r["weight"] for r in found}


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, DataFrame]:
    """All of a scorer but its fit, and the labelled texts; without both labels there is nothing to fit, and no ``beta``."""
    table = language_model(trigram_counts(docs)).tolist()
    known = materialise(labelled(docs, labels), "toxicity-labelled")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Scorer(table, {}, None, float(pos > 0)), known
    words = word_shares(known)
    return Scorer(table, feature_weights(known, table, words, pos, neg), np.zeros(4), pos / (pos + neg), words=words), known


_NUMBERS = ["a", "b", "c", "d"]


def described(docs: DataFrame, scorer: Scorer, *keys: str) -> DataFrame:
    """The ``keys`` and the four numbers of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = scorer.rows([t or "" for t in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), *b.columns[1:]], names=[*_NUMBERS, *keys])

    rows = docs.select("text", *keys)
    return rows.mapInArrow(run, ", ".join([*(f"{n} double" for n in _NUMBERS), *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])]))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    scorer, known = learn(docs, labels)
    if scorer.beta is not None:
        # one row of four numbers for each labelled text
        scorer.beta = _logistic(materialise(described(known, scorer, "toxic"), "toxicity-features"), _NUMBERS, "toxic")
    return scorer


def trained_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row, as ``score_documents`` gives with ``train``: each text is restored once, for the fit and for its score."""
    scorer, known = learn(docs, labels)
    if scorer.beta is None:
        return score_documents(docs, scorer)
    text = F.col("text").cast("string")
    texts = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("copy"))
    rows = materialise(described(texts, scorer, "doc_id", "copy"), "toxicity-features")
    fit = rows.join(known.select("doc_id", "copy", "toxic"), ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"])
    beta = _logistic(materialise(fit.select(*_NUMBERS, "toxic"), "toxicity-fit"), _NUMBERS, "toxic")
    z = sum((F.col(n) * float(b) for n, b in zip(_NUMBERS, beta, strict=True)), F.lit(0.0))
    return rows.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))).alias("score"))


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = scorer.scores([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below the threshold.

    A null text is judged as an empty one; repeated rows stay or go together; a row is judged by its text alone, so nulls and
    clashing names in other columns do not matter; an empty table gives an empty result.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(scorer.scores([t or "" for t in b.column(at).to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = trained_scores(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
