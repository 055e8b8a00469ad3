"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

The distinct words of a slice of the corpus are laid out as one linked list of
token ids. An inverted index maps each token pair that has a rank to the
positions where it stands. Pairs are taken in rank order; a merge is applied at
all its positions, with array operations while ranks are low and positions
many, and only the two neighbours of each are looked up again and entered in
the index. A merge thus costs as much as it changes, and a word is merged once
however often it occurs.

The slice is what one task holds: the words its worker process has not met
before. Replaying over the words of all tasks together would give the same ids
(a word's merges depend on nothing outside it) but would need every occurrence
shuffled back to its document. The worker keeps words it has encoded, up to
``CACHE_ENTRIES``; beyond that it starts afresh, so memory is bounded.

Defined results: a null text is empty and has no ids; special tokens are
ordinary text; repeated rows get the same ids; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import read

RANKS = "byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 200_000
WORDS_AT_ONCE = 1 << 16
COMMON = 2_000  # merges of lower rank have many places in a slice and are applied with array operations
_END, _GONE = -1, -2


class Vocabulary:
    """Ranks of a public byte-level BPE vocabulary and the pairs of its tokens that merge."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        rank_of = self.ranks.get
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left = rank_of(token[:cut])
                right = rank_of(token[cut:]) if left is not None else None
                if right is not None:
                    self.pairs[left << 32 | right] = rank
        self._keys = np.array(sorted(self.pairs), np.int64)
        self._ranks = np.array([self.pairs[k] for k in self._keys.tolist()] + [-1], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the tokens that pairs merge into; -1 for those that do not, ends of words among them."""
        keys = left << 32 | right
        at = np.searchsorted(self._keys, keys)
        found = self._ranks[at]
        found[(self._keys[np.minimum(at, len(self._keys) - 1)] != keys) | (left < 0) | (right < 0)] = -1
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _by_rank(rank_at: np.ndarray, below: float = np.inf) -> dict[int, np.ndarray]:
    """The inverted index: for each rank, in order, the places where a pair of that rank stands."""
    places = np.flatnonzero((rank_at >= 0) & (rank_at < below))
    ranks = rank_at[places]
    order = np.argsort(ranks, kind="stable")
    found, starts = np.unique(ranks[order], return_index=True)
    return dict(zip(found.tolist(), np.split(places[order], starts[1:]), strict=True)) if len(found) else {}


def _merge_common(token: np.ndarray, rank_at: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Apply all merges of rank below ``COMMON`` in order, each at all its places at once.

    Returns the tokens and pair ranks that are left, and places (of the input)
    in words where a merge made a pair of lower rank than its own.
    """
    size = len(token)
    after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
    where = {rank: [places] for rank, places in _by_rank(rank_at, COMMON).items()}
    order, early = list(where), []
    heapify(order)
    taken = np.zeros(size, bool)

    def enter(places: np.ndarray, ranks: np.ndarray, rank: int) -> None:
        low = (ranks >= 0) & (ranks < COMMON)
        places, ranks = places[low], ranks[low]
        early.extend(places[ranks < rank].tolist())
        by = np.argsort(ranks, kind="stable")
        found, starts = np.unique(ranks[by], return_index=True)
        for m, group in zip(found.tolist(), np.split(places[by], starts[1:]), strict=True) if len(found) else ():
            if m in where:
                where[m].append(group)
            else:
                where[m] = [group]
                heappush(order, m)

    while order:
        rank = heappop(order)
        groups = where.pop(rank, None)
        if groups is None:
            continue
        at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        at = at[rank_at[at] == rank]  # a place may have changed since it was entered
        taken[at] = True
        if taken[after[at]].any():
            # places that overlap: the leftmost of a run goes first, then every other one
            free, last = [], -1
            for i in at.tolist():
                if i != last:
                    free.append(i)
                    last = after[i]
            taken[at] = False
            at = np.array(free, np.int64)
            taken[at] = True
        gone = after[at]
        right = after[gone]
        seen = token[right]
        token[at], token[gone], rank_at[gone] = rank, _GONE, -1
        after[at], before[right] = right, at
        beside = taken[right]
        taken[at] = False
        if beside.any():
            # what the next place was before it merged, too
            between = vocab.merged(token[at[beside]], seen[beside])
            early.extend(at[beside][(between >= 0) & (between < rank)].tolist())
        ranks = vocab.merged(token[at], token[right])
        rank_at[at] = ranks
        enter(at, ranks, rank)
        left = before[at]
        ranks = vocab.merged(token[left], token[at])
        rank_at[left] = ranks
        enter(left, ranks, rank)
    alive = token != _GONE
    return token[alive], rank_at[alive], early


def _merge_rare(token: list[int], rank_at: list[int], vocab: Vocabulary) -> list[int]:
    """Apply the other merges in order, place by place; changes ``token`` and returns places as ``_merge_common`` does."""
    known, early = vocab.pairs.get, []
    size = len(token)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    where = {rank: places.tolist() for rank, places in _by_rank(np.array(rank_at, np.int64)).items()}
    order = list(where)
    heapify(order)
    while order:
        rank = heappop(order)
        places = where.pop(rank, None)
        if places is None:
            continue
        places.sort()
        high = rank << 32
        for i in places:
            if rank_at[i] != rank:
                continue
            j = after[i]
            token[i] = rank
            token[j] = _GONE
            rank_at[j] = -1
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            for at, key, other in ((i, high | token[k], token[k]), (h, token[h] << 32 | rank, token[h])):
                m = known(key, -1) if other >= 0 else -1
                rank_at[at] = m
                if m >= 0:
                    if m < rank:
                        early.append(i)
                    if m in where:
                        where[m].append(at)
                    else:
                        where[m] = [at]
                        heappush(order, m)
    return early


def replay(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Token ids of each word, as little-endian unsigned 32-bit integers: all merges in rank order over all words at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1)
    token = np.full(1 + int(ends[-1]) if len(words) else 1, _END)
    letters = np.ones(len(token), bool)
    letters[0] = False
    letters[ends] = False
    token[letters] = vocab.single[np.frombuffer(b"".join(words), np.uint8)]
    rank_at = np.full(len(token), -1)
    rank_at[:-1] = vocab.merged(token[:-1], token[1:])
    token, rank_at, early = _merge_common(token, rank_at, vocab)
    odd = set(np.searchsorted(ends, early).tolist())
    left = token.tolist()
    found = _merge_rare(left, rank_at.tolist(), vocab)
    odd.update(np.searchsorted(np.flatnonzero(token == _END)[1:], found).tolist())
    token = np.array(left, np.int64)
    token = token[token != _GONE]
    closed = np.flatnonzero(token == _END)
    stops = (4 * (closed - np.arange(len(closed)))).tolist()
    data = token[token >= 0].astype("<u4").tobytes()
    out = [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]
    for n in odd:
        # a merge made a pair of lower rank: such a word is replayed alone, one place at a time
        out[n] = np.array(_one_by_one(words[n], vocab), "<u4").tobytes()
    return out


def _one_by_one(word: bytes, vocab: Vocabulary) -> list[int]:
    """The leftmost pair of least rank merges first, again and again."""
    known = vocab.pairs.get
    token = [int(vocab.single[c]) for c in word]
    size = len(token)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    heap = [(m, i) for i in range(size - 1) if (m := known(token[i] << 32 | token[i + 1], -1)) >= 0]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        if token[i] < 0 or j >= size or known(token[i] << 32 | token[j], -1) != rank:
            continue
        token[i], token[j] = rank, -1
        k = after[i] = after[j]
        if k < size:
            before[k] = i
            if (m := known(rank << 32 | token[k], -1)) >= 0:
                heappush(heap, (m, i))
        h = before[i]
        if h >= 0 and (m := known(token[h] << 32 | rank, -1)) >= 0:
            heappush(heap, (m, h))
    return [t for t in token if t >= 0]


#: Signs that may close a chunk; a run of them after letters is always a match of its own.
CLOSING = ".,;:!?$%&*#|\"()"


def ascii_letters(core: str) -> bool:
    """Letters in every version of Unicode."""
    return core.isascii() and core.isalpha()


class ChunkEncoder:
    """Encodes texts through a bounded memo of chunks.

    A chunk reaches from a space before a visible character to the next such
    space. The pattern always starts a match at such a space and never looks
    across it, so chunks are split into matches independently of each other.
    Letters and the signs that close them are matches of their own too, so a
    word is encoded once, whatever follows it. When the memo is full it becomes
    the old generation, from which entries are taken back when they are met.

    A key of the memo is a chunk without its space, or, where a chunk does not
    start at a space, the chunk after a mark.
    """

    def __init__(
        self, encode_new: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES, letters: Callable[[str], object] = ascii_letters
    ) -> None:
        """``letters``: whether a string is a run of letters by the tables of the encoder; such a run and the signs that close it are encoded apart."""
        self.encode_new, self.entries, self.letters = encode_new, entries, letters
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [chunk_keys(t) for t in texts]
        if len(self.memo) > self.entries:
            self.old, self.memo = self.memo, {}
        memo = self.memo
        fresh = [k for k in set().union(*split) if k not in memo]
        if fresh:
            self._learn(fresh)
        known = memo.__getitem__
        return [b"".join(map(known, keys)) for keys in split]

    def _learn(self, fresh: list[str]) -> None:
        memo, old = self.memo, self.old
        closed, need = [], set()
        for key in fresh:
            ids = old.get(key)
            if ids is not None:
                memo[key] = ids
                continue
            core = key.rstrip(CLOSING)
            if core and len(core) < len(key) and self.letters(core):
                tail = MARK + key[len(core) :]
                closed.append((key, core, tail))
                for part in (core, tail):
                    if part in old:
                        memo[part] = old[part]
                    elif part not in memo:
                        need.add(part)
            else:
                need.add(key)
        new = list(need)
        memo.update(zip(new, self.encode_new([k[1:] if k[:1] == MARK else " " + k for k in new]), strict=True))
        for key, core, tail in closed:
            memo[key] = memo[core] + memo[tail]


#: Before the key of a chunk that does not start at a space; a chunk never starts with it otherwise, see ``chunk_keys``.
MARK = "\0"
_LOOSE = re.compile(r" \s")


def chunk_keys(text: str) -> list[str]:
    """Cut at spaces that stand before a visible character; the chunks together are the text."""
    keys = text.split(" ")
    if keys[-1] and MARK not in text and not _LOOSE.search(text):
        keys[0] = MARK + keys[0]
        return keys
    out = [MARK + keys[0]]
    for k in keys[1:]:
        if k and not k[0].isspace() and k[0] != MARK:
            out.append(k)
        else:
            # inside a run of white space, or at the end: it stays with what comes before
            out[-1] = out[-1] + " " + k
    return out


@lru_cache(maxsize=1)
def tiktoken_patterns() -> tuple[re.Pattern, re.Pattern]:
    """``PATTERN`` over the letters, numbers and spaces that ``tiktoken`` knows, and a run of its letters.

    Versions of Unicode differ in thousands of characters, so the library itself is asked: an encoding whose pattern is one
    class keeps the characters of that class.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))

    def members(kind: str) -> str:
        asked = tiktoken.Encoding(kind, pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        codes = np.frombuffer(bytes(asked.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4")
        runs = np.split(codes, np.flatnonzero(np.diff(codes) != 1) + 1)
        return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)

    letter, number, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    own = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]")
    for kind, inside in ((r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        own = own.replace(kind, inside)
    return re.compile(own), re.compile(f"[{letter}]+")


@lru_cache(maxsize=4)
def replay_encoder(path: str, entries: int = CACHE_ENTRIES) -> ChunkEncoder:
    """An encoder of this process that merges new words by replay."""
    vocab = vocabulary(path)
    pattern, letters = tiktoken_patterns()

    def encode_new(chunks: list[str]) -> list[bytes]:
        split = [pattern.findall(c) for c in chunks]
        new = list({w for ws in split for w in ws})
        words: dict[str, bytes] = {}
        for at in range(0, len(new), WORDS_AT_ONCE):
            part = new[at : at + WORDS_AT_ONCE]
            words.update(zip(part, replay([w.encode("utf-8", "replace") for w in part], vocab), strict=True))
        return [b"".join(map(words.__getitem__, ws)) for ws in split]

    return ChunkEncoder(encode_new, entries, lambda core: ascii_letters(core) or letters.fullmatch(core))


def decode(ids: bytes, vocab: Vocabulary) -> bytes:
    """The bytes that little-endian unsigned 32-bit ids stand for."""
    return b"".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_TEXTS_AT_ONCE = 512


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): ids are little-endian unsigned 32-bit integers in one binary value."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = replay_encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, _TEXTS_AT_ONCE):
                part = b.slice(at, _TEXTS_AT_ONCE)
                ids = encoder.encode([x or "" for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def digests(ids: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and checksums of encoded documents, and of the bytes that their ids decode to."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            values = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(v) // 4 for v in values], pa.int64()),
                    pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string()),
                    pa.array([hashlib.sha256(decode(v, vocab)).hexdigest() for v in values], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded(read(spark, sf_dir, "documents")))
