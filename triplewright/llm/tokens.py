"""Token ids of documents by a tokenizer library: whole texts by ranks, or each distinct chunk of text once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.bpe import RANKS, ChunkEncoder, vocabulary

TOKENIZER = "byte_bpe_50k.json"
CACHE_ENTRIES = 200_000
_TEXTS_AT_ONCE = 256


def joined_encoder(
    encode: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, entries: int = CACHE_ENTRIES
) -> ChunkEncoder:
    """A chunk encoder over a library's ``encode``; ``lengths`` are the UTF-8 bytes that each id stands for.

    New chunks that start at a space are joined and encoded as one text, then cut
    apart again by the byte lengths of the ids; a tokenizer never merges across
    the start of a chunk.
    """

    def encode_new(chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        joined = [i for i, c in enumerate(chunks) if len(c) > 1 and c[0] == " " and not c[1].isspace()]
        taken = set(joined)
        for at in range(0, len(joined), 2000):
            part = joined[at : at + 2000]
            ids = np.array(encode(["".join(chunks[i] for i in part)])[0], "<u4")
            ends = np.cumsum(lengths[ids])
            want = np.cumsum([len(chunks[i].encode("utf-8", "replace")) for i in part])
            cut = np.searchsorted(ends, want)
            if len(ids) and cut[-1] < len(ids) and np.array_equal(ends[cut], want):
                data, begin = ids.tobytes(), 0
                for i, end in zip(part, (cut + 1).tolist(), strict=True):
                    out[i] = data[4 * begin : 4 * end]
                    begin = end
            else:
                taken.difference_update(part)
        alone = [i for i in range(len(chunks)) if i not in taken]
        for i, ids in zip(alone, encode([chunks[i] for i in alone]), strict=True):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    return ChunkEncoder(encode_new, entries)


class RankedEncoder:
    """Encodes whole texts by ranks with ``tiktoken``, which is quicker than looking up the chunks of a memo."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [np.array(self.ranked.encode_ordinary(t), "<u4").tobytes() for t in texts]


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks by the bytes of the tokens in a ``tokenizers`` file of a byte-level model; None if its merges are not in the order of ids."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, added = whole["model"]["vocab"], {t["content"] for t in whole.get("added_tokens", [])}
    # printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(shown))}
    merges = [m.split(" ") if isinstance(m, str) else m for m in whole["model"]["merges"]]
    made = [vocab["".join(m)] for m in merges]
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in added}
    if made != sorted(made) or len(ranks) != len(made) + 256:
        return None
    return ranks


#: Characters on whose classes (letter, number, space) all versions of Unicode agree.
_SETTLED = re.compile("[^\x00-\u024f]")


class SettledEncoder:
    """Texts of settled characters by ranks, as wholes; other texts by the ``tokenizers`` library itself.

    A text that holds the string of a special token goes through the library as a whole, which reads the string as that token.
    """

    def __init__(self, ranks: dict[bytes, int], chunks: ChunkEncoder, whole: Callable[[list[str]], list[list[int]]], special: list[str]) -> None:
        self.ranked, self.chunks, self.whole = RankedEncoder(ranks), chunks, whole
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        kinds = [2 if self.special and self.special.search(t) else int(not t.isascii() and bool(_SETTLED.search(t))) for t in texts]
        part = [[t for t, k in zip(texts, kinds, strict=True) if k == kind] for kind in range(3)]
        whole = [np.array(ids, "<u4").tobytes() for ids in self.whole(part[2])] if part[2] else []
        found = [iter(self.ranked.encode(part[0])), iter(self.chunks.encode(part[1]) if part[1] else []), iter(whole)]
        return [next(found[k]) for k in kinds]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> RankedEncoder | SettledEncoder:
    """An encoder of this process over a byte-level file of ``tokenizers`` (.json) or of ranks for ``tiktoken``.

    The strings of special tokens are those tokens for the first, as the library reads them, and ordinary text for the second.
    """
    if not path.endswith(".json"):
        return RankedEncoder(vocabulary(path).ranks)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    names = tokenizer.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(names.values()) + 1, np.int64)
    for token, i in names.items():
        lengths[i] = len(token)  # byte-level vocabularies write one character a byte
    ranks = byte_ranks(path)
    if ranks is None:
        raise ValueError("the merges of the file are not in the order of its ids")
    return SettledEncoder(ranks, joined_encoder(whole, lengths), whole, [t.content for t in tokenizer.get_added_tokens_decoder().values()])


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(doc_id values, ids as little-endian unsigned 32-bit integers) of batches of (doc_id, text), some at a time."""
    encoder = library_encoder(path)
    for b in batches:
        for at in range(0, b.num_rows, _TEXTS_AT_ONCE):
            part = b.slice(at, _TEXTS_AT_ONCE)
            yield part.column(0), encoder.encode([x or "" for x in part.column(1).to_pylist()])


def default_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def ranks_path() -> str:
    return public_tokenizers.path(RANKS)


def doc_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
