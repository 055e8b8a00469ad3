"""Token occurrences of two tokenizers aligned by elementary intervals, and how often their ids go together in the corpus.

A byte-level BPE (A) encodes a space and the text, a piece model with byte
fallback (B) the text, to which it adds the space. Both tile the same bytes, so
the union of both end arrays cuts them into elementary intervals; looking each
interval's end up in the arrays gives the token of each side that owns it, and
each interval is one overlap of two tokens. An end that both have closes a
group. All pairs of the tokens of a group are links. Texts lie one behind the
other in a batch, so this is done once for a batch.

A group's product is expanded over its different ids with their counts, some at
a time, so that a group of thousands of tokens costs no more than its different
id pairs. A document keeps its different linked id pairs and how often each
occurs. Their counts over the corpus are partial sums by task and one
aggregation. Each document then needs the counts of its own pairs: pairs are cut
by A id into buckets, documents' pairs are sent to their buckets in bounded
pieces, and a bucket with more than ``PIECE_PAIRS`` of these is salted, its
counts being sent to each salt. What comes back is added up by document.

Defined results: null and empty texts, and texts whose tokens of A or B do not
join to a space and the text (a text with the letter that B uses for spaces,
say), have no tokens, zeros and an empty digest; the strings of special tokens
are plain text; repeated rows count as documents of their own; rows without an
id are kept; an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, read, slices
from triplewright.llm.tokens import SettledEncoder, byte_ranks, doc_texts, joined_encoder

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
BUCKET_PAIRS = 1 << 15  # different id pairs of a bucket, about
PIECE_PAIRS = 1 << 19  # pairs of documents that a task holds at once (12 MB)
_TEXT_AT_ONCE = 1 << 19  # letters of texts, or one text
_LINKS_AT_ONCE = 1 << 19
_HELD = 1 << 19  # pairs that a task gathers before it counts or sends them


class Tokenizers:
    """Both tokenizers of a process, with the bytes of each id."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(byte_path)
        library.encode_special_tokens = True
        ranks = byte_ranks(byte_path)
        if ranks is None:
            raise ValueError("the merges of the file are not in the order of its ids")
        self.size_a = max(library.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [b""] * self.size_a
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.lengths_a = np.array([len(t) for t in self.bytes_a], np.int64)

        def whole(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

        # without special tokens: their strings are cut like any other text
        self.a = SettledEncoder(ranks, joined_encoder(whole, self.lengths_a), whole, [])
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.size_b = self.b.vocab_size()
        self.bytes_b = []
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.lengths_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # the decimal ids with each separator: A followed by another A or by the B side, B by another B or by the next group
        digits_a, digits_b = [b"%d" % i for i in range(self.size_a)], [b"%d" % i for i in range(self.size_b)]
        self.written = [d + s for digits, s in ((digits_a, b","), (digits_a, b"|"), (digits_b, b","), (digits_b, b";")) for d in digits]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text, both empty where they do not tile a space and the text."""
        full = [i for i, t in enumerate(texts) if t]
        empty = np.zeros(0, np.int64)
        found_a, found_b = [empty] * len(texts), [empty] * len(texts)
        ids_a = self.a.encode([" " + texts[i] for i in full])
        ids_b = self.b.encode([texts[i] for i in full], num_threads=1) if full else []
        for i, x, y in zip(full, ids_a, ids_b, strict=True):
            p = np.frombuffer(x, "<u4").astype(np.int64)
            want = b" " + texts[i].encode()
            if b"".join(map(self.bytes_b.__getitem__, y)) == want and b"".join(map(self.bytes_a.__getitem__, p.tolist())) == want:
                found_a[i], found_b[i] = p, np.array(y, np.int64)
        return found_a, found_b


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First A token, A tokens, first B token and B tokens of each group, from the ascending end offsets of both sides."""
    # the union of both arrays (as union1d gives it, but a stable sort merges what is in order): an elementary interval ends at each
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) != 0]
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    closed = np.flatnonzero((ends_a[own_a] == ends) & (ends_b[own_b] == ends)) if len(ends) else np.zeros(0, np.int64)
    opened = np.concatenate([[0], closed[:-1] + 1]) if len(closed) else closed
    first_a, first_b = own_a[opened], own_b[opened]
    return first_a, own_a[closed] - first_a + 1, first_b, own_b[closed] - first_b + 1


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(before - starts, lengths)


def _counted(owner: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (owner, id) in order, and how often each occurs."""
    keys, counts = np.unique(owner * size + ids, return_counts=True)
    return keys // size, keys % size, counts


def pair_counts(
    doc: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, cut: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], size_a: int, size_b: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair as a * size_b + b, links) for the groups ``cut``, whose documents are ``doc``; ordered, each pair once."""
    first_a, many_a, first_b, many_b = cut
    single = (many_a == 1) & (many_b == 1)
    keys, links = [doc[single] * (size_a * size_b) + ids_a[first_a[single]] * size_b + ids_b[first_b[single]]], [np.ones(int(single.sum()), np.int64)]
    at = np.flatnonzero(~single)
    g = np.arange(len(at))
    ga, a, na = _counted(np.repeat(g, many_a[at]), ids_a[_runs(first_a[at], many_a[at])], size_a)
    gb, b, nb = _counted(np.repeat(g, many_b[at]), ids_b[_runs(first_b[at], many_b[at])], size_b)
    from_b, to_b = np.searchsorted(gb, g), np.searchsorted(gb, g, side="right")
    # each different A id of a group meets all different B ids of it, so many products at a time
    width = (to_b - from_b)[ga]
    done = np.cumsum(width)
    start = 0
    while start < len(ga):
        stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + _LINKS_AT_ONCE, side="right")))
        w, of = width[start:stop], ga[start:stop]
        right = _runs(from_b[of], w)
        key = np.repeat(doc[at[of]] * (size_a * size_b) + a[start:stop] * size_b, w) + b[right]
        k, inverse = np.unique(key, return_inverse=True)
        keys.append(k)
        # counts of links stay far below 2^53
        links.append(np.bincount(inverse, weights=(np.repeat(na[start:stop], w) * nb[right]).astype(np.float64), minlength=len(k)).astype(np.int64))
        start = stop
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(links).astype(np.float64), minlength=len(k)).astype(np.int64)
    return k // (size_a * size_b), k % (size_a * size_b), total


def _digests(t: Tokenizers, ids_a: np.ndarray, ids_b: np.ndarray, cut: tuple[np.ndarray, ...], ends: np.ndarray) -> list[str]:
    """The digest of the written groups of each document; ``ends`` are the numbers of tokens (A and B) up to its end."""
    first_a, many_a, first_b, many_b = cut
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[first_a + many_a - 1] = 1
    last_b[first_b + many_b - 1] = 1
    order[np.arange(len(ids_a)) + np.repeat(first_b, many_a)] = ids_a + t.size_a * last_a
    order[np.arange(len(ids_b)) + np.repeat(first_a + many_a, many_b)] = 2 * t.size_a + ids_b + t.size_b * last_b
    out, begin = [], 0
    for end in ends.tolist():
        whole = b"".join(map(t.written.__getitem__, order[begin:end].tolist()))
        out.append(hashlib.sha256(whole[:-1]).hexdigest() if whole else "")
        begin = end
    return out


def align(texts: list[str], t: Tokenizers) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
    """Counts and digest of each text, and (text, id pair, links) of all."""
    found_a, found_b = t.encode(texts)
    n_a, n_b = np.array([len(x) for x in found_a], np.int64), np.array([len(x) for x in found_b], np.int64)
    ids_a, ids_b = np.concatenate([np.zeros(0, np.int64), *found_a]), np.concatenate([np.zeros(0, np.int64), *found_b])
    cut = groups(np.cumsum(t.lengths_a[ids_a]), np.cumsum(t.lengths_b[ids_b]))
    # the end of a text is an end of both sides, so no group reaches over it
    doc = np.searchsorted(np.cumsum(n_a), cut[0], side="right")
    of_doc = {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(doc, minlength=len(texts)),
        "n_links": np.bincount(doc, weights=(cut[1] * cut[3]).astype(np.float64), minlength=len(texts)).astype(np.int64),
    }
    digests = _digests(t, ids_a, ids_b, cut, np.cumsum(n_a + n_b))
    return {k: v.tolist() for k, v in of_doc.items()} | {"groups_sha256": digests}, *pair_counts(doc, ids_a, ids_b, cut, t.size_a, t.size_b)


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links): the last two are the document's id pairs and their links, as 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(byte_path, piece_path)
        for b in slices(batches, 256):
            texts = [x or "" for x in b.column(1).to_pylist()]
            sizes = np.cumsum([len(x) for x in texts])
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _TEXT_AT_ONCE, side="right")))
                counts, doc, pair, links = align(texts[start:stop], t)
                at = np.searchsorted(doc, np.arange(stop - start + 1))
                cuts = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                pairs, many = pair.astype("<u8"), links.astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, stop - start),
                        *(pa.array(counts[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")),
                        pa.array(counts["groups_sha256"], pa.string()),
                        pa.array([pairs[p:q].tobytes() for p, q in cuts], pa.binary()),
                        pa.array([many[p:q].tobytes() for p, q in cuts], pa.binary()),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
                )
                start = stop

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"
    return doc_texts(docs).mapInArrow(run, schema)


def corpus_counts(table: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, docs, best) of every linked id pair: in how many documents, and whether that is the most of its A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_counts, waiting, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
            keys, inverse = np.unique(np.concatenate([held, fresh]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, inverse, np.concatenate([held_counts, counts]))
            return keys, total

        for b in batches:
            for x in b.column(0).to_pylist():
                waiting.append(np.frombuffer(x, "<u8"))
                size += len(waiting[-1])
                if size >= _HELD:
                    held, held_counts = merged()
                    waiting, size = [], 0
                    if len(held) >= _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(held_counts)], names=["pair", "docs"])
                        held, held_counts = held[:0], held_counts[:0]
        held, held_counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(held_counts)], names=["pair", "docs"])

    counts = table.select("pairs").mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = counts.withColumn("a", F.expr(f"pair div {size_b}"))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "a", "docs", (F.col("docs") == F.col("most")).alias("best"))


def document_sums(table: DataFrame, counts: DataFrame, size_b: int, bucket_pairs: int = BUCKET_PAIRS, piece_pairs: int = PIECE_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of each document (row, pairs, links) that has pairs."""
    spark = table.sparkSession
    buckets = max(1, -(-counts.count() // bucket_pairs))
    bucket = F.pmod(F.xxhash64("a"), F.lit(buckets)).cast("int")
    # one row a bucket, and a bucket for each 32,768 different pairs: a product of two vocabularies bounds them
    salts = counts.groupBy(bucket.alias("bucket")).agg(F.ceil(F.sum("docs") / piece_pairs).cast("int").alias("salts")).collect()
    of_bucket = {r["bucket"]: r["salts"] for r in salts}
    salted = spark.createDataFrame([(b, s) for b, s in of_bucket.items()] or [(0, 1)], "bucket int, salts int")
    known = counts.withColumn("bucket", bucket).join(F.broadcast(salted), "bucket")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("bucket", "salt", "pair", "docs", "best")
    # the bucket of an A id, as Spark hashes it; as many rows as the vocabulary has
    where = dict(counts.select("a", bucket.alias("bucket")).distinct().collect())
    size_a = max(where, default=0) + 1
    bucket_of = np.zeros(size_a, np.int32)
    for a, b in where.items():
        bucket_of[a] = b

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pairs, links, size = [], [], [], 0

        def pieces() -> pa.RecordBatch:
            key, many = np.concatenate([np.zeros(0, np.uint64), *pairs]), np.concatenate([np.zeros(0, np.uint64), *links])
            row = np.repeat(np.array(rows, np.int64), [len(p) for p in pairs])
            b = bucket_of[(key // np.uint64(size_b)).astype(np.int64)]
            order = np.argsort(b, kind="stable")
            key, many, row, b = key[order], many[order], row[order], b[order]
            at = np.concatenate([np.flatnonzero(np.diff(b, prepend=-1)), [len(b)]])
            spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            numbers = [int(b[p]) for p, _ in spans]
            # all pieces of one flush differ in salt from those of the next as a hash of its first row does
            salt = [hash((rows[0], n)) % of_bucket[n] for n in numbers]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(numbers, pa.int32()),
                    pa.array(salt, pa.int32()),
                    *(pa.array([x[p:q].tobytes() for p, q in spans], pa.binary()) for x in (row, key, many)),
                ],
                names=["bucket", "salt", "rows", "pairs", "links"],
            )

        for b in batches:
            for r, p, n in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if not p:
                    continue
                rows.append(r)
                pairs.append(np.frombuffer(p, "<u8"))
                links.append(np.frombuffer(n, "<u8"))
                size += len(pairs[-1])
                if size >= _HELD:
                    yield pieces()
                    rows, pairs, links, size = [], [], [], 0
        if rows:
            yield pieces()

    def look_up(pieces: pa.Table, known: pa.Table) -> pa.Table:
        pair, docs = known.column("pair").to_numpy(), known.column("docs").to_numpy()
        best = known.column("best").to_numpy(zero_copy_only=False)
        order = np.argsort(pair)
        pair, docs, best = pair[order], docs[order], best[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for chunk in pieces.to_batches(max_chunksize=1):
            row, key, many = (np.frombuffer(chunk.column(c)[0].as_py(), t) for c, t in (("rows", "<i8"), ("pairs", "<u8"), ("links", "<u8")))
            at = np.searchsorted(pair, key.astype(np.int64))
            many = many.astype(np.int64)
            # rows of a piece stand in the order of the table, so those of a document are neighbours
            starts = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
            found.append((row[starts], np.add.reduceat(many * best[at], starts), np.add.reduceat(many * docs[at], starts)))
        columns = [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3)]
        return pa.table({"row": columns[0], "n_best": columns[1], "count_sum": columns[2]})

    sent = table.select("row", "pairs", "links").mapInArrow(cut, "bucket int, salt int, rows binary, pairs binary, links binary")
    parts = sent.groupBy("bucket", "salt").cogroup(known.groupBy("bucket", "salt")).applyInArrow(look_up, "row long, n_best long, count_sum long")
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_documents(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, bucket_pairs: int = BUCKET_PAIRS, piece_pairs: int = PIECE_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    byte_path, piece_path = byte_path or public_tokenizers.path(BYTE_TOKENIZER), piece_path or public_tokenizers.path(PIECE_TOKENIZER)
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).vocab_size()
    # numbered when written, so that a lost task finds the same numbers again
    table = materialise(aligned(docs, byte_path, piece_path).withColumn("row", F.monotonically_increasing_id()), "alignment-documents")
    counts = materialise(corpus_counts(table, size_b), "alignment-counts")
    sums = document_sums(table, counts, size_b, bucket_pairs, piece_pairs)
    whole = table.drop("pairs", "links").join(sums, "row", "left")
    none = F.lit(0).cast("long")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"))
