"""Hilbert-curve ordering of documents and sharding by runs of the curve (DataFrame functions only).

Each metadata dimension is quantised to ``2**bits`` equally filled cells, the
cell coordinates become one Hilbert index, rows are sorted by that index and
the sorted rows are cut into runs. Neighbouring rows on the curve are close in
every dimension, so each run covers a small box and min/max pruning works in
all dimensions at once.

Defined results: a null number quantises to cell 0, a null or empty string too;
ties on the curve are ordered by checksum and id, so a hot cell still spreads
over tasks; repeated rows each get their own slot; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, ordered_slots, read

BITS = 5
SHARDS = 16
ACCURACY = 10_000


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of a point with ``bits`` bits in each coordinate."""
    n = len(cells)
    point = F.array(*[c.cast("long") for c in cells])
    steps = F.array(
        *[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]
    )

    def reflect(x: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        low = q - 1
        at = F.element_at(x, i + 1)
        first = F.element_at(x, F.lit(1))
        swap = first.bitwiseXOR(at).bitwiseAND(low)
        return F.when(
            at.bitwiseAND(q) != 0,
            F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)),
        ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    turned = F.aggregate(steps, point, reflect) if bits > 1 else point
    # Gray code: each coordinate is combined with all before it
    gray = F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda k: F.aggregate(F.slice(turned, F.lit(1), k), F.lit(0).cast("long"), lambda a, v: a.bitwiseXOR(v)),
    )
    flips = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, -1, -1)])

    def untwist(g: Column) -> Column:
        last = F.element_at(g, n)
        t = F.aggregate(
            flips,
            F.lit(0).cast("long"),
            lambda a, q: F.when((q > 1) & (last.bitwiseAND(q) != 0), a.bitwiseXOR(q - 1)).otherwise(a),
        )
        return F.transform(g, lambda v: v.bitwiseXOR(t))

    straight = F.transform(F.array(gray), untwist)[0]
    return F.transform(
        F.array(straight),
        lambda g: F.aggregate(
            flips,
            F.lit(0).cast("long"),
            lambda a, q: F.aggregate(
                g, a, lambda b, v: b * 2 + F.when(v.bitwiseAND(q) != 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
            ),
        ),
    )[0]


def order_code(c: Column) -> Column:
    """A number that orders strings by their first four bytes and tells those that share them apart by a hash of the whole."""
    head = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 4)), 8, "0"), 16, 10).cast("long")
    return F.coalesce(head * (1 << 24) + F.pmod(F.xxhash64(c), F.lit(1 << 24)), F.lit(0).cast("long"))


def quantise(df: DataFrame, dims: dict[str, str], bits: int = BITS) -> DataFrame:
    """Add a cell column per dimension: how many of the ``2**bits - 1`` quantiles lie below the value.

    The quantiles come from one pass over all rows; their number is fixed by ``bits``.
    """
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(c, cuts, ACCURACY).alias(c) for c in dims]).first()
    for c, cell in dims.items():
        bounds = row[c] or []
        below = F.lit(0)
        if bounds:
            below = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(c))), F.lit(0))
        df = df.withColumn(cell, below)
    return df


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Deal documents into ``shards`` runs of the curve over (size, lang, source).

    Returns doc_id, size, text_crc32, the cells, hilbert, shard, slot (position in
    the shard, from 0) and ``curve_slot`` (position on the whole curve). Counts of
    shards differ by at most one.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    facts = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        order_code(F.col("lang")).alias("lang_code"),
        order_code(F.col("source")).alias("source_code"),
    )
    facts = materialise(facts, "hilbert-facts")
    cells = quantise(facts, {"size": "size_cell", "lang_code": "lang_cell", "source_code": "source_cell"}, bits)
    cells = cells.withColumn("hilbert", hilbert_index([F.col("size_cell"), F.col("lang_cell"), F.col("source_cell")], bits))
    order = [F.col("hilbert"), F.col("text_crc32"), F.col("doc_id")]
    placed, total = ordered_slots(cells, order, "hilbert-order", "curve_slot")
    total = max(total, 1)
    shard = F.expr(f"cast((curve_slot * {shards}L) div {total}L as int)")
    # the first slot of shard k is ceil(k * total / shards)
    first = F.expr(f"((shard * {total}L) + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("curve_slot") - first)


def shard_boxes(placed: DataFrame) -> DataFrame:
    """What a reader needs to prune: the range of every dimension in each shard."""
    return placed.groupBy("shard").agg(
        F.count("*").alias("rows"),
        F.sum("size").alias("bytes"),
        *[f(c).alias(f"{n}_{c}") for c in ("size", "lang_code", "source_code") for n, f in (("min", F.min), ("max", F.max))],
    )


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "hilbert",
    )
