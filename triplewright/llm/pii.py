"""Personal data by weak supervision (DataFrame functions only).

Wide patterns propose spans of four kinds. Labelers vote on each proposal
(for, against, no opinion): the strict pattern, a checksum or range test, a
gazetteer (domains, calling codes, issuer prefixes, address blocks), cue words
to the left, and the characters at its edges. Expectation-maximisation over the
counts of vote patterns, kind by kind, estimates how reliable each labeler is
and how likely each pattern is personal data. These soft labels train a naive
Bayes span classifier over the votes, the shape of the span and its edges; a
proposal that it accepts is a span. Spans of the strict patterns always stay.

The vote patterns are at most 4 x 3**5 rows and the classifier has a fixed
number of weights, whatever the size of the corpus; every proposal of the whole
corpus is counted.

Defined results: a null or empty text has no spans; without proposals only the
strict patterns count; repeated rows get the same spans; an empty table gives
an empty result; positions are code points; other columns of the input are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm.common import materialise, read

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 15
LEFT = 24
SHAPES = 64
EDGES = 5
VOTERS = 5
PATTERNS = 3**VOTERS
SLOTS = PATTERNS + SHAPES + 2 * EDGES
ACCEPT = 0.0  # log-odds
BLOCK = 256  # matches whose places are summed in one fold

# The contract's patterns. Possessive repeats and the anchors before them change no match; they keep
# the search linear and free of recursion on very long runs.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold before a pattern is tried.
_WORTH = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+"
    r"|\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,8}+"
    r"|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{1,63}+){1,8}+)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3}|3[0-9]{3}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
_WIDE_WORTH = {"email": r"@|[(\[]at[)\]]|\x20dot\x20", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": _WORTH["card"], "phone": r"[0-9]{3}[\x20.-][0-9]{3}"}

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_CUES = {
    "email": r"mail|contact|write|reach|schreib|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|adresse|client",
    "card": r"card|visa|credit|debit|karte|tarjeta|carte|payment|account",
    "phone": r"call|phone|\btel|fax|mobile|dial|anruf|llama|appel",
}
_NOT_CUES = r"order|version|invoice|isbn|\bref\b|token|\bsku\b|page|serial|\bv\s*$|[=\"§#]\s*$"
_GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|eu|it|nl|ch|at|us|ca|mx|ar)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+?(?:1|33|34|44|49|52|54)[^0-9]|555|^\([0-9]{3}\)",
}


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


_FOUND = "array<struct<s:int,e:int,val:string,left:string,right:string>>"


def _running(items: Column, width: Callable[[Column], Column], place: Callable[[Column, Column], Column], kind: str) -> Column:
    """``place(item, sum of the widths before it)`` for each item.

    A fold that adds to an array copies it each time, so items are folded in blocks and the blocks' sums in a fold of their own.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    summed = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda a, it: a + width(it)).alias("n")))
    zero = lambda: F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))

    def based(all_: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
        bases = F.aggregate(
            all_, start, lambda a, b: F.struct((a["pos"] + b["n"]).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"]
        )
        return let(bases, lambda at: F.flatten(F.transform(all_, lambda b, i: inside(b["b"], F.get(at, i)))))

    def inside(block: Column, base: Column) -> Column:
        def add(a: Column, it: Column) -> Column:
            row = place(it, base + a["pos"])
            return F.struct((a["pos"] + width(it)).alias("pos"), F.concat(a["out"], F.array(row)).alias("out"))

        return F.aggregate(block, zero(), add)["out"]

    return let(summed, based)


def matches(text: Column, pattern: str, worth: str) -> Column:
    """Leftmost non-overlapping matches with their places, what stands to the left, and the next character."""
    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def found(z: Column) -> Column:
        return F.transform(
            z["m"],
            lambda x, i: F.struct(
                x.alias("val"),
                F.char_length(F.get(z["g"], i)).alias("skip"),
                F.char_length(x).alias("n"),
                F.lower(F.right(F.get(z["g"], i), F.lit(LEFT))).alias("left"),
                F.left(F.get(z["g"], i + 1), F.lit(1)).alias("right"),
            ),
        )

    def place(it: Column, before: Column) -> Column:
        s = before + it["skip"]
        return F.struct(s.alias("s"), (s + it["n"]).alias("e"), it["val"].alias("val"), it["left"].alias("left"), it["right"].alias("right"))

    placed = let(let(both, found), lambda items: _running(items, lambda it: it["skip"] + it["n"], place, _FOUND))
    return F.when(text.rlike(worth), placed).otherwise(F.array().cast(_FOUND))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def valid(kind: str, val: Column) -> Column:
    """Whether a strict match counts."""
    digits = F.regexp_replace(val, "[^0-9]", "")
    if kind == "ip":
        return val.rlike(_QUAD)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 0 against, 1 no opinion."""
    out = F.when(yes, F.lit(2))
    return (out.when(no, F.lit(0)) if no is not None else out).otherwise(1)


def _edge(c: Column) -> Column:
    return (
        F.when(c == "", F.lit(0)).when(c.rlike(r"^\s$"), F.lit(1)).when(c.rlike(r"^[\p{L}]$"), F.lit(2)).when(c.rlike(r"^[0-9]$"), F.lit(3)).otherwise(4)
    )


def proposals(kind: str, found: Column) -> Column:
    """Each proposed span with its votes, as one number, and the values of its other features."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")

    def votes(x: Column) -> list[Column]:
        val, left, right = x["val"], x["left"], x["right"]
        strict = val.rlike("^(?:" + STRICT[kind].replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "").replace(r"(?:\G|(?<![0-9]))", "") + ")$")
        if kind == "card":
            check = _vote(_luhn(digits(val)), ~_luhn(digits(val)))
        elif kind == "ip":
            check = _vote(val.rlike(_QUAD) | val.contains(":"), ~val.rlike(_QUAD))
        elif kind == "phone":
            check = _vote(F.length(digits(val)).between(10, 13), ~F.length(digits(val)).between(9, 15))
        else:
            check = _vote(val.rlike(r"[A-Za-z]{2,}$"), val.rlike(r"[0-9-]$"))
        glued = F.right(left, F.lit(1)).rlike(r"[\p{L}0-9=\"#/]") | right.rlike(r"[\p{L}0-9/=]")
        return [
            _vote(strict & valid(kind, val)),
            check,
            _vote(val.rlike(_GAZETTEER[kind]) if kind != "card" else digits(val).rlike(_GAZETTEER[kind])),
            _vote(left.rlike(_CUES[kind]), left.rlike(_NOT_CUES)),
            _vote(~glued, glued),
        ]

    def describe(x: Column) -> Column:
        code = F.lit(0)
        for v in votes(x):
            code = code * 3 + v
        shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["val"], "[0-9]", "9"), r"[A-Za-z]+", "a"), r"\s", "_")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"),
            x["s"].alias("s"),
            x["e"].alias("e"),
            code.alias("votes"),
            F.pmod(F.xxhash64(shape), F.lit(SHAPES)).cast("int").alias("shape"),
            _edge(F.right(x["left"], F.lit(1))).alias("before"),
            _edge(x["right"]).alias("behind"),
        )

    return F.transform(found, describe)


def span_columns(text: Column) -> tuple[Column, Column]:
    """Spans of the strict patterns by kind, and all proposals."""
    base = []
    for k, kind in enumerate(KINDS):
        kept = F.filter(matches(text, STRICT[kind], _WORTH[kind]), lambda x: valid(kind, x["val"]))
        base.append(F.transform(kept, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    wide = [proposals(kind, matches(text, WIDE[kind], _WIDE_WORTH[kind])) for kind in KINDS]
    return F.concat(*base), F.concat(*wide)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, proposed) for every row."""
    base, proposed = span_columns(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.alias("base"), proposed.alias("proposed"))


def vote_posteriors(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(k, votes, n, q): the chance, by expectation-maximisation, that a proposal with these votes is personal data.

    ``counts`` has a row per kind and vote pattern; the rounds run inside one expression over the patterns of a kind.
    """
    grouped = counts.groupBy("k").agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("ps"))
    steps = [3 ** (VOTERS - 1 - l) for l in range(VOTERS)]
    cells = F.array(*[F.struct(F.lit(steps[l]).alias("step"), F.lit(v).alias("v"), F.lit(l).alias("l")) for l in range(VOTERS) for v in range(3)])
    guess1, guess0, weight = (0.1, 0.3, 0.6), (0.5, 0.3, 0.2), 10.0
    first = F.struct(
        F.lit(0.5).alias("prior"),
        F.array(*[F.lit(g) for _ in range(VOTERS) for g in guess1]).alias("t1"),
        F.array(*[F.lit(g) for _ in range(VOTERS) for g in guess0]).alias("t0"),
    )

    def posterior(p: Column, s: Column) -> Column:
        odds = F.log(s["prior"]) - F.log(1 - s["prior"])
        for l in range(VOTERS):
            at = F.lit(3 * l) + F.floor(p["votes"] / steps[l]).cast("int") % 3
            odds = odds + F.log(F.get(s["t1"], at)) - F.log(F.get(s["t0"], at))
        return 1 / (1 + F.exp(-odds))

    def soft(ps: Column, s: Column) -> Column:
        return F.transform(ps, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(p, s).alias("q")))

    def maximise(qs: Column) -> Column:
        total = lambda f: F.aggregate(qs, F.lit(0.0), lambda a, p: a + f(p))
        sums = F.struct(total(lambda p: p["n"] * p["q"]).alias("y"), total(lambda p: p["n"] * (1 - p["q"])).alias("no"))

        def table(y: Column, positive: bool) -> Column:
            share = (lambda p: p["n"] * p["q"]) if positive else (lambda p: p["n"] * (1 - p["q"]))
            guess = F.array(*[F.lit(g) for g in (guess1 if positive else guess0)])
            return F.transform(
                cells,
                lambda c: (
                    total(lambda p: F.when(F.floor(p["votes"] / c["step"]).cast("int") % 3 == c["v"], share(p)).otherwise(0.0))
                    + weight * F.get(guess, c["v"])
                )
                / (y + weight),
            )

        return let(
            sums,
            lambda t: F.struct(
                ((t["y"] + 1) / (t["y"] + t["no"] + 2)).alias("prior"),
                table(t["y"], True).alias("t1"),
                table(t["no"], False).alias("t0"),
            ),
        )

    fitted = grouped.select(
        "k", "ps", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda s, _: let(soft(F.col("ps"), s), maximise)).alias("theta")
    )
    return fitted.select("k", F.explode(soft(F.col("ps"), F.col("theta"))).alias("p")).select("k", "p.votes", "p.n", "p.q")


def _slots(x: Column) -> list[Column]:
    """Places of the features of a proposal in the weights of its kind."""
    return [x["votes"], x["shape"] + PATTERNS, x["before"] + PATTERNS + SHAPES, x["behind"] + PATTERNS + SHAPES + EDGES]


def train(found: DataFrame) -> list[float]:
    """Weights of the span classifier: for each kind a prior log-odds, then one weight per feature value."""
    spans = found.select(F.explode("proposed").alias("x")).select("x.*")
    shown = spans.groupBy("k", "votes", "shape", "before", "behind").agg(F.count("*").alias("n"))
    counts = shown.groupBy("k", "votes").agg(F.sum("n").alias("n"))
    soft = vote_posteriors(counts).select("k", "votes", "q")  # at most 4 * 3 ** 5 rows
    x = F.struct("votes", "shape", "before", "behind")
    slots = F.explode(F.array(F.lit(-1), *_slots(x))).alias("slot")
    sums = (
        shown.join(F.broadcast(soft), ["k", "votes"])
        .select("k", slots, (F.col("n") * F.col("q")).alias("y"), (F.col("n") * (1 - F.col("q"))).alias("no"))
        .groupBy("k", "slot")
        .agg(F.sum("y").alias("y"), F.sum("no").alias("no"))
    )
    got = {(r["k"], r["slot"]): (r["y"], r["no"]) for r in sums.collect()}  # at most 4 * (SLOTS + 1) rows
    out = []
    for k in range(len(KINDS)):
        y, no = got.get((k, -1), (0.0, 0.0))
        out.append(math.log((y + 1) / (no + 1)))
        for slot in range(SLOTS):
            a, b = got.get((k, slot), (0.0, 0.0))
            out.append(math.log((a + 1) / (y + 2)) - math.log((b + 1) / (no + 2)) if a + b else 0.0)
    return out


def covers(of: Column) -> Column:
    """For each kind, which places of the text its spans cover: one byte a place up to the last span, 1 at a first place, 2 after it, else 0.

    Spans of one kind are disjoint. Asking these about a span costs its length, however many spans there are.
    """

    def cover(spans_: Column) -> Column:
        gap = lambda x, i: x["s"] - F.when(i > 0, F.get(spans_, i - 1)["e"]).otherwise(0)
        parts = F.transform(spans_, lambda x, i: F.concat(F.repeat(F.lit("0"), gap(x, i)), F.lit("1"), F.repeat(F.lit("2"), x["e"] - x["s"] - 1)))
        return F.array_join(parts, "").cast("binary")

    def of_kind(k: int) -> Column:
        return F.array_sort(F.filter(of, lambda x: x["k"] == k))

    return F.array(*[let(of_kind(k), cover) for k in range(len(KINDS))])


def _touches(x: Column, cover: Column) -> Column:
    there = F.substring(cover, x["s"] + 1, x["e"] - x["s"])
    return F.contains(there, F.lit(b"1")) | F.contains(there, F.lit(b"2"))


def accepted(base: Column, proposed: Column, weights: list[float]) -> Column:
    """Proposals that the classifier accepts and that touch no strict span."""
    table = F.split(F.lit(",".join(f"{w:.12g}" for w in weights)), ",").cast("array<double>")

    def odds(x: Column) -> Column:
        at = x["k"] * (SLOTS + 1)
        out = F.get(table, at)
        for s in _slots(x):
            out = out + F.get(table, at + 1 + s)
        return out

    likely = F.transform(F.filter(proposed, lambda x: odds(x) > ACCEPT), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    apart = lambda kept: let(covers(base), lambda c: F.filter(kept, lambda x: ~F.exists(c, lambda one: _touches(x, one))))
    return let(likely, lambda kept: F.when((F.size(kept) == 0) | (F.size(base) == 0), kept).otherwise(apart(kept)))


def alone(added: Column) -> Column:
    """Where accepted proposals of two kinds overlap, the kind listed first has it."""
    earlier = lambda x, c: F.exists(F.slice(c, F.lit(1), x["k"]), lambda one: _touches(x, one))
    return F.when(F.size(added) < 2, added).otherwise(let(covers(added), lambda c: F.filter(added, lambda x: ~earlier(x, c))))


def spans(found: DataFrame, weights: list[float]) -> DataFrame:
    """(doc_id, base, spans): the strict spans, and these with the accepted proposals, by kind and start."""
    added = found.select("doc_id", "base", accepted(F.col("base"), F.col("proposed"), weights).alias("added"))
    return added.select(
        "doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", alone(F.col("added")))).alias("spans")
    )


def redacted(text: Column, of: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by the kind of its first span in brackets."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    in_order = F.array_sort(F.transform(of, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))

    def replaced(z: Column) -> Column:
        goes_on = lambda at: F.exists(z["cover"], lambda c: F.substring(c, at + 1, F.lit(1)) == F.lit(b"2"))
        # a run begins where no span goes on from before, and ends where none goes on behind
        begins = F.filter(z["all"], lambda x, i: ~goes_on(x["s"]) & ((i == 0) | (F.get(z["all"], i - 1)["s"] != x["s"])))
        ends = F.array_sort(F.array_distinct(F.transform(F.filter(z["all"], lambda x: ~goes_on(x["e"])), lambda x: x["e"])))
        wide = F.encode(text, "UTF-32")  # four bytes a code point: a piece is found without counting from the start
        return let(F.struct(begins.alias("b"), ends.alias("e"), wide.alias("w")), pieces)

    def pieces(z: Column) -> Column:
        piece = lambda a, n: F.decode(F.substring(z["w"], a * 4 + 1, n * 4), "UTF-32")
        before = lambda i: F.when(i > 0, F.get(z["e"], i - 1)).otherwise(0)
        kept = F.transform(z["b"], lambda x, i: F.concat(piece(before(i), x["s"] - before(i)), F.get(tags, x["k"])))
        last = F.element_at(z["e"], -1)
        return F.concat(F.array_join(kept, ""), piece(last, F.floor(F.octet_length(z["w"]) / 4).cast("int") - last))

    both = F.struct(in_order.alias("all"), covers(of).alias("cover"))
    return F.when(F.size(of) == 0, text).otherwise(let(both, replaced))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all personal data in ``text`` replaced; ``n_chars``, where there is one, follows the text.

    A null text stays null, an empty one and one without personal data stay as they are, with their ``n_chars``; nulls in other
    columns do not matter; repeated rows give repeated rows; columns of any name are kept; an empty table gives an empty result.
    """
    weights = train(materialise(candidates(docs), "pii-candidates"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base, proposed = span_columns(text)
    added = lambda z: let(accepted(z["base"], z["proposed"], weights), lambda a: F.concat(z["base"], alone(a)))
    every = let(F.struct(base.alias("base"), proposed.alias("proposed")), added)
    has_count = "n_chars" in docs.columns

    def changed(of: Column) -> Column:
        out = [F.when(F.col("text").isNotNull(), redacted(text, of)).alias("text")]
        return F.struct(*out, (F.size(of) > 0).alias("any"))

    # one array value holds what is computed, so no name of the input can clash
    done = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), let(every, changed).alias("done"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("done.text")}
    if has_count:
        columns["n_chars"] = F.when(F.col("done.any"), F.char_length("done.text").cast("long")).otherwise(F.col("row.n_chars"))
    return done.select(*[columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def joined(of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row of ``docs``, as arrays of (kind number, start, end)."""
    found = materialise(candidates(docs), "pii-candidates")
    return spans(found, train(found))


def op1_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
