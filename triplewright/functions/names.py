"""Names, identifiers and literals of a knowledge graph as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE = "http://rdf.freebase.com/ns/"

# Signs that names lose when they are compared (fixed values).
DROPPED_SIGNS = "!.,-_ '"


def normalise_name(name: Column) -> Column:
    """Lower case without punctuation and spaces."""
    return F.translate(F.lower(name), DROPPED_SIGNS, "")


def drop_the(name: Column) -> Column:
    """Without a leading ``the``; a longer word that starts so loses it too."""
    return F.regexp_replace(name, "^the", "")


def drop_number_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r" #[0-9]+$", "")


def drop_bracket_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r" \([^()]+\)$", "")


def drop_suffixes(name: Column) -> Column:
    """Without a number, then without a bracket at the end, if either sign occurs."""
    return F.when(name.contains("#") | name.contains("("), drop_bracket_suffix(drop_number_suffix(name))).otherwise(name)


def is_main_name(text: Column, name: Column) -> Column:
    """Whether a mention is the name of an entity, apart from suffixes, case, signs and a leading article."""
    return drop_the(normalise_name(text)) == drop_the(normalise_name(drop_suffixes(name)))


def drop_abbreviations(tokens: Column, abbreviations: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(abbreviations))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def relation_parts(relation: Column) -> Column:
    return F.split(relation, r"\.")


def relation_suffix(relation: Column, n: int = 1) -> Column:
    """The last ``n`` dotted parts, joined again."""
    parts = relation_parts(relation)
    return F.array_join(F.slice(parts, -F.least(F.lit(n), F.size(parts)), n), ".")


def relation_words(relation: Column, n: int = 3) -> Column:
    """Words of the last ``n`` dotted parts."""
    parts = relation_parts(relation)
    last = F.slice(parts, -F.least(F.lit(n), F.size(parts)), n)
    return F.flatten(F.transform(last, lambda p: F.split(p, "_")))


def relation_domain(relation: Column) -> Column:
    return F.element_at(relation_parts(relation), 1)


def add_namespace(name: Column, brackets: bool = False) -> Column:
    out = F.concat(F.lit(NAMESPACE), name)
    return F.concat(F.lit("<"), out, F.lit(">")) if brackets else out


def remove_namespace(name: Column) -> Column:
    """Without surrounding angle brackets and the namespace."""
    return F.regexp_replace(F.regexp_replace(name, "^<(.*)>$", "$1"), "^" + NAMESPACE.replace(".", r"\."), "")


def plain_literal(value: Column) -> Column:
    """The text of a literal: between its outer quotes, without a midnight or an empty month and day, or an identifier."""
    quoted = F.regexp_extract(value, r'(?s)^[^"]*"(.*)"[^"]*$', 1)
    text = F.regexp_replace(F.regexp_replace(quoted, r"T00:00:00$", ""), r"-00-00$", "")
    return F.when(value.contains('"'), text).otherwise(remove_namespace(value))


def literal_language(value: Column) -> Column:
    """Language tag of a literal, null without one."""
    tag = F.regexp_extract(value, r'"@([A-Za-z-]+)$', 1)
    return F.when(tag != "", tag)


def url_to_id(url: Column, prefix: str = "www.freebase.com/") -> Column:
    return F.translate(F.substr(url, F.lit(len(prefix) + 1)), "/", ".")


def derivation_key(lemma: Column, tag: Column) -> Column:
    """Lemma with the mark of its word class: adjective, verb or noun; null for others."""
    mark = F.when(tag.isin("JJ", "JJS", "RB"), ".a").when(tag.startswith("V"), ".v").when(tag.startswith("N"), ".n")
    return F.concat(lemma, mark)


def year_of(token: Column) -> Column:
    """The four digits that a year token starts with, null otherwise."""
    y = F.regexp_extract(token, "^([0-9]{4})", 1)
    return F.when(y != "", y)


def date_parts(value: Column) -> Column:
    """(y, m, d) of ``m/d/y`` or ``y-m-d`` at the start of a value; null for anything else."""
    mdy, ymd = r"^([0-9]+)/([0-9]+)/([0-9]+)", r"^([0-9]+)-([0-9]+)-([0-9]+)"

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(value, pattern, i).cast("int")

    def row(pattern: str, y: int, m: int, d: int) -> Column:
        return F.struct(part(pattern, y).alias("y"), part(pattern, m).alias("m"), part(pattern, d).alias("d"))

    return F.when(value.rlike(mdy), row(mdy, 3, 1, 2)).when(value.rlike(ymd), row(ymd, 1, 2, 3))


def comparable(value: Column) -> Column:
    """A value as results are compared: a nonzero whole number, else a date, else the text."""
    number = value.try_cast("bigint")
    date = F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "M/d/yyyy"))
    return F.coalesce(F.when(number != 0, number.cast("string")), date.cast("string"), value)


def pattern_complexity(pattern: Column) -> Column:
    return F.length(pattern) - F.length(F.replace(pattern, F.lit("R"), F.lit("")))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


# Answer classes by how a question begins (fixed values).
COUNT_STARTS = ["how many", "in how many", "on how many", "for how many"]
DATE_STARTS = ["in what year", "what year", "when", "since when"]
WHERE_CLASSES = [("location", 0.7), ("event", 0.6), ("conference", 0.6)]
WHO_CLASSES = [("person", 0.7), ("organization", 0.5), ("employer", 0.4), ("character", 0.5)]


def answer_classes(question: Column) -> Column:
    """Array of (class, prob) by the beginning of a question; null where a model has to decide."""

    def rows(pairs: list[tuple[str, float]]) -> Column:
        return F.array(*[F.struct(F.lit(c).alias("class"), F.lit(p).alias("prob")) for c, p in pairs])

    q = F.lower(question)
    return (
        F.when(starts_with_any(q, COUNT_STARTS), rows([("count", 1.0)]))
        .when(q.startswith("where"), rows(WHERE_CLASSES))
        .when(q.startswith("who"), rows(WHO_CLASSES))
        .when(starts_with_any(q, DATE_STARTS), rows([("date", 0.99)]))
    )
