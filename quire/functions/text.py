"""Text helpers: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that marks match starts; where a text has it, it counts as OTHER, so that positions stay right.
MARK, OTHER = "\x01", "\x02"
#: Numbers that are added up in one go for running sums.
BLOCK = 32


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s++", ""), r"(?<!\s)\s++$", "")


def bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(OTHER))


def match_starts(text: Column, pattern: str) -> Column:
    """0-based start of every match of ``pattern``, in order."""
    pieces = F.split(F.regexp_replace(_unmarked(text), pattern, MARK + "$0"), MARK)
    # Up to a piece's end the text is as long as the pieces before it, added up in steps of BLOCK pieces so that no sum starts anew.
    lengths = F.transform(pieces, F.length)
    return bind(lengths, running_sums)


def running_sums(n: Column) -> Column:
    """The sums of the first 1, 2, 3... numbers but the last, in blocks of BLOCK numbers."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda b: F.slice(n, b * BLOCK + 1, F.lit(BLOCK)))

    def within(before: Column, block: Column) -> Column:
        return F.transform(block, lambda x, i: before + total(F.slice(block, F.lit(1), i + 1)))

    def each(found: Column) -> Column:
        return bind(F.transform(found, total), lambda sums: F.flatten(F.transform(found, lambda block, i: bind(total(F.slice(sums, F.lit(1), i)), lambda before: within(before, block)))))

    return bind(bind(blocks, each), lambda ends: F.slice(ends, F.lit(1), F.size(ends) - 1))


def marked(text: Column, pattern: str) -> Column:
    """The text with MARK before and behind each match of a pattern that matches neither MARK nor an empty text."""
    return F.regexp_replace(_unmarked(text), pattern, f"{MARK}$0{MARK}")


def cut(text: Column) -> Column:
    """A marked text's pieces before, in and behind the matches, in turn: every second piece is a match."""
    return F.split(text, MARK)


def matches(pieces: Column) -> Column:
    """array<struct<text, position>> of the matches among the pieces of ``cut``: what they are and where they start."""
    ends = bind(F.transform(pieces, F.length), running_sums)
    each = F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces)), ends, lambda t, at: F.struct(t.alias("text"), at.alias("position")))
    return F.filter(each, lambda m, i: i % 2 == 0)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text in the first match; null where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def keep_case(text: Column, word: str, correction: str) -> Column:
    """Replace the word in any case, giving the correction the case that the word has: all capitals, first capital, or as it is."""
    rest = f"(?i:{word[1:]})"
    text = F.regexp_replace(text, rf"\b{word.upper()}\b", correction.upper())
    text = F.regexp_replace(text, rf"\b{word[0].upper()}{rest}\b", correction.capitalize())
    return F.regexp_replace(text, rf"\b{word[0]}{rest}\b", correction)


def cased(match: Column, word: str, correction: str) -> Column:
    """The correction in the case of ``match``, which is the word in any case (see ``keep_case``)."""
    return F.when(match == word.upper(), correction.upper()).when(match.startswith(word[0].upper()), correction.capitalize()).otherwise(correction)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
