"""Column helpers for text predicates. All of them stay built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def contains_any(text: Column, fragments: list[str]) -> Column:
    return any_of([text.contains(f) for f in fragments])


def count_of(text: Column, fragment: str) -> Column:
    """Non-overlapping occurrences of a plain fragment."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(fragment), F.lit("")))
    return (gone / F.lit(len(fragment))).cast("int")


def count_any(text: Column, fragments: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count_of(text, f) for f in fragments])


def quote_word(word: Column) -> Column:
    return F.regexp_replace(word, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def contains_word(text: Column, word: Column) -> Column:
    """The word occurs with no letter, digit or underscore on either side."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quote_word(word), F.lit(r"(?![\p{L}\p{N}_])"))
    return (F.length(word) > 0) & F.regexp_like(text, pattern)


def body_uses_word(text: Column, word: Column) -> Column:
    """Word occurs after the first colon, or after the first brace when there is no colon."""
    colon = F.locate(":", text)
    brace = F.locate("{", text)
    start = F.when(colon > 0, colon).otherwise(brace)
    body = F.when(start > 0, F.substring(text, start + 1, F.length(text))).otherwise(F.lit(""))
    return contains_word(body, word)


def returns_hardcoded_default(text: Column) -> Column:
    """Some line returns null, a boolean, ``default``, ``new``, a quoted text or a number."""
    number = r"^[-+]?-?(?:[0-9]+\.?[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+(?:[eE][-+]?[0-9]+)?|inf|infinity|nan)$"

    def hit(line: Column) -> Column:
        pos = F.locate("return", line)
        rest = F.trim(F.substring(line, pos + 6, F.length(line)))
        token = F.element_at(F.split(rest, "[; ]"), 1)
        return (pos > 0) & (
            token.isin("null", "false", "true", "default", "new")
            | token.startswith('"')
            | token.startswith("'")
            | F.lower(token).rlike(number)
        )

    return F.exists(F.split(text, r"\r?\n"), hit)


def utf8_slice(data: Column, start: Column, end: Column) -> Column:
    """Text between two byte offsets. ``data`` is binary, so the cut is a plain copy."""
    return F.substring(data, start + 1, end - start).cast("string")


# Arrows, comparisons (a blank stands before their ``<``), brackets, and the text between.
_GROUP_PIECE = r"=>|->|\s+<|[<>()\[\]{}]|(?:(?!\s+<)[^<>()\[\]{}=-])+|[\s\S]"
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def strip_groups(text: Column) -> Column:
    """The text with every bracket group emptied, whatever its depth: the commas left are top-level.

    One pass with a running depth. Only a ``>`` that closes a list counts, so comparisons stay text.
    """
    pieces = F.regexp_extract_all(text, F.lit(_GROUP_PIECE), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("angles"), F.lit("").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        angle_end = (piece == ">") & (acc["angles"] > 0)
        opens = piece.isin(*_CLOSERS)
        closes = piece.isin(")", "]", "}") | angle_end
        shown = (opens & (acc["depth"] == 0)) | (closes & (acc["depth"] <= 1)) | (~opens & ~closes & (acc["depth"] == 0))
        depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(F.lit(0), acc["depth"] - 1)).otherwise(acc["depth"])
        angles = F.when(piece == "<", acc["angles"] + 1).when(angle_end, acc["angles"] - 1).otherwise(acc["angles"])
        return F.struct(
            depth.alias("depth"), angles.alias("angles"), F.when(shown, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out")
        )

    return F.aggregate(pieces, start, step)["out"]


def shannon_entropy(s: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    n = F.length(s)
    chars = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))

    def term(acc: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(s, c, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.aggregate(chars, F.lit(0.0), term)
