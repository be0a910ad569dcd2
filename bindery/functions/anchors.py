"""Locating a sentence inside a text with increasing tolerance.

Tolerant levels search the original text with a pattern that allows ignorable
characters between the wanted ones, so the match offset is already an offset
in the original text and needs no mapping back.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clean_for_match, compact_text

HEAD_CHARS = 12
IGNORED_BY_CLEAN = r"[^\u4e00-\u9fa5a-zA-Z0-9]*"


def _spaced_pattern(c: Column) -> Column:
    chars = F.filter(F.split(compact_text(c), ""), lambda x: x != "")
    return F.array_join(F.transform(chars, lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), r"(?U:\s*)")


def _clean_pattern(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), IGNORED_BY_CLEAN)


def _offset(content: Column, pattern: Column) -> Column:
    """0-based offset of the first match, null when the pattern is empty or absent.

    The engine's own offset counts UTF-16 units; the text before it has as
    many characters as its length says.
    """
    before = F.call_function("regexp_extract", content, F.concat(F.lit("(?s)^(.*?)"), pattern), F.lit(1))
    return F.when((pattern != "") & F.regexp_like(content, pattern), F.length(before))


def find_anchor(content: Column, sentence: Column) -> Column:
    """Struct(offset, level): level 1 exact, 2 spacing, 3 punctuation, 4 head; -1/0 if none.

    An empty sentence matches at offset 0, as a plain substring search does.
    """
    exact = F.instr(content, sentence) - 1
    level1 = F.when(sentence == "", F.lit(0)).when(exact >= 0, exact)
    cleaned = clean_for_match(sentence)
    level2 = _offset(content, _spaced_pattern(sentence))
    level3 = _offset(content, _clean_pattern(cleaned))
    level4 = _offset(content, _clean_pattern(F.left(cleaned, F.lit(HEAD_CHARS))))

    def hit(value: Column, level: int) -> Column:
        return F.when(value.isNotNull(), F.struct(value.cast("int").alias("offset"), F.lit(level).alias("level")))

    return F.coalesce(
        hit(level1, 1),
        hit(level2, 2),
        hit(level3, 3),
        hit(level4, 4),
        F.struct(F.lit(-1).alias("offset"), F.lit(0).alias("level")),
    )
