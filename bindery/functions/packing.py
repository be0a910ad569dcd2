"""Order-dependent folds over arrays held in one row.

`scan` emits one value per element of a left fold. Appending to an array on
every step would copy it every time, so elements are folded in slices and the
slices are flattened once: the copying cost stays near linear in practice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import TERMINATORS, let, sentences, strip

SLICE = 256

# Fragment and chunk sizes.
FRAGMENT_MIN = 300
FRAGMENT_MAX = 800
SEGMENT_TARGET = 2_600
SEGMENT_TRIGGER = 6_500
MODULE_CHARS = 12_000


def scan(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column], Column],
    emit_type: str,
) -> Column:
    """Left fold keeping `emit(state)` after every element.

    `zero` and `step` must give structs of the same type.
    """
    empty = F.array().cast(f"array<{emit_type}>")
    nested = F.array().cast(f"array<array<{emit_type}>>")

    def inner(state: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(state.alias("s"), empty.alias("o")),
            lambda acc, x: let(
                step(acc["s"], x),
                lambda nxt: F.struct(nxt.alias("s"), F.concat(acc["o"], F.array(emit(nxt))).alias("o")),
            ),
        )

    count = F.size(items)
    parts = F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), F.floor((count - 1) / SLICE).cast("int")),
            lambda b: F.slice(items, b * SLICE + 1, SLICE),
        ),
    ).otherwise(F.array(items))
    folded = F.aggregate(
        parts,
        F.struct(zero.alias("s"), nested.alias("o")),
        lambda acc, part: let(
            inner(acc["s"], part),
            lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")),
        ),
    )
    return F.flatten(folded["o"])


def pack_numbers(sizes: Column, maximum: int | Column, separator: int = 0) -> Column:
    """1-based chunk number of each element under greedy packing.

    A chunk takes the next element while its size, plus the separator, plus
    the element stays within `maximum`; an oversized element stands alone.
    """
    limit = F.lit(maximum) if isinstance(maximum, int) else maximum
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("no"))

    def step(s: Column, n: Column) -> Column:
        fits = (s["size"] > 0) & (s["size"] + separator + n <= limit)
        return F.struct(
            F.when(fits, s["size"] + separator + n).otherwise(n).alias("size"),
            F.when(fits, s["no"]).otherwise(s["no"] + 1).alias("no"),
        )

    return scan(sizes, zero, step, lambda s: s["no"], "int")


def regroup(items: Column, numbers: Column, joiner: str) -> Column:
    """Join neighbouring items that carry the same number."""
    return let(
        F.struct(items.alias("i"), numbers.alias("n")),
        lambda z: let(
            F.struct(
                z["i"].alias("i"),
                F.filter(
                    F.transform(
                        z["n"],
                        lambda n, k: F.when((k == 0) | (n != F.get(z["n"], F.greatest(k - 1, F.lit(0)))), k + 1),
                    ),
                    lambda k: k.isNotNull(),
                ).alias("starts"),
            ),
            lambda y: F.transform(
                y["starts"],
                lambda at, k: F.array_join(
                    F.slice(
                        y["i"], at, F.coalesce(F.get(y["starts"], k + 1), F.size(y["i"]) + 1) - at
                    ),
                    joiner,
                ),
            ),
        ),
    )


def pack(items: Column, maximum: int, separator: int, joiner: str = "\n\n") -> Column:
    sizes = F.transform(items, lambda x: F.length(x))
    return regroup(items, pack_numbers(sizes, maximum, separator), joiner)


def hard_cuts(c: Column, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.length(c), F.lit(1)) - 1) / width).cast("int")),
        lambda i: F.substring(c, i * width + 1, F.lit(width)),
    )


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda p: p != "")


def fragment_atoms(c: Column, maximum: int = FRAGMENT_MAX, terminators: str = TERMINATORS) -> Column:
    """Paragraphs; long ones as sentences; long sentences cut at `maximum`."""

    def from_sentence(s: Column) -> Column:
        return F.when(F.length(s) <= maximum, F.array(s)).otherwise(hard_cuts(s, maximum))

    def from_paragraph(p: Column) -> Column:
        return F.when(F.length(p) <= maximum, F.array(p)).otherwise(
            F.flatten(F.transform(sentences(p, terminators), from_sentence))
        )

    return F.flatten(F.transform(paragraphs(c), from_paragraph))


def merge_short_tail(frags: Column, minimum: int, maximum: int) -> Column:
    """Append a short last fragment to the one before it when both fit."""

    def rule(f: Column) -> Column:
        n = F.size(f)
        last, prev = F.get(f, n - 1), F.get(f, n - 2)
        small = (n > 1) & (F.length(last) < minimum) & (F.length(prev) + 2 + F.length(last) <= maximum)
        return F.when(
            small, F.concat(F.slice(f, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(F.concat_ws("\n\n", prev, last)))
        ).otherwise(f)

    return let(frags, rule)


def pack_fragments(atoms: Column, minimum: int = FRAGMENT_MIN, maximum: int = FRAGMENT_MAX) -> Column:
    return merge_short_tail(pack(atoms, maximum, 2), minimum, maximum)


def semantic_chunks(c: Column, target: int = SEGMENT_TARGET, terminators: str = TERMINATORS) -> Column:
    """Paragraphs (sentences where there is one paragraph) packed without separator cost."""

    def units(p: Column) -> Column:
        cut = F.filter(F.transform(F.split(c, f"(?<=[{terminators}])"), strip), lambda s: s != "")
        return F.when(F.size(p) > 1, p).otherwise(cut)

    return let(
        let(paragraphs(c), units),
        lambda u: F.when(F.size(u) > 0, pack(u, target, 0)).otherwise(F.array(c)),
    )


def split_markdown(c: Column, maximum: int) -> Column:
    """Blank-line blocks, then lines, then hard cuts, packed with the separator counted."""
    text = strip(c)
    blocks = F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda b: b != "")

    def from_line(line: Column) -> Column:
        return F.when(F.length(line) <= maximum, F.array(line)).otherwise(hard_cuts(line, maximum))

    def from_block(b: Column) -> Column:
        lines = F.filter(F.split(b, "\n"), lambda x: strip(x) != "")
        return F.when(F.length(b) <= maximum, F.array(b)).otherwise(F.flatten(F.transform(lines, from_line)))

    long = pack(F.flatten(F.transform(blocks, from_block)), maximum, 2)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.length(text) <= maximum, F.array(text))
        .otherwise(long)
    )


def occurrence_numbers(keys: Column) -> Column:
    """For each element, how many equal elements occurred up to and including it."""
    tagged = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    zero = F.struct(
        F.lit(None).cast("string").alias("k"), F.lit(0).alias("i"), F.lit(0).alias("n")
    )

    def step(s: Column, x: Column) -> Column:
        return F.struct(
            x["k"].alias("k"),
            x["i"].alias("i"),
            F.when(s["k"] == x["k"], s["n"] + 1).otherwise(F.lit(1)).alias("n"),
        )

    numbered = scan(
        tagged, zero, step, lambda s: F.struct(s["i"].alias("i"), s["n"].alias("n")), "struct<i:int,n:int>"
    )
    return F.transform(F.array_sort(numbered), lambda s: s["n"])
