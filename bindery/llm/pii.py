"""Personal data: base patterns, and bootstrapped contextual extraction on top.

Matches of the base patterns are seeds. The words around them induce lexical
patterns; everything that looks like an identifier and stands in such a
context is an instance. Pattern and instance scores are refined in rounds over
the pattern-instance graph: a pattern is as good as the share of its distinct
instances that are known, an instance as good as its best pattern. Instances
of patterns with high confidence are found where no base pattern sees them.

Surface forms are compared by hash and counted once, so copies of a document
add nothing. Scores are aggregates over the whole corpus with map-side sums.
"""

from __future__ import annotations

import bisect
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .flat import text_slices
from .rows import mark_members

KINDS = ("email", "ip", "card", "phone")
#: Rounds over the graph; distinct known instances and share of them that a pattern needs.
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE = 3, 5, 0.8

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits unless one starts at its head.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Something like an identifier: a word with a digit or @, and digit groups behind it.
_WORD = re.compile(r"(?<![^\s\",;:'<>|])(?=[^\s\",;:'<>|]*[0-9@])[^\s\",;:'<>|]+(?: [0-9()+.-]*[0-9][0-9()+.-]*)*")
_MARK = re.compile(r"[0-9@]")
_TRIM = ".!?*%#$&=()[]{}"
_SHAPES = str.maketrans({**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A")})


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in this order; code points, end exclusive."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _words(text: str) -> list[str]:
    return [w for w in (x.strip(".,;!?()\"'") for x in text.lower().split()) if w]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or -1, surface, contexts) of base spans and of what else looks like an identifier."""
    found = [(s, e, k) for s, k, e in spans]
    # Spans by start, and the furthest end of each and those before it: one bisection tells an overlap.
    starts, ends = [s for s, _, _ in spans], list(itertools.accumulate((e for _, _, e in spans), max))
    for m in _WORD.finditer(text) if _MARK.search(text) else ():
        raw = m.group()
        start = m.start() + len(raw) - len(raw.lstrip(_TRIM))
        surface = raw.strip(_TRIM)
        end = start + len(surface)
        if len(surface) < 6 or sum(c.isdigit() for c in surface) < 4 and "@" not in surface:
            continue
        before = bisect.bisect_left(starts, end)
        if not before or ends[before - 1] <= start:
            found.append((start, end, -1))
    out = []
    for start, end, kind in found:
        surface = text[start:end]
        left, right = _words(text[max(0, start - 80) : start])[-2:], _words(text[end : end + 40])[:1]
        contexts = []
        if len(left) == 2:
            contexts.append("l2\t" + "\t".join(left))
        if left and right:
            contexts.append(f"lr\t{left[-1]}\t{right[0]}")
        if left:
            shape = re.sub(r"(.)\1+", r"\1+", surface.translate(_SHAPES))
            contexts.append(f"ls\t{left[-1]}\t{shape}")
        out.append((start, end, kind, surface, contexts))
    return out


def _scan(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, k, spans, found): base spans and candidates of every document; k tells rows of one id apart."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    cand = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("surface", pa.string()), ("contexts", pa.list_(pa.string()))])

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for lo, hi, data, offsets in text_slices(column):
                spans, found = [[]] * (hi - lo), [[]] * (hi - lo)
                for i in marked(data, offsets).tolist():
                    value = column[lo + i].as_py()
                    own = base_spans(value)
                    spans[i] = [{"start": s, "kind": k, "end": e} for s, k, e in own]
                    found[i] = [{"start": s, "end": e, "kind": k, "surface": x, "contexts": c} for s, e, k, x, c in candidates(value, own)]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(cand))], ["doc_id", "k", "spans", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text)).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, k bigint, spans array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,kind:int,surface:string,contexts:array<string>>>")


_MARKS = np.zeros(256, bool)
_MARKS[[*range(48, 58), 64]] = True


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a slice whose text has a digit or an @: a byte of work space per byte of text."""
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    return filled[np.logical_or.reduceat(_MARKS[data], offsets[filled])] if len(filled) else filled


def induce(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(context, kind, confidence): the contexts that high-confidence patterns consist of.

    `found` has instance (a hash), kind (-1: none known) and contexts.
    """
    edges = cut_lineage(found.select("instance", F.explode("contexts").alias("context")).distinct())
    known = found.where("kind >= 0").select("instance", "kind").distinct()
    size = edges.groupBy("context").agg(F.count(F.lit(1)).alias("size"))
    scores = known.withColumn("score", F.lit(1.0))
    for turn in range(rounds):
        support = edges.join(scores, "instance").groupBy("context", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support"))
        patterns = support.where(F.col("support") >= min_support).join(size, "context").select("context", "kind", (F.col("mass") / F.col("size")).alias("confidence"))
        patterns = cut_lineage(patterns.where(F.col("confidence") >= min_confidence))
        if turn + 1 < rounds:
            reached = edges.join(patterns, "context").groupBy("instance", "kind").agg(F.max("confidence").alias("score"))
            scores = cut_lineage(known.withColumn("score", F.lit(1.0)).union(reached).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    # A context may serve several kinds: the best one names what it finds.
    return patterns.groupBy("context").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"), F.max("confidence").alias("confidence"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, k, spans, more): base spans of every document, and those that patterns add.

    Spans are (start, kind, end) in code points, kind an index of `KINDS`; `k`
    is the hash of the text. Added spans overlap no base span. A null text is
    empty; ids may be null or repeat, each row gives a row; no rows in, no
    rows out.
    """
    rows = cut_lineage(_scan(docs, id_col, text))
    found = rows.select("doc_id", "k", F.explode("found").alias("f")).select("doc_id", "k", F.xxhash64("f.surface").alias("instance"), "f.start", "f.end", "f.kind", "f.contexts")
    patterns = induce(found, **settings)
    unseen = found.where("kind < 0").select("doc_id", "k", "start", "end", F.explode("contexts").alias("context")).join(patterns, "context")
    best = unseen.groupBy("doc_id", "k", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    more = best.groupBy("doc_id", "k").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("more"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("k2"))
    joined = rows.join(more.select(F.col("doc_id").alias("d"), F.col("k").alias("k2"), "more"), same, "left")
    return joined.select("doc_id", "k", "spans", F.coalesce("more", F.filter("spans", lambda _: F.lit(False))).alias("more"))


def listing(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` with each span of personal data replaced by its kind in brackets; `n_chars`, if there, follows the text.

    Null texts stay null; other columns are unchanged. Overlapping spans are
    replaced as one, named after the first. Texts are shuffled only for rows
    in which patterns found more than the base ones.
    """
    names = [f"`{c}`" for c in docs.columns]
    found = cut_lineage(find(docs, id_col, text, **settings).where("size(more) > 0").select("doc_id", "k", "more").distinct())
    rows = docs.select(F.struct(*map(F.col, names)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text)).alias("k"))
    rows = mark_members(rows, F.struct("id", "k"), found, F.struct(F.col("doc_id"), F.col("k")), "_more")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("k2"))
    some = rows.where("_more").join(found.withColumnRenamed("k", "k2"), same, "left").select("row", F.coalesce("more", empty).alias("more"))
    every = rows.where("NOT _more").select("row", empty.alias("more")).unionByName(some).select("row.*", F.col("more").alias("_found"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                column, extra = part.column(at), part.column(batch.num_columns - 1)
                out = column.to_pylist()
                for i in set(marked(data, offsets).tolist()).union(np.flatnonzero(np.asarray(extra.value_lengths())).tolist()):
                    if out[i]:
                        out[i] = _replace(out[i], sorted(base_spans(out[i]) + [(s["start"], s["kind"], s["end"]) for s in extra[i].as_py()]))
                arrays = part.columns[:-1]
                arrays[at] = pa.array(out, column.type)
                if "n_chars" in part.schema.names:
                    j = part.schema.get_field_index("n_chars")
                    arrays[j] = pa.array([old if new is None else len(new) for old, new in zip(part.column(j).to_pylist(), out, strict=True)], part.column(j).type)
                yield pa.RecordBatch.from_arrays(arrays, part.schema.names[:-1])

    return every.mapInArrow(run, docs.schema)


def _replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])
