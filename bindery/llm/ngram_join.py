"""Jaccard self-join of word n-gram sets, and the components of its links.

Documents with the same set form a class, and classes are what is joined. All
sets are read in one global order of n-grams, rare first, so two sets over the
threshold share one of their first few n-grams (the prefix). Candidates come
from a join on prefix n-grams and pass a length, a positional and a suffix
filter; what is left is verified on whole sets, once per pair. The suffix
filter bounds the distance of two sets from below: n-grams fall into hash bins,
and a bin with an odd number of them in one set and an even number in the
other holds at least one in which they differ.

The order is: n-grams of a hashed universe (a fixed share of all n-grams) by
frequency, then the others by frequency. Frequencies of the universe are
exact counts over all classes. A prefix nearly always lies inside it, so the
others are needed only for classes, mostly tiny ones, with too few universe
n-grams; those send all of theirs. N-grams of a single class cannot join
anything: they are only counted.

Only components are asked for, so a pair whose classes are known to be
connected need not be looked at. First every posting list meets a few of its
own members, the same in all lists they lead, which connects the bulk of large
groups of near copies; then every pair still in different components is
compared. No list is cut and no pair in different components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .flat import bounds, mix
from .graph import components
from .rows import mark_members, shuffled_joins
from .shingles import WORDS, shingle_sets

#: Jaccard threshold as a ratio of whole numbers.
THRESHOLD = (4, 5)
#: Share of n-grams, by hash, that come first in the global order.
UNIVERSE = 0.4
#: Members of a posting list that all of it meets first.
PIVOTS = 16
#: In lists longer than LONG a pair is offered only by the first such list it shares,
#: as far as the first SEEN of them tell; it is offered once at least in any case.
LONG, SEEN = 32, 64
#: Hash bins whose parities the suffix filter compares, 64 to a number.
PARITY_WORDS = 8


def _prefix(n, threshold):
    num, den = threshold
    return n - (n * num + den - 1) // den + 1


def _class_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit key per set."""
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        at = offsets[:-1][full]
        total = np.add.reduceat(mix(values), at)
        cross = np.bitwise_xor.reduceat(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
        out[full] = mix(total + mix(cross + n[full].astype(np.uint64)))
    return out


def _parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity of every hash bin of each set, packed (sets, PARITY_WORDS)."""
    sets, bins = len(offsets) - 1, 64 * PARITY_WORDS
    cell = np.repeat(np.arange(sets), np.diff(offsets)) * bins + (values % np.uint64(bins)).astype(np.int64)
    odd = np.bincount(cell, minlength=sets * bins) & 1
    return np.packbits(odd.astype(np.uint8).reshape(sets, bins), axis=1).view(np.int64)


_PARITY = [f"s{i}" for i in range(PARITY_WORDS)]


def classes(docs: DataFrame, size: int = WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, c, s0, ...): size, key and bin parities of the set of each document."""

    def run(batches):
        for batch in batches:
            for lo, hi, values, offsets in shingle_sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(_class_keys(values, offsets).view(np.int64)), *map(pa.array, np.ascontiguousarray(_parities(values, offsets).T))], ["doc_id", "n_shingles", "c", *_PARITY])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text}` AS text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, c bigint, " + ", ".join(f"{x} bigint" for x in _PARITY))


def _in_universe(values: np.ndarray, universe: float) -> np.ndarray:
    return (values >> np.uint64(11)) < np.uint64(int(universe * (1 << 53)))


def _grams(docs: DataFrame, size: int, threshold, universe: float, text: str) -> DataFrame:
    """(h, c, nu): the n-grams that each class sends, once per task; nu: set size << 32 | how many lie in the universe."""

    def run(batches):
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, values, offsets in shingle_sets(batch.column(0), size):
                n = np.diff(offsets)
                key = _class_keys(values, offsets)
                _, first = np.unique(key, return_index=True)
                fresh = np.zeros(len(key), bool)
                fresh[first] = True
                fresh &= (n > 0) & ~np.isin(key, seen)
                seen = np.concatenate([seen, key[fresh]])
                row = np.repeat(np.arange(len(n)), n)
                inside = _in_universe(values, universe)
                u = np.bincount(row[inside], minlength=len(n))
                send = fresh[row] & (inside | (u < _prefix(n, threshold))[row])
                row = row[send]
                packed = (n << 32 | u)[row]
                yield pa.RecordBatch.from_arrays([pa.array(values[send].view(np.int64)), pa.array(key[row].view(np.int64)), pa.array(packed)], ["h", "c", "nu"])

    return docs.selectExpr(f"`{text}` AS text").mapInArrow(run, "h bigint, c bigint, nu bigint")


def postings(docs: DataFrame, size: int = WORDS, threshold=THRESHOLD, universe: float = UNIVERSE, text: str = "text") -> DataFrame:
    """(h, c, n, pos, prev): the prefix n-grams that two classes or more have, with their place in the class's ordered set.

    `prev` holds, for n-grams of long lists, those of the class that come before it.
    """
    sent = _grams(docs, size, threshold, universe, text)
    gram = Window.partitionBy("h")
    rows = sent.withColumns({"df": F.count(F.lit(1)).over(gram), "lo": F.min("c").over(gram), "hi": F.max("c").over(gram)}).where("lo <> hi")
    late = F.shiftrightunsigned("h", 11) >= F.lit(int(universe * (1 << 53)))
    rows = rows.select("h", "c", "nu", "df", late.alias("late")).dropDuplicates(["h", "c"])
    own = Window.partitionBy("c", "nu")
    placed = rows.withColumns({"i": F.row_number().over(own.orderBy("late", "df", "h")), "m": F.count(F.lit(1)).over(own), "e": F.count(F.when(~F.col("late"), 1)).over(own)})
    placed = placed.selectExpr("h", "c", "cast(shiftright(nu, 32) AS int) AS n", "cast(nu & 4294967295 AS int) AS u", "i", "m", "e", "late")
    num, den = threshold
    # N-grams of no other class come first in their part of the order.
    placed = placed.selectExpr("h", "c", "n", "cast(if(late, n - m, u - e) + i - 1 AS int) AS pos")
    placed = placed.where(f"pos < n - cast(floor((n * {num} + {den - 1}) / {den}) AS int) + 1")
    # Lists of one are of no use; long ones are remembered by the class for its later n-grams.
    placed = placed.withColumn("size", F.count(F.lit(1)).over(gram)).where("size > 1")
    before = Window.partitionBy("c", "n").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    long = F.col("size") > LONG
    rank = F.coalesce(F.count(F.when(long, 1)).over(before), F.lit(0))
    placed = placed.withColumn("long", long & (rank < SEEN))
    prev = F.when(long, F.collect_list(F.when(F.col("long"), F.col("h"))).over(before)).otherwise(F.array().cast("array<bigint>"))
    return placed.select("h", "c", "n", "pos", prev.alias("prev"))


def _close(threshold) -> str:
    """Length, positional and suffix filter of a candidate (c, n, pos, ...) and (c2, n2, pos2, ...), offered for the first time.

    A positional filter holds for the first n-gram shared. If that lies in a
    short list, the pair is offered there, whatever long lists say.
    """
    num, den = threshold
    apart = " + ".join(f"bit_count({x} ^ {x}2)" for x in _PARITY)
    return (
        f"{den} * least(n, n2) >= {num} * greatest(n, n2) AND {num + den} * (1 + least(n - pos - 1, n2 - pos2 - 1)) >= {num} * (n + n2)"
        f" AND {num + den} * ({apart}) <= {den - num} * (n + n2) AND NOT arrays_overlap(prev, prev2)"
    )


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text: str) -> DataFrame:
    """(c, n, hashes): the whole sets of the classes in `wanted` (c, n, doc_id), a document of each."""

    def run(batches):
        for batch in batches:
            for _, _, values, offsets in shingle_sets(batch.column(0), size):
                raw = pa.py_buffer(np.ascontiguousarray(values))
                key = _class_keys(values, offsets).view(np.int64)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(offsets * 8), raw])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.diff(offsets).astype(np.int32)), packed.cast(pa.binary())], ["c", "n", "hashes"])

    rows = mark_members(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), F.col("doc_id"), wanted, F.col("doc_id"), "_in")
    found = rows.where("_in").select("text").mapInArrow(run, "c bigint, n int, hashes binary")
    return found.join(wanted.select("c", "n").distinct(), ["c", "n"], "left_semi").groupBy("c", "n").agg(F.first("hashes").alias("hashes"))


def _verify(pairs: DataFrame, docs: DataFrame, members: DataFrame, size: int, threshold, id_col: str, text: str) -> DataFrame:
    """The pairs (c, n, c2, n2) whose whole sets reach the threshold, as (c, c2)."""
    num, den = threshold

    def compare(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            n, n2 = (np.asarray(batch.column(i)).astype(np.int64) for i in (1, 3))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (4, 5))
                if len(x) > len(y):
                    x, y = y, x
                spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                keep[i] = (num + den) * int((y[spot] == x).sum()) >= num * (n[i] + n2[i])
            kept = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(2).take(pa.array(kept))], ["c", "c2"])

    ends = pairs.select("c", "n").union(pairs.select("c2", "n2")).distinct()
    wanted = members.join(ends, ["c", "n"], "left_semi")
    sets = cut_lineage(_sets(docs, wanted, size, id_col, text))
    left, right = (sets.selectExpr(f"c AS c{k}", f"n AS n{k}", f"hashes AS s{k}") for k in ("", "2"))
    both = pairs.join(left, ["c", "n"]).join(right, ["c2", "n2"]).select("c", "n", "c2", "n2", "s", "s2")
    return both.mapInArrow(compare, "c bigint, c2 bigint")


def join_components(docs: DataFrame, size: int = WORDS, threshold=THRESHOLD, universe: float = UNIVERSE, pivots: int = PIVOTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): a row per document, with the smallest id reachable over links.

    Two documents link when their sets' Jaccard similarity reaches the
    threshold, equal sets included. Texts without words (null, empty) have an
    empty set and no links. Null ids are kept and are never a component's id
    unless all its ids are null; repeated rows give repeated rows; an empty
    table gives no rows.
    """
    with shuffled_joins(docs.sparkSession):
        return _join_components(docs, size, threshold, universe, pivots, id_col, text)


def _join_components(docs: DataFrame, size: int, threshold, universe: float, pivots: int, id_col: str, text: str) -> DataFrame:
    known = cut_lineage(classes(docs, size, id_col, text))
    members = cut_lineage(known.where("n_shingles > 0").groupBy("c", F.col("n_shingles").cast("int").alias("n")).agg(F.min("doc_id").alias("doc_id"), *[F.min(x).alias(x) for x in _PARITY]))
    lists = cut_lineage(postings(docs, size, threshold, universe, text).join(members.drop("doc_id"), ["c", "n"]))
    place = ["c", "n", "pos", "prev", *_PARITY]

    def candidates(met: DataFrame, done: DataFrame | None = None) -> DataFrame:
        """The distinct pairs of `met` that pass the filters, but for those in `done`."""
        swap = "c > c2"
        pairs = met.where(_close(threshold)).selectExpr("least(c, c2) AS c", f"if({swap}, n2, n) AS n", "greatest(c, c2) AS c2", f"if({swap}, n, n2) AS n2").distinct()
        return cut_lineage(pairs if done is None else pairs.join(done, ["c", "c2"], "left_anti"))

    def linked(pairs: DataFrame) -> DataFrame:
        return _verify(pairs, docs, members, size, threshold, id_col, text)

    rank = F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("c", F.lit("lead")), "c"))
    lead = lists.withColumn("rank", rank).where(F.col("rank") <= pivots)
    met = lists.join(lead.selectExpr("h", *[f"{x} AS {x}2" for x in place]), "h").where("c <> c2")
    tested = candidates(met)
    # (c, root) of classes connected so far; empty where the leads found nothing.
    root = cut_lineage(components(linked(tested).toDF("a", "b")).withColumnRenamed("node", "c"))
    rows = lists.join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
    # What lies outside a list's largest component meets all of the list, so that component never meets itself.
    parts = rows.groupBy("h", "root").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("h").agg(F.max_by("root", F.struct("size", "root")).alias("big"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("h", "big")
    rows = cut_lineage(rows.join(mixed, "h"))
    every = rows.selectExpr("h", "big = root AS inside", *[f"{x} AS {x}2" for x in [*place, "root"]])
    met = rows.where("root <> big").join(every, "h").where("root <> root2 AND (inside OR c < c2)")
    rest = candidates(met, tested.select("c", "c2"))
    a, b = root.selectExpr("c", "root AS a"), root.selectExpr("c AS c2", "root AS b")
    more = linked(rest).join(a, "c", "left").join(b, "c2", "left").select(F.coalesce("a", "c").alias("a"), F.coalesce("b", "c2").alias("b"))
    moved = cut_lineage(components(more).withColumnRenamed("root", "top"))
    old = root.join(moved, F.col("root") == F.col("node"), "left").select("c", F.coalesce("top", "root").alias("root"))
    root = old.union(moved.select(F.col("node").alias("c"), F.col("top").alias("root")).join(root, "c", "left_anti"))
    label = members.select("c", "n", "doc_id").join(root, "c", "left").withColumn("root", F.coalesce("root", "c"))
    # The class with its set size names the component of classes that link nothing.
    top = label.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = label.join(top, "root").select(F.col("c").alias("k"), F.col("n").alias("kn"), "component_id")
    full = known.where("n_shingles > 0").join(named, (F.col("c") == F.col("k")) & (F.col("n_shingles") == F.col("kn")), "left").select("doc_id", "n_shingles", "component_id")
    return full.union(known.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """`docs` with one document of each component of `join_components`: the one whose id names it.

    Rows are decided by id: rows of an id that names a component all stay, so
    no text is lost where an id repeats. Other columns are unchanged, and only
    rows that may go are shuffled.
    """
    found = cut_lineage(join_components(docs, id_col=id_col, text=text, **settings).select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")))
    gone = found.groupBy("doc_id").agg(F.max("stays").alias("stays")).where("NOT stays").select("doc_id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    rows = mark_members(rows, F.col("id"), gone, F.col("doc_id"), "_gone")
    left = rows.where("_gone").join(gone, F.col("id").eqNullSafe(F.col("doc_id")), "left_anti")
    return rows.where("NOT _gone").select("row").unionByName(left.select("row")).select("row.*")
