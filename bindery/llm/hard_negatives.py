"""Hard negatives by angular triangle filtering, exact in whole numbers.

Every vector is stored with its norm and its angles to a few reference
directions. For two vectors the angles to one reference bound the angle
between them from both sides (triangle inequality on the sphere), which bounds
their cosine, and times the norms their inner product. The bounds are widened
by more than any rounding, so what they exclude is excluded for certain.

Vectors lie in cells: the nearest reference, and a ring of angles around it.
The same bounds over the extremes of a cell tell an anchor which cells it has
to visit, and over single vectors which of them need a score at all. Scores
are integer inner products. First the positives of each anchor are looked for
above a score that a sample proves to be reached; then the negatives, in the
windows of scores that the positives span.

References, rings and that first threshold come from a bounded sample; all
vectors are stored, and the answer does not depend on the sample.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage

#: Vectors that references, rings and thresholds are taken from, at most.
SAMPLE = 8192
REFERENCES, MAX_RINGS, ROUNDS = 16, 64, 6
#: Vectors of a cell, and anchors that visit it, that one task is given at once.
BLOCK, ASKED = 4096, 1024
#: Anchors that are scored at once.
SLICE = 128
#: Radians that an angle can be off by rounding (angles are stored in single precision), generously; share that a score can.
ANGLE, SHARE = 4e-6, 1e-9
#: Score of a pair that was not scored.
NONE = np.iinfo(np.int64).min
#: Products of norms below this are exact in doubles; bounds are cut a little inside the range of a long.
_EXACT, _LONG = float(1 << 52), 9.2e18


class Frame:
    """Reference directions (spherical k-means of a sample) and the ring edges around each."""

    def __init__(self, sample: np.ndarray, references: int = REFERENCES, rings: int = 1, seed: int = 7):
        norm = np.sqrt((sample * sample).sum(1))
        unit = sample[norm > 0] / norm[norm > 0, None]
        rng = np.random.default_rng(seed)
        if not len(unit):
            unit = np.eye(1, max(sample.shape[1], 1))
        at = unit[np.sort(rng.choice(len(unit), min(references, len(unit)), replace=False))]
        for _ in range(ROUNDS):
            own = np.argmax(unit @ at.T, axis=1)
            for r in range(len(at)):
                middle = unit[own == r].sum(0)
                if (length := np.linalg.norm(middle)) > 1e-9:
                    at[r] = middle / length
        self.directions, self.rings = at, rings
        angles = self.angles(unit)
        near, least = angles.argmin(1), angles.min(1)
        shares = np.arange(1, rings) / rings
        self.edges = [np.quantile(least[near == r], shares) if (near == r).any() else np.linspace(0, math.pi, rings + 1)[1:-1] for r in range(len(at))]

    def angles(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1))
        cosine = (x @ self.directions.T) / np.where(norm > 0, norm, 1)[:, None]
        return np.arccos(np.clip(cosine, -1, 1))

    def cells(self, angles: np.ndarray) -> np.ndarray:
        near, least = angles.argmin(1), angles.min(1)
        ring = np.zeros(len(angles), np.int64)
        for r in range(len(self.directions)):
            ring[near == r] = np.searchsorted(self.edges[r], least[near == r])
        return near * self.rings + ring

    @property
    def count(self) -> int:
        return len(self.directions) * self.rings


def score_bounds(norms, angles, least_norm, most_norm, least_angle, most_angle) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (vectors, ranges) of the inner products of vectors with all that lies in a range.

    A range has norms between two values and, for each reference, angles
    between two values; for a single vector both ends are the same.
    """
    low = np.zeros((len(norms), len(least_norm)), np.float32)
    high = np.full(low.shape, math.pi, np.float32)
    for j in range(angles.shape[1]):
        own, least, most = angles[:, j : j + 1], least_angle[None, :, j], most_angle[None, :, j]
        np.maximum(low, own - most, out=low)
        np.maximum(low, least - own, out=low)
        np.minimum(high, own + most, out=high)
        np.minimum(high, np.float32(2 * math.pi) - own - least, out=high)
    best = np.cos(np.maximum(low.astype(np.float64) - ANGLE, 0))
    worst = np.cos(np.minimum(high.astype(np.float64) + ANGLE, math.pi))
    upper = norms[:, None] * best * np.where(best >= 0, most_norm, least_norm)
    lower = norms[:, None] * worst * np.where(worst >= 0, least_norm, most_norm)
    # Scores end at the range of a long.
    return np.minimum(lower - np.abs(lower) * SHARE - 1, _LONG), np.maximum(upper + np.abs(upper) * SHARE + 1, -_LONG)


def products(a: np.ndarray, b: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of `a` with those of `b` where `wanted`, `NONE` elsewhere.

    Doubles hold every partial sum exactly while the norms are small; beyond
    that Python's integers do, and the result ends at the range of a long.
    """
    out = np.full(wanted.shape, NONE, np.int64)
    rows, columns = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
    if not len(rows):
        return out
    x, y = a[rows].astype(np.float64), b[columns].astype(np.float64)
    if math.sqrt((x * x).sum(1).max()) * math.sqrt((y * y).sum(1).max()) < _EXACT:
        exact = np.rint(x @ y.T).astype(np.int64)
    else:
        exact = np.clip(a[rows].astype(object) @ b[columns].T.astype(object), NONE + 1, np.iinfo(np.int64).max).astype(np.int64)
    out[np.ix_(rows, columns)] = np.where(wanted[np.ix_(rows, columns)], exact, NONE)
    return out


def at_least(score: np.ndarray, low: tuple[int, int]) -> np.ndarray:
    """The least whole number n with den * n >= num * score, for low = (num, den)."""
    num, den = low
    return score // den * num - -(score % den * num) // den


def _matrix(column, kind=np.int64) -> np.ndarray:
    values = np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten(), dtype=kind)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


class Side:
    """The columns of stored vectors, by id."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        column = lambda name: table.column(table.schema.get_field_index(name))
        self.id, self.label, self.norm = (np.asarray(column(c)) for c in ("id", "label", "norm"))
        self.angles, self.q = _matrix(column("angles"), np.float32), _matrix(column("q"))

    def part(self, at) -> Side:
        new = object.__new__(Side)
        for name, value in vars(self).items():
            setattr(new, name, value[at])
        return new

    def bounds(self, other: Side) -> tuple[np.ndarray, np.ndarray]:
        return score_bounds(self.norm, self.angles, other.norm, other.norm, other.angles, other.angles)


def _first(row: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the first `k` of their row; equal rows lie together."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k


def best_same(anchors: Side, others: Side, need: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor row, other row, score): the `k` best of the same label that reach `need`, ties to the smaller id. `others` is sorted by id."""
    _, upper = anchors.bounds(others)
    wanted = (anchors.label[:, None] == others.label) & (anchors.id[:, None] != others.id) & (upper >= need[:, None])
    score = products(anchors.q, others.q, wanted)
    keep = min(k, score.shape[1])
    last = np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep]
    a, x = np.nonzero((score >= np.maximum(last, need.astype(np.int64))[:, None]) & (score > NONE))
    s = score[a, x]
    order = np.lexsort((x, -s, a))
    order = order[_first(a[order], k)]
    return a[order], x[order], s[order]


def in_windows(anchors: Side, others: Side, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each column of `low` and `high` (anchors, windows): (anchor row, other row, score) of the `k` first of another label in the window."""
    least, most = anchors.bounds(others)
    different = anchors.label[:, None] != others.label
    wanted = np.zeros(different.shape, bool)
    for j in range(low.shape[1]):
        wanted |= different & (most >= low[:, j : j + 1]) & (least <= high[:, j : j + 1]) & (low[:, j] <= high[:, j])[:, None]
    score = products(anchors.q, others.q, wanted)
    a, x = np.nonzero(score > NONE)
    s = score[a, x]
    some = (s >= low.min(1)[a]) & (s <= high.max(1)[a])
    a, x, s = a[some], x[some], s[some]
    order = np.lexsort((x, -s, a))
    a, x, s = a[order], x[order], s[order]
    out = []
    for j in range(low.shape[1]):
        inside = np.flatnonzero((s >= low[a, j]) & (s <= high[a, j]))
        inside = inside[_first(a[inside], k)]
        out.append((a[inside], x[inside], s[inside]))
    return out


_STORED = "id bigint, label bigint, norm double, angles array<float>, q array<bigint>"


class Index:
    """Stored vectors in cells, with the extremes of each cell."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, references: int = REFERENCES, block: int = BLOCK):
        """`rows` (id, label, q, anchor) with distinct ids and vectors of one size; not empty."""
        total = rows.count()
        chosen = rows.orderBy(F.xxhash64("id"), "id").select("id", "label", "q").limit(sample).toArrow()
        base = _matrix(chosen.column("q"))
        rings = max(1, min(MAX_RINGS, math.ceil(total / (references * block))))
        frame = Frame(base.astype(np.float64), references, rings)
        context = rows.sparkSession.sparkContext
        # Bounded by `sample`, whatever the size of the table.
        self.known = context.broadcast((frame, np.asarray(chosen.column("id")), np.asarray(chosen.column("label")), base))
        known, self.block = self.known, block

        def place(batches):
            for batch in batches:
                q = _matrix(batch.column(2)).astype(np.float64)
                angles = known.value[0].angles(q)
                flat = pa.array(angles.astype(np.float32).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * angles.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array(known.value[0].cells(angles).astype(np.int32)), batch.column(3), batch.column(0), batch.column(1), pa.array(np.sqrt((q * q).sum(1))), lists, batch.column(2)], ["cell", "anchor", "id", "label", "norm", "angles", "q"])

        self.table = cut_lineage(rows.select("id", "label", "q", "anchor").mapInArrow(place, f"cell int, anchor boolean, {_STORED}"))
        m = len(frame.directions)
        ends = [f(F.col("angles")[j]).alias(f"{name}{j}") for j in range(m) for name, f in (("a", F.min), ("z", F.max))]
        found = self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("lo"), F.max("norm").alias("hi"), *ends).collect()  # a row per cell: bounded
        self.sizes = np.zeros(frame.count, np.int64)
        cells = [np.zeros(frame.count), np.zeros(frame.count), np.zeros((frame.count, m), np.float32), np.zeros((frame.count, m), np.float32)]
        for r in found:
            self.sizes[r["cell"]] = r["n"]
            cells[0][r["cell"]], cells[1][r["cell"]] = r["lo"], r["hi"]
            cells[2][r["cell"]], cells[3][r["cell"]] = [r[f"a{j}"] for j in range(m)], [r[f"z{j}"] for j in range(m)]
        self.cells = context.broadcast(cells)

    def meet(self, anchors: DataFrame, extra: str, visits, pair, schema: str) -> DataFrame:
        """What `pair` yields for each anchor in each cell that it visits.

        `anchors` has the stored columns and `extra`; `visits(batch, lower,
        upper)` says by the bounds of the cells which are visited, and
        `pair(others, anchors, table)` makes the rows of a block. Cells and
        their visitors are dealt out over blocks of bounded size.
        """
        cells, sizes, block = self.cells, self.sizes, self.block
        blocks = np.maximum(-(-sizes // block), 1)
        kinds = f"{_STORED}, {extra}"

        def reach(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    side = Side(part)
                    wanted = visits(part, *score_bounds(side.norm, side.angles, *cells.value)) & (sizes > 0)
                    places = [np.flatnonzero(w) for w in wanted]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(places, pa.list_(pa.int32()))], [*part.schema.names, "places"])

        reached = cut_lineage(anchors.mapInArrow(reach, f"{kinds}, places array<int>"))
        asked = np.zeros(len(sizes), np.int64)
        for r in reached.select(F.explode("places").alias("p")).groupBy("p").count().collect():  # a row per cell as well
            asked[r["p"]] = r["count"]
        parts = np.maximum(-(-asked // ASKED), 1)
        lookup = lambda values: F.array(*[F.lit(int(v)) for v in values])
        own = lambda values, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.element_at(lookup(values), F.col("cell") + 1)).cast("int")
        every = lambda values: F.sequence(F.lit(0), F.element_at(lookup(values), F.col("cell") + 1) - 1)
        askers = reached.select("*", F.explode("places").alias("cell")).drop("places").withColumn("part", own(parts, "part")).withColumn("block", F.explode(every(blocks)))
        stored = self.table.drop("anchor").where(F.element_at(lookup(asked > 0), F.col("cell") + 1) > 0).withColumn("block", own(blocks, "block")).withColumn("part", F.explode(every(parts)))
        place = ("cell", "block", "part")

        def join(left, right):
            if not left.num_rows or not right.num_rows:
                return pa.table({name: [] for name in fields.names}, schema=fields)
            return pair(Side(left.sort_by("id")), Side(right), right)

        fields = pa.schema([(c.split()[0], {"bigint": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in schema.split(", ")])
        return stored.groupBy(*place).cogroup(askers.groupBy(*place)).applyInArrow(join, schema)


def positives(index: Index, k: int) -> DataFrame:
    """(id, positives): the `k` best of the same label for each anchor, as (id, score), best first."""
    known = index.known

    def threshold(batches):
        """The k-th best score among the sample, which the k-th best of all reaches; lowest where the sample has fewer."""
        _, ids, labels, base = known.value
        for batch in batches:
            need = []
            for at in range(0, batch.num_rows, SLICE):
                side = Side(batch.slice(at, SLICE))
                score = products(side.q, base, (side.label[:, None] == labels) & (side.id[:, None] != ids))
                need.append(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] if score.shape[1] >= k else np.full(len(side.id), NONE))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(need), pa.int64())], [*batch.schema.names, "need"])

    def visits(batch, lower, upper):
        return upper >= np.asarray(batch.column(batch.schema.get_field_index("need")))[:, None]

    def pair(others, anchors, table):
        need = np.asarray(table.column("need"))
        out = []
        for at in range(0, len(anchors.id), SLICE):
            side = anchors.part(slice(at, at + SLICE))
            a, x, s = best_same(side, others, need[at : at + SLICE], k)
            out.append((side.id[a], others.id[x], s))
        return pa.table(dict(zip(("anchor", "other", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    asked = index.table.where("anchor").select("id", "label", "norm", "angles", "q").mapInArrow(threshold, f"{_STORED}, need bigint")
    found = index.meet(asked, "need bigint", visits, pair, "anchor bigint, other bigint, score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "other")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("other").alias("id"), "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    return found.groupBy(F.col("anchor").alias("id")).agg(listed.alias("positives"))


def negatives(index: Index, found: DataFrame, k: int, low: tuple[int, int]) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the positives that `found` lists."""

    def windows(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends (anchors, windows); anchors with fewer have windows that nothing lies in."""
        lists = column.to_pylist()
        width = max(map(len, lists), default=0)
        ids, score = np.zeros((len(lists), width), np.int64), np.full((len(lists), width), -1, np.int64)
        for i, own in enumerate(lists):
            for j, p in enumerate(own):
                ids[i, j], score[i, j] = p["id"], p["score"]
        return ids, at_least(score, low), score

    def visits(batch, lower, upper):
        _, least, most = windows(batch.column(batch.schema.get_field_index("positives")))
        out = np.zeros(lower.shape, bool)
        for j in range(least.shape[1]):
            out |= (upper >= least[:, j : j + 1]) & (lower <= most[:, j : j + 1]) & (least[:, j] <= most[:, j])[:, None]
        return out

    def pair(others, anchors, table):
        ids, least, most = windows(table.column("positives"))
        out = []
        for at in range(0, len(anchors.id), SLICE):
            to = slice(at, at + SLICE)
            side = anchors.part(to)
            for j, (a, x, s) in enumerate(in_windows(side, others, least[to], most[to], k)):
                out.append((side.id[a], ids[to][a, j], others.id[x], most[to][a, j], s))
        return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    asked = index.table.where("anchor").select("id", "label", "norm", "angles", "q").join(found, "id")
    rows = index.meet(asked, "positives array<struct<id:bigint,score:bigint>>", visits, pair, "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def usable(vector: Column) -> Column:
    """Not null and not empty, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, k_positive: int = 5, k_negative: int = 5, low: tuple[int, int] = (4, 5), scale: float = 256.0, id_col: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Components become floor(scale * x) and scores are integer inner products.
    Of each anchor the `k_positive` best others of its label are positives;
    for each of them the first `k_negative` rows of other labels follow whose
    score lies between `low` (a ratio) times the positive's score and the
    positive's score. Ties go to the smaller id.

    Rows with a null id or label, a vector that is null, empty or has a null
    or non-finite component, or one of another dimension than most (the
    smaller of two equally frequent) take no part. Of rows that share an id
    the one with the smallest label, then vector, takes part. Labels and ids
    are whole numbers. Values and scores beyond the range of a long end there.
    Without anchors, positives or rows in the windows there are no rows.
    """
    spark: SparkSession = vectors.sparkSession
    column = F.col(f"`{vector}`")
    q = F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & usable(column))
    rows = rows.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), label.cast("bigint").alias("label"), q.alias("q"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    dims = rows.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    one = rows.where(F.size("q") == dims["d"]).groupBy("id").agg(F.min(F.struct("label", "q")).alias("x"), F.max("anchor").alias("anchor"))
    index = Index(cut_lineage(one.select("id", "x.label", "x.q", "anchor")), **settings)
    return negatives(index, cut_lineage(positives(index, k_positive)), k_negative, low)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
