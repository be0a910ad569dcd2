"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is then routed to one
leaf of each tree. A query walks all trees through one priority queue, widest
margin first, until the leaves it has reached hold enough vectors. Its
candidates are scored where their leaf lies and reranked exactly, in double
precision, on the original vectors.

Equal vectors are one class, with the few smallest ids that any answer can
need, so a vector that is repeated without end fills no leaf.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

#: Vectors that trees are fitted on, at most; they bound the depth of the trees too.
SAMPLE = 1 << 15
TREES = 16
#: Leaf entries that a query reaches, as a share of all vectors. Vectors without
#: any structure (recall 0.9 needs near half of them) set it; clustered ones need far less.
SEARCH_SHARE, SEARCH_LEAST = 0.8, 4096
#: Leaves that these entries make up: the search, not the input, sets how often a query is sent.
VISITS = 100
#: Vectors of a leaf, and queries that reached it, that one task is given at once.
BLOCK, ASKED = 4096, 4096
#: Queries that are scored at once, and pairs that are scored exactly at once.
SLICE, PAIRS = 256, 1 << 16
#: Rough scores this far below the last one that counts may still tie with it.
MARGIN = 1e-9


class Forest:
    """`normals` (trees, nodes, dims) and `cuts` (trees, nodes) of full binary trees, node i over 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, nodes = depth, (1 << depth) - 1
        dims = sample.shape[1]
        self.normals = np.zeros((trees, nodes, dims), np.float32)
        self.cuts = np.zeros((trees, nodes), np.float32)
        for t in range(trees):
            parts = [np.arange(len(sample))]
            for node in range(nodes):
                own = parts[node]
                normal = np.zeros(dims)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    normal = sample[a] - sample[b]
                if not np.linalg.norm(normal) > 1e-9:
                    normal = rng.standard_normal(dims)
                normal = (normal / np.linalg.norm(normal)).astype(np.float32)
                side = sample[own] @ normal
                cut = np.float32(np.median(side)) if len(own) else np.float32(0)
                self.normals[t, node], self.cuts[t, node] = normal, cut
                parts += [own[side <= cut], own[side > cut]]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector in each tree (vectors, trees)."""
        out = np.zeros((len(x), len(self.cuts)), np.int32)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("nd,nd->n", x, self.normals[t][node]) > self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - len(self.cuts[t])
        return out

    def probe(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold `enough` vectors."""
        nodes = self.cuts.shape[1]
        queue = [(-math.inf, t, 0) for t in range(len(self.cuts))]
        out, found = [], 0
        while queue and found < enough:
            worst, t, node = heapq.heappop(queue)
            while node < nodes:
                margin = float(q @ self.normals[t, node] - self.cuts[t, node])
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (max(worst, abs(margin)), t, 4 * node + 3 - near))
                node = near
            out.append((t, node - nodes))
            found += int(sizes[t, node - nodes])
        return out


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    values = np.asarray(column.flatten(), dtype=np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _repeat(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the running number of each copy, for rows that are copied `counts` times."""
    at = np.repeat(np.arange(len(counts)), counts)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)


def _copies(batch: pa.RecordBatch, at: np.ndarray, **more: np.ndarray):
    """Rows `at` of a batch with more columns before them, in batches of bounded size."""
    for i in range(0, len(at), BLOCK):
        rows = pa.array(at[i : i + BLOCK])
        yield pa.RecordBatch.from_arrays([*[pa.array(x[i : i + BLOCK].astype(np.int32)) for x in more.values()], *[c.take(rows) for c in batch.columns]], [*more, *batch.schema.names])


def _salt(keys) -> np.ndarray:
    return np.array([int(k[:12], 16) for k in keys.to_pylist()], np.int64)


def rank(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Of one block: the k + 1 best ids for each query that came to it."""
    ids = left.column("ids").to_pylist()
    x, every = (_matrix(t.column("v").combine_chunks()) if t.num_rows else np.zeros((0, 1)) for t in (left, right))
    lx = np.sqrt((x * x).sum(1))
    keys = right.column("q").to_pylist()
    q_out, id_out, score_out = [], [], []
    low = np.array([i[0] for i in ids])
    keep = min(len(x), k + 1)
    for start in range(0, len(every) if len(x) else 0, SLICE):
        y = every[start : start + SLICE]
        ly = np.sqrt((y * y).sum(1))
        rough = (y / ly[:, None]) @ (x / lx[:, None]).T
        last = np.partition(rough, len(x) - keep, axis=1)[:, len(x) - keep]
        row, near = np.nonzero(~(rough < last[:, None] - MARGIN))  # whatever may be among the best, ties included
        exact = np.concatenate([(x[n] * y[r]).sum(1) / (lx[n] * ly[r]) for r, n in ((row[a : a + PAIRS], near[a : a + PAIRS]) for a in range(0, len(row), PAIRS))])
        order = np.lexsort((low[near], -exact, row))
        for q, a in enumerate(np.searchsorted(row, np.arange(len(y)))):  # `order` keeps the rows where they are
            pairs = sorted((-exact[j], v) for j in order[a : a + keep] for v in ids[near[j]])[: k + 1]
            q_out += [keys[start + q]] * len(pairs)
            id_out += [v for _, v in pairs]
            score_out += [-s for s, _ in pairs]
    kind = left.schema.field("ids").type.value_type
    return pa.table([pa.array(q_out, pa.string()), pa.array(id_out, kind), pa.array(score_out, pa.float64())], names=["q", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, trees: int = TREES, search_share: float = SEARCH_SHARE, visits: int = VISITS, sample: int = SAMPLE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found by cosine, ties to the smaller id.

    Queries are the rows for which `is_query` holds; rows with a query's own
    id are no candidates for it. Rows whose id is null, whose vector is not
    `usable`, or has another dimension than most, take no part. An id that
    repeats counts with its nearest vector. With fewer candidates fewer rows
    come out, and with no vectors none.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector))).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], f"query_id {vectors.schema[id_col].dataType.simpleString()}, rank int, vec_id {vectors.schema[id_col].dataType.simpleString()}, score double")
    rows = rows.where(F.size("v") == dims["d"])
    first = Window.partitionBy("v").orderBy("id")
    least = rows.select("v", "id").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    kept = least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    asks = rows.groupBy("v").agg(F.max("q").alias("q")).withColumnRenamed("v", "w")
    index = cut_lineage(kept.join(asks, F.col("v") == F.col("w")).select(F.sha2(F.to_json("v"), 256).alias("key"), "v", "ids", "q"))
    total = index.count()
    search = max(math.ceil(search_share * total), SEARCH_LEAST)
    chosen = index.orderBy(F.xxhash64("key"), "key").select("v").limit(sample).toArrow()
    base = _matrix(chosen.column("v").combine_chunks())
    base = base / np.linalg.norm(base, axis=1, keepdims=True)
    depth = max(0, min(math.ceil(math.log2(max(total * visits / search, 1))), math.floor(math.log2(max(len(base) / 4, 1)))))
    forest = vectors.sparkSession.sparkContext.broadcast(Forest(base, depth, trees))  # bounded by `sample` and `trees`

    def unit(x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    def route(batches):
        for batch in batches:
            at = forest.value.leaves(unit(_matrix(batch.column(1))))
            n, t = at.shape
            pick = pa.array(np.repeat(np.arange(n), t))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(at.ravel()), *[batch.column(i).take(pick) for i in range(3)]], ["tree", "leaf", "key", "v", "ids"])

    id_kind = vectors.schema[id_col].dataType.simpleString()
    routed = cut_lineage(index.select("key", "v", "ids").mapInArrow(route, f"tree int, leaf int, key string, v array<double>, ids array<{id_kind}>"))
    sizes = np.zeros((trees, 1 << depth), np.int64)
    for r in routed.groupBy("tree", "leaf").count().collect():  # a row per leaf: bounded as the forest
        sizes[r["tree"], r["leaf"]] = r["count"]
    leaf_sizes = vectors.sparkSession.sparkContext.broadcast(sizes)

    def reach(batches):
        for batch in batches:
            places = [[t << depth | x for t, x in forest.value.probe(q, leaf_sizes.value, search)] for q in unit(_matrix(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.list_(pa.int32()))], ["q", "v", "places"])

    reached = cut_lineage(index.where("q").select("key", "v").mapInArrow(reach, "q string, v array<double>, places array<int>"))
    counts = np.zeros((trees, 1 << depth), np.int64)
    for r in reached.select(F.explode("places").alias("p")).groupBy("p").count().collect():  # a row per leaf as well
        counts[r["p"] >> depth, r["p"] & (1 << depth) - 1] = r["count"]
    leaf_asks = vectors.sparkSession.sparkContext.broadcast(counts)

    def ask(batches):
        """Send a query to every block of the leaves it reached, into one of their parts of the queries."""
        for batch in batches:
            places = batch.column(2)
            at = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(places.offsets)))
            p = np.asarray(places.flatten())
            t, x = p >> depth, p & (1 << depth) - 1
            part = _salt(batch.column(0))[at] % -(-leaf_asks.value[t, x] // ASKED)
            i, b = _repeat(-(-leaf_sizes.value[t, x] // BLOCK))
            yield from _copies(batch.select(["q", "v"]), at[i], tree=t[i], leaf=x[i], block=b, part=part[i])

    probes = reached.mapInArrow(ask, "tree int, leaf int, block int, part int, q string, v array<double>")

    def spread(batches):
        """Deal large leaves out over blocks, each to meet every part of the queries."""
        for batch in batches:
            t, x = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            block = _salt(batch.column(2)) % np.maximum(-(-leaf_sizes.value[t, x] // BLOCK), 1)
            i, part = _repeat(-(-leaf_asks.value[t, x] // ASKED))
            yield from _copies(batch, i, block=block[i], part=part)

    stored = routed.mapInArrow(spread, f"block int, part int, tree int, leaf int, key string, v array<double>, ids array<{id_kind}>")

    place = ("tree", "leaf", "block", "part")
    best_of = lambda _, left, right: rank(left, right, k)
    scored = stored.groupBy(*place).cogroup(probes.groupBy(*place)).applyInArrow(best_of, f"q string, vec_id {id_kind}, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    lists = top.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))
    queries = rows.where("q").select("id", F.sha2(F.to_json("v"), 256).alias("key")).distinct()
    own = queries.join(lists, F.col("key") == F.col("q")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    cut = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)
    answer = own.select(F.col("id").alias("query_id"), F.posexplode(cut).alias("i", "x"))
    return answer.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
