"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of two hashed embedding rows, so a word the model has not
seen rarely looks like one that it has. Filters over one, two and three words
are max-pooled over the whole text and feed one logistic unit. Embeddings
start from smoothed log-odds of the bucket, counted over all labelled texts,
and are trained with the filters: in every epoch each part of the rows trains
a copy of the model, and the copies are averaged. Thresholds are calibrated on
rows kept out of training, over all of them for the score's own 0.5 and by
language for the `toxic` decision. What reaches the driver has the size of the
model, however many rows are labelled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .flat import FOLD, bounds, ragged, span_hashes, text_slices, words
from .rows import mark_members

#: Labelled rows per copy of the model, while there are fewer copies than this.
PER_COPY, COPIES = 4096, 64
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Bits of the map of labelled ids, at most: 8 MiB.
MARK_BITS = 1 << 26
#: Texts that hold a bucket, for it to be trained.
MIN_SUPPORT = 3

#: Bytes between words: all of ASCII but letters and digits.
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_buckets(column):
    """(first row, row behind the last, buckets (2, words), first word of each text) by slices; case is folded."""
    for lo, hi, data, offsets in text_slices(column):
        data = FOLD[data]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        data[capital] += 32
        starts, ends, at = words(data, offsets, GAP)
        h = span_hashes(data, starts, ends)
        yield lo, hi, np.stack([h % np.uint64(BUCKETS), (h >> np.uint64(32)) % np.uint64(BUCKETS)]).astype(np.int32), at


@dataclass
class Model:
    """Trained parameters; `empty` when there were no labels of both kinds to learn from."""

    tables: np.ndarray = field(default_factory=lambda: np.zeros((2, 1, DIMS), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)  # (width, DIMS, FILTERS) each
    bias: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out_bias: float = 0.0
    by_language: dict[str, float] = field(default_factory=dict)
    empty: bool = True

    def pooled(self, buckets: np.ndarray, at: np.ndarray, where: bool = False):
        """Greatest response of each filter over each text (texts, filters), and its word if `where`."""
        n, texts = buckets.shape[1], len(at) - 1
        out = np.zeros((texts, len(self.bias)), np.float32)
        place = np.zeros((texts, len(self.bias)), np.int64)
        full = np.flatnonzero(np.diff(at) > 0)
        if not n:
            return out, place, full
        x = self.tables[0][buckets[0]] + self.tables[1][buckets[1]]
        left = np.repeat(at[1:], np.diff(at)) - np.arange(n)  # words up to the end of the text
        for k, (width, w) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            y = x @ w[0]
            for j in range(1, width):
                y[:-j] += (x[j:] @ w[j]) * (left[:-j] > j)[:, None]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top = np.maximum.reduceat(y, at[full], axis=0)
            out[full, cols] = top
            if where:
                hit = y == np.repeat(top, np.diff(at)[full], axis=0)
                order = np.where(hit, np.arange(n)[:, None], n)
                place[full, cols] = np.minimum.reduceat(order, at[full], axis=0)
        return out, place, full

    def logits(self, buckets: np.ndarray, at: np.ndarray) -> np.ndarray:
        pooled, _, _ = self.pooled(buckets, at)
        return np.maximum(pooled + self.bias, 0).astype(np.float64) @ self.out + self.out_bias


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)


#: Averages are sums of whole numbers, so that their order does not matter: values count in this many parts of 1.
PARTS = 1 << 28
#: Logits are told apart by so many steps of 1 when a threshold is sought.
STEPS = 1 << 10


@dataclass
class _Learner:
    """A model in training; `live` marks the buckets that are trained, `touched` those that have been."""

    model: Model
    live: np.ndarray
    weights: tuple[float, float]  # of a row that is not toxic, of one that is
    rows: int = 0
    touched: np.ndarray = field(default_factory=lambda: np.zeros((2, BUCKETS), bool))
    adam: _Adam = field(default_factory=lambda: _Adam(0.01))

    def dense(self) -> list[np.ndarray]:
        m = self.model
        return [*m.filters, m.bias, m.out, np.array([m.out_bias], np.float32)]

    def learn(self, buckets: np.ndarray, at: np.ndarray, toxic: np.ndarray, rng: np.random.Generator) -> None:
        """One pass over some texts, in steps of 64."""
        order = rng.permutation(len(toxic))
        for lo in range(0, len(order), 64):
            some = order[lo : lo + 64]
            sizes = np.diff(at)[some]
            self._step(buckets[:, ragged(at[some], sizes)], bounds(sizes), toxic[some])
        self.rows += len(toxic)

    def _step(self, b: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> None:
        model, adam = self.model, self.adam
        pooled, place, full = model.pooled(b, at, where=True)
        act = np.maximum(pooled + model.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.out_bias, -30, 30)))
        g = (np.where(toxic, self.weights[1], self.weights[0]) * (p - toxic) / len(toxic)).astype(np.float32)
        back = g[:, None] * model.out * (pooled + model.bias > 0)
        adam.t += 1
        adam.step("out", model.out, act.T @ g)
        out_bias = np.array([model.out_bias], np.float32)
        adam.step("out_bias", out_bias, np.array([g.sum()], np.float32))
        model.out_bias = float(out_bias[0])
        adam.step("bias", model.bias, back.sum(0))
        if not len(full):
            return
        x_rows, x_grad = [], []
        for k, (width, w) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            pos, gy, end = place[full, cols], back[full, cols], at[full + 1][:, None]
            dw = np.zeros_like(w)
            for j in range(width):
                ok = pos + j < end
                i = np.minimum(pos + j, b.shape[1] - 1)
                x = model.tables[0][b[0][i]] + model.tables[1][b[1][i]]
                gj = gy * ok
                dw[j] = np.einsum("tfd,tf->df", x, gj)
                x_rows.append(i.ravel())
                x_grad.append((gj[:, :, None] * w[j].T[None]).reshape(-1, DIMS))
            adam.step(f"w{k}", w, dw)
        rows, grad = np.concatenate(x_rows), np.concatenate(x_grad)
        for k in range(2):
            bucket = b[k][rows]
            np.add.at(model.tables[k], bucket, -0.5 * grad * self.live[k][bucket][:, None])
            self.touched[k][bucket] = True

    def trained(self) -> pa.RecordBatch:
        """Rows (id, weight, v0 to v7): touched embeddings by their place in the tables, then all other parameters."""
        at = np.flatnonzero(self.touched.ravel() & self.live.ravel())
        rest = np.concatenate([x.ravel() for x in self.dense()])
        rest = np.pad(rest, (0, -len(rest) % DIMS)).reshape(-1, DIMS)
        values = np.concatenate([self.model.tables.reshape(-1, DIMS)[at], rest])
        ids = np.concatenate([at, 2 * BUCKETS + np.arange(len(rest))]).astype(np.int32)
        columns = [pa.array(ids), pa.array(np.full(len(ids), self.rows, np.int64)), *[pa.array(np.ascontiguousarray(values[:, d])) for d in range(DIMS)]]
        return pa.RecordBatch.from_arrays(columns, ["id", "weight", *[f"v{d}" for d in range(DIMS)]])

    def take(self, ids: np.ndarray, values: np.ndarray) -> None:
        """Set the parameters to averaged rows."""
        own = ids < 2 * BUCKETS
        self.model.tables.reshape(-1, DIMS)[ids[own]] = values[own]
        rest = values[~own][np.argsort(ids[~own])].ravel()
        dense = self.dense()
        for x in dense:
            x[...] = rest[: x.size].reshape(x.shape)
            rest = rest[x.size :]
        self.model.out_bias = float(dense[-1][0])


def _averaged(rows: DataFrame, learner: _Learner, seed: int) -> None:
    """One epoch over rows(copy, toxic, text): a copy of the model for each part, their mean weighted by rows."""
    shared = rows.sparkSession.sparkContext.broadcast(learner)

    def run(batches):
        copy, now = None, None
        for batch in batches:
            copies = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(copies)) + 1), len(copies)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if copies[lo] != now:
                    if copy is not None:
                        yield copy.trained()
                    now, base = copies[lo], shared.value
                    m = base.model
                    own = Model(m.tables.copy(), [w.copy() for w in m.filters], m.bias.copy(), m.out.copy(), m.out_bias, {}, False)
                    copy, rng = _Learner(own, base.live, base.weights), np.random.default_rng((seed, int(now)))
                part = batch.slice(lo, hi - lo)
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for first, end, buckets, at in word_buckets(part.column(2)):
                    copy.learn(buckets, at, toxic[first:end], rng)
        if copy is not None:
            yield copy.trained()

    values = [f"v{d}" for d in range(DIMS)]
    trained = rows.mapInArrow(run, "id int, weight bigint, " + ", ".join(f"{v} float" for v in values))
    part = lambda v: F.rint(F.col(v).cast("double") * PARTS).cast("bigint") * F.col("weight")
    sums = trained.groupBy("id").agg(F.sum("weight").alias("weight"), *[F.sum(part(v)).alias(v) for v in values])
    table = sums.select("id", *[(F.col(v) / F.col("weight") / PARTS).cast("float").alias(v) for v in values]).toArrow()  # a row per bucket at most
    learner.take(table.column("id").to_numpy(), np.stack([table.column(v).to_numpy() for v in values], axis=1))
    shared.destroy()


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """(table, kind, bucket): how many of rows(toxic, text) hold a bucket."""

    def run(batches):
        count = np.zeros((2, 2, BUCKETS), np.int64)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, buckets, at in word_buckets(batch.column(1)):
                row = np.repeat(np.arange(hi - lo), np.diff(at))
                for k in range(2):
                    once = np.unique(row * BUCKETS + buckets[k])
                    np.add.at(count[k], (toxic[lo + once // BUCKETS], once % BUCKETS), 1)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count.ravel()[at])], ["id", "n"])

    table = rows.mapInArrow(run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row per kind and bucket at most
    count = np.zeros(4 * BUCKETS, np.float64)
    count[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return count.reshape(2, 2, BUCKETS)


def _best_cuts(rows: DataFrame, model: Model, weights: tuple[float, float]) -> dict[str | None, float]:
    """The logit that gives the best F1 over rows(toxic, lang, text), in the middle of the gap around it.

    By language where it has 10 rows of both kinds, and for None over all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for lo, hi, buckets, at in word_buckets(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.logits(buckets, at))], ["toxic", "lang", "logit"])

    scored = rows.select("toxic", "lang", "text").mapInArrow(run, "toxic boolean, lang string, logit double")
    name = F.struct(F.lit(True).alias("own"), F.coalesce("lang", F.lit("")).alias("lang"))
    scopes = F.array(F.struct(F.lit(False).alias("own"), F.lit("").alias("lang")), name)
    binned = scored.select("toxic", "logit", F.explode(scopes).alias("scope"), F.floor(F.col("logit") * STEPS).alias("bin")).select("scope.*", "toxic", "logit", "bin")
    bins = binned.groupBy("own", "lang", "bin").agg(
        F.count_if("toxic").alias("n1"), F.count_if(~F.col("toxic")).alias("n0"), F.min("logit").alias("low"), F.max("logit").alias("high")
    )
    whole = Window.partitionBy("own", "lang")  # the bins of a language: logits are clipped before they are told apart further
    upto = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit, miss = F.sum("n1").over(upto) * weights[1], F.sum("n0").over(upto) * weights[0]
    f1 = 2 * hit / (hit + miss + F.sum("n1").over(whole) * weights[1])
    below = F.lead("high").over(whole.orderBy(F.desc("bin")))
    cut = F.coalesce((F.col("low") + below) / 2, F.col("low") - 1.0)
    ranked = bins.select("own", "lang", "bin", "n1", "n0", f1.alias("f1"), cut.alias("cut"))
    best = ranked.groupBy("own", "lang").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max_by("cut", F.struct("f1", "bin")).alias("cut"))
    cuts = {r["lang"] if r["own"] else None: r["cut"] for r in best.where("NOT own OR (n1 >= 10 AND n0 >= 10)").collect()}  # a row per language
    shared.destroy()
    return cuts


def fit(rows: DataFrame, weights: tuple[float, float] = (1.0, 1.0), epochs: int = 4, seed: int = 7) -> Model:
    """Train on every row of a stored table rows(copy, toxic, held, lang, text).

    Rows with `held` calibrate, the others train; all do both where one side
    lacks a kind. `weights`: rows of the table that a row of each kind stands for.
    """
    model = Model()
    counts = {(r["held"], r["toxic"]): r["count"] for r in rows.groupBy("held", "toxic").count().collect()}  # four rows
    if not all(any(t is kind for _, t in counts) for kind in (False, True)):
        return model
    trains = calibrates = rows
    if len(counts) == 4:
        trains, calibrates = rows.where("NOT held"), rows.where("held")
        counts = {k: n for k, n in counts.items() if not k[0]}
    kinds = [sum(n for (_, t), n in counts.items() if t is kind) for kind in (False, True)]
    # Smoothed log-odds of each bucket over the texts that hold it.
    count = _bucket_counts(trains.select("toxic", "text"))
    odds = np.log((count[:, 1] + 0.5) / (kinds[1] + 1)) - np.log((count[:, 0] + 0.5) / (kinds[0] + 1))
    live = count.sum(1) >= min(MIN_SUPPORT, sum(kinds))
    rng = np.random.default_rng(seed)
    model.tables = (rng.standard_normal((2, BUCKETS, DIMS)) * 0.02).astype(np.float32) * live[:, :, None]
    model.tables[:, :, 0] = np.where(live, odds / 4, 0)
    model.filters = [(rng.standard_normal((w, DIMS, FILTERS)) * 0.2).astype(np.float32) for w in WIDTHS]
    for w in model.filters:
        w[:, 0] = np.abs(w[:, 0]) + 0.5 / len(w)
    model.bias = np.full(len(WIDTHS) * FILTERS, -0.5, np.float32)
    model.out = np.full(len(WIDTHS) * FILTERS, 2.0 / (len(WIDTHS) * FILTERS), np.float32)
    model.out_bias = -1.0
    model.empty = False
    learner = _Learner(model, live, (0.5 * sum(kinds) / kinds[0], 0.5 * sum(kinds) / kinds[1]))
    for epoch in range(epochs):
        _averaged(trains.select("copy", "toxic", "text"), learner, seed + epoch)
    cuts = _best_cuts(calibrates, model, weights)
    cut = cuts.pop(None)
    model.out_bias -= cut
    model.by_language = {name: float(1 / (1 + np.exp(cut - own))) for name, own in cuts.items()}
    return model


def _with_language(docs: DataFrame) -> DataFrame:
    return docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))


def _perhaps_labelled(docs: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """`docs` without most rows whose id is not among the `n` ids of `known`, so that their texts are not shuffled to find it out."""
    if docs.schema["doc_id"].dataType != known.schema["doc_id"].dataType:
        return docs  # hashes of equal ids would differ
    bits = min(MARK_BITS, max(1 << 15, 1 << (16 * n).bit_length()))
    return mark_members(docs, F.col("doc_id"), known, F.col("doc_id"), "_known", bits).where("_known").drop("_known")


def train(docs: DataFrame, labels: DataFrame, sample_total: int | None = None) -> Model:
    """Fit on every labelled row; fold 0 of five (crc32 of the id) is never used.

    Rows without id or label are ignored; of several labels of an id the
    largest counts, of several texts the one with the largest hash. The rows
    are dealt to the copies of the model by hash, and stored as texts for the
    passes over them. A caller that asks for it gets a model of the first
    texts of each kind in hash order, as far as `sample_total` characters of
    their kind go. Without a column `lang` no language has a threshold of its own.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold != 0).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = known.count()
    copies = min(COPIES, n // PER_COPY + 1)
    rest = _with_language(docs).where(fold != 0).select("doc_id", F.struct("lang", "text").alias("r"))
    texts = _perhaps_labelled(rest, known, n).join(known, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.max_by("r", F.struct(F.xxhash64("r.text"), "r.text", "r.lang")).alias("r"))
    k = F.xxhash64("doc_id")
    rows = one.select(F.pmod(F.xxhash64(k), F.lit(copies)).cast("int").alias("copy"), "toxic", (F.pmod(k, F.lit(5)) == 0).alias("held"), F.col("r.lang").cast("string").alias("lang"), "r.text", k.alias("k"))
    rows = cut_lineage(rows.repartition(copies, "copy").sortWithinPartitions("copy", "k", "text"))
    weights = (1.0, 1.0)
    if sample_total is not None:
        upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(Window.partitionBy("toxic").orderBy("k", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        whole, rows = rows, cut_lineage(rows.withColumn("upto", upto).where(F.col("upto") <= sample_total).drop("upto"))
        # The sample holds more rows of one kind than the table: weight them back.
        had, has = ({r["toxic"]: r["count"] for r in x.groupBy("toxic").count().collect()} for x in (whole, rows))
        weights = tuple(had.get(kind, 0) / max(has.get(kind, 0), 1) for kind in (False, True))
    return fit(rows, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, score, toxic): the score of every whole text, and the decision by its language's threshold.

    The score reads the text alone; null and empty texts get that of a text
    without words, and with an empty model every score is 0. `toxic` takes
    0.5 for languages (null included) without a threshold of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS and DIMS

    def run(batches):
        m = shared.value
        for batch in batches:
            for lo, hi, buckets, at in word_buckets(batch.column(2)):
                p = np.zeros(hi - lo) if m.empty else 1 / (1 + np.exp(-np.clip(m.logits(buckets, at), -40, 40)))
                lang = batch.column(1).slice(lo, hi - lo)
                cut = np.array([m.by_language.get(x or "", 0.5) for x in lang.to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lang, pa.array(p), pa.array(p >= cut)], ["doc_id", "lang", "score", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_language(docs).select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, f"doc_id {kind}, lang string, score double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without the rows whose text is toxic by its language's threshold; all columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            at = batch.schema.get_field_index("lang")
            lang = batch.column(at) if at >= 0 else pa.nulls(batch.num_rows, pa.string())
            keep = np.ones(batch.num_rows, bool)
            for lo, hi, buckets, at in word_buckets(text):
                if not m.empty:
                    p = 1 / (1 + np.exp(-np.clip(m.logits(buckets, at), -40, 40)))
                    keep[lo:hi] = p < [m.by_language.get(x or "", 0.5) for x in lang.slice(lo, hi - lo).to_pylist()]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
