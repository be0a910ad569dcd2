"""Hard negatives, sharding, fill-in-the-middle."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindery.llm import fill_middle, hard_negatives, shard_tree
from bindery.llm.shard_tree import Shard
from bindery.session import ship_code


@pytest.fixture(scope="module")
def table(spark):
    ship_code(spark)
    return lambda data, schema: spark.createDataFrame(data, schema)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def floor_of(v):
    return [max(min(math.floor(256 * float(np.float32(x))), 2**63 - 1), -(2**63)) for x in v]


def brute_negatives(rows):
    dims = collections.Counter(len(v) for i, v, g in rows if usable(i, v, g))
    if not dims:
        return []
    size = min(dims, key=lambda d: (-dims[d], d))
    kept = {}
    for i, v, g in rows:
        if usable(i, v, g) and len(v) == size:
            kept[i] = min(kept.get(i, (g, floor_of(v))), (g, floor_of(v)))
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63) + 1)
    out = []
    for a, (ga, qa) in kept.items():
        if a % 100:
            continue
        scored = sorted(((-clip(sum(x * y for x, y in zip(qa, q, strict=True))), i, g) for i, (g, q) in kept.items() if i != a))
        for p, j, _ in [x for x in scored if x[2] == ga][:5]:
            inside = [(i, -s) for s, i, g in scored if g != ga and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(a, j, r + 1, i, -p, s) for r, (i, s) in enumerate(inside[:5])]
    return sorted(out)


def usable(i, v, g):
    return i is not None and g is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v)


def mined(df, **settings):
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label"), **settings).collect()))


def clouds(n, dims=8, seed=4, centres=6):
    rnd = np.random.default_rng(seed)
    middle = rnd.standard_normal((centres, dims))
    out = []
    for i in range(n):
        v = (middle[rnd.integers(centres)] + 0.3 * rnd.standard_normal(dims)) * rnd.choice([0.2, 1, 5])
        out.append((i * 10, [float(x) for x in v], int(rnd.integers(3))))
    return out


@pytest.mark.parametrize("settings", [{}, {"block": 16, "references": 3}, {"sample": 3, "references": 1}])
def test_hard_negatives(table, settings, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ASKED", 4)
    rows = clouds(400)
    rows += [(100 * k + 1, rows[k][1], 7) for k in range(20)]  # the same vectors under another label: ties
    rows += [(9_001 + i, rows[0][1], rows[0][2]) for i in range(60)]
    got = mined(table(rows, VECTORS), **settings)
    assert got == brute_negatives(rows) and len(got) > 100


def test_hard_negatives_of_odd_rows(table):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1), (500, [1.0, 2.0], None), (600, [], 1), (700, [1.0, 2.0, 3.0], 1)]
    base = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.9, 2.0], 2), (3, [1.0, 1.9], 3), (3, [0.1, 0.1], 2), (800, [0.0, 0.0], 1), (900, [-1.0, -2.0], 1), (4, [1.0, 2.0], 2), (4, [1.0, 2.0], 2)]
    big = [(1000, [3e30, 1e9], 1), (11, [4e30, 1.0], 1), (12, [2e30, 5.0], 2), (1100, [3e6, 2e6], 1), (13, [3e6, 2e6 - 1], 2)]
    for rows in (odd, base, odd + base, odd + base + big):
        assert mined(table(rows, VECTORS)) == brute_negatives(rows)
    more = table([(*r, 5, "x") for r in base], f"{VECTORS}, score int, id string")
    assert mined(more) == brute_negatives(base)
    assert mined(table([], VECTORS)) == []


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    x = np.floor(256 * rnd.standard_normal((300, 16)))
    x[:20] = x[20:40] * 3
    x[0] = 0
    frame = hard_negatives.Frame(x, 5, 2)
    norm, angles = np.sqrt((x * x).sum(1)), frame.angles(x).astype(np.float32)
    low, high = hard_negatives.score_bounds(norm, angles, norm, norm, angles, angles)
    score = x @ x.T
    assert ((low <= score) & (score <= high)).all()
    cell = frame.cells(angles)
    for c in np.unique(cell):
        own = cell == c
        ends = norm[own].min(keepdims=True), norm[own].max(keepdims=True), angles[own].min(0, keepdims=True), angles[own].max(0, keepdims=True)
        low, high = hard_negatives.score_bounds(norm, angles, *ends)
        assert (low <= score[:, own]).all() and (score[:, own] <= high).all()


def test_clustered_vectors_are_mostly_not_scored(monkeypatch):
    rnd = np.random.default_rng(3)
    middle = rnd.standard_normal((12, 32)) * 256
    x = np.floor(np.concatenate([m + rnd.standard_normal((50, 32)) * 8 for m in middle])).astype(np.int64)
    frame = hard_negatives.Frame(x.astype(float), 12)
    side = object.__new__(hard_negatives.Side)
    side.id, side.label, side.q = np.arange(600), np.arange(600) % 2, x
    side.norm, side.angles = np.sqrt((x * x).sum(1).astype(float)), frame.angles(x.astype(float)).astype(np.float32)
    asked = []
    monkeypatch.setattr(hard_negatives, "products", lambda a, b, wanted, real=hard_negatives.products: asked.append(wanted.mean()) or real(a, b, wanted))
    top = np.sort(x @ x.T, axis=1)[:, -8]
    hard_negatives.best_same(side, side, top, 5)
    assert asked[0] < 0.2


def test_at_least():
    for s in range(-30, 30):
        for low in ((4, 5), (1, 1), (2, 3)):
            assert hard_negatives.at_least(np.array([s]), low)[0] == math.ceil(s * low[0] / low[1])


DOCS = "doc_id bigint, text string"


def test_shards(table):
    rnd = random.Random(8)
    rows = [(i, "x" * rnd.randrange(50)) for i in range(4000)] + [(7, "hot")] * 9000 + [(8, f"t{i}") for i in range(300)] + [(None, None), (None, None), (5, "é"), (-3, "")]
    got = shard_tree.shard_rows(table(rows, DOCS), block=256).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by, place, later = collections.defaultdict(list), {}, {}
    for r in got:
        by[r.shard].append(r.slot)
        assert place.setdefault(r.doc_id, r.shard) == r.shard and later.setdefault(r.doc_id, r.grown_shard) == r.grown_shard
        assert r.law == "key" and r.grown_shard in (r.shard, 8) and (r.region, r.rack) == (r.shard // 4, r.shard // 2)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(abs(n - 500) < 90 for n in collections.Counter(place.values()).values())
    assert abs(sum(s == 8 for s in later.values()) - 444) < 90
    again = shard_tree.shard_rows(table(rows[::-1], DOCS).repartition(7), block=100_000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # no layout or block size changes a slot
    assert shard_tree.shard_rows(table([], DOCS)).count() == 0


def placed(spark, tree, n=6000):
    rows = shard_tree.assign(spark.range(n).withColumnRenamed("id", "doc_id"), tree)
    return {r.doc_id: r.shard for r in rows.collect()}


def test_only_the_changed_subtree_moves(spark):
    tree = [Shard(0, 0, 0, 2.0), Shard(1, 0, 0, 1.0), Shard(2, 0, 1, 1.0), Shard(3, 1, 2, 3.0), Shard(4, 1, 3, 1.0), Shard(5, 1, 3, 0.0)]
    before = placed(spark, tree)
    share = collections.Counter(before.values())
    assert share[5] == 0 and all(abs(share[s.number] - 6000 * s.weight / 8) < 150 for s in tree)
    more = placed(spark, [*tree[:3], Shard(3, 1, 2, 4.0), *tree[4:]])
    moved = {(before[k], more[k]) for k in before if before[k] != more[k]}
    assert moved == {(s, 3) for s in (0, 1, 2, 4)}
    less = placed(spark, [Shard(0, 0, 0, 1.0), *tree[1:]])
    assert {before[k] for k in before if before[k] != less[k]} == {0}
    for n in range(1, 12):  # at any count the next shard takes rows only into itself
        assert {b for a, b in zip(placed(spark, shard_tree.grown(n), 500).values(), placed(spark, shard_tree.grown(n + 1), 500).values(), strict=True) if a != b} <= {n}
    with pytest.raises(ValueError):
        shard_tree.descend([F.lit(1.0)], [Shard(0, 0, 0, 0.0)])


def test_assign_keeps_columns(table):
    got = shard_tree.assign(table([(1, "a", 9), (None, None, 8)], f"{DOCS}, shard int"), shard_tree.grown(1), later=shard_tree.grown(1))
    assert got.columns == ["doc_id", "text", "region", "rack", "shard", "grown_shard"] and {(r.shard, r.grown_shard) for r in got.collect()} == {(0, 0)}


def brute_middle(doc_id, text, rate=50):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(units) == text
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


def odd_texts():
    rnd = random.Random(6)
    bits = ["a", "é", " ", "\x1c", " ", "\t", "\n", "\x0b", "日本", "<", "P>", "<P", "word", "\r\n", "😀"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(600)]
    texts += [None, "", " ", "<P>", "a <S> b", "x<M>", "é" * 90_000, " " * 90_000, "word " * 40_000, "end \n", "<<P>>"]
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a b c d e f"), (3, "twice here"), (3, "twice here"), (-5, "a b c")]


def test_fill_middle(table):
    data = odd_texts()
    docs = table([(*r, 1, "x") for r in data], f"{DOCS}, row int, piece string")
    for settings, rate in (({}, 50), ({"piece_bytes": 7, "rate": 100}, 100)):
        want = [brute_middle(*r, rate) for r in data]
        got = fill_middle.round_trip_digests(docs, **settings)
        assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(w) for w, _ in want)
        texts = fill_middle.transform(docs, **settings).collect()
        assert sorted(str((r.doc_id, r.output)) for r in texts) == sorted(str((w[0], out)) for w, out in want)
        assert sorted(fill_middle.restore(r.output, r.form) for r in texts) == sorted(t or "" for _, t in data)
    assert {w[2] for w, _ in want} == {"plain", "psm", "spm"}
    assert fill_middle.round_trip_digests(table([], DOCS)).count() == 0 == fill_middle.transform(table([], DOCS)).count()


def test_pieces_are_bounded_and_shuffled_once(table):
    docs = table([(i, "word and more " * 20_000) for i in range(4)], DOCS)
    cut = fill_middle.pieces(docs, rate=100)
    assert cut.selectExpr("max(length(piece))").first()[0] <= fill_middle.PIECE_BYTES + 3
    plan = fill_middle.round_trip_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
