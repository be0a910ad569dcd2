"""BPE, packing, token counts, vectors, WARC, quotes, and the pipeline."""

import collections
import gzip
import hashlib
import itertools
import json
import random
import time
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import plain
from bindery.llm import ann, bpe, pack, quotes, token_counts, warc
from bindery.llm.queries import vocabulary
from bindery.session import ship_code

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def table(spark):
    ship_code(spark)
    return lambda data, schema="doc_id bigint, text string": spark.createDataFrame(data, schema)


def odd_texts(n=3000):
    rnd = random.Random(1)
    parts = ["a", "b", "'s", "'", "'re", "'ll", "'ve", "'t", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "日本", "🙂", "<|endoftext|>", "<|endof", "!", "...", "don't", "THE", "x" * 70, "́", "٣", "\x1c", "\x85", "​", "re"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]
    return [*out, "a" * 4000, "ab" * 3000, "\n" * 500, " " * 999 + "x", "".join(rnd.choice("abcdefgh") for _ in range(3000))]


def as_ids(coder, texts):
    from bindery.llm.flat import text_slices
    import pyarrow as pa

    out = []
    for _, _, data, offsets in text_slices(pa.array(texts)):
        ids, at = coder.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


@pytest.mark.parametrize("known", [1 << 20, 64])
def test_ids_equal_the_library(library, known):
    texts = odd_texts()
    assert as_ids(bpe.ByteBPE(vocabulary(), known), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_encode_and_decode(table, library):
    texts = [*odd_texts(200), None, "", "tail"]
    docs = table([*[(i, t, 1) for i, t in enumerate(texts)], (None, "no id", 2), (1, texts[1], 3)], "doc_id bigint, text string, ids int")
    coded = bpe.encode_documents(docs, vocabulary())
    assert coded.count() == len(texts) + 2
    back = {r.doc_id: r.text for r in bpe.decode_documents(coded, vocabulary()).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, vocabulary()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    cut = table([(1, [library.encode("é").ids[0]][:1], 0), (2, None, 0)], "doc_id bigint, ids array<int>, x int")
    assert {r.doc_id: r.text for r in bpe.decode_documents(cut, vocabulary()).collect()} == {1: library.decode(library.encode("é").ids[:1]), 2: ""}
    empty = table([])
    assert bpe.encode_documents(empty, vocabulary()).count() == 0 == bpe.round_trip_digests(empty, vocabulary()).count()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=40))
def test_patterns_place_everything(histogram):
    packs = pack.patterns(dict(histogram), 64)
    placed = collections.Counter()
    for count, lengths in packs:
        assert count > 0 and sum(lengths) <= 64
        for n in lengths:
            placed[n] += count
    assert placed == collections.Counter(histogram)
    # No two packs could be one.
    short = sorted(sum(lengths) for count, lengths in packs for _ in range(min(count, 2)))[:2]
    assert len(short) < 2 or sum(short) > 64


def check_packing(rows, ids, width=2048):
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for k, parts in by.items():
        full, at = ids[k], 0
        for r in sorted(parts, key=lambda r: r.start):
            own = full[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(full) and r.length == len(own) > 0
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += r.length
        assert at == len(full)
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width


def test_packing(table, library):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["alpha", "b", "42", "ünü"]) for _ in range(rnd.choice([0, 1, 7, 300, 300, 300, 6000]))) for _ in range(120)]
    data = [*enumerate(texts), (500, None), (501, "")]
    rows = pack.pack_documents(table([(*d, 1, 2) for d in data], "doc_id bigint, text string, length int, _rank int"), vocabulary()).collect()
    check_packing(rows, {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in data})
    assert pack.pack_documents(table([]), vocabulary()).count() == 0
    same = pack.pack_documents(table([(1, "x y")] * 5), vocabulary()).collect()  # repeated rows: a place each
    assert len({(r.sequence_id, r.offset) for r in same}) == 5
    assert pack.pack_documents(table([(None, "x y")]), vocabulary()).first().doc_id is None


def test_scan_of_token_blocks(table):
    rnd = random.Random(4)
    files = {f: [rnd.choice([0, 0, 1, 2, 3]) for _ in range(rnd.randint(0, 90))] for f in ("a", "b", "c", None)} | {"empty": [], "one": [0], "open": [5, 5]}
    blocks = []
    for f, ids in files.items():
        at = b = 0
        while at < len(ids) or b == 0:
            n = rnd.randint(0, 7)
            part = ids[at : at + n]
            blocks.append((f, b, bytearray(struct.pack(f"<{len(part)}I", *part)) if part or rnd.random() < 0.5 else None, "x"))
            at, b = at + n, b + 1
    want = set()
    for f, ids in files.items():
        start = k = 0
        for i, x in enumerate(ids):
            if x == 0:
                want.add((f, k, start, i + 1 - start, True))
                start, k = i + 1, k + 1
        if start < len(ids):
            want.add((f, k, start, len(ids) - start, False))
    got = token_counts.count_tokens(table(blocks, "file string, block int, tokens binary, n string"), 0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert token_counts.count_tokens(table([], "file string, block int, tokens binary"), 0).count() == 0


def test_counts_of_documents(table, library):
    texts = [*odd_texts(300), None, "", "word " * 70_000]
    docs = table([*enumerate(texts), (7, "again"), (None, "no id")])
    got = token_counts.counts_of_documents(docs, vocabulary(), 50257).collect()
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in [*enumerate(texts), (7, "again"), (None, "no id")]]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == sorted((i if i is not None else -1, n) for i, n in want)


def test_nearest(table):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:140] = x[50]
    data = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    bad = [(900, None, 1), (950, [0.0] * 16, 1), (1000, [float("nan")] * 16, 1), (1050, [float("inf")] + [1.0] * 15, 1), (1100, [None] + [1.0] * 15, 1), (1150, [1.0], 1), (None, [1.0] * 16, 1)]
    vectors = table([*data, *bad, data[10]], "vec_id bigint, embedding array<float>, score int")
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append(r)
    d = x.astype(np.float64)
    unit = d / np.sqrt((d * d).sum(1))[:, None]
    hit = 0
    for q in range(0, 600, 50):
        score = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(600), -score.round(12))) if i != q][:5]
        rows = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5] and len({r.vec_id for r in rows}) == 5
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in rows)
        hit += len({r.vec_id for r in rows} & set(map(int, order)))
    assert set(got) == set(range(0, 600, 50)) and hit >= 0.9 * 60
    assert [r.vec_id for r in sorted(got[50], key=lambda r: r.rank)] == [100, 101, 102, 103, 104]  # ties: smaller ids


def test_queries_of_a_leaf_are_dealt_out(table, monkeypatch):
    x = np.random.default_rng(5).standard_normal((500, 8)).astype(np.float32)
    vectors = table([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<float>")
    whole = sorted(map(tuple, ann.nearest(vectors, F.lit(True)).collect()))
    groups = table([], "n int").sparkSession.sparkContext.accumulator(0)
    first = ann.rank

    def counted(left, right, k):
        assert right.num_rows <= 40  # 500 queries, dealt over 50 parts by hash
        groups.add(1)
        return first(left, right, k)

    monkeypatch.setattr(ann, "rank", counted)
    monkeypatch.setattr(ann, "ASKED", 10)
    assert sorted(map(tuple, ann.nearest(vectors, F.lit(True)).collect())) == whole and len(whole) == 2500
    assert groups.value >= 50


def test_many_queries_of_a_block_take_bounded_memory():
    rng = np.random.default_rng(6)
    vectors = lambda n: pa.array(list(rng.standard_normal((n, 4))), pa.list_(pa.float64()))
    left = pa.table({"v": vectors(4096), "ids": pa.array([[i] for i in range(4096)])})
    right = pa.table({"v": vectors(4096), "q": pa.array([str(i) for i in range(4096)])})
    tracemalloc.start()
    assert ann.rank(left, right, 5).num_rows == 6 * 4096
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores of the block would take 134 MB, and their order as much


def test_ties_of_different_vectors_go_to_the_smaller_ids(table):
    schema = "vec_id bigint, embedding array<float>"
    scaled = [(i, [3.0 * 2.0 ** (i * 7 % 60 - 30), 4.0 * 2.0 ** (i * 7 % 60 - 30)]) for i in range(1, 61)]
    binary = [(100 + n, [float(d in pair) for d in range(16)]) for n, pair in enumerate(itertools.combinations(range(16), 2))]
    for ask, rows in (([1.0, 0.0], scaled), ([1.0] * 16, binary)):
        for some in (rows, [(i, v) for (i, _), (_, v) in zip(rows, reversed(rows), strict=True)]):
            got = ann.nearest(table([(0, ask), *some], schema), F.col("vec_id") == 0).collect()
            assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for i, _ in rows[:5]]
            assert len({r.score for r in got}) == 1


def test_nearest_of_few(table):
    schema = "vec_id bigint, embedding array<float>"
    assert ann.nearest(table([], schema), F.lit(True)).count() == 0
    assert ann.nearest(table([(1, [1.0, 0.0])], schema), F.lit(True)).count() == 0
    got = ann.nearest(table([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], schema), F.col("vec_id") == 1).collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 3, 0.707107), (1, 2, 2, 0.0)]


def record(body, headers="Content-Type: text/html; charset=utf-8", kind="response", ident="<urn:uuid:1>", length=None):
    http = f"HTTP/1.1 200 OK\r\n{headers}\r\n\r\n".encode() + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Block-Digest: {warc.digest(http)}\r\nX-Own: a\r\n b\r\nContent-Length: {len(http) if length is None else length}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


PAGE = "<html><head><title>T &amp; é</title><script>var x='<p>';</script></head><body><p>One<b>two</b> &lt;3<br>line<!-- no --><a href='/x?a&amp;b'>go</a></body></html>"


def test_derivatives():
    chunk = PAGE.encode()
    chunked = b"5\r\n" + chunk[:5] + b"\r\n" + f"{len(chunk) - 5:x};q\r\n".encode() + chunk[5:] + b"\r\n0\r\n\r\n"
    for raw in (record(chunk), record(chunked, "Transfer-Encoding: chunked"), record(gzip.compress(chunk), "Content-Encoding: gzip"), record(PAGE.encode("latin-1"), "Content-Type: text/html; charset=ISO-8859-1")):
        about, plain_text = warc.derive_one(raw)
        assert about["kind"] == "metadata" and plain_text["kind"] == "conversion" and about["source_digests_ok"]
        assert {r["refers_to"] for r in (about, plain_text)} == {"<urn:uuid:1>"} and about["record_id"] != plain_text["record_id"]
        version, headers, block = warc._split(plain_text["record"])
        named = dict(headers)
        block = block[: int(named["Content-Length"])]
        assert version == "WARC/1.0" and block.decode() == "Onetwo <3\nlinego"
        assert named["WARC-Block-Digest"] == warc.digest(block) == plain_text["block_digest"] and named["WARC-Refers-To"] == "<urn:uuid:1>"
        envelope = json.loads(warc._split(about["record"])[2])["Envelope"]
        assert ["X-Own", "a b"] in envelope["WARC-Header-Metadata"]
        page = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
        assert page["Title"] == "T & é" and page["Links"] == [{"path": "A@/href", "url": "/x?a&b"}]


def test_derivatives_of_bad_records(table):
    broken = record(b"x").replace(b"HTTP/1.1", b"GOPHER")
    data = [(1, None), (2, bytearray()), (3, bytearray(b"junk")), (4, bytearray(record(b"", kind="request"))), (5, bytearray(record(b"a", length=10**6))), (6, bytearray(record(b"a", ident=""))), (7, bytearray(broken)), (8, bytearray(record(b"notgzip", "Content-Encoding: gzip"))), (9, bytearray(record(b""))), (None, bytearray(record(b"<p>" + b"long " * 300_000)))]
    got = collections.Counter((r.page_id, r.kind) for r in warc.derive(table([(*d, "x") for d in data], "page_id bigint, record binary, kind string")).collect())
    assert got == collections.Counter([*[(i, "error") for i in (1, 2, 3, 5, 6, 7, 8)], *[(i, k) for i in (9, None) for k in ("metadata", "conversion")]])
    tampered = record(b"abc").replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    assert [r["source_digests_ok"] for r in warc.derive_one(tampered)] == [False, False]
    assert warc.derive(table([], "page_id bigint, record binary")).count() == 0


@pytest.mark.parametrize("piece", ["<a ", "<script ", "<a href=", "<title>", "<!--", "<script>", "</p", "<a href href ", "<img src='", "<style></style ", "&amp", "< ", "<p"])
@pytest.mark.parametrize("end", ["", ">", "<b>x</b>"])
def test_a_megabyte_of_open_tags(piece, end):
    page = piece * ((1 << 20) // len(piece)) + end
    start = time.process_time()
    warc.page_text(page), warc.page_title(page), list(warc._LINK.finditer(page))
    assert time.process_time() - start < 1.5


def test_what_is_open_hides_the_rest():
    text = {
        "a<script>x</script>b": "ab", "a<script>x</b>": "a", "a<script>x</b> c": "a", "a<!-- x --> b": "a b", "a<!-- <b>x</b>": "a", "a <b>c</b> < d": "a c < d", "a<style>x</style>": "a", "a<style>x</style> b <": "a b <",
        "<title>t</title>x": "t\nx", "a <!-- b": "a", "1 < 2 <p>3": "1 < 2\n3",
    }
    assert {k: warc.page_text(k) for k in text} == text
    assert warc.page_title("<TITLE >a<b>c</b></title >d") == "a<b>c</b>" and warc.page_title("<title>a") is None and warc.page_title("") is None
    assert [m[3] or m[4] or m[5] for m in warc._LINK.finditer('<a <a href="x"><img src=y><script src=\'z\'>')] == ["x", "y", "z"]


def test_bodies_are_read_whole_or_refused():
    page, packed = b"<p>one</p><p>two</p>", gzip.compress
    chunk = lambda b: f"{len(b):x}\r\n".encode() + b + b"\r\n"
    raw = zlib.compressobj(wbits=-15)
    bare = raw.compress(page) + raw.flush()
    whole = [
        (packed(page[:10]) + packed(page[10:]), "Content-Encoding: gzip"),
        (packed(page) + bytes(8), "Content-Encoding: gzip"),
        (packed(packed(page)), "Content-Encoding: gzip, x-gzip"),
        (packed(zlib.compress(page)), "Content-Encoding: deflate\r\nContent-Encoding: gzip"),
        (bare, "Content-Encoding: identity, deflate"),
        (chunk(packed(page)) + b"0\r\n\r\n", "Transfer-Encoding: gzip, chunked"),
    ]
    for body, headers in whole:
        text = warc.derive_one(record(body, headers))[1]["record"]
        assert text.rstrip().endswith(b"\r\n\r\none\ntwo"), headers
    cut = [
        (packed(page)[:-9], "Content-Encoding: gzip"),
        (packed(page) + packed(page)[:-9], "Content-Encoding: gzip"),
        (packed(page) + b"<p>rest</p>", "Content-Encoding: gzip"),
        (zlib.compress(page)[:-5], "Content-Encoding: deflate"),
        (chunk(page), "Transfer-Encoding: chunked"),
        (chunk(page)[:-9], "Transfer-Encoding: chunked"),
        (chunk(page) + b"-1\r\n", "Transfer-Encoding: chunked"),
        (b"", "Transfer-Encoding: chunked"),
        (page, "Content-Encoding: br"),
        (page, "Content-Encoding: zstd"),
        (packed(page), "Content-Encoding: br, gzip"),
    ]
    for body, headers in cut:
        assert [r["kind"] for r in warc.derive_one(record(body, headers))] == ["error"], (body, headers)
    unchanged = record(b"", "Transfer-Encoding: chunked").replace(b"200 OK", b"304 No")
    assert len(warc.derive_one(unchanged)) == 2


def test_quote_levels():
    text = "Yes.\n\nOn Monday Ann wrote:\n> Shall we?\n>\n> > First  \n>> idea\n> Tell me.\nBye"
    found = [(level, [x for x in lines if x]) for level, lines in quotes.passages(text)]
    assert found == [(0, ["Yes."]), (1, ["Shall we?"]), (2, ["First  ", "idea"]), (1, ["Tell me."]), (0, ["Bye"])]


def test_conversations(table):
    data = [
        (1, "a", 1, "Shall we meet?\nTell me soon."),
        (1, "b", 2, "Yes.\n\nOn Monday Ann wrote:\n> SHALL we   meet?\n> Tell me soon."),
        (1, "c", 3, "Where?\n> Yes.\n>> Shall we meet?"),
        (1, "d", 4, "Also I can.\n> Tell me soon."),
        (1, "e", 5, "Unrelated\n> nobody wrote this"),
        (1, "f", 6, "Unrelated"),
        (1, "g", 7, "which?\n> Unrelated"),
        (2, "h", 8, "> Yes."),
        (None, "i", 1, "Hello"),
        (None, "j", 2, "Hi\n> hello"),
        (1, "k", 9, None),
        (1, None, 9, "no id"),
        (1, "a", 1, "Shall we meet?\nTell me soon."),
    ]
    got = {r.msg_id: r for r in quotes.conversations(table([(*d, 0) for d in data], "scope bigint, msg_id string, position bigint, text string, root_id int")).collect()}
    assert {k: r.parent_id for k, r in got.items()} == {"a": None, "b": "a", "c": "b", "d": "a", "e": None, "f": None, "g": "e", "h": None, "i": None, "j": "i", "k": None}
    assert {k: (r.root_id, r.depth) for k, r in got.items() if k in "abcd"} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 1)}
    assert sorted("abcd", key=lambda k: got[k].path) == ["a", "b", "c", "d"] and got["b"].text == "Yes." and got["h"].text == ""
    assert quotes.conversations(table([], "scope bigint, msg_id string, position bigint, text string")).count() == 0


def test_conversations_without_the_direct_parent(table):
    data = [
        (1, "a", 1, "First words."),
        (1, "b", 2, "Second words."),
        (1, "c", 4, "Parent missing.\n> lost text\n>> second words.\n>>> First words."),
        (1, "d", 5, "Parent empty.\n>\n>> Deeper lost\n>>> First words."),
        (1, "e", 6, "Shallow wins.\n> First words.\n>> Second words."),
    ]
    got = {r.msg_id: r for r in quotes.conversations(table(data, "scope bigint, msg_id string, position bigint, text string")).collect()}
    assert {k: r.parent_id for k, r in got.items()} == {"a": None, "b": None, "c": "b", "d": "a", "e": "a"}
    turns = [(7, 1, "One."), (7, 2, "Two."), (7, 3, ""), (7, 4, "Four."), (7, 6, "Six.")]
    mails = quotes.mails(table(turns, "conv_id bigint, turn bigint, text string"))
    assert {r.position: r.parent_id for r in quotes.conversations(mails).collect()} == {1: None, 2: "7-1", 3: "7-2", 4: "7-2", 6: "7-4"}


def test_pipeline(spark):
    import corpus_pipeline
    from bindery.llm import toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).collect() if r.toxic}
    best = {}
    for r in docs.collect():
        if r.doc_id not in bad:
            key = (r.text or "").translate(plain.FOLD)
            best[key] = max(best.get(key, r), r, key=lambda x: x.doc_id)
    left = {r.doc_id: r.text or "" for r in best.values()}
    group, _ = plain.components(list(left.items()))
    texts = {k: plain.masked(t) for k, t in left.items() if group[k] == k}
    library = tokenizers.Tokenizer.from_file(vocabulary())
    ids = {k: [*library.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    check_packing(corpus_pipeline.run(spark, sf).collect(), ids)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
