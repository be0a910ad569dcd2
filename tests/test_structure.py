import io
import random
import zipfile

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from bindery.functions import anchors as A
from bindery.operators import fragments as FR, quotes as Q, structure as ST
from bindery.sources import readers as RD

BOOK = "book_id string, filename string, text string"


def parse(spark, text, name="我的书.md", **kw):
    df = spark.createDataFrame([("b", name, text)], BOOK)
    return sorted(ST.parse_books(df, **kw).collect(), key=lambda r: r["position"])


def test_literal_newlines_and_levels(spark):
    rows = parse(spark, "# 正文\n### 主题\\n内容\\n#### 文章\\n第一段。\\n第二段。[1]")
    assert [(r["level"], r["title"], r["content"]) for r in rows] == [(1, "正文", ""), (3, "主题", "内容"), (4, "文章", "第一段。\n第二段。[1]")]
    assert rows[0]["book_title"] == "我的书" and rows[1]["parent_id"] == rows[0]["section_id"] and rows[2]["parent_id"] == rows[1]["section_id"]
    books = spark.createDataFrame([("b", "x.md", "# 正文\n### 主题\\n内容\\n#### 文章\\n第一段。\\n第二段。[1]")], BOOK)
    d = ST.parse_diagnostics(books, ST.parse_books(books)).first()
    assert (d["literal_newlines_restored"], d["heading_count"], d["h3_count"], d["h4_count"], d["footnote_markers"]) == (4, 3, 1, 1, 1)


def test_plain_text_gets_a_heading(spark):
    rows = parse(spark, "只有正文\n第二行", "plain.v1.txt")
    assert [(r["title"], r["content"], r["parent_id"]) for r in rows] == [("plain.v1", "只有正文\n第二行", None)]


def test_long_article_is_also_cut(spark):
    body = "\n".join(["段落内容。" * 60] * 30)
    rows = parse(spark, f"# 书\n#### 文章\n{body}")
    segments = [r for r in rows if r["kind"] == "semantic_segment"]
    assert segments and all(len(r["content"]) <= 2_700 and r["level"] == 5 for r in segments)
    assert [r["position"] for r in segments] == [1000 + i for i in range(1, len(segments) + 1)]
    assert len(parse(spark, f"# 书\n#### 文章\n{body}", include_segments=False)) == 2


def test_candidates(spark):
    sections = spark.createDataFrame(
        [("b", "1", None, 1, 0, "目录", "x"), ("b", "2", None, 1, 1, "第一章 起", "x"), ("b", "3", "2", 2, 2, "第一节", "y" * 600), ("b", "4", None, 1, 3, "各栏注", "z" * 900), ("b", "5", None, 1, 4, "短章", "z"), ("b", "6", None, 1, 5, "这是一句话。", "z" * 900)],
        "book_id string, section_id string, parent_id string, level int, position bigint, title string, content string",
    )
    got = {r["section_id"]: r["reason"] for r in ST.analysis_candidates(sections).collect()}
    assert got == {"1": ST.REASON_EXCLUDED, "2": "", "4": ST.REASON_EXCLUDED, "5": ST.REASON_SHORT, "6": ST.REASON_SENTENCE}


def library(spark, text_of_child):
    cols = "book_id string, section_id string, parent_id string, level int, position bigint, title string, content string, status string"
    return spark.createDataFrame(
        [("b", "r", None, 1, 10, "章", "导语。" * 80, "confirmed"), ("b", "c", "r", 2, 11, "节", text_of_child, "confirmed"), ("b", "d", "r", 2, 12, "稿", "草稿", "draft")], cols
    )


def records(spark, text):
    sections = library(spark, text)
    return FR.fragment_records(FR.cut_library(sections), ST.lineage(sections))


def test_positions_and_paths(spark):
    rows = sorted(records(spark, "同一段。\n" * 3 + "长" * 790 + "\n同一段。").collect(), key=lambda r: r["book_position"])
    assert [r["book_position"] for r in rows] == list(range(1, len(rows) + 1))
    assert {tuple(r["section_path"]) for r in rows} == {("章",), ("章", "节")}
    assert len({r["content_index"] for r in rows}) == len(rows)


def test_fingerprint_is_stable_and_changes(spark):
    a = FR.set_fingerprint(records(spark, "甲" * 900), ["book_id"]).first()[1]
    b = FR.set_fingerprint(records(spark, "甲" * 900), ["book_id"]).first()[1]
    c = FR.set_fingerprint(records(spark, "甲" * 901), ["book_id"]).first()[1]
    assert a == b != c


def test_fingerprint_of_small_set_is_the_plain_digest(spark):
    import hashlib

    members = spark.createDataFrame([("k", f"content_{i}", i) for i in range(1, 40)], "k string, content_index string, book_position int")
    want = hashlib.sha256("\n".join(f"content_{i}:{i}" for i in range(1, 40)).encode()).hexdigest()
    assert FR.set_fingerprint(members, ["k"]).first()["content_fingerprint"] == want
    tree = FR.set_fingerprint(members, ["k"], block=4).first()["content_fingerprint"]
    assert tree != want and tree == FR.set_fingerprint(members.repartition(7), ["k"], block=4).first()["content_fingerprint"]


def test_one_digest_rule_at_every_size(spark):
    members = spark.range(1, 5001).select(F.lit("k").alias("k"), F.format_string("c%d", "id").alias("content_index"), F.col("id").alias("book_position"))
    lines = F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda i: F.concat_ws(":", F.format_string("c%d", i), i.cast("string")))
    for block in (4096, 7):
        want = FR.set_fingerprint(members, ["k"], block=block).first()["content_fingerprint"]
        assert spark.range(1).select(FR.tree_digest(lines, block, 6).alias("d")).first()["d"] == want


def test_deep_and_circular_lineage(spark):
    rows = [("b", f"s{i}", f"s{i - 1}" if i else None, f"t{i}") for i in range(13)] + [("b", "x", "y", "X"), ("b", "y", "x", "Y"), ("b", "z", "gone", "Z")]
    got = {r["section_id"]: r for r in ST.lineage(spark.createDataFrame(rows, "book_id string, section_id string, parent_id string, title string")).collect()}
    assert got["s12"]["root_id"] == "s0" and got["s12"]["section_path"] == [f"t{i}" for i in range(13)]
    assert got["x"]["ancestors"] == ["y", "x"] and got["y"]["ancestors"] == ["x", "y"] and got["z"]["root_id"] == "z"


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n, made = 10_000, []
    monkeypatch.setattr(ST, "cut_lineage", lambda df, real=ST.cut_lineage: made.append(1) or real(df))
    chain = spark.range(n).select(F.lit("b").alias("book_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("section_id"), F.when(F.col("id") > 0, F.concat(F.lit("s"), (F.col("id") - 1).cast("string"))).alias("parent_id"), F.lit("ti").alias("title"), F.lit(" x ").alias("content"))
    sizes = {r["section_id"]: (r["subtree_chars"], r["cyclic"]) for r in ST.subtree_size(chain).collect()}
    assert all(sizes[f"s{i}"] == (1 + 3 * (n - 1 - i), False) for i in range(n))
    assert len(made) <= 16
    short = chain.filter("cast(substring(section_id, 2) as int) < 600")
    made.clear()
    deep = ST.lineage(short).filter("section_id = 's599'").first()
    assert deep["root_id"] == "s0" and deep["ancestors"] == [f"s{i}" for i in range(600)] and len(made) <= 12


def test_sizes_and_lineage_match_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for book in ("a", "b"):
        ids = [f"n{i}" for i in range(60)]
        for i, s in enumerate(ids):
            up = rnd.choice([None, "gone", *ids[:i], *ids[:i]]) if book == "a" else rnd.choice([None, *ids])  # the second book has loops
            rows.append((book, s, up, "t" * rnd.randrange(4), "c" * rnd.randrange(5)))
    df = spark.createDataFrame(rows, "book_id string, section_id string, parent_id string, title string, content string")
    node = {(b, s): (p, len(t), len(c)) for b, s, p, t, c in rows}

    def climb(b, s):
        path = [s]
        while (up := node[b, path[-1]][0]) is not None and (b, up) in node and up not in path:
            path.append(up)
        return path, up is not None and (b, up) in node and up == s

    want = {k: climb(*k) for k in node}
    got = {(r["book_id"], r["section_id"]): r["ancestors"] for r in ST.lineage(df).collect()}
    assert got == {k: v[0][::-1] for k, v in want.items()}
    sizes = {(r["book_id"], r["section_id"]): (r["subtree_chars"], r["cyclic"]) for r in ST.subtree_size(df).collect()}
    for (b, s), (_, loop) in want.items():
        below = [k for k, v in want.items() if k[0] == b and s in v[0]]
        size = None if loop else sum(node[k][2] + (node[k][1] if k[1] != s else 0) for k in below)
        assert sizes[b, s] == (size, loop)
    assert ST.subtree_size(df.limit(0)).count() == 0 == ST.lineage(df.limit(0)).count()


def test_anchor_levels(spark):
    rows = [("你好，世界 再见", "世界", 1, 3), ("a  b c", "ab", 2, 0), ("x, y! z.", "x y z", 3, 0), ("目标句子一二三四五六七八九十后文", "目标句子一二三四五六七八不同结尾", 4, 0), ("abc", "zzz", 0, -1)]
    df = spark.createDataFrame(rows, "c string, q string, level int, at int").withColumn("f", A.find_anchor(F.col("c"), F.col("q")))
    for r in df.collect():
        assert (r["f"]["level"], r["f"]["offset"]) == (r["level"], r["at"]), r


def test_quotes_match_brute_force(spark):
    rnd = random.Random(4)
    docs = [(1, "Alpha beta gamma delta epsilon zeta. Another line here for you"), (2, "x (Alpha beta gamma delta epsilon) end"), (3, "nothing to see"), (4, "xAlpha beta gamma delta"), (5, "他说过这样一句话然后离开了这个地方再没有回来")]
    quotes = [(1, "Alpha beta gamma delta"), (2, "Another line here"), (3, "absent words entirely now"), (4, "eta"), (5, "这样一句话然后离开了这个地方再没有"), (6, "一句"), (7, "Alpha\nbeta\u00a0gamma"), (8, "(Alpha; beta, gamma"), (9, "Another line here but other"), (10, "..."), (11, " "), (12, ""), (13, None), (14, "é"), (15, "—é")]
    bits = ["a", "b", "B", "1", " ", "\n", "\u3000", ".", "é", "中", "文", "—", "😀"]
    docs += [(10 + i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))) for i in range(80)] + [(None, "Alpha beta"), (7, None), (8, "")]
    quotes += [(100 + i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 18)))) for i in range(150)]
    quotes += [(300 + i, d[5:22]) for i, (_, d) in enumerate(docs) if d and len(d) > 25]
    d, q = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(quotes, "item int, quote string")
    for settings in ({}, {"bits": 1 << 16, "per_copy": 3}):
        got = sorted(((r["doc_id"] or 0, r["item"], r["level"], r["quote_offset"]) for r in Q.locate_quotes(d, q, **settings).collect()))
        pairs = d.where("length(text) > 0").crossJoin(q.where("length(quote) > 0")).withColumn("f", A.find_anchor(F.col("text"), F.col("quote")))
        want = sorted((r["doc_id"] or 0, r["item"], r["f"]["level"], r["f"]["offset"]) for r in pairs.where("f.level > 0").collect())
        assert got == want and {x[2] for x in got} == {1, 2, 3, 4}
    assert Q.locate_quotes(d, q.limit(0)).count() == 0 == Q.locate_quotes(d.limit(0), q).count()


def epub(pages):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{n}" href="p{n}.xhtml"/>' for n in range(len(pages)))
        spine = "".join(f'<itemref idref="i{n}"/>' for n in reversed(range(len(pages)))) + '<itemref idref="gone"/>'
        z.writestr("O/p.opf", f'<package xmlns="urn:y"><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for n, page in enumerate(pages):
            z.writestr(f"O/p{n}.xhtml", page)
    return out.getvalue()


def test_library_reading(spark):
    files = spark.createDataFrame(
        [
            ("/l/a.epub", bytearray(epub(["<html><body><h1>二</h1><p>后 &amp; <b>来</b></p></body></html>", "<h1>一</h1><script>var x;</script><p>先</p>"]))),
            ("/l/b.md", bytearray("﻿# 标题\n正文".encode())),
            ("/l/c.txt", bytearray("旧编码文本".encode("gb18030"))),
            ("/l/bad.epub", bytearray(b"nope")),
            ("/l/d.pdf", bytearray(b"x")),
        ],
        "path string, content binary",
    )
    books, errors = RD.read_library(RD.with_suffix(files))
    got = {r["filename"]: r["text"] for r in books.collect()}
    assert got["b.md"] == "# 标题\n正文" and got["c.txt"] == "旧编码文本"
    assert got["a.epub"].index("# 一") < got["a.epub"].index("# 二") and "后 & 来" in got["a.epub"] and "var x;" in got["a.epub"]
    assert {r["path"].rsplit("/")[-1] for r in errors.collect()} == {"bad.epub", "d.pdf"}
    sections = ST.parse_books(books.filter("filename = 'a.epub'")).orderBy("position").collect()
    assert [s["title"] for s in sections] == ["一", "二"]


def test_toc_and_narrative(spark, one):
    toc = "# 目录\n## 第一章\n### 甲\n#### 乙\n## 第二章\n### 丙\n# 正文\n## 第一章"
    assert one(ST.toc_child_titles(F.lit(toc), F.lit("第一章"))) == ["甲", "乙"]
    assert one(ST.toc_child_titles(F.lit(toc), F.lit("没有"))) == []
    assert one(ST.toc_child_titles(F.lit("无标记"), F.lit("第一章"))) == []
    text = "# 第一章\n## 子主题：\n### 金句\n- 一句\n### 事件1：开端\n**事件背景：** 背景\n**事件经过：**\n- 甲\n- 乙\n**事件影响：**\n- 丙\n"
    subs = one(ST.narrative_subtopics(F.lit(text.replace("子主题：", "子主题：原名")), F.lit("主题"), F.array(F.lit("改名"))))
    assert subs[0]["subtopic_title"] == "改名" and subs[0]["golden_quotes"] == ["一句"]
    assert subs[0]["events"][0].asDict() == {"event_title": "开端", "event_background": "背景", "event_process": ["甲", "乙"], "event_impact": ["丙"]}
    bare = one(ST.narrative_subtopics(F.lit("# 章\n文"), F.lit("主题"), F.array().cast("array<string>")))
    assert [s["subtopic_title"] for s in bare] == ["无"]
    each = one(ST.narrative_subtopics(F.lit("# 章\n文"), F.lit("主题"), F.array(F.lit("p"), F.lit(" "), F.lit("q"))))
    assert [s["subtopic_title"] for s in each] == ["p", "q"]


def test_composed_chapters_hold_whole_documents(spark, monkeypatch):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(ST, "split_narrative_chapters", lambda c: F.array(F.struct(c.alias("number"), c.alias("title"))))
    composed = {r.doc_id: r.title for r in entry.queries()["narrative_chapters"](spark, d).collect()}
    texts = {r.doc_id: r.text.replace("#", "").split() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert set(composed) == set(texts) and max(map(len, texts.values())) > 1000
    assert all(" ".join(words) in " ".join(composed[i].split()) for i, words in texts.items())


def odd_texts_match_sql(spark, tmp_path, name, texts):
    rows = [(i, t, "en", "web") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    ok, note = check.compare(spark, str(tmp_path), name, entry.queries()[name], entry.oracle_sql()[name], con)
    assert ok, note


def test_rollup_of_odd_texts_matches_sql(spark, tmp_path):
    texts = [None, "", " \t\n", "a b. c", "one\\ntwo\\r\\nthree", "a\r\nb\rc", "\ufeff# x", "well-known ’tis 1.5"]
    odd_texts_match_sql(spark, tmp_path, "document_rollup", texts)


def test_subtopics_of_odd_texts_match_sql(spark, tmp_path):
    odd_texts_match_sql(spark, tmp_path, "narrative_subtopics", [None, "- a\n- b", "** x **", "## 子主题：y\n### 金句", "甲：乙"])


def test_chapters_of_null_texts_match_sql(spark, tmp_path):
    odd_texts_match_sql(spark, tmp_path, "narrative_chapters", [None, "a"])
