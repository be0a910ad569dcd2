import json

import pytest
from pyspark.sql import functions as F

from bindery.functions import modeljson as J
from bindery.operators import assets as A

GOOD, BAD = ["content_a", "content_b"], "content_zz"


def text(t, *ix):
    return {"text": t, "source_content_indexes": list(ix)}


CHAPTER = {
    "chapter_title": " 章 ",
    "chapter_theme": "题",
    "subtopics": [
        {
            "title": "甲",
            "definitions": [{"name": "名", "definition": "义", "source_content_indexes": ["content_b", " content_a ", "content_b"]}, {"name": "坏", "definition": "", "source_content_indexes": GOOD}],
            "quotes": [text("引", "content_a"), text("空")],
            "viewpoints": [
                {
                    **text("观", "content_a"),
                    "arguments": [text("据", "content_b"), text("坏据", BAD)],
                    "case": {"summary": "概", "relation": "联", "source_content_indexes": ["content_a"], "evidence_quotes": [text("证", "content_a"), text("外", "content_b")]},
                },
                {
                    **text("坏观", BAD),
                    "arguments": [text("留", "content_a")],
                    "case": {"summary": "概二", "relation": "联", "source_content_indexes": ["content_b"], "evidence_quotes": [text("证", "content_b")]},
                },
                {**text("无案", "content_a"), "arguments": [], "case": {"summary": "概三", "relation": "联", "source_content_indexes": ["content_a"], "evidence_quotes": [text("外", "content_b")]}},
            ],
        },
        {"title": " ", "definitions": [], "quotes": [], "viewpoints": [], "orphan_arguments": [text("旧留", "content_b")]},
    ],
}


def run(spark, *chapters):
    rows = [(f"a{i}", "book", "r", "s", json.dumps(c, ensure_ascii=False)) for i, c in enumerate(chapters)]
    analyses = spark.createDataFrame(rows, "analysis_id string, book_id string, root_section_id string, set_id string, raw string")
    fragments = spark.createDataFrame(
        [("s", "r", "content_a", 1, "sec1"), ("s", "r", "content_b", 2, "sec2"), ("s", "other", BAD, 3, "sec3")],
        "set_id string, root_section_id string, content_index string, book_position int, source_section_id string",
    )
    return A.validate(A.resolve(analyses.withColumn("data", A.parse_analysis(F.col("raw"))), fragments))


def test_partial_validation(spark):
    r = run(spark, CHAPTER).first()
    sub = r["valid"]["subtopics"][0]
    assert r["valid"]["chapter_title"] == "章"
    assert [d["source_content_indexes"] for d in sub["definitions"]] == [["content_a", "content_b"]]
    assert [v["text"] for v in sub["viewpoints"]] == ["观", "无案"]
    assert sub["viewpoints"][0]["case"]["evidence_quotes"][0]["text"] == "证" and len(sub["viewpoints"][0]["case"]["evidence_quotes"]) == 1
    assert sub["viewpoints"][1]["case"] is None
    assert [a["text"] for a in sub["orphan_arguments"]] == ["留"] and [c["summary"] for c in sub["orphan_cases"]] == ["概二"]
    assert r["valid"]["subtopics"][1]["title"] == "子主题 2" and r["valid"]["subtopics"][1]["orphan_arguments"][0]["text"] == "旧留"
    assert [(i["asset_type"], i["error"]) for i in r["issues"]] == [
        ("概念", "definition.definition 不能为空"),
        ("金句", "金句 必须包含至少一个 source_content_indexes"),
        ("论据", f"论据 引用了无效 content_index：{BAD}"),
        ("案例证据", "案例证据索引必须包含在案例来源索引中"),
        ("观点", f"主要观点 引用了无效 content_index：{BAD}"),
        ("案例证据", "案例证据索引必须包含在案例来源索引中"),
        ("案例", "案例没有通过来源校验的 evidence_quotes"),
    ]
    assert r["invalid_item_count"] == 7 and r["valid_item_count"] == 9


def test_hard_errors_and_strict(spark):
    rows = {r["analysis_id"]: r for r in run(spark, {**CHAPTER, "chapter_theme": " "}, {**CHAPTER, "subtopics": []}, CHAPTER).collect()}
    assert rows["a0"]["rejected_reason"] == "chapter_theme 不能为空" and rows["a0"]["valid"] is None
    assert rows["a1"]["rejected_reason"] == "subtopics 必须是非空数组"
    assert rows["a2"]["rejected_reason"] is None
    assert A.strict_failures(run(spark, CHAPTER)).first()["first_error"] == "definition.definition 不能为空"


def test_strict_write_keeps_what_it_refuses(spark, tmp_path):
    fine = {"chapter_title": "t", "chapter_theme": "h", "subtopics": [{"title": "s", "quotes": [text("q", "content_a")]}]}
    v, path = run(spark, CHAPTER, fine, {**CHAPTER, "subtopics": []}), str(tmp_path / "out")
    with pytest.raises(A.RefusedAnalyses, match="2 of 3"):
        A.write_strict(v, path)
    assert {r["analysis_id"]: r["first_error"] for r in A.read_strict(spark, path, True).collect()} == {"a0": "definition.definition 不能为空", "a2": "subtopics 必须是非空数组"}
    assert [r["analysis_id"] for r in A.read_strict(spark, path, False).collect()] == ["a1"]
    assert A.write_strict(v, path, strict=False)["refused"] == 2 and A.write_strict(run(spark, fine), path)["refused"] == 0


def test_cards_links_and_rendering(spark):
    v = run(spark, CHAPTER)
    cards = A.derive_cards(v).orderBy("card_no").collect()
    assert [(c["kind"], c["title"]) for c in cards] == [
        ("概念", "名"), ("金句", "甲 · 金句"), ("观点", "甲"), ("论据", "甲 · 论据"), ("案例", "甲 · 案例"), ("观点", "甲"),
        ("论据", "甲 · 论据（观点未通过校验）"), ("案例", "甲 · 案例（观点未通过校验）"), ("论据", "子主题 2 · 论据（观点未通过校验）"),
    ]
    assert cards[0]["source_section_ids"] == ["sec1", "sec2"] and len({c["card_id"] for c in cards}) == 9
    assert A.card_links(A.derive_cards(v)).count() == sum(len(c["indexes"]) for c in cards)
    md = v.select(A.render_chapter(F.col("valid"), F.col("book_id"))).first()[0]
    lines = md.split("\n")
    assert lines[:4] == ["# 章", "**章节主题：** 题", "", "## 子主题：甲"]
    assert f"**知识资产 ID：** {cards[0]['card_id']}" in lines and "**原文索引：** content_a、content_b" in lines
    assert "### 主要观点1：观" in lines and "### 独立保留的论据（所属观点未通过原文校验）" in lines and "  - 证 （content_a）" in lines
    active = A.derive_cards(v).filter("kind <> '金句'")
    compact = A.render_compact(v, active).first()["compact_markdown"]
    assert "- [概念] 名：义" in compact and "金句" not in compact and "论据" not in compact and "- [案例] 案例：概 关联：联" in compact


def test_revalidation_outcomes(spark):
    clean = {**CHAPTER, "subtopics": [{"title": "甲", "definitions": [], "quotes": [text("引", "content_a")], "viewpoints": []}]}
    v = run(spark, clean, clean, CHAPTER, clean)
    cards = A.derive_cards(v)
    links = cards.filter("analysis_id <> 'a1'").select("analysis_id", "card_id")
    status = F.when(F.col("analysis_id") == "a3", "succeeded").otherwise("partial")
    partial = v.select("analysis_id", "book_id", "root_section_id", "set_id", "data").withColumn("status", status)
    fragments = spark.createDataFrame(
        [("s", "r", "content_a", 1, "sec1"), ("s", "r", "content_b", 2, "sec2")], "set_id string, root_section_id string, content_index string, book_position int, source_section_id string"
    )
    got = {r["analysis_id"]: r["outcome"] for r in A.revalidate(partial, fragments, links).collect()}
    assert got == {"a0": "upgraded", "a1": "failed", "a2": "failed", "a3": "skipped"}


def test_relationships(one):
    ok = '```json\n{"relationships":[{"characters":[" 甲 ","乙"],"relationship":"友","evidence":"据"},{"characters":["丙"],"relationship":"敌"}]}\n```'
    assert one(A.parse_relationships(F.lit(ok))) == ["甲、乙：友（依据：据）", "丙：敌"]
    assert one(A.parse_relationships(F.lit('{"relationships":[{"characters":["甲"],"relationship":" "}]}'))) is None
    assert one(A.parse_relationships(F.lit('{"other":1}'))) is None


def test_loose_json(spark, one):
    assert one(A.parse_json_object(F.lit("[1]")))["error"] == "模型输出必须是 JSON 对象"
    assert one(A.parse_json_object(F.lit("{")))["error"] == "invalid JSON"
    assert one(J.chapters(F.lit("{bad"))) == []
    df = spark.createDataFrame([('{"character_relationships":[1],"x":2}{"y":3} tail',)], "t string")
    rows = df.select(J.split_concatenated(F.col("t"))).first()[0]
    assert [(json.loads(r["character_relationships"]), json.loads(r["rest"])) for r in rows] == [([1], {"x": 2}), ([], {"y": 3})]


def test_one_bad_element_hides_no_other(spark):
    sub = {
        "title": "乙",
        "quotes": ["oops", text("引", "content_a"), {"text": 5, "source_content_indexes": GOOD}, {"text": "数", "source_content_indexes": [7]}, None],
        "definitions": [3, {"name": "名", "definition": "义", "source_content_indexes": GOOD}],
        "viewpoints": ["x", {**text("观", "content_a"), "arguments": [[]], "case": "oops"}, {**text("静", "content_a"), "case": None}],
    }
    r = run(spark, {"chapter_title": "章", "chapter_theme": "题", "subtopics": [sub]}).first()
    kept = r["valid"]["subtopics"][0]
    assert [q["text"] for q in kept["quotes"]] == ["引"] and len(kept["definitions"]) == 1
    assert [(v["text"], v["case"]) for v in kept["viewpoints"]] == [("观", None), ("静", None)]
    errors = [(i["asset_type"], i["error"]) for i in r["issues"]]
    assert errors.count(("金句", "quotes 条目必须包含 text 和 source_content_indexes")) == 2
    assert ("金句", "quote.text 不能为空") in errors and ("金句", "金句 的 source_content_indexes 无效") in errors
    assert ("案例", "case 结构无效") in errors and ("概念", "definitions 条目结构无效") in errors
    assert [i["title"] for i in r["issues"] if i["error"] == "viewpoints 条目结构无效"] == ["结构无效的观点"]
    assert len(errors) == 8


def test_broken_subtopic_rejects(spark):
    r = run(spark, {"chapter_title": "章", "chapter_theme": "题", "subtopics": [{"title": "a"}, "oops"]}, ["no object"])
    assert {x["rejected_reason"] for x in r.collect()} == {"第 2 个子主题结构无效", "模型输出必须是 JSON 对象"}


def test_indexes_are_trimmed_once_and_issues_made_where_wanted(one):
    places = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(1)).cast("map<string,bigint>")
    given = lambda *xs: F.array(*[F.lit(x).cast("string") for x in xs])
    checked = lambda *xs: one(A.check_indexes(given(*xs), F.lit("x"), places))
    assert str(A.check_indexes(F.col("raw"), F.lit("x"), F.col("p"))).count("trim(") == 1
    assert checked(" a", "b ", "a").indexes == ["b", "a"] and checked(" a").indexes == ["a"] and checked("a").error is None
    assert checked().error.endswith("至少一个 source_content_indexes") and checked().indexes == []
    assert checked("a", None).error.endswith("无效") and checked(None).indexes == [None] and checked("a", " c").error.endswith("：c")
    text = lambda t: F.struct(F.lit(t).alias("text"), given("a").alias("source_content_indexes"))
    good, bad = (one(A._checked_text(text(t), "f", "l", "k", "s", places)) for t in ("t ", " "))
    assert good.ok and good.item.text == "t" and good.issue is None
    assert not bad.ok and bad.item is None and bad.issue.error == "f 不能为空"


def test_revalidation_composes_and_validates_once(spark, monkeypatch):
    """One table of analyses and one of what the second look found."""
    import __spark_entry__ as entry
    from bindery.catalog import q_assets

    stored, cut = [], A.cut_lineage
    monkeypatch.setattr(q_assets, "cut_lineage", lambda df: stored.append("composed") or cut(df))
    monkeypatch.setattr(A, "cut_lineage", lambda df: stored.append("checked") or cut(df))
    entry.queries()["analyses_revalidated"](spark, "/root/testdata/sf0.001")
    assert stored == ["composed", "checked"]
