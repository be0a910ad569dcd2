import pytest
from pyspark.sql import functions as F

from bindery.plans import planning as P

L = F.lit
MODULE = "project_id string, position bigint, title string, listener_question string, chapter_keys array<string>, suggested int"


def budget(spark, count, desired=15):
    rows = [("p", i, f"m{i}", "q", [f"CHAPTER_{i:03d}"], i % 5 + 1) for i in range(1, count + 1)]
    m = spark.createDataFrame(rows, MODULE)
    projects = spark.createDataFrame([("p", desired, desired + 2)], "project_id string, desired int, maximum int")
    m = P.merge_to_max(m, projects)
    b = P.episode_budget(m, projects)
    shares = [r["episodes"] for r in P.apportion(m, b).orderBy("position").collect()]
    return b.first(), shares, m.count()


def test_budgets(spark):
    for count, total, left in ((15, 17, 15), (4, 14, 4), (20, 17, 17)):
        b, shares, modules = budget(spark, count)
        assert (b["minimum"], b["maximum"], b["selected"]) == (13, 17, total) and modules == left
        assert sum(shares) == total and min(shares) >= 1 and b["error"] is None


def apportion_brute_force(weights, selected):
    if sum(weights) == selected:
        return weights
    rest, total = selected - len(weights), sum(weights)
    floor = [rest * w // total for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (-(rest * weights[i] % total), i))[: rest - sum(floor)]
    return [1 + f + (i in order) for i, f in enumerate(floor)]


def test_apportion_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    cases = {f"p{k}": [rng.randint(1, 8) for _ in range(rng.randint(1, 25))] for k in range(40)}
    picks = {k: len(w) + rng.randint(0, 30) for k, w in cases.items()}
    m = spark.createDataFrame([(k, i, "t", "q", ["c"], x) for k, w in cases.items() for i, x in enumerate(w)], MODULE)
    b = spark.createDataFrame([(k, n) for k, n in picks.items()], "project_id string, selected int")
    got: dict = {}
    for r in P.apportion(m, b).orderBy("project_id", "position").collect():
        got.setdefault(r["project_id"], []).append(r["episodes"])
    for k, w in cases.items():
        assert got[k] == apportion_brute_force(w, picks[k]), k


def test_module_plan(one):
    md = "引言\n## 模块一：甲\n听众问题：问？\n来源章节：[CHAPTER_001]、CHAPTER_002\n建议声音数：12\n## 乙\n[CHAPTER_003]\n## 空"
    keys = F.array(*[L(f"CHAPTER_00{i}") for i in (1, 2, 3)])
    r = one(P.parse_module_plan(L(md), keys))
    assert r["error"] is None
    assert [(m["module_key"], m["title"], m["listener_question"], m["suggested"]) for m in r["modules"]] == [("MODULE_001", "甲", "问？", 8), ("MODULE_002", "乙", "乙", 4)]
    assert one(P.parse_module_plan(L("## 甲\nCHAPTER_001"), keys))["error"] == "模块计划遗漏章节：CHAPTER_002、CHAPTER_003"
    assert one(P.parse_module_plan(L("## 甲\nCHAPTER_009"), keys))["error"] == "模块计划引用未知章节：CHAPTER_009"
    assert one(P.parse_module_plan(L("无"), keys))["error"] == "模块计划没有可识别的模块或章节标识"


def test_split_oversized(spark):
    m = spark.createDataFrame([("p", "题", ["a", "b", "c", "d"], [40, 40, 40, 10], 5)], "project_id string, title string, chapter_keys array<string>, sizes array<int>, suggested int")
    rows = P.split_oversized(m, 100).orderBy("part").collect()
    assert [(r["title"], r["chapter_keys"], r["suggested"]) for r in rows] == [("题（第 1/2 部分）", ["a", "b"], 2), ("题（第 2/2 部分）", ["c", "d"], 2)]
    assert P.split_oversized(m, 30).first()["oversized"]


OUTLINE = """## 第1集：甲题
听众钩子：钩
核心主题：题
核心要点：
1. 一；

2. 二。
内容类型：深度解读
来源章节：[CHAPTER_001]、[CHAPTER_001]
模块标识：MODULE_009
被忽略
## 第 2 集: 乙题
**听众钩子**：钩二
**核心主题**：题二
**核心要点**：点
**内容类型**：承上启下
**来源章节**：CHAPTER_002
"""


def outlines(spark, md, suggested=2, keys=("CHAPTER_001", "CHAPTER_002"), catalog=("CHAPTER_001", "CHAPTER_002", "CHAPTER_003")):
    df = spark.createDataFrame([("r", "MODULE_001", 1, list(keys), list(catalog), suggested, md)], "run_id string, module_key string, position bigint, chapter_keys array<string>, catalog_keys array<string>, suggested int, markdown string")
    return P.parse_outlines(df).first()


def test_outline_parsing(spark):
    r = outlines(spark, OUTLINE)
    assert r["error"] is None
    a, b = r["episodes"]
    assert (a["title"], a["content_type"], a["chapter_keys"]) == ("甲题", "解读", ["CHAPTER_001"])
    assert a["main_points"] == "听众钩子：钩\n核心主题：题\n核心要点：\n1. 一；\n2. 二。"
    assert (b["title"], b["content_type"], b["chapter_keys"]) == ("乙题", "过渡", ["CHAPTER_002"])


def test_outline_errors(spark):
    assert outlines(spark, OUTLINE, suggested=3)["error"] == "MODULE_001 应有 3 集，实际解析 2 集"
    assert outlines(spark, OUTLINE.replace("核心主题：题\n", ""))["error"] == "MODULE_001 第 1 集缺少字段：核心主题"
    assert outlines(spark, OUTLINE.replace("CHAPTER_002", "CHAPTER_008"))["error"] == "MODULE_001 第 2 集引用未知章节：CHAPTER_008"
    assert outlines(spark, OUTLINE.replace("CHAPTER_002", "CHAPTER_003"))["error"] == "MODULE_001 第 2 集引用所属模块之外的章节：CHAPTER_003"
    assert outlines(spark, " ")["error"] == "MODULE_001 缺少已生成的模块大纲"
    assert outlines(spark, "x")["error"] == "MODULE_001 没有可识别的声音条目"


def test_recovered_structure_repeats(spark):
    m = spark.createDataFrame(
        [("r", "MODULE_001", 1, ["CHAPTER_001", "CHAPTER_002"], ["CHAPTER_001", "CHAPTER_002"], 2), ("r", "MODULE_002", 2, ["CHAPTER_001", "CHAPTER_002"], ["CHAPTER_001", "CHAPTER_002"], 2)],
        "run_id string, module_key string, position bigint, chapter_keys array<string>, catalog_keys array<string>, suggested int",
    )
    o = spark.createDataFrame([("r", "MODULE_001", OUTLINE), ("r", "MODULE_002", OUTLINE)], "run_id string, module_key string, content string")
    first = sorted(map(tuple, P.recover_structure(m, o).select("position", "episode_id", "title").collect()))
    assert [x[0] for x in first] == [1, 2, 3, 4] and first == sorted(map(tuple, P.recover_structure(m, o).select("position", "episode_id", "title").collect()))


def test_album_snapshot_switches_last(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([("e1",)], "episode_id string")
    two = spark.createDataFrame([("e2",)], "episode_id string")
    P.replace_album(one, one, root, "0001")
    two.write.parquet(f"{root}/versions/0002/episodes")  # an interrupted replacement
    assert P.read_album(spark, root)[0].first()[0] == "e1"
    P.replace_album(two, two, root, "0003")
    assert P.read_album(spark, root)[0].first()[0] == "e2"


def test_outline_lines_and_repeats(spark):
    md = "  ## 第1集：甲\n　核心主题：旧\n听众钩子：a  \n \t\n　b\nc 核心主题：d\n\n**核心主题**\n：新\n核心要点：x\n内容类型：*解读*\n来源章节：CHAPTER_002 my_content_ab\n##\n第二行"
    r = outlines(spark, md, suggested=1)
    assert r["error"] is None and r["episodes"][0]["title"] == "甲"
    assert r["episodes"][0]["main_points"] == "听众钩子：a\nb\nc 核心主题：d\n核心主题：新\n核心要点：\nx"
    assert outlines(spark, md.replace("my_", "my "), suggested=1)["error"] == "MODULE_001 第 1 集不得包含知识资产 ID或段落原文索引"
    long = "## 第1集：甲\n" + "".join(f"{n}：" + "行\n" * 20_000 for n in P.REQUIRED_FIELDS)
    assert outlines(spark, long.replace("内容类型：", "内容类型：解读\n模块标识：", 1), suggested=1)["error"] == "MODULE_001 第 1 集缺少来源章节"


def test_recovery_parses_once(spark):
    m = spark.createDataFrame([("r", f"M{k}", k, ["CHAPTER_001", "CHAPTER_002"], ["CHAPTER_001", "CHAPTER_002"], 2) for k in (1, 2)], "run_id string, module_key string, position bigint, chapter_keys array<string>, catalog_keys array<string>, suggested int")
    o = spark.createDataFrame([("r", "M1", ""), ("r", "M2", OUTLINE)], "run_id string, module_key string, content string")
    r = P.recover_structure(m, o)
    # The stored parse is read; no plan of the result cuts a text again.
    assert "regexp_extract" not in r._jdf.queryExecution().executedPlan().toString()
    assert sorted((x["module_key"], x["position"] or 0) for x in r.collect()) == [("M1", 0), ("M2", 1), ("M2", 2)]


@pytest.mark.parametrize("name, mark", [("structured_checked", "字段不完整"), ("module_plans_parsed", "模块计划遗漏章节")])
def test_parsed_columns_are_computed_once(spark, name, mark):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(mark) == 1


def test_structured_album(spark):
    ep = "struct<title:string,main_points:string,content_type:string,chapter_keys:array<string>,module_key:string>"
    good = ("甲 ", "听众钩子：a\n核心主题：b\n核心要点：c ", "解读类", ["[CHAPTER_001]", " CHAPTER_001"], " M1")
    rows = [(1, [good], True), (2, [good, None], True), (3, [], True), (4, None, True), (5, [good[:4] + ("M2",)], True), (6, [good[:4] + ("M2",)], False)]
    df = spark.createDataFrame(rows, f"id int, raw array<{ep}>, given boolean")
    catalog = F.create_map(L("CHAPTER_001"), F.struct(L("章").alias("title"), L("s1").alias("section_id")))
    modules = F.when(F.col("given"), F.create_map(L("M1"), F.array(L("CHAPTER_001"))))
    got = {r["id"]: r["s"] for r in df.select("id", P.validate_structured(F.col("raw"), catalog, modules, L(False)).alias("s")).collect()}
    assert [got[k]["error"] for k in range(1, 7)] == [None, "专辑第 2 条结构无效", *["结构化专辑大纲缺少 album_outline"] * 2, "专辑第 1 条缺少有效模块标识", None]
    e = got[1]["episodes"][0]
    assert (e["title"], e["content_framework"], e["section_identifier"], e["module_key"], e["chapter_keys"], e["source_section_ids"]) == ("甲", good[1].strip(), "[CHAPTER_001] 章", "M1", ["CHAPTER_001"], ["s1"])
    assert got[2]["episodes"] is None
