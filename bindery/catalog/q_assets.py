"""Structured analyses: validation, cards, rendering, loose JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import modeljson as J
from ..operators import assets as A
from ..rows import unnest
from ..session import cut_lineage, shared_folder
from . import views as V
from .q_evidence import ANALYSES, analyses, links
from .q_structure import source_books
from .q_text import FLAT
from .registry import query, table


def _ref(c: Column) -> Column:
    return F.concat(F.lit("content_"), c.cast("string"))


def composed(spark, d) -> DataFrame:
    """One analysis per order, its items from the order's few lines.

    Flag A lines give definitions, R quotes, N viewpoints with an argument
    and, on even line numbers, a case.
    """
    text = lambda prefix: F.concat(F.lit(prefix), F.col("l_partkey").cast("string"))
    own, nxt, far = _ref(F.col("l_suppkey")), _ref(F.col("l_suppkey") + 1), _ref(F.col("l_suppkey") + 50)
    item = lambda t, *ix: F.struct(t.alias("text"), F.array(*ix).alias("source_content_indexes"))
    case = F.when(
        F.col("l_linenumber") % 2 == 0,
        F.struct(
            text("s").alias("summary"), F.lit("r").alias("relation"), F.array(nxt, own, own).alias("source_content_indexes"),
            F.array(item(F.lit("e"), own), item(F.lit("f"), far)).alias("evidence_quotes"),
        ),
    )
    line = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("k"),
        F.when(
            F.col("l_returnflag") == "A",
            F.struct(text("d").alias("name"), text("def ").alias("definition"), F.array(nxt, own).alias("source_content_indexes")),
        ).alias("definition"),
        F.when(F.col("l_returnflag") == "R", item(text("q"), own)).alias("quote"),
        F.when(
            F.col("l_returnflag") == "N",
            F.struct(
                F.when(F.col("l_tax") == 0, F.lit(" ")).otherwise(text("v")).alias("text"), F.array(own).alias("source_content_indexes"),
                F.array(item(text("a"), nxt)).alias("arguments"), case.alias("case"),
            ),
        ).alias("viewpoint"),
    )
    grouped = line.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("k", "definition", "quote", "viewpoint"))).alias("r"))
    pick = lambda name: F.filter(F.transform("r", lambda x: x[name]), lambda x: x.isNotNull())
    sub = F.struct(
        F.concat(F.lit("topic "), F.col("o_orderkey").cast("string")).alias("title"),
        pick("definition").alias("definitions"), pick("quote").alias("quotes"), pick("viewpoint").alias("viewpoints"),
    )
    o = table(spark, d, "orders").join(grouped, "o_orderkey")
    data = F.struct(
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("chapter_title"),
        F.col("o_orderstatus").alias("chapter_theme"), F.array(sub).alias("subtopics"),
    )
    # Through JSON, as stored model output arrives.
    return o.select(
        F.col("o_orderkey").alias("analysis_id"), F.concat(F.lit("b"), F.col("o_custkey").cast("string")).alias("book_id"), (F.col("o_custkey") % 2).alias("root_section_id"),
        F.lit(0).alias("set_id"), A.parse_analysis(F.concat(F.lit("```json\n"), F.to_json(data), F.lit("\n```"))).alias("data"),
    )


def allowed(spark, d) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(
        F.lit(0).alias("set_id"), (F.col("s_nationkey") % 2).cast("bigint").alias("root_section_id"), _ref(F.col("s_suppkey")).alias("content_index"),
        F.col("s_suppkey").alias("book_position"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("source_section_id"),
    )


def stored(spark, d) -> DataFrame:
    """The composed analyses as a stored table: they are read more than once."""
    return cut_lineage(composed(spark, d))


def validated(spark, d) -> DataFrame:
    return A.validate(A.resolve(stored(spark, d), allowed(spark, d)))


# Validity of the ids each line cites, for the SQL forms.
LINES = """ok AS (SELECT s_suppkey AS k, s_nationkey % 2 AS root, s_nationkey AS nat FROM supplier),
lines AS (
  SELECT l.*, o_custkey, o_orderkey % 50 = 0 AS bad_title, l_tax <> 0 AS has_text,
         a.k IS NOT NULL AS v0, b.k IS NOT NULL AS v1, c.k IS NOT NULL AS v50, a.nat AS nat0, b.nat AS nat1,
         row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS item_no
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN ok a ON a.k = l_suppkey AND a.root = o_custkey % 2
  LEFT JOIN ok b ON b.k = l_suppkey + 1 AND b.root = o_custkey % 2
  LEFT JOIN ok c ON c.k = l_suppkey + 50 AND c.root = o_custkey % 2
)"""


@query(
    "assets_flattened", "N2",
    f"""WITH {LINES}
        SELECT l_orderkey AS analysis_id, 'definition' AS slot, item_no, 0 AS child_no, 'def ' || l_partkey AS body, 'content_' || (l_suppkey + 1) || ',content_' || l_suppkey AS ix FROM lines WHERE l_returnflag = 'A'
        UNION ALL SELECT l_orderkey, 'quote', item_no, 0, 'q' || l_partkey, 'content_' || l_suppkey FROM lines WHERE l_returnflag = 'R'
        UNION ALL SELECT l_orderkey, 'viewpoint', item_no, 0, CASE WHEN l_tax = 0 THEN ' ' ELSE 'v' || l_partkey END, 'content_' || l_suppkey FROM lines WHERE l_returnflag = 'N'
        UNION ALL SELECT l_orderkey, 'argument', item_no, 1, 'a' || l_partkey, 'content_' || (l_suppkey + 1) FROM lines WHERE l_returnflag = 'N'
        UNION ALL SELECT l_orderkey, 'case', item_no, 0, 's' || l_partkey, 'content_' || (l_suppkey + 1) || ',content_' || l_suppkey || ',content_' || l_suppkey FROM lines WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0
        UNION ALL SELECT l_orderkey, 'evidence', item_no, 1, 'e', 'content_' || l_suppkey FROM lines WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0
        UNION ALL SELECT l_orderkey, 'evidence', item_no, 2, 'f', 'content_' || (l_suppkey + 50) FROM lines WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0""",
)
def _(spark, d):
    r = A.flatten_assets(composed(spark, d))
    return r.select("analysis_id", "slot", F.col("item_no").cast("bigint").alias("item_no"), "child_no", "body", F.array_join("indexes", ",").alias("ix"))


@query(
    "assets_validated", "N1 N3 N4 N5 N6 N7 A12",
    f"""WITH {LINES}, t AS (
          SELECT l_orderkey, bad_title,
            CASE l_returnflag WHEN 'A' THEN (v0 AND v1)::INT WHEN 'R' THEN v0::INT ELSE (v0 AND has_text)::INT + v1::INT + (l_linenumber % 2 = 0 AND v0 AND v1)::INT END AS good,
            CASE l_returnflag WHEN 'A' THEN (NOT (v0 AND v1))::INT WHEN 'R' THEN (NOT v0)::INT ELSE (NOT (v0 AND has_text))::INT + (NOT v1)::INT + (l_linenumber % 2 = 0)::INT END AS bad
          FROM lines)
        SELECT l_orderkey AS analysis_id, CASE WHEN any_value(bad_title) THEN 'chapter_title 不能为空' END AS rejected_reason,
               CAST(CASE WHEN any_value(bad_title) THEN 0 ELSE sum(good) END AS BIGINT) AS valid_items, CAST(CASE WHEN any_value(bad_title) THEN 0 ELSE sum(bad) END AS BIGINT) AS invalid_items
        FROM t GROUP BY 1""",
)
def _(spark, d):
    return validated(spark, d).select(
        "analysis_id", "rejected_reason", F.col("valid_item_count").cast("bigint").alias("valid_items"), F.col("invalid_item_count").cast("bigint").alias("invalid_items")
    )


@query(
    "asset_issues", "N5 N6 N7",
    f"""WITH {LINES}, i AS (
          SELECT l_orderkey, '概念' AS asset_type, 'd' || l_partkey AS title, '概念“d' || l_partkey || '” 引用了无效 content_index：content_' || CASE WHEN NOT v1 THEN l_suppkey + 1 ELSE l_suppkey END AS error
          FROM lines WHERE l_returnflag = 'A' AND NOT (v0 AND v1) AND NOT bad_title
          UNION ALL SELECT l_orderkey, '金句', 'q' || l_partkey, '金句 引用了无效 content_index：content_' || l_suppkey FROM lines WHERE l_returnflag = 'R' AND NOT v0 AND NOT bad_title
          UNION ALL SELECT l_orderkey, '观点', CASE WHEN has_text THEN 'v' || l_partkey ELSE '未命名条目' END, CASE WHEN NOT has_text THEN 'viewpoint.text 不能为空' ELSE '主要观点 引用了无效 content_index：content_' || l_suppkey END
          FROM lines WHERE l_returnflag = 'N' AND NOT (v0 AND has_text) AND NOT bad_title
          UNION ALL SELECT l_orderkey, '论据', 'a' || l_partkey, '论据 引用了无效 content_index：content_' || (l_suppkey + 1) FROM lines WHERE l_returnflag = 'N' AND NOT v1 AND NOT bad_title
          UNION ALL SELECT l_orderkey, '案例', 's' || l_partkey, '案例 引用了无效 content_index：content_' || CASE WHEN NOT v1 THEN l_suppkey + 1 ELSE l_suppkey END
          FROM lines WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0 AND NOT (v0 AND v1) AND NOT bad_title
          UNION ALL SELECT l_orderkey, '案例证据', 'f', CASE WHEN v50 THEN '案例证据索引必须包含在案例来源索引中' ELSE '案例证据 引用了无效 content_index：content_' || (l_suppkey + 50) END
          FROM lines WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0 AND v0 AND v1 AND NOT bad_title)
        SELECT l_orderkey AS analysis_id, asset_type, title, error FROM i""",
)
def _(spark, d):
    return unnest(validated(spark, d), ["analysis_id"], "issues", "i").select("analysis_id", "i.asset_type", "i.title", "i.error")


def _card_sql(kind: str, title: str, body: str, ix: str, where: str, sections: str) -> str:
    return (
        f"SELECT l_orderkey AS analysis_id, o_custkey, '{kind}' AS kind, {title} AS title, {body} AS body, {ix} AS ix, {sections} AS secs FROM lines WHERE NOT bad_title AND {where}"
    )


_BOTH, _BOTH_N = "['content_' || l_suppkey, 'content_' || (l_suppkey + 1)]", "list_distinct(['n' || nat0, 'n' || nat1])"
_TOPIC = "'topic ' || l_orderkey"


@query(
    "cards_derived", "N9 T23",
    f"""WITH {LINES}, c AS (
          {_card_sql("概念", "'d' || l_partkey", "'def ' || l_partkey", _BOTH, "l_returnflag = 'A' AND v0 AND v1", _BOTH_N)}
          UNION ALL {_card_sql("金句", _TOPIC + " || ' · 金句'", "'q' || l_partkey", "['content_' || l_suppkey]", "l_returnflag = 'R' AND v0", "['n' || nat0]")}
          UNION ALL {_card_sql("观点", _TOPIC, "'v' || l_partkey", "['content_' || l_suppkey]", "l_returnflag = 'N' AND v0 AND has_text", "['n' || nat0]")}
          UNION ALL {_card_sql("论据", _TOPIC + " || CASE WHEN v0 AND has_text THEN ' · 论据' ELSE ' · 论据（观点未通过校验）' END", "'a' || l_partkey", "['content_' || (l_suppkey + 1)]", "l_returnflag = 'N' AND v1", "['n' || nat1]")}
          UNION ALL {_card_sql("案例", _TOPIC + " || CASE WHEN v0 AND has_text THEN ' · 案例' ELSE ' · 案例（观点未通过校验）' END", "'s' || l_partkey || chr(10) || chr(10) || '关联：r'", _BOTH, "l_returnflag = 'N' AND l_linenumber % 2 = 0 AND v0 AND v1", _BOTH_N)})
        SELECT analysis_id, kind, title, body, array_to_string(ix, ',') AS ix, array_to_string(list_sort(secs), ',') AS sections,
               'knowledge_' || left(sha256('{{"body": "' || regexp_replace(body, '\\s+', '', 'g') || '", "book_id": "b' || o_custkey || '", "kind": "' || kind || '", "sources": ["' || array_to_string(ix, '", "') || '"]}}'), 24) AS card_id
        FROM c""",
)
def _(spark, d):
    r = A.derive_cards(validated(spark, d))
    return r.select("analysis_id", "kind", "title", "body", F.array_join("indexes", ",").alias("ix"), F.array_join(F.array_sort("source_section_ids"), ",").alias("sections"), "card_id")


@query(
    "strict_failures", "N8",
    f"""WITH {LINES}, i AS (
          SELECT l_orderkey, 0 AS g, 0 AS no, 0 AS part, 'chapter_title 不能为空' AS error FROM lines WHERE bad_title
          UNION ALL SELECT l_orderkey, 1, item_no, 0, '概念“d' || l_partkey || '” 引用了无效 content_index：content_' || CASE WHEN NOT v1 THEN l_suppkey + 1 ELSE l_suppkey END FROM lines WHERE l_returnflag = 'A' AND NOT (v0 AND v1)
          UNION ALL SELECT l_orderkey, 2, item_no, 0, '金句 引用了无效 content_index：content_' || l_suppkey FROM lines WHERE l_returnflag = 'R' AND NOT v0
          UNION ALL SELECT l_orderkey, 3, item_no, 0, CASE WHEN NOT has_text THEN 'viewpoint.text 不能为空' ELSE '主要观点 引用了无效 content_index：content_' || l_suppkey END FROM lines WHERE l_returnflag = 'N' AND NOT (v0 AND has_text)
          UNION ALL SELECT l_orderkey, 3, item_no, 1, '论据 引用了无效 content_index：content_' || (l_suppkey + 1) FROM lines WHERE l_returnflag = 'N' AND NOT v1
          UNION ALL SELECT l_orderkey, 3, item_no, 2, CASE WHEN NOT v1 THEN '案例 引用了无效 content_index：content_' || (l_suppkey + 1) WHEN NOT v0 THEN '案例 引用了无效 content_index：content_' || l_suppkey
                WHEN v50 THEN '案例证据索引必须包含在案例来源索引中' ELSE '案例证据 引用了无效 content_index：content_' || (l_suppkey + 50) END FROM lines WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0)
        SELECT l_orderkey AS analysis_id, arg_min(error, row(g, no, part)) AS first_error FROM i GROUP BY 1
        UNION ALL SELECT NULL, count(*) || ' of ' || (SELECT count(DISTINCT l_orderkey) FROM lines) FROM (SELECT DISTINCT l_orderkey FROM i)""",
)
def _(spark, d):
    # Written strictly: the count that the failed write tells is a row as well.
    path = f"{shared_folder(spark)}/bindery-{uuid.uuid4().hex}/analyses"
    try:
        told = A.write_strict(validated(spark, d).select("analysis_id", "rejected_reason", "issues"), path)
    except A.RefusedAnalyses as refused:
        told = {"refused": refused.refused, "total": refused.total}
    counts = spark.range(1).select(F.lit(None).cast("bigint").alias("analysis_id"), F.lit(f"{told['refused']} of {told['total']}").alias("first_error"))
    return A.read_strict(spark, path, True).select("analysis_id", "first_error").unionByName(counts)


@query(
    "asset_items_malformed", "N1 N3 N4 N5 N6 N7",
    """WITH ok AS (SELECT s_suppkey AS k, s_nationkey % 2 AS root FROM supplier), l AS (
          SELECT l_orderkey, l_linenumber % 5 AS kind, 'q' || l_partkey AS title, 'content_' || l_suppkey AS ref, k IS NOT NULL AS known
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN ok ON k = l_suppkey AND root = o_custkey % 2),
        i AS (SELECT l_orderkey, '金句' AS asset_type, CASE WHEN kind IN (1, 2) THEN '金句' ELSE title END AS title, CASE kind WHEN 1 THEN 'quotes 条目必须包含 text 和 source_content_indexes' WHEN 2 THEN 'quote.text 不能为空' WHEN 3 THEN '金句 的 source_content_indexes 无效'
              ELSE CASE WHEN NOT known THEN '金句 引用了无效 content_index：' || ref END END AS error FROM l WHERE kind <> 4
          UNION ALL SELECT l_orderkey, '观点', title, CASE WHEN NOT known THEN '主要观点 引用了无效 content_index：' || ref END FROM l WHERE kind = 4
          UNION ALL SELECT l_orderkey, '案例', '案例', 'case 结构无效' FROM l WHERE kind = 4)
        SELECT l_orderkey AS analysis_id, asset_type, title, error FROM i WHERE error IS NOT NULL""",
)
def _(spark, d):
    # Quotes by line number: an object, a bare text, a numeric text, an index that is a number; a viewpoint whose case is a text.
    kind, ref = F.col("l_linenumber") % 5, _ref(F.col("l_suppkey"))
    item = lambda text, more="", ids="": F.concat(F.lit('{"text":'), text, F.lit(',"source_content_indexes":["'), ref, F.lit(f'"{ids}]{more}}}'))
    title = F.concat(F.lit('"q'), F.col("l_partkey").cast("string"), F.lit('"'))
    quote = F.when(kind == 0, item(title)).when(kind == 1, title).when(kind == 2, item(F.col("l_partkey").cast("string"))).when(kind == 3, item(title, ids=",7"))
    view = F.when(kind == 4, item(title, more=',"arguments":"none","case":"told"'))
    listed = lambda name, c: F.concat(F.lit(f'"{name}":['), F.array_join(F.collect_list(c), ","), F.lit("]"))
    raw = F.concat(F.lit('{"chapter_title":"t","chapter_theme":"h","subtopics":[{"title":7,"definitions":{},'), listed("quotes", quote), F.lit(","), listed("viewpoints", view), F.lit("}]}"))
    grouped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(raw.alias("raw"))
    told = table(spark, d, "orders").join(grouped, "o_orderkey").select(
        F.col("o_orderkey").alias("analysis_id"), (F.col("o_custkey") % 2).alias("root_section_id"), F.lit(0).alias("set_id"), A.parse_analysis(F.col("raw")).alias("data")
    )
    checked = A.validate(A.resolve(cut_lineage(told), allowed(spark, d)))
    return unnest(checked, ["analysis_id"], "issues", "i").select("analysis_id", "i.asset_type", "i.title", "i.error")


def _id_sql(kind: str, body: str, ix: str) -> str:
    return (
        "'knowledge_' || left(sha256('{\"body\": \"' || regexp_replace(" + body + ", '\\s+', '', 'g') || '\", \"book_id\": \"b' || o_custkey || '\", \"kind\": \""
        + kind + "\", \"sources\": [\"' || array_to_string(" + ix + ", '\", \"') || '\"]}'), 24)"
    )


_NL = "chr(10)"
_ONE, _NEXT = "['content_' || l_suppkey]", "['content_' || (l_suppkey + 1)]"
_CASE_BODY = "'s' || l_partkey || chr(10) || chr(10) || '关联：r'"
_ARG_LINES = f"'- a' || l_partkey || {_NL} || '  - 知识资产 ID：' || {_id_sql('论据', chr(39) + 'a' + chr(39) + ' || l_partkey', _NEXT)} || {_NL} || '  - 原文索引：content_' || (l_suppkey + 1)"
_CASE_LINES = (
    f"'- **概述：** s' || l_partkey || {_NL} || '- **关联：** r' || {_NL} || '- **知识资产 ID：** ' || {_id_sql('案例', _CASE_BODY, _BOTH)} || {_NL} || '- **原文索引：** ' || array_to_string({_BOTH}, '、') || {_NL}"
    f" || '- **证据原文：**' || {_NL} || '  - e （content_' || l_suppkey || '）'"
)
_VIEW, _DEAD = "l_returnflag = 'N' AND v0 AND has_text", "l_returnflag = 'N' AND NOT (v0 AND has_text)"


@query(
    "chapters_rendered", "N11",
    f"""WITH {LINES}, ok_lines AS (SELECT *, count(*) FILTER (WHERE {_VIEW}) OVER (PARTITION BY l_orderkey ORDER BY item_no, l_returnflag ROWS UNBOUNDED PRECEDING) AS vno FROM lines WHERE NOT bad_title),
        blocks AS (
          SELECT l_orderkey, 0 AS g, 0 AS i, '# ' || o_orderpriority || {_NL} || '**章节主题：** ' || o_orderstatus || {_NL} || {_NL} || '## 子主题：topic ' || l_orderkey AS t FROM ok_lines JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
          UNION ALL SELECT l_orderkey, 1, item_no, {_NL} || '### 概念定义' || {_NL} || '**知识资产 ID：** ' || {_id_sql("概念", "'def ' || l_partkey", _BOTH)} || {_NL} || '**原文索引：** ' || array_to_string({_BOTH}, '、') || {_NL} || '**d' || l_partkey || '：** def ' || l_partkey
            FROM ok_lines WHERE l_returnflag = 'A' AND v0 AND v1
          UNION ALL SELECT DISTINCT l_orderkey, 2, 0, {_NL} || '### 金句' FROM ok_lines WHERE l_returnflag = 'R' AND v0
          UNION ALL SELECT l_orderkey, 3, item_no, '- q' || l_partkey || {_NL} || '  - 知识资产 ID：' || {_id_sql("金句", "'q' || l_partkey", _ONE)} || {_NL} || '  - 原文索引：content_' || l_suppkey FROM ok_lines WHERE l_returnflag = 'R' AND v0
          UNION ALL SELECT l_orderkey, 4, item_no, {_NL} || '### 主要观点' || vno || '：v' || l_partkey || {_NL} || '**知识资产 ID：** ' || {_id_sql("观点", "'v' || l_partkey", _ONE)} || {_NL} || '**原文索引：** content_' || l_suppkey || {_NL} || '**论据：**'
              || CASE WHEN v1 THEN {_NL} || {_ARG_LINES} ELSE '' END || CASE WHEN l_linenumber % 2 = 0 AND v1 THEN {_NL} || {_NL} || '**案例故事：**' || {_NL} || {_CASE_LINES} ELSE '' END FROM ok_lines WHERE {_VIEW}
          UNION ALL SELECT DISTINCT l_orderkey, 5, 0, {_NL} || '### 独立保留的论据（所属观点未通过原文校验）' FROM ok_lines WHERE {_DEAD} AND v1
          UNION ALL SELECT l_orderkey, 6, item_no, {_ARG_LINES} FROM ok_lines WHERE {_DEAD} AND v1
          UNION ALL SELECT DISTINCT l_orderkey, 7, 0, {_NL} || '### 独立保留的案例（所属观点未通过原文校验）' FROM ok_lines WHERE {_DEAD} AND v0 AND v1 AND l_linenumber % 2 = 0
          UNION ALL SELECT l_orderkey, 8, item_no, {_CASE_LINES} FROM ok_lines WHERE {_DEAD} AND v0 AND v1 AND l_linenumber % 2 = 0)
        SELECT l_orderkey AS analysis_id, string_agg(t, {_NL} ORDER BY g, i) AS markdown FROM blocks GROUP BY 1""",
)
def _(spark, d):
    v = validated(spark, d).filter(F.col("rejected_reason").isNull())
    return v.select("analysis_id", A.render_chapter(F.col("valid"), F.col("book_id")).alias("markdown"))


def _entry_sql(kind: str, label: str, body: str, ix: str) -> str:
    flat = f"trim(regexp_replace({body}, '\\s+', ' ', 'g'))"
    return f"'- [{kind}] ' || {label} || '：' || {flat} || {_NL} || '  - 知识资产 ID：' || {_id_sql(kind, body, ix)} || {_NL} || '  - 原文索引：' || array_to_string({ix}, '、')"


@query(
    "chapters_compact", "N12",
    f"""WITH {LINES}, ok_lines AS (SELECT * FROM lines WHERE NOT bad_title), blocks AS (
          SELECT l_orderkey, 0 AS g, 0 AS i, 0 AS j, '# ' || o_orderpriority || {_NL} || '**章节主题：** ' || o_orderstatus || {_NL} || {_NL} || '## 子主题：topic ' || l_orderkey AS t FROM ok_lines JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
          UNION ALL SELECT l_orderkey, 1, item_no, 0, {_entry_sql("概念", "'d' || l_partkey", "'def ' || l_partkey", _BOTH)} FROM ok_lines WHERE l_returnflag = 'A' AND v0 AND v1
          UNION ALL SELECT l_orderkey, 2, item_no, 0, {_entry_sql("金句", "'金句'", "'q' || l_partkey", _ONE)} FROM ok_lines WHERE l_returnflag = 'R' AND v0
          UNION ALL SELECT l_orderkey, 3, item_no, 0, {_entry_sql("观点", "'主要观点'", "'v' || l_partkey", _ONE)} FROM ok_lines WHERE {_VIEW}
          UNION ALL SELECT l_orderkey, 3, item_no, 1, {_entry_sql("案例", "'案例'", _CASE_BODY, _BOTH)} FROM ok_lines WHERE {_VIEW} AND v1 AND l_linenumber % 2 = 0
          UNION ALL SELECT l_orderkey, 4, item_no, 0, {_entry_sql("案例", "'案例'", _CASE_BODY, _BOTH)} FROM ok_lines WHERE {_DEAD} AND v0 AND v1 AND l_linenumber % 2 = 0)
        SELECT l_orderkey AS analysis_id, string_agg(t, {_NL} ORDER BY g, i, j) AS compact_markdown FROM blocks GROUP BY 1""",
)
def _(spark, d):
    accepted = validated(spark, d).filter(F.col("rejected_reason").isNull())
    v = cut_lineage(accepted.select("analysis_id", "book_id", "root_section_id", "homes", "valid"))
    return A.render_compact(v, A.derive_cards(v)).select("analysis_id", "compact_markdown")


@query(
    "analyses_revalidated", "N21",
    f"""WITH {LINES}, t AS (
          SELECT l_orderkey, any_value(bad_title) AS bad_title,
            sum(CASE l_returnflag WHEN 'A' THEN (v0 AND v1)::INT WHEN 'R' THEN v0::INT ELSE (v0 AND has_text)::INT + v1::INT + (l_linenumber % 2 = 0 AND v0 AND v1)::INT END) AS good,
            sum(CASE l_returnflag WHEN 'A' THEN (NOT (v0 AND v1))::INT WHEN 'R' THEN (NOT v0)::INT ELSE (NOT (v0 AND has_text))::INT + (NOT v1)::INT + (l_linenumber % 2 = 0)::INT END) AS bad
          FROM lines GROUP BY 1)
        SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'skipped' WHEN NOT bad_title AND bad = 0 AND good > 0 THEN 'upgraded' ELSE 'failed' END AS outcome, count(*) AS analyses FROM t GROUP BY 1""",
)
def _(spark, d):
    analysed = stored(spark, d)
    partial = analysed.withColumn("status", F.when(F.col("analysis_id") % 3 == 0, "succeeded").otherwise("partial"))
    published = A.derive_cards(A.validate(A.resolve(analysed, allowed(spark, d)))).select("analysis_id", "card_id")
    return A.revalidate(partial, allowed(spark, d), published).groupBy("outcome").agg(F.count(F.lit(1)).alias("analyses"))


@query(
    "cards_published", "N10",
    f"""WITH {V.CARDS}, {ANALYSES}, n AS (SELECT arg_max(analysis_id, version) AS analysis_id FROM analyses GROUP BY root_section_id)
        SELECT card_id, CASE WHEN card_id IN (SELECT card_id FROM links JOIN n USING (analysis_id)) THEN 'active' ELSE 'superseded' END AS status FROM cards""",
)
def _(spark, d):
    return A.publish_cards(analyses(spark, d), links(spark, d), V.cards(spark, d)).select("card_id", "status")


@query(
    "rule_based_cards", "N19 T6 T7 F10",
    f"""WITH t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM documents),
          c AS (SELECT doc_id, lang, '观点' AS kind, lang AS title,
                  coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_replace(b, '\\s+', ' ', 'g'), '([.])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) BETWEEN 24 AND 180)[1], left({FLAT.replace("text", "b")}, 160)) AS body FROM t
           UNION ALL SELECT doc_id, lang, '金句', lang || ' · 摘录', list_filter(list_transform(string_split(regexp_replace(b, '([.])', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) BETWEEN 36 AND 120)[1] FROM t
           UNION ALL SELECT doc_id, lang, '案例', lang, CASE WHEN lang IN ('de', 'en') THEN left({FLAT.replace("text", "b")}, 420) END FROM t)
        SELECT CAST(doc_id AS VARCHAR) AS section_id, kind, title, md5(body) AS body FROM c WHERE body IS NOT NULL""",
)
def _(spark, d):
    sections, _ = source_books(spark, d)
    r = A.rule_based_cards(sections.withColumn("kind", F.lit("article")), terminators=".", words=("de", "en"))
    return r.select("section_id", "kind", "title", F.md5("body").alias("body"))


@query(
    "mind_map_lines", "N20 W10",
    f"""WITH {V.TREE}, a AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY position) AS rn FROM tree WHERE level = 4)
        SELECT book_id, position, CAST(0 AS BIGINT) AS sub_position, '- ' || title AS line FROM tree WHERE level = 3
        UNION ALL SELECT a.book_id, t.position, rn, '  - ' || a.title FROM a JOIN tree t ON t.section_id = a.parent_id WHERE rn <= 8""",
)
def _(spark, d):
    return A.mind_map(V.tree(spark, d)).select("book_id", "position", "sub_position", "line")


@query(
    "relations_parsed", "N13",
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand || '、' || p_type || '：' || p_name || CASE WHEN p_size % 2 = 1 THEN '（依据：' || p_type || '）' ELSE '' END END AS relations FROM part""",
)
def _(spark, d):
    item = F.struct(
        F.array(F.concat(F.lit(" "), F.col("p_brand")), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).otherwise(F.lit(" "))).alias("characters"),
        F.concat("p_name", F.lit(" ")).alias("relationship"), F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("evidence"),
    )
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(item).alias("relationships"))), F.lit("\n```"))
    return table(spark, d, "part").select("p_partkey", F.array_join(A.parse_relationships(raw), "|").alias("relations"))


@query(
    "relations_replaced", "N22",
    """SELECT 'old ' || p_partkey AS body FROM part WHERE p_size NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)
       UNION ALL SELECT 'new ' || c_custkey FROM customer WHERE c_nationkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)""",
)
def _(spark, d):
    old = table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("section_id"), F.concat(F.lit("old "), F.col("p_partkey").cast("string")).alias("body"))
    new = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("section_id"), F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("body"))
    done = table(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("section_id"))
    return A.replace_relationships(old, new, done).select("body")


@query("json_objects", "N1", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE event_id % 3 WHEN 1 THEN '模型输出必须是 JSON 对象' WHEN 2 THEN 'invalid JSON' END AS error FROM events""")
def _(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit("{"), "props"))
    r = table(spark, d, "events").withColumn("r", A.parse_json_object(raw))
    return r.select("event_id", F.try_variant_get("r.value", "$.k", "bigint").alias("k"), "r.error")


def narrative_json(lang: Column, doc: Column, events: Column) -> Column:
    chapter = F.struct(
        F.struct(lang.alias("title")).alias("chapter"),
        F.array(F.struct(doc.alias("subtopic_title"), F.array(F.struct(lang.alias("viewpoint"))).alias("main_viewpoints"), events.alias("events"))).alias("subtopics"),
    )
    return F.to_json(F.struct(F.struct(F.array(chapter).alias("chapters")).alias("book_analysis")))


@query(
    "json_chapters_merged", "N14 N15",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '|' || source ELSE source END AS titles, source AS last_subtopic, lang AS viewpoint, 'ev' || doc_id AS event FROM documents""",
)
def _(spark, d):
    doc = F.col("doc_id").cast("string")
    events = F.array(F.struct(F.concat(F.lit("ev"), doc).alias("event_title"), F.array(doc).alias("event_process")))
    first = F.when(F.col("doc_id") % 2 == 0, narrative_json(F.col("lang"), doc, events)).otherwise(F.lit("{broken"))
    second = narrative_json(F.col("source"), F.col("source"), events)
    merged = J.projected_chapters(J.merged_chapters(F.array(first, second, F.lit('{"x": 1}'))))
    r = table(spark, d, "documents").withColumn("m", merged)
    last = F.element_at("m", -1)["subtopics"][0]
    return r.select(
        "doc_id", F.array_join(F.transform("m", lambda c: c["chapter_title"]), "|").alias("titles"), last["subtopic_title"].alias("last_subtopic"),
        F.when(last["viewpoints"][0]["viewpoint"] == F.col("source"), F.col("lang")).alias("viewpoint"), last["events"][0]["event_title"].alias("event"),
    )


@query("json_split", "N16", "SELECT doc_id, CAST(0 AS BIGINT) AS part, '[\"' || lang || '\"]' AS relations, '{\"a\": ' || doc_id || '}' AS rest FROM documents UNION ALL SELECT doc_id, 1, '[]', '{\"b\": \"' || source || '\"}' FROM documents")
def _(spark, d):
    doc = F.col("doc_id").cast("string")
    raw = F.concat(F.lit('{"a": '), doc, F.lit(', "character_relationships": ["'), "lang", F.lit('"]}{"b": "'), "source", F.lit('"}{oops'))
    r = table(spark, d, "documents").select("doc_id", J.split_concatenated(raw).alias("s"))
    return unnest(r, ["doc_id"], "s", "s", "part").select("doc_id", F.col("part").cast("bigint").alias("part"), F.col("s.character_relationships").alias("relations"), "s.rest")


@query(
    "json_cleaned", "N17 N18",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS title, CASE WHEN doc_id % 3 = 0 THEN 'given' ELSE source || '|' || lang END AS sections FROM documents",
)
def _(spark, d):
    body = F.struct(F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("title"), F.array(F.struct(F.col("source").alias("title")), F.struct(F.col("lang").alias("title"))).alias("sectionContents"))
    raw = F.concat(F.lit("```JSON\n"), F.to_json(body), F.lit("\n```"))
    bare = F.when(F.col("doc_id") % 3 != 0, F.to_json(body)).otherwise(F.lit("{}"))
    r = table(spark, d, "documents").select("doc_id", J.clean_chapter(raw).alias("c"), J.section_titles(bare, F.array(F.lit("given"))).alias("t"))
    return r.select("doc_id", F.col("c.title").alias("title"), F.array_join("t", "|").alias("sections"))


@query("json_chapters_read", "S8", "SELECT doc_id, lang AS title, length(text) AS chars, source AS section FROM documents WHERE doc_id % 5 <> 0")
def _(spark, d):
    chapter = F.struct(F.col("lang").alias("title"), F.col("text").alias("content"), F.array(F.struct(F.col("source").alias("title"))).alias("sectionContents"))
    raw = F.when(F.col("doc_id") % 5 != 0, F.to_json(F.struct(F.array(chapter).alias("chapterContents")))).otherwise(F.lit("nope"))
    r = unnest(table(spark, d, "documents"), ["doc_id"], J.chapters(raw), "c")
    return r.select("doc_id", "c.title", F.length("c.content").cast("bigint").alias("chars"), F.get("c.sectionContents", F.lit(0))["title"].alias("section"))


@query("first_materials", "S9", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '' END AS link FROM pages")
def _(spark, d):
    def m(kind: Column, link: Column) -> Column:
        return F.struct(kind.alias("materialType"), link.alias("material"))

    kinds = F.array(m(F.lit("COVER"), F.lit("x")), m(F.when(F.col("page_id") % 2 == 0, "STRUCTURED_BOOK").otherwise("AUDIO"), F.col("url")), m(F.lit("TAIL"), F.lit("y")))
    return table(spark, d, "pages").select("page_id", J.first_material(kinds, "STRUCTURED_BOOK").alias("link"))
