"""Catalogs, modules, budgets and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..ordered import running
from ..plans import planning as P
from ..rows import computed_once, unnest
from . import views as V
from .registry import query, table


def chapter_key(c: Column) -> Column:
    return X.ordinal_key("CHAPTER", c)


def modules(spark, d) -> DataFrame:
    """Modules: the lines of an order; suggested counts from quantities."""
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") % 7).alias("suggested")
    )
    placed = running(li, ["project_id"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_linenumber"), number="position")
    return placed.select(
        "project_id", "position", F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("title"),
        F.concat(F.lit("q"), (F.col("l_suppkey") % 3).cast("string")).alias("listener_question"),
        F.array(chapter_key(F.col("l_partkey") % 20), chapter_key(F.col("l_suppkey") % 20)).alias("chapter_keys"), "suggested",
    )


MODULES = """mods AS (
  SELECT l_orderkey AS project_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position,
         'm' || l_partkey AS title, 'q' || (l_suppkey % 3) AS question, 'CHAPTER_' || lpad(CAST(l_partkey % 20 AS VARCHAR), 3, '0') AS k1,
         'CHAPTER_' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS k2, CAST(floor(l_quantity) AS BIGINT) % 7 AS suggested
  FROM lineitem)"""


def projects(spark, d) -> DataFrame:
    c = F.col("o_custkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), (c % 9 + 1).alias("desired"), (c % 3 + 1).alias("maximum"))


PROJECTS = "projects AS (SELECT o_orderkey AS project_id, o_custkey % 9 + 1 AS desired, o_custkey % 3 + 1 AS maximum FROM orders)"
BUDGET = f"""{MODULES}, {PROJECTS}, need AS (SELECT project_id, count(*) AS modules, CAST(sum(greatest(1, suggested)) AS BIGINT) AS suggested_total FROM mods GROUP BY 1),
  budget AS (SELECT project_id, desired, greatest(1, desired - 2) AS minimum, desired + 2 AS maximum, modules, suggested_total,
                    greatest(modules, greatest(greatest(1, desired - 2), least(desired + 2, suggested_total))) AS selected FROM need JOIN projects USING (project_id))"""


@query(
    "episode_budgets", "P7",
    f"""WITH {BUDGET} SELECT *, CASE WHEN selected > maximum THEN '至少需要 ' || modules || ' 集才能覆盖全部知识模块，已超过目标允许上限 ' || maximum || ' 集' END AS error FROM budget""",
)
def _(spark, d):
    return P.episode_budget(modules(spark, d), projects(spark, d))


SHARES = f"""{BUDGET}, w AS (SELECT m.*, greatest(1, m.suggested) AS wt, b.selected, b.modules AS k, b.suggested_total AS tot FROM mods m JOIN budget b USING (project_id)),
  f AS (SELECT *, (selected - k) * wt // tot AS fl, ((selected - k) * wt) % tot AS rem FROM w),
  e AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rem DESC, position) AS rk, CAST((selected - k) - sum(fl) OVER (PARTITION BY project_id) AS BIGINT) AS extras FROM f),
  shares AS (SELECT project_id, position, title, question, k1, k2, CASE WHEN tot = selected THEN wt ELSE 1 + fl + CASE WHEN rk <= extras THEN 1 ELSE 0 END END AS episodes FROM e)"""


@query("episodes_apportioned", "P8", f"WITH {SHARES} SELECT project_id, position, CAST(episodes AS BIGINT) AS episodes FROM shares")
def _(spark, d):
    m = modules(spark, d)
    return P.apportion(m, P.episode_budget(m, projects(spark, d))).select("project_id", "position", "episodes")


@query(
    "module_plans_rendered", "P9",
    f"""WITH {SHARES}, l AS (
          SELECT project_id, 0 AS position, '目标集数：' || desired || chr(10) || '允许范围：' || minimum || '至' || maximum || '集' || chr(10) || '本次规划总数：' || selected || '集' || chr(10) AS t FROM budget
          UNION ALL SELECT project_id, position, '## 模块' || position || '：' || title || chr(10) || '听众问题：' || question || chr(10) || '来源章节：[' || k1 || ']、[' || k2 || ']' || chr(10) || '建议声音数：' || episodes || chr(10) FROM shares)
        SELECT project_id, md5(trim(string_agg(t, chr(10) ORDER BY position), ' ' || chr(10))) AS digest FROM l GROUP BY 1""",
)
def _(spark, d):
    m = modules(spark, d)
    b = P.episode_budget(m, projects(spark, d))
    return P.render_module_plan(P.apportion(m, b), b).select("project_id", F.md5("text").alias("digest"))


@query(
    "modules_merged", "P6",
    f"""WITH {MODULES}, {PROJECTS}, n AS (SELECT project_id, count(*) AS n FROM mods GROUP BY 1),
          g AS (SELECT m.*, (position * least(n, maximum) - 1) // n AS g FROM mods m JOIN n USING (project_id) JOIN projects USING (project_id)),
          ks AS (SELECT project_id, g, position, unnest([k1, k2]) AS k, unnest([1, 2]) AS o FROM g),
          kf AS (SELECT project_id, g, k, min((position, o)) AS first FROM ks GROUP BY ALL), qf AS (SELECT project_id, g, question, min(position) AS first FROM g GROUP BY ALL)
        SELECT g.project_id, g.g + 1 AS position, string_agg(title, ' / ' ORDER BY g.position) AS title, CAST(sum(suggested) AS BIGINT) AS suggested,
               (SELECT string_agg(question, '；' ORDER BY first) FROM qf WHERE qf.project_id = g.project_id AND qf.g = g.g) AS listener_question,
               (SELECT string_agg(k, ',' ORDER BY first) FROM kf WHERE kf.project_id = g.project_id AND kf.g = g.g) AS chapter_keys
        FROM g GROUP BY g.project_id, g.g""",
)
def _(spark, d):
    r = P.merge_to_max(modules(spark, d), projects(spark, d))
    return r.select("project_id", "position", "title", F.col("suggested").cast("bigint").alias("suggested"), "listener_question", F.array_join("chapter_keys", ",").alias("chapter_keys"))


@query(
    "modules_split", "P5",
    """WITH RECURSIVE ls AS (SELECT doc_id, lang, len(string_split(text, chr(10))) AS n, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
       st AS (SELECT doc_id, i, length(l) + 2 AS size, 1 AS part FROM ls WHERE i = 1
              UNION ALL SELECT x.doc_id, x.i, CASE WHEN s.size + length(x.l) + 2 <= 1200 THEN s.size + length(x.l) + 2 ELSE length(x.l) + 2 END,
                               CASE WHEN s.size + length(x.l) + 2 <= 1200 THEN s.part ELSE s.part + 1 END FROM st s JOIN ls x ON x.doc_id = s.doc_id AND x.i = s.i + 1),
       g AS (SELECT doc_id, part, count(*) AS c, string_agg(i, ',' ORDER BY i) AS keys FROM st GROUP BY ALL),
       t AS (SELECT doc_id, max(part) AS parts FROM st GROUP BY 1)
       SELECT g.doc_id, CAST(part AS BIGINT) AS part, lang || CASE WHEN parts > 1 THEN '（第 ' || part || '/' || parts || ' 部分）' ELSE '' END AS title, keys,
              CAST(greatest(1, round_even(5 * c / any_n, 0)) AS BIGINT) AS suggested, o AS oversized
       FROM g JOIN t USING (doc_id) JOIN (SELECT doc_id, any_value(lang) AS lang, any_value(n) AS any_n, bool_or(length(l) > 1200) AS o FROM ls GROUP BY 1) USING (doc_id)""",
)
def _(spark, d):
    lines = F.split("text", "\n")
    m = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("title"), F.transform(F.sequence(F.lit(1), F.size(lines)), lambda i: i.cast("string")).alias("chapter_keys"),
        F.transform(lines, lambda l: F.length(l)).alias("sizes"), F.lit(5).alias("suggested"),
    )
    r = P.split_oversized(m, 1200)
    return r.select("doc_id", F.col("part").cast("bigint").alias("part"), "title", F.array_join("chapter_keys", ",").alias("keys"), F.col("suggested").cast("bigint").alias("suggested"), "oversized")


def composed_plan(spark, d) -> DataFrame:
    """A module plan text per order, a block per line."""
    m = modules(spark, d)
    block = F.concat(
        F.lit("## 模块"), F.col("position").cast("string"), F.lit("："), "title",
        F.when(F.col("position") % 2 == 0, F.concat(F.lit("\n听众问题："), "listener_question")).otherwise(F.lit("")),
        F.lit("\n来源章节：["), F.array_join("chapter_keys", "]、["), F.lit("]"),
        F.when(F.col("suggested") > 0, F.concat(F.lit("\n建议声音数："), (F.col("suggested") * 2).cast("string"))).otherwise(F.lit("")),
    )
    packed = m.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("position", block.alias("b"), "chapter_keys"))).alias("r"))
    keys = F.array_distinct(F.flatten(F.transform("r", lambda r: r["chapter_keys"])))
    extra = F.when(F.col("project_id") % 5 == 0, F.array(F.lit("CHAPTER_999"))).otherwise(F.array().cast("array<string>"))
    return packed.select(
        "project_id", F.array_join(F.transform("r", lambda r: r["b"]), "\n\n").alias("markdown"),
        F.when(F.col("project_id") % 7 == 0, F.slice(keys, 2, 99)).otherwise(F.concat(keys, extra)).alias("allowed"),
    )


@query(
    "module_plans_parsed", "P3 P4 X1",
    f"""WITH {MODULES}, ks AS (SELECT project_id, position, unnest([k1, k2]) AS k, unnest([1, 2]) AS o FROM mods),
          fk AS (SELECT project_id, arg_min(k, (position, o)) AS k0, min(position) AS p0 FROM ks GROUP BY 1),
          bad AS (SELECT project_id, arg_min(CASE WHEN k1 = k0 OR k2 = k0 THEN k0 END, position) AS k FROM mods JOIN fk USING (project_id) WHERE k1 = k0 OR k2 = k0 GROUP BY 1)
        SELECT m.project_id, position, 'MODULE_' || lpad(CAST(position AS VARCHAR), 3, '0') AS module_key, title, CASE WHEN position % 2 = 0 THEN question ELSE title END AS listener_question,
               CASE WHEN k1 = k2 THEN k1 ELSE k1 || ',' || k2 END AS chapter_keys, CASE WHEN suggested = 0 THEN 4 ELSE greatest(1, least(8, suggested * 2)) END AS suggested,
               CASE WHEN m.project_id % 7 = 0 THEN '模块计划引用未知章节：' || bad.k WHEN m.project_id % 5 = 0 THEN '模块计划遗漏章节：CHAPTER_999' END AS error
        FROM mods m JOIN bad USING (project_id)""",
)
def _(spark, d):
    # Two columns are taken from the parsed plan: it is parsed once.
    r = computed_once(composed_plan(spark, d), p=P.parse_module_plan(F.col("markdown"), F.col("allowed")))
    return unnest(r, ["project_id", F.col("p.error").alias("error")], "p.modules", "m").select(
        "project_id", F.col("m.position").cast("bigint").alias("position"), "m.module_key", "m.title", "m.listener_question",
        F.array_join("m.chapter_keys", ",").alias("chapter_keys"), F.col("m.suggested").cast("bigint").alias("suggested"), "error",
    )


# Catalog ------------------------------------------------------------------------


def catalog(spark, d) -> DataFrame:
    """Chapters: orders of a customer; subtopics and viewpoints from their columns."""
    o = table(spark, d, "orders")
    roots = o.select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("section_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("position"))
    views = F.array(F.struct(F.concat(F.col("o_orderstatus"), F.lit(" content_ab12 point，")).alias("text")), F.struct(F.concat("o_orderstatus", F.lit("  point")).alias("text")))
    sub = F.struct(F.concat(F.lit(" "), "o_orderpriority").alias("title"), views.alias("viewpoints"))
    valid = F.struct(F.concat(F.lit("knowledge_1 "), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.lit(""))).alias("chapter_theme"), F.array(sub, sub).alias("subtopics"))
    analyses = o.filter(F.col("o_orderkey") % 10 != 0).select(F.col("o_orderkey").alias("section_id"), valid.alias("valid"))
    return P.chapter_catalog(roots, analyses)


CATALOG = f"""entries AS (
  SELECT o_custkey AS book_id, o_orderkey AS position, 'CHAPTER_' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), 3, '0') AS chapter_key, o_orderpriority AS title,
         CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 10 <> 0 THEN o_orderstatus ELSE '{P.DEFAULT_THEME}' END AS theme, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS subs,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus || ' point' END AS points, o_orderkey % 10 = 0 AS missing FROM orders)"""


@query("chapter_catalog", "P1", f"WITH {CATALOG} SELECT book_id, chapter_key, title, theme, subs, points, missing FROM entries")
def _(spark, d):
    return catalog(spark, d).select("book_id", "chapter_key", "title", "theme", F.array_join("subtopic_titles", ";").alias("subs"), F.array_join("concise_points", ";").alias("points"), "missing")


@query(
    "catalog_rendered", "P2",
    f"""WITH {CATALOG} SELECT book_id, md5(string_agg('[' || chapter_key || '] ' || title || chr(10) || '章节主题：' || theme || coalesce(chr(10) || '子主题：' || subs, '') || coalesce(chr(10) || '主要观点：' || points, ''), chr(10) || chr(10) ORDER BY position)) AS digest
        FROM entries GROUP BY ALL""",
)
def _(spark, d):
    return P.render_catalog(catalog(spark, d), points=True).select("book_id", F.md5("text").alias("digest"))


@query(
    "module_sources", "P2",
    f"""WITH {CATALOG}, m AS (SELECT DISTINCT c_custkey AS book_id, 'CHAPTER_' || lpad(CAST(unnest([1, c_nationkey % 5 + 1, 3]) AS VARCHAR), 3, '0') AS chapter_key FROM customer)
        SELECT book_id, md5(string_agg('[' || chapter_key || '] ' || title || chr(10) || '章节主题：' || theme || coalesce(chr(10) || '子主题：' || subs, '') || coalesce(chr(10) || '主要观点：' || points, ''), chr(10) || chr(10) ORDER BY position)) AS digest
        FROM m JOIN entries USING (book_id, chapter_key) GROUP BY 1""",
)
def _(spark, d):
    keys = F.array(chapter_key(F.lit(1)), chapter_key(F.col("c_nationkey") % 5 + 1), chapter_key(F.lit(3)))
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("book_id"), F.lit("m").alias("module_id"), keys.alias("chapter_keys"))
    return P.module_source(m, catalog(spark, d)).select("book_id", F.md5("text").alias("digest"))


# Outlines -----------------------------------------------------------------------


def outline(spark, d) -> DataFrame:
    """A two-episode outline per order line, with planned defects by line number."""
    n = F.col("l_linenumber")
    key, other = chapter_key(F.col("l_partkey") % 20), chapter_key(F.col("l_suppkey") % 20)

    def episode(k: int, kind: Column, keys: Column) -> Column:
        return F.concat(
            F.lit(f"## 第{k}集：t"), F.col("l_partkey").cast("string"), F.lit("\n**听众钩子**：h\n核心主题：c\n续"), F.lit("\n核心要点：\n1. x；\n2. y。\n"),
            F.when((n == 2) & F.lit(k == 2), F.lit("")).otherwise(F.concat(F.lit("内容类型："), kind, F.lit("\n"))), F.lit("来源章节：["), keys, F.lit("]\n模块标识：Z\n忽略"),
        )

    md = F.concat(
        episode(1, F.when(n == 3, F.lit("别的")).otherwise(F.lit("深度解读类")), key), F.lit("\n\n"), episode(2, F.lit("过渡"), F.when(n == 4, F.lit("CHAPTER_777")).otherwise(other)),
        F.when(n == 5, F.lit(" content_ab ")).otherwise(F.lit("")),
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.round("l_extendedprice").cast("bigint").alias("price"),
        F.concat_ws("-", "l_orderkey", n, "l_partkey", "l_suppkey").alias("run_id"),
        F.lit("MODULE_001").alias("module_key"), F.lit(1).cast("bigint").alias("position"), F.array(key, other).alias("chapter_keys"),
        F.array(*[F.lit(f"CHAPTER_{k:03d}") for k in range(20)]).alias("catalog_keys"), F.when(n == 6, F.lit(3)).otherwise(F.lit(2)).alias("suggested"),
        F.when(n == 7, F.lit(" ")).otherwise(md).alias("markdown"),
    )


@query(
    "outlines_validated", "P10",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 4 THEN '模块第 2 集引用未知章节：CHAPTER_777' WHEN 5 THEN '专辑大纲不得包含知识资产 ID 或段落原文索引'
         WHEN 6 THEN '本模块分配 3 集，模型实际生成 2 集' WHEN 7 THEN '模块没有生成专辑大纲' END AS error FROM lineitem""",
)
def _(spark, d):
    o = outline(spark, d)
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", P.validate_outline(F.col("markdown"), F.col("chapter_keys"), F.col("suggested")).alias("error"))


@query(
    "outlines_parsed", "P11 T20",
    """WITH b AS (SELECT *, 'CHAPTER_' || lpad(CAST(l_partkey % 20 AS VARCHAR), 3, '0') AS k1, 'CHAPTER_' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 3, '0') AS k2,
         CASE l_linenumber WHEN 2 THEN 'MODULE_001 第 2 集缺少字段：内容类型' WHEN 3 THEN '未知内容类型：别的' WHEN 4 THEN 'MODULE_001 第 2 集引用未知章节：CHAPTER_777' WHEN 5 THEN 'MODULE_001 第 2 集不得包含知识资产 ID或段落原文索引'
           WHEN 6 THEN 'MODULE_001 应有 3 集，实际解析 2 集' END AS error,
         '听众钩子：h' || chr(10) || '核心主题：c' || chr(10) || '续' || chr(10) || '核心要点：' || chr(10) || '1. x；' || chr(10) || '2. y。' AS points FROM lineitem WHERE l_linenumber <> 7)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(1 AS BIGINT) AS no, 't' || l_partkey AS title, points, CASE WHEN l_linenumber <> 3 THEN '解读' END AS content_type, k1 AS chapters, error FROM b
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, 't' || l_partkey, points, CASE WHEN l_linenumber <> 2 THEN '过渡' END, CASE WHEN l_linenumber = 4 THEN 'CHAPTER_777' ELSE k2 END, error FROM b""",
)
def _(spark, d):
    r = P.parse_outlines(outline(spark, d))
    return unnest(r, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error"], "episodes", "e", "k").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("k") + 1).cast("bigint").alias("no"), "e.title", F.col("e.main_points").alias("points"),
        "e.content_type", F.array_join("e.chapter_keys", ",").alias("chapters"), "error",
    )


@query(
    "structured_checked", "P12 X7",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN '专辑第 2 条字段不完整' WHEN 2 THEN '专辑第 1 条未知内容类型：别的' WHEN 3 THEN '专辑第 2 条引用未知章节：CHAPTER_777'
         WHEN 4 THEN '叙事类书籍不能生成过渡声音' WHEN 5 THEN '专辑第 2 条缺少有效模块标识' WHEN 6 THEN '专辑第 1 条主要内容缺少“核心主题：”' END AS error,
         CASE WHEN l_linenumber = 7 THEN 't' || l_partkey || '=CHAPTER_001=[CHAPTER_001] A' || l_returnflag || '=s' || l_suppkey || ';u=CHAPTER_001,CHAPTER_002=[CHAPTER_001] A' || l_returnflag || '、[CHAPTER_002] B' || l_linestatus || '=s' || l_suppkey || ',s2' END AS episodes FROM lineitem""",
)
def _(spark, d):
    n = F.col("l_linenumber")
    full = "听众钩子：a\n核心主题：b\n核心要点：c"

    def raw(title: Column, points: Column, kind: Column, keys: Column, module: Column) -> Column:
        return F.struct(title.alias("title"), points.alias("main_points"), kind.alias("content_type"), keys.alias("chapter_keys"), module.alias("module_key"))

    a = raw(
        F.concat(F.lit(" t"), F.col("l_partkey").cast("string")), F.when(n == 6, F.lit("听众钩子：a\n核心要点：c")).otherwise(F.lit(full)),
        F.when(n == 2, F.lit("别的")).otherwise(F.lit("解读")), F.array(F.lit("[CHAPTER_001]"), F.lit("CHAPTER_001")), F.lit("M1"),
    )
    b = raw(
        F.when(n == 1, F.lit(" ")).otherwise(F.lit("u")), F.lit(full), F.when(n == 4, F.lit("过渡")).otherwise(F.lit("解读")),
        F.when(n == 3, F.array(F.lit("CHAPTER_777"))).otherwise(F.array(F.lit("CHAPTER_001"), F.lit("CHAPTER_002"))), F.when(n == 5, F.lit("M9")).otherwise(F.lit("M1")),
    )
    allowed = F.array(F.lit("CHAPTER_001"), F.lit("CHAPTER_002"))
    entry = lambda title, section: F.struct(title.alias("title"), section.alias("section_id"))
    catalog = F.create_map(
        F.lit("CHAPTER_001"), entry(F.concat(F.lit("A"), "l_returnflag"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))),
        F.lit("CHAPTER_002"), entry(F.concat(F.lit("B"), "l_linestatus"), F.lit("s2")),
    )
    s = P.validate_structured(F.array(a, b), catalog, F.create_map(F.lit("M1"), allowed), n == 4)
    r = computed_once(table(spark, d, "lineitem"), s=s).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s")
    shown = F.transform("s.episodes", lambda e: F.concat_ws("=", e["title"], F.array_join(e["chapter_keys"], ","), e["section_identifier"], F.array_join(e["source_section_ids"], ",")))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s.error", F.array_join(shown, ";").alias("episodes"))


@query(
    "count_notices", "P13",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN '目标 ' || d || ' 集，允许 ' || (d - 1) || ' 至 ' || (d + 1) || ' 集，本次生成 ' || a || ' 集。'
              WHEN a <> d THEN '期望 ' || d || ' 集，模型根据内容结构生成 ' || a || ' 集。' ELSE '' END AS notice,
              CASE WHEN o_orderkey % 3 = 0 AND a <> d THEN '本次规划总数为 ' || d || ' 集，结构化结果却有 ' || a || ' 集' WHEN o_orderkey % 2 = 0 AND a NOT BETWEEN d - 1 AND d + 1 THEN '专辑实际 ' || a || ' 集，超出允许范围 ' || (d - 1) || ' 至 ' || (d + 1) || ' 集' END AS error
       FROM (SELECT o_orderkey, o_custkey % 9 + 1 AS d, o_orderkey % 11 + 1 AS a FROM orders)""",
)
def _(spark, d):
    k, desired, actual = F.col("o_orderkey"), F.col("o_custkey") % 9 + 1, F.col("o_orderkey") % 11 + 1
    low, high = F.when(k % 2 == 0, desired - 1), F.when(k % 2 == 0, desired + 1)
    return table(spark, d, "orders").select(
        "o_orderkey", P.count_notice(F.when(k % 5 != 0, desired), low, high, actual).alias("notice"), P.total_error(actual, F.when(k % 3 == 0, desired), low, high).alias("error")
    )


@query("module_lines_tagged", "P14", "SELECT doc_id, md5('## 第1集：' || lang || chr(10) || '模块标识：' || source || chr(10) || text || chr(10) || '## 2集: x模块标识：' || source || chr(10)) AS digest FROM documents")
def _(spark, d):
    md = F.concat(F.lit("## 第1集："), "lang", F.lit("\n"), "text", F.lit("\n## 2集: x"))
    return table(spark, d, "documents").select("doc_id", F.md5(P.tag_module_lines(md, F.col("source"))).alias("digest"))


@query(
    "card_outlines_checked", "P15 X5",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber WHEN 1 THEN '同一知识资产被拆分到多条普通声音' WHEN 2 THEN '专辑第 2 条主要内容结构顺序无效' WHEN 3 THEN '专辑第 2 条核心要点必须为 2 至 4 条' WHEN 4 THEN '专辑第 2 条引用了不存在的知识资产'
         WHEN 5 THEN '专辑第 2 条过渡声音至少需要两个知识资产' END AS error, 'L 原文索引：' || l_partkey || '、' || l_suppkey AS identifier FROM lineitem""",
)
def _(spark, d):
    n = F.col("l_linenumber")
    good = "听众钩子：a\n核心主题：b\n核心要点：\n1. x\n2. y"
    card = F.concat(F.lit("c"), F.col("l_partkey").cast("string"))

    def ep(points: Column, kind: Column, ids: Column) -> Column:
        return F.struct(F.lit("t").alias("title"), points.alias("main_points"), F.lit("L 原文索引：old").alias("section_identifier"), kind.alias("content_type"), ids.alias("knowledge_item_ids"))

    first = ep(F.lit(good), F.lit("解读类"), F.array(card))
    points = F.when(n == 2, F.lit("核心主题：b\n听众钩子：a\n核心要点：\n1. x\n2. y")).when(n == 3, F.lit("听众钩子：a\n核心主题：b\n核心要点：\n1. x")).otherwise(F.lit(good))
    kind = F.when(n == 5, F.lit("过渡")).otherwise(F.lit("解读"))
    ids = F.when(n == 1, F.array(card)).when(n == 4, F.array(F.lit("zz"))).otherwise(F.array(F.lit("other")))
    err = P.outline_v1_error(F.array(first, ep(points, kind, ids)), F.array(card, F.lit("other")), F.lit(False))
    ident = P.rebuilt_identifier(F.lit("L 原文索引：old"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", err.alias("error"), ident.alias("identifier"))


@query(
    "episodes_seeded", "P16 W10 W11",
    f"""WITH {V.TREE}, r AS (SELECT book_id, title, section_id, row_number() OVER (PARTITION BY book_id ORDER BY position) AS rn FROM tree WHERE level = 4)
        SELECT c_custkey AS project_id, rn AS position, title, CASE WHEN rn > 1 AND rn % 4 = 0 THEN '过渡' ELSE '解读' END AS content_type, '章节：' || title AS section_identifier, section_id AS source_section_id
        FROM customer JOIN r ON book_id = 'r' || (c_nationkey % 5) WHERE rn <= 12""",
)
def _(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.concat(F.lit("r"), (F.col("c_nationkey") % 5).cast("string")).alias("book_id"))
    return P.seed_episodes(p, V.tree(spark, d)).select("project_id", F.col("position").cast("bigint").alias("position"), "title", "content_type", "section_identifier", "source_section_id")


@query(
    "confirm_violations", "P17 J13 J23 F3",
    f"""WITH {V.CARDS}, {V.EPISODE_CARDS}, p AS (SELECT c_custkey AS project_id, c_nationkey % 5 AS b1, (c_nationkey + 1) % 5 AS b2 FROM customer),
          e AS (SELECT o_orderkey AS episode_id, o_custkey AS project_id, o_orderkey AS position, o_orderkey % 17 = 0 AS blank, o_orderkey % 13 = 0 AS none, o_orderkey % 120 AS sec FROM orders),
          s AS (SELECT s_suppkey AS section_id, s_nationkey % 5 AS book_id FROM supplier), ea AS (SELECT *, '第 ' || position || ' 条声音' AS lbl FROM e JOIN p USING (project_id))
        SELECT p.project_id, CAST(0 AS BIGINT) AS position, '专辑大纲至少需要一条声音' AS reason FROM p WHERE project_id NOT IN (SELECT project_id FROM e)
        UNION ALL SELECT project_id, position, lbl || '缺少内容框架' FROM ea WHERE blank
        UNION ALL SELECT project_id, position, lbl || '没有关联原文块' FROM ea WHERE none
        UNION ALL SELECT project_id, position, lbl || '包含无效原文块' FROM ea LEFT JOIN s ON section_id = sec WHERE NOT none AND (book_id IS NULL OR book_id NOT IN (b1, b2))
        UNION ALL SELECT DISTINCT a.project_id, a.position, lbl || '包含无效或已过期知识资产' FROM episode_cards ec JOIN ea a USING (episode_id) LEFT JOIN cards c USING (card_id)
          WHERE c.card_id IS NULL OR status <> 'active' OR source_scheme <> 'paragraph_evidence_v1' OR c.book_id NOT IN (b1, b2)""",
)
def _(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.array((F.col("c_nationkey") % 5).cast("int"), ((F.col("c_nationkey") + 1) % 5).cast("int")).alias("book_ids"))
    k = F.col("o_orderkey")
    e = table(spark, d, "orders").select(
        k.alias("episode_id"), F.col("o_custkey").alias("project_id"), k.alias("position"), F.when(k % 17 == 0, F.lit(" ")).otherwise(F.lit("f")).alias("content_framework"),
        F.when(k % 13 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 120)).alias("source_section_ids"),
    )
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("section_id"), (F.col("s_nationkey") % 5).cast("int").alias("book_id"))
    return P.confirm_violations(p, e, s, V.episode_cards(spark, d), V.cards(spark, d))


@query(
    "modules_to_retry", "P20",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'failed' WHEN l_returnflag = 'R' OR l_linenumber IN (4, 5, 6, 7) THEN 'run' ELSE 'keep' END AS action,
              CASE WHEN l_returnflag = 'A' THEN '模块尚未成功' END AS carried_error FROM lineitem""",
)
def _(spark, d):
    # Line keys repeat on the smallest tables: flag and price make runs unique.
    o = outline(spark, d).withColumn("run_id", F.concat_ws("-", "run_id", "l_returnflag", "price"))
    stored = o.filter("l_returnflag <> 'R'").select(
        "run_id", "module_key", F.when(F.col("l_returnflag") == "A", "failed").otherwise("succeeded").alias("status"), F.col("markdown").alias("content"), F.lit("").alias("error_message")
    )
    r = P.module_retry_set(o.drop("markdown"), stored, retry_key="MODULE_999")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "action", "carried_error")


@query(
    "structure_recovered", "P21 P11",
    """WITH r AS (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_returnflag || '-' || CAST(round(l_extendedprice) AS BIGINT) AS run_id,
            CASE l_linenumber WHEN 2 THEN 'MODULE_001 第 2 集缺少字段：内容类型' WHEN 3 THEN '未知内容类型：别的' WHEN 4 THEN 'MODULE_001 第 2 集引用未知章节：CHAPTER_777' WHEN 5 THEN 'MODULE_001 第 2 集不得包含知识资产 ID或段落原文索引'
              WHEN 6 THEN 'MODULE_001 应有 3 集，实际解析 2 集' WHEN 7 THEN 'MODULE_001 缺少已生成的模块大纲' END AS error FROM lineitem)
       SELECT run_id, error, CAST(k AS BIGINT) AS position, 't' || l_partkey AS title, CASE WHEN k = 2 AND l_linenumber <> 2 THEN '过渡' WHEN k = 1 AND l_linenumber <> 3 THEN '解读' END AS content_type,
              left(sha1('episode' || chr(31) || run_id || chr(31) || k), 16) AS episode_id
       FROM r, (SELECT unnest([1, 2]) AS k) WHERE l_linenumber <> 7
       UNION ALL SELECT run_id, error, NULL, NULL, NULL, NULL FROM r WHERE l_linenumber = 7""",
)
def _(spark, d):
    # Line keys repeat on the smallest tables: flag and price make runs unique.
    o = outline(spark, d).withColumn("run_id", F.concat_ws("-", "run_id", "l_returnflag", "price"))
    r = P.recover_structure(o.drop("markdown"), o.select("run_id", "module_key", F.col("markdown").alias("content")))
    return r.select("run_id", "error", F.col("position").cast("bigint").alias("position"), "title", "content_type", "episode_id")
