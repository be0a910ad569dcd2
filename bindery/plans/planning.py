"""Album planning: catalog, modules, budgets and outlines, many projects per job.

Parsing a model's Markdown happens inside the row that holds it. Arithmetic
across the modules of a project uses aggregates and `ordered.running`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import packing, text as X
from ..ordered import assemble, position_block, running
from ..rows import computed_once, unnest
from ..session import cut_lineage

# Defaults and labels of the planning formats.
DEFAULT_THEME = "本章主题待模型结合子主题理解。"
DEFAULT_EPISODES, MAX_EPISODES = 4, 8
TOLERANCE = 2
MODULE_HEADING = r"(?mUd)^##\s+(?:模块[^：:]*[：:]\s*)?(.+)$"
MODULE_QUESTION = r"(?mUd)^(?:听众问题|要解决的问题)[：:]\s*(.+)$"
MODULE_COUNT = r"(?U)建议(?:声音|集)数[：:]\s*(\d+)"
# Blocks are read line by line: only where a line begins can the next one begin.
_EPISODE_OPEN = r"##\s+第?\s*\d+\s*集\s*[：:]"
EPISODE_WHOLE = rf"(?mUd)^{_EPISODE_OPEN}[^\n]*+(?:\n(?!{_EPISODE_OPEN})[^\n]*+)*+"
EPISODE_HEADING = r"(?mUd)\A##\s+第?\s*\d+\s*集\s*[：:]\s*(.+?)\s*$"
EPISODE_BLOCK = r"(?mUd)^##\s+第?\d+\s*集"
FIELD_LABELS = "听众钩子|核心主题|核心要点|内容类型|来源章节|模块标识"
_LABEL_OPEN, _LABEL_CLOSE = r"^[\s\u3000]*(?:\*\*)?", r"(?:\*\*)?[\s\u3000]*[：:]"
REQUIRED_FIELDS = ("听众钩子", "核心主题", "核心要点", "内容类型", "来源章节")
MARKERS = ("听众钩子：", "核心主题：", "核心要点：")
NO_ID_SHAPES = r"(?<![\p{L}\p{N}_])(?:knowledge|content)_[0-9a-f]+(?![\p{L}\p{N}_])"
KEY_POINT = r"(?m)(?:^|[\n；;])\s*(?:\d+\s*[.．、)）]|[-*])\s*\S+"


def has_id_shape(c: Column) -> Column:
    """Whether a text cites an id; the words alone, which are rarely there, are looked for first."""
    return (F.contains(c, F.lit("knowledge_")) | F.contains(c, F.lit("content_"))) & F.regexp_like(c, F.lit(NO_ID_SHAPES))


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# Catalog ----------------------------------------------------------------------


def chapter_catalog(roots: DataFrame, analyses: DataFrame, max_points: int | None = 12) -> DataFrame:
    """Planning entries of confirmed roots.

    roots(book_id, section_id, title, position); analyses(section_id, valid)
    holds the newest succeeded analysis per root. A root without one comes out
    with missing = true. `max_points` main points are listed; None lists all.
    """
    numbered = running(roots, ["book_id"], ["position", "section_id"], position_block(F.col("position")), number="_no")
    joined = numbered.join(analyses.select("section_id", "valid"), "section_id", "left")
    subs = F.col("valid.subtopics")
    titles = F.filter(F.transform(subs, lambda s: X.strip(s["title"])), lambda t: t != "")
    points = F.filter(
        F.flatten(F.transform(subs, lambda s: F.transform(s["viewpoints"], lambda v: X.clean_planning_text(v["text"])))),
        lambda t: t != "",
    )
    theme = X.clean_planning_text(F.col("valid.chapter_theme"))
    return joined.select(
        "book_id",
        X.ordinal_key("CHAPTER", F.col("_no")).alias("chapter_key"),
        "section_id",
        X.strip(F.col("title")).alias("title"),
        F.coalesce(F.nullif(theme, F.lit("")), F.lit(DEFAULT_THEME)).alias("theme"),
        F.array_distinct(titles).alias("subtopic_titles"),
        F.array_distinct(points if max_points is None else F.slice(points, 1, max_points)).alias("concise_points"),
        "position",
        F.col("valid").isNull().alias("missing"),
    )


def entry_text(points: bool) -> Column:
    """One chapter block; with its main points in the detailed form."""
    def listed(label: str, name: str) -> Column:
        return F.when(F.coalesce(F.size(name), F.lit(0)) > 0, _cat(label, F.array_join(name, "；")))

    lines = [
        _cat("[", F.col("chapter_key"), "] ", F.col("title")),
        _cat("章节主题：", F.col("theme")),
        listed("子主题：", "subtopic_titles"),
    ]
    if points:
        lines.append(listed("主要观点：", "concise_points"))
    return F.concat_ws("\n", *lines)


def render_catalog(entries: DataFrame, *, points: bool = False) -> DataFrame:
    """Catalog text, a row per book."""
    return assemble(
        entries.withColumn("_t", entry_text(points)), ["book_id"], ["position", "chapter_key"], F.col("_t"), separator="\n\n"
    )


def module_source(modules: DataFrame, entries: DataFrame) -> DataFrame:
    """Detailed chapter blocks of each module, in chapter order.

    modules(book_id, module_id, chapter_keys): the keys of one row.
    """
    flat = modules.select("book_id", "module_id", F.explode(F.array_distinct("chapter_keys")).alias("chapter_key"))
    hit = flat.join(entries.withColumn("_t", entry_text(True)).select("book_id", "chapter_key", "position", "_t"), ["book_id", "chapter_key"])
    return assemble(hit, ["book_id", "module_id"], ["position"], F.col("_t"), separator="\n\n")


# Module plan ------------------------------------------------------------------


def chapter_keys_in(text: Column) -> Column:
    return X.extract_ids(text, X.CHAPTER_KEY)


def parse_module_plan(markdown: Column, allowed: Column) -> Column:
    """Struct(modules, error). `allowed` holds the chapter keys of the book."""
    blocks = F.filter(F.split(X.strip(markdown), r"(?mUd)(?=^##\s+)"), lambda b: X.strip(b) != "")

    def module(b: Column) -> Column:
        read = F.struct(
            X.nonblank(F.regexp_extract(b, MODULE_HEADING, 1)).alias("title"), X.nonblank(F.regexp_extract(b, MODULE_QUESTION, 1)).alias("question"),
            chapter_keys_in(b).alias("keys"), F.regexp_extract(b, MODULE_COUNT, 1).alias("count"),
        )
        return X.let(
            read,
            lambda m: F.struct(
                m["title"].alias("title"),
                F.coalesce(m["question"], m["title"]).alias("listener_question"),
                m["keys"].alias("chapter_keys"),
                F.greatest(
                    F.lit(1), F.least(F.lit(MAX_EPISODES), F.coalesce(F.nullif(m["count"], F.lit("")).cast("int"), F.lit(DEFAULT_EPISODES)))
                ).alias("suggested"),
            ),
        )

    found = F.filter(F.transform(blocks, module), lambda m: m["title"].isNotNull() & (F.size(m["chapter_keys"]) > 0))

    def judge(ms: Column) -> Column:
        covered = F.flatten(F.transform(ms, lambda m: m["chapter_keys"]))
        strange = F.get(
            F.filter(F.transform(ms, lambda m: F.array_except(m["chapter_keys"], allowed)), lambda u: F.size(u) > 0), F.lit(0)
        )
        missing = F.array_sort(F.array_except(allowed, covered))
        error = (
            F.when(strange.isNotNull(), _cat("模块计划引用未知章节：", F.array_join(strange, "、")))
            .when(F.size(ms) == 0, F.lit("模块计划没有可识别的模块或章节标识"))
            .when(F.size(missing) > 0, _cat("模块计划遗漏章节：", F.array_join(missing, "、")))
        )
        numbered = F.transform(
            ms,
            lambda m, k: F.struct(
                X.ordinal_key("MODULE", k + 1).alias("module_key"), (k + 1).alias("position"),
                m["title"].alias("title"), m["listener_question"].alias("listener_question"),
                m["chapter_keys"].alias("chapter_keys"), m["suggested"].alias("suggested"),
            ),
        )
        return F.struct(numbered.alias("modules"), error.alias("error"))

    return X.let(found, judge)


def split_oversized(modules: DataFrame, maximum: int = packing.MODULE_CHARS) -> DataFrame:
    """Split modules whose chapters exceed `maximum` characters together.

    modules(..., title, chapter_keys, sizes, suggested): `sizes` is aligned
    with `chapter_keys`. Shares are rounded half to even.
    """
    cost = F.transform("sizes", lambda s: s + 2)
    numbered = modules.withColumn("_no", packing.pack_numbers(cost, maximum, 0))
    oversized = F.exists("sizes", lambda s: s > maximum)
    groups = F.transform(
        F.sequence(F.lit(1), F.greatest(F.array_max("_no"), F.lit(1))),
        lambda g: F.struct(
            g.alias("part"),
            F.transform(
                F.filter(F.arrays_zip(F.col("chapter_keys").alias("k"), F.col("_no").alias("n")), lambda z: z["n"] == g),
                lambda z: z["k"],
            ).alias("keys"),
        ),
    )
    keep = [c for c in modules.columns if c not in ("title", "chapter_keys", "sizes", "suggested")]
    flat = unnest(
        numbered.withColumn("oversized", oversized),
        [*keep, "title", "suggested", "oversized", F.array_max("_no").alias("parts"), F.size("chapter_keys").alias("_all")],
        groups,
        "g",
    )
    suffix = F.when(F.col("parts") > 1, F.format_string("（第 %d/%d 部分）", F.col("g.part"), F.col("parts"))).otherwise(F.lit(""))
    share = F.bround(F.col("suggested") * F.size("g.keys") / F.greatest(F.lit(1), F.col("_all"))).cast("int")
    return flat.select(
        *keep,
        F.concat("title", suffix).alias("title"),
        F.col("g.part").alias("part"),
        "parts",
        F.col("g.keys").alias("chapter_keys"),
        F.greatest(F.lit(1), share).alias("suggested"),
        "oversized",
    )


def merge_to_max(modules: DataFrame, projects: DataFrame) -> DataFrame:
    """Merge ordered modules of a project down to its allowed maximum.

    modules(project_id, position, title, listener_question, chapter_keys,
    suggested), projects(project_id, maximum). Projects within their maximum
    pass through. The groups are the output rows themselves.
    """
    counts = modules.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    limits = counts.join(projects.select("project_id", "maximum"), "project_id").withColumn("_m", F.least("_n", "maximum"))
    order = running(modules, ["project_id"], ["position"], position_block(F.col("position")), number="_i")
    # With i counted from 1: group = floor((i * m - 1) / n).
    placed = order.join(limits, "project_id").withColumn("_g", F.floor((F.col("_i") * F.col("_m") - 1) / F.col("_n")).cast("bigint"))
    packed = placed.groupBy("project_id", "_g").agg(
        F.sort_array(F.collect_list(F.struct("_i", "title", "listener_question", "chapter_keys"))).alias("_r"),
        F.sum("suggested").alias("suggested"),
    )
    pick = lambda name: F.transform("_r", lambda r: r[name])
    return packed.select(
        "project_id",
        (F.col("_g") + 1).alias("position"),
        X.ordinal_key("MODULE", F.col("_g") + 1).alias("module_key"),
        F.array_join(pick("title"), " / ").alias("title"),
        F.array_join(F.array_distinct(pick("listener_question")), "；").alias("listener_question"),
        F.array_distinct(F.flatten(pick("chapter_keys"))).alias("chapter_keys"),
        "suggested",
    )


def episode_budget(modules: DataFrame, projects: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Minimum, maximum and selected episode count per project; error when infeasible."""
    need = modules.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("modules"), F.sum(F.greatest(F.lit(1), F.col("suggested"))).alias("suggested_total")
    )
    low = F.greatest(F.lit(1), F.col("desired") - tolerance)
    high = F.col("desired") + tolerance
    selected = F.greatest(F.col("modules"), F.greatest(low, F.least(high, F.col("suggested_total"))))
    return need.join(projects.select("project_id", "desired"), "project_id").select(
        "project_id",
        F.col("desired").cast("bigint").alias("desired"),
        low.cast("bigint").alias("minimum"),
        high.cast("bigint").alias("maximum"),
        "modules",
        "suggested_total",
        selected.cast("bigint").alias("selected"),
        F.when(
            selected > high,
            F.format_string("至少需要 %d 集才能覆盖全部知识模块，已超过目标允许上限 %d 集", F.col("modules"), high.cast("bigint")),
        ).alias("error"),
    )


def apportion(modules: DataFrame, budgets: DataFrame) -> DataFrame:
    """Episodes per module by largest remainder: one each, then shares of the rest.

    modules(project_id, position, suggested) with unique positions;
    budgets(project_id, selected, ...). When the suggestions already sum to
    the budget they stay as they are.

    The order by (remainder, position) is counted in two steps, remainder
    levels first and positions within a level second, so neither a large
    project nor many equal remainders end up in one task.
    """
    totals = modules.groupBy("project_id").agg(
        F.sum(F.greatest(F.lit(1), F.col("suggested"))).alias("_w"), F.count(F.lit(1)).alias("_k")
    )
    base = modules.join(totals, "project_id").join(budgets.select("project_id", "selected"), "project_id")
    weight = F.greatest(F.lit(1), F.col("suggested")).cast("bigint")
    rest = F.col("selected") - F.col("_k")
    shared = base.withColumn("_floor", F.expr("(selected - _k) * cast(greatest(1, suggested) as bigint) div _w")).withColumn(
        "_neg", -((rest * weight) % F.col("_w"))
    )
    levels = shared.groupBy("project_id", "_neg").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("_floor").alias("_f")
    )
    spent = levels.groupBy("project_id").agg(F.sum("_f").alias("_spent"))
    ranked_levels = running(levels.drop("_f"), ["project_id"], ["_neg"], position_block(F.col("_neg")), sums={"_upto": F.col("_c")})
    within = running(shared, ["project_id", "_neg"], ["position"], position_block(F.col("position")), number="_r")
    joined = within.join(
        ranked_levels.select("project_id", "_neg", (F.col("_upto") - F.col("_c")).alias("_above")), ["project_id", "_neg"]
    ).join(spent, "project_id")
    extras = rest - F.col("_spent")
    bonus = (F.col("_above") + F.col("_r") <= extras).cast("bigint")
    unchanged = F.col("_w") == F.col("selected")
    return joined.withColumn(
        "episodes", F.when(unchanged, weight).otherwise(1 + F.col("_floor") + bonus)
    ).drop("_w", "_k", "_floor", "_neg", "_r", "_above", "_spent")


def render_module_plan(modules: DataFrame, budgets: DataFrame) -> DataFrame:
    """Plan text per project: budget header, then module blocks."""
    head = budgets.select(
        "project_id", F.lit(0).cast("bigint").alias("position"),
        F.format_string("目标集数：%d\n允许范围：%d至%d集\n本次规划总数：%d集\n", "desired", "minimum", "maximum", "selected").alias("_t"),
    )
    keys = F.array_join(F.transform("chapter_keys", lambda k: _cat("[", k, "]")), "、")
    body = modules.select(
        "project_id", F.col("position").cast("bigint").alias("position"),
        _cat(
            "## 模块", F.col("position").cast("string"), "：", F.col("title"), "\n听众问题：", F.col("listener_question"),
            "\n来源章节：", keys, "\n建议声音数：", F.col("episodes").cast("string"), "\n",
        ).alias("_t"),
    )
    out = assemble(head.unionByName(body), ["project_id"], ["position"], F.col("_t"))
    return out.withColumn("text", X.strip(F.col("text")))


# Outlines ---------------------------------------------------------------------


def validate_outline(markdown: Column, allowed: Column, expected: Column) -> Column:
    """Error of a module outline, null when it is usable."""
    blocks = F.filter(F.split(markdown, rf"(?mUd)(?=^##\s+第?\d+\s*集)"), lambda b: F.regexp_like(b, F.lit(EPISODE_BLOCK)))

    def judge(bs: Column) -> Column:
        def check(b: Column, k: Column) -> Column:
            keys = chapter_keys_in(b)
            unknown = F.array_sort(F.array_except(keys, allowed))
            where = F.format_string("模块第 %d 集", k + 1)
            return (
                F.when(F.size(keys) == 0, _cat(where, "缺少来源章节"))
                .when(F.size(unknown) > 0, _cat(where, "引用未知章节：", F.array_join(unknown, "、")))
                .when(F.regexp_like(b, F.lit(NO_ID_SHAPES)), F.lit("专辑大纲不得包含知识资产 ID 或段落原文索引"))
            )

        first = F.get(F.filter(F.transform(bs, check), lambda e: e.isNotNull()), F.lit(0))
        return (
            F.when(X.strip(markdown) == "", F.lit("模块没有生成专辑大纲"))
            .when(F.size(bs) == 0, F.lit("模块大纲没有可识别的声音条目"))
            .when(
                expected.isNotNull() & (F.size(bs) != expected),
                F.format_string("本模块分配 %d 集，模型实际生成 %d 集", expected, F.size(bs)),
            )
            .otherwise(first)
        )

    return X.let(blocks, judge)


_LABELLED = rf"(?md){_LABEL_OPEN}({FIELD_LABELS}){_LABEL_CLOSE}([^\n]*+(?:\n(?!{_LABEL_OPEN}(?:{FIELD_LABELS}){_LABEL_CLOSE})[^\n]*+)*+)"
# A line break with all space around it, blank lines included; a run of space without one is read once.
_BLANK = X.SPACE.replace(r"\t-\r", r"\t\x0b-\r")
_LINE_EDGE = rf"(?![!-~\u3001-\uffff])(?<!{_BLANK}){_BLANK}*+\n{X.SPACE}*+"


def outline_fields(body: Column) -> Column:
    """Struct(labels, texts) of a block: each label and what stands after it up to the next."""
    found = lambda group: F.regexp_extract_all(body, F.lit(_LABELLED), F.lit(group))
    return F.struct(found(1).alias("labels"), found(2).alias("texts"))


def outline_field(fields: Column, label: str) -> Column:
    """The text of a label, of its last block where it is given twice, blank lines dropped; empty if absent."""
    last = F.size(fields["labels"]) - F.array_position(F.reverse(fields["labels"]), F.lit(label)).cast("int")
    text = X.strip(F.coalesce(F.get(fields["texts"], last), F.lit("")))
    return X.let(text, lambda t: F.when(F.contains(t, F.lit("\n")), F.regexp_replace(t, _LINE_EDGE, "\n")).otherwise(t))


def parse_outlines(modules: DataFrame, markdown: str = "markdown") -> DataFrame:
    """Adds `episodes` (array of structs) and `error` to module rows.

    modules(..., module_key, chapter_keys, catalog_keys, suggested, markdown).
    """
    parts = F.transform(
        F.regexp_extract_all(X.strip(F.coalesce(markdown, F.lit(""))), F.lit(EPISODE_WHOLE), F.lit(0)),
        lambda p: F.struct(F.regexp_extract(p, EPISODE_HEADING, 1).alias("head"), X.strip(F.regexp_replace(p, EPISODE_HEADING, "")).alias("body")),
    )
    shaped = computed_once(
        modules,
        _eps=F.transform(
            F.filter(parts, lambda p: p["head"] != ""),
            lambda p: X.let(
                outline_fields(p["body"]),
                lambda found: X.let(
                    F.struct(*[outline_field(found, name).alias(f"f{i}") for i, name in enumerate(REQUIRED_FIELDS)]),
                    lambda e: F.struct(
                        X.strip(p["head"]).alias("title"),
                        has_id_shape(p["body"]).alias("cites"),
                        *[e[f"f{i}"].alias(f"f{i}") for i in range(len(REQUIRED_FIELDS))],
                        X.normalize_content_type(e[f"f{REQUIRED_FIELDS.index('内容类型')}"]).alias("kind"),
                        chapter_keys_in(e[f"f{REQUIRED_FIELDS.index('来源章节')}"]).alias("keys"),
                    ),
                ),
            ),
        ),
    )

    def field(e: Column, name: str) -> Column:
        return e[f"f{REQUIRED_FIELDS.index(name)}"]

    def problem(e: Column, k: Column) -> Column:
        where = F.concat(F.col("module_key"), F.format_string(" 第 %d 集", k + 1))
        absent = F.filter(F.array(*[F.when(field(e, n) == "", F.lit(n)) for n in REQUIRED_FIELDS]), lambda x: x.isNotNull())
        unknown = F.array_except(e["keys"], F.col("catalog_keys"))
        outside = F.array_except(e["keys"], F.col("chapter_keys"))
        return (
            F.when(e["title"] == "", _cat(where, "缺少标题"))
            .when(e["cites"], _cat(where, "不得包含知识资产 ID或段落原文索引"))
            .when(F.size(absent) > 0, _cat(where, "缺少字段：", F.array_join(absent, "、")))
            .when(e["kind"].isNull(), _cat("未知内容类型：", field(e, "内容类型")))
            .when(F.size(e["keys"]) == 0, _cat(where, "缺少来源章节"))
            .when(F.size(unknown) > 0, _cat(where, "引用未知章节：", F.array_join(unknown, "、")))
            .when(F.size(outside) > 0, _cat(where, "引用所属模块之外的章节：", F.array_join(outside, "、")))
        )

    first = F.get(F.filter(F.transform("_eps", problem), lambda x: x.isNotNull()), F.lit(0))
    error = (
        F.when(
            F.size("_eps") == 0,
            _cat(F.col("module_key"), F.when(X.strip(F.coalesce(markdown, F.lit(""))) == "", F.lit(" 缺少已生成的模块大纲")).otherwise(F.lit(" 没有可识别的声音条目"))),
        )
        .when(
            F.size("_eps") != F.col("suggested"),
            _cat(F.col("module_key"), F.format_string(" 应有 %d 集，实际解析 %d 集", F.col("suggested"), F.size("_eps"))),
        )
        .otherwise(first)
    )

    def episode(e: Column) -> Column:
        return F.struct(
            e["title"].alias("title"),
            _cat("听众钩子：", field(e, "听众钩子"), "\n核心主题：", field(e, "核心主题"), "\n核心要点：\n", field(e, "核心要点")).alias("main_points"),
            F.col("module_key").alias("module_key"),
            e["keys"].alias("chapter_keys"),
            e["kind"].alias("content_type"),
        )

    return shaped.withColumn("error", error).withColumn("episodes", F.transform("_eps", episode)).drop("_eps")


def validate_structured(raw: Column, catalog: Column, modules: Column, narrative: Column) -> Column:
    """Struct(episodes, error) of one structured album.

    raw: array<struct<title, main_points, content_type, chapter_keys,
    module_key>>; catalog: map<chapter_key, struct<title, section_id>>;
    modules: map<module_key, array<chapter_key>> (null for none). Episodes
    name the sections of their chapters, and show them with key and title.
    """
    def keys_of(e: Column) -> Column:
        cleaned = F.transform(e["chapter_keys"], lambda k: F.btrim(X.strip(k), F.lit("[]")))
        return F.array_distinct(F.filter(cleaned, lambda k: k != ""))

    def read(e: Column) -> Column:
        """What the checks and the result share, found once; the map of modules is built once, here."""
        module = X.strip(F.coalesce(e["module_key"], F.lit("")))
        return F.struct(
            e.isNull().alias("absent"), X.strip(e["title"]).alias("title"), X.strip(e["main_points"]).alias("points"), X.strip(e["content_type"]).alias("type"),
            X.normalize_content_type(e["content_type"]).alias("kind"), F.coalesce(F.size(e["chapter_keys"]), F.lit(0)).alias("n"), keys_of(e).alias("keys"), module.alias("module"),
            F.try_element_at(modules, module).alias("own"),
        )

    def blank(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    def problem(e: Column, k: Column, allowed: Column, given: Column) -> Column:
        where = F.format_string("专辑第 %d 条", k + 1)
        unknown = F.array_except(e["keys"], allowed)
        outside = F.array_sort(F.array_except(e["keys"], e["own"]))
        # The markers hold no space, so the trimmed text has them where the text has.
        lacking = F.coalesce(*[F.when(~F.contains(e["points"], F.lit(m)), F.lit(m)) for m in MARKERS])
        incomplete = blank(e["title"]) | blank(e["points"]) | blank(e["type"]) | (e["n"] < 1)
        return (
            F.when(e["absent"], _cat(where, "结构无效"))
            .when(incomplete, _cat(where, "字段不完整"))
            .when(e["kind"].isNull(), _cat(where, "未知内容类型：", e["type"]))
            .when(F.size(unknown) > 0, _cat(where, "引用未知章节：", F.array_join(unknown, "、")))
            .when(narrative & (e["kind"] != "解读"), F.lit("叙事类书籍不能生成过渡声音"))
            .when(given & e["own"].isNull(), _cat(where, "缺少有效模块标识"))
            .when(given & (F.size(outside) > 0), _cat(where, "引用了所属模块之外的章节：", F.array_join(outside, "、")))
            .when(lacking.isNotNull(), _cat(where, "主要内容缺少“", lacking, "”"))
        )

    def episode(e: Column, k: Column, shelf: Column) -> Column:
        return F.struct(
            (k + 1).alias("position"),
            e["title"].alias("title"),
            e["kind"].alias("content_type"),
            F.lit("观点").alias("style"),
            e["points"].alias("content_framework"),
            F.array_join(F.transform(e["keys"], lambda c: F.concat(F.lit("["), c, F.lit("] "), F.try_element_at(shelf, c)["title"])), "、").alias("section_identifier"),
            e["module"].alias("module_key"),
            e["keys"].alias("chapter_keys"),
            F.transform(e["keys"], lambda c: F.try_element_at(shelf, c)["section_id"]).alias("source_section_ids"),
        )

    def judged(s: Column) -> Column:
        problems = F.transform(s["eps"], lambda e, k: problem(e, k, s["allowed"], s["given"]))
        first = F.get(F.filter(problems, lambda x: x.isNotNull()), F.lit(0))
        return F.struct(s["eps"].alias("eps"), F.when(F.coalesce(F.size(s["eps"]), F.lit(0)) < 1, F.lit("结构化专辑大纲缺少 album_outline")).otherwise(first).alias("error"))

    # The catalog is looked up for the albums that pass, and built for those alone.
    shared = F.struct(F.transform(raw, read).alias("eps"), F.map_keys(catalog).alias("allowed"), modules.isNotNull().alias("given"))
    shown = lambda j: X.let(F.struct(catalog.alias("c")), lambda s: F.transform(j["eps"], lambda e, k: episode(e, k, s["c"])))
    return X.let(shared, lambda s: X.let(judged(s), lambda j: F.struct(F.when(j["error"].isNull(), shown(j)).alias("episodes"), j["error"].alias("error"))))


def total_error(actual: Column, expected: Column, low: Column, high: Column) -> Column:
    """Error when an album's size misses its plan; null bounds are not checked."""
    return F.when(
        expected.isNotNull() & (actual != expected),
        F.format_string("本次规划总数为 %d 集，结构化结果却有 %d 集", expected, actual),
    ).when(
        low.isNotNull() & ~actual.between(low, high),
        F.format_string("专辑实际 %d 集，超出允许范围 %d 至 %d 集", actual, low, high),
    )


def count_notice(desired: Column, low: Column, high: Column, actual: Column) -> Column:
    return (
        F.when(desired.isNull(), F.lit(""))
        .when(low.isNotNull(), F.format_string("目标 %d 集，允许 %d 至 %d 集，本次生成 %d 集。", desired, low, high, actual))
        .when(desired != actual, F.format_string("期望 %d 集，模型根据内容结构生成 %d 集。", desired, actual))
        .otherwise(F.lit(""))
    )


def tag_module_lines(markdown: Column, module_key: Column) -> Column:
    """Insert the module key after every episode heading."""
    tagged = F.regexp_replace(markdown, F.lit(r"(?mUd)(^##\s+第?\d+\s*集[：:].*$\n?)"), F.lit("$1模块标识：\u0000\n"))
    return F.replace(tagged, F.lit("\u0000"), module_key)


def outline_v1_error(episodes: Column, live_cards: Column, narrative: Column) -> Column:
    """First error of a card-based album outline, null when usable.

    episodes: array<struct<title, main_points, section_identifier,
    content_type, knowledge_item_ids>>; live_cards: ids of active cards.
    """

    def kind_of(e: Column) -> Column:
        return F.replace(X.strip(e["content_type"]), F.lit("类"), F.lit(""))

    def ids_of(e: Column) -> Column:
        return F.array_distinct(F.transform(e["knowledge_item_ids"], X.strip))

    def blank(c: Column) -> Column:
        return X.strip(F.coalesce(c, F.lit(""))) == ""

    def problem(e: Column, k: Column) -> Column:
        where = F.format_string("专辑第 %d 条", k + 1)
        at = [F.instr(e["main_points"], F.lit(m)) for m in MARKERS]
        points = F.regexp_extract(e["main_points"], r"(?s)核心要点：(.*)", 1)
        n = F.regexp_count(X.strip(points), F.lit(KEY_POINT))
        before = F.flatten(
            F.transform(
                F.filter(F.slice(episodes, F.lit(1), k), lambda p: kind_of(p) == "解读"), lambda p: F.coalesce(ids_of(p), F.array().cast("array<string>"))
            )
        )
        return (
            F.when(blank(e["title"]) | blank(e["main_points"]) | blank(e["section_identifier"]) | blank(e["content_type"]), _cat(where, "字段不完整"))
            .when((at[0] == 0) | (at[1] == 0) | (at[2] == 0), _cat(where, "主要内容缺少听众钩子、核心主题或核心要点"))
            .when((at[0] > at[1]) | (at[1] > at[2]), _cat(where, "主要内容结构顺序无效"))
            .when(~n.between(2, 4), _cat(where, "核心要点必须为 2 至 4 条"))
            .when(~kind_of(e).isin("解读", "过渡"), _cat(where, "内容类型无效"))
            .when(narrative & (kind_of(e) != "解读"), F.lit("叙事类书籍不能生成过渡声音"))
            .when(F.coalesce(F.size(e["knowledge_item_ids"]), F.lit(0)) < 1, _cat(where, "缺少知识资产来源"))
            .when(F.size(F.array_except(ids_of(e), live_cards)) > 0, _cat(where, "引用了不存在的知识资产"))
            .when((kind_of(e) == "过渡") & (F.size(ids_of(e)) < 2), _cat(where, "过渡声音至少需要两个知识资产"))
            .when((kind_of(e) == "解读") & F.arrays_overlap(ids_of(e), before), F.lit("同一知识资产被拆分到多条普通声音"))
        )

    first = F.get(F.filter(F.transform(episodes, problem), lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(episodes), F.lit(0)) < 1, F.lit("专辑大纲输出缺少 album_outline")).otherwise(first)


def rebuilt_identifier(identifier: Column, indexes: Column) -> Column:
    """Source label with its index list written anew."""
    label = X.strip(F.regexp_replace(identifier, r"(?sU)\s*原文索引\s*[:：].*\z", ""))
    return _cat(F.coalesce(F.nullif(label, F.lit("")), F.lit("内容来源")), " 原文索引：", F.array_join(indexes, "、"))


# Projects ---------------------------------------------------------------------


def seed_episodes(projects: DataFrame, sections: DataFrame, limit: int = 12) -> DataFrame:
    """Default album: the first level-4 sections of the project's book."""
    from ..operators.versions import every_nth_type, topk_per_parent

    first = topk_per_parent(sections.filter(F.col("level") == 4), ["book_id"], ["position", "section_id"], limit)
    title = F.col("title")
    return projects.select("project_id", "book_id").join(first, "book_id").select(
        "project_id",
        F.col("rank").alias("position"),
        "title",
        every_nth_type(F.col("rank")).alias("content_type"),
        F.lit("观点").alias("style"),
        _cat("围绕“", title, "”展开：先说明本节讨论的问题，再梳理原文中的核心观点、事件或案例，最后总结其意义。").alias("content_framework"),
        _cat("章节：", title).alias("section_identifier"),
        F.col("section_id").alias("source_section_id"),
    )


def confirm_violations(projects: DataFrame, episodes: DataFrame, sections: DataFrame, episode_cards: DataFrame, cards: DataFrame) -> DataFrame:
    """Reasons why projects cannot be confirmed; no row means confirmable.

    Every rule is a semi/anti join or a filter; the rows are (project_id,
    position, reason).
    """
    from ..operators.evidence import EVIDENCE_SCHEME

    empty = projects.join(episodes.select("project_id"), "project_id", "left_anti").select(
        "project_id", F.lit(0).cast("bigint").alias("position"), F.lit("专辑大纲至少需要一条声音").alias("reason")
    )
    at = F.format_string("第 %d 条声音", F.col("position"))
    pos = F.col("position").cast("bigint").alias("position")
    no_framework = episodes.filter(X.strip(F.col("content_framework")) == "").select("project_id", pos, _cat(at, "缺少内容框架").alias("reason"))
    no_source = episodes.filter(F.coalesce(F.size("source_section_ids"), F.lit(0)) < 1).select("project_id", pos, _cat(at, "没有关联原文块").alias("reason"))
    owned = projects.select("project_id", F.explode("book_ids").alias("_book")).distinct()
    homes = sections.select("section_id", F.col("book_id").alias("_book"))
    cited = episodes.select("project_id", "position", F.explode("source_section_ids").alias("section_id"))
    good = cited.join(homes, "section_id").join(owned, ["project_id", "_book"], "left_semi").select("project_id", "position", "section_id")
    bad_source = (
        cited.join(good, ["project_id", "position", "section_id"], "left_anti")
        .select("project_id", pos, _cat(at, "包含无效原文块").alias("reason"))
        .distinct()
    )
    used = episode_cards.join(episodes.select("episode_id", "project_id", F.col("position").alias("_pos")), "episode_id").select(
        "project_id", F.col("_pos").alias("position"), "card_id"
    )
    live = cards.filter((F.col("status") == "active") & (F.col("source_scheme") == EVIDENCE_SCHEME)).select("card_id", F.col("book_id").alias("_book"))
    fine = used.join(live, "card_id").join(owned, ["project_id", "_book"], "left_semi").select("project_id", "position", "card_id")
    stale = (
        used.join(fine, ["project_id", "position", "card_id"], "left_anti")
        .select("project_id", pos, _cat(at, "包含无效或已过期知识资产").alias("reason"))
        .distinct()
    )
    out = empty
    for frame in (no_framework, no_source, bad_source, stale):
        out = out.unionByName(frame)
    return out


def module_retry_set(modules: DataFrame, artifacts: DataFrame, retry_key: str | None = None) -> DataFrame:
    """What to do per module: keep (succeeded and still valid), failed (carry its error), or run."""
    stored = artifacts.select(
        "run_id", "module_key", F.col("status").alias("_s"), F.col("content").alias("_c"), F.col("error_message").alias("_e")
    )
    out = modules.join(stored, ["run_id", "module_key"], "left")
    broken = validate_outline(F.coalesce("_c", F.lit("")), F.col("chapter_keys"), F.col("suggested"))
    other = F.lit(False) if retry_key is None else F.col("module_key") != retry_key
    action = (
        F.when((F.col("_s") == "succeeded") & broken.isNull(), F.lit("keep"))
        .when((F.col("_s") == "failed") & other, F.lit("failed"))
        .otherwise(F.lit("run"))
    )
    return (
        out.withColumn("action", action)
        .withColumn("carried_error", F.when(F.col("action") == "failed", F.coalesce(F.nullif("_e", F.lit("")), F.lit("模块尚未成功"))))
        .drop("_s", "_c", "_e")
    )


def recover_structure(modules: DataFrame, outlines: DataFrame) -> DataFrame:
    """Episodes rebuilt from stored module outlines, the same on every repeat.

    modules(run_id, module_key, position, chapter_keys, catalog_keys,
    suggested); outlines(run_id, module_key, content). Positions run on over
    the modules of a run. Episodes of a module with an error are listed with
    it; a module without any has one row with nothing but the error.
    """
    parsed = parse_outlines(modules.join(outlines.withColumnRenamed("content", "markdown"), ["run_id", "module_key"], "left"))
    # Stored, so that the numbering reads sizes and does not parse again.
    done = cut_lineage(parsed.select("run_id", "module_key", "position", "error", "episodes", F.size("episodes").cast("bigint").alias("_n")))
    good = running(done, ["run_id"], ["position"], position_block(F.col("position")), sums={"_upto": F.col("_n")}).withColumn("_from", F.col("_upto") - F.col("_n"))
    flat = good.select("run_id", "module_key", "error", "_from", F.posexplode_outer("episodes").alias("_k", "e"))
    ident = F.when(F.col("_k").isNotNull(), X.stable_id("episode", F.col("run_id"), F.col("_from") + F.col("_k") + 1))
    return flat.select("run_id", "module_key", "error", (F.col("_from") + F.col("_k") + 1).alias("position"), ident.alias("episode_id"), "e.title", "e.content_type", "e.main_points", "e.chapter_keys")


def replace_album(episodes: DataFrame, links: DataFrame, root: str, version: str) -> None:
    """Store a whole album set as one new snapshot and make it current last.

    Parquet has no transactions over several tables: both tables go into a
    fresh versioned folder, and only a complete snapshot is pointed to. A
    failure before the last step leaves the former album current.
    """
    spark = episodes.sparkSession
    episodes.write.mode("overwrite").parquet(f"{root}/versions/{version}/episodes")
    links.write.mode("overwrite").parquet(f"{root}/versions/{version}/links")
    try:
        number = spark.read.parquet(f"{root}/current").agg(F.max("number")).first()[0] + 1
    except AnalysisException:  # the first snapshot
        number = 1
    spark.createDataFrame([(number, version)], "number bigint, version string").coalesce(1).write.mode("append").parquet(f"{root}/current")


def read_album(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot that was stored last, whatever its name."""
    version = spark.read.parquet(f"{root}/current").agg(F.max_by("version", "number")).first()[0]
    return spark.read.parquet(f"{root}/versions/{version}/episodes"), spark.read.parquet(f"{root}/versions/{version}/links")
