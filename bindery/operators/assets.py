"""Validation of structured chapter analyses, and the cards they yield.

An analysis is one nested row. The only cross-row question, which cited
fragments exist and where they stand, is answered by one join over distinct
cited ids; the answers come back as a small map per analysis and everything
else is nested array work inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import text as X
from ..rows import computed_once, unnest
from ..session import cut_lineage

_TEXT = "struct<text:string,source_content_indexes:array<string>>"
_CASE = (
    "struct<summary:string,relation:string,source_content_indexes:array<string>,"
    f"evidence_quotes:array<{_TEXT}>>"
)
ANALYSIS_SCHEMA = (
    "struct<chapter_title:string,chapter_theme:string,subtopics:array<struct<"
    "title:string,"
    "definitions:array<struct<name:string,definition:string,source_content_indexes:array<string>>>,"
    f"quotes:array<{_TEXT}>,"
    f"viewpoints:array<struct<text:string,source_content_indexes:array<string>,arguments:array<{_TEXT}>,`case`:{_CASE}>>,"
    f"orphan_arguments:array<{_TEXT}>,"
    f"orphan_cases:array<{_CASE}>>>>"
)
ISSUE = "struct<asset_type:string,title:string,error:string,source_content_indexes:array<string>>"

# Card kinds.
CONCEPT, QUOTE, VIEWPOINT, ARGUMENT, CASE, EVIDENCE = "概念", "金句", "观点", "论据", "案例", "案例证据"
RELATION = "人物关系"


# The same shapes with texts left as they came, to be read by their own type.
_RAW_TEXT = "struct<text:variant,source_content_indexes:array<variant>>"
_RAW_CASE = f"struct<summary:variant,relation:variant,source_content_indexes:array<variant>,evidence_quotes:array<{_RAW_TEXT}>>"
_RAW = (
    "struct<chapter_title:variant,chapter_theme:variant,subtopics:array<struct<title:variant,"
    "definitions:array<struct<name:variant,definition:variant,source_content_indexes:array<variant>>>,"
    f"quotes:array<{_RAW_TEXT}>,"
    f"viewpoints:array<struct<text:variant,source_content_indexes:array<variant>,arguments:array<{_RAW_TEXT}>,`case`:variant>>,"
    f"orphan_arguments:array<{_RAW_TEXT}>,orphan_cases:array<{_RAW_CASE}>>>>"
)


def _string(v: Column) -> Column:
    """A text; null where it is missing or of another type. Only scalars are asked for their type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def parse_analysis(raw: Column) -> Column:
    """Model output to the nested analysis; null when it is not a JSON object.

    One cast reads the whole shape, element by element: what is no object
    becomes a null element, what is no list a null list. What is no text
    becomes a null text, so one bad item never hides its neighbours. A case
    that is no object has nulls throughout, its list of indexes included,
    which an object never has.
    """

    def ids(e: Column) -> Column:
        return _list(F.transform(e["source_content_indexes"], _string), "string").alias("source_content_indexes")

    def each(e: Column, name: str, item) -> Column:
        return F.transform(e[name], lambda x: F.when(x.isNotNull(), item(x))).alias(name)

    def fields(e: Column, *names: str) -> list[Column]:
        return [_string(e[n]).alias(n) for n in names]

    def text(e: Column) -> Column:
        return F.struct(*fields(e, "text"), ids(e))

    def definition(e: Column) -> Column:
        return F.struct(*fields(e, "name", "definition"), ids(e))

    def case(e: Column) -> Column:
        return F.struct(*fields(e, "summary", "relation"), ids(e), each(e, "evidence_quotes", text))

    def optional_case(v: Column) -> Column:
        broken = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("summary", "string"), ("relation", "string"), ("source_content_indexes", "array<string>"), ("evidence_quotes", f"array<{_TEXT}>"))])
        there = v.isNotNull() & ~F.is_variant_null(v)
        return F.when(there, X.let(F.struct(F.try_variant_get(v, "$", _RAW_CASE).alias("c")), lambda s: F.when(s["c"].isNotNull(), case(s["c"])).otherwise(broken))).alias("case")

    def viewpoint(e: Column) -> Column:
        return F.struct(*fields(e, "text"), ids(e), each(e, "arguments", text), optional_case(e["case"]))

    def subtopic(e: Column) -> Column:
        return F.struct(
            *fields(e, "title"), each(e, "definitions", definition), each(e, "quotes", text),
            each(e, "viewpoints", viewpoint), each(e, "orphan_arguments", text), each(e, "orphan_cases", case),
        )

    def whole(v: Column) -> Column:
        return F.when(v.isNotNull(), F.struct(*fields(v, "chapter_title", "chapter_theme"), each(v, "subtopics", subtopic)))

    value = F.try_variant_get(F.try_parse_json(X.strip_code_fence(raw)), "$", _RAW)
    return X.let(F.struct(value.alias("v")), lambda s: whole(s["v"])).cast(ANALYSIS_SCHEMA)


def parse_json_object(raw: Column) -> Column:
    """Struct(value variant, error) of a fenced or bare JSON object."""
    value = F.try_parse_json(X.strip_code_fence(raw))
    return X.let(
        F.struct(value.alias("v")),
        lambda s: F.struct(
            F.when(F.schema_of_variant(s["v"]).startswith("OBJECT"), s["v"]).alias("value"),
            F.when(s["v"].isNull(), F.lit("invalid JSON"))
            .when(~F.schema_of_variant(s["v"]).startswith("OBJECT"), F.lit("模型输出必须是 JSON 对象"))
            .alias("error"),
        ),
    )


def _none(ddl: str) -> Column:
    return F.array().cast(f"array<{ddl}>")


def _list(c: Column, ddl: str) -> Column:
    return F.coalesce(c, _none(ddl))


# Flattening ------------------------------------------------------------------


def flatten_assets(analyses: DataFrame, data: str = "data") -> DataFrame:
    """One row per definition, quote, viewpoint, argument, case, evidence and orphan.

    The assets of an analysis are put into one array and exploded once.
    Columns: slot, sub_no, item_no, child_no, subtopic, name, body, indexes.
    """

    def asset(slot: str, sub: Column, k: Column, item: Column | None, child: Column | None, name, body, indexes) -> Column:
        zero = F.lit(0)
        return F.struct(
            F.lit(slot).alias("slot"),
            (k + 1).alias("sub_no"),
            (zero if item is None else item + 1).cast("int").alias("item_no"),
            (zero if child is None else child + 1).cast("int").alias("child_no"),
            sub["title"].alias("subtopic"),
            (F.lit(None).cast("string") if name is None else name).alias("name"),
            body.alias("body"),
            indexes.alias("indexes"),
        )

    def texts(slot: str, sub: Column, k: Column, values: Column, item: Column | None = None) -> Column:
        if item is None:
            return F.transform(
                _list(values, _TEXT), lambda x, i: asset(slot, sub, k, i, None, None, x["text"], x["source_content_indexes"])
            )
        return F.transform(
            _list(values, _TEXT), lambda x, j: asset(slot, sub, k, item, j, None, x["text"], x["source_content_indexes"])
        )

    def case_rows(slot: str, sub: Column, k: Column, i: Column, c: Column) -> Column:
        head = asset(slot, sub, k, i, None, c["relation"], c["summary"], c["source_content_indexes"])
        return F.when(
            c.isNotNull(), F.concat(F.array(head), texts("evidence", sub, k, c["evidence_quotes"], i))
        ).otherwise(F.slice(F.array(head), F.lit(1), F.lit(0)))

    def per_subtopic(sub: Column, k: Column) -> Column:
        return F.concat(
            F.transform(
                sub["definitions"],
                lambda x, i: asset("definition", sub, k, i, None, x["name"], x["definition"], x["source_content_indexes"]),
            ),
            texts("quote", sub, k, sub["quotes"]),
            F.flatten(
                F.transform(
                    sub["viewpoints"],
                    lambda v, i: F.concat(
                        F.array(asset("viewpoint", sub, k, i, None, None, v["text"], v["source_content_indexes"])),
                        texts("argument", sub, k, v["arguments"], i),
                        case_rows("case", sub, k, i, v["case"]),
                    ),
                )
            ),
            texts("orphan_argument", sub, k, sub["orphan_arguments"]),
            F.flatten(F.transform(sub["orphan_cases"], lambda c, i: case_rows("orphan_case", sub, k, i, c))),
        )

    filled = F.transform(
        F.col(data)["subtopics"],
        lambda s: s.withField("definitions", _list(s["definitions"], "struct<name:string,definition:string,source_content_indexes:array<string>>"))
        .withField("viewpoints", _list(s["viewpoints"], f"struct<text:string,source_content_indexes:array<string>,arguments:array<{_TEXT}>,`case`:{_CASE}>"))
        .withField("orphan_cases", _list(s["orphan_cases"], _CASE)),
    )
    rest = [c for c in analyses.columns if c != data]
    # The filled array becomes a column first so that it is computed once.
    ready = analyses.withColumn("_subs", filled)
    rows = F.flatten(F.transform("_subs", per_subtopic))
    return unnest(ready, rest, rows, "a").select(*rest, "a.*")


# Resolving cited fragments -----------------------------------------------------


def _cited(data: Column) -> Column:
    """Distinct trimmed ids cited anywhere in an analysis."""
    ids = lambda xs: F.flatten(F.transform(xs, lambda x: _list(x["source_content_indexes"], "string")))
    case_ids = lambda c: F.concat(
        _list(c["source_content_indexes"], "string"), ids(_list(c["evidence_quotes"], _TEXT))
    )

    def per_sub(s: Column) -> Column:
        views = _list(s["viewpoints"], f"struct<text:string,source_content_indexes:array<string>,arguments:array<{_TEXT}>,`case`:{_CASE}>")
        return F.concat(
            ids(_list(s["definitions"], "struct<name:string,definition:string,source_content_indexes:array<string>>")),
            ids(_list(s["quotes"], _TEXT)),
            ids(views),
            F.flatten(F.transform(views, lambda v: ids(_list(v["arguments"], _TEXT)))),
            F.flatten(F.transform(views, lambda v: F.coalesce(case_ids(v["case"]), F.array().cast("array<string>")))),
            ids(_list(s["orphan_arguments"], _TEXT)),
        )

    flat = F.flatten(F.transform(data["subtopics"], per_sub))
    return F.array_distinct(F.filter(F.transform(flat, X.strip), lambda x: x != ""))


def resolve(analyses: DataFrame, fragments: DataFrame) -> DataFrame:
    """Adds `positions` (id -> book position) and `homes` (id -> section) maps.

    analyses(analysis_id, root_section_id, set_id, data);
    fragments(set_id, root_section_id, content_index, book_position, source_section_id).
    """
    cited = unnest(analyses, ["analysis_id", "set_id", "root_section_id"], _cited(F.col("data")), "content_index")
    found = cited.join(fragments, ["set_id", "root_section_id", "content_index"])
    maps = found.groupBy("analysis_id").agg(
        F.map_from_entries(F.collect_list(F.struct("content_index", F.col("book_position").cast("bigint")))).alias("positions"),
        F.map_from_entries(F.collect_list(F.struct("content_index", "source_section_id"))).alias("homes"),
    )
    out = analyses.join(maps, "analysis_id", "left")
    return out.withColumns(
        {
            "positions": F.coalesce("positions", F.create_map().cast("map<string,bigint>")),
            "homes": F.coalesce("homes", F.create_map().cast("map<string,string>")),
        }
    )


def check_indexes(raw: Column, label: Column, positions: Column) -> Column:
    """Struct(error, indexes): known ids, distinct, in book order; first problem as error."""

    def check(trimmed: Column) -> Column:
        blank = F.exists(trimmed, lambda x: x.isNull() | (x == ""))
        unknown = F.get(F.filter(trimmed, lambda x: ~F.map_contains_key(positions, x)), F.lit(0))
        error = (
            F.when(F.size(trimmed) == 0, F.concat(label, F.lit(" 必须包含至少一个 source_content_indexes")))
            .when(blank, F.concat(label, F.lit(" 的 source_content_indexes 无效")))
            .otherwise(F.concat(label, F.lit(" 引用了无效 content_index："), unknown))
        )
        placed = F.transform(F.array_distinct(trimmed), lambda x: F.struct(F.try_element_at(positions, x).alias("p"), x.alias("x")))
        ordered = F.when(F.size(trimmed) == 1, trimmed).otherwise(F.transform(F.array_sort(placed), lambda s: s["x"]))
        return F.struct(error.alias("error"), ordered.alias("indexes"))

    return X.let(F.transform(_list(raw, "string"), X.strip), check)


def _required(value: Column, field: str) -> Column:
    return F.when(X.strip(F.coalesce(value, F.lit(""))) == "", F.lit(f"{field} 不能为空"))


def _issue(kind: str, title: Column, fallback: str, error: Column, raw: Column) -> Column:
    shown = F.nullif(F.left(X.compact_text(F.coalesce(title, F.lit(fallback))), F.lit(120)), F.lit(""))
    return F.struct(
        F.lit(kind).alias("asset_type"),
        F.coalesce(shown, F.lit("未命名条目")).alias("title"),
        error.alias("error"),
        _list(raw, "string").alias("source_content_indexes"),
    )


def _checked_text(x: Column, field: str, label: str, kind: str, structure: str, positions: Column, unnamed: Column | None = None) -> Column:
    """Struct(ok, item, issue) of a text asset; `unnamed` titles an issue without text, else the kind does."""
    return X.let(
        check_indexes(x["source_content_indexes"], F.lit(label), positions),
        lambda r: X.let(
            F.coalesce(
                F.when(x.isNull(), F.lit(structure)), _required(x["text"], field), r["error"]
            ),
            lambda e: F.struct(
                e.isNull().alias("ok"),
                F.when(
                    e.isNull(),
                    F.struct(X.strip(x["text"]).alias("text"), r["indexes"].alias("source_content_indexes")),
                ).alias("item"),
                F.when(
                    e.isNotNull(),
                    _issue(kind, x["text"] if unnamed is None else F.coalesce(x["text"], unnamed), kind, e, x["source_content_indexes"]),
                ).alias("issue"),
            ),
        ),
    )


def _kept(checked: Column) -> Column:
    return F.transform(F.filter(checked, lambda c: c["ok"]), lambda c: c["item"])


def _issues(checked: Column) -> Column:
    return F.transform(F.filter(checked, lambda c: ~c["ok"]), lambda c: c["issue"])


def _checked_definition(x: Column, positions: Column) -> Column:
    label = F.concat(F.lit("概念“"), X.strip(x["name"]), F.lit("”"))
    return X.let(
        check_indexes(x["source_content_indexes"], label, positions),
        lambda r: X.let(
            F.coalesce(
                F.when(x.isNull(), F.lit("definitions 条目结构无效")),
                _required(x["name"], "definition.name"),
                _required(x["definition"], "definition.definition"),
                r["error"],
            ),
            lambda e: F.struct(
                e.isNull().alias("ok"),
                F.when(
                    e.isNull(),
                    F.struct(
                        X.strip(x["name"]).alias("name"),
                        X.strip(x["definition"]).alias("definition"),
                        r["indexes"].alias("source_content_indexes"),
                    ),
                ).alias("item"),
                F.when(e.isNotNull(), _issue(CONCEPT, x["name"], CONCEPT, e, x["source_content_indexes"])).alias("issue"),
            ),
        ),
    )


def _checked_case(c: Column, positions: Column) -> Column:
    """Struct(item or null, issues) of a viewpoint's case."""

    def evidence(x: Column, outer: Column) -> Column:
        base = _checked_text(x, "case.evidence_quote.text", "案例证据", EVIDENCE, "案例 evidence_quotes 结构无效", positions)
        outside = F.lit("案例证据索引必须包含在案例来源索引中")

        def widen(b: Column) -> Column:
            bad = b["ok"] & (F.size(F.array_except(b["item"]["source_content_indexes"], outer)) > 0)
            return F.when(
                bad,
                F.struct(
                    F.lit(False).alias("ok"),
                    b["item"].alias("item"),
                    _issue(EVIDENCE, x["text"], EVIDENCE, outside, x["source_content_indexes"]).alias("issue"),
                ),
            ).otherwise(b)

        return X.let(base, widen)

    def finish(s: Column) -> Column:
        kept = _kept(s["ev"])
        late = F.when(s["early"].isNull() & (F.size(kept) == 0), F.lit("案例没有通过来源校验的 evidence_quotes"))
        return X.let(
            F.coalesce(s["early"], late),
            lambda e: F.struct(
                F.when(
                    e.isNull(),
                    F.struct(
                        X.strip(c["summary"]).alias("summary"),
                        X.strip(c["relation"]).alias("relation"),
                        s["ix"].alias("source_content_indexes"),
                        kept.alias("evidence_quotes"),
                    ),
                ).alias("item"),
                F.concat(
                    F.when(s["early"].isNull(), _issues(s["ev"])).otherwise(_none(ISSUE)),
                    F.when(
                        e.isNotNull(), F.array(_issue(CASE, c["summary"], CASE, e, c["source_content_indexes"]))
                    ).otherwise(_none(ISSUE)),
                ).alias("issues"),
            ),
        )

    quotes = _list(c["evidence_quotes"], _TEXT)
    checked = X.let(
        check_indexes(c["source_content_indexes"], F.lit(CASE), positions),
        lambda r: X.let(
            F.struct(
                F.coalesce(
                    F.when(c["summary"].isNull() & c["relation"].isNull() & c["source_content_indexes"].isNull() & c["evidence_quotes"].isNull(), F.lit("case 结构无效")),
                    _required(c["summary"], "case.summary"),
                    _required(c["relation"], "case.relation"),
                    r["error"],
                    F.when(F.size(quotes) == 0, F.lit("案例必须包含至少一条 evidence_quotes")),
                ).alias("early"),
                r["indexes"].alias("ix"),
                F.transform(quotes, lambda x: evidence(x, r["indexes"])).alias("ev"),
            ),
            finish,
        ),
    )
    nothing = F.struct(F.lit(None).cast(_CASE).alias("item"), _none(ISSUE).alias("issues"))
    return F.when(c.isNull(), nothing).otherwise(checked)


def validate(resolved: DataFrame) -> DataFrame:
    """Adds rejected_reason, valid (nested), issues, valid_item_count, invalid_item_count.

    Bad items are listed and dropped one by one; the arguments and the case of
    a bad viewpoint are kept as orphans. Only a missing title, theme or
    subtopic list rejects a whole analysis.
    """
    pos = F.col("positions")

    def viewpoint(v: Column) -> Column:
        unnamed = F.when(v.isNull(), F.lit("结构无效的观点")).otherwise(F.lit("主要观点"))
        head = _checked_text(v, "viewpoint.text", "主要观点", VIEWPOINT, "viewpoints 条目结构无效", pos, unnamed)
        args = F.transform(
            _list(v["arguments"], _TEXT),
            lambda a: _checked_text(a, "argument.text", ARGUMENT, ARGUMENT, "arguments 条目必须包含 text 和 source_content_indexes", pos),
        )
        return F.struct(head.alias("head"), args.alias("args"), _checked_case(v["case"], pos).alias("case"))

    def subtopic(s: Column, k: Column) -> Column:
        views = _list(s["viewpoints"], f"struct<text:string,source_content_indexes:array<string>,arguments:array<{_TEXT}>,`case`:{_CASE}>")
        return F.struct(
            F.coalesce(X.nonblank(s["title"]), F.concat(F.lit("子主题 "), (k + 1).cast("string"))).alias("title"),
            F.transform(
                _list(s["definitions"], "struct<name:string,definition:string,source_content_indexes:array<string>>"),
                lambda x: _checked_definition(x, pos),
            ).alias("defs"),
            F.transform(
                _list(s["quotes"], _TEXT),
                lambda x: _checked_text(x, "quote.text", QUOTE, QUOTE, "quotes 条目必须包含 text 和 source_content_indexes", pos),
            ).alias("quotes"),
            F.transform(views, viewpoint).alias("views"),
            F.transform(
                _list(s["orphan_arguments"], _TEXT),
                lambda x: _checked_text(x, "orphan_argument.text", "独立论据", ARGUMENT, "orphan_arguments 条目必须包含 text 和 source_content_indexes", pos),
            ).alias("loose"),
        )

    def clean(s: Column) -> Column:
        good = F.filter(s["views"], lambda v: v["head"]["ok"])
        bad = F.filter(s["views"], lambda v: ~v["head"]["ok"])
        return F.struct(
            s["title"].alias("title"),
            _kept(s["defs"]).alias("definitions"),
            _kept(s["quotes"]).alias("quotes"),
            F.transform(
                good,
                lambda v: F.struct(
                    v["head"]["item"]["text"].alias("text"),
                    v["head"]["item"]["source_content_indexes"].alias("source_content_indexes"),
                    _kept(v["args"]).alias("arguments"),
                    v["case"]["item"].alias("case"),
                ),
            ).alias("viewpoints"),
            F.concat(F.flatten(F.transform(bad, lambda v: _kept(v["args"]))), _kept(s["loose"])).alias("orphan_arguments"),
            F.filter(F.transform(bad, lambda v: v["case"]["item"]), lambda c: c.isNotNull()).alias("orphan_cases"),
        )

    def problems(s: Column) -> Column:
        per_view = F.flatten(
            F.transform(
                s["views"],
                lambda v: F.concat(
                    F.when(~v["head"]["ok"], F.array(v["head"]["issue"])).otherwise(_none(ISSUE)),
                    _issues(v["args"]),
                    v["case"]["issues"],
                ),
            )
        )
        return F.concat(_issues(s["defs"]), _issues(s["quotes"]), per_view, _issues(s["loose"]))

    data = F.col("data")
    reason = F.coalesce(
        F.when(data.isNull(), F.lit("模型输出必须是 JSON 对象")),
        _required(data["chapter_title"], "chapter_title"),
        _required(data["chapter_theme"], "chapter_theme"),
        F.when(F.coalesce(F.size(data["subtopics"]), F.lit(0)) < 1, F.lit("subtopics 必须是非空数组")),
        F.when(
            F.exists(data["subtopics"], lambda s: s.isNull()),
            F.format_string("第 %d 个子主题结构无效", F.array_position(F.transform(data["subtopics"], lambda s: s.isNull()), F.lit(True))),
        ),
    )
    checked = computed_once(
        resolved.withColumn("rejected_reason", reason),
        _checked=F.when(F.col("rejected_reason").isNull(), F.transform(data["subtopics"], subtopic)),
    )
    out = computed_once(
        checked,
        valid=F.when(
            F.col("rejected_reason").isNull(),
            F.struct(
                X.strip(data["chapter_title"]).alias("chapter_title"),
                X.strip(data["chapter_theme"]).alias("chapter_theme"),
                F.transform("_checked", clean).alias("subtopics"),
            ),
        ),
        issues=F.coalesce(F.flatten(F.transform("_checked", problems)), _none(ISSUE)),
    )
    return (
        out.drop("_checked")
        .withColumn("valid_item_count", F.coalesce(F.size(_card_rows(F.col("valid"))), F.lit(0)))
        .withColumn("invalid_item_count", F.size("issues"))
    )


def _first_error() -> Column:
    return F.coalesce(F.col("rejected_reason"), F.get("issues", F.lit(0))["error"])


def strict_failures(validated: DataFrame) -> DataFrame:
    """Analyses a strict check refuses, with the first error of each."""
    return validated.withColumn("first_error", _first_error()).filter(F.col("first_error").isNotNull())


class RefusedAnalyses(RuntimeError):
    """A strict write met analyses with errors; they are in quarantine."""

    def __init__(self, refused: int, total: int, first: str):
        super().__init__(f"{refused} of {total} analyses refused, the first: {first}")
        self.refused, self.total = refused, total


def write_strict(validated: DataFrame, path: str, *, strict: bool = True) -> dict:
    """Validate and write in one pass: accepted analyses below refused=false, the others, with first_error, below refused=true.

    How many were refused is measured while they are written, so nothing is
    read or validated twice; a strict write with any raises
    `RefusedAnalyses` once all are stored. Returns the counts.
    """
    seen = Observation()
    error = F.col("first_error")
    marked = computed_once(validated, first_error=_first_error()).withColumn("refused", error.isNotNull())
    measured = marked.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(error.isNotNull()).alias("refused"), F.min(error).alias("first"))
    measured.write.mode("overwrite").partitionBy("refused").parquet(path)
    counts = seen.get
    if strict and counts["refused"]:
        raise RefusedAnalyses(counts["refused"], counts["total"], counts["first"])
    return counts


def read_strict(spark: SparkSession, path: str, refused: bool) -> DataFrame:
    """The accepted or the refused analyses of `write_strict`."""
    return spark.read.parquet(path).filter(F.col("refused") == refused).drop("refused")


# Cards -----------------------------------------------------------------------


def case_body(c: Column) -> Column:
    return F.concat(c["summary"], F.lit("\n\n关联："), c["relation"])


def _card_rows(valid: Column) -> Column:
    """array<struct<kind,title,body,indexes>> in the order cards are derived."""

    def card(kind: str, title: Column, body: Column, indexes: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), title.alias("title"), body.alias("body"), indexes.alias("indexes")
        )

    def titled(s: Column, suffix: str) -> Column:
        return F.concat(s["title"], F.lit(suffix))

    def per_view(s: Column, v: Column) -> Column:
        one_case = F.array(card(CASE, titled(s, " · 案例"), case_body(v["case"]), v["case"]["source_content_indexes"]))
        return F.concat(
            F.array(card(VIEWPOINT, s["title"], v["text"], v["source_content_indexes"])),
            F.transform(v["arguments"], lambda a: card(ARGUMENT, titled(s, " · 论据"), a["text"], a["source_content_indexes"])),
            F.filter(one_case, lambda c: v["case"].isNotNull()),
        )

    def per_sub(s: Column) -> Column:
        return F.concat(
            F.transform(s["definitions"], lambda d: card(CONCEPT, d["name"], d["definition"], d["source_content_indexes"])),
            F.transform(s["quotes"], lambda q: card(QUOTE, titled(s, " · 金句"), q["text"], q["source_content_indexes"])),
            F.flatten(F.transform(s["viewpoints"], lambda v: per_view(s, v))),
            F.transform(
                s["orphan_arguments"],
                lambda a: card(ARGUMENT, titled(s, " · 论据（观点未通过校验）"), a["text"], a["source_content_indexes"]),
            ),
            F.transform(
                s["orphan_cases"],
                lambda c: card(CASE, titled(s, " · 案例（观点未通过校验）"), case_body(c), c["source_content_indexes"]),
            ),
        )

    return F.flatten(F.transform(valid["subtopics"], per_sub))


def derive_cards(validated: DataFrame) -> DataFrame:
    """One row per card with stable key, id, ordered sources and section ids."""
    keep = ["analysis_id", "book_id", "root_section_id", "homes"]
    rows = unnest(validated, keep, _card_rows(F.col("valid")), "c", "card_no").select(*keep, "card_no", "c.*")
    keyed = rows.withColumn("stable_key", X.card_key(F.col("book_id"), F.col("kind"), F.col("body"), F.col("indexes")))
    sections = F.array_distinct(F.transform("indexes", lambda x: F.try_element_at("homes", x)))
    return keyed.withColumn("card_id", X.card_id(F.col("stable_key"))).withColumn("source_section_ids", sections).drop("homes")


def card_links(cards: DataFrame) -> DataFrame:
    """(card_id, content_index, source_order) rows."""
    flat = cards.select("card_id", F.posexplode("indexes").alias("_p", "content_index")).distinct()
    return flat.select("card_id", "content_index", (F.col("_p") + 1).alias("source_order"))


def publish_cards(analyses: DataFrame, links: DataFrame, cards: DataFrame) -> DataFrame:
    """Card status derived from the log: active when linked to a root's newest analysis.

    Nothing is updated in place; publishing is appending an analysis and its
    links, and this view gives the current state.
    """
    newest = analyses.groupBy("root_section_id").agg(F.max_by("analysis_id", F.struct("version", "analysis_id")).alias("analysis_id"))
    live = links.join(newest, "analysis_id", "left_semi").select("card_id").distinct().withColumn("_live", F.lit(True))
    out = cards.join(live, "card_id", "left")
    return out.withColumn("status", F.when(F.col("_live"), F.lit("active")).otherwise(F.lit("superseded"))).drop("_live")


# Rendering -------------------------------------------------------------------


def render_chapter(valid: Column, book: Column) -> Column:
    """Chapter Markdown with card ids and source lists."""

    def ident(kind: str, body: Column, ix: Column) -> Column:
        return X.card_id(X.card_key(book, F.lit(kind), body, ix))

    def src(ix: Column) -> Column:
        return F.array_join(ix, "、")

    def lines(*parts) -> Column:
        return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def cat(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def bullets(kind: str, xs: Column) -> Column:
        return F.flatten(
            F.transform(
                xs,
                lambda q: lines(
                    cat("- ", q["text"]),
                    cat("  - 知识资产 ID：", ident(kind, q["text"], q["source_content_indexes"])),
                    cat("  - 原文索引：", src(q["source_content_indexes"])),
                ),
            )
        )

    def case_lines(c: Column) -> Column:
        ix = c["source_content_indexes"]
        return F.concat(
            lines(
                cat("- **概述：** ", c["summary"]),
                cat("- **关联：** ", c["relation"]),
                cat("- **知识资产 ID：** ", ident(CASE, case_body(c), ix)),
                cat("- **原文索引：** ", src(ix)),
                "- **证据原文：**",
            ),
            F.transform(
                c["evidence_quotes"], lambda e: cat("  - ", e["text"], " （", src(e["source_content_indexes"]), "）")
            ),
        )

    empty = F.array().cast("array<string>")

    def viewpoint(v: Column, k: Column) -> Column:
        ix = v["source_content_indexes"]
        return F.concat(
            lines(
                "",
                cat("### 主要观点", (k + 1).cast("string"), "：", v["text"]),
                cat("**知识资产 ID：** ", ident(VIEWPOINT, v["text"], ix)),
                cat("**原文索引：** ", src(ix)),
                "**论据：**",
            ),
            bullets(ARGUMENT, v["arguments"]),
            F.when(v["case"].isNotNull(), F.concat(lines("", "**案例故事：**"), case_lines(v["case"]))).otherwise(empty),
        )

    def subtopic(s: Column) -> Column:
        return F.concat(
            lines("", cat("## 子主题：", s["title"])),
            F.flatten(
                F.transform(
                    s["definitions"],
                    lambda d: lines(
                        "",
                        "### 概念定义",
                        cat("**知识资产 ID：** ", ident(CONCEPT, d["definition"], d["source_content_indexes"])),
                        cat("**原文索引：** ", src(d["source_content_indexes"])),
                        cat("**", d["name"], "：** ", d["definition"]),
                    ),
                )
            ),
            F.when(F.size(s["quotes"]) > 0, F.concat(lines("", "### 金句"), bullets(QUOTE, s["quotes"]))).otherwise(empty),
            F.flatten(F.transform(s["viewpoints"], viewpoint)),
            F.when(
                F.size(s["orphan_arguments"]) > 0,
                F.concat(lines("", "### 独立保留的论据（所属观点未通过原文校验）"), bullets(ARGUMENT, s["orphan_arguments"])),
            ).otherwise(empty),
            F.when(
                F.size(s["orphan_cases"]) > 0,
                F.concat(
                    lines("", "### 独立保留的案例（所属观点未通过原文校验）"),
                    F.flatten(F.transform(s["orphan_cases"], case_lines)),
                ),
            ).otherwise(empty),
        )

    head = lines(cat("# ", valid["chapter_title"]), cat("**章节主题：** ", valid["chapter_theme"]))
    return F.array_join(F.concat(head, F.flatten(F.transform(valid["subtopics"], subtopic))), "\n")


def render_compact(validated: DataFrame, active: DataFrame) -> DataFrame:
    """Shorter chapter Markdown: active cards only, no arguments, one-line bodies."""
    cards = derive_cards(validated).filter(F.col("kind") != ARGUMENT)
    live = cards.join(active.select("card_id").distinct(), "card_id", "left_semi")
    ids = live.groupBy("analysis_id").agg(F.collect_set("card_id").alias("_live"))
    rows = validated.join(ids, "analysis_id", "left").withColumn("_live", F.coalesce("_live", F.array().cast("array<string>")))

    def entry(kind: str, label: Column, body: Column, ix: Column) -> Column:
        return X.let(
            X.card_id(X.card_key(F.col("book_id"), F.lit(kind), body, ix)),
            lambda i: F.when(
                F.array_contains("_live", i),
                F.concat(
                    F.lit(f"- [{kind}] "), label, F.lit("："), X.collapse_ws(body),
                    F.lit("\n  - 知识资产 ID："), i, F.lit("\n  - 原文索引："), F.array_join(ix, "、"),
                ),
            ),
        )

    def case_entry(c: Column) -> Column:
        return F.when(c.isNotNull(), entry(CASE, F.lit(CASE), case_body(c), c["source_content_indexes"]))

    def per_sub(s: Column) -> Column:
        parts = F.concat(
            F.array(F.concat(F.lit("\n## 子主题："), s["title"])),
            F.transform(s["definitions"], lambda d: entry(CONCEPT, d["name"], d["definition"], d["source_content_indexes"])),
            F.transform(s["quotes"], lambda q: entry(QUOTE, F.lit(QUOTE), q["text"], q["source_content_indexes"])),
            F.flatten(
                F.transform(
                    s["viewpoints"],
                    lambda v: F.array(
                        entry(VIEWPOINT, F.lit("主要观点"), v["text"], v["source_content_indexes"]), case_entry(v["case"])
                    ),
                )
            ),
            F.transform(s["orphan_cases"], case_entry),
        )
        return F.filter(parts, lambda x: x.isNotNull())

    head = F.array(
        F.concat(F.lit("# "), F.col("valid.chapter_title")), F.concat(F.lit("**章节主题：** "), F.col("valid.chapter_theme"))
    )
    text = F.array_join(F.concat(head, F.flatten(F.transform("valid.subtopics", per_sub))), "\n")
    return rows.withColumn("compact_markdown", text).drop("_live")


# Rule-based cards and relations ------------------------------------------------


def rule_based_cards(sections: DataFrame, terminators: str = X.TERMINATORS, words: tuple[str, ...] = X.CASE_TITLE_WORDS) -> DataFrame:
    """Viewpoint, quote and case cards of article sections without any model."""
    body = X.strip(F.col("content"))
    usable = sections.filter(F.col("kind").isin("article", "section") & (body != "")).withColumn("_b", body)
    quote = X.first_quote(F.col("_b"), terminators=terminators.replace("!", "").replace("?", ""))
    candidates = F.array(
        F.struct(F.lit(VIEWPOINT).alias("kind"), F.col("title"), X.extract_sentence(F.col("_b"), terminators=terminators).alias("body")),
        F.struct(F.lit(QUOTE).alias("kind"), F.concat("title", F.lit(" · 摘录")).alias("title"), quote.alias("body")),
        F.struct(
            F.lit(CASE).alias("kind"), F.col("title"), F.when(X.title_flag(F.col("title"), words), X.excerpt(F.col("_b"), 420)).alias("body")
        ),
    )
    kept = F.filter(candidates, lambda c: c["body"].isNotNull())
    return unnest(usable, ["book_id", "section_id"], kept, "c").select("book_id", "section_id", "c.*")


RELATION_SCHEMA = "struct<relationships:array<struct<characters:array<string>,relationship:string,evidence:string>>>"


def parse_relationships(raw: Column) -> Column:
    """Texts of extracted character relations; null if any item is unusable."""
    data = F.from_json(X.strip_code_fence(raw), RELATION_SCHEMA)
    filled = lambda c: c.isNotNull() & (X.strip(c) != "")

    def good(item: Column) -> Column:
        return (
            item["characters"].isNotNull()
            & F.forall(item["characters"], filled)
            & filled(item["relationship"])
        )

    def shown(item: Column) -> Column:
        names = F.array_join(F.transform(item["characters"], X.strip), "、")
        why = F.when(filled(item["evidence"]), F.concat(F.lit("（依据："), X.strip(item["evidence"]), F.lit("）"))).otherwise(F.lit(""))
        return F.concat(names, F.lit("："), X.strip(item["relationship"]), why)

    items = data["relationships"]
    return F.when(items.isNotNull() & F.forall(items, lambda i: F.coalesce(good(i), F.lit(False))), F.transform(items, shown))


def replace_relationships(old: DataFrame, fresh: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Relation cards after a run: replaced for succeeded sections, kept elsewhere.

    old/fresh(section_id, ...); succeeded(section_id).
    """
    kept = old.join(succeeded.select("section_id"), "section_id", "left_anti")
    added = fresh.join(succeeded.select("section_id"), "section_id", "left_semi")
    return kept.unionByName(added)


def relationship_targets(sections: DataFrame, done: DataFrame) -> DataFrame:
    """Sections still to be extracted."""
    return sections.join(done.select("section_id"), "section_id", "left_anti")


def mind_map(sections: DataFrame, per_theme: int = 8) -> DataFrame:
    """Lines of a theme/article outline: (book_id, position, sub_position, line)."""
    from .versions import topk_per_parent

    themes = sections.filter(F.col("level") == 3)
    lines = themes.select("book_id", "position", F.lit(0).cast("bigint").alias("sub_position"), F.concat(F.lit("- "), "title").alias("line"))
    first = topk_per_parent(
        sections.filter(F.col("level") == 4).select("book_id", F.col("parent_id").alias("theme_id"), "position", "title", "section_id"),
        ["book_id", "theme_id"],
        ["position", "section_id"],
        per_theme,
    )
    articles = first.join(
        themes.select("book_id", F.col("section_id").alias("theme_id"), F.col("position").alias("_p")), ["book_id", "theme_id"]
    ).select("book_id", F.col("_p").alias("position"), F.col("rank").cast("bigint").alias("sub_position"), F.concat(F.lit("  - "), "title").alias("line"))
    return lines.unionByName(articles)


def revalidate(partial: DataFrame, fragments: DataFrame, links: DataFrame) -> DataFrame:
    """Re-check stored partial analyses: upgraded only if clean and the card set is unchanged.

    partial(analysis_id, book_id, root_section_id, set_id, status, data) is the
    newest analysis per root; links(analysis_id, card_id) is what it published.
    """
    from .sets import differing_groups

    todo = partial.filter(F.col("status") == "partial")
    first = F.get("issues", F.lit(0))["error"].alias("_first")
    checked = validate(resolve(todo, fragments)).select("analysis_id", "book_id", "root_section_id", "homes", "valid", "rejected_reason", "invalid_item_count", first)
    checked = cut_lineage(checked)  # cards and verdict read it
    cards = derive_cards(checked).select("analysis_id", "card_id")
    diff = differing_groups(cards, links.join(todo.select("analysis_id"), "analysis_id", "left_semi"), ["analysis_id"], "card_id")
    verdict = checked.join(diff, "analysis_id", "left")
    clean = F.col("rejected_reason").isNull() & (F.col("invalid_item_count") == 0)
    same = (F.col("only_left") == 0) & (F.col("only_right") == 0)
    done = verdict.select(
        "analysis_id",
        F.when(clean & F.coalesce(same, F.lit(False)), "upgraded").otherwise("failed").alias("outcome"),
        F.when(~clean, F.coalesce("rejected_reason", "_first"))
        .when(~F.coalesce(same, F.lit(False)), F.lit("重新校验后的知识资产集合与当前部分版本不一致，为保护历史数据已停止升级"))
        .alias("error"),
    )
    out = partial.select("analysis_id", "book_id", "root_section_id").join(done, "analysis_id", "left")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))
