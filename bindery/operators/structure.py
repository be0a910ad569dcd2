"""Heading scan, section trees and their edits.

Everything about one text happens inside the row that holds it (higher-order
functions, no shuffle). Operators over section tables use aggregates, equi
joins and `ordered.running`, so a book may hold any share of the rows.

Section columns: book_id, section_id, parent_id, level, position, title,
content, kind, status, analysis_enabled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import packing, text as X
from ..ordered import position_block, running
from ..rows import unnest
from ..session import cut_lineage

HEADING = r"(?Ud)^(#{1,6})\s+(.+?)\s*$"

# Titles that never name a book, and the chapter filters.
GENERIC_TITLES = ("正文", "目录")
INCLUDE_TITLE = (
    r"^(序言|序|前言|前记|导言|导论|引言|绪论|"
    r"第[一二三四五六七八九十百千万零〇\d]+[章节篇部卷]|附录|后记|结语)"
)
EXCLUDE_TITLE = (
    r"(目录|版权|出版说明|版权页|数据来源|资料来源|表下注|表格说明|"
    r"各栏|注[:：]|ISBN|CIP)"
)
REASON_EXCLUDED = "疑似目录、版权或表格注释"
REASON_SENTENCE = "疑似正文注释或误识别标题"
REASON_SHORT = "正文过短，疑似异常一级标题"


def heading_lines(text: Column) -> Column:
    """array<struct<line, level, title>> of heading lines, 0-based."""

    def read(line: Column, at: Column) -> Column:
        return X.let(
            X.strip(line),
            lambda s: F.when(
                F.regexp_like(s, F.lit(HEADING)),
                F.struct(
                    at.cast("int").alias("line"),
                    F.length(F.regexp_extract(s, HEADING, 1)).alias("level"),
                    X.strip(F.regexp_extract(s, HEADING, 2)).alias("title"),
                ),
            ),
        )

    return F.filter(F.transform(F.split(text, "\n"), read), lambda h: h.isNotNull())


def file_stem(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/]*)\z", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*\z", "")


def book_title(headings: Column, filename: Column) -> Column:
    first = F.get(headings, F.lit(0))
    named = (first["level"] == 1) & ~first["title"].isin(*GENERIC_TITLES)
    return F.when(named, first["title"]).otherwise(file_stem(filename))


def parent_indexes(levels: Column) -> Column:
    """Index of the nearest earlier element of smaller level, -1 if none."""
    names = [f"l{k}" for k in range(1, 7)]
    zero = F.struct(
        *[F.lit(-1).alias(n) for n in names], F.lit(-1).alias("at"), F.lit(-1).alias("parent")
    )

    def step(s: Column, level: Column) -> Column:
        at = s["at"] + 1
        above = [F.when(level > k, s[f"l{k}"]).otherwise(F.lit(-1)) for k in range(1, 7)]
        return F.struct(
            *[F.when(level == k, at).otherwise(s[f"l{k}"]).alias(f"l{k}") for k in range(1, 7)],
            at.alias("at"),
            F.greatest(*above).alias("parent"),
        )

    return packing.scan(levels, zero, step, lambda s: s["parent"], "int")


def section_kind(level: Column) -> Column:
    return F.when(level >= 4, F.lit("article")).otherwise(F.lit("theme"))


def parse_books(books: DataFrame, *, include_segments: bool = True) -> DataFrame:
    """(book_id, filename, text) to one row per section, without a shuffle.

    Long level-4+ bodies additionally come as semantic segments unless
    `include_segments` is off.
    """
    normal = books.withColumn("_text", X.normalize_text(F.col("text")))
    found = normal.withColumn("_found", heading_lines(F.col("_text")))
    titled = found.withColumn("book_title", book_title(F.col("_found"), F.col("filename")))
    bare = F.size("_found") == 0
    ready = titled.select(
        "book_id",
        "filename",
        "book_title",
        F.split("_text", "\n").alias("_lines"),
        F.when(
            bare,
            F.array(
                F.struct(F.lit(-1).alias("line"), F.lit(1).alias("level"), F.col("book_title").alias("title"))
            ),
        ).otherwise(F.col("_found")).alias("_heads"),
    )
    linked = ready.withColumn(
        "_parents", parent_indexes(F.transform("_heads", lambda h: h["level"]))
    )

    def section(h: Column, k: Column) -> Column:
        nxt = F.coalesce(F.get(F.col("_heads"), k + 1)["line"], F.size("_lines"))
        body = F.array_join(F.slice("_lines", h["line"] + 2, nxt - h["line"] - 1), "\n")
        up = F.get(F.col("_parents"), k)
        parent = F.get(F.col("_heads"), up)
        return F.struct(
            h["level"].alias("level"),
            k.cast("bigint").alias("position"),
            h["title"].alias("title"),
            X.strip(body).alias("content"),
            up.alias("up"),
            parent["level"].alias("up_level"),
            parent["title"].alias("up_title"),
        )

    rows = unnest(linked, ["book_id", "filename", "book_title"], F.transform("_heads", section), "s").select(
        "book_id", "filename", "book_title", "s.*"
    )
    sections = rows.select(
        "book_id",
        "book_title",
        X.stable_id("section", F.col("filename"), F.col("level"), F.col("position"), F.col("title")).alias("section_id"),
        F.when(
            F.col("up") >= 0,
            X.stable_id("section", F.col("filename"), F.col("up_level"), F.col("up"), F.col("up_title")),
        ).alias("parent_id"),
        "level",
        "position",
        "title",
        "content",
        section_kind(F.col("level")).alias("kind"),
    )
    if not include_segments:
        return sections
    return with_segments(sections)


def with_segments(sections: DataFrame) -> DataFrame:
    """Each section followed by its semantic segments, in one pass over the rows."""
    long = (F.col("level") >= 4) & (F.length("content") > packing.SEGMENT_TRIGGER)
    pieces = F.when(long, packing.semantic_chunks(F.col("content"))).otherwise(F.array().cast("array<string>"))
    listed = sections.withColumn("_pieces", F.concat(F.array(F.col("content")), pieces))
    out = unnest(listed, sections.columns, "_pieces", "_body", "_no")
    is_segment = F.col("_no") > 0
    replaced = {
        "section_id": F.when(is_segment, X.stable_id("segment", F.col("section_id"), F.col("_no"))).otherwise(
            F.col("section_id")
        ),
        "parent_id": F.when(is_segment, F.col("section_id")).otherwise(F.col("parent_id")),
        "level": F.when(is_segment, F.least(F.col("level") + 1, F.lit(6))).otherwise(F.col("level")),
        "position": F.when(is_segment, F.col("position") * 1000 + F.col("_no")).otherwise(F.col("position")),
        "title": F.when(is_segment, F.concat_ws(" · ", F.col("title"), F.col("_no").cast("string"))).otherwise(
            F.col("title")
        ),
        "content": F.col("_body"),
        "kind": F.when(is_segment, F.lit("semantic_segment")).otherwise(F.col("kind")),
    }
    return out.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in sections.columns])


def parse_diagnostics(books: DataFrame, sections: DataFrame) -> DataFrame:
    """Per-book counts; one aggregate over sections joined to per-text counts."""
    counted = sections.groupBy("book_id").agg(
        F.count_if(F.col("kind") != "semantic_segment").alias("heading_count"),
        F.count_if((F.col("level") == 3) & (F.col("kind") != "semantic_segment")).alias("h3_count"),
        F.count_if((F.col("level") == 4) & (F.col("kind") != "semantic_segment")).alias("h4_count"),
        F.count_if(F.col("kind") == "semantic_segment").alias("semantic_segments"),
    )
    texts = books.select(
        "book_id",
        X.restored_newlines(F.col("text")).alias("literal_newlines_restored"),
        X.footnote_markers(X.normalize_text(F.col("text"))).alias("footnote_markers"),
    )
    return texts.join(counted, "book_id")


def heading_parent(sections: DataFrame) -> DataFrame:
    """Parent of each section from level and order alone, for sections held as rows.

    Six carried-forward values (the last section of each level) replace a
    stack; the nearest one above wins.
    """
    last = {f"_l{k}": F.when(F.col("level") == k, F.struct("position", "section_id")) for k in range(1, 7)}
    carried = running(
        sections, ["book_id"], ["position"], position_block(F.col("position")), before=last
    )
    above = [F.when(F.col("level") > k, F.col(f"_l{k}")) for k in range(1, 6)]
    nearest = F.greatest(*above)
    return carried.withColumn("computed_parent", nearest["section_id"]).drop(*last)


def lineage(sections: DataFrame) -> DataFrame:
    """Adds root_id, ancestors (root first, self last) and section_path titles.

    By pointer doubling: each round a section takes over the ancestors that
    the topmost one it knows has found, so a tree of any depth is done in as
    many rounds as its depth has binary digits, one equi join each. Only
    sections that are not done are joined, so none pile up on a null key. A
    chain that comes back to itself ends there; its sections then have no root
    but the one before the loop.
    """
    state = cut_lineage(
        sections.select("book_id", "section_id", F.col("parent_id").alias("_up"), F.array("section_id").alias("ancestors"), F.array("title").alias("section_path"))
    )
    while not state.filter(F.col("_up").isNotNull()).isEmpty():
        above = state.select(
            F.col("book_id").alias("_b"), F.col("section_id").alias("_id"), F.col("_up").alias("_next"), F.col("ancestors").alias("_more"), F.col("section_path").alias("_titles")
        )
        open_ = state.filter(F.col("_up").isNotNull()).join(above, (F.col("book_id") == F.col("_b")) & (F.col("_up") == F.col("_id")), "left")
        # Of what lies above, nearest last, only that behind the last section already known is new.
        seen = F.arrays_overlap("_more", "ancestors")
        known = F.transform("_more", lambda x: F.array_contains("ancestors", x))
        kept = F.when(seen, F.array_position(F.reverse(known), F.lit(True)).cast("int") - 1).otherwise(F.size("_more"))
        tail = lambda c: F.slice(c, F.size("_more") - kept + 1, kept)
        found = F.col("_id").isNotNull()
        grown = open_.select(
            "book_id", "section_id", F.when(~F.coalesce(seen, F.lit(False)), F.col("_next")).alias("_up"),
            F.when(found, F.concat(tail("_more"), "ancestors")).otherwise(F.col("ancestors")).alias("ancestors"),
            F.when(found, F.concat(tail("_titles"), "section_path")).otherwise(F.col("section_path")).alias("section_path"),
        )
        state = cut_lineage(state.filter(F.col("_up").isNull()).unionByName(grown))
    return state.select(
        "book_id", "section_id", F.get("ancestors", F.lit(0)).alias("root_id"), "ancestors", "section_path"
    )


def subtree_size(sections: DataFrame) -> DataFrame:
    """(book_id, section_id, subtree_chars, cyclic): own body plus titles and bodies of all descendants.

    By pointer doubling: after k rounds a section holds the sum of all that
    lies less than 2^k levels below it and points 2^k levels up; one round
    adds its sum to the section it points to and takes over that one's
    pointer. Each round is a sum with map-side combine and a join over narrow
    rows, as many rounds as the depth has binary digits. Sections that stand
    below themselves are marked cyclic and have no size; those hanging from
    them have.
    """
    titled = F.coalesce(F.length("title"), F.lit(0))
    weight = F.coalesce(F.length(X.strip(F.col("content"))), F.lit(0)) + titled
    key = ["book_id", "section_id"]
    state = cut_lineage(sections.select(*key, F.col("parent_id").alias("_up"), weight.cast("bigint").alias("_sum"), titled.alias("_title")))
    total, reach = state.count(), 1
    pointing = state.filter(F.col("_up").isNotNull())
    while reach <= total and not pointing.isEmpty():
        added = pointing.groupBy("book_id", F.col("_up").alias("section_id")).agg(F.sum("_sum").alias("_add"))
        tops = state.select("book_id", F.col("section_id").alias("_up"), F.col("_up").alias("_next"))
        moved = pointing.join(tops, ["book_id", "_up"]).filter(F.col("_next").isNotNull()).select(*key, "_next")
        state = state.join(added, key, "left").join(moved, key, "left")
        state = cut_lineage(state.select(*key, F.col("_next").alias("_up"), (F.col("_sum") + F.coalesce("_add", F.lit(0))).alias("_sum"), "_title"))
        pointing, reach = state.filter(F.col("_up").isNotNull()), 2 * reach
    # A pointer that goes further up than there are sections ends on a loop.
    looped = pointing.select("book_id", F.col("_up").alias("section_id"), F.lit(True).alias("_loop")).distinct()
    marked = state.join(looped, key, "left")
    return marked.select(*key, F.when(F.col("_loop").isNull(), F.col("_sum") - F.col("_title")).alias("subtree_chars"), F.col("_loop").isNotNull().alias("cyclic"))


def candidate_verdict(
    title: Column, size: Column, include: str = INCLUDE_TITLE, exclude: str = EXCLUDE_TITLE, minimum: int = 500
) -> Column:
    """Reason for not analysing a root section; empty text means keep."""
    flat = X.collapse_ws(title)
    named = F.regexp_like(flat, F.lit(f"(?U){include}"))
    return (
        F.when(F.regexp_like(flat, F.lit(exclude)), F.lit(REASON_EXCLUDED))
        .when(~named & ((F.length(flat) > 36) | F.regexp_like(flat, F.lit(r"[。；;]\z"))), F.lit(REASON_SENTENCE))
        .when((size < minimum) & ~named, F.lit(REASON_SHORT))
        .otherwise(F.lit(""))
    )


def analysis_candidates(sections: DataFrame, include: str = INCLUDE_TITLE, exclude: str = EXCLUDE_TITLE) -> DataFrame:
    """Keep/reject verdict with reason for every root; manual choices stay as they are."""
    sizes = subtree_size(sections)
    roots = sections.filter(F.col("parent_id").isNull()).join(sizes, ["book_id", "section_id"])
    judged = roots.withColumn("reason", candidate_verdict(F.col("title"), F.col("subtree_chars"), include, exclude))
    if "selection_source" in sections.columns:
        manual = F.col("selection_source") != "auto"
        judged = judged.withColumn("reason", F.when(manual, F.lit("")).otherwise(F.col("reason"))).withColumn(
            "selected", F.when(manual, F.col("analysis_enabled")).otherwise(F.col("reason") == "")
        )
    else:
        judged = judged.withColumn("selected", F.col("reason") == "")
    return judged


def split_by_anchors(content: Column, anchors: Column) -> Column:
    """array<struct<title, content>> cut at located anchors; unlocated ones are dropped.

    `anchors` is array<struct<title, sentence>>.
    """
    from .. functions.anchors import find_anchor

    located = F.filter(
        F.transform(
            anchors,
            lambda a: F.struct(
                find_anchor(content, X.strip(a["sentence"]))["offset"].alias("at"),
                a["title"].alias("title"),
                a["sentence"].alias("sentence"),
            ),
        ),
        lambda a: a["at"] >= 0,
    )
    return X.let(
        F.array_sort(located),
        lambda s: F.transform(
            s,
            lambda a, k: F.struct(
                a["title"].alias("title"),
                X.strip(
                    F.substring(
                        content,
                        a["at"] + 1,
                        F.coalesce(F.get(s, k + 1)["at"], F.length(content)) - a["at"],
                    )
                ).alias("content"),
            ),
        ),
    )


def toc_child_titles(content: Column, chapter: Column) -> Column:
    """Titles below a chapter in the table of contents, up to its next peer."""
    start, end = F.instr(content, F.lit("# 目录")), F.instr(content, F.lit("# 正文"))
    toc = X.strip(F.substring(content, start, end - start))
    marks = F.transform(
        F.filter(F.transform(F.split(toc, "\n"), X.strip), lambda s: s.startswith("#")),
        lambda s: F.struct(
            F.length(F.regexp_extract(s, "^(#+)", 1)).alias("level"),
            F.regexp_replace(s, r"(?U)^#+\s+", "").alias("title"),
            F.regexp_like(s, F.lit(r"(?U)^#{1,6}\s")).alias("heading"),
        ),
    )

    def below(m: Column) -> Column:
        own = F.array_position(F.transform(m, lambda x: x["heading"] & (x["title"] == chapter)), F.lit(True))
        level = F.get(m, (own - 1).cast("int"))["level"]
        rest = F.slice(m, own.cast("int") + 1, F.size(m))
        stop = F.array_position(F.transform(rest, lambda x: x["level"] <= level), F.lit(True)).cast("int")
        kept = F.when(stop > 0, F.slice(rest, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
        return F.when(own > 0, F.transform(kept, lambda x: x["title"])).otherwise(F.array().cast("array<string>"))

    return F.when((start > 0) & (end > 0), X.let(marks, below)).otherwise(F.array().cast("array<string>"))


def split_narrative_chapters(content: Column) -> Column:
    """array<struct<number, title, body>> of the level-1 chapters of a narrative text."""
    parts = F.filter(F.transform(F.split(content, r"\n(?=# [^#])"), X.strip), lambda p: p.startswith("#"))

    def chapter(p: Column) -> Column:
        line = F.get(F.filter(F.split(p, "\n"), lambda x: x.startswith("# ")), F.lit(0))
        return X.let(
            X.strip(F.substring(line, F.lit(3), F.length(line))),
            lambda t: F.when(
                t != "", F.struct(X.chapter_number(t).alias("number"), t.alias("title"), p.alias("body"))
            ),
        )

    return F.filter(F.transform(parts, chapter), lambda c: c.isNotNull())


def narrative_quotes(block: Column) -> Column:
    section = F.regexp_extract(block, r"(?sd)### 金句\n(.*?)(?=### |## |\z)", 1)
    return F.transform(F.regexp_extract_all(section, F.lit(r"(?md)^- (.+)$"), 1), X.strip)


def narrative_relations(chapter: Column) -> Column:
    section = F.regexp_extract(chapter, r"(?sd)## 人物关系\n(.*?)(?=## 子主题|# |\z)", 1)
    pattern = r"- ([^：:]+)：([^\n]*(?:\n(?!- )[^\n]*)*)"
    people = F.regexp_extract_all(section, F.lit(pattern), 1)
    texts = F.regexp_extract_all(section, F.lit(pattern), 2)
    return F.zip_with(
        people,
        texts,
        lambda p, t: F.struct(
            X.strip(p).alias("character"), F.replace(X.strip(t), F.lit("\n"), F.lit(" ")).alias("relationship")
        ),
    )


def narrative_events(block: Column) -> Column:
    """array<struct<event_title, event_background, event_process, event_impact>>."""
    pattern = r"(?sd)### 事件\d+：([^\n]+)\n(.*?)(?=### |## |\z)"
    titles = F.regexp_extract_all(block, F.lit(pattern), 1)
    bodies = F.regexp_extract_all(block, F.lit(pattern), 2)
    bullet = F.lit(r"(?sd)- (.*?)(?=\n- |\z)")

    def event(t: Column, b: Column) -> Column:
        background = X.strip(F.regexp_extract(b, r"(?sd)\*\*事件背景：\*\*\s*(.*?)(?=\n\*\*事件经过：\*\*|\z)", 1))
        process = X.strip(F.regexp_extract(b, r"(?sd)\*\*事件经过：\*\*\s*(.*?)(?=\n\*\*事件影响：\*\*|\z)", 1))
        has_impact = F.regexp_like(b, F.lit(r"\*\*事件影响：\*\*"))
        impact = X.strip(F.regexp_extract(b, r"(?sd)\*\*事件影响：\*\*\s*(.*?)(?=\n\n|### |## |\z)", 1))
        items = lambda c: F.transform(F.regexp_extract_all(c, bullet, 1), X.strip)
        return F.struct(
            X.strip(t).alias("event_title"),
            background.alias("event_background"),
            items(process).alias("event_process"),
            F.when(~has_impact, F.array().cast("array<string>"))
            .when(F.regexp_like(impact, F.lit("(?m)^- ")), items(impact))
            .otherwise(F.array(impact))
            .alias("event_impact"),
        )

    return F.zip_with(titles, bodies, event)


def narrative_subtopics(chapter: Column, theme: Column, given: Column) -> Column:
    """Subtopic blocks of a chapter; given titles override parsed ones by position.

    Without given titles there is one block named 无; with given titles but
    no marks, every title gets the whole chapter.
    """
    marks = F.regexp_extract_all(chapter, F.lit("## 子主题：([^\n]+)"), 1)
    blocks = F.slice(F.split(chapter, "(?=## 子主题：[^\n])"), F.lit(2), F.greatest(F.size(marks), F.lit(1)))
    titles = F.coalesce(given, F.array().cast("array<string>"))

    def subtopic(name: Column, block: Column) -> Column:
        return F.struct(
            name.alias("subtopic_title"),
            F.concat(F.lit("章节："), theme, F.lit(" 子主题："), name).alias("content_index"),
            narrative_quotes(block).alias("golden_quotes"),
            narrative_events(block).alias("events"),
        )

    by_mark = F.transform(
        F.slice(blocks, F.lit(1), F.size(marks)),
        lambda b, k: subtopic(
            F.coalesce(
                F.when(F.trim(F.get(titles, k)) != "", F.get(titles, k)),
                X.nonblank(F.get(marks, k)),
                F.concat(F.lit("子主题"), (k + 1).cast("string")),
            ),
            b,
        ),
    )
    by_title = F.transform(F.filter(titles, lambda t: X.strip(t) != ""), lambda t: subtopic(t, chapter))
    return (
        F.when(F.size(titles) == 0, F.array(subtopic(F.lit("无"), chapter)))
        .when(F.size(marks) == 0, by_title)
        .otherwise(by_mark)
    )


# Edits over many sections at once ------------------------------------------


def renumber(sections: DataFrame, block: Column | None = None) -> DataFrame:
    """Rewrite positions as 0, 1, 2, … in reading order."""
    block = position_block(F.col("position")) if block is None else block
    numbered = running(sections, ["book_id"], ["position", "section_id"], block, number="_no")
    return numbered.withColumn("position", F.col("_no") - 1).drop("_no")


def split_section_half(sections: DataFrame, chosen: Column) -> DataFrame:
    """Halve chosen level-4 sections by paragraphs, then renumber the book."""
    pieces = F.filter(F.split("content", "\n+"), lambda p: p != "")
    listed = sections.withColumn("_p", pieces)
    able = chosen & (F.col("level") == 4) & (F.length("content") >= 200) & (F.size("_p") >= 2)
    half = F.ceil(F.size("_p") / 2).cast("int")
    first = F.array_join(F.slice("_p", F.lit(1), half), "\n\n")
    second = F.array_join(F.slice("_p", half + 1, F.greatest(F.size("_p") - half, F.lit(0))), "\n\n")
    parts = F.when(
        able,
        F.array(
            F.struct(F.lit(0).alias("no"), first.alias("body")),
            F.struct(F.lit(1).alias("no"), second.alias("body")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("no"), F.col("content").alias("body"))))
    out = unnest(listed, sections.columns, parts, "_x")
    tail = F.col("_x.no") == 1
    replaced = {
        "section_id": F.when(tail, X.stable_id("split", F.col("section_id"))).otherwise(F.col("section_id")),
        "title": F.when(tail, F.concat("title", F.lit("（续）"))).otherwise(F.col("title")),
        "content": F.col("_x.body"),
        "position": F.col("position") * 2 + F.col("_x.no"),
    }
    if "status" in sections.columns:
        replaced["status"] = F.when(tail, F.lit("draft")).otherwise(F.col("status"))
    halves = out.select(*[replaced[c].alias(c) if c in replaced else F.col(c) for c in sections.columns])
    return renumber(halves)


def _neighbours(sections: DataFrame) -> DataFrame:
    """Adds the previous structural section (level ≤ 4) of each structural row."""
    packed = F.struct("position", "section_id", "level")
    return running(
        sections.filter(F.col("level") <= 4),
        ["book_id"],
        ["position", "section_id"],
        position_block(F.col("position")),
        before={"_prev": packed},
    )


def merge_with_previous(sections: DataFrame, chosen: Column) -> DataFrame:
    """Append chosen sections to their previous same-level neighbour.

    The edit is one step for all chosen rows: a section whose neighbour is
    itself merged away is left for a later call.
    """
    near = _neighbours(sections.withColumn("_chosen", chosen))
    able = near.filter(F.col("_chosen") & (F.col("_prev.level") == F.col("level")))
    edges = able.select(
        "book_id", F.col("section_id").alias("_gone"), F.col("_prev.section_id").alias("_into"), "title", "content"
    )
    gone = edges.select("book_id", F.col("_gone").alias("_into"))
    edges = edges.join(gone, ["book_id", "_into"], "left_anti")
    extra = edges.select(
        "book_id",
        F.col("_into").alias("section_id"),
        F.concat(F.lit("\n\n"), F.col("title"), F.lit("\n"), F.col("content")).alias("_extra"),
    )
    moved = edges.select("book_id", F.col("_gone").alias("parent_id"), F.col("_into").alias("_new_parent"))
    kept = sections.join(
        edges.select("book_id", F.col("_gone").alias("section_id")), ["book_id", "section_id"], "left_anti"
    )
    merged = kept.join(extra, ["book_id", "section_id"], "left").join(moved, ["book_id", "parent_id"], "left")
    body = F.when(F.col("_extra").isNotNull(), X.strip(F.concat("content", "_extra"))).otherwise(F.col("content"))
    return merged.select(
        *[
            body.alias("content") if c == "content"
            else F.coalesce("_new_parent", "parent_id").alias("parent_id") if c == "parent_id"
            else F.col(c)
            for c in sections.columns
        ]
    )


def swap_with_previous(sections: DataFrame, chosen: Column) -> DataFrame:
    """Exchange the positions of chosen structural sections and their predecessors."""
    near = _neighbours(sections.withColumn("_chosen", chosen)).filter("_chosen and _prev is not null")
    ups = near.select("book_id", "section_id", F.col("_prev.position").alias("_p"))
    downs = near.select("book_id", F.col("_prev.section_id").alias("section_id"), F.col("position").alias("_p"))
    moves = ups.unionByName(downs).groupBy("book_id", "section_id").agg(F.min("_p").alias("_p"))
    out = sections.join(moves, ["book_id", "section_id"], "left")
    return out.withColumn("position", F.coalesce("_p", "position")).select(*sections.columns)
