"""Reading loosely formed JSON as Columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import text as X

CHAPTERS = "struct<chapterContents:array<struct<title:string,content:string,sectionContents:array<struct<title:string,content:string>>>>>"
_SECTIONED = "struct<title:string,sectionContents:array<struct<section_title:string,first_sentence:string,title:string,content:string>>>"
_NARRATIVE = (
    "struct<book_analysis:struct<chapters:array<struct<"
    "chapter:struct<number:string,title:string,theme:string>,"
    "subtopics:array<struct<content_index:string,subtopic_title:string,"
    "main_viewpoints:array<struct<viewpoint:string>>,"
    "events:array<struct<event_title:string,event_background:string,event_process:array<string>,event_impact:array<string>>>>>>>>>"
)


def chapters(raw: Column) -> Column:
    """array of chapter structs; empty for unusable input."""
    listed = F.from_json(raw, CHAPTERS)["chapterContents"]
    filled = F.transform(
        listed,
        lambda c: F.struct(
            F.coalesce(c["title"], F.lit("")).alias("title"),
            F.coalesce(c["content"], F.lit("")).alias("content"),
            F.coalesce(c["sectionContents"], F.array().cast("array<struct<title:string,content:string>>")).alias("sectionContents"),
        ),
    )
    empty = F.array().cast("array<struct<title:string,content:string,sectionContents:array<struct<title:string,content:string>>>>")
    return F.coalesce(filled, empty)


def first_material(materials: Column, kind: str) -> Column:
    """Link of the first material of a kind, empty text if there is none."""
    hit = F.get(F.filter(materials, lambda m: m["materialType"] == kind), F.lit(0))
    return F.coalesce(hit["material"], F.lit(""))


def clean_chapter(raw: Column) -> Column:
    """Chapter struct of one model answer; null unless it has a title and sections."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)\A```json\s*", ""), r"\s*```\z", "")
    fixed = F.regexp_replace(X.strip(bare), r"\\\\n", r"\\n")
    parsed = F.from_json(fixed, _SECTIONED)
    return F.when(parsed["title"].isNotNull() & parsed["sectionContents"].isNotNull(), parsed)


def section_titles(raw: Column, given: Column) -> Column:
    """Titles listed inside a chapter JSON, else the given ones."""
    listed = F.from_json(raw, _SECTIONED)["sectionContents"]
    own = F.filter(F.transform(listed, lambda s: s["title"]), lambda t: t.isNotNull())
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.coalesce(given, F.array().cast("array<string>")))


def merged_chapters(items: Column) -> Column:
    """All chapters of an array of JSON answers, skipping unusable ones."""
    lists = F.transform(items, lambda s: F.from_json(X.strip(s), _NARRATIVE)["book_analysis"]["chapters"])
    return F.flatten(F.filter(lists, lambda c: c.isNotNull()))


def projected_chapters(merged: Column) -> Column:
    """Chapter title, subtopics, viewpoints and event outlines only."""
    na = F.lit("N/A")
    return F.transform(
        merged,
        lambda c: F.struct(
            F.coalesce(c["chapter"]["title"], na).alias("chapter_title"),
            F.transform(
                F.coalesce(c["subtopics"], F.array().cast(_SUBTOPICS)),
                lambda s: F.struct(
                    F.coalesce(s["content_index"], na).alias("content_index"),
                    F.coalesce(s["subtopic_title"], na).alias("subtopic_title"),
                    F.transform(
                        F.coalesce(s["main_viewpoints"], F.array().cast("array<struct<viewpoint:string>>")),
                        lambda v: F.struct(F.coalesce(v["viewpoint"], na).alias("viewpoint")),
                    ).alias("viewpoints"),
                    F.transform(
                        F.coalesce(s["events"], F.array().cast(_EVENTS)),
                        lambda e: F.struct(
                            F.coalesce(e["event_title"], na).alias("event_title"),
                            F.coalesce(e["event_process"], F.array().cast("array<string>")).alias("event_process"),
                        ),
                    ).alias("events"),
                ),
            ).alias("subtopics"),
        ),
    )


_EVENTS = "array<struct<event_title:string,event_background:string,event_process:array<string>,event_impact:array<string>>>"
_SUBTOPICS = (
    "array<struct<content_index:string,subtopic_title:string,"
    f"main_viewpoints:array<struct<viewpoint:string>>,events:{_EVENTS}>>"
)


_SPLIT = T.ArrayType(
    T.StructType([T.StructField("character_relationships", T.StringType()), T.StructField("rest", T.StringType())])
)


@F.pandas_udf(_SPLIT)
def split_concatenated(raw: pd.Series) -> pd.Series:
    """Each JSON object of a run-together string, its relations split off.

    Reading stops at the first malformed object; there is no built-in
    expression that tells where a JSON value ends.
    """
    decoder = json.JSONDecoder()

    def read(text: str | None) -> list[dict[str, str]]:
        out, at = [], 0
        while text and at < len(text):
            try:
                value, at = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                break
            relations = value.pop("character_relationships", []) if isinstance(value, dict) else []
            out.append(
                {
                    "character_relationships": json.dumps(relations, ensure_ascii=False),
                    "rest": json.dumps(value, ensure_ascii=False),
                }
            )
        return out

    return raw.map(read)
