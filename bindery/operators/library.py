"""Filters and counts over library tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .evidence import EVIDENCE_SCHEME


def confirmed_roots(sections: DataFrame) -> DataFrame:
    return sections.filter(
        F.col("parent_id").isNull() & (F.col("status") == "confirmed") & F.col("analysis_enabled")
    )


def article_sections(sections: DataFrame) -> DataFrame:
    return sections.filter(F.col("kind").isin("article", "section") & (X.strip(F.col("content")) != ""))


def active_evidence_cards(cards: DataFrame) -> DataFrame:
    return cards.filter((F.col("status") == "active") & (F.col("source_scheme") == EVIDENCE_SCHEME))


def structural_sections(sections: DataFrame) -> DataFrame:
    return sections.filter(F.col("level") <= 4)


def scope_match(a: Column, b: Column) -> Column:
    """Equal, or both absent."""
    return a.eqNullSafe(b)


def backfill_framework(framework: Column, title: Column) -> Column:
    template = F.concat(
        F.lit("围绕“"), title,
        F.lit("”展开：先说明本集要解决的问题，再梳理关联原文中的核心观点、事件或案例，最后总结其意义。"),
    )
    return F.when(F.trim(framework) == "", template).otherwise(framework)


def book_stats(sections: DataFrame, cards: DataFrame) -> DataFrame:
    """Section, theme, article and active-card counts per book, in one aggregate each."""
    counted = sections.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("sections"),
        F.count_if(F.col("level") == 3).alias("themes"),
        F.count_if(F.col("level") == 4).alias("articles"),
    )
    live = cards.filter(F.col("status") == "active").groupBy("book_id").agg(F.count(F.lit(1)).alias("cards"))
    return counted.join(live, "book_id", "left").withColumn("cards", F.coalesce("cards", F.lit(0)))


def cards_by_kind(cards: DataFrame) -> DataFrame:
    return cards.groupBy("kind").agg(F.count(F.lit(1)).alias("cards"))


def project_stats(episodes: DataFrame) -> DataFrame:
    done = F.col("status").isin("completed", "review", "approved")
    return episodes.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if(done).alias("completed"),
        F.bool_and(done).alias("all_done"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows breaking a uniqueness constraint; must be empty."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def material_sizes(materials: DataFrame, limit: int = 6_000) -> DataFrame:
    """Characters per prompt input and whether a preview would cut any of them."""
    return materials.groupBy("owner_id").agg(
        F.sum(F.length("value")).alias("characters"), F.bool_or(F.length("value") > limit).alias("truncated")
    )


def fragment_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments per set, or whatever `keys` name."""
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("fragments"))
