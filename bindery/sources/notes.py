"""Writing libraries and exporting Markdown notes.

Note frames are (path, body) rows; every note is one row of bounded content
(a section, a fragment, a card, an episode text). Listings that grow with a
book or a fragment's fame come in numbered parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..ordered import assemble

SYSTEM_BEGIN, SYSTEM_END = "<!-- GENERATED:BEGIN -->", "<!-- GENERATED:END -->"
USER_BEGIN, USER_END = "<!-- USER_NOTES:BEGIN -->", "<!-- USER_NOTES:END -->"

# Folder and file names of the exported vault.
BOOKS, PROJECTS = "01_书籍", "02_内容项目"
KIND_FOLDERS = {"观点": "02_知识点", "论据": "02_知识点", "概念": "02_知识点", "案例": "03_案例", "金句": "04_金句"}
STAGE_LABELS = {"outline": "声音细纲", "draft": "声音初稿", "final": "声音终稿"}


def write_library(df: DataFrame, path: str, key: str = "book_id", buckets: int = 256) -> None:
    """Append-safe partitioned write: only the partitions present are replaced."""
    bucketed = df.withColumn("book_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    (
        bucketed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", 1_000_000)
        .partitionBy("book_bucket")
        .parquet(path)
    )


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def note_name(title: Column, ident: Column) -> Column:
    """A readable name that no other id shares."""
    return _cat(X.safe_name(title), "__", ident)


# Album export ---------------------------------------------------------------


def album_lines(projects: DataFrame, episodes: DataFrame, finals: DataFrame) -> DataFrame:
    """(project_id, position, episode_id, line) of an album of final texts."""
    title = F.coalesce(F.nullif(X.collapse_ws(F.col("title")), F.lit("")), F.lit("未命名专辑"))
    # One aggregate answers "has episodes" without gathering them.
    has = episodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    heads = projects.join(has, "project_id", "left").select(
        "project_id",
        F.lit(-1).cast("bigint").alias("position"),
        F.lit("").alias("episode_id"),
        F.when(F.col("_n").isNull(), _cat("# ", title, "\n\n> 当前专辑尚未创建声音。\n")).otherwise(_cat("# ", title, "\n")).alias("line"),
    )
    name = F.coalesce(F.nullif(X.collapse_ws(F.col("title")), F.lit("")), F.lit("未命名声音"))
    body = F.coalesce(X.nonblank(F.col("content")), F.lit("> 本集终稿尚未生成"))
    parts = episodes.join(finals.select("episode_id", "content"), "episode_id", "left").select(
        "project_id",
        F.col("position").cast("bigint").alias("position"),
        F.col("episode_id").cast("string").alias("episode_id"),
        _cat(F.format_string("## 第 %02d 集：", F.col("position")), name, "\n\n", body, "\n").alias("line"),
    )
    return heads.unionByName(parts)


def export_album(projects: DataFrame, episodes: DataFrame, finals: DataFrame) -> DataFrame:
    """(project_id, text): an album as one text; `album_lines` has it as rows."""
    lines = album_lines(projects, episodes, finals)
    out = assemble(lines, ["project_id"], ["position", "episode_id"], F.col("line"))
    return out.withColumn("text", F.concat(F.regexp_replace("text", r"(?U)\s+\z", ""), F.lit("\n")))


# Note frames ------------------------------------------------------------------


def book_folder(title: Column, book: Column) -> Column:
    return _cat(f"{BOOKS}/", note_name(title, book))


def book_notes(
    books: DataFrame,
    sections: DataFrame,
    cards: DataFrame,
    card_sources: DataFrame,
    fragments: DataFrame,
    mind_maps: DataFrame,
) -> DataFrame:
    """(path, body) of home, section, fragment, card and mind-map notes.

    fragments: current members with text, section_path and set_version;
    mind_maps: newest per book.
    """
    named = books.select("book_id", F.col("title").alias("_bt"), book_folder(F.col("title"), F.col("book_id")).alias("_dir"))
    n_sections = sections.groupBy("book_id").agg(F.count(F.lit(1)).alias("_ns"))
    live = cards.filter(F.col("status") == "active")
    n_cards = live.groupBy("book_id").agg(F.count(F.lit(1)).alias("_nc"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    home = (
        books.join(named.drop("_bt"), "book_id").join(n_sections, "book_id", "left").join(n_cards, "book_id", "left")
    ).select(
        _cat(F.col("_dir"), "/00_书籍主页.md").alias("path"),
        _cat(
            X.frontmatter(("id", F.col("book_id"), "text"), ("type", F.lit("book"), "text"), ("status", F.col("status"), "text")),
            "\n\n# ", F.col("title"), "\n\n作者：", F.coalesce(F.nullif("author", F.lit("")), F.lit("未填写")),
            "\n\n- 原文小节：", zero("_ns"), "\n- 知识资产：", zero("_nc"), "\n",
        ).alias("body"),
    )
    section_name = _cat(F.format_string("%03d_", F.col("position")), note_name(F.col("title"), F.col("section_id")))
    section_notes = sections.join(named, "book_id").select(
        _cat(F.col("_dir"), "/01_原文小节/", section_name, ".md").alias("path"),
        _cat(
            X.frontmatter(("id", F.col("section_id"), "text"), ("type", F.lit("section"), "text"), ("book_id", F.col("book_id"), "text")),
            "\n\n# ", F.col("title"), "\n\n", F.col("content"), "\n",
        ).alias("body"),
    )

    # Links to the cards citing a fragment, in one note.
    citing = card_sources.join(live.select("card_id", "kind", "title"), "card_id").select(
        "content_index", "kind", "title", "card_id", _cat("- [[", note_name(F.col("title"), F.col("card_id")), "]]").alias("_l")
    )
    links = assemble(citing, ["content_index"], ["kind", "title", "card_id"], F.col("_l")).withColumnRenamed("text", "_links")
    place = sections.select("book_id", F.col("section_id").alias("source_section_id"), section_name.alias("_sec"))
    base = fragments.join(named, "book_id").join(place, ["book_id", "source_section_id"], "left").join(links, "content_index", "left")
    fragment_notes = base.select(
        _cat(
            F.col("_dir"), "/01_原文片段/", F.col("content_index"), ".md",
        ).alias("path"),
        _cat(
            X.frontmatter(
                ("id", F.col("content_index"), "text"), ("type", F.lit("source_fragment"), "text"), ("book_id", F.col("book_id"), "text"),
                ("source_section_id", F.col("source_section_id"), "text"), ("section_path", F.col("section_path"), "list"),
                ("fragment_set_version", F.col("set_version"), "number"),
            ),
            "\n\n# 原文片段 ", F.col("content_index"), "\n\n",
            F.coalesce(_cat("原章节：[[", F.col("_sec"), "]]\n\n"), F.lit("")),
            F.col("text"), "\n\n## 被以下知识资产引用\n", F.coalesce("_links", F.lit("- 暂无")), "\n",
        ).alias("body"),
    )
    ordered = card_sources.groupBy("card_id").agg(
        F.sort_array(F.collect_list(F.struct("source_order", "content_index"))).alias("_s")
    )
    listed = live.join(ordered, "card_id", "left").join(named, "book_id")
    ids = F.transform(F.col("_s"), lambda s: s["content_index"])
    folder = F.coalesce(X.map_lookup(F.col("kind"), KIND_FOLDERS), F.lit("02_知识点"))
    card_notes = listed.select(
        _cat(F.col("_dir"), "/", folder, "/", note_name(F.col("title"), F.col("card_id")), ".md").alias("path"),
        _cat(
            X.frontmatter(
                ("id", F.col("card_id"), "text"), ("type", F.col("kind"), "text"), ("book_id", F.col("book_id"), "text"),
                ("source_section_ids", F.col("source_section_ids"), "list"), ("source_content_indexes", ids, "list"),
                ("source_scheme", F.col("source_scheme"), "text"),
            ),
            "\n\n# ", F.col("title"), "\n\n", F.col("body"), "\n\n## 段落级原文证据\n",
            F.coalesce(
                F.array_join(F.transform(ids, lambda i: _cat("- [[", i, "|", i, "]]")), "\n"), F.lit("- 历史资产暂无段落级索引")
            ),
            "\n",
        ).alias("body"),
    )
    map_notes = mind_maps.join(named, "book_id").select(
        _cat(F.col("_dir"), "/05_思维导图.md").alias("path"),
        _cat(
            X.frontmatter(("id", F.col("map_id"), "text"), ("type", F.lit("mind_map"), "text"), ("book_id", F.col("book_id"), "text")),
            "\n\n", F.col("content"), "\n",
        ).alias("body"),
    )
    out = home
    for frame in (section_notes, fragment_notes, card_notes, map_notes):
        out = out.unionByName(frame)
    return out


def project_notes(projects: DataFrame, episodes: DataFrame, episode_cards: DataFrame, cards: DataFrame, latest: DataFrame) -> DataFrame:
    """(path, body) of project home, album outline and the newest text per stage.

    latest(episode_id, stage, artifact_id, content) from versions.latest_artifact.
    """
    named = projects.select(
        "project_id", F.col("title").alias("_pt"), F.col("status").alias("_ps"),
        _cat(f"{PROJECTS}/", note_name(F.col("title"), F.col("project_id"))).alias("_dir"),
    )
    counts = episodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    home = named.join(counts, "project_id", "left").select(
        _cat(F.col("_dir"), "/00_项目主页.md").alias("path"),
        _cat(
            X.frontmatter(("id", F.col("project_id"), "text"), ("type", F.lit("project"), "text"), ("status", F.col("_ps"), "text")),
            "\n\n# ", F.col("_pt"), "\n\n声音数量：", F.coalesce("_n", F.lit(0)).cast("string"), "\n",
        ).alias("body"),
    )
    framework = F.replace(F.coalesce(X.nonblank(F.col("content_framework")), F.lit("未填写")), F.lit("\n"), F.lit("\n    "))
    entry = _cat(
        F.format_string("- %02d ", F.col("position")), F.col("title"), "（", F.col("content_type"), " / ", F.col("style"),
        "）\n  - 内容框架：", framework,
    )
    outline_rows = named.select(
        "project_id", F.lit(-1).cast("bigint").alias("position"), F.lit("").alias("episode_id"), _cat("# ", F.col("_pt"), " · 专辑大纲").alias("_l")
    ).unionByName(
        episodes.select("project_id", F.col("position").cast("bigint").alias("position"), "episode_id", entry.alias("_l"))
    )
    outline = assemble(outline_rows, ["project_id"], ["position", "episode_id"], F.col("_l")).join(named, "project_id")
    outline_notes = outline.select(
        _cat(
            F.col("_dir"), "/02_专辑大纲", ".md",
        ).alias("path"),
        F.col("text").alias("body"),
    )
    assets = (
        episode_cards.join(cards.select("card_id", "title"), "card_id")
        .groupBy("episode_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "card_id", "title"))).alias("_a"))
    )
    label = X.map_lookup(F.col("stage"), STAGE_LABELS)
    texts = (
        episodes.join(latest, "episode_id").filter(F.col("stage").isin(*STAGE_LABELS))
        .join(assets, "episode_id", "left").join(named, "project_id")
    )
    links = F.array_join(F.transform("_a", lambda a: _cat("- [[", note_name(a["title"], a["card_id"]), "]]")), "\n")
    episode_notes = texts.select(
        _cat(
            F.col("_dir"), "/03_声音/", F.format_string("%02d_", F.col("position")), note_name(F.col("title"), F.col("episode_id")),
            "/", label, ".md",
        ).alias("path"),
        _cat(
            X.frontmatter(
                ("id", F.col("artifact_id"), "text"), ("type", F.col("stage"), "text"), ("project_id", F.col("project_id"), "text"),
                ("episode_id", F.col("episode_id"), "text"), ("source_section_ids", F.col("source_section_ids"), "list"),
                ("knowledge_item_ids", F.transform("_a", lambda a: a["card_id"]), "list"),
            ),
            "\n\n# ", F.col("title"), " · ", label, "\n\n## 本集知识资产\n",
            F.coalesce(F.nullif(links, F.lit("")), F.lit("- 历史声音暂无知识资产关联")), "\n\n## 文稿\n", F.col("content"), "\n",
        ).alias("body"),
    )
    return home.unionByName(outline_notes).unionByName(episode_notes)


# Incremental sync -------------------------------------------------------------


def user_block(existing: Column) -> Column:
    """What a reader wrote between the user marks of a stored note."""
    has = F.contains(existing, F.lit(USER_BEGIN)) & F.contains(existing, F.lit(USER_END))
    after = F.substring(existing, F.instr(existing, F.lit(USER_BEGIN)) + len(USER_BEGIN), F.length(existing))
    return F.coalesce(F.when(has, X.strip(F.substring_index(after, USER_END, 1))), F.lit(""))


def merge_note(existing: Column, generated: Column) -> Column:
    return _note(user_block(existing), generated)


def _note(user: Column, generated: Column) -> Column:
    return _cat(f"{SYSTEM_BEGIN}\n", X.strip(generated), f"\n{SYSTEM_END}\n\n{USER_BEGIN}\n", F.coalesce(user, F.lit("")), f"\n{USER_END}\n")


def sync_notes(new: DataFrame, existing: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed notes to write, new manifest).

    A note is written when its digest differs from the manifest or its file
    is gone. New bodies meet what readers wrote by path in one join; of stored
    notes only that part is shuffled. Unchanged ones go no further.
    """
    old = existing.select("path", user_block(F.col("body")).alias("_user"), F.lit(True).alias("_there"))
    return sync_parts(merged_notes(new.join(old, "path", "left"), manifest), manifest)


def merged_notes(met: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, digest, body, changed) of met(path, body, _user, _there); the body of an unchanged note is null."""
    known = manifest.select("path", F.col("digest").alias("_known"))
    ready = met.join(known, "path", "left").select(
        "path", _note(F.col("_user"), F.col("body")).alias("body"), F.col("_there").isNull().alias("_gone"), "_known"
    ).withColumn("digest", F.sha2("body", 256))
    same = F.col("digest").eqNullSafe(F.col("_known")) & ~F.col("_gone")
    return ready.select("path", "digest", F.when(~same, F.col("body")).alias("body"), (~same).alias("changed"))


def sync_parts(ready: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed notes to write, new manifest) of `merged_notes`."""
    untouched = manifest.select("path", "digest").join(ready.select("path"), "path", "left_anti")
    return ready.where("changed").select("path", "body", "digest"), untouched.unionByName(ready.select("path", "digest"))


def read_notes(df_files: DataFrame, root: str) -> DataFrame:
    """Stored notes as (path relative to root, body) from a binaryFile frame."""
    prefix = root.rstrip("/") + "/"
    at = F.instr("path", F.lit(prefix))
    return df_files.select(
        F.substring(F.col("path"), at + len(prefix), F.length("path")).alias("path"), F.col("content").cast("string").alias("body")
    )
