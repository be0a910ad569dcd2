"""Readers, exports, incremental sync and streams."""

from __future__ import annotations

import datetime
import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as X
from ..operators import structure as ST, versions as W
from ..plans import planning as PL
from ..session import cut_lineage, shared_folder
from ..sources import note_sink as NS, notes as N, readers as RD
from ..streaming import jobs as JB
from . import views as V
from .registry import query, table


@query("pages_to_markdown", "S4 U1")
def _(spark, d):
    md = RD.html_to_markdown(F.col("html"))
    return table(spark, d, "pages").select("page_id", md.alias("markdown"))


_WHITE = "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(
    "composed_pages_read", "S4",
    f"""WITH w AS (SELECT *, trim(regexp_replace(translate(text, '&<>', ''), '{_WHITE}+', ' ', 'g')) AS words FROM documents)
        SELECT doc_id, md5('b {{}}' || rest) AS markdown, md5(rest) AS prose FROM (SELECT doc_id, chr(10) || '## ' || lang || chr(10) || chr(10) || CASE WHEN words = '' THEN '' ELSE ' ' || words || ' ' END || 'bold' || chr(10)
          || chr(10) || 'one & two' || chr(10) || chr(10) || source || chr(10) || chr(10) || '#### ' || doc_id || chr(10) || 'end' AS rest FROM w)""",
)
def _(spark, d):
    # A page around each document, with every kind of mark.
    page = F.concat(
        F.lit("<html><head><style>b {}</style></head><body><h2 class='x'>"), F.col("lang"), F.lit("</h2><p> "), F.translate("text", "&<>", ""), F.lit(" <b>bold</b></p><ul><li>one &amp; two</li><li>"),
        F.col("source"), F.lit("</li></ul><h4>"), F.col("doc_id").cast("string"), F.lit("</h4><br>end</body></html>"),
    )
    pages = table(spark, d, "documents").select("doc_id", page.alias("page"))
    return pages.select("doc_id", F.md5(RD.html_to_markdown("page")).alias("markdown"), F.md5(RD.html_to_markdown_prose("page")).alias("prose"))


@query("page_headings", "S4 C1 C7")
def _(spark, d):
    books = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("book_id"), F.col("url").alias("filename"), RD.html_to_markdown_prose(F.col("html")).alias("text"))
    return ST.parse_diagnostics(books, ST.parse_books(books))


@F.pandas_udf(T.BinaryType())
def legacy_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.encode("gb18030"))


@query(
    "bytes_decoded", "S2",
    "SELECT doc_id, md5(text) AS digest FROM documents",
)
def _(spark, d):
    # Even rows as UTF-8 with a byte order mark, odd rows as GB18030 bytes.
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(legacy_bytes("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(RD.decode_bytes(raw)).alias("digest"))


@query("files_routed", "S1", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'md' WHEN 2 THEN 'txt' ELSE 'pdf' END AS suffix, page_id % 4 <> 3 AS accepted FROM pages")
def _(spark, d):
    k = F.col("page_id") % 4
    name = F.concat(F.lit("/lib.d/"), F.col("page_id").cast("string"), F.when(k == 0, ".EPUB").when(k == 1, ".md").when(k == 2, ".TXT").otherwise(".pdf"))
    files = RD.with_suffix(table(spark, d, "pages").select("page_id", name.alias("path"), F.encode("html", "UTF-8").alias("content")))
    ident = F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint")
    return files.select(ident.alias("page_id"), "suffix", F.col("suffix").isin("epub", *RD.TEXT_SUFFIXES).alias("accepted"))


@query("json_columns_read", "S6", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CAST(CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS keys FROM events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 == 0, F.lit("{bad")).otherwise(F.col("props")).alias("props"))
    r = RD.read_json_cols(e, {"props": "map<string,bigint>"})
    return r.select("event_id", F.col("props")["k"].alias("k"), F.size("props").cast("bigint").alias("keys"))


@query("schema_evolved", "S7", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'section_v0' ELSE p_type END AS scheme, 'active' AS status, CAST(0 AS BIGINT) AS attempt FROM part")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 1, F.col("p_type")).alias("scheme"))
    return RD.evolve(p, {"scheme": ("string", "section_v0"), "status": ("string", "active"), "attempt": ("bigint", 0)})


@query("library_bucketed", "S5", "SELECT doc_id, length(text) AS chars FROM documents")
def _(spark, d):
    folder = f"{scratch(spark)}/library"
    N.write_library(table(spark, d, "documents").select("doc_id", "text"), folder, key="doc_id", buckets=8)
    return spark.read.parquet(folder).select("doc_id", F.length("text").cast("bigint").alias("chars"))


def scratch(spark) -> str:
    """A fresh folder below the one that driver and executors share."""
    return f"{shared_folder(spark)}/bindery-{uuid.uuid4().hex}"


def album_frames(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Albums: customers; episodes: orders; finals: some orders."""
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.concat(F.lit(" a \n"), "c_name").alias("title"))
    o = table(spark, d, "orders")
    episodes = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("episode_id"), F.col("o_orderkey").alias("position"), F.when(F.col("o_orderkey") % 6 == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("title"))
    finals = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("episode_id"), F.concat(F.lit("\n"), "o_orderstatus", F.lit(" text ")).alias("content"))
    return projects, episodes, finals


@query(
    "albums_exported", "S10 W1 T2 T21",
    """WITH l AS (
         SELECT c_custkey AS project_id, -1 AS position, '# a ' || c_name || chr(10) || CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN chr(10) || '> 当前专辑尚未创建声音。' || chr(10) ELSE '' END AS t FROM customer
         UNION ALL SELECT o_custkey, o_orderkey, '## 第 ' || CASE WHEN o_orderkey < 10 THEN '0' ELSE '' END || o_orderkey || ' 集：' || CASE WHEN o_orderkey % 6 = 0 THEN '未命名声音' ELSE o_orderpriority END || chr(10) || chr(10)
           || CASE WHEN o_orderstatus = 'P' THEN '> 本集终稿尚未生成' ELSE o_orderstatus || ' text' END || chr(10) FROM orders)
       SELECT project_id, md5(rtrim(string_agg(t, chr(10) ORDER BY position), ' ' || chr(10)) || chr(10)) AS digest FROM l GROUP BY 1""",
)
def _(spark, d):
    return N.export_album(*album_frames(spark, d)).select("project_id", F.md5("text").alias("digest"))


# Notes in SQL; the sign stands for a line feed.
_NL = "¶"
BOOK_NOTES = f"""WITH {V.TREE}, {V.CARDS}, {V.CARD_SOURCES},
  b AS (SELECT 'r' || r_regionkey AS book_id, r_name AS bt, '01_书籍/' || r_name || '__r' || r_regionkey AS dir FROM region),
  live AS (SELECT CAST(card_id AS VARCHAR) AS card_id, 'r' || book_id AS book_id, kind, title, body, source_scheme FROM cards WHERE status = 'active'),
  src AS (SELECT CAST(card_id AS VARCHAR) AS card_id, CAST(content_index AS VARCHAR) AS content_index, source_order FROM card_sources),
  sec AS (SELECT *, printf('%03d_', position) || title || '__' || section_id AS name FROM tree),
  links AS (SELECT content_index, string_agg('- [[' || title || '__' || card_id || ']]', '{_NL}' ORDER BY kind, title, card_id) AS l FROM src JOIN live USING (card_id) GROUP BY 1),
  used AS (SELECT card_id, string_agg('  - ' || content_index, '{_NL}' ORDER BY source_order) AS ids, string_agg('- [[' || content_index || '|' || content_index || ']]', '{_NL}' ORDER BY source_order) AS refs FROM src GROUP BY 1),
  notes AS (
    SELECT dir || '/00_书籍主页.md' AS path, '---¶id: "' || book_id || '"¶type: "book"¶status: "analyzed"¶---¶¶# ' || bt || '¶¶作者：未填写¶¶- 原文小节：'
      || (SELECT count(*) FROM tree t WHERE t.book_id = b.book_id) || '¶- 知识资产：' || (SELECT count(*) FROM live l WHERE l.book_id = b.book_id) || '¶' AS body FROM b
    UNION ALL SELECT dir || '/01_原文小节/' || name || '.md', '---¶id: "' || section_id || '"¶type: "section"¶book_id: "' || book_id || '"¶---¶¶# ' || title || '¶¶' || content || '¶' FROM sec JOIN b USING (book_id)
    UNION ALL SELECT dir || '/01_原文片段/' || substr(section_id, 2) || '.md', '---¶id: "' || substr(section_id, 2) || '"¶type: "source_fragment"¶book_id: "' || book_id || '"¶source_section_id: "' || section_id
      || '"¶section_path:¶  - ' || title || '¶fragment_set_version: 1¶---¶¶# 原文片段 ' || substr(section_id, 2) || '¶¶原章节：[[' || name || ']]¶¶' || content || '¶¶## 被以下知识资产引用¶' || coalesce(l, '- 暂无') || '¶'
      FROM sec JOIN b USING (book_id) LEFT JOIN links ON content_index = substr(section_id, 2) WHERE level = 4
    UNION ALL SELECT dir || '/02_知识点/' || title || '__' || card_id || '.md', '---¶id: "' || card_id || '"¶type: "' || kind || '"¶book_id: "' || book_id || '"¶source_section_ids:¶  - x'
      || coalesce('¶source_content_indexes:¶' || ids, '') || '¶source_scheme: "' || source_scheme || '"¶---¶¶# ' || title || '¶¶' || body || '¶¶## 段落级原文证据¶' || coalesce(refs, '- 历史资产暂无段落级索引') || '¶'
      FROM live JOIN b USING (book_id) LEFT JOIN used USING (card_id)
    UNION ALL SELECT dir || '/05_思维导图.md', '---¶id: "map-' || book_id || '"¶type: "mind_map"¶book_id: "' || book_id || '"¶---¶¶# ' || bt || '¶' FROM b)
SELECT path, replace(body, '{_NL}', chr(10)) AS body FROM notes"""
PROJECT_NOTES = f"""WITH {V.CARDS}, {V.EPISODE_CARDS}, {V.ARTIFACTS},
  p AS (SELECT c_custkey AS project_id, c_name AS pt, '02_内容项目/' || c_name || '__' || c_custkey AS dir FROM customer),
  newest AS (SELECT episode_id, stage, max(version) AS version, max_by(content, version) AS content FROM artifacts GROUP BY 1, 2),
  assets AS (SELECT episode_id, string_agg('  - ' || card_id, '{_NL}' ORDER BY position, CAST(card_id AS VARCHAR)) AS ids, string_agg('- [[' || title || '__' || card_id || ']]', '{_NL}' ORDER BY position, CAST(card_id AS VARCHAR)) AS refs
             FROM episode_cards JOIN cards USING (card_id) GROUP BY 1),
  named AS (SELECT *, CASE stage WHEN 'outline' THEN '声音细纲' WHEN 'draft' THEN '声音初稿' ELSE '声音终稿' END AS label FROM newest),
  notes AS (
    SELECT dir || '/00_项目主页.md' AS path, '---¶id: "' || project_id || '"¶type: "project"¶status: "ready"¶---¶¶# ' || pt || '¶¶声音数量：' || (SELECT count(*) FROM orders WHERE o_custkey = project_id) || '¶' AS body FROM p
    UNION ALL SELECT dir || '/02_专辑大纲.md', '# ' || pt || ' · 专辑大纲' || coalesce((SELECT string_agg('¶- ' || printf('%02d ', o_orderkey) || o_orderpriority || '（解读 / 观点）¶  - 内容框架：a¶    b', '' ORDER BY o_orderkey) FROM orders WHERE o_custkey = project_id), '') FROM p
    UNION ALL SELECT dir || '/03_声音/' || printf('%02d_', o_orderkey) || o_orderpriority || '__' || o_orderkey || '/' || label || '.md', '---¶id: "' || o_orderkey || '-' || stage || '-' || version || '"¶type: "' || stage || '"¶project_id: "' || project_id || '"¶episode_id: "' || o_orderkey
      || '"¶source_section_ids:¶  - x' || coalesce('¶knowledge_item_ids:¶' || ids, '') || '¶---¶¶# ' || o_orderpriority || ' · ' || label || '¶¶## 本集知识资产¶' || coalesce(refs, '- 历史声音暂无知识资产关联') || '¶¶## 文稿¶' || content || '¶'
      FROM named n JOIN orders ON o_orderkey = n.episode_id JOIN p ON project_id = o_custkey LEFT JOIN assets a ON a.episode_id = n.episode_id)
SELECT path, replace(body, '{_NL}', chr(10)) AS body FROM notes"""


@query("book_notes", "S11 J17 T17 T22", BOOK_NOTES)
def _(spark, d):
    sections = V.tree(spark, d)
    books = table(spark, d, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("book_id"), F.col("r_name").alias("title"), F.lit("").alias("author"), F.lit("analyzed").alias("status")
    )
    text_id = lambda c: F.col(c).cast("string").alias(c)
    cards = V.cards(spark, d).select(
        text_id("card_id"), F.concat(F.lit("r"), F.col("book_id").cast("string")).alias("book_id"), "kind", "title", "body", "status", "source_scheme", F.array(F.lit("x")).alias("source_section_ids")
    )
    sources = V.card_sources(spark, d).select(text_id("card_id"), text_id("content_index"), "source_order")
    leaves = sections.filter("level = 4")
    fragments = leaves.select(
        "book_id", F.substring("section_id", 2, 20).alias("content_index"), F.col("section_id").alias("source_section_id"), F.array("title").alias("section_path"), F.lit(1).alias("set_version"), F.col("content").alias("text")
    )
    maps = books.select("book_id", F.concat(F.lit("map-"), "book_id").alias("map_id"), F.concat(F.lit("# "), "title").alias("content"))
    return N.book_notes(books, sections, cards, sources, fragments, maps)


@query("project_notes", "S12 W1 J17", PROJECT_NOTES)
def _(spark, d):
    s = lambda c, a: F.col(c).cast("string").alias(a)
    projects = table(spark, d, "customer").select(s("c_custkey", "project_id"), F.col("c_name").alias("title"), F.lit("ready").alias("status"))
    episodes = table(spark, d, "orders").select(
        s("o_custkey", "project_id"), s("o_orderkey", "episode_id"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("title"), F.lit("解读").alias("content_type"),
        F.lit("观点").alias("style"), F.lit("a\nb").alias("content_framework"), F.array(F.lit("x")).alias("source_section_ids"),
    )
    links = V.episode_cards(spark, d).select(s("episode_id", "episode_id"), s("card_id", "card_id"), "position")
    cards = V.cards(spark, d).select(s("card_id", "card_id"), "title")
    latest = W.latest_artifact(V.artifacts(spark, d)).select(s("episode_id", "episode_id"), "stage", F.concat_ws("-", "episode_id", "stage", "version").alias("artifact_id"), "content")
    return N.project_notes(projects, episodes, links, cards, latest)


def wrapped(body: Column, user: Column) -> Column:
    return F.concat(F.lit(f"{N.SYSTEM_BEGIN}\n"), X.strip(body), F.lit(f"\n{N.SYSTEM_END}\n\n{N.USER_BEGIN}\n"), user, F.lit(f"\n{N.USER_END}\n"))


@query(
    "notes_synced", "S13",
    f"""WITH n AS (SELECT doc_id, 'n/' || doc_id AS path, '{N.SYSTEM_BEGIN}' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || '{N.SYSTEM_END}' || chr(10) || chr(10) || '{N.USER_BEGIN}' || chr(10)
               || CASE WHEN doc_id % 3 = 0 THEN 'mine ' || doc_id ELSE '' END || chr(10) || '{N.USER_END}' || chr(10) AS body FROM documents)
        SELECT path, sha256(body) AS digest FROM n WHERE doc_id % 4 IN (0, 1)""",
)
def _(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("n/"), F.col("doc_id").cast("string"))
    user = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("mine "), F.col("doc_id").cast("string"))).otherwise(F.lit(""))
    new = docs.select(path.alias("path"), F.col("text").alias("body"))
    stored = wrapped(F.col("text"), user)
    # One quarter changed since, one quarter new to the manifest, the rest as stored.
    existing = docs.select(path.alias("path"), F.when(F.col("doc_id") % 4 == 0, wrapped(F.lit("old"), user)).otherwise(stored).alias("body"))
    manifest = docs.filter("doc_id % 4 <> 1").select(path.alias("path"), F.sha2(F.when(F.col("doc_id") % 4 == 0, wrapped(F.lit("old"), user)).otherwise(stored), 256).alias("digest"))
    changed, _ = N.sync_notes(new, existing, manifest)
    return changed.select("path", "digest")


@query(
    "notes_stored", "S13",
    f"""SELECT 'n' || doc_id % 7 || '/' || doc_id || '.md' AS path, md5('{N.SYSTEM_BEGIN}' || chr(10) || regexp_replace(text || CASE WHEN doc_id % 3 = 0 THEN ' again' ELSE '' END, '^\\s+|\\s+$', '', 'g') || chr(10) || '{N.SYSTEM_END}' || chr(10) || chr(10) || '{N.USER_BEGIN}' || chr(10) || chr(10) || '{N.USER_END}' || chr(10)) AS digest,
              CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS written FROM documents""",
)
def _(spark, d):
    # Written, found unchanged, and a third of them written again after a change; then read back from the files.
    root = f"{scratch(spark)}/vault"
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("n"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    first = docs.select(path.alias("path"), F.col("text").alias("body"))
    second = docs.select(path.alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text")).alias("body"))
    written = NS.sync(first, root).select("path").unionByName(NS.sync(first, root).select("path")).unionByName(NS.sync(second, root).select("path"))
    times = written.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("written"))
    return NS.with_stored(times, root, "body").where("body IS NOT NULL").select("path", F.md5("body").alias("digest"), "written")


@query("notes_unchanged", "S13", "SELECT count(*) AS notes, CAST(0 AS BIGINT) AS changed FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("n/"), F.col("doc_id").cast("string"))
    stored = wrapped(F.col("text"), F.lit(""))
    existing = docs.select(path.alias("path"), stored.alias("body"))
    manifest = docs.select(path.alias("path"), F.sha2(stored, 256).alias("digest"))
    changed, after = N.sync_notes(docs.select(path.alias("path"), F.col("text").alias("body")), existing, manifest)
    marks = after.select(F.lit(0).alias("c")).unionByName(changed.select(F.lit(1).alias("c")))
    return marks.agg(F.count_if(F.col("c") == 0).alias("notes"), F.count_if(F.col("c") == 1).alias("changed"))


SLOT_DAYS = 10


@query(
    "run_status_streamed", "R9 R1",
    f"""WITH {V.RUN_EVENTS}, s AS (SELECT *, last_value(CASE WHEN status <> 'running' THEN status END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS settled FROM run_events),
          a AS (SELECT * FROM s WHERE NOT (status = 'running' AND settled IS NOT DISTINCT FROM 'cancelled'))
        SELECT CAST(run_id AS VARCHAR) AS run_id, arg_max(status, (ts, seq)) AS status, count(*) FILTER (WHERE status = 'running') AS attempt, epoch_us(max(ts)) AS heartbeat_us,
               epoch_us(min(ts) FILTER (WHERE status = 'running')) AS started_us, CASE WHEN arg_max(status, (ts, seq)) IN ('succeeded', 'failed', 'cancelled') THEN epoch_us(max(ts)) END AS finished_us FROM a GROUP BY 1""",
)
def _(spark, d):
    # The log arrives in portions, half of each ten days one portion late; the job is stopped after each and goes on from its checkpoint.
    root = scratch(spark)
    e = V.run_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    first = e.agg(F.min("ts")).first()[0]
    if first is None:
        first = datetime.datetime(2024, 1, 1)
    portion = F.floor(F.date_diff("ts", F.lit(first)) / SLOT_DAYS).cast("int") + F.pmod(F.xxhash64("seq"), F.lit(2)).cast("int")
    source = cut_lineage(e.select("run_id", "ts", "seq", "status", portion.alias("portion")))
    provider, parts = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k, None) for k in (provider, parts)}
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # A state store and a Python worker per partition and micro-batch: as many as there are cores.
    spark.conf.set(parts, str(min(int(spark.conf.get(parts)), spark.sparkContext.defaultParallelism)))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id:09d}")

    try:
        for n in [r["portion"] for r in source.select("portion").distinct().orderBy("portion").collect()]:  # one per ten days of the log
            source.where(F.col("portion") == n).drop("portion").write.parquet(f"{root}/log/portion={n}")
            stream = spark.readStream.schema(source.drop("portion").schema).option("recursiveFileLookup", "true").parquet(f"{root}/log")
            state = JB.stream_run_state(stream, lateness=f"{SLOT_DAYS + 1} days")
            state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = spark.read.schema(f"{JB.RUN_STATE}, batch int").parquet(f"{root}/out/*").where("NOT stale")
    us = lambda c: F.unix_micros(F.col(f"x.{c}"))
    last = rows.groupBy("run_id").agg(F.max_by(F.struct("status", "attempt", "heartbeat_at", "started_at", "finished_at"), "batch").alias("x"))
    return last.select("run_id", "x.status", "x.attempt", us("heartbeat_at").alias("heartbeat_us"), us("started_at").alias("started_us"), us("finished_at").alias("finished_us"))


# Archives, files and snapshots written from the tables --------------------------------


@F.pandas_udf(T.BinaryType())
def packed_epub(page: pd.Series) -> pd.Series:
    """A two-page archive around each page, the page coming second."""

    def pack(html: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b/p.opf"/></rootfiles></container>')
            z.writestr("b/p.opf", '<package><manifest><item id="y" href="2.html"/><item id="x" href="1.html"/></manifest><spine><itemref idref="x"/><itemref idref="y"/></spine></package>')
            z.writestr("b/1.html", "<h1>cover</h1>")
            z.writestr("b/2.html", html)
        return out.getvalue()

    return page.map(pack)


@query(
    "epub_spines", "S3 U2",
    """SELECT page_id, CAST(0 AS BIGINT) AS spine_pos, '1.html' AS href, md5('<h1>cover</h1>') AS digest FROM pages WHERE page_id % 10 <> 7
       UNION ALL SELECT page_id, 1, '2.html', md5(html) FROM pages WHERE page_id % 10 <> 7 UNION ALL SELECT page_id, -1, NULL, NULL FROM pages WHERE page_id % 10 = 7""",
)
def _(spark, d):
    broken = F.encode("html", "UTF-8")
    files = table(spark, d, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".epub")).alias("path"), F.when(F.col("page_id") % 10 == 7, broken).otherwise(packed_epub("html")).alias("content")
    )
    r = RD.epub_to_spine(files)
    ident = F.substring_index("path", ".", 1).cast("bigint")
    return r.select(ident.alias("page_id"), F.col("spine_pos").cast("bigint").alias("spine_pos"), "href", F.md5("page").alias("digest"))


@query("album_replaced", "P18", "SELECT o_orderkey AS episode_id, o_custkey AS project_id FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, d):
    root = scratch(spark)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("project_id"), "o_orderstatus")
    links = V.episode_cards(spark, d)
    PL.replace_album(o, links, root, "v1")
    PL.replace_album(o.filter("o_orderstatus <> 'P'"), links, root, "v2")
    return PL.read_album(spark, root)[0].select("episode_id", "project_id")


@query(
    "library_streamed", "R8 S1 S2 C3 C11 C12 C15",
    f"""SELECT page_id, CASE WHEN page_id % 10 = 7 THEN '{RD.UNSUPPORTED}' END AS error, CASE WHEN page_id % 10 <> 7 THEN CAST(1 AS BIGINT) ELSE 0 END AS books,
              CASE WHEN page_id % 10 <> 7 THEN md5(regexp_replace(page_id || ' > ' || html, '[ \t\n\r\f]+', '', 'g')) END AS digest FROM pages""",
)
def _(spark, d):
    # Files arrive in two portions; the second brings the first ones again under other names, and files of a kind that is refused.
    root = scratch(spark)
    pages = table(spark, d, "pages").select("page_id", (F.col("page_id") % 2).alias("half"), F.concat(F.col("page_id").cast("string"), F.lit(" > "), "html").alias("value"))
    good, bad = pages.where("page_id % 10 <> 7"), pages.where("page_id % 10 = 7")
    go = lambda: JB.stream_library(spark, f"{root}/in", f"{root}/out", f"{root}/state", availableNow=True).awaitTermination()
    good.where("half = 0").select("page_id", "value").write.partitionBy("page_id").text(f"{root}/in/first")
    go()
    good.where("half = 1").select("page_id", "value").write.partitionBy("page_id").text(f"{root}/in/second")
    good.where("half = 0").select("page_id", "value").write.partitionBy("page_id").text(f"{root}/in/again")
    bad.select("page_id", "value").write.partitionBy("page_id").json(f"{root}/in/refused")
    go()
    JB.deliver(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/in/first"), 0, f"{root}/out")  # a batch that is repeated changes nothing
    page = F.regexp_extract("path", r"page_id=(\d+)", 1).cast("bigint").alias("page_id")
    out = lambda name: JB.read_delivered(spark, f"{root}/out", name)
    read, rejected = out("books").select("book_id", page), out("rejects").where("path NOT LIKE '%/\\_%' AND path NOT LIKE '%.crc'").select(page, "error")
    ordered = F.array_sort(F.collect_list(F.struct("book_position", "text")))
    whole = F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["text"]), ""), "[ \t\n\r\f]+", "")
    texts = out("fragments").groupBy("book_id").agg(F.md5(whole).alias("digest"))
    per = read.join(texts, "book_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("books"), F.max("digest").alias("digest"))
    return per.select("page_id", F.lit(None).cast("string").alias("error"), "books", "digest").unionByName(
        rejected.select("page_id", "error", F.lit(0).cast("bigint").alias("books"), F.lit(None).cast("string").alias("digest"))
    )
