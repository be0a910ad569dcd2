"""Scalar queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from . import views as V
from .registry import query, table

T = ".!?"
NORM = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, '\\r\\n', chr(10)), '\\n', chr(10)),"
    " '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10)"
)
FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "text_normalized", "T1",
    f"""SELECT doc_id, CAST((length(text) - length(replace(text, '\\n', ''))) / 2 AS BIGINT) AS restored, length({NORM}) AS chars, md5({NORM}) AS digest
        FROM documents""",
)
def _(spark, d):
    df = table(spark, d, "documents")
    n = X.normalize_text(F.col("text"))
    return df.select(
        "doc_id", X.restored_newlines(F.col("text")).cast("bigint").alias("restored"), F.length(n).cast("bigint").alias("chars"), F.md5(n).alias("digest")
    )


@query(
    "text_whitespace_forms", "T2 T3 T4",
    f"""SELECT doc_id, md5({FLAT}) AS collapsed, md5(regexp_replace(text, '\\s+', '', 'g')) AS compacted,
               md5(regexp_replace(text, '[^\\x{{4e00}}-\\x{{9fa5}}a-zA-Z0-9]', '', 'g')) AS cleaned
        FROM documents""",
)
def _(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.md5(X.collapse_ws(c)).alias("collapsed"), F.md5(X.compact_text(c)).alias("compacted"), F.md5(X.clean_for_match(c)).alias("cleaned")
    )


@query(
    "text_excerpts", "T5",
    f"SELECT doc_id, left({FLAT}, 360) AS excerpt, left({FLAT}, 120) AS short FROM documents",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"), X.excerpt(F.col("text"), 120).alias("short"))


@query(
    "text_first_sentences", "T6 T7",
    f"""SELECT doc_id,
          coalesce(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)),
                               lambda s: length(s) BETWEEN 24 AND 180)[1], left({FLAT}, 160)) AS sentence,
          list_filter(list_transform(string_split(regexp_replace(text, '([.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')),
                      lambda s: length(s) BETWEEN 36 AND 120)[1] AS quote
        FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.extract_sentence(F.col("text"), terminators=T).alias("sentence"), X.first_quote(F.col("text"), terminators=T).alias("quote")
    )


@query(
    "text_sentences", "T8",
    """SELECT doc_id, CAST(len(s) AS BIGINT) AS sentences, md5(array_to_string(s, '|')) AS digest
       FROM (SELECT doc_id, list_transform(regexp_extract_all(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?s).+?(?:[.!?]+[”’"'']?|$)'), lambda x: trim(x)) AS s FROM documents)""",
)
def _(spark, d):
    s = X.sentences(X.collapse_ws(F.col("text")), T)
    return table(spark, d, "documents").withColumn("s", s).select(
        "doc_id", F.size("s").cast("bigint").alias("sentences"), F.md5(F.array_join("s", "|")).alias("digest")
    )


WORDS = "len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]|[0-9]|[A-Za-z]+(?:[''’\\-][A-Za-z]+)*'))"


@query("text_spoken_words", "T9", f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS words FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.spoken_words(F.col("text")).cast("bigint").alias("words"))


@query(
    "text_word_check", "T10",
    f"""SELECT doc_id, actual, actual BETWEEN 300 AND 400 AS within_range,
               CASE WHEN actual < 300 THEN 300 - actual WHEN actual > 400 THEN 400 - actual ELSE 0 END AS delta,
               CASE WHEN actual < 300 THEN '需要增加至少 ' || (300 - actual) || ' 字' WHEN actual > 400 THEN '需要减少至少 ' || (actual - 400) || ' 字'
                    ELSE '当前字数已经位于目标范围内' END AS instruction
        FROM (SELECT doc_id, CAST({WORDS} AS BIGINT) AS actual FROM documents)""",
)
def _(spark, d):
    c = X.word_count_check(F.col("text"), F.lit(300), F.lit(400))
    return table(spark, d, "documents").withColumn("c", c).select(
        "doc_id", F.col("c.actual").cast("bigint").alias("actual"), "c.within_range", F.col("c.delta").cast("bigint").alias("delta"), "c.instruction"
    )


@query(
    "word_ranges", "T11",
    """SELECT p_partkey, lo, hi,
              CASE WHEN lo < 300 THEN '每集最少字数不能低于 300' WHEN hi > 10000 THEN '每集最多字数不能超过 10000' WHEN lo > hi THEN '每集最少字数不能大于最多字数' END AS error,
              '每集 ' || lo || '–' || hi || ' 字；汉字和阿拉伯数字逐字计数，连续英文单词计 1 字，标点、Markdown 标记和空白不计入。' AS shown
       FROM (SELECT p_partkey, p_size * 40 AS lo, CAST(floor(p_retailprice * 9) AS BIGINT) AS hi FROM part)""",
)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("lo"), F.floor(F.col("p_retailprice") * 9).cast("bigint").alias("hi"))
    return p.withColumn("error", X.word_range_error(F.col("lo"), F.col("hi"))).withColumn("shown", X.word_range_text(F.col("lo"), F.col("hi")))


CITED = (
    "'[CHAPTER_' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '] ，content_' || lower(hex(l_suppkey)) || ' x knowledge_' || lower(hex(l_partkey)) || '  content_'"
    " || lower(hex(l_suppkey)) || ' ' || l_returnflag || ' CHAPTER_' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '；'"
)


def cited(spark, d):
    chapter = F.format_string("CHAPTER_%03d", F.col("l_linenumber"))
    content = F.concat(F.lit("content_"), F.lower(F.hex("l_suppkey")))
    text = F.concat(
        F.lit("["), chapter, F.lit("] ，"), content, F.lit(" x knowledge_"), F.lower(F.hex("l_partkey")), F.lit("  "), content, F.lit(" "),
        F.col("l_returnflag"), F.lit(" "), chapter, F.lit("；"),
    )
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


@query(
    "text_ids", "T12 T13",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               array_to_string(regexp_extract_all(text, 'content_[0-9a-f]+')[1:1], ',') AS contents, regexp_extract(text, 'knowledge_[0-9a-f]+') AS cards,
               regexp_extract(text, 'CHAPTER_[0-9]{{3}}') AS chapters,
               trim(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\bknowledge_[0-9a-f]+\\b', '', 'g'), '\\bcontent_[0-9a-f]+\\b', '', 'g'), '\\s+', ' ', 'g')), ' ，,；;') AS bare
        FROM (SELECT *, {CITED} AS text FROM lineitem)""",
)
def _(spark, d):
    c = F.col("text")
    return cited(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.array_join(X.extract_ids(c, X.CONTENT_ID), ",").alias("contents"), F.array_join(X.extract_ids(c, X.KNOWLEDGE_ID), ",").alias("cards"),
        F.array_join(X.extract_ids(c, X.CHAPTER_KEY), ",").alias("chapters"), X.clean_planning_text(c).alias("bare"),
    )


@query(
    "text_fences", "T14 T15 T16",
    """SELECT conv_id, turn,
              trim(text, ' ' || chr(10)) AS unfenced, '前' || text AS unthought,
              CASE WHEN turn % 3 = 2 THEN NULL ELSE trim(text, ' ' || chr(10)) END AS body
       FROM conversations""",
)
def _(spark, d):
    text = F.col("text")
    fence = F.concat(F.lit("```json\n"), text, F.lit("\n```"))
    think = F.concat(F.lit("前<think>a\nb</think>"), text)
    block = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("x ```json\n{}\n``` y ```text\n<think>q</think>"), text, F.lit("\n``` z")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("x ```json\n"), text, F.lit("\n```")))
        .otherwise(text)
    )
    return table(spark, d, "conversations").select(
        "conv_id", "turn", X.strip_code_fence(fence).alias("unfenced"), X.strip_think(think).alias("unthought"), X.extract_fenced(block).alias("body")
    )


@query(
    "safe_names", "T17",
    """SELECT page_id, coalesce(nullif(left(trim(regexp_replace(url, '[\\\\/:*?"<>|]+', '_', 'g'), ' .'), 80), ''), '未命名') AS name FROM pages""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@query(
    "footnotes", "T18",
    "SELECT doc_id, CAST(len(regexp_extract_all(t, '\\[[0-9]+\\]')) AS BIGINT) AS notes FROM (SELECT doc_id, replace(text, '.', '.[' || doc_id || ']') AS t FROM documents)",
)
def _(spark, d):
    marked = F.replace("text", F.lit("."), F.concat(F.lit(".["), F.col("doc_id").cast("string"), F.lit("]")))
    return table(spark, d, "documents").select("doc_id", X.footnote_markers(marked).cast("bigint").alias("notes"))


@query(
    "chapter_numbers", "T19",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '第' || c_nationkey || '章' WHEN 1 THEN '导论' WHEN 2 THEN '附录' || c_nationkey
              WHEN 3 THEN '第' || c_nationkey || '部分' ELSE c_name END AS number
       FROM customer""",
)
def _(spark, d):
    n = F.col("c_nationkey").cast("string")
    k = F.col("c_custkey") % 5
    title = (
        F.when(k == 0, F.concat(F.lit("甲 第"), n, F.lit("章 "), "c_name"))
        .when(k == 1, F.concat(F.lit("导论 "), "c_name"))
        .when(k == 2, F.concat(F.lit("附录"), n, F.lit(" "), "c_name"))
        .when(k == 3, F.concat(F.lit("第"), n, F.lit("部分 "), "c_name"))
        .otherwise(F.col("c_name"))
    )
    return table(spark, d, "customer").select("c_custkey", X.chapter_number(title).alias("number"))


@query(
    "content_types", "T20",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '解读' WHEN 1 THEN '过渡' WHEN 2 THEN '解读' END AS content_type,
              CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'cheap' WHEN 'STANDARD' THEN 'plain' END AS mapped FROM part""",
)
def _(spark, d):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.lit("**深度 解读类**：")).when(k == 1, F.lit("`承上启下`。")).when(k == 2, F.lit(" 书籍解读 ")).otherwise(F.col("p_type"))
    table_ = {"ECONOMY": "cheap", "PROMO": "cheap", "STANDARD": "plain"}
    return table(spark, d, "part").select(
        "p_partkey", X.normalize_content_type(raw).alias("content_type"), X.normalize_content_type(F.col("p_type"), table_).alias("mapped")
    )


@query(
    "ordinal_keys", "T21",
    "SELECT s_suppkey, 'CHAPTER_' || lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS VARCHAR), 3, '0') AS chapter_key FROM supplier",
)
def _(spark, d):
    m = V.members(spark, d)
    return m.select(F.col("content_index").alias("s_suppkey"), X.ordinal_key("CHAPTER", F.col("book_position")).alias("chapter_key"))


@query(
    "note_headers", "T22",
    """SELECT doc_id, '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: "' || lang || '"' || chr(10)
              || CASE WHEN doc_id % 2 = 0 THEN 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - ' || source || chr(10) ELSE '' END || '---' AS header
       FROM documents""",
)
def _(spark, d):
    tags = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>"))
    header = X.frontmatter(("id", F.col("doc_id"), "number"), ("lang", F.col("lang"), "text"), ("empty", F.lit(""), "text"), ("tags", tags, "list"))
    return table(spark, d, "documents").select("doc_id", header.alias("header"))


@query(
    "identities", "T23",
    f"""SELECT doc_id, left(sha1('section' || chr(31) || source || chr(31) || doc_id), 16) AS section_id,
               'content_' || left(sha1(doc_id || chr(31) || source || chr(31) || {FLAT} || chr(31) || '1'), 20) AS content_index,
               'knowledge_' || left(sha256('{{"body": ' || to_json(regexp_replace(text, '\\s+', '', 'g')) || ', "book_id": "' || doc_id || '", "kind": "' || lang || '", "sources": ["' || source || '", "x"]}}'), 24) AS card_id
        FROM documents""",
)
def _(spark, d):
    c = F.col
    key = X.card_key(c("doc_id"), c("lang"), c("text"), F.array(c("source"), F.lit("x")))
    return table(spark, d, "documents").select(
        "doc_id",
        X.stable_id("section", c("source"), c("doc_id")).alias("section_id"),
        X.content_index(c("doc_id"), c("source"), X.collapse_ws(c("text")), F.lit(1)).alias("content_index"),
        X.card_id(key).alias("card_id"),
    )


@query(
    "fingerprints", "T24 T25",
    f"""SELECT doc_id, sha256({FLAT}) AS text_fingerprint, sha256('{{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}}') AS signature FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", X.text_fingerprint(F.col("text")).alias("text_fingerprint"), X.signature(F.col("doc_id"), F.col("lang"), F.col("source")).alias("signature")
    )


@query(
    "iso_times", "T26",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso, epoch_us(ts) AS micros FROM events",
)
def _(spark, d):
    iso = X.iso_time(F.col("ts"))
    return table(spark, d, "events").select("event_id", iso.alias("iso"), F.unix_micros(X.parse_iso(iso)).alias("micros"))


@query(
    "size_tiers", "T27",
    """SELECT conv_id, full_chars, compact_chars, CASE WHEN full_chars <= 1500 THEN 'full' WHEN compact_chars <= 1500 THEN 'compact' ELSE 'compressed' END AS tier
       FROM (SELECT conv_id, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS full_chars,
                    CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS compact_chars FROM conversations GROUP BY conv_id)""",
)
def _(spark, d):
    sizes = table(spark, d, "conversations").groupBy("conv_id").agg(
        (F.sum(F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("full_chars"),
        F.sum(F.when(F.col("role") != "assistant", F.length("text")).otherwise(0)).alias("compact_chars"),
    )
    return sizes.withColumn("tier", X.size_tier(F.col("full_chars"), F.col("compact_chars"), 1500))


@query(
    "prompt_version_ids", "T23",
    """SELECT stage, substr(h, 1, 12) || '5' || substr(h, 14, 3) || ['8', '9', 'a', 'b'][1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4] || substr(h, 18, 15) AS version_id
       FROM (SELECT DISTINCT o_orderpriority AS stage, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('bindery:' || o_orderpriority || ':v1')) AS h FROM orders)""",
)
def _(spark, d):
    stages = table(spark, d, "orders").select(F.col("o_orderpriority").alias("stage")).distinct()
    return stages.select("stage", X.prompt_version_id(F.col("stage"), F.lit("v1"), "bindery").alias("version_id"))
