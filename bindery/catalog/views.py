"""Library-shaped views of the standard tables, in Spark and as SQL CTEs.

Each view exists twice: as a DataFrame and as the text of a common table
expression, so that a query and its SQL form start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.evidence import EVIDENCE_SCHEME
from ..ordered import position_block, running
from .registry import table

# Position step between regions and between nations of a region.
REGION_STEP, NATION_STEP = 10**15, 10**12


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Sections: region (level 1) > nation (level 3) > supplier (level 4)."""
    region, nation, supplier = (table(spark, d, n) for n in ("region", "nation", "supplier"))
    none = F.lit(None).cast("string")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    base = F.col("n_regionkey").cast("bigint") * REGION_STEP + (F.col("n_nationkey").cast("bigint") + 1) * NATION_STEP
    tops = region.select(
        key("r", "r_regionkey").alias("book_id"), key("r", "r_regionkey").alias("section_id"), none.alias("parent_id"),
        F.lit(1).alias("level"), (F.col("r_regionkey").cast("bigint") * REGION_STEP).alias("position"), F.col("r_name").alias("title"),
        F.lit("").alias("content"), F.lit("confirmed").alias("status"), (F.col("r_regionkey") != 3).alias("analysis_enabled"),
    )
    mids = nation.select(
        key("r", "n_regionkey"), key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit(3), base, F.col("n_name"),
        F.lit(""), F.lit("confirmed"), F.lit(True),
    )
    leaves = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        key("r", "n_regionkey"), key("s", "s_suppkey"), key("n", "n_nationkey"), F.lit(4), base + F.col("s_suppkey") + 1, F.col("s_name"),
        F.repeat(F.concat("s_name", F.lit(". ")), (F.lit(1) + F.col("s_suppkey") % 40).cast("int")),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit("draft")).otherwise(F.lit("confirmed")), F.lit(True),
    )
    out = tops.union(mids).union(leaves)
    return out.withColumn("kind", F.when(F.col("level") >= 4, "article").otherwise("theme"))


TREE = f"""tree AS (
  SELECT 'r' || r_regionkey AS book_id, 'r' || r_regionkey AS section_id, CAST(NULL AS VARCHAR) AS parent_id, 1 AS level,
         CAST(r_regionkey AS BIGINT) * {REGION_STEP} AS position, r_name AS title, '' AS content, 'confirmed' AS status,
         r_regionkey <> 3 AS analysis_enabled, 'theme' AS kind
  FROM region
  UNION ALL
  SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'r' || n_regionkey, 3,
         CAST(n_regionkey AS BIGINT) * {REGION_STEP} + (CAST(n_nationkey AS BIGINT) + 1) * {NATION_STEP}, n_name, '', 'confirmed', true, 'theme'
  FROM nation
  UNION ALL
  SELECT 'r' || n_regionkey, 's' || s_suppkey, 'n' || n_nationkey, 4,
         CAST(n_regionkey AS BIGINT) * {REGION_STEP} + (CAST(n_nationkey AS BIGINT) + 1) * {NATION_STEP} + s_suppkey + 1, s_name,
         repeat(s_name || '. ', CAST(1 + s_suppkey % 40 AS BIGINT)),
         CASE WHEN s_suppkey % 7 = 0 THEN 'draft' ELSE 'confirmed' END, true, 'article'
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """Fragments: suppliers; set = nation, position within it, four per section."""
    placed = running(
        table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], ["s_suppkey"], position_block(F.col("s_suppkey")), number="book_position"
    )
    return placed.select(
        F.col("s_nationkey").alias("set_id"),
        F.col("s_suppkey").alias("content_index"),
        (F.col("s_nationkey") % 5).alias("root_section_id"),
        F.expr("s_nationkey * 1000000L + (book_position - 1) div 4").alias("section_id"),
        "book_position",
    )


MEMBERS = """members AS (
  SELECT s_nationkey AS set_id, s_suppkey AS content_index, s_nationkey % 5 AS root_section_id,
         CAST(s_nationkey AS BIGINT) * 1000000 + (bp - 1) // 4 AS section_id, bp AS book_position
  FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS bp FROM supplier)
)"""


def sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").alias("set_id"),
        F.col("n_regionkey").alias("book_id"),
        (F.col("n_nationkey") % 4).alias("version"),
        F.when(F.col("n_nationkey") % 6 == 0, "historical").otherwise("current").alias("status"),
    )


SETS = """sets AS (
  SELECT n_nationkey AS set_id, n_regionkey AS book_id, n_nationkey % 4 AS version,
         CASE WHEN n_nationkey % 6 = 0 THEN 'historical' ELSE 'current' END AS status
  FROM nation
)"""


def cards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("card_id"),
        (F.col("p_partkey") % 5).cast("int").alias("book_id"),
        F.col("p_type").alias("kind"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_brand", "p_name").alias("body"),
        F.when(F.col("p_size") % 10 == 0, "superseded").otherwise("active").alias("status"),
        F.when(F.col("p_partkey") % 11 == 0, "section_v0").otherwise(EVIDENCE_SCHEME).alias("source_scheme"),
    )


CARDS = f"""cards AS (
  SELECT p_partkey AS card_id, p_partkey % 5 AS book_id, p_type AS kind, p_name AS title, p_brand || ' ' || p_name AS body,
         CASE WHEN p_size % 10 = 0 THEN 'superseded' ELSE 'active' END AS status,
         CASE WHEN p_partkey % 11 = 0 THEN 'section_v0' ELSE '{EVIDENCE_SCHEME}' END AS source_scheme
  FROM part
)"""


def card_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("card_id"), F.col("l_suppkey").alias("content_index")).distinct().withColumn("source_order", F.col("content_index"))


CARD_SOURCES = """card_sources AS (
  SELECT DISTINCT l_partkey AS card_id, l_suppkey AS content_index, l_suppkey AS source_order FROM lineitem
)"""


def episode_cards(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("card_id"))
        .agg(F.min("l_linenumber").alias("position"))
    )


EPISODE_CARDS = """episode_cards AS (
  SELECT l_orderkey AS episode_id, l_partkey AS card_id, min(l_linenumber) AS position FROM lineitem GROUP BY ALL
)"""

EVIDENCE_CTES = ",\n".join((MEMBERS, SETS, CARDS, CARD_SOURCES, EPISODE_CARDS))


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifact versions: conversation = episode, role = stage, turn = version."""
    stage = F.when(F.col("role") == "system", "outline").when(F.col("role") == "user", "draft").otherwise("final")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("episode_id"), stage.alias("stage"), F.col("turn").alias("version"), F.col("text").alias("content"))


ARTIFACTS = """artifacts AS (
  SELECT conv_id AS episode_id, CASE role WHEN 'system' THEN 'outline' WHEN 'user' THEN 'draft' ELSE 'final' END AS stage,
         turn AS version, text AS content
  FROM conversations
)"""

# Event types standing for run states.
RUN_STATES = {"signup": "pending", "click": "running", "error": "failed", "purchase": "succeeded", "view": "cancelled"}


def run_events(spark: SparkSession, d: str) -> DataFrame:
    state = F.lit(None).cast("string")
    for kind, name in RUN_STATES.items():
        state = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(state)
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", F.col("event_id").alias("seq"), state.alias("status"), "props")


RUN_EVENTS = (
    "run_events AS (SELECT user_id AS run_id, ts, event_id AS seq, props, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RUN_STATES.items())
    + " END AS status FROM events)"
)


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One run per event, for operators over run rows."""
    e = run_events(spark, d)
    return e.select(
        F.col("seq").alias("run_id"),
        F.when(F.col("seq") % 3 == 0, "episode").when(F.col("seq") % 3 == 1, "project_batch").otherwise("book_analysis_batch").alias("scope_type"),
        F.col("run_id").cast("string").alias("scope_id"),
        F.when(F.col("seq") % 4 == 0, F.col("run_id")).alias("parent_run_id"),
        "status",
        F.col("ts").alias("created_at"),
        F.replace("props", F.lit('"k"'), F.lit('"book_id"')).alias("metadata"),
    )


RUNS = (
    RUN_EVENTS
    + """, runs AS (
  SELECT seq AS run_id, CASE seq % 3 WHEN 0 THEN 'episode' WHEN 1 THEN 'project_batch' ELSE 'book_analysis_batch' END AS scope_type,
         CAST(run_id AS VARCHAR) AS scope_id, CASE WHEN seq % 4 = 0 THEN run_id END AS parent_run_id, status, ts AS created_at,
         replace(props, '"k"', '"book_id"') AS metadata
  FROM run_events
)"""
)


def batch_children(spark: SparkSession, d: str) -> DataFrame:
    """Child runs: order lines of an order; state from flag and tax."""
    state = (
        F.when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_returnflag") == "A", "cancelled")
        .when(F.col("l_tax") == 0, "pending")
        .when(F.col("l_tax") == 0.01, "running")
        .otherwise("succeeded")
    )
    return table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("run_id"),
        F.col("l_orderkey").alias("parent_run_id"),
        F.col("l_partkey").alias("episode_id"),
        F.col("l_shipdate").alias("created_at"),
        state.alias("status"),
    )


CHILDREN = """children AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS run_id, l_orderkey AS parent_run_id,
         l_partkey AS episode_id, l_shipdate AS created_at,
         CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'cancelled' WHEN l_tax = 0 THEN 'pending'
              WHEN l_tax = 0.01 THEN 'running' ELSE 'succeeded' END AS status
  FROM lineitem
)"""

# A Markdown text per document: every line break opens three nested headings.
MD_BREAK = "\n## alpha\n### beta\n#### gamma\n"


def markdown_books(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("doc_id").cast("string").alias("book_id"),
        F.concat(F.lit("lib/"), F.col("source"), F.lit(".x"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"),
        F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit(MD_BREAK))).alias("text"),
    )


MD = """md AS (
  SELECT CAST(doc_id AS VARCHAR) AS book_id, 'lib/' || source || '.x' || doc_id || '.md' AS filename,
         '# ' || source || chr(10) || replace(text, chr(10), chr(10) || '## alpha' || chr(10) || '### beta' || chr(10) || '#### gamma' || chr(10)) AS raw
  FROM documents
), md_norm AS (
  SELECT book_id, filename, raw,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(raw, '\\r\\n', chr(10)), '\\n', chr(10)),
           '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') || chr(10) AS text
  FROM md
), md_lines AS (
  SELECT book_id, filename, u.line AS line, u.i AS i
  FROM (SELECT book_id, filename, string_split(text, chr(10)) AS ls FROM md_norm),
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) u
), md_heads AS (
  SELECT book_id, filename, i, length(regexp_extract(trim(line), '^(#{1,6})\\s', 1)) AS level,
         trim(regexp_extract(trim(line), '^#{1,6}\\s+(.+?)\\s*$', 1)) AS title,
         row_number() OVER (PARTITION BY book_id ORDER BY i) - 1 AS position
  FROM md_lines WHERE regexp_matches(trim(line), '^#{1,6}\\s+.+$')
)"""
