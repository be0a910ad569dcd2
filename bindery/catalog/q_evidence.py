"""Joins of the evidence graph, filters, set operations and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import evidence as E, library as L, quotes as Q, runs as R, sets as S, structure as ST, versions as W
from . import views as V
from .registry import query, table

CTES = V.EVIDENCE_CTES


def current(spark, d) -> DataFrame:
    return E.current_members(V.members(spark, d), V.sets(spark, d))


CURRENT = f"{CTES}, cur AS (SELECT * FROM members WHERE set_id IN (SELECT set_id FROM sets WHERE status = 'current'))"
DIRECT = f"""{CURRENT}, cited AS (
  SELECT e.episode_id, s.content_index, e.card_id, row_number() OVER (PARTITION BY e.episode_id, s.content_index ORDER BY e.position, e.card_id, s.source_order) AS rn,
         c.set_id, c.section_id, c.book_position
  FROM episode_cards e JOIN card_sources s USING (card_id) JOIN cur c USING (content_index)
), direct AS (SELECT * FROM cited WHERE rn = 1)"""


def fragments(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("content_index"), F.col("s_name").alias("text"), F.col("s_nationkey").alias("source_section_id"))


@query(
    "chapter_fragments", "J1",
    f"WITH {CTES} SELECT set_id, root_section_id, content_index, book_position, s_name AS text FROM members JOIN supplier ON s_suppkey = content_index",
)
def _(spark, d):
    return E.chapter_fragments(V.members(spark, d), fragments(spark, d)).select("set_id", "root_section_id", "content_index", "book_position", "text")


def memberships(spark, d) -> DataFrame:
    """Every fragment in its own set and in the set after it."""
    m = V.members(spark, d).select("content_index", "set_id", "book_position")
    return m.unionByName(m.select("content_index", ((F.col("set_id") + 1) % 25).alias("set_id"), "book_position"))


MEMBERSHIPS = f"""{CTES}, both_sets AS (
  SELECT content_index, set_id, book_position FROM members UNION ALL SELECT content_index, (set_id + 1) % 25, book_position FROM members)"""


@query(
    "fragment_detail", "J2",
    f"""WITH {MEMBERSHIPS}, ranked AS (
          SELECT m.*, version, status, row_number() OVER (PARTITION BY content_index ORDER BY (status = 'current') DESC, version DESC, set_id DESC) AS rn FROM both_sets m JOIN sets USING (set_id))
        SELECT s_suppkey AS content_index, s_name AS text, set_id, version, status, book_position FROM supplier LEFT JOIN ranked ON content_index = s_suppkey AND rn = 1""",
)
def _(spark, d):
    return E.fragment_detail(fragments(spark, d), memberships(spark, d), V.sets(spark, d)).select("content_index", "text", "set_id", "version", "status", "book_position")


@query(
    "item_sources", "J3",
    f"""WITH {MEMBERSHIPS}, placed AS (SELECT * FROM both_sets WHERE content_index % 3 <> 0)
        SELECT card_id, s.content_index, source_order, set_id FROM card_sources s JOIN supplier ON s_suppkey = s.content_index
          LEFT JOIN placed p ON p.content_index = s.content_index LEFT JOIN sets USING (set_id)
        WHERE status = 'current' OR status IS NULL""",
)
def _(spark, d):
    placed = memberships(spark, d).filter(F.col("content_index") % 3 != 0)
    return E.item_sources(V.card_sources(spark, d), fragments(spark, d), placed, V.sets(spark, d)).select("card_id", "content_index", "source_order", "set_id")


@query("direct_evidence", "J4", f"WITH {DIRECT} SELECT episode_id, content_index, card_id, set_id, book_position FROM direct")
def _(spark, d):
    r = E.direct_evidence(V.episode_cards(spark, d), V.card_sources(spark, d), current(spark, d))
    return r.select("episode_id", "content_index", "card_id", "set_id", "book_position")


@query(
    "cards_without_evidence", "J4 J13",
    f"WITH {CURRENT} SELECT episode_id, card_id, position FROM episode_cards WHERE card_id NOT IN (SELECT card_id FROM card_sources JOIN cur USING (content_index) WHERE card_id % 100 <> 77)",
)
def _(spark, d):
    # Cards whose number ends in 77 are cited by nothing.
    return E.cards_without_evidence(V.episode_cards(spark, d), V.card_sources(spark, d).filter("card_id % 100 <> 77"), current(spark, d)).select("episode_id", "card_id", "position")


@query(
    "auxiliary_context", "J5",
    f"""WITH {DIRECT}
        SELECT DISTINCT d.episode_id, m.content_index, m.book_position FROM direct d
        JOIN members m ON m.set_id = d.set_id AND m.section_id = d.section_id AND m.book_position BETWEEN d.book_position - 1 AND d.book_position + 1
        WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.episode_id = d.episode_id AND x.content_index = m.content_index)""",
)
def _(spark, d):
    found = E.auxiliary_of_links(V.episode_cards(spark, d), V.card_sources(spark, d), current(spark, d), V.members(spark, d), "section_id", keep=["book_position"])
    return found.select("episode_id", "content_index", "book_position")


@query(
    "previous_finals", "J6 W1",
    """WITH e AS (SELECT o_custkey AS project_id, o_orderkey AS episode_id, o_orderkey AS position FROM orders),
            f AS (SELECT o_orderkey AS episode_id, o_orderkey % 7 || ' ' || o_orderpriority AS content FROM orders WHERE o_orderstatus <> 'P'),
            x AS (SELECT e.*, f.content, f.episode_id AS fid FROM e LEFT JOIN f USING (episode_id))
       SELECT e.episode_id, x.content AS previous_final FROM e ASOF LEFT JOIN (SELECT project_id, position, content FROM x WHERE fid IS NOT NULL) x
         ON e.project_id = x.project_id AND e.position > x.position""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    episodes = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("episode_id"), F.col("o_orderkey").alias("position"))
    finals = o.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("episode_id"), F.concat_ws(" ", F.col("o_orderkey") % 7, "o_orderpriority").alias("content")
    )
    return E.previous_final(episodes, finals).select("episode_id", "previous_final")


@query(
    "episode_candidates", "J7",
    f"""WITH {CURRENT}, live AS (SELECT * FROM cards WHERE status = 'active' AND source_scheme = '{E.EVIDENCE_SCHEME}')
        SELECT w.content_index AS episode_id, card_id, min(c.book_position) AS first_position
        FROM members w JOIN cur c ON c.section_id = w.section_id JOIN card_sources s ON s.content_index = c.content_index JOIN live USING (card_id) GROUP BY ALL""",
)
def _(spark, d):
    # One episode per fragment, its section standing for the source chapter.
    by_section = lambda df: df.withColumn("root_section_id", F.col("section_id"))
    episodes = V.members(spark, d).select(F.col("content_index").alias("episode_id"), F.array("section_id").alias("source_section_ids"))
    r = E.episode_candidates(episodes, V.cards(spark, d), V.card_sources(spark, d), by_section(current(spark, d)))
    return r.select("episode_id", "card_id", "first_position")


@query(
    "eligible_episodes", "J8",
    f"""WITH {V.ARTIFACTS}, {V.RUNS}
        SELECT o_orderkey AS episode_id FROM orders WHERE o_orderkey NOT IN (SELECT episode_id FROM artifacts WHERE stage = 'final')
          AND CAST(o_orderkey AS VARCHAR) NOT IN (SELECT scope_id FROM runs WHERE scope_type = 'episode' AND status IN ('pending', 'running'))""",
)
def _(spark, d):
    episodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"))
    runs = V.runs(spark, d).withColumn("scope_id", F.col("scope_id").cast("bigint"))
    return E.eligible_episodes(episodes, V.artifacts(spark, d), runs)


BOOKS = """books AS (SELECT c_custkey AS book_id, CASE WHEN c_nationkey % 2 = 0 THEN 'narrative' ELSE 'non_narrative' END AS book_type,
  CASE c_nationkey % 4 WHEN 1 THEN 'analyzed' WHEN 3 THEN 'analysis_partial' ELSE 'ready_to_analyze' END AS status FROM customer)"""


def books(spark, d) -> DataFrame:
    k = F.col("c_nationkey") % 4
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("book_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "narrative").otherwise("non_narrative").alias("book_type"),
        F.when(k == 1, "analyzed").when(k == 3, "analysis_partial").otherwise("ready_to_analyze").alias("status"),
    )


@query(
    "books_to_ready", "J9",
    f"WITH {BOOKS} SELECT book_id FROM books WHERE book_type = 'non_narrative' AND status = 'analyzed' AND book_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def _(spark, d):
    owned = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("book_id"))
    return E.analyzed_without_cards(books(spark, d), owned).select("book_id")


@query(
    "maps_kept", "J9",
    f"WITH {BOOKS} SELECT o_orderkey AS map_id, o_custkey AS book_id FROM orders WHERE o_custkey NOT IN (SELECT book_id FROM books WHERE book_type = 'non_narrative' AND status IN ('ready_to_analyze', 'analysis_partial', 'analysis_partial_failed'))",
)
def _(spark, d):
    maps = table(spark, d, "orders").select(F.col("o_orderkey").alias("map_id"), F.col("o_custkey").alias("book_id"))
    return E.maps_of_ready_books(maps, books(spark, d)).select("map_id", "book_id")


# Analyses: orders of a customer; version by key; status by order status.
ANALYSES = """analyses AS (
  SELECT o_orderkey AS analysis_id, o_custkey AS root_section_id, o_custkey % 100 AS book_id, o_orderkey % 3 AS set_id, o_orderkey AS version, o_orderdate AS created_at,
         CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'partial' ELSE 'failed' END AS status FROM orders
), links AS (SELECT DISTINCT l_orderkey AS analysis_id, l_partkey AS card_id FROM lineitem)"""


def analyses(spark, d) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("root_section_id"), (F.col("o_custkey") % 100).alias("book_id"),
        (F.col("o_orderkey") % 3).alias("set_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"),
        F.when(s == "F", "succeeded").when(s == "P", "partial").otherwise("failed").alias("status"),
    )


def links(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("analysis_id"), F.col("l_partkey").alias("card_id")).distinct()


@query(
    "cards_superseded", "J10",
    f"""WITH {CTES}, {ANALYSES} SELECT card_id, CASE WHEN card_id IN (SELECT card_id FROM links JOIN analyses USING (analysis_id) JOIN customer ON c_custkey = root_section_id AND c_mktsegment = 'BUILDING')
               THEN 'superseded' ELSE status END AS status FROM cards""",
)
def _(spark, d):
    roots = table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("root_section_id"))
    return E.supersede(V.cards(spark, d), links(spark, d), analyses(spark, d), roots).select("card_id", "status")


@query(
    "modules_recovered", "J11",
    """WITH ch AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS c FROM lineitem GROUP BY 1),
       m AS (SELECT o_custkey AS project_id, year(o_orderdate) AS run_id, o_orderdate AS done_at, o_orderkey AS module_key, c FROM orders JOIN ch ON l_orderkey = o_orderkey),
       r AS (SELECT project_id, run_id, max(done_at) AS run_at FROM m GROUP BY ALL),
       e AS (SELECT o_custkey AS project_id, o_orderkey AS episode_id, c[1:2] AS c FROM orders JOIN ch ON l_orderkey = o_orderkey),
       hits AS (SELECT e.episode_id, m.run_id, r.run_at, m.module_key, len(m.c) = len(e.c) AS exact FROM e JOIN m USING (project_id) JOIN r ON r.project_id = m.project_id AND r.run_id = m.run_id
                WHERE list_has_all(m.c, e.c)),
       per AS (SELECT episode_id, run_id, run_at, count(*) FILTER (WHERE exact) AS ne, count(*) AS nc, min(module_key) FILTER (WHERE exact) AS ke, min(module_key) AS kc FROM hits GROUP BY ALL),
       best AS (SELECT *, CASE WHEN ne > 0 THEN ne ELSE nc END AS k, CASE WHEN ne > 0 THEN ke ELSE kc END AS key, row_number() OVER (PARTITION BY episode_id ORDER BY run_at DESC, run_id DESC) AS rn FROM per)
       SELECT e.episode_id, run_id, CASE WHEN k = 1 THEN key END AS module_key, CASE WHEN k IS NULL THEN 'none' WHEN k = 1 THEN 'recovered' ELSE 'ambiguous' END AS outcome
       FROM e LEFT JOIN best b ON b.episode_id = e.episode_id AND rn = 1""",
)
def _(spark, d):
    # An order's line numbers are its chapters: a handful per order.
    ch = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_linenumber")).alias("c"))
    o = table(spark, d, "orders").join(ch, "o_orderkey")
    modules = o.select(
        F.col("o_custkey").alias("project_id"), F.year("o_orderdate").alias("run_id"), F.col("o_orderdate").alias("_at"),
        F.col("o_orderkey").alias("module_key"), F.col("c").alias("chapters"),
    )
    at = modules.groupBy("project_id", "run_id").agg(F.max("_at").alias("run_at"))
    episodes = o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("episode_id"), F.slice("c", 1, 2).alias("chapters"))
    return E.recover_module(episodes, modules.join(at, ["project_id", "run_id"]).drop("_at"))


@query(
    "relations_found", "J12",
    """WITH e AS (SELECT o_orderkey AS episode_id, o_custkey % 100 AS book_id, [o_orderkey % 50, o_orderkey % 7] AS ss FROM orders),
            c AS (SELECT p_partkey AS card_id, p_partkey % 100 AS book_id, [p_size, p_partkey % 50] AS ss FROM part WHERE p_type IN ('PROMO', 'ECONOMY'))
       SELECT episode_id, card_id FROM e JOIN c USING (book_id) WHERE list_has_any(e.ss, c.ss)""",
)
def _(spark, d):
    episodes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("episode_id"), (F.col("o_custkey") % 100).alias("book_id"), F.array(F.col("o_orderkey") % 50, F.col("o_orderkey") % 7).alias("source_section_ids")
    )
    people = table(spark, d, "part").select(
        F.col("p_partkey").alias("card_id"), (F.col("p_partkey") % 100).alias("book_id"),
        F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 50).alias("source_section_ids"),
        F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "人物关系").otherwise(F.col("p_type")).alias("kind"),
    )
    return E.relationships_for(episodes, people)


@query("orphan_references", "J13", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey * 2 NOT IN (SELECT p_partkey FROM part)")
def _(spark, d):
    refs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 2).alias("p_partkey"))
    return E.orphan_refs(refs, table(spark, d, "part"), "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "chapter_sources", "J14 C8",
    f"""WITH RECURSIVE {V.TREE}, walk AS (
          SELECT section_id, section_id AS root_id, title AS path FROM tree WHERE parent_id IS NULL
          UNION ALL SELECT t.section_id, w.root_id, w.path || ' / ' || t.title FROM tree t JOIN walk w ON t.parent_id = w.section_id),
        ls AS (SELECT root_id, position AS p, 0 AS q, repeat('#', level) || ' ' || title AS t FROM tree JOIN walk USING (section_id) WHERE status = 'confirmed'
          UNION ALL SELECT root_id, position, 1, '[content_index: content_' || section_id || ']' || chr(10) || '[章节路径: ' || path || ']' || chr(10) || trim(content) || chr(10)
          FROM tree JOIN walk USING (section_id) WHERE status = 'confirmed' AND level = 4)
        SELECT root_id, md5(regexp_replace(string_agg(t, chr(10) ORDER BY p, q), '^\\s+|\\s+$', '', 'g')) AS digest FROM ls GROUP BY ALL""",
)
def _(spark, d):
    sections = V.tree(spark, d)
    lines = ST.lineage(sections)
    frags = sections.filter((F.col("level") == 4) & (F.col("status") == "confirmed")).join(lines.select("book_id", "section_id", "section_path"), ["book_id", "section_id"]).select(
        "book_id", F.col("section_id").alias("source_section_id"), F.concat(F.lit("content_"), "section_id").alias("content_index"), F.lit(1).alias("book_position"),
        "section_path", F.trim("content").alias("text"),
    )
    return E.chapter_source(sections, lines, frags).select("root_id", F.md5("text").alias("digest"))


@query(
    "runs_decorated", "J15",
    f"""WITH {V.RUNS}, lab AS (SELECT 'episode' AS label_type, CAST(c_custkey AS VARCHAR) AS label_id, c_name AS label FROM customer
          UNION ALL SELECT 'project_batch', CAST(s_suppkey AS VARCHAR), s_name FROM supplier)
        SELECT run_id, coalesce(label, CASE scope_type WHEN 'episode' THEN '声音文稿' WHEN 'project_batch' THEN '内容项目' ELSE '书籍拆解' END) AS scope_label
        FROM runs LEFT JOIN lab ON label_type = scope_type AND label_id = scope_id""",
)
def _(spark, d):
    labels = table(spark, d, "customer").select(F.lit("episode").alias("label_type"), F.col("c_custkey").cast("string").alias("label_id"), F.col("c_name").alias("label")).unionByName(
        table(spark, d, "supplier").select(F.lit("project_batch").alias("label_type"), F.col("s_suppkey").cast("string").alias("label_id"), F.col("s_name").alias("label"))
    )
    return E.decorate_runs(V.runs(spark, d), labels, E.DEFAULT_LABELS).select("run_id", "scope_label")


@query(
    "batch_children", "J16",
    f"WITH {V.CHILDREN} SELECT parent_run_id, run_id, status, p_name AS episode_title FROM children JOIN part ON p_partkey = episode_id",
)
def _(spark, d):
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("episode_id"), F.col("p_name").alias("episode_title"))
    return E.batch_children(V.batch_children(spark, d), titles).select("parent_run_id", "run_id", "status", "episode_title")


@query(
    "fragment_backlinks", "J17",
    f"WITH {CTES} SELECT content_index, card_id, kind, title FROM card_sources JOIN cards USING (card_id) WHERE status = 'active'",
)
def _(spark, d):
    return E.backlinks(V.card_sources(spark, d), V.cards(spark, d), ["content_index"])


@query(
    "sources_looked_up", "J18",
    """SELECT o_orderkey, array_to_string(list_filter([a.s_name, b.s_name, c.s_name], lambda x: x IS NOT NULL), ',') AS names
       FROM orders LEFT JOIN supplier a ON a.s_suppkey = o_orderkey % 150 LEFT JOIN supplier b ON b.s_suppkey = o_custkey % 130 LEFT JOIN supplier c ON c.s_suppkey = o_orderkey % 90""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 150, F.col("o_custkey") % 130, F.col("o_orderkey") % 90).alias("ids"))
    r = E.lookup_array(o, "o_orderkey", "ids", table(spark, d, "supplier"), "s_suppkey", "s_name")
    return r.select("o_orderkey", F.array_join("found", ",").alias("names"))


@query(
    "card_identities", "J19",
    "SELECT a.p_partkey AS item_id, b.p_partkey AS card_id FROM part a LEFT JOIN part b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand = b.p_brand AND b.p_retailprice > 1000",
)
def _(spark, d):
    p = table(spark, d, "part")
    shape = lambda key: [F.col("p_partkey").alias(key), F.col("p_type").alias("kind"), F.col("p_name").alias("body"), F.array(F.col("p_size").cast("string"), F.col("p_brand")).alias("indexes")]
    return E.card_identity(p.select(*shape("item_id")), p.filter("p_retailprice > 1000").select(*shape("card_id"))).select("item_id", "card_id")


@query(
    "outputs_materialized", "J20 X6",
    """WITH refs AS (SELECT o_custkey AS run_id, CASE o_orderkey % 3 WHEN 0 THEN 'episode_artifact' WHEN 1 THEN 'chapter_analysis' ELSE 'album_planning_artifact' END AS kind,
                 CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey % 2000 AS VARCHAR) WHEN 1 THEN CAST(o_orderkey % 150 AS VARCHAR) ELSE 'plan:' || (o_custkey % 7) END AS ref_id FROM orders),
            plan AS (SELECT c_custkey AS run_id, 'plan' AS planning_type, CAST(c_custkey % 7 AS VARCHAR) AS module_key, c_name AS label, c_mktsegment AS content FROM customer
                     UNION ALL SELECT c_custkey, 'extra', '0', c_name, c_mktsegment FROM customer)
       SELECT run_id, kind AS artifact_type, p_name AS label FROM refs JOIN part ON kind = 'episode_artifact' AND CAST(p_partkey AS VARCHAR) = ref_id
       UNION ALL SELECT run_id, kind, s_name FROM refs JOIN supplier ON kind = 'chapter_analysis' AND CAST(s_suppkey AS VARCHAR) = ref_id
       UNION ALL SELECT r.run_id, kind, label FROM refs r JOIN plan p ON kind = 'album_planning_artifact' AND p.run_id = r.run_id AND planning_type || ':' || module_key = ref_id
       UNION ALL SELECT p.run_id, 'album_planning_artifact', label FROM plan p
         WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE kind = 'album_planning_artifact' AND p.run_id = r.run_id AND planning_type || ':' || module_key = ref_id)""",
)
def _(spark, d):
    k = F.col("o_orderkey") % 3
    refs = table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), F.lit("s").alias("stage"),
        F.when(k == 0, "episode_artifact").when(k == 1, "chapter_analysis").otherwise("album_planning_artifact").alias("artifact_type"),
        F.when(k == 0, (F.col("o_orderkey") % 2000).cast("string")).when(k == 1, (F.col("o_orderkey") % 150).cast("string"))
        .otherwise(F.concat_ws(":", F.lit("plan"), F.col("o_custkey") % 7)).alias("ref_id"),
    )
    frames = {
        "episode_artifact": table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ref_id"), F.col("p_name").alias("label"), F.col("p_type").alias("content")),
        "chapter_analysis": table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ref_id"), F.col("s_name").alias("label"), F.lit("").alias("content")),
    }
    c = table(spark, d, "customer")
    plan = lambda kind, key: c.select(F.col("c_custkey").alias("run_id"), F.lit(kind).alias("planning_type"), key.alias("module_key"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("content"))
    planning = plan("plan", (F.col("c_custkey") % 7).cast("string")).unionByName(plan("extra", F.lit("0")))
    return E.materialize_outputs(refs, frames, planning).select("run_id", "artifact_type", "label")


@query(
    "latest_modules", "J21",
    """WITH a AS (SELECT o_custkey AS project_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 2 = 0 THEN 'module_source' ELSE 'module_outline' END AS artifact_type,
                 CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS status, year(o_orderdate) AS run_id, o_orderkey AS module_key, o_orderkey AS position, o_orderpriority AS content FROM orders),
       u AS (SELECT * FROM a WHERE status = 'succeeded'),
       b AS (SELECT project_id, run_id, artifact_type FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, (artifact_type = 'module_source') DESC, run_id DESC) AS rn FROM u) WHERE rn = 1)
       SELECT project_id, module_key, CASE WHEN module_key % 5 = 0 THEN 'title ' || module_key ELSE '知识模块 ' || position END AS title, CAST(length(content) AS BIGINT) AS character_count
       FROM u JOIN b USING (project_id, run_id, artifact_type)""",
)
def _(spark, d):
    a = table(spark, d, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 2 == 0, "module_source").otherwise("module_outline").alias("artifact_type"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded").alias("status"), F.year("o_orderdate").alias("run_id"),
        F.col("o_orderkey").alias("module_key"), F.col("o_orderkey").alias("position"), F.col("o_orderpriority").alias("content"),
    )
    titles = a.filter(F.col("module_key") % 5 == 0).select("run_id", "module_key", F.concat_ws(" ", F.lit("title"), "module_key").alias("module_title"))
    return E.latest_modules(a, titles).select("project_id", "module_key", "title", F.col("character_count").cast("bigint").alias("character_count"))


@query(
    "chapter_titles", "J22",
    f"WITH {ANALYSES} SELECT analysis_id, c_name AS chapter_title, version, status FROM analyses JOIN customer ON c_custkey = root_section_id",
)
def _(spark, d):
    titles = table(spark, d, "customer").select(F.col("c_custkey").alias("root_section_id"), F.col("c_name").alias("chapter_title"))
    return E.chapter_titles(analyses(spark, d), titles).select("analysis_id", "chapter_title", "version", "status")


@query(
    "project_link_violations", "J23 X7",
    """WITH e AS (SELECT o_orderkey AS episode_id, o_custkey AS project_id, unnest([o_orderkey % 120, o_custkey % 100]) AS section_id FROM orders)
       SELECT episode_id, section_id, s_nationkey AS book_id FROM e JOIN customer ON c_custkey = project_id LEFT JOIN supplier ON s_suppkey = section_id
       WHERE s_nationkey IS NULL OR NOT list_contains([c_nationkey, (c_nationkey + 1) % 25, 3], s_nationkey)""",
)
def _(spark, d):
    episodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("project_id"), F.array(F.col("o_orderkey") % 120, F.col("o_custkey") % 100).alias("source_section_ids"))
    sections = table(spark, d, "supplier").select(F.col("s_suppkey").alias("section_id"), F.col("s_nationkey").alias("book_id"))
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25, F.lit(3)).alias("book_ids"))
    return E.project_link_violations(episodes, sections, projects).select("episode_id", "section_id", "book_id")


@query(
    "episode_indexes", "A10 X4",
    f"""WITH {CTES}, o AS (SELECT e.episode_id, s.content_index, row_number() OVER (PARTITION BY e.episode_id, s.content_index ORDER BY e.position, CAST(e.card_id AS VARCHAR), s.source_order) AS rn,
               e.position, e.card_id, s.source_order FROM episode_cards e JOIN card_sources s USING (card_id) WHERE e.episode_id % 3 <> 0)
        SELECT episode_id, CAST(content_index AS VARCHAR) AS content_index, CAST(position AS BIGINT) AS position, CAST(card_id AS VARCHAR) AS card_id FROM o WHERE rn = 1
        UNION ALL SELECT o_orderkey, 'content_n' || o_custkey, 0, '' FROM orders
        WHERE NOT (o_orderkey % 2 = 0 AND o_custkey % 100 < 50) AND o_orderkey NOT IN (SELECT episode_id FROM o)""",
)
def _(spark, d):
    episodes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("episode_id"), (F.col("o_custkey") % 100).alias("book_id"), F.array(F.concat(F.lit("n-"), F.col("o_custkey").cast("string"))).alias("source_section_ids"),
        (F.col("o_orderkey") % 2 == 0).alias("has_root_source"),
    )
    linked = V.episode_cards(spark, d).filter(F.col("episode_id") % 3 != 0)
    sources = V.card_sources(spark, d).withColumn("content_index", F.col("content_index").cast("string"))
    precise = episodes.select("book_id").filter("book_id < 50")
    return E.episode_indexes(episodes, linked, sources, precise).select("episode_id", "content_index", "place.position", "place.card_id")


# Filters -----------------------------------------------------------------------


@query("confirmed_roots", "F1", f"WITH {V.TREE} SELECT section_id, position FROM tree WHERE parent_id IS NULL AND status = 'confirmed' AND analysis_enabled")
def _(spark, d):
    return L.confirmed_roots(V.tree(spark, d)).select("section_id", "position")


@query("article_sections", "F2 W13", f"WITH {V.TREE} SELECT section_id, title FROM tree WHERE kind IN ('article', 'section') AND trim(content) <> ''")
def _(spark, d):
    return L.article_sections(V.tree(spark, d)).select("section_id", "title")


@query("active_cards", "F3", f"WITH {V.CARDS} SELECT card_id, kind FROM cards WHERE status = 'active' AND source_scheme = '{E.EVIDENCE_SCHEME}'")
def _(spark, d):
    return L.active_evidence_cards(V.cards(spark, d)).select("card_id", "kind")


@query("recent_runs", "F4", f"WITH {V.RUNS} SELECT run_id, status FROM runs WHERE status IN ('pending', 'running') AND scope_type = 'episode' ORDER BY created_at DESC, run_id DESC LIMIT 100")
def _(spark, d):
    return R.list_runs(V.runs(spark, d), active_only=True, scope_type="episode").select("run_id", "status")


@query("incomplete_runs", "F5", f"WITH {V.RUNS} SELECT run_id, scope_type FROM runs WHERE status IN ('pending', 'running') AND (scope_type <> 'episode' OR parent_run_id IS NULL)")
def _(spark, d):
    return R.incomplete_runs(V.runs(spark, d)).select("run_id", "scope_type")


@query(
    "unfinished_books", "F6",
    f"""WITH {V.RUNS} SELECT CAST(c_custkey AS VARCHAR) AS book_id FROM customer WHERE EXISTS (
          SELECT 1 FROM runs WHERE status IN ('pending', 'running') AND (scope_id = CAST(c_custkey AS VARCHAR) OR json_extract_string(metadata, '$.book_id') = CAST(c_custkey AS VARCHAR)))""",
)
def _(spark, d):
    return R.unfinished_for(V.runs(spark, d), table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("book_id")))


@query("null_safe_scope", "F7", f"WITH {V.RUNS} SELECT run_id FROM runs WHERE parent_run_id IS NOT DISTINCT FROM CASE WHEN run_id % 8 = 0 THEN CAST(scope_id AS BIGINT) END")
def _(spark, d):
    other = F.when(F.col("run_id") % 8 == 0, F.col("scope_id").cast("bigint"))
    return V.runs(spark, d).filter(L.scope_match(F.col("parent_run_id"), other)).select("run_id")


@query(
    "framework_backfilled", "F8",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '围绕“' || p_name || '”展开：先说明本集要解决的问题，再梳理关联原文中的核心观点、事件或案例，最后总结其意义。' ELSE p_brand END AS framework FROM part",
)
def _(spark, d):
    f = F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", L.backfill_framework(f, F.col("p_name")).alias("framework"))


@query("structural_sections", "F9", f"WITH {V.TREE} SELECT section_id, level FROM tree WHERE level <= 4")
def _(spark, d):
    return L.structural_sections(V.tree(spark, d)).select("section_id", "level")


@query("title_flags", "F10", "SELECT p_partkey, regexp_matches(p_name, 'ring|widget') AS flagged FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.title_flag(F.col("p_name"), ("ring", "widget")).alias("flagged"))


# Aggregates ---------------------------------------------------------------------


@query(
    "book_stats", "A1",
    f"""WITH {V.TREE}, c AS (SELECT 'r' || (p_partkey % 5) AS book_id, count(*) AS cards FROM part WHERE p_size % 10 <> 0 GROUP BY 1)
        SELECT book_id, count(*) AS sections, count(*) FILTER (WHERE level = 3) AS themes, count(*) FILTER (WHERE level = 4) AS articles, coalesce(any_value(cards), 0) AS cards
        FROM tree LEFT JOIN c USING (book_id) GROUP BY book_id""",
)
def _(spark, d):
    cards = V.cards(spark, d).withColumn("book_id", F.concat(F.lit("r"), F.col("book_id").cast("string")))
    return L.book_stats(V.tree(spark, d), cards)


@query("cards_by_kind", "A2", "SELECT p_type AS kind, count(*) AS cards FROM part GROUP BY 1")
def _(spark, d):
    return L.cards_by_kind(V.cards(spark, d))


@query(
    "project_stats", "A3",
    """SELECT o_custkey AS project_id, count(*) AS episodes, count(*) FILTER (WHERE o_orderstatus IN ('F', 'O')) AS completed, bool_and(o_orderstatus IN ('F', 'O')) AS all_done FROM orders GROUP BY 1""",
)
def _(spark, d):
    s = F.col("o_orderstatus")
    return L.project_stats(table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(s == "F", "completed").when(s == "O", "review").otherwise("draft").alias("status")))


BATCH = f"""WITH {V.CHILDREN}, c AS (SELECT parent_run_id, count(*) AS total, count(*) FILTER (WHERE status = 'succeeded') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'cancelled') AS cancelled, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending') AS pending FROM children GROUP BY 1)"""


@query("batch_progress", "A4", f"{BATCH} SELECT parent_run_id, completed + failed + cancelled AS progress_current, total AS progress_total FROM c")
def _(spark, d):
    return R.batch_progress(V.batch_children(spark, d))


@query(
    "batch_outcome", "A5",
    f"""{BATCH} SELECT parent_run_id, CASE WHEN failed > 0 THEN 'partial_failed' WHEN cancelled > 0 THEN 'cancelled' ELSE 'succeeded' END AS batch_status,
          CASE WHEN failed > 0 THEN 'partial_failed' WHEN cancelled > 0 THEN 'ready' ELSE 'review' END AS project_status,
          CASE WHEN failed > 0 THEN completed || ' 条完成，' || failed || ' 条失败' WHEN cancelled > 0 THEN '批次已取消' ELSE completed || ' 条声音终稿已生成' END AS message FROM c""",
)
def _(spark, d):
    return R.batch_outcome(V.batch_children(spark, d))


@query("batch_summary", "A6", f"{BATCH} SELECT parent_run_id, total, completed, failed, running, pending, CAST(floor(completed * 100.0 / total + 0.5) AS BIGINT) AS percent FROM c")
def _(spark, d):
    return R.batch_summary(V.batch_children(spark, d))


@query(
    "analysis_outcome", "A7",
    """WITH o AS (SELECT source AS book_id, CASE WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'partial' WHEN quality = 1 THEN 'succeeded' ELSE 'waiting' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)),
       c AS (SELECT book_id, count(*) AS roots, count(*) FILTER (WHERE outcome = 'succeeded') AS succeeded, count(*) FILTER (WHERE outcome = 'partial') AS partial, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o GROUP BY 1)
       SELECT *, CASE WHEN failed + partial = 0 AND succeeded = roots THEN 'analyzed' WHEN failed + partial > 0 THEN 'analysis_partial_failed' ELSE 'analysis_partial' END AS status,
              '成功 ' || succeeded || ' 章，部分成功 ' || partial || ' 章，失败 ' || failed || ' 章' AS message FROM c""",
)
def _(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    outcome = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "partial").when(F.col("quality") == 1, "succeeded").otherwise("waiting")
    return R.analysis_outcome(j.select(F.col("source").alias("book_id"), outcome.alias("outcome")))


@query(
    "traceability", "A8",
    f"""WITH {ANALYSES}, n AS (SELECT c_custkey % 100 AS book_id, count(*) AS roots FROM customer GROUP BY 1),
          p AS (SELECT book_id, count(DISTINCT root_section_id) AS precise FROM analyses WHERE status = 'succeeded' GROUP BY 1)
        SELECT book_id, roots, coalesce(precise, 0) AS precise, CASE WHEN coalesce(precise, 0) >= roots THEN 'unchanged' WHEN precise > 0 THEN 'analysis_partial' ELSE 'ready_to_analyze' END AS next_status
        FROM n LEFT JOIN p USING (book_id)""",
)
def _(spark, d):
    roots = table(spark, d, "customer").select((F.col("c_custkey") % 100).alias("book_id"))
    return R.traceability_status(roots, analyses(spark, d))


@query(
    "all_ready", "A9 W3",
    f"""WITH {ANALYSES}, l AS (SELECT root_section_id, arg_max(status, version) AS status FROM analyses GROUP BY 1)
        SELECT c_custkey % 1000 AS book_id, bool_and(coalesce(status = 'succeeded', false)) AS all_ready FROM customer LEFT JOIN l ON root_section_id = c_custkey GROUP BY 1""",
)
def _(spark, d):
    roots = table(spark, d, "customer").select((F.col("c_custkey") % 1000).alias("book_id"), F.col("c_custkey").alias("root_section_id"))
    return R.all_ready(roots, W.latest_artifact(analyses(spark, d), ["root_section_id"]))


@query(
    "material_sizes", "A13",
    "SELECT conv_id AS owner_id, CAST(sum(length(text)) AS BIGINT) AS characters, bool_or(length(text) > 500) AS truncated FROM conversations GROUP BY 1",
)
def _(spark, d):
    return L.material_sizes(table(spark, d, "conversations").select(F.col("conv_id").alias("owner_id"), F.col("text").alias("value")), 500)


@query("fragment_counts", "A14", f"WITH {CURRENT} SELECT set_id, count(*) AS fragments FROM cur GROUP BY 1")
def _(spark, d):
    return L.fragment_counts(current(spark, d), ["set_id"])


@query("run_stats", "A15", f"WITH {V.RUNS} SELECT count(*) FILTER (WHERE status = 'succeeded') AS succeeded, count(*) FILTER (WHERE status IN ('pending', 'running') AND parent_run_id IS NULL) AS active FROM runs")
def _(spark, d):
    return R.run_stats(V.runs(spark, d))


# Set operations -------------------------------------------------------------------


@query("missing_keys", "X1", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 10 = 0)")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_suppkey")
    return S.missing_keys(li, li.filter("l_returnflag = 'R' AND l_suppkey % 10 = 0"), ["l_partkey"])


@query(
    "ids_preserved", "X2",
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'content_' || lpad(lower(hex(l_suppkey)), 8, '0') AS c, 'knowledge_' || lpad(lower(hex(l_partkey)), 24, '0') AS k FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS missing, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS unexpected FROM a""",
)
def _(spark, d):
    c = F.concat(F.lit("content_"), F.lpad(F.lower(F.hex("l_suppkey")), 8, "0"))
    k = F.concat(F.lit("knowledge_"), F.lpad(F.lower(F.hex("l_partkey")), 24, "0"))
    before = F.concat_ws(" ", c, k, c)
    after = F.concat_ws(" ", k, F.when(F.col("l_linenumber") % 2 == 1, c), F.when(F.col("l_linenumber") % 3 == 0, F.lit("content_ffffffffff")))
    r = S.id_preservation(before, after)
    return table(spark, d, "lineitem").withColumn("r", r).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("r.missing").cast("bigint").alias("missing"), F.col("r.unexpected").cast("bigint").alias("unexpected"))


@query(
    "groups_compared", "X3",
    """WITH a AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_tax < 0.05)
       SELECT l_orderkey, count(*) FILTER (WHERE b.l_partkey IS NULL) AS only_left, CAST(0 AS BIGINT) AS only_right FROM a LEFT JOIN b USING (l_orderkey, l_partkey) GROUP BY 1""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_tax")
    return S.differing_groups(li, li.filter("l_tax < 0.05"), ["l_orderkey"], "l_partkey")


@query("reused_assets", "X5", "SELECT l_partkey AS card_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def _(spark, d):
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_linestatus = 'F'")
    return S.reused_assets(li.select(F.col("l_partkey").alias("card_id"), "l_orderkey"), "l_orderkey", "card_id")


@query(
    "subset_checks", "X7 X3",
    """SELECT o_orderkey, list_has_all([o_orderkey % 3, o_custkey % 3, 2], [o_orderkey % 4, o_custkey % 2]) AS subset,
              list_has_all([o_orderkey % 3, o_custkey % 3], [o_custkey % 2, o_orderkey % 2]) AND list_has_all([o_custkey % 2, o_orderkey % 2], [o_orderkey % 3, o_custkey % 3]) AS same FROM orders""",
)
def _(spark, d):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", S.subset(F.array(o % 4, c % 2), F.array(o % 3, c % 3, F.lit(2).cast("bigint"))).alias("subset"),
        S.same_set(F.array(o % 3, c % 3), F.array(c % 2, o % 2)).alias("same"),
    )


@query("duplicate_lines", "X1", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return L.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


# Quotes across the corpus -----------------------------------------------------------


_VARIED = """q AS (SELECT item_id * 5 + v AS quote_id, CASE v WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN replace(text, ' ', '; ') WHEN 3 THEN left(text, 30) || ' 结尾不同' ELSE left(text, 7) END AS quote
  FROM benchmark, (SELECT unnest([0, 1, 2, 3, 4]) AS v))"""
_CLEAN = "[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]"
# White space as Unicode defines it, so that both engines drop the same characters.
_BLANK = "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@query(
    "quotes_located", "C17",
    f"""WITH {_VARIED}, d AS (SELECT doc_id, text, regexp_replace(text, '{_BLANK}', '', 'g') AS t2, regexp_replace(text, '{_CLEAN}', '', 'g') AS t3 FROM documents),
          k AS (SELECT quote_id, quote, regexp_replace(quote, '{_BLANK}', '', 'g') AS q2, regexp_replace(quote, '{_CLEAN}', '', 'g') AS q3 FROM q),
          g AS (SELECT *, CASE WHEN contains(text, quote) THEN 1 WHEN q2 <> '' AND contains(t2, q2) THEN 2 WHEN q3 <> '' AND contains(t3, q3) THEN 3 WHEN q3 <> '' AND contains(t3, left(q3, 12)) THEN 4 END AS level FROM d, k)
        SELECT doc_id, quote_id, CAST(level AS BIGINT) AS level, CAST(CASE level WHEN 1 THEN strpos(text, quote) - 1
            WHEN 2 THEN list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(substr(text, i, 1), '{_BLANK}'))[strpos(t2, q2)] - 1
            ELSE list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(substr(text, i, 1), '{_CLEAN}'))[strpos(t3, CASE level WHEN 3 THEN q3 ELSE left(q3, 12) END)] - 1 END AS BIGINT) AS quote_offset
        FROM g WHERE level IS NOT NULL""",
)
def _(spark, d):
    t = F.col("text")
    varied = F.array(t, F.replace(t, F.lit(" "), F.lit("  ")), F.replace(t, F.lit(" "), F.lit("; ")), F.concat(F.left(t, F.lit(30)), F.lit(" 结尾不同")), F.left(t, F.lit(7)))
    quotes = table(spark, d, "benchmark").select("item_id", F.posexplode(varied).alias("v", "quote")).select((F.col("item_id") * 5 + F.col("v")).alias("quote_id"), "quote")
    found = Q.locate_quotes(table(spark, d, "documents").select("doc_id", "text"), quotes)
    return found.select("doc_id", "quote_id", F.col("level").cast("bigint").alias("level"), "quote_offset")
