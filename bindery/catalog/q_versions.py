"""Versions, ranked picks and run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fragments as FR, runs as R, versions as W
from ..ordered import position_block, running
from . import views as V
from .q_evidence import ANALYSES, analyses
from .registry import query, table


@query(
    "latest_artifacts", "W1",
    f"WITH {V.ARTIFACTS} SELECT episode_id, stage, max(version) AS version, arg_max(content, version) AS content FROM artifacts GROUP BY 1, 2",
)
def _(spark, d):
    return W.latest_artifact(V.artifacts(spark, d)).select("episode_id", "stage", "version", "content")


@query(
    "versions_appended", "W2",
    """WITH old AS (SELECT l_partkey AS k, max(l_linenumber) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
            new AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'A')
       SELECT new.k AS part, l_orderkey, l_linenumber, l_suppkey, coalesce(top, 0) + row_number() OVER (PARTITION BY new.k ORDER BY l_orderkey, l_linenumber, l_suppkey) AS version
       FROM new LEFT JOIN old USING (k)""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    old = li.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("version"))
    new = li.filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_suppkey")
    return W.append_version(old, new, ["part"], ["l_orderkey", "l_linenumber", "l_suppkey"], position_block(F.col("l_orderkey")))


def _latest(mode: str, sql: str):
    @query(f"analyses_{mode}", "W3", f"WITH {ANALYSES} {sql}")
    def _(spark, d):
        return W.latest_analysis(analyses(spark, d), mode).select("root_section_id", "analysis_id", "version")


_latest("newest_succeeded", "SELECT root_section_id, max(analysis_id) AS analysis_id, max(version) AS version FROM analyses WHERE status = 'succeeded' GROUP BY root_section_id, set_id")
_latest(
    "newest_if_ok",
    "SELECT root_section_id, analysis_id, version FROM (SELECT *, row_number() OVER (PARTITION BY root_section_id, set_id ORDER BY version DESC) AS rn FROM analyses) WHERE rn = 1 AND status = 'succeeded'",
)
_latest(
    "newest_overall",
    "SELECT root_section_id, analysis_id, version FROM (SELECT *, row_number() OVER (PARTITION BY root_section_id ORDER BY version DESC) AS rn FROM analyses) WHERE rn = 1 AND status = 'succeeded'",
)


@query(
    "versions_on_change", "W4",
    """WITH p AS (SELECT user_id AS book_id, event_id, ts, event_type, lag(event_type) OVER w AS prior FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
            n AS (SELECT *, event_type IS DISTINCT FROM prior AS is_new FROM p),
            v AS (SELECT *, CAST(sum(is_new::INT) OVER (PARTITION BY book_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM n)
       SELECT book_id, event_id, version, is_new, CASE WHEN version = max(version) OVER (PARTITION BY book_id) THEN 'current' ELSE 'historical' END AS status FROM v""",
)
def _(spark, d):
    prints = table(spark, d, "events").select(F.col("user_id").alias("book_id"), "event_id", F.col("event_type").alias("content_fingerprint"))
    # Event ids follow time in this table, so they order the history.
    r = FR.version_on_change(prints, "book_id", "event_id", position_block(F.col("event_id"), 1024))
    return r.select("book_id", "event_id", "version", "is_new", "status")


@query("rows_enumerated", "W5", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return W.enumerate_rows(o, ["o_custkey"], ["o_orderkey"], position_block(F.col("o_orderkey"))).select("o_orderkey", "position")


@query("version_history", "W6 W13", f"WITH {V.ARTIFACTS} SELECT episode_id, stage, version, length(content) AS chars FROM artifacts")
def _(spark, d):
    return W.version_history(V.artifacts(spark, d).select("episode_id", "stage", "version", F.length("content").cast("bigint").alias("chars")))


@query(
    "first_missing_stages", "W7",
    f"""WITH {V.ARTIFACTS}, h AS (SELECT episode_id, bool_or(stage = 'outline') AS o, bool_or(stage = 'draft') AS d, bool_or(stage = 'final') AS f FROM artifacts GROUP BY 1),
          s AS (SELECT o_orderkey AS episode_id, CASE WHEN NOT coalesce(o, false) THEN 'outline' WHEN NOT coalesce(d, false) THEN 'draft' ELSE 'final' END AS from_stage FROM orders LEFT JOIN h ON episode_id = o_orderkey)
        SELECT s.episode_id, from_stage, CASE WHEN l.l_orderkey IS NULL THEN 'match_episode_sources,' ELSE '' END || CASE from_stage WHEN 'outline' THEN 'outline,draft,final' WHEN 'draft' THEN 'draft,final' ELSE 'final' END AS target_stages
        FROM s LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON l.l_orderkey = s.episode_id""",
)
def _(spark, d):
    episodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"))
    r = W.first_missing_stage(episodes, V.artifacts(spark, d), V.episode_cards(spark, d))
    return r.select("episode_id", "from_stage", F.array_join("target_stages", ",").alias("target_stages"))


@query(
    "latest_runs", "W8 R4",
    f"""WITH {V.RUNS} SELECT scope_type, scope_id, parent_run_id, arg_max(run_id, (created_at, run_id)) AS run_id FROM runs WHERE status IN ('pending', 'running') GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return R.dedupe_active(V.runs(spark, d)).select("scope_type", "scope_id", "parent_run_id", "run_id")


@query(
    "latest_failed_children", "W8",
    f"WITH {V.CHILDREN} SELECT episode_id, arg_max(run_id, (created_at, run_id)) AS run_id FROM children WHERE status = 'failed' GROUP BY 1",
)
def _(spark, d):
    return R.latest_failed_child(V.batch_children(spark, d))


@query(
    "effective_prompts", "W9",
    """WITH t AS (SELECT n_nationkey AS template_id, n_nationkey * 10 AS sys, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 + 1 END AS glb FROM nation),
            p AS (SELECT c_custkey AS project_id, unnest([c_nationkey, (c_nationkey + 1) % 25]) AS template_id FROM customer),
            b AS (SELECT DISTINCT o_custkey AS project_id, CAST(o_custkey % 25 AS INTEGER) AS template_id FROM orders)
       SELECT p.project_id, t.template_id, CASE WHEN b.project_id IS NOT NULL THEN 'project' WHEN glb IS NOT NULL THEN 'global' ELSE 'system' END AS source_scope,
              CASE WHEN b.project_id IS NOT NULL THEN '项目 v3' WHEN glb IS NOT NULL THEN '全局 v2' ELSE '系统默认' END AS source_label
       FROM p JOIN t USING (template_id) LEFT JOIN b ON b.project_id = p.project_id AND b.template_id = t.template_id""",
)
def _(spark, d):
    n = F.col("n_nationkey")
    templates = table(spark, d, "nation").select(
        n.alias("template_id"), n.cast("string").alias("stage_key"), (n * 10).alias("system_version_id"), F.when(n % 2 == 0, n * 10 + 1).alias("global_version_id")
    )
    versions = table(spark, d, "nation").select(F.explode(F.array(*[F.struct((n * 10 + k).alias("version_id"), F.lit(k + 1).alias("version"), F.lit("t").alias("user_template")) for k in range(3)])).alias("v")).select("v.*")
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25).alias("template_ids"))
    k = (F.col("o_custkey") % 25).cast("int")
    bindings = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), k.alias("template_id"), (k * 10 + 2).alias("active_version_id")).distinct()
    return W.effective_prompt(projects, templates, versions, bindings).select("project_id", "template_id", "source_scope", "source_label")


@query(
    "top_per_parent", "W10 W11",
    """SELECT s_nationkey, s_suppkey, rank, CASE WHEN rank > 1 AND rank % 4 = 0 THEN '过渡' ELSE '解读' END AS content_type
       FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rank FROM supplier) WHERE rank <= 8""",
)
def _(spark, d):
    r = W.topk_per_parent(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), ["s_nationkey"], ["s_suppkey"], 8)
    return r.select("s_nationkey", "s_suppkey", F.col("rank").cast("bigint").alias("rank"), W.every_nth_type(F.col("rank")).alias("content_type"))


@query("recent_rows", "W12", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, d):
    return W.recent(table(spark, d, "events"), "ts", "event_id").select("event_id", "event_type")


@query(
    "planning_upserted", "P19",
    """SELECT user_id AS run_id, event_type AS artifact_type, arg_max(props, (ts, event_id)) AS content, epoch_us(min(ts)) AS created_us, epoch_us(max(ts)) AS updated_us FROM events GROUP BY 1, 2""",
)
def _(spark, d):
    log = table(spark, d, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("artifact_type"), F.lit("").alias("module_key"), F.col("props").alias("content"),
        F.lit("succeeded").alias("status"), F.lit("").alias("error_message"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )
    r = W.upsert_planning(log)
    return r.select("run_id", "artifact_type", "content", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query(
    "prompts_published", "M5",
    """WITH old AS (SELECT o_orderpriority AS template_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS project_id, count(*) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
            new AS (SELECT o_orderkey, o_orderpriority AS template_id, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS project_id FROM orders WHERE o_orderstatus = 'O')
       SELECT n.o_orderkey AS ordinal, coalesce(top, 0) + row_number() OVER (PARTITION BY n.template_id, n.project_id ORDER BY n.o_orderkey) AS version
       FROM new n LEFT JOIN old o ON o.template_id = n.template_id AND o.project_id IS NOT DISTINCT FROM n.project_id""",
)
def _(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("template_id"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("project_id"), "o_orderstatus"
    ).withColumn("scope", F.when(F.col("project_id").isNull(), "global").otherwise("project"))
    old = running(o.filter("o_orderstatus = 'F'"), ["template_id", "scope", "project_id"], ["ordinal"], position_block(F.col("ordinal")), number="version")
    return W.publish_versions(old, o.filter("o_orderstatus = 'O'"), position_block(F.col("ordinal"))).select("ordinal", "version")


# Run state -----------------------------------------------------------------------


@query(
    "run_states", "R1",
    f"""WITH {V.RUN_EVENTS}, every AS (SELECT run_id, ts, seq, status FROM run_events UNION ALL SELECT -1, make_timestamp(1704067200000000 + epoch_us(ts) % 3600000000), seq, status FROM run_events WHERE seq % 2 = 0),
          s AS (SELECT *, last_value(CASE WHEN status <> 'running' THEN status END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS settled FROM every),
          a AS (SELECT * FROM s WHERE NOT (status = 'running' AND settled IS NOT DISTINCT FROM 'cancelled'))
        SELECT run_id, arg_max(status, (ts, seq)) AS status, count(*) FILTER (WHERE status = 'running') AS attempt, epoch_us(min(ts) FILTER (WHERE status = 'running')) AS started_us,
               CASE WHEN arg_max(status, (ts, seq)) IN ('succeeded', 'failed', 'cancelled') THEN epoch_us(max(ts)) END AS finished_us FROM a GROUP BY 1""",
)
def _(spark, d):
    # One run holds half of all events within one hour: every even event, moved there, as run -1.
    e = V.run_events(spark, d)
    hour = F.timestamp_micros(1_704_067_200_000_000 + F.unix_micros(F.col("ts").cast("timestamp")) % 3_600_000_000).cast(e.schema["ts"].dataType)
    hot = e.where("seq % 2 = 0").withColumns({"run_id": F.lit(-1).cast(e.schema["run_id"].dataType), "ts": hour})
    r = R.fold_runs(e.unionByName(hot))
    return r.select("run_id", "status", "attempt", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_us"))


@query(
    "progress_clamped", "R2",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND t > 0 THEN t WHEN t > 0 THEN least(c, t) ELSE c END AS progress
       FROM (SELECT o_orderkey, o_orderstatus, greatest(0, o_orderkey % 20 - 5) AS c, greatest(0, o_custkey % 10 - 2) AS t FROM orders)""",
)
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("running")
    return table(spark, d, "orders").select("o_orderkey", R.clamp_progress(F.col("o_orderkey") % 20 - 5, F.col("o_custkey") % 10 - 2, status).alias("progress"))


@query(
    "stage_maps", "R3",
    """WITH l AS (SELECT user_id AS run_id, event_type AS stage, arg_max(props, (ts, event_id)) AS message FROM events GROUP BY 1, 2)
       SELECT run_id, string_agg(stage || '=' || message, ';' ORDER BY stage) AS stages FROM l GROUP BY 1""",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), F.lit("done").alias("status"), F.col("props").alias("message"), "ts", F.col("event_id").alias("seq"))
    r = R.merge_stage_map(e)
    pairs = F.transform(F.array_sort(F.map_keys("stages")), lambda k: F.concat_ws("=", k, F.col("stages")[k]["message"]))
    return r.select("run_id", F.array_join(pairs, ";").alias("stages"))


@query(
    "cancel_cascades", "R5",
    f"""WITH {V.CHILDREN} SELECT run_id, CASE WHEN o_orderstatus = 'F' AND status IN ('pending', 'running') THEN 'cancelled' ELSE status END AS stopped,
          CASE WHEN o_orderstatus = 'F' AND status = 'pending' THEN 'cancelled' ELSE status END AS batch_stopped
        FROM children LEFT JOIN orders ON o_orderkey = parent_run_id""",
)
def _(spark, d):
    children = V.batch_children(spark, d)
    cancelled = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"))
    plain = R.cancel_cascade(children.withColumn("_was", F.col("status")), cancelled, batch=False).drop("message").withColumnRenamed("status", "stopped")
    both = R.cancel_cascade(plain.withColumnRenamed("_was", "status"), cancelled, batch=True)
    return both.select("run_id", "stopped", F.col("status").alias("batch_stopped"))


@query(
    "batches_reconciled", "R6 A5",
    f"""WITH {V.CHILDREN}, n AS (SELECT arg_max(run_id, (created_at, run_id)) AS run_id, episode_id FROM children WHERE status = 'failed' GROUP BY episode_id),
          x AS (SELECT c.parent_run_id, CASE WHEN c.run_id IN (SELECT run_id FROM n JOIN part ON p_partkey = episode_id AND p_size > 25) THEN 'succeeded' ELSE status END AS status FROM children c)
        SELECT parent_run_id, CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'partial_failed' WHEN count(*) FILTER (WHERE status = 'cancelled') > 0 THEN 'cancelled' ELSE 'succeeded' END AS batch_status
        FROM x GROUP BY 1""",
)
def _(spark, d):
    later = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("episode_id"))
    return R.batch_outcome(R.reconcile(V.batch_children(spark, d), later)).select("parent_run_id", "batch_status")


@query(
    "runs_to_resume", "R7",
    f"""WITH {V.RUNS} SELECT run_id, 'pending' AS status, CASE run_id % 4 WHEN 0 THEN 'outline,draft,final' WHEN 1 THEN 'draft,final' WHEN 2 THEN 'final' ELSE '' END AS todo,
          CASE run_id % 4 WHEN 0 THEN 'outline' WHEN 1 THEN 'draft' ELSE 'final' END AS next_stage FROM runs WHERE status IN ('pending', 'running')""",
)
def _(spark, d):
    order = F.array(*[F.lit(s) for s in W.STAGES])
    r = V.runs(spark, d).withColumn("target_stages", order).withColumn("done_stages", F.slice(order, F.lit(1), (F.col("run_id") % 4).cast("int")))
    return R.resume_set(r).select("run_id", "status", F.array_join("todo_stages", ",").alias("todo"), "next_stage")
