"""Run state derived from an event log, and batch roll-ups.

Everything here is an aggregate with map-side combine, an equi join, or a fold
in pieces (`run_fold`), so no run's history is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import run_fold

ACTIVE = ("pending", "running")
TERMINAL = ("succeeded", "partial_failed", "failed", "cancelled")


def fold_runs(events: DataFrame) -> DataFrame:
    """Current state per run from a log of (run_id, ts, seq, status).

    started_at is the first running update and never moves; finished_at is
    empty again after a re-run; every accepted running update is an attempt;
    a cancelled run accepts none. No run's events are gathered (`run_fold`).
    """
    state = run_fold.fold(events)
    return state.withColumn("finished_at", F.when(F.col("status").isin(*TERMINAL), F.col("heartbeat_at")))


def clamp_progress(current: Column, total: Column, status: Column) -> Column:
    low = F.greatest(F.lit(0), current)
    top = F.greatest(F.lit(0), total)
    return F.when((status == "succeeded") & (top > 0), top).when(top > 0, F.least(low, top)).otherwise(low)


def merge_stage_map(stage_events: DataFrame) -> DataFrame:
    """Latest struct per (run, stage), then one map per run; stages are few."""
    last = stage_events.groupBy("run_id", "stage").agg(
        F.max_by(F.struct("status", "message"), F.struct("ts", "seq")).alias("state")
    )
    return last.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", "state")))).alias("stages"))


def dedupe_active(runs: DataFrame) -> DataFrame:
    """The newest active run per scope and parent: the one to be reused."""
    active = runs.filter(F.col("status").isin(*ACTIVE))
    keep = [c for c in runs.columns if c not in ("scope_type", "scope_id", "parent_run_id")]
    best = active.groupBy("scope_type", "scope_id", "parent_run_id").agg(
        F.max_by(F.struct(*keep), F.struct("created_at", "run_id")).alias("_r")
    )
    return best.select("scope_type", "scope_id", "parent_run_id", "_r.*")


def cancel_cascade(children: DataFrame, cancelled: DataFrame, *, batch: bool) -> DataFrame:
    """Children of cancelled parents; a batch only stops those still pending."""
    parents = cancelled.select(F.col("run_id").alias("parent_run_id")).distinct().withColumn("_c", F.lit(True))
    stoppable = F.col("status").isin("pending") if batch else F.col("status").isin(*ACTIVE)
    out = children.join(parents, "parent_run_id", "left")
    message = "批次已取消" if batch else "父任务已取消"
    hit = F.col("_c") & stoppable
    return (
        out.withColumn("message", F.when(hit, F.lit(message)))
        .withColumn("status", F.when(hit, F.lit("cancelled")).otherwise(F.col("status")))
        .drop("_c")
    )


def batch_counts(children: DataFrame) -> DataFrame:
    status = F.col("status")
    return children.groupBy("parent_run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "succeeded").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "cancelled").alias("cancelled"),
        F.count_if(status == "running").alias("running"),
        F.count_if(status == "pending").alias("pending"),
        F.count_if(status.isin(*TERMINAL)).alias("terminal"),
    )


def batch_progress(children: DataFrame) -> DataFrame:
    return batch_counts(children).select("parent_run_id", F.col("terminal").alias("progress_current"), F.col("total").alias("progress_total"))


def batch_outcome(children: DataFrame) -> DataFrame:
    """Batch and project status with message, from child states."""
    c = batch_counts(children)
    failed, cancelled = F.col("failed") > 0, F.col("cancelled") > 0
    return c.select(
        "parent_run_id",
        F.when(failed, "partial_failed").when(cancelled, "cancelled").otherwise("succeeded").alias("batch_status"),
        F.when(failed, "partial_failed").when(cancelled, "ready").otherwise("review").alias("project_status"),
        F.when(failed, F.format_string("%d 条完成，%d 条失败", F.col("completed"), F.col("failed")))
        .when(cancelled, F.lit("批次已取消"))
        .otherwise(F.format_string("%d 条声音终稿已生成", F.col("completed")))
        .alias("message"),
    )


def batch_summary(children: DataFrame) -> DataFrame:
    c = batch_counts(children)
    percent = F.when(F.col("total") > 0, F.floor(F.col("completed") * 100.0 / F.col("total") + 0.5)).otherwise(F.lit(0))
    return c.select("parent_run_id", "total", "completed", "failed", "running", "pending", percent.cast("bigint").alias("percent"))


def reconcile(children: DataFrame, later: DataFrame) -> DataFrame:
    """Failed children whose episode later succeeded on its own count as succeeded.

    Only the newest failed child of an episode is repaired.
    """
    failed = children.filter((F.col("status") == "failed") & F.col("parent_run_id").isNotNull())
    newest = failed.groupBy("episode_id").agg(F.max(F.struct("created_at", "run_id")).alias("_m")).select(
        "episode_id", F.col("_m.run_id").alias("run_id")
    )
    fixed = newest.join(later.select("episode_id"), "episode_id", "left_semi").select("run_id", F.lit(True).alias("_fixed"))
    out = children.join(fixed, "run_id", "left")
    return out.withColumn("status", F.when(F.col("_fixed"), F.lit("succeeded")).otherwise(F.col("status"))).drop("_fixed")


def latest_failed_child(children: DataFrame) -> DataFrame:
    failed = children.filter((F.col("status") == "failed") & F.col("parent_run_id").isNotNull())
    return failed.groupBy("episode_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def resume_set(runs: DataFrame) -> DataFrame:
    """Unfinished runs back to pending with the stages still to do."""
    todo = F.array_except("target_stages", "done_stages")
    return (
        runs.filter(F.col("status").isin(*ACTIVE))
        .withColumn("status", F.lit("pending"))
        .withColumn("message", F.lit("应用重启后恢复任务"))
        .withColumn("todo_stages", todo)
        .withColumn("next_stage", F.coalesce(F.get(todo, F.lit(0)), F.element_at("target_stages", -1)))
    )


def incomplete_runs(runs: DataFrame) -> DataFrame:
    """Unfinished runs to pick up again; episodes only when no batch owns them."""
    active = runs.filter(F.col("status").isin(*ACTIVE))
    return active.filter((F.col("scope_type") != "episode") | F.col("parent_run_id").isNull())


def list_runs(runs: DataFrame, *, active_only: bool = False, scope_type: str | None = None, scope_id: str | None = None, limit: int = 100) -> DataFrame:
    """Newest runs under optional filters; `limit` says how many."""
    keep = F.lit(True)
    if active_only:
        keep = keep & F.col("status").isin(*ACTIVE)
    if scope_type:
        keep = keep & (F.col("scope_type") == scope_type)
    if scope_id:
        keep = keep & (F.col("scope_id") == scope_id)
    return runs.filter(keep).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def unfinished_for(runs: DataFrame, books: DataFrame) -> DataFrame:
    """Books with an active run, by scope or by the book named in its metadata.

    The either-or condition becomes two keys per run and one semi join, so no
    nested-loop join is needed.
    """
    active = runs.filter(F.col("status").isin(*ACTIVE))
    keys = active.select(
        F.explode(F.array("scope_id", F.get_json_object("metadata", "$.book_id"))).alias("book_id")
    ).filter(F.col("book_id").isNotNull())
    return books.join(keys, "book_id", "left_semi")


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count_if(F.col("status") == "succeeded").alias("succeeded"),
        F.count_if(F.col("status").isin(*ACTIVE) & F.col("parent_run_id").isNull()).alias("active"),
    )


def analysis_outcome(chapters: DataFrame) -> DataFrame:
    """Book status from chapter outcomes (succeeded, partial, failed)."""
    c = chapters.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("roots"),
        F.count_if(F.col("outcome") == "succeeded").alias("succeeded"),
        F.count_if(F.col("outcome") == "partial").alias("partial"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
    )
    bad = (F.col("failed") > 0) | (F.col("partial") > 0)
    status = (
        F.when(~bad & (F.col("succeeded") == F.col("roots")), "analyzed")
        .when(bad, "analysis_partial_failed")
        .otherwise("analysis_partial")
    )
    message = F.format_string("成功 %d 章，部分成功 %d 章，失败 %d 章", F.col("succeeded"), F.col("partial"), F.col("failed"))
    return c.withColumn("status", status).withColumn("message", message)


def traceability_status(roots: DataFrame, analyses: DataFrame) -> DataFrame:
    """Status a book falls back to when precise chapters are fewer than its roots.

    Succeeded analyses are reduced to distinct (book, root) rows first, then
    counted, so a hot book is never gathered for a distinct count.
    """
    need = roots.groupBy("book_id").agg(F.count(F.lit(1)).alias("roots"))
    precise = (
        analyses.filter(F.col("status") == "succeeded")
        .select("book_id", "root_section_id")
        .distinct()
        .groupBy("book_id")
        .agg(F.count(F.lit(1)).alias("precise"))
    )
    out = need.join(precise, "book_id", "left").withColumn("precise", F.coalesce("precise", F.lit(0)))
    status = F.when(F.col("precise") >= F.col("roots"), "unchanged").when(F.col("precise") > 0, "analysis_partial").otherwise("ready_to_analyze")
    return out.withColumn("next_status", status)


def all_ready(roots: DataFrame, latest: DataFrame) -> DataFrame:
    """Per book: whether every root's newest analysis succeeded."""
    ok = latest.filter(F.col("status") == "succeeded").select("root_section_id", F.lit(True).alias("_ok"))
    joined = roots.join(ok, "root_section_id", "left")
    return joined.groupBy("book_id").agg(
        (F.bool_and(F.coalesce("_ok", F.lit(False))) & (F.count(F.lit(1)) > 0)).alias("all_ready")
    )
