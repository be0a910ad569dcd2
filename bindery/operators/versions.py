"""Append-only versions, latest-wins views, ranked picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..ordered import first_per_group, running

STAGES = ("outline", "draft", "final")


def latest_artifact(artifacts: DataFrame, keys: Sequence[str] = ("episode_id", "stage")) -> DataFrame:
    """Newest version per key, as an aggregate rather than a sort per group."""
    keep = [c for c in artifacts.columns if c not in keys]
    return first_per_group(artifacts, list(keys), F.col("version"), keep)


def append_version(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """New rows with versions continuing after the highest stored one of their key."""
    top = existing.groupBy(*keys).agg(F.max("version").alias("_top"))
    numbered = running(new, keys, order, block, number="_no")
    match = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        match = one if match is None else match & one
    renamed = top.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_top")
    joined = numbered.join(renamed, match, "left")
    version = (F.coalesce("_top", F.lit(0)) + F.col("_no")).cast("bigint")
    return joined.withColumn("version", version).drop("_no", "_top", *[f"_t_{k}" for k in keys])


def latest_analysis(analyses: DataFrame, mode: str, keys: Sequence[str] = ("root_section_id", "set_id")) -> DataFrame:
    """Newest analysis per chapter under one of three rules.

    newest_succeeded   the newest among those that succeeded
    newest_if_ok       the newest, kept only if it succeeded
    newest_overall     the newest over all fragment sets, kept only if it succeeded
    """
    ok = F.col("status") == "succeeded"
    if mode == "newest_succeeded":
        return latest_artifact(analyses.filter(ok), keys)
    if mode == "newest_if_ok":
        return latest_artifact(analyses, keys).filter(ok)
    if mode == "newest_overall":
        return latest_artifact(analyses, [k for k in keys if k != "set_id"]).filter(ok)
    raise ValueError(f"unknown mode: {mode}")


def enumerate_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "position") -> DataFrame:
    """1-based order numbers within each key."""
    return running(df, keys, order, block, number=name)


def version_history(artifacts: DataFrame) -> DataFrame:
    """All versions, stage first, newest first; sorted only on output."""
    return artifacts.orderBy("episode_id", "stage", F.desc("version"))


def first_missing_stage(episodes: DataFrame, artifacts: DataFrame, episode_cards: DataFrame | None = None) -> DataFrame:
    """First stage without an artifact, and the stages left to run."""
    have = artifacts.filter(F.col("stage").isin(*STAGES)).groupBy("episode_id").agg(
        *[F.max((F.col("stage") == s).cast("int")).alias(f"_{s}") for s in STAGES]
    )
    out = episodes.join(have, "episode_id", "left")
    missing = [F.when(F.coalesce(f"_{s}", F.lit(0)) == 0, F.lit(s)) for s in STAGES]
    out = out.withColumn("from_stage", F.coalesce(*missing, F.lit(STAGES[-1])))
    order = F.array(*[F.lit(s) for s in STAGES])
    start = F.array_position(order, F.col("from_stage")).cast("int")
    target = F.slice(order, start, len(STAGES))
    if episode_cards is not None:
        linked = episode_cards.select("episode_id").distinct().withColumn("_linked", F.lit(True))
        out = out.join(linked, "episode_id", "left")
        target = F.when(F.col("_linked"), target).otherwise(F.concat(F.array(F.lit("match_episode_sources")), target))
    return out.withColumn("target_stages", target).drop(*[f"_{s}" for s in STAGES], "_linked")


def effective_prompt(projects: DataFrame, templates: DataFrame, versions: DataFrame, bindings: DataFrame) -> DataFrame:
    """Project binding over global choice over system default, per stage.

    templates(template_id, stage_key, system_version_id, global_version_id)
    and versions are configuration; projects may be many.
    """
    # Every project needs every stage: the stage list is a literal-sized array
    # carried on each template row, attached by key after it is exploded.
    wanted = projects.select("project_id", F.explode("template_ids").alias("template_id"))
    chosen = wanted.join(templates, "template_id").join(
        bindings.select("project_id", "template_id", "active_version_id"), ["project_id", "template_id"], "left"
    )
    scope = (
        F.when(F.col("active_version_id").isNotNull(), F.lit("project"))
        .when(F.col("global_version_id").isNotNull(), F.lit("global"))
        .otherwise(F.lit("system"))
    )
    picked = chosen.withColumn("source_scope", scope).withColumn(
        "version_id", F.coalesce("active_version_id", "global_version_id", "system_version_id")
    )
    out = picked.join(versions.select("version_id", "version", "user_template"), "version_id")
    label = (
        F.when(F.col("source_scope") == "system", F.lit("系统默认"))
        .when(F.col("source_scope") == "global", F.format_string("全局 v%d", F.col("version")))
        .otherwise(F.format_string("项目 v%d", F.col("version")))
    )
    return out.withColumn("source_label", label).drop("active_version_id")


def publish_versions(existing: DataFrame, new: DataFrame, block: Column) -> DataFrame:
    """Append prompt versions per (template, scope, project); null projects are one key."""
    return append_version(existing, new, ["template_id", "scope", "project_id"], ["ordinal"], block)


def restore_version(existing: DataFrame, chosen: DataFrame, block: Column) -> DataFrame:
    """Re-append chosen stored versions as the newest of their scope, remembering the source."""
    again = existing.join(chosen.select("version_id"), "version_id", "left_semi")
    fresh = again.select(
        "template_id", "scope", "project_id", "user_template",
        F.col("version_id").alias("source_version_id"), F.col("version").alias("ordinal"),
    )
    return append_version(existing, fresh, ["template_id", "scope", "project_id"], ["ordinal", "source_version_id"], block)


def topk_per_parent(df: DataFrame, parent: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """First k rows per parent.

    A row_number() <= k filter lets Spark keep k rows per parent and task
    before the shuffle (WindowGroupLimit), so hot parents stay small.
    """
    rank = F.row_number().over(Window.partitionBy(*parent).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def every_nth_type(position: Column, n: int = 4) -> Column:
    return F.when((position > 1) & (position % n == 0), F.lit("过渡")).otherwise(F.lit("解读"))


def recent(df: DataFrame, at: str, tie: str, limit: int = 20) -> DataFrame:
    """Newest rows with an id tie-break: a top-k, not a full sort."""
    return df.orderBy(F.desc(at), F.desc(tie)).limit(limit)


def upsert_planning(log: DataFrame) -> DataFrame:
    """Last write per (run, type, module); created_at stays that of the first write."""
    keys = ["run_id", "artifact_type", "module_key"]
    best = log.groupBy(*keys).agg(
        F.max_by(F.struct("content", "status", "error_message"), F.struct("at", "seq")).alias("_v"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )
    return best.select(*keys, "_v.content", "_v.status", F.left("_v.error_message", F.lit(2000)).alias("error_message"), "created_at", "updated_at")
