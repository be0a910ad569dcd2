"""Batch text generation through a function the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import packing, text as X
from ..operators.sets import id_preservation
from ..rows import unnest
from ..session import cut_lineage

# Chunk sizes of compression.
COMPRESS_CHUNK, COMPRESS_MIN = 5_000, 600
COMPRESS_ROUNDS = 5

Generator = Callable[[str, str], str]
"""(prompt id, source text) -> text; raises GenerationError for known failures."""


class GenerationError(RuntimeError):
    """A failed generation with a category and diagnostics."""

    def __init__(self, message: str, category: str, **diagnostics: object):
        super().__init__(message)
        self.category = category
        self.diagnostics = {k: str(v) for k, v in diagnostics.items()}


def generate(requests: DataFrame, fn: Generator, *, parallelism: int | None = None) -> DataFrame:
    """Run `fn` once per request row; failures become error columns.

    requests(request_id, prompt_id, source). Reruns of lost tasks call `fn`
    again: put `reuse_if_same` before and a written table after this step.
    `parallelism` bounds how many calls run at once.
    """
    schema = "request_id string, content string, error_category string, error string, diagnostics map<string,string>"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ident, prompt, source in zip(batch["request_id"], batch["prompt_id"], batch["source"]):
                try:
                    content = fn(prompt, source)
                    if not isinstance(content, str) or not content.strip():
                        raise GenerationError("模型未返回文本内容", "empty_model_output")
                    rows.append((ident, content, None, None, {}))
                except GenerationError as problem:
                    rows.append((ident, None, problem.category, str(problem)[:500], problem.diagnostics))
                except Exception as problem:
                    rows.append((ident, None, "generation_error", str(problem)[:500], {"error_type": type(problem).__name__}))
            yield pd.DataFrame(rows, columns=["request_id", "content", "error_category", "error", "diagnostics"])

    narrow = requests.select(F.col("request_id").cast("string").alias("request_id"), "prompt_id", "source")
    if parallelism is not None:
        narrow = narrow.repartition(parallelism, "request_id")
    return narrow.mapInPandas(call, schema)


LEDGER = "signature string, attempt bigint, content string, error_category string, error string, diagnostics map<string,string>"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException:  # nothing answered so far
        return spark.createDataFrame([], LEDGER)


def generate_once(requests: DataFrame, fn: Generator, ledger: str, *, parallelism: int = 64) -> DataFrame:
    """`generate`, but an input that was ever answered is not asked again, whatever failed since.

    Answers go to the `ledger` folder, keyed by the signature of prompt and
    source. The work is cut into `parallelism` tasks, and the answers of a task
    are in the ledger as soon as it ends, not when the job does: after a lost
    executor, a failed job or a stopped driver only what no task has finished
    is asked again. Equal inputs are asked once. Failures are kept as well but
    do not count as answers; each run tries them anew.
    """
    spark = requests.sparkSession
    signed = cut_lineage(
        requests.select(F.col("request_id").cast("string").alias("request_id"), "prompt_id", "source", X.signature(F.col("prompt_id"), F.col("source")).alias("signature"))
    )
    before = read_ledger(spark, ledger)
    attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
    answered = before.filter(F.col("error_category").isNull()).select("signature").distinct()
    asked = signed.join(answered, "signature", "left_anti").groupBy("signature").agg(F.any_value("prompt_id").alias("prompt_id"), F.any_value("source").alias("source"))
    fresh = generate(asked.withColumnRenamed("signature", "request_id"), fn, parallelism=parallelism)
    rows = fresh.select(F.col("request_id").alias("signature"), F.lit(attempt).cast("bigint").alias("attempt"), "content", "error_category", "error", "diagnostics")
    # The second version of the committer publishes the files of a task when that task commits.
    rows.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(ledger)
    kept = F.struct("content", "error_category", "error", "diagnostics")
    best = read_ledger(spark, ledger).groupBy("signature").agg(F.max_by(kept, F.struct(F.col("error_category").isNull(), "attempt")).alias("r"))
    return signed.join(best, "signature").select("request_id", "r.*")


def classify_output(timed_out: Column, http_status: Column, connected: Column, well_formed: Column, finish: Column, content: Column) -> Column:
    """Failure category of a gateway answer, null for a usable one."""
    return (
        F.when(timed_out, "model_timeout")
        .when(~connected, "gateway_connection_error")
        .when(http_status >= 400, "gateway_http_error")
        .when(~well_formed, "invalid_gateway_response")
        .when(finish == "length", "output_truncated")
        .when(finish.isNotNull() & (finish != "stop"), "abnormal_finish_reason")
        .when(X.strip(F.coalesce(content, F.lit(""))) == "", "empty_model_output")
    )


def reuse_if_same(requests: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, remaining) by input signature.

    requests need a `signature` column; stored(signature, content).
    """
    newest = stored.groupBy("signature").agg(F.max_by("content", F.col("version")).alias("content"))
    return requests.join(newest, "signature"), requests.join(stored.select("signature"), "signature", "left_anti")


def compress(texts: DataFrame, fn: Generator, *, prompt_id: str = "chapter_compression", parallelism: int | None = None) -> DataFrame:
    """Shorten texts chunk by chunk, keeping every evidence id.

    texts(key, text). A chunk that is cut off or loses ids is halved and tried
    again, down to the smallest size; the number of rounds is fixed by the
    sizes. Chunks keep an ordered path, and results are put together per text.
    Every round is materialised, so generation is not repeated downstream.
    """
    pieces = packing.split_markdown(F.col("text"), COMPRESS_CHUNK)
    todo = unnest(texts, ["key"], pieces, "source", "_n").select(
        "key", F.format_string("%06d", F.col("_n")).alias("path"), "source"
    )
    finished: DataFrame | None = None
    for last in [False] * (COMPRESS_ROUNDS - 1) + [True]:
        asked = todo.select(
            F.sha2(F.concat_ws("|", F.col("key").cast("string"), "path"), 256).alias("request_id"),
            F.lit(prompt_id).alias("prompt_id"), "source", "key", "path",
        )
        answered = generate(asked, fn, parallelism=parallelism).join(asked.select("request_id", "key", "path", "source"), "request_id")
        kept = id_preservation(F.col("source"), F.coalesce("content", F.lit("")))
        judged = cut_lineage(
            answered.withColumn("_lost", (kept["missing"] + kept["unexpected"]) > 0).select("key", "path", "source", "content", "error_category", "error", "_lost")
        )
        retry = ((F.col("error_category") == "output_truncated") | (F.col("error_category").isNull() & F.col("_lost"))) & (
            F.length("source") > COMPRESS_MIN
        )
        again = F.coalesce(retry, F.lit(False)) if not last else F.lit(False)
        done = judged.filter(~again).select(
            "key", "path", "content",
            F.when(F.col("error_category").isNotNull(), F.col("error"))
            .when(F.col("_lost"), F.lit("压缩后来源标识不完整"))
            .alias("error"),
        )
        finished = done if finished is None else finished.unionByName(done)
        if last:
            break
        half = F.greatest(F.lit(COMPRESS_MIN), F.floor(F.length("source") / 2).cast("int"))
        blocks = F.split(X.strip(F.col("source")), "\n{2,}")
        sized = judged.filter(again).withColumn("_half", half)
        atoms = F.flatten(
            F.transform(
                blocks,
                lambda b: F.when(F.length(b) <= F.col("_half"), F.array(b)).otherwise(
                    F.flatten(
                        F.transform(
                            F.split(b, "\n"),
                            lambda l: F.transform(
                                F.sequence(F.lit(0), F.floor((F.greatest(F.length(l), F.lit(1)) - 1) / F.col("_half")).cast("int")),
                                lambda i: F.substring(l, i * F.col("_half") + 1, F.col("_half")),
                            ),
                        )
                    )
                ),
            )
        )
        cut = sized.withColumn("_atoms", F.filter(atoms, lambda a: X.strip(a) != "")).withColumn(
            "_no", packing.pack_numbers(F.transform("_atoms", lambda a: F.length(a)), F.col("_half"), 2)
        )
        todo = unnest(cut, ["key", "path"], packing.regroup(F.col("_atoms"), F.col("_no"), "\n\n"), "source", "_n").select(
            "key", F.concat("path", F.format_string(".%06d", F.col("_n"))).alias("path"), "source"
        )
    packed = finished.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("path", "content"))).alias("_r"), F.min("error").alias("error")
    )
    parts = F.filter(F.transform("_r", lambda r: X.strip(F.coalesce(r["content"], F.lit("")))), lambda c: c != "")
    result = packed.select("key", F.array_join(parts, "\n\n").alias("compressed"), "error")
    checked = texts.join(result, "key", "left")
    final = id_preservation(F.col("text"), F.coalesce("compressed", F.lit("")))
    return checked.withColumn(
        "error",
        F.coalesce("error", F.when((final["missing"] + final["unexpected"]) > 0, F.lit("压缩后来源标识不完整"))),
    )


def produce_episodes(
    episodes: DataFrame, stages: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], fn: Generator, artifacts: DataFrame, *,
    ledger: str | None = None, checks: dict[str, Callable[[DataFrame], DataFrame]] | None = None, parallelism: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Run the missing stages of each episode in order.

    episodes(episode_id, target_stages); `stages` maps a stage name, in order,
    to a function (healthy episodes, artifacts so far) -> requests
    (request_id = episode_id, prompt_id, source). `checks` maps a stage to a
    function (episode_id, content) -> (episode_id, error) that refuses answers,
    as the match of sources needs it. Returns (new artifacts, failures); an
    episode stops at its first error, the others go on. With a `ledger` a
    repeated run asks only for what no earlier run was answered.
    """
    healthy, failures, made = episodes, None, None
    so_far = artifacts.select("episode_id", "stage", F.col("version").cast("bigint").alias("version"), "content")
    for stage, build in stages.items():
        due = healthy.filter(F.array_contains("target_stages", stage))
        requests = build(due, so_far)
        answers = generate_once(requests, fn, ledger, parallelism=parallelism) if ledger else generate(requests, fn, parallelism=parallelism)
        answers = cut_lineage(answers.select(F.col("request_id").alias("episode_id"), "content", "error_category", "error"))
        if checks and stage in checks:
            told = answers.filter(F.col("error_category").isNull()).select("episode_id", "content")
            refused = checks[stage](told).filter(F.col("error").isNotNull()).select("episode_id", F.col("error").alias("_refused"))
            answers = cut_lineage(
                answers.join(refused, "episode_id", "left").select(
                    "episode_id", "content", F.when(F.col("_refused").isNotNull(), F.lit("refused_output")).otherwise(F.col("error_category")).alias("error_category"),
                    F.coalesce("_refused", "error").alias("error"),
                )
            )
        good = answers.filter(F.col("error_category").isNull())
        bad = answers.filter(F.col("error_category").isNotNull()).select("episode_id", F.lit(stage).alias("stage"), "error_category", "error")
        failures = bad if failures is None else failures.unionByName(bad)
        top = so_far.filter(F.col("stage") == stage).groupBy("episode_id").agg(F.max("version").alias("_top"))
        fresh = good.select("episode_id", F.lit(stage).alias("stage"), "content").join(top, "episode_id", "left")
        fresh = fresh.select("episode_id", "stage", (F.coalesce("_top", F.lit(0)) + 1).cast("bigint").alias("version"), "content")
        made = fresh if made is None else made.unionByName(fresh)
        so_far = so_far.unionByName(fresh)
        healthy = healthy.join(bad.select("episode_id"), "episode_id", "left_anti")
    return made, failures


def human_version(texts: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Hand-written finals as the next versions; blank texts are dropped.

    texts(episode_id, content), one per episode.
    """
    top = artifacts.filter(F.col("stage") == "final").groupBy("episode_id").agg(F.max("version").alias("_top"))
    usable = texts.withColumn("content", X.nonblank(F.col("content"))).filter(F.col("content").isNotNull())
    return usable.join(top, "episode_id", "left").select(
        "episode_id", F.lit("final").alias("stage"), (F.coalesce("_top", F.lit(0)) + 1).cast("bigint").alias("version"),
        "content", F.lit("human").alias("author_type"), F.lit("manual-edit").alias("model"),
    )
