"""Session settings the operators rely on."""

from __future__ import annotations

import functools
import pathlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs a further shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Archive and HTML parsing hold whole files in a batch: keep batches short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app: str = "bindery", **extra: str) -> SparkSession:
    """Build (or fetch) a session; cluster-supplied settings win over ours."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set only the session settings that change results, plan quality or the memory of Python workers."""
    for key in (
        "spark.sql.session.timeZone",
        "spark.sql.mapKeyDedupPolicy",
        "spark.sql.adaptive.forceOptimizeSkewedJoin",
        "spark.sql.execution.arrow.maxRecordsPerBatch",
    ):
        spark.conf.set(key, SETTINGS[key])
    return spark


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = pathlib.Path(__file__).resolve().parents[1]
        target = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / "bindery"
        context.addPyFile(shutil.make_archive(str(target), "zip", root_dir=str(root), base_dir="bindery"))
        _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver can read and write.

    It is the one the session names in ``spark.checkpoint.dir``. Where none is
    named, a single-process session (tests, bench) gets a fresh folder of its
    own; a session with executors elsewhere is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return str(folder).rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` as a table in the shared folder and read it back.

    Later steps start from files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
