"""A folder of notes as a sink: staged by tasks, committed once, then put in place.

Tasks write their notes next to the vault, not into it, with a list of what
they wrote. When all have ended, the commit names those lists; a failed job
leaves the vault as it was. Putting committed notes in place is a job of its
own that can be repeated: whoever comes next finishes what was committed. The
manifest that belongs to them becomes the current one last.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import cut_lineage
from .notes import merged_notes, sync_parts, user_block

# Spark's readers pass over names that begin like this.
STAGED, MANIFEST = ".staged", ".manifest"
#: Notes that are read at a time.
READ_ROWS = 256
COMMITTED, CURRENT = "COMMITTED", "current"


def open_folder(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the folder in it."""
    fs, base = pafs.FileSystem.from_uri(root if "://" in root else pathlib.PurePath(root).as_uri())
    return fs, base.rstrip("/")


def _exists(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type != pafs.FileType.NotFound


def _put(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """Write a file so that it is there whole or not at all."""
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(content)
    fs.move(part, path)


def _checked_place(path: str) -> str:
    """`path`, if a note may lie there."""
    parts = pathlib.PurePosixPath(path).parts
    if not parts or parts[0] == "/" or ".." in parts or parts[0] in (STAGED, MANIFEST):
        raise ValueError(f"no place for a note: {path}")
    return path


@dataclass
class Staged(WriterCommitMessage):
    listing: str


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str, job: str) -> None:
        self.root, self.job = root, job

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, base = open_folder(self.root)
        task = TaskContext.get()
        folder = f"{STAGED}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(f"{base}/{folder}", recursive=True)
        with fs.open_output_stream(f"{base}/{folder}/list.json") as listing:
            for row in iterator:
                name = f"{folder}/{hashlib.sha256(_checked_place(row['path']).encode()).hexdigest()}"
                with fs.open_output_stream(f"{base}/{name}") as note:
                    note.write(row["body"].encode())
                listing.write(json.dumps({"staged": name, "path": row["path"]}).encode() + b"\n")
        return Staged(f"{folder}/list.json")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_folder(self.root)
        _put(fs, f"{base}/{STAGED}/{self.job}/{COMMITTED}", json.dumps([m.listing for m in messages if m]).encode())  # a name per task

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = open_folder(self.root)
        if _exists(fs, f"{base}/{STAGED}/{self.job}"):
            fs.delete_dir(f"{base}/{STAGED}/{self.job}")


class NoteSink(DataSource):
    """`df.write.format("bindery_notes")` with the options root and job; df(path, body)."""

    @classmethod
    def name(cls) -> str:
        return "bindery_notes"

    def schema(self) -> str:
        return "path string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NoteWriter(self.options["root"], self.options["job"])


def stage(notes: DataFrame, root: str, job: str) -> None:
    """Stage and commit notes(path, body); they are in place after `publish`."""
    spark = notes.sparkSession
    spark.dataSource.register(NoteSink)
    notes.select("path", "body").write.format("bindery_notes").option("root", root).option("job", job).mode("append").save()


def publish(spark: SparkSession, root: str) -> list[str]:
    """Put all committed notes in place, then make their manifest current; returns the jobs that were finished."""
    fs, base = open_folder(root)
    if not _exists(fs, f"{base}/{STAGED}"):
        return []
    jobs = [i.base_name for i in fs.get_file_info(pafs.FileSelector(f"{base}/{STAGED}")) if _exists(fs, f"{i.path}/{COMMITTED}")]

    def move(rows: Iterable[Row]) -> None:
        fs, base = open_folder(root)
        folder = None
        for row in rows:
            staged, target = f"{base}/{row['staged']}", f"{base}/{row['path']}"
            if _exists(fs, staged):  # else an earlier attempt has moved it
                if folder != posixpath.dirname(target):
                    folder = posixpath.dirname(target)
                    fs.create_dir(folder, recursive=True)
                fs.move(staged, target)

    for job in sorted(jobs):
        with fs.open_input_stream(f"{base}/{STAGED}/{job}/{COMMITTED}") as f:
            listings = json.loads(f.read())
        if listings:
            spark.read.schema("staged string, path string").json([f"{root.rstrip('/')}/{x}" for x in listings]).foreachPartition(move)
        if _exists(fs, f"{base}/{MANIFEST}/{job}"):
            _put(fs, f"{base}/{MANIFEST}/{CURRENT}", job.encode())
        fs.delete_dir(f"{base}/{STAGED}/{job}")
    return sorted(jobs)


def with_stored(df: DataFrame, root: str, name: str) -> DataFrame:
    """`df` and, as text in the column `name`, the note that lies at its `path`; null where there is none.

    Tasks open the places that their rows name. The folder is not listed, so
    neither the driver nor a split per few files stands between rows and notes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(root)

        def stored(path: str) -> bytes | None:
            try:
                with fs.open_input_stream(f"{base}/{_checked_place(path)}") as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for batch in batches:
            at = batch.schema.get_field_index("path")
            for lo in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(lo, READ_ROWS)
                found = pa.array([stored(p) for p in part.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())])
    return df.mapInArrow(run, schema).withColumn(name, F.col(name).cast("string"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, digest) of the notes as the last finished sync left them."""
    fs, base = open_folder(root)
    if not _exists(fs, f"{base}/{MANIFEST}/{CURRENT}"):
        return spark.createDataFrame([], "path string, digest string")
    with fs.open_input_stream(f"{base}/{MANIFEST}/{CURRENT}") as f:
        return spark.read.parquet(f"{root.rstrip('/')}/{MANIFEST}/{f.read().decode()}")


def sync(new: DataFrame, root: str) -> DataFrame:
    """Bring a vault up to date with notes(path, body); returns those written, as (path, body, digest).

    What readers wrote is kept, unchanged notes are not touched, notes that
    are gone come back. A sync that was interrupted is finished first.
    """
    spark = new.sparkSession
    fs, base = open_folder(root)
    fs.create_dir(base, recursive=True)
    publish(spark, root)
    known = read_manifest(spark, root)
    met = with_stored(new.select("path", "body"), root, "_stored")
    met = met.select("path", "body", user_block(F.col("_stored")).alias("_user"), F.when(F.col("_stored").isNotNull(), F.lit(True)).alias("_there"))
    # Notes are read once: what is to be written and the new manifest come from one table.
    changed, after = sync_parts(cut_lineage(merged_notes(met, known)), known)
    job = uuid.uuid4().hex
    after.write.parquet(f"{root.rstrip('/')}/{MANIFEST}/{job}")
    stage(changed, root, job)
    publish(spark, root)
    return changed
