"""Document boundaries and token counts of flat token files without an index.

A file is a sequence of identifiers in which an end-of-document identifier
closes each document. Blocks of it are searched independently; a block yields
no more than the places of the identifiers found. A prefix scan over the
blocks of a file then tells each how many documents ended before it and where
the last one did, which is all that stitches a document over block borders.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..ordered import position_block, running
from ..session import cut_lineage
from .bpe import encoder
from .flat import text_slices

#: Tokens of a block.
BLOCK = 1 << 16
#: Documents of a file that is written here.
DOCS_PER_FILE = 4096
TOKEN = "<u4"


def scan_blocks(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, block, n, ends): the number of tokens of each block, and where `end_id` stands in it."""

    def run(batches):
        for batch in batches:
            raw = batch.column(2)
            counts, ends = [], []
            for value in raw:
                ids = np.frombuffer(value.as_buffer(), TOKEN) if value.is_valid else np.zeros(0, TOKEN)
                counts.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id).astype(np.int32))
            at = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = pa.array(np.concatenate(ends) if ends else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(at), flat)], ["file", "block", "n", "ends"])

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.select("file", F.col("block").cast("bigint").alias("block"), F.col("tokens").cast("binary").alias("tokens")).mapInArrow(run, f"file {kind}, block bigint, n bigint, ends array<int>")


def count_tokens(blocks: DataFrame, end_id: int) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed): a row per document of each file.

    `blocks` has file, block (its order in the file; distinct) and tokens
    (little-endian unsigned 32-bit ids). `n_tokens` counts the closing
    identifier. Tokens behind the last one are a document that is not closed;
    null and empty blocks hold none; a file without tokens has no documents.
    """
    found = cut_lineage(scan_blocks(blocks, end_id))
    k = F.size("ends")
    scan = running(
        found, ["file"], ["block"], position_block(F.col("block")),
        sums={"docs": k.cast("bigint"), "tokens": F.col("n")},
    )
    placed = scan.withColumn("base", F.col("tokens") - F.col("n")).withColumn("last", F.when(k > 0, F.col("base") + F.element_at("ends", -1) + 1))
    placed = running(placed, ["file"], ["block"], position_block(F.col("block")), before={"open": F.col("last")})
    own = F.transform("ends", lambda e: F.col("base") + e + 1)
    start = F.concat(F.array(F.coalesce("open", F.lit(0).cast("bigint"))), own)
    whole = placed.where(k > 0).select("file", (F.col("docs") - k).alias("first"), start.alias("start"), F.posexplode(own).alias("i", "end"))
    whole = whole.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.element_at("start", F.col("i") + 1).alias("start"), "end", F.lit(True).alias("closed"))
    tail = found.groupBy("file").agg(F.sum("n").alias("end"), F.sum(k).cast("bigint").alias("ordinal"))
    last = placed.groupBy("file").agg(F.coalesce(F.max("last"), F.lit(0).cast("bigint")).alias("start"))
    tail = tail.join(last.withColumnRenamed("file", "f"), F.col("file").eqNullSafe(F.col("f"))).where("end > start").select("file", "ordinal", "start", "end", F.lit(False).alias("closed"))
    return whole.unionByName(tail).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "closed")


def token_files(docs: DataFrame, path: str, end_id: int, block: int = BLOCK, per_file: int = DOCS_PER_FILE) -> tuple[DataFrame, DataFrame]:
    """Flat token files of `docs` as (file, block, tokens), and the documents' order in them as (file, ordinal, doc_id).

    Documents are dealt out to files by a hash of their id and follow each
    other by id, then by a hash of their text. A null text is empty: its
    end-of-document identifier alone.
    """
    files = max(8, -(-docs.count() // per_file))
    file = F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int")
    rows = docs.select(file.alias("file"), "doc_id", F.xxhash64("text").alias("k"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        bpe = encoder(path)
        now, number, held = None, 0, np.zeros(0, TOKEN)
        for batch in batches:
            names = np.asarray(batch.column(0))
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, at = bpe.encode(data, offsets)
                own = names[lo:hi]
                cuts = np.flatnonzero(np.diff(own)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
                    if own[a] != now:
                        if len(held):
                            yield _block(now, number, held)
                        now, number, held = int(own[a]), 0, np.zeros(0, TOKEN)
                    part = np.insert(ids[at[a] : at[b]].astype(TOKEN), at[a + 1 : b + 1] - at[a], end_id)
                    held = np.concatenate([held, part])
                    while len(held) >= block:
                        yield _block(now, number, held[:block])
                        number, held = number + 1, held[block:]
        if len(held):
            yield _block(now, number, held)

    # More partitions than files would leave some idle; files of one partition follow each other.
    dealt = rows.repartition("file").sortWithinPartitions("file", "doc_id", "k").select("file", "text")
    blocks = dealt.mapInArrow(run, "file int, block bigint, tokens binary")


    order = Window.partitionBy("file").orderBy("doc_id", "k")
    places = rows.select("file", "doc_id", "k").select("file", (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"), "doc_id")
    return blocks, places


def _block(file: int, number: int, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["file", "block", "tokens"])


def counts_of_documents(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): what the scan of the documents' token files finds, with the documents."""
    blocks, places = token_files(docs, path, end_id)
    return count_tokens(blocks, end_id).join(places, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
