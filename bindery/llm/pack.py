"""Packing of tokenised documents into sequences: shortest pack first over the length histogram.

Documents longer than a sequence are cut into full sequences and a rest, so
what is packed are pieces of 1..width tokens, and their histogram has at most
`width` entries however many documents there are. Lengths are placed longest
first; each goes to the packs that are shortest so far, a whole count of equal
packs (a pattern) at once. Patterns then meet documents by rank: the k-th piece
of a length takes the k-th place that the patterns have for that length.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .bpe import encoder
from .flat import bounds, text_slices

WIDTH = 2048
#: Blocks that the pieces of one length are ranked in: a common length is no single task.
RANK_BLOCKS = 256


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[int]]]:
    """(count, piece lengths) of the packs that hold all pieces of the histogram."""
    made: list[tuple[int, int]] = []  # (pattern it extends or -1, length added)
    heap: list[tuple[int, int, int]] = []  # (-room, pattern, count): the shortest pack comes first
    full: list[tuple[int, int]] = []

    def put(room: int, pattern: int, count: int) -> None:
        if room:
            heapq.heappush(heap, (-room, pattern, count))
        else:
            full.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if heap and -heap[0][0] >= length:
                room, parent, count = heapq.heappop(heap)
                room = -room
                if count > left:
                    heapq.heappush(heap, (-room, parent, count - left))
                    count = left
                made.append((parent, length))
                grown.append((room - length, len(made) - 1, count))
                left -= count
                for g in grown:  # a pack may take several pieces of one length
                    put(*g)
                grown = []
            else:
                # No open pack has room: new ones, each with as many pieces as fit.
                each = min(width // length, left)
                count = left // each
                parent = -1
                for _ in range(each):
                    made.append((parent, length))
                    parent = len(made) - 1
                put(width - each * length, parent, count)
                left -= each * count
    out = []
    for pattern, count in [*full, *((p, c) for _, p, c in heap)]:
        lengths, p = [], pattern
        while p >= 0:
            p, length = made[p][0], made[p][1]
            lengths.append(length)
        out.append((count, lengths[::-1]))
    return out


def places(packs: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where ranks of a length go: sorted (length << 40 | first rank), first rank, first sequence, offset."""
    rows, used, sequence = [], {}, 0
    for count, lengths in packs:
        at = 0
        for length in lengths:
            first = used.get(length, 0)
            rows.append((length, first, sequence, at))
            used[length] = first + count
            at += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0] << 40 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pieces(docs: DataFrame, path: str, end_id: int = 1, width: int = WIDTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids with `end_id` behind them, in pieces of at most `width`.

    A null or empty text is the one piece of its end id.
    """

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            ident = batch.column(0)
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, at = bpe.encode(data, offsets)
                n = np.diff(at) + 1
                to = bounds(n)
                out = np.full(int(to[-1]), end_id, "<u4")
                keep = np.ones(len(out), bool)
                keep[to[1:] - 1] = False
                out[keep] = ids
                parts = -(-n // width)
                doc = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(doc)) - np.repeat(bounds(parts)[:-1], parts)) * width
                length = np.minimum(n[doc] - start, width)
                begin = to[doc] + start
                raw = memoryview(out.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ident.slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text}` AS text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(cut: DataFrame, width: int = WIDTH) -> DataFrame:
    """`cut` with sequence_id and offset: pieces share sequences of at most `width` tokens, gapless from offset 0.

    `cut` has doc_id, start and length (1..width) and should be a table, for
    it is read twice. Pieces of one length are ranked by block, id and start;
    rows that repeat these are interchangeable and each gets a place of its
    own. No rows in, no rows out.
    """
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `width` rows
    keys, first, sequence, offset = places(patterns(histogram, width))
    block = F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_BLOCKS))
    rows = cut.withColumn("_block", block)
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("length", "_block").agg(F.count(F.lit(1)).alias("_n")).select("length", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("length", "_block").orderBy("doc_id", "start")
    ranked = rows.withColumn("_in", F.row_number().over(inside)).join(ahead, ["length", "_block"])
    ranked = ranked.select(*cut.columns, (F.col("_in") - 1 + F.col("_ahead")).cast("bigint").alias("_rank"))

    def place(batches):
        for batch in batches:
            column = lambda name: np.asarray(batch.column(batch.schema.get_field_index(name)))  # noqa: B023, E731
            rank = column("_rank")
            i = np.searchsorted(keys, column("length").astype(np.int64) << 40 | rank, "right") - 1
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(sequence[i] + rank - first[i]), pa.array(offset[i])], [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, width: int = WIDTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise, cut and pack: a row per piece, as in `pieces` and `pack`."""
    return pack(cut_lineage(pieces(docs, path, end_id, width, id_col, text)), width)
