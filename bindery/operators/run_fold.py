"""Run state from an event log, folded in pieces.

What an event does depends on the ones before it: a cancelled run ignores
"running" updates until something else happens to it. A stretch of events is
therefore summed up for both ways it can be entered, open or cancelled, and
two such summaries of neighbouring stretches make one. That composition is
associative, so a run is folded wherever its events happen to lie: events are
range-partitioned by (run, time), which cuts a long run by count, each
partition is folded in one pass over sorted batches, and only the summaries,
one per run and partition, come together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RUNNING, CANCELLED = "running", "cancelled"
#: Events without a time come first.
_UNTIMED = -(1 << 63)
_RUNS, _CANCELS, _SETTLES, _SILENT = range(4)
_LAST = "struct<status:string,at:bigint>"
#: A stretch of one run. settled: whether its last event other than running cancels (null: it has none).
#: free_*: its running events before any other, which count if it is entered open; sure_*: those that count in any case.
#: open, shut: the last event that counts if it is entered open, or cancelled.
SUMMARY = f"first bigint, first_seq bigint, settled boolean, free_n bigint, free_at bigint, sure_n bigint, sure_at bigint, open {_LAST}, shut {_LAST}"
_NAMES = ["first", "first_seq", "settled", "free_n", "free_at", "sure_n", "sure_at", "open", "shut"]


def summarise(run: np.ndarray, at: np.ndarray, seq: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """First row of each stretch of equal `run`, and its summary; last events are row numbers, -1 for none."""
    n = len(run)
    index = np.arange(n)
    start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    begin = np.repeat(start, np.diff(np.r_[start, n]))
    runs, settles = kind == _RUNS, (kind == _CANCELS) | (kind == _SETTLES)
    upto = np.maximum.accumulate(np.where(settles, index, -1))
    before = np.r_[-1, upto[:-1]]
    inside = before >= begin
    head = runs & ~inside
    sure = runs & inside & (kind[before] != _CANCELS)
    last = lambda rows: np.maximum.reduceat(np.where(rows, index, -1), start)
    first = lambda rows: np.minimum.reduceat(np.where(rows, index, n), start)
    count = lambda rows: np.add.reduceat(rows.astype(np.int64), start)
    settled = last(settles)
    return start, {
        "first": at[start], "first_seq": seq[start], "settled": settled, "cancelled": kind[settled] == _CANCELS,
        "free_n": count(head), "free_at": first(head), "sure_n": count(sure), "sure_at": first(sure), "open": last(~runs | head | sure), "shut": last(~runs | sure),
    }


def compose(a: dict, b: dict) -> dict:
    """The summary of stretch `a` with `b` right behind it."""
    out = dict(a)
    if a["settled"] is None:
        out.update(settled=b["settled"], free_n=a["free_n"] + b["free_n"], free_at=_first(a["free_at"], b["free_at"]), sure_n=a["sure_n"] + b["sure_n"], sure_at=_first(a["sure_at"], b["sure_at"]))
        out.update(open=b["open"] or a["open"], shut=b["shut"] or a["shut"])
        return out
    if b["settled"] is not None:
        out["settled"] = b["settled"]
    if a["settled"]:
        out.update(sure_n=a["sure_n"] + b["sure_n"], sure_at=_first(a["sure_at"], b["sure_at"]), open=b["shut"] or a["open"], shut=b["shut"] or a["shut"])
    else:
        out.update(sure_n=a["sure_n"] + b["free_n"] + b["sure_n"], sure_at=_first(a["sure_at"], b["free_at"], b["sure_at"]), open=b["open"] or a["open"], shut=b["open"] or a["shut"])
    return out


def _first(*times):
    return min((t for t in times if t is not None), default=None)


def stretches(events: DataFrame) -> DataFrame:
    """(run_id, SUMMARY): one row per run and partition of events(run_id, at, seq, status), sorted by run and time."""
    schema = pa.schema([("settled", pa.bool_()), ("last", pa.struct([("status", pa.string()), ("at", pa.int64())]))])
    last_type = schema.field("last").type

    def fold(batches):
        held = None  # the last run so far: (run id as an array of one, summary)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode(null_encoding="encode")
            at, seq = (np.asarray(batch.column(i).fill_null(_UNTIMED)) for i in (1, 2))
            status = batch.column(3)
            words = status.to_pylist()
            kind = np.array([_SILENT if s is None else _RUNS if s == RUNNING else _CANCELS if s == CANCELLED else _SETTLES for s in words], np.int8)
            start, found = summarise(np.asarray(ids.indices), at, seq, kind)
            rows = []
            for i in range(len(start)):
                get = lambda name, f=found, i=i: int(f[name][i])
                when = lambda name, n=len(at), t=at, g=get: int(t[g(name)]) if g(name) < n else None
                event = lambda name, t=at, w=words, g=get: {"status": w[g(name)], "at": int(t[g(name)])} if g(name) >= 0 else None
                rows.append({
                    "first": get("first"), "first_seq": get("first_seq"), "settled": bool(found["cancelled"][i]) if get("settled") >= 0 else None,
                    "free_n": get("free_n"), "free_at": when("free_at"), "sure_n": get("sure_n"), "sure_at": when("sure_at"), "open": event("open"), "shut": event("shut"),
                })
            runs = batch.column(0).take(pa.array(start))
            done_ids, done = [], []
            if held is not None and held[0].equals(runs.slice(0, 1)):
                rows[0] = compose(held[1], rows[0])
            elif held is not None:
                done_ids, done = [held[0]], [held[1]]
            held = (runs.slice(len(rows) - 1, 1), rows[-1])
            yield from _batch([*done_ids, runs.slice(0, len(rows) - 1)], [*done, *rows[:-1]])
        if held is not None:
            yield from _batch([held[0]], [held[1]])

    def _batch(ids, rows):
        if rows:
            kinds = {"settled": pa.bool_(), "open": last_type, "shut": last_type}
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *[pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in _NAMES]], ["run_id", *_NAMES])

    kind = events.schema["run_id"].dataType.simpleString()
    return events.select("run_id", "at", "seq", "status").mapInArrow(fold, f"run_id {kind}, {SUMMARY}")


def composed(a: Column, b: Column) -> Column:
    """`compose` as an expression over two summaries."""
    first = lambda *c: F.array_min(F.array(*c))
    unsettled, cancelled = a["settled"].isNull(), F.coalesce(a["settled"], F.lit(False))
    return F.struct(
        a["first"].alias("first"), a["first_seq"].alias("first_seq"), F.coalesce(b["settled"], a["settled"]).alias("settled"),
        F.when(unsettled, a["free_n"] + b["free_n"]).otherwise(a["free_n"]).alias("free_n"),
        F.when(unsettled, first(a["free_at"], b["free_at"])).otherwise(a["free_at"]).alias("free_at"),
        (a["sure_n"] + b["sure_n"] + F.when(unsettled | cancelled, 0).otherwise(b["free_n"])).alias("sure_n"),
        F.when(unsettled | cancelled, first(a["sure_at"], b["sure_at"])).otherwise(first(a["sure_at"], b["free_at"], b["sure_at"])).alias("sure_at"),
        F.coalesce(F.when(cancelled, b["shut"]).otherwise(b["open"]), a["open"]).alias("open"),
        F.coalesce(F.when(unsettled | cancelled, b["shut"]).otherwise(b["open"]), a["shut"]).alias("shut"),
    )


def fold(events: DataFrame) -> DataFrame:
    """(run_id, status, heartbeat_at, started_at, attempt) per run of events(run_id, ts, seq, status).

    Events count in the order of (ts, seq, status). started_at is the first
    running event that counts, attempt their number, status and heartbeat_at
    those of the last event that counts. Events without a time come first and leave
    theirs null. A null status neither settles a run
    nor starts it. Null run ids are one run; no events, no rows.
    """
    kind = events.schema["ts"].dataType
    rows = events.select("run_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("seq").cast("bigint").alias("seq"), "status")
    order = ("run_id", "at", "seq", "status")
    parts = stretches(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    # As many summaries per run as there are partitions that it reaches into.
    listed = F.sort_array(F.collect_list(F.struct("first", "first_seq", "settled", "free_n", "free_at", "sure_n", "sure_at", "open", "shut")))
    one = parts.groupBy("run_id").agg(listed.alias("s")).select("run_id", F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), composed).alias("s"))
    time = lambda c: F.timestamp_micros(F.nullif(c, F.lit(_UNTIMED))).cast(kind)
    return one.select(
        "run_id", F.col("s.open.status").alias("status"), time(F.col("s.open.at")).alias("heartbeat_at"),
        time(F.array_min(F.array("s.free_at", "s.sure_at"))).alias("started_at"), (F.col("s.free_n") + F.col("s.sure_n")).alias("attempt"),
    )
