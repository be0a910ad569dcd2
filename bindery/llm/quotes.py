"""Conversations from messages that quote each other.

Lines of a message are read by quote level (nested ">"). Runs of one level are
passages; passages and their lines are hashed after normalisation and joined
to the first message that wrote them itself. The message with most of the text
at the shallowest level that is found is the one replied to; replies are followed to their root
by pointer doubling. What comes out is text without quotes, in reply order.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .rows import write_counted

_LEVEL = re.compile(r"^(?:[ \t]?>)+")
#: Lines that introduce a quote, dropped where one follows.
_INTRO = re.compile(r"^.{0,200}\b(?:wrote|writes|schrieb|écrit|escribió)\s*:\s*$", re.I)
_BLANK = re.compile(r"\s+")


def normal(text: str) -> str:
    """Lower case, white space collapsed."""
    return _BLANK.sub(" ", text).strip().lower()


def fingerprint(text: str) -> int | None:
    """A 64-bit hash of the normalised text; None if nothing is left."""
    own = normal(text)
    return int.from_bytes(hashlib.blake2b(own.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) if own else None


def passages(text: str) -> list[tuple[int, list[str]]]:
    """(level, lines) of the runs of one quote level; level 0 is the writer's own text."""
    out: list[tuple[int, list[str]]] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        mark = _LEVEL.match(line)
        level = mark[0].count(">") if mark else 0
        body = line[mark.end() :].removeprefix(" ") if mark else line
        if not body.strip() and out and not mark:
            out[-1][1].append("")  # a blank line between quotes ends neither
            continue
        if out and out[-1][0] == level:
            out[-1][1].append(body)
            continue
        if out and level > out[-1][0]:
            before = out[-1][1]
            while before and not before[-1].strip():
                before.pop()
            if before and _INTRO.match(before[-1]):
                before.pop()
        out.append((level, [body]))
    return [(level, lines) for level, lines in out if any(x.strip() for x in lines)]


def _units(lines: list[str]) -> list[tuple[int, int]]:
    """(fingerprint, weight) of a passage as a whole and of its lines."""
    found = {}
    for x in ["\n".join(lines), *lines]:
        if (h := fingerprint(x)) is not None:
            found[h] = len(normal(x))
    return sorted(found.items())


def read_messages(messages: DataFrame, scope: str, msg_id: str, position: str, text: str) -> DataFrame:
    """(scope, id, pos, own, wrote, quoted): own text, fingerprints of it, and quoted units by level."""
    unit = pa.struct([("level", pa.int32()), ("h", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        for batch in batches:
            own, wrote, quoted = [], [], []
            for value in batch.column(3).to_pylist():
                parts = passages(value or "")
                mine = [lines for level, lines in parts if level == 0]
                whole = "\n".join("\n".join(x).strip("\n") for x in mine)
                own.append(whole)
                wrote.append(sorted({h for h, _ in _units(whole.split("\n"))} | {h for x in mine for h, _ in _units(x)}))
                quoted.append([{"level": k, "h": h, "weight": w} for k, lines in parts if k for h, w in _units(lines)])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(3)], pa.array(own, pa.string()), pa.array(wrote, pa.list_(pa.int64())), pa.array(quoted, pa.list_(unit))],
                ["scope", "id", "pos", "own", "wrote", "quoted"],
            )

    kinds = [messages.schema[c].dataType.simpleString() for c in (scope, msg_id, position)]
    rows = messages.select(F.col(scope).alias("scope"), F.col(msg_id).alias("id"), F.col(position).alias("pos"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"scope {kinds[0]}, id {kinds[1]}, pos {kinds[2]}, own string, wrote array<bigint>, quoted array<struct<level:int,h:bigint,weight:bigint>>")


def conversations(messages: DataFrame, scope: str = "scope", msg_id: str = "msg_id", position: str = "position", text: str = "text") -> DataFrame:
    """(scope, msg_id, position, parent_id, root_id, depth, path, text): a row per message, quotes removed.

    A message replies to the earlier one (by position) in its scope that wrote
    most of what it quotes at the shallowest level of which any is found there;
    ties go to the later one. Of messages that wrote the same passage, the
    first counts. Without such a
    message it starts a conversation. `path` holds the positions from the root
    down: sorted by it, a conversation reads in reply order. Null text is
    empty. Rows without id or position, and all but one of rows that repeat an
    id (the least position, then text), are left out; null scopes are one
    scope of their own. An empty table gives no rows.
    """
    rows = read_messages(messages.where(F.col(msg_id).isNotNull() & F.col(position).isNotNull()), scope, msg_id, position, text)
    rows = cut_lineage(rows.groupBy("id").agg(F.min_by(F.struct("scope", "pos", "own", "wrote", "quoted"), F.struct("pos", "own")).alias("m")).select("id", "m.*"))
    key = F.xxhash64(F.col("scope").isNull(), F.col("scope"), F.col("h"))
    # One row per passage: however many messages repeat it, a quote meets one.
    wrote = rows.select("scope", "id", "pos", F.explode("wrote").alias("h")).select(key.alias("k"), "id", "pos")
    first = wrote.groupBy("k").agg(F.min(F.struct("pos", "id")).alias("src"))
    quoted = rows.select("scope", "id", "pos", F.explode("quoted").alias("q")).select("scope", "id", "pos", F.col("q.h").alias("h"), F.col("q.level").alias("level"), F.col("q.weight").alias("weight"))
    votes = quoted.select("id", "pos", "level", "weight", key.alias("k")).join(first, "k").where(F.col("src.pos") < F.col("pos"))
    tally = votes.groupBy("id", "level", F.col("src.id").alias("parent"), F.col("src.pos").alias("parent_pos")).agg(F.sum("weight").alias("weight"))
    best = tally.groupBy("id").agg(F.max(F.struct(-F.col("level"), "weight", "parent_pos", "parent")).alias("b")).select(F.col("id").alias("child"), F.col("b.parent").alias("parent_id"))
    # Pointer doubling: `up` moves to twice the distance each round; a null means that the root is reached.
    linked = rows.select("id", "pos").join(best, F.col("id") == F.col("child"), "left")
    state, seen = write_counted(linked.select("id", F.col("parent_id").alias("up"), F.col("id").alias("top"), F.array("pos").alias("path")), open=F.count("up"))
    while seen["open"]:
        above = state.select(F.col("id").alias("a"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("path").alias("path2"))
        moved = state.where("up IS NOT NULL").join(above, F.col("up") == F.col("a"))
        moved = moved.select("id", F.col("up2").alias("up"), F.col("top2").alias("top"), F.concat("path2", "path").alias("path"))
        state, seen = write_counted(state.where("up IS NULL").union(moved), open=F.count("up"))
    found = state.select(F.col("id").alias("i"), F.col("top").alias("root_id"), "path").join(best, F.col("i") == F.col("child"), "left").drop("child")
    out = rows.join(found, F.col("id") == F.col("i"))
    return out.select("scope", F.col("id").alias("msg_id"), F.col("pos").alias("position"), "parent_id", "root_id", (F.size("path") - 1).cast("int").alias("depth"), "path", F.col("own").alias("text"))


def mails(turns: DataFrame, levels: int = 3) -> DataFrame:
    """Messages as a mail program writes them: each turn of `turns` (conv_id, turn, text) quotes the ones before it.

    (scope, msg_id, position, text); the first level quotes the turn before,
    the second the one before that, up to `levels`.
    """
    text = F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.min(text).alias("text"))
    out = rows
    for k in range(1, levels + 1):
        before = rows.select(F.col("conv_id").alias(f"c{k}"), (F.col("turn") + k).alias(f"t{k}"), F.col("text").alias(f"x{k}"))
        out = out.join(before, (F.col("conv_id") == F.col(f"c{k}")) & (F.col("turn") == F.col(f"t{k}")), "left")
    parts = [F.col("text")]
    for k in range(1, levels + 1):
        mark, outer = ">" * k + " ", ">" * (k - 1) + (" " if k > 1 else "")
        head = F.lit(f"\n{outer}On a day someone wrote:\n")
        parts.append(F.when(F.col(f"x{k}").isNotNull(), F.concat(head, F.lit(mark), F.regexp_replace(F.col(f"x{k}"), "\n", "\n" + mark))))
    ident = F.concat_ws("-", "conv_id", "turn")
    return out.select(F.col("conv_id").alias("scope"), ident.alias("msg_id"), F.col("turn").alias("position"), F.concat_ws("", *parts).alias("text"))


#: What the links must be: a turn replies to the first turn of its conversation with the text of the turn before.
SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
n AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM t),
f AS (SELECT conv_id, norm, min(turn) AS first FROM n WHERE norm <> '' GROUP BY ALL),
p AS (SELECT a.conv_id, a.turn, f.first AS parent FROM n a LEFT JOIN n b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN f ON f.conv_id = b.conv_id AND f.norm = b.norm),
w AS (SELECT conv_id, turn, parent, turn AS root, [turn] AS path FROM p WHERE parent IS NULL
      UNION ALL SELECT p.conv_id, p.turn, p.parent, w.root, list_append(w.path, p.turn) FROM p JOIN w ON w.conv_id = p.conv_id AND w.turn = p.parent)
SELECT conv_id, turn, conv_id || '-' || parent AS parent_id, conv_id || '-' || root AS root_id, len(path) - 1 AS depth,
       array_to_string(path, '/') AS reply_path, sha256(norm) AS text_sha256
FROM w JOIN n USING (conv_id, turn)
"""
