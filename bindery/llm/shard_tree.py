"""Shards by a hierarchical weighted hash tree: regions of racks of shards.

A row descends from the root: at each level every child makes a draw that
depends on the row's key and favours children by their weight, and the least
draw wins. A shard draws an exponential variable with its weight as the rate,
from a hash of the key and its own name alone. A rack draws the least of its
shards' draws and a region the least of its racks': that is again an
exponential variable, with the sum of their weights as the rate, so each level
chooses by weight. A change of weight below one node changes the draws on the
way from the root to it and no others: rows only enter that subtree (weight
added) or only leave it (weight taken), and within the subtrees around it
nothing moves. A new shard takes rows into itself and no other row moves.

Draws are columns, so placing rows is a scan. Numbers within a shard need one
narrow shuffle; they follow a hash of the row, so blocks of a shard are ranges
of that hash and a shard, or a key, may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..ordered import BLOCK, running
from ..rows import computed_once
from .rows import write_counted

#: Bits of a hash that a draw is made of: exact in a double.
BITS = 52
#: Equal rows that one task writes at once.
COPIES = 4096


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def grown(count: int, racks: int = 2, shards: int = 2) -> list[Shard]:
    """The tree of `count` shards of weight one: racks of `shards` and regions of `racks`, filled in order."""
    return [Shard(i, i // (shards * racks), i // shards) for i in range(count)]


def _bits(name: Column) -> Column:
    """`BITS` bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("bigint")


def draw(key: Column, number: int) -> Column:
    """Exponential with rate one, of a key and a shard; a null key has draws of its own."""
    u = (_bits(F.concat(F.lit(f"{number}:"), F.coalesce(key.cast("string"), F.lit("null")))) + 0.5) / float(1 << BITS)
    return -F.log(u)


def descend(draws: Sequence[Column], tree: Sequence[Shard]) -> Column:
    """(draw, region, rack, shard) of the place that a row reaches; `draws` has one of rate one per shard of `tree`.

    Children without weight are never chosen; equal draws go to the smaller numbers.
    """
    if not any(s.weight > 0 for s in tree):
        raise ValueError("a tree needs a shard with weight")

    def least(nodes: list[Column]) -> Column:
        return nodes[0] if len(nodes) == 1 else F.array_min(F.array(*nodes))

    regions: dict[int, dict[int, list[Column]]] = {}
    for s, own in zip(tree, draws, strict=True):
        if s.weight > 0:
            leaf = F.struct((own / float(s.weight)).alias("draw"), F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack"), F.lit(s.number).alias("shard"))
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(leaf)
    return least([least([least(leaves) for leaves in racks.values()]) for racks in regions.values()])


def assign(docs: DataFrame, tree: Sequence[Shard], key: str = "doc_id", later: Sequence[Shard] | None = None) -> DataFrame:
    """`docs` with region, rack and shard, and with `grown_shard` in the tree `later` if one is given.

    Only the key and the tree decide, so rows that repeat a key lie together;
    null keys lie together as well. No shuffle. Columns of these names are
    replaced.
    """
    numbers = sorted({s.number for s in [*tree, *(later or ())]})
    draws = computed_once(docs, _draws=F.array(*[draw(F.col(f"`{key}`"), n) for n in numbers]))

    def reached(shards: Sequence[Shard]) -> Column:
        return descend([F.col("_draws")[numbers.index(s.number)] for s in shards], shards)

    out = draws.withColumn("_at", reached(tree))
    if later is not None:
        out = out.withColumn("_later", reached(later)["shard"])
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("region", "rack", "shard", "grown_shard")]
    more = [F.col("_later").alias("grown_shard")] if later is not None else []
    return out.select(*kept, F.col("_at.region").alias("region"), F.col("_at.rack").alias("rack"), F.col("_at.shard").alias("shard"), *more)


def shard_rows(docs: DataFrame, count: int = 8, id_col: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack), a row per row of `docs`.

    The law is `key`: the id and the number of shards decide, and one shard
    more takes rows only into itself. Size is the UTF-8 bytes of the text and
    one; a null text has none. Slots are gapless from 0 in each shard, in an
    order that no layout of the input changes; rows equal in id, size and
    checksum are interchangeable. Ids may be null or repeat; no rows in, no
    rows out.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    same, seen = write_counted(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    placed = assign(same, grown(count), later=grown(count + 1))
    order = _bits(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32"))
    bits = max((seen["rows"] // block).bit_length(), 1)
    placed = placed.withColumn("order", order)
    placed = running(placed, ["shard"], ["order", "doc_id", "size", "text_crc32"], F.shiftright("order", BITS - bits), sums={"upto": F.col("copies")})
    # A row that is repeated without end is dealt out before it is written as often as it came.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = placed.withColumn("from", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1, F.lit(COPIES).cast("bigint"))))
    parts = parts.repartition(tasks, "shard", "from")
    to = F.least(F.col("from") + (COPIES - 1), F.col("upto") - 1)
    return parts.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence("from", to)).alias("slot"), "grown_shard", "region", "rack")


_DRAW = f"-ln((CAST('0x' || left(md5(s || ':' || k), {BITS // 4}) AS BIGINT) + 0.5) / {float(1 << BITS):.1f})"
SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM b),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
  coalesce(CAST(doc_id AS VARCHAR), 'null') AS k FROM d, t),
g AS (SELECT *, list_transform(range(9), lambda s: {_DRAW}) AS draws, CAST('0x' || left(md5(k || ':' || size || ':' || text_crc32), {BITS // 4}) AS BIGINT) AS place FROM c),
p AS (SELECT *, list_position(draws[1:8], list_min(draws[1:8])) - 1 AS shard, list_position(draws, list_min(draws)) - 1 AS grown FROM g)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, size, text_crc32) - 1 AS slot,
  CAST(grown AS INTEGER) AS grown_shard, CAST(shard // 4 AS INTEGER) AS region, CAST(shard // 2 AS INTEGER) AS rack FROM p
"""
