"""DataFrame helpers shared by the operators."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of a membership map: 1 MiB, whatever the size of the data.
MAP_BITS = 1 << 23
_PER_BUCKET = 32_768  # bits of one row of bitmap_construct_agg


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z, and nothing else, in lower case."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


@contextlib.contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Within this block joins are broadcast only where a hint says so.

    Steps with dozens of joins would else build a relation for each in the
    driver, of a few MiB however small the table, many at a time.
    """
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mark_members(df: DataFrame, key: Column, members: DataFrame, member_key: Column, flag: str, bits: int = MAP_BITS) -> DataFrame:
    """Add a boolean `flag`: false means that no row of `members` has this key.

    Keys are hashed into a bit map of a fixed size (`bits` / 8 bytes in rows
    of 4 KiB), which is what gets broadcast. It may say true for a key that is
    not there, never false for one that is.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    maps = (
        members.select(place(member_key).alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("_map"))
    )
    placed = df.withColumn("_place", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_place"))
    bit = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.col("_map").isNotNull() & (F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1)
    joined = placed.join(F.broadcast(maps), "_bucket", "left")
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def write_counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """`df` as a table in the shared folder, and aggregates over it taken while it is written."""
    seen = Observation()
    table = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in measures.items()]))
    return table, seen.get
