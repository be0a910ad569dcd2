"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .rows import write_counted


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    return write_counted(edges, sum=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) is connected with.

    Nulls and loops are ignored, repeated edges count once; nodes without
    edges do not appear. Each round writes a table; only a count and a
    checksum of it reach the driver.
    """
    edges, mark = _written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while mark["rows"]:
        # Every node hands its larger neighbours to the smallest one.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Then every node ties its smaller neighbours, and itself, to the smallest.
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        tied = large.join(least, F.col("b") == F.col("u")).select(F.col("m").alias("x"), F.explode(F.array("a", "u")).alias("y"))
        edges, after = _written(tied.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if after == mark:
            break
        mark = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
