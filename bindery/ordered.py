"""Running computations over large ordered groups.

A plain window puts a whole group in one task. Here each group is cut into
ordered blocks: the window runs inside a block, block totals are aggregated
(with map-side combine), a second window runs over the totals only, and the
carried-in value is joined back. With `position_block` a task holds at most
`BLOCK` rows of a group and the totals are smaller than the group by that
factor, so a single group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK = 65_536


def position_block(position: Column, size: int = BLOCK) -> Column:
    """Ordered block number of an integer position, exact over all of bigint."""
    p, n = position.cast("bigint"), F.lit(size).cast("bigint")
    return F.call_function("div", p - F.pmod(p, n), n)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    *,
    number: str | None = None,
    sums: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over `keys` in ascending `order`.

    number  name of a 1-based row number
    sums    name -> expression; inclusive running sum
    before  name -> expression; last non-null value on any earlier row

    `block` must not decrease along `order` and `order` must be total.
    """
    sums, before = sums or {}, before or {}
    keys, order = list(keys), list(order)
    # Nulls form a group of their own. Keys are split into (is null, value)
    # once, so that window, totals and join share one partitioning: the rows
    # are shuffled a single time and the join finds them in place.
    tagged = df.withColumn("_blk_raw", block)
    types = {f.name: f.dataType for f in tagged.schema.fields}
    parts: dict[str, Column] = {}
    for i, k in enumerate([*keys, "_blk_raw"]):
        parts[f"_z{i}"] = F.col(k).isNull()
        parts[f"_v{i}"] = F.coalesce(F.col(k), _filler(types[k]))
    tagged = tagged.withColumns(parts).drop("_blk_raw")
    group = [c for i in range(len(keys)) for c in (f"_v{i}", f"_z{i}")]
    blk = [f"_v{len(keys)}", f"_z{len(keys)}"]
    local = Window.partitionBy(*group, *blk).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = local.rowsBetween(Window.unboundedPreceding, -1)

    local_cols: dict[str, Column] = {}
    total_cols: list[Column] = []
    if number:
        local_cols["_n"] = F.row_number().over(local).cast("bigint")
        total_cols.append(F.count(F.lit(1)).alias("_n_t"))
    for i, expr in enumerate(sums.values()):
        local_cols[f"_s{i}"] = F.sum(expr).over(upto)
        total_cols.append(F.sum(expr).alias(f"_s{i}_t"))
    for i, expr in enumerate(before.values()):
        local_cols[f"_b{i}"] = F.last(expr, ignorenulls=True).over(prior)
        rank = F.when(expr.isNotNull(), F.struct(*order))
        total_cols.append(F.max_by(expr, rank).alias(f"_b{i}_t"))

    totals = tagged.groupBy(*group, *blk).agg(*total_cols)
    # Null blocks come first, as null order values do.
    across = Window.partitionBy(*group).orderBy(F.desc(blk[1]), blk[0]).rowsBetween(Window.unboundedPreceding, -1)
    carried: list[Column] = []
    if number:
        carried.append(F.coalesce(F.sum("_n_t").over(across), F.lit(0)).alias("_n_c"))
    for i in range(len(sums)):
        carried.append(F.sum(f"_s{i}_t").over(across).alias(f"_s{i}_c"))
    for i in range(len(before)):
        carried.append(F.last(f"_b{i}_t", ignorenulls=True).over(across).alias(f"_b{i}_c"))
    carry = totals.select(*group, *blk, *carried)
    joined = tagged.withColumns(local_cols).join(carry, [*group, *blk], "left")

    out: dict[str, Column] = {}
    if number:
        out[number] = F.col("_n") + F.col("_n_c")
    for i, name in enumerate(sums):
        out[name] = (
            F.when(F.col(f"_s{i}").isNull(), F.col(f"_s{i}_c"))
            .when(F.col(f"_s{i}_c").isNull(), F.col(f"_s{i}"))
            .otherwise(F.col(f"_s{i}") + F.col(f"_s{i}_c"))
        )
    for i, name in enumerate(before):
        out[name] = F.coalesce(F.col(f"_b{i}"), F.col(f"_b{i}_c"))
    return joined.select(*[F.col(c) for c in df.columns if c not in out], *[v.alias(k) for k, v in out.items()])


def _filler(kind: T.DataType) -> Column:
    """Any non-null value of a type; a null flag tells it from a real one."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit("").cast(kind)
    if isinstance(kind, T.DateType):
        return F.lit("1970-01-01").cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(kind)
    return F.lit(0).cast(kind)


def first_per_group(df: DataFrame, keys: Sequence[str], rank: Column, keep: Sequence[str]) -> DataFrame:
    """The row of greatest `rank` per group, as an aggregate (map-side combine)."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*keep), rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in keep])


def assemble(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    line: Column,
    *,
    separator: str = "\n",
) -> DataFrame:
    """Join ordered lines into one text per key.

    For texts that a reader or a model takes as a whole (a note, a prompt), so
    their length is bounded by that use. Listings without such a bound stay rows.
    """
    packed = df.select(*keys, F.struct(*order, line.alias("_line")).alias("_row"))
    grouped = packed.groupBy(*keys).agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    text = F.array_join(F.transform("_rows", lambda r: r["_line"]), separator)
    return grouped.select(*keys, text.alias("text"))
