"""Keeping costly expressions from being evaluated more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def unnest(df: DataFrame, keep: Sequence[str | Column], array: Column | str, name: str, position: str | None = None) -> DataFrame:
    """One row per non-null element.

    A plain explode makes the optimizer add a "not empty" filter below it and
    push that filter through projections, copying the expression that builds
    the array, once per mention, into the filter. The outer form has no such
    filter; the null rows it adds are dropped right after.
    """
    array = F.col(array) if isinstance(array, str) else array
    if position is None:
        out = df.select(*keep, F.explode_outer(array).alias(name))
        return out.filter(F.col(name).isNotNull())
    out = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return out.filter(F.col(position).isNotNull())


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections cannot copy.

    The optimizer moves filters below a projection by repeating the projected
    expressions inside them. A one-element unnest is a boundary it does not
    cross, so the expressions are evaluated once per row. All columns travel in
    the one element.
    """
    kept = [F.col(f"`{c}`").alias(c) for c in df.columns if c not in columns]
    held = F.array(F.struct(*kept, *[c.alias(n) for n, c in columns.items()]))
    return df.select(F.explode_outer(held).alias("_held")).select("_held.*")
