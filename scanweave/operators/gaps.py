"""Cutting a key's events where nothing is remembered, so that a sequential rule runs on many pieces of one key at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same(left: DataFrame, right: DataFrame, columns) -> Column:
    """Null-safe equality of columns that both sides have."""
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in columns])


def cut_at_gaps(events: DataFrame, keys: list[str], gap: int, bucket: int, order=("us",)) -> DataFrame:
    """``events`` with ``piece``: how many of a key's events so far came ``gap`` microseconds or more after the one before; the first
    counts too.

    ``us`` holds the time in microseconds. Windows run inside time buckets of ``bucket`` microseconds, which are joined by one row
    for each key and bucket, so a key with a third of all events spreads over tasks.
    """
    by = [*keys, "bucket__"]
    e = events.withColumn("bucket__", F.floor(F.col("us") / bucket))
    over = Window.partitionBy(*keys).orderBy("bucket__")
    ends = e.groupBy(*by).agg(F.max("us").alias("end__")).withColumn("earlier__", F.lag("end__").over(over)).drop("end__")
    e = e.join(ends, same(e, ends, by)).select(e["*"], "earlier__")
    inside = Window.partitionBy(*by).orderBy(*order)
    since = F.col("us") - F.coalesce(F.lag("us").over(inside), F.col("earlier__"))
    e = e.withColumn("starts__", F.coalesce((since >= gap).cast("int"), F.lit(1))).drop("earlier__")
    heads = e.groupBy(*by).agg(F.sum("starts__").alias("n__")).withColumn(
        "head__", F.coalesce(F.sum("n__").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n__")
    e = e.withColumn("in__", F.sum("starts__").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return e.join(heads, same(e, heads, by)).select(*[e[c] for c in events.columns], (F.col("head__") + F.col("in__")).alias("piece"))
