"""Rows of a key in order without the key in one task: ranges of rows, places, and a key's row sent to
all of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keys import keyed_join
from tidemark.plans.staging import staged

#: Rows in one range, about.
RANGE_ROWS = 100_000
#: Share of all rows over which a key's row is sent to all tasks; there are under a thousand of them.
HOT_SHARE = 0.001


def fit_a_task(df: DataFrame, keys: list[str | Column], times: int = 1) -> bool:
    """Whether no key has more rows than ``times`` ranges; then a task may take a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS * times).isEmpty()


def in_ranges(df: DataFrame, order: list[str | Column], scratch: list[str] | None, rows: int | None = None) -> DataFrame:
    """``df`` staged with ``_range``: rising numbers of ranges of about RANGE_ROWS rows in ``order``.
    Rows that are equal in it are in one range."""
    n = max(1, -(-(df.count() if rows is None else rows) // RANGE_ROWS))
    return staged(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges", scratch)


def in_places(df: DataFrame, keys: list[str], order: list[str | Column], scratch: list[str], out: str = "place") -> DataFrame:
    """``df`` with ``out``: the row's number from 0 within its key in the order of ``order``, which is
    total. Where a key has more rows than a range, rows are numbered in ranges, and only the number of
    a key's rows in a range meets others."""
    if fit_a_task(df, keys):
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    ranged = in_ranges(df, [*keys, *order], scratch)
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = sizes.select(*keys, "_range", (F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_rows")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)) - 1
    numbered = ranged.withColumn("_in", inside)
    return keyed_join(numbered, before, [*keys, "_range"]).withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_in", "_before", "_range")


def to_each(df: DataFrame, rows: DataFrame, keys: list[str], n: str = "_n") -> DataFrame:
    """``df`` with the other columns of ``rows``, a staged table of one row a key whose ``n`` tells how
    many rows of ``df`` the key has. Null keys are keys like others.

    A key with over HOT_SHARE of all rows is not dealt to one task: the rows of such keys, under a
    thousand, are sent to all tasks. The others meet their rows by a shuffle."""
    total = rows.agg(F.sum(n)).first()[0] or 0
    hot, rest = (rows.where(F.col(n) > total * HOT_SHARE).drop(n), rows.where(F.col(n) <= total * HOT_SHARE).drop(n))
    met = keyed_join(df, F.broadcast(hot), keys)
    if rest.isEmpty():
        return met
    return met.unionByName(keyed_join(keyed_join(df, F.broadcast(hot.select(*keys)), keys, "left_anti"), rest, keys))
