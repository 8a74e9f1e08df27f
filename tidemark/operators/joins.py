"""Joins: claimed and chosen rows, ranges, nearest times, two keys in order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import LEVEL_CELLS, interval_level, level_size
from tidemark.plans.staging import staged


def unclaimed(df: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among ``claimed``; a null key is equal to none, so it stays."""
    return df.join(claimed, keys, "left_anti")


def chosen(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, each once, whose keys are among ``wanted``; a null key is equal to none."""
    return df.join(wanted, keys, "left_semi")


def range_semi_join(df: DataFrame, windows: DataFrame, t: str, value: str, size: int) -> DataFrame:
    """Rows with ``t`` in some window's [start_t, end_t] and ``value`` within its tolerance of
    its center; nulls are in none. Windows (start_t, end_t, center, tolerance) are dealt to cells
    of their length's level (``intervals.interval_level``), few however long they are, and a row
    looks in one cell of each level that occurs."""
    known = windows.where("start_t <= end_t").withColumn("_level", interval_level("start_t", "end_t", size)).withColumn("_size", level_size(size, F.col("_level")))
    levels = sorted(r["_level"] for r in known.select("_level").distinct().collect())  # at most 16
    cells = known.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_t") / F.col("_size")), F.floor(F.col("end_t") / F.col("_size")))))
    at = lambda level: F.floor(F.col(t) / (size * LEVEL_CELLS**level)) == cells["_cell"]
    inside = F.col(t).between(cells["start_t"], cells["end_t"]) & (F.abs(F.col(value) - cells["center"]) <= cells["tolerance"])
    if len(levels) <= 1:
        here = cells.drop("_level", "_size")
        return df.join(here, at(levels[0] if levels else 0) & inside, "left_semi")
    placed = df.withColumn("_id", F.monotonically_increasing_id())
    placed = staged(placed, "placed")  # the number of a row must not change
    asked = placed.select("_id", F.col(t).alias("_t"), F.col(value).alias("_v"), F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.floor(F.col(t) / (size * LEVEL_CELLS**x)).alias("cell")) for x in levels])).alias("_at"))
    met = (F.col("_at.level") == cells["_level"]) & (F.col("_at.cell") == cells["_cell"]) & F.col("_t").between(cells["start_t"], cells["end_t"]) & (F.abs(F.col("_v") - cells["center"]) <= cells["tolerance"])
    return placed.join(asked.join(cells, met, "left_semi").select("_id").distinct(), "_id", "left_semi").drop("_id")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], t: str, tie: str, most: int) -> DataFrame:
    """``left`` with near_t and near_tie of the key's ``right`` row nearest in ``t`` on either
    side, at most ``most`` away; the earlier of two as near, of equal times the one with the
    smallest ``tie``; null without one, and for a null key or time. Repeated left rows are rows of
    their own.

    Both sides are dealt to cells of four times ``most``, right rows also to the cell next door
    where it is near, so a key may hold any share of the rows. In a cell windows carry the last
    right row up to and the first from each left row. ``t`` and ``tie`` are read from both.
    """
    size = 4 * most if most else 1
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, t)])
    at = F.struct(F.col(t).alias("t"), F.col("_tie").alias("tie"))
    none = F.lit(None).cast(left.schema)
    r = right.where(known).groupBy(*keys, t).agg(F.min(tie).alias("_tie")).select(*keys, F.col(t).alias("_t"), none.alias("_row"), at.alias("_at"))
    r = r.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("_t") - most) / size), F.floor((F.col("_t") + most) / size))))
    l = left.where(known).select(*keys, F.col(t).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(r.schema["_at"].dataType).alias("_at"))  # noqa: E741
    l = l.withColumn("_cell", F.floor(F.col("_t") / size))  # noqa: E741
    w = Window.partitionBy(*keys, "_cell").orderBy("_t")
    both = l.unionByName(r)
    both = both.withColumn("_b", F.last("_at", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_f", F.first("_at", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    back, ahead = F.col("_t") - F.col("_b.t"), F.col("_f.t") - F.col("_t")
    near = F.when((back <= most) & (ahead.isNull() | (back <= ahead)), F.col("_b")).when(ahead <= most, F.col("_f"))
    found = both.where("_row is not null").select("_row.*", near["t"].alias("near_t"), near["tie"].alias("near_tie"))
    apart = left.where(~known).select("*", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("near_t", "near_tie")])
    return found.unionByName(apart)


def interpolate_at(points: DataFrame, times: DataFrame, keys: list[str], t: str, value: str, bucket: int) -> DataFrame:
    """``times`` (keys, t) with ``value`` of ``points`` (keys, t unique in a key, value) on the
    straight line between neighbours; beyond the ends the end's value, null without a point or a
    time. Points with a null time or value are none; a null key is one like others.

    Work is in buckets of ``bucket`` of time; of each only its first and last point meet the
    others, so a key may hold any share of the rows.
    """
    points = points.where(F.col(t).isNotNull() & F.col(value).isNotNull())
    p = points.select(*keys, t, F.struct(F.col(t).alias("t"), F.col(value).alias("v")).alias("_p"), F.lit(False).alias("_ask"))
    q = times.select(*keys, t, F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.lit(True).alias("_ask"))
    both = p.unionByName(q).withColumn("_part", F.struct(*keys, F.floor(F.col(t) / bucket).alias("_bucket")))
    ends = both.groupBy("_part").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    along = Window.partitionBy(*[F.col(f"_part.{k}") for k in keys]).orderBy("_part._bucket")
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select("_part", before.alias("_before"), after.alias("_after"))
    w = Window.partitionBy("_part").orderBy(t)
    both = both.join(ends, "_part").withColumn("_a", F.coalesce(F.last("_p", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_before"))
    both = both.withColumn("_b", F.coalesce(F.first("_p", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)), "_after"))
    a, b = F.col("_a"), F.col("_b")
    line = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["t"] == b["t"]), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"]))
    return both.where("_ask").select(*keys, t, F.when(F.col(t).isNotNull(), line).alias(value))


def lookup_two_keys(df: DataFrame, first: DataFrame, first_keys: list[str], second: DataFrame, second_keys: list[str], label: str) -> DataFrame:
    """``df`` with ``label`` from ``first`` by its keys, else from ``second`` by its own; each
    lookup table has at most one row for a key. A null key finds nothing; a null label is none."""
    one = first.select(*first_keys, F.col(label).alias("_one"))
    two = second.select(*second_keys, F.col(label).alias("_two"))
    return df.join(one, first_keys, "left").join(two, second_keys, "left").select(*df.columns, F.coalesce("_one", "_two").alias(label))
