"""Intervals: merging, overlaps and their lengths. Starts and ends are whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sessions import number_starts


def stretches_apart(df: DataFrame, keys: list[str], start: str, end: str, apart: int, bucket: int, out: str) -> DataFrame:
    """``out``: number from 0 of the key's stretch of intervals; one begins with an interval whose
    start is more than ``apart`` beyond all ends before it.

    Intervals are taken in buckets of ``bucket`` of their start; of each bucket only its furthest
    end and its number of beginnings meet the others, so a key may hold any share of them. A null
    key is one like others; starts and ends must not be null, nor an end be before its start.
    """
    dealt = df.withColumn("_part", F.struct(*keys, F.floor(F.col(start) / bucket).alias("_bucket")))
    tops = dealt.groupBy("_part").agg(F.max(end).alias("_top"))
    along = Window.partitionBy(*[F.col(f"_part.{k}") for k in keys]).orderBy("_part._bucket")
    carried = tops.select("_part", F.max("_top").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.max(end).over(Window.partitionBy("_part").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    reach = F.greatest(here, "_carried") + apart
    flagged = dealt.join(carried, "_part").withColumn("_start", F.coalesce((F.col(start) > reach).cast("long"), F.lit(0)))
    # Of equal intervals the one that begins a stretch comes first.
    return number_starts(flagged, keys, [start, end, F.desc("_start")], out).select(*df.columns, out)


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, bucket: int) -> DataFrame:
    """The key's intervals with those that overlap or touch made one: keys, start, end, n. A null
    key is one like others; an interval with a null end or one before its start is left out. See
    :func:`stretches_apart` for ``bucket``.
    """
    known = df.where(F.col(start) <= F.col(end)).groupBy(*keys, start, end).agg(F.count("*").alias("n"))
    island = stretches_apart(known, keys, start, end, 0, bucket, "_i")
    return island.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_i")


#: Cells of one level that an interval covers at most, about; the next level's are so many times as long.
LEVEL_CELLS = 16


def interval_level(start: str, end: str, size: int) -> Column:
    """The level whose cells, of ``size`` times a power of LEVEL_CELLS, an interval covers few of."""
    cells = F.greatest((F.col(end) - F.col(start)) / size, F.lit(1))
    return F.greatest(F.lit(0), F.ceil(F.log(cells) / F.log(F.lit(float(LEVEL_CELLS)))) - 1).cast("int")


def level_size(size: int, level: Column) -> Column:
    return (F.lit(size) * F.pow(F.lit(LEVEL_CELLS), level)).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], size: int, closed: bool = True) -> DataFrame:
    """Pairs of ``left`` (start_t, end_t) and ``right`` (other_start, other_end) of one key that
    overlap; with ``closed`` also those that only touch. Intervals with a null end or one before
    their start, and rows with a null key, overlap nothing.

    Each interval is dealt to the cells of its level that it covers, about LEVEL_CELLS at most
    however long it is, and to those of the levels above that occur. A pair is made at the higher
    of its two levels, in the cell where its overlap begins, so it is an equi-join and no pair
    comes twice. Choose ``size`` near the usual length.
    """

    def levelled(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where(F.col(s) <= F.col(e)).withColumn("_own", interval_level(s, e, size))

    a, b = levelled(left, "start_t", "end_t"), levelled(right, "other_start", "other_end")
    levels = sorted(r["_own"] for r in a.select("_own").union(b.select("_own")).distinct().collect())  # at most 16

    def dealt(df: DataFrame, s: str, e: str, own: str) -> DataFrame:
        above = df.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).where("_level >= _own")
        cells = above.withColumn("_size", level_size(size, F.col("_level")))
        return cells.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s) / F.col("_size")), F.floor(F.col(e) / F.col("_size"))))).withColumnRenamed("_own", own)

    a, b = dealt(a, "start_t", "end_t", "_a"), dealt(b, "other_start", "other_end", "_b").drop("_size")
    meets = (F.col("start_t") <= F.col("other_end")) & (F.col("other_start") <= F.col("end_t")) if closed else (F.col("start_t") < F.col("other_end")) & (F.col("other_start") < F.col("end_t"))
    once = (F.floor(F.greatest("start_t", "other_start") / F.col("_size")) == F.col("_cell")) & (F.col("_level") == F.greatest("_a", "_b"))
    return a.join(b, [*keys, "_level", "_cell"]).where(meets & once).drop("_level", "_size", "_cell", "_a", "_b")


def overlap_length(spans: DataFrame, gaps: DataFrame, keys: list[str], size: int, bucket: int) -> DataFrame:
    """Every row of ``gaps`` (keys, start_t, end_t) with covered: how much of it the key's merged
    ``spans`` (other_start, other_end) cover; 0 where none does, and for a null key or end."""
    merged = merge_intervals(spans, keys, "other_start", "other_end", bucket).drop("n")
    pairs = overlap_join(gaps.select(*keys, "start_t", "end_t").distinct(), merged, keys, size, closed=False)
    cover = pairs.groupBy(*keys, "start_t", "end_t").agg(F.sum(F.least("end_t", "other_end") - F.greatest("start_t", "other_start")).alias("covered"))
    return gaps.join(cover, [*keys, "start_t", "end_t"], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
