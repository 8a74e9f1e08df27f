"""Sessions, runs, frames and windows over a key's rows in the order of a number ``t``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.keys import keyed_join


def bucket_of(df: DataFrame, t: str, bucket: float) -> Column:
    """The number of the bucket of ``bucket`` that ``t`` is in; null for null, and for NaN, which Spark
    sorts behind all numbers, the last one."""
    at = F.floor(F.col(t) / bucket)
    return F.when(F.isnan(t), F.lit(2**63 - 1)).otherwise(at) if df.schema[t].dataType.typeName() in ("double", "float") else at


def _along(keys: list[str]) -> Window:
    """The buckets of a key in order."""
    return Window.partitionBy(*[F.col(f"_part.{k}") for k in keys]).orderBy("_part._bucket")


def previous(df: DataFrame, keys: list[str], t: str, tie: str, carried: list[str], bucket: float, out: str) -> DataFrame:
    """``out``: a struct of ``carried`` of the key's row before in the order of ``t``, ``tie``;
    null for its first row. Also ``_part``: the key and the bucket of ``bucket`` of ``t``.

    A key may hold any share of the rows: windows stay inside a bucket, and only the last row
    of each bucket meets those of the key's other buckets. Null keys and a null ``t`` are
    values like others, the latter before all; NaN comes after all.
    """
    row = F.struct(*carried)
    dealt = df.withColumn("_part", F.struct(*keys, bucket_of(df, t, bucket).alias("_bucket")))
    ends = dealt.groupBy("_part").agg(F.max_by(row, F.struct(t, tie)).alias("_last"))
    before = ends.select("_part", F.lag("_last").over(_along(keys)).alias("_carried"))
    here = F.lag(row).over(Window.partitionBy("_part").orderBy(t, tie))
    return dealt.join(before, "_part").withColumn(out, F.coalesce(here, "_carried")).drop("_carried")


def number_starts(flagged: DataFrame, keys: list[str], order: list[str | Column], out: str) -> DataFrame:
    """``out``: starts (``_start``, 0 or 1) up to a row in the order of the key's ``_part`` buckets and
    of ``order``, which is total inside one."""
    sums = flagged.groupBy("_part").agg(F.sum("_start").alias("_n"))
    running = Window.unboundedPreceding, 0
    before = sums.select("_part", (F.sum("_n").over(_along(keys).rowsBetween(*running)) - F.col("_n")).alias("_before"))
    inside = F.sum("_start").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(*running))
    return flagged.join(before, "_part").withColumn(out, (inside + F.col("_before")).cast("long")).drop("_before")


def stretches(df: DataFrame, keys: list[str], t: str, tie: str, carried: list[str], starts: Callable[[Column], Column], bucket: float, out: str) -> DataFrame:
    """``out``: number from 0 of the key's stretch that a row is in. ``starts`` tells from the
    struct of :func:`previous` whether a row begins one; null does not. Of each bucket only its
    last row and its number of starts meet the others."""
    flagged = previous(df, keys, t, tie, carried, bucket, "_prev").withColumn("_start", F.coalesce(starts(F.col("_prev")).cast("long"), F.lit(0)))
    return number_starts(flagged, keys, [t, tie], out).select(*df.columns, out)


def running(df: DataFrame, keys: list[str], t: str, ties: list[str], weight: Column, bucket: float, to: str, total: str) -> DataFrame:
    """``to``: sum of ``weight`` over the key's rows up to this one in the order of ``t``, ``ties``;
    ``total``: over all its rows. Of each bucket only its sum meets the others. Null keys and a
    null ``t`` are values like others, the latter before all; NaN comes after all."""
    dealt = df.withColumn("_w", weight).withColumn("_part", F.struct(*keys, bucket_of(df, t, bucket).alias("_bucket")))
    sums = dealt.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    before = F.sum("_sum").over(_along(keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")
    whole = F.sum("_sum").over(Window.partitionBy(*[F.col(f"_part.{k}") for k in keys]))
    inside = F.sum("_w").over(Window.partitionBy("_part").orderBy(t, *ties).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(sums.select("_part", before.alias("_before"), whole.alias(total)), "_part").withColumn(to, inside + F.col("_before")).drop("_w", "_part", "_before")


def lag_difference(df: DataFrame, keys: list[str], t: str, tie: str, bucket: int, out: str = "gap") -> DataFrame:
    """``out``: distance of ``t`` from the key's row before; null for its first row."""
    return previous(df, keys, t, tie, [t], bucket, "_prev").withColumn(out, F.col(t) - F.col("_prev")[t]).select(*df.columns, out)


def sessionise(df: DataFrame, key: str, t: str, tie: str, gap: int, bucket: int, out: str = "session") -> DataFrame:
    """``out``: number from 0 of the key's session; a distance over ``gap`` begins a new one.

    A key may hold any share of the rows: it is worked on in buckets of ``bucket`` of ``t``.
    Only the last ``t`` and the number of starts of each bucket meet across buckets. Null keys and
    a null ``t`` are values like others, the latter before all.
    """
    parts = ["_bucket", key]
    dealt = df.withColumn("_bucket", bucket_of(df, t, bucket))
    inside = Window.partitionBy(*parts).orderBy(t, tie)
    marked = dealt.withColumn("_start", (F.col(t) - F.lag(t).over(inside) > gap).cast("long"))
    marked = marked.withColumn("_in", F.coalesce(F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    sums = dealt.withColumn("_gap", F.col(t) - F.lag(t).over(inside)).groupBy(*parts).agg(F.min(t).alias("_min"), F.max(t).alias("_max"), F.sum((F.col("_gap") > gap).cast("long")).alias("_n"))
    along = Window.partitionBy(key).orderBy("_bucket")
    first = F.when(F.col("_min") - F.lag("_max").over(along) > gap, 1).otherwise(0)
    sums = sums.withColumn("_first", first).withColumn("_all", F.col("_first") + F.coalesce("_n", F.lit(0)))
    before = F.sum("_all").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce("_n", F.lit(0))
    offsets = sums.select(*parts, before.alias("_before"))
    marked, offsets = marked.withColumn("_part", F.struct(*parts)), offsets.select(F.struct(*parts).alias("_part"), "_before")
    return marked.join(offsets, "_part").withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).select(*df.columns, out)


def session_summary(df: DataFrame, key: str, t: str, tie: str, value: str, gap: int, bucket: int) -> DataFrame:
    """A row for each session: start, end, duration, n, mean gap (0 for one row), mean value."""
    s = sessionise(df, key, t, tie, gap, bucket)
    out = s.groupBy(key, "session").agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("n"), F.avg(value).alias("mean_value"))
    return out.withColumn("duration", F.col("end_t") - F.col("start_t")).withColumn("mean_gap", F.when(F.col("n") > 1, F.col("duration") / (F.col("n") - 1)).otherwise(0.0))


def run_segments(df: DataFrame, keys: list[str], t: str, tie: str, value: str, bucket: int) -> DataFrame:
    """A row for each run of equal ``value``: run, value, start, end, n. Nulls form runs too."""
    runs = stretches(df, keys, t, tie, [value], lambda p: p.isNotNull() & ~F.col(value).eqNullSafe(p[value]), bucket, "run")
    return runs.groupBy(*keys, "run", value).agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("n"))


def split_on_gap_or_jump(df: DataFrame, keys: list[str], t: str, tie: str, value: str, gap: int, rate: float, bucket: int) -> DataFrame:
    """``part``: a new one begins where ``t`` jumps by more than ``gap`` or ``value`` changes by
    more than ``rate`` for each unit of ``t`` (no rate over equal ``t``). A null ``t`` comes first, and no
    part begins at it, at the row after it or at a null value or the row after one by its rate."""

    def starts(before: Column) -> Column:
        dt, dv = F.col(t) - before[t], F.abs(F.col(value) - before[value])
        return (dt > gap) | ((dt > 0) & (dv > rate * dt))

    return stretches(df, keys, t, tie, [t, value], starts, bucket, "part")


def coalesce_parts(df: DataFrame, keys: list[str], t: str, part: str, gap: int, bucket: int) -> DataFrame:
    """Parts merged again where the next begins within ``gap`` of the end of the one before:
    keys, merged (number from 0), parts, start, end, n. Null keys and parts are values like others;
    an empty table gives none."""
    parts = df.groupBy(*keys, part).agg(F.min(t).alias("s"), F.max(t).alias("e"), F.count("*").alias("n"))
    joined = stretches(parts, keys, "s", part, ["e"], lambda p: F.col("s") - p["e"] > gap, bucket, "merged")
    return joined.groupBy(*keys, "merged").agg(F.count("*").alias("parts"), F.min("s").alias("start_t"), F.max("e").alias("end_t"), F.sum("n").alias("n"))


def frames(df: DataFrame, t: str, size: int, out: str = "frame") -> DataFrame:
    """``out``: ``t`` div ``size``, rounded down; null for a null ``t``."""
    return df.withColumn(out, F.floor(F.col(t) / size).cast("long"))


def sliding_windows(df: DataFrame, keys: list[str], t: str, length: int, step: int) -> DataFrame:
    """Each row once for every window it lies in, with window_start: windows of ``length``, both
    ends included, begin every ``step`` from the key's least ``t`` as long as they end no later
    than a step past its greatest.

    The windows of a row are computed, not joined; a row is in at most length / step + 1. A null
    key is one like others; a null ``t`` lies in no window.
    """
    spans = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    placed = keyed_join(df.where(F.col(t).isNotNull()), spans, keys)
    last = F.least(F.floor((F.col(t) - F.col("_lo")) / step), F.floor((F.col("_hi") + step - length - F.col("_lo")) / step))
    first = F.greatest(F.ceil((F.col(t) - F.col("_lo") - length) / step), F.lit(0))
    windows = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))
    return placed.withColumn("_k", F.explode(windows)).withColumn("window_start", F.col("_lo") + F.col("_k") * step).drop("_k", "_lo", "_hi")


def full_span(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys, start, end, n of all rows of each key; a null ``t`` counts in n only."""
    return df.groupBy(*keys).agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count("*").alias("n"))
