"""Aggregates beyond the built-in ones, as columns for ``groupBy().agg`` or as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keys import keyed_join
from tidemark.operators.sessions import running


def circular_mean(degrees: str) -> Column:
    """Mean direction from 0 up to but not 360; nulls do not count, and nulls only give null."""
    r = F.radians(degrees)
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(r)), F.sum(F.cos(r)))), F.lit(360.0))


def power_mean(value: str, power: int = 3) -> Column:
    """For power 3 the cube root of the mean cube; nulls do not count, and nulls only give null."""
    mean = F.avg(F.pow(F.col(value), F.lit(power)))
    return F.cbrt(mean) if power == 3 else F.pow(mean, F.lit(1 / power))


def slope(x: str, y: str) -> Column:
    """Of the least-squares line; rows with a null do not count, equal ``x`` only give null."""
    return F.regr_slope(F.col(y), F.col(x))


def intercept(x: str, y: str) -> Column:
    """Of the least-squares line, as :func:`slope`."""
    return F.regr_intercept(F.col(y), F.col(x))


def _counted(df: DataFrame, keys: list[str], value: str, bucket: float) -> DataFrame:
    """Each distinct value with its number of rows _n, those up to it _to and all of the key _all.

    Equal values are counted first and running counts are kept in buckets of ``bucket`` of the
    value, so a key may hold any share of the rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return running(counts, keys, value, [], F.col("_n"), bucket, "_to", "_all")


def median(df: DataFrame, keys: list[str], value: str, bucket: float) -> DataFrame:
    """keys, median: the middle of the sorted non-null values, or the mean of the two in the
    middle. A null key is one like others; a key with nulls only is left out; NaN is the greatest value."""
    at = lambda place: ((F.col("_to") > place) & (F.col("_to") - F.col("_n") <= place)).cast("int")
    both = at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))
    return _counted(df, keys, value, bucket).where(both > 0).groupBy(*keys).agg((F.sum(F.col(value) * both) / 2).alias("median"))


def upper_median(df: DataFrame, keys: list[str], value: str, bucket: float) -> DataFrame:
    """keys, upper_median: the value at place n div 2 from 0 of the sorted non-null values; keys as
    in :func:`median`."""
    half = F.floor(F.col("_all") / 2)
    return _counted(df, keys, value, bucket).where((F.col("_to") > half) & (F.col("_to") - F.col("_n") <= half)).select(*keys, F.col(value).alias("upper_median"))


def mode_largest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mode, n: the most frequent value; of several the largest. Nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias("mode"), F.col("b.n").alias("n"))


def histogram(df: DataFrame, keys: list[str], value: str, width: int, least: int = 8, most: int = 30) -> DataFrame:
    """keys, bin, center, n of the bins that hold values: (max - min) div ``width`` + 1 bins of
    one size, ``least`` to ``most`` of them, at least 1 wide. ``value`` is a whole number; nulls
    do not count, a null key is one like others."""
    lo_hi = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    bins = F.least(F.lit(most), F.greatest(F.lit(least), F.floor((F.col("_hi") - F.col("_lo")) / width) + 1))
    sized = lo_hi.withColumn("_bins", bins).withColumn("_w", F.greatest(F.lit(1.0), (F.col("_hi") - F.col("_lo")) / F.col("_bins")))
    put = keyed_join(df.where(F.col(value).isNotNull()), sized, keys).withColumn("bin", F.least(F.col("_bins") - 1, F.floor((F.col(value) - F.col("_lo")) / F.col("_w"))))
    out = put.groupBy(*keys, "bin", "_lo", "_w").agg(F.count("*").alias("n"))
    return out.select(*keys, "bin", (F.col("_lo") + F.floor((F.col("bin") + 0.5) * F.col("_w") + 0.5)).alias("center"), "n")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def retained(df: DataFrame, keys: list[str], frame: str, member: str) -> DataFrame:
    """keys, member of the members that are in every frame of the key: counted, not collected.
    Null frames are none; a null key and a null member are ones like others."""
    frames = df.groupBy(*keys).agg(F.count_distinct(frame).alias("_all"))
    held = df.groupBy(*keys, member).agg(F.count_distinct(frame).alias("_in"))
    return keyed_join(held, frames, keys).where("_in = _all").select(*keys, member)


def mahalanobis(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``df`` with distance: of (x, y) from its group's mean in the group's sample covariance;
    null where the covariance is singular, there are fewer than two rows or x or y is null. A
    null key is one like others."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_samp(x).alias("_xx"), F.var_samp(y).alias("_yy"), F.covar_samp(x, y).alias("_xy"))
    dx, dy, det = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    square = (F.col("_yy") * dx * dx - 2 * F.col("_xy") * dx * dy + F.col("_xx") * dy * dy) / det
    return keyed_join(df, m, keys).withColumn("distance", F.when(det > 0, F.sqrt(square))).select(*df.columns, "distance")


def labels_list(label: str) -> Column:
    """Distinct labels in order, comma-joined."""
    return F.array_join(F.array_sort(F.collect_set(label)), ",")
