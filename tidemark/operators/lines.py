"""The line that most of a key's rows lie near, by drawing pairs of rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import is_number
from tidemark.operators import ranges
from tidemark.operators.keys import keyed_join
from tidemark.operators.ranges import in_places, to_each
from tidemark.plans.staging import drop, staged


def drawn(seed: int, draw: int, side: int) -> float:
    """A number from 0 up to but not 1 that depends on these alone."""
    return int(hashlib.md5(f"{seed}:{draw}:{side}".encode()).hexdigest()[:8], 16) / 2.0**32


def _inliers(x: np.ndarray, y: np.ndarray, shares: tuple[np.ndarray, np.ndarray], tolerance: float) -> np.ndarray:
    """Which rows lie near the best of the lines through the rows at these shares; the first of equally good ones."""
    n = len(x)
    a, b = (np.minimum(np.floor(n * u).astype(np.int64), n - 1) for u in shares)
    lines = x[a] != x[b]
    a, b = a[lines], b[lines]
    best, most = np.zeros(n, bool), 0
    with np.errstate(all="ignore"):
        m, step = (y[b] - y[a]) / (x[b] - x[a]), max(1, 1_000_000 // max(1, n))
        for k in range(0, len(a), step):
            x0, y0, slope = (v[k : k + step, None] for v in (x[a], y[a], m))
            near = np.abs(y - y0 - slope * (x - x0)) <= tolerance
            counts = near.sum(axis=1)
            if counts.max() > most:
                best, most = near[counts.argmax()], counts.max()
    return best


def ransac_line(df: DataFrame, keys: list[str], x: str, y: str, tie: str, tolerance: float, draws: int = 200, seed: int = 0) -> DataFrame:
    """keys, slope, intercept, inliers: the line through two rows that most rows lie within
    ``tolerance`` of, refitted to them by least squares. Rows with a null or NaN x or y are none and
    never drawn; the first draw of equally good lines wins; a key without two different ``x`` among
    its drawn rows has null and 0 inliers; a null key is one like others.

    A key's rows are numbered in the order of ``x``, ``tie``, ``y``; draw k takes the rows at two shares
    of their number that depend on ``seed`` and k alone (:func:`drawn`). Keys of up to ranges.RANGE_ROWS
    rows are taken one to a task. Of larger ones the rows drawn meet their
    draws by number, a key's lines, at most ``draws``, go to all its rows, and one aggregate counts
    what lies near each, so neither partitioning nor the size of a key matters.
    """
    spark, scratch = df.sparkSession, []
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    usable = df.where(is_number(x) & is_number(y)).select(*keys, a.alias("_x"), b.alias("_y"), F.col(tie).alias("_tie"))
    large = usable.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > ranges.RANGE_ROWS)
    large = F.broadcast(staged(large.select(*keys), "large", scratch))  # one for RANGE_ROWS rows at most
    order, inlier = ["_x", "_tie", "_y"], T.StructType([*[df.schema[k] for k in keys], T.StructField("_x", T.DoubleType()), T.StructField("_y", T.DoubleType())])
    chances = tuple(np.array([drawn(seed, k, side) for k in range(draws)]) for side in (0, 1))

    def near_best(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        return pdf.loc[_inliers(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), chances, tolerance), inlier.fieldNames()]

    small = keyed_join(usable, large, keys, "left_anti").withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    inside = small.drop("_tie").groupBy(*keys).applyInPandas(near_best, inlier)
    if not large.isEmpty():
        inside = inside.unionByName(_inside_large(keyed_join(usable, large, keys, "left_semi"), keys, tolerance, draws, seed, scratch))
    fits = inside.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count("*").alias("inliers")).where("slope is not null")
    found = keyed_join(df.select(*keys).distinct(), fits, keys, "left").withColumn("inliers", F.coalesce("inliers", F.lit(0).cast("long")))
    found = staged(found, "lines")
    drop(spark, scratch)
    return found


def _inside_large(usable: DataFrame, keys: list[str], tolerance: float, draws: int, seed: int, scratch: list[str]) -> DataFrame:
    """Rows near the best line of keys that no task holds."""
    placed = staged(in_places(usable, keys, ["_x", "_tie", "_y"], scratch, "_place").drop("_tie"), "placed", scratch)
    sizes = staged(placed.groupBy(*keys).agg(F.count("*").alias("_n")), "sizes", scratch)

    shares = F.array(*[F.struct(F.lit(k).alias("_draw"), F.lit(drawn(seed, k, 0)).alias("_u"), F.lit(drawn(seed, k, 1)).alias("_w")) for k in range(draws)])
    asks = sizes.select("*", F.inline(shares))
    ask = lambda share, side: asks.select(*keys, "_draw", F.least(F.floor(F.col("_n") * F.col(share)), F.col("_n") - 1).alias("_place"), F.lit(side).alias("_side"))
    met = keyed_join(ask("_u", 0).unionByName(ask("_w", 1)), placed, [*keys, "_place"])
    end = lambda side: F.max(F.when(F.col("_side") == side, F.struct("_x", "_y")))
    ends = met.groupBy(*keys, "_draw").agg(end(0).alias("_a"), end(1).alias("_b")).where("_a._x <> _b._x")
    line = F.struct("_draw", F.col("_a._x").alias("x"), F.col("_a._y").alias("y"), ((F.col("_b._y") - F.col("_a._y")) / (F.col("_b._x") - F.col("_a._x"))).alias("m"))
    lines = ends.groupBy(*keys).agg(F.collect_list(line).alias("_lines"))
    lines = staged(keyed_join(lines, sizes, keys), "lines", scratch)

    near = lambda at: F.abs(F.col("_y") - at["y"] - at["m"] * (F.col("_x") - at["x"])) <= tolerance
    scored = to_each(placed, lines, keys).select(*keys, "_x", "_y", F.explode("_lines").alias("_line"))
    counts = scored.where(near(F.col("_line"))).groupBy(*keys, "_line").agg(F.count("*").alias("_inside"))
    best = counts.groupBy(*keys).agg(F.min_by("_line", F.struct(-F.col("_inside"), "_line._draw")).alias("_line"))
    best = staged(keyed_join(best, sizes, keys), "best", scratch)
    return to_each(placed, best, keys).where(near(F.col("_line"))).select(*keys, "_x", "_y")
