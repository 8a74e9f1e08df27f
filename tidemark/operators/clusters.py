"""Clusters of one series within a key: bins, gaps and two means."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.keys import keyed_join
from tidemark.operators.sessions import stretches
from tidemark.plans.staging import drop, staged


def gap_clusters(df: DataFrame, keys: list[str], value: str, gap: float, out: str = "cluster") -> DataFrame:
    """``out``: number from 0 of the value's cluster; a step over ``gap`` between neighbouring
    distinct values begins a new one. Null values are left out, a null key is one like others.

    Distinct values are taken in buckets of CELL gaps, of which only the last value and the number
    of steps meet the others, so a key may hold any share of them."""
    values = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    numbered = stretches(values, keys, value, value, [value], lambda p: F.col(value) - p[value] > gap, CELL * gap or 1, out)
    return keyed_join(df, numbered, [*keys, value])


#: Widths of a bin or gap in one bucket of values.
CELL = 64
#: Distinct values in one group of buckets, about.
GROUP_VALUES = 200_000


def _following(v: np.ndarray, at: np.ndarray, tolerance: float) -> np.ndarray:
    """For each of ``at``, the place in the sorted ``v`` of the first value over ``tolerance`` beyond."""
    j = np.searchsorted(v, at + tolerance, side="right")
    while (low := (j < len(v)) & (v[np.minimum(j, len(v) - 1)] - at <= tolerance)).any():  # rounding of the sum
        j[low] += 1
    while (high := (j > 0) & (v[np.maximum(j, 1) - 1] - at > tolerance)).any():
        j[high] -= 1
    return j


def _cells(pdf: pd.DataFrame, keys: list[str], value: str) -> tuple[pd.DataFrame, np.ndarray, list[tuple[int, int]]]:
    """A frame sorted by bucket and value, its values, and from where to where each bucket goes."""
    code = pdf.groupby([*keys, "_cell"], sort=False, dropna=False).ngroup().to_numpy()
    order = np.lexsort((pdf[value].to_numpy(), code))
    code = code[order]
    begins = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, int)
    pdf = pdf.iloc[order].reset_index(drop=True)
    return pdf, pdf[value].to_numpy(), list(zip(begins.tolist(), [*begins[1:].tolist(), len(code)]))


def _openings(keys: list[str], value: str, tolerance: float):
    """Of each bucket the values that its first anchor may be, each with the bucket's last anchor
    if it is: the first value and those whose forerunner is within the tolerance of it. Also
    whether the last anchor is the same for all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, values, cells = _cells(pdf, keys, value)
        kept, ends, sure = [], [], []
        for begin, end in cells:
            v = values[begin:end]
            last, step = np.arange(len(v)), _following(v, v, tolerance)
            while (inside := step[last] < len(v)).any():
                last = np.where(inside, step[np.where(inside, last, 0)], last)
            n = min(int((v - v[0] <= tolerance).sum()) + 1, len(v))
            kept.append(np.arange(begin, begin + n))
            ends.append(last[:n] + begin)
            sure.append(np.full(n, (last[:n] == last[0]).all()))
        at, ends, sure = (np.concatenate([np.empty(0, kind), *x]).astype(kind) for x, kind in ((kept, int), (ends, int), (sure, bool)))
        return pdf.iloc[at].assign(_last=values[ends], _sure=sure)

    return run


def _seek(keys: list[str], value: str, tolerance: float):
    """For each opening of an earlier bucket (``_asks``), the first of this one's openings over the
    tolerance beyond its last anchor, else the first of the bucket after, if there is one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, values, cells = _cells(pdf, keys, value)
        asks, last, later, on = (pdf[c].to_numpy() for c in ("_asks", "_last", "_later", "_goes_on"))
        to = np.full(len(pdf), None, object)
        for begin, end in cells:
            v, at = values[begin:end][~asks[begin:end]], np.flatnonzero(asks[begin:end]) + begin
            for i, k in zip(at, _following(v, last[at], tolerance), strict=True):
                to[i] = v[k] if k < len(v) else later[i] if on[i] else None
        return pdf[[*keys, value, "_sure"]].assign(_to=to)[asks]

    return run


def _anchored(keys: list[str], value: str, tolerance: float, out: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, values, cells = _cells(pdf, keys, value)
        opens, opening, before = (pdf[c].to_numpy() for c in ("_opens", "_opening", "_before"))
        anchors = np.empty(len(values), values.dtype)
        for begin, end in cells:
            v = values[begin:end]
            at = int(v.searchsorted(opening[begin])) if opens[begin] else len(v)
            anchors[begin : begin + at] = before[begin]
            while at < len(v):
                nxt = int(v.searchsorted(v[at] + tolerance, "right"))
                while nxt < len(v) and v[nxt] - v[at] <= tolerance:  # rounding of the sum
                    nxt += 1
                while v[nxt - 1] - v[at] > tolerance:
                    nxt -= 1
                anchors[begin + at : begin + nxt], at = v[at], nxt
        return pdf[[*keys, value]].assign(**{out: anchors})

    return run


def anchor_bins(df: DataFrame, keys: list[str], value: str, tolerance: float, out: str = "anchor") -> DataFrame:
    """``out``: the first value of the value's bin, rising; a bin holds what is within
    ``tolerance`` of its first value. Null values are left out, NaN is a bin of its own, a null key
    is one like others.

    Distinct values are taken in buckets of CELL tolerances. In a bucket each value that may be
    its first anchor leads to one last anchor and so to an opening of a later bucket; which of
    them are reached, from the key's first value and from those that every way leads to, is found
    by doubling the steps. Buckets are then scanned apart, anchor by anchor, so a key may hold any
    number of values.
    """
    kind = df.schema[value].dataType
    if not tolerance > 0:
        return df.where(F.col(value).isNotNull()).withColumn(out, F.col(value))
    if kind.typeName() in ("double", "float"):
        apart = df.where(F.isnan(value)).withColumn(out, F.col(value))
        return _anchor_bins(df.where(~F.isnan(value)), keys, value, tolerance, out).unionByName(apart)
    return _anchor_bins(df, keys, value, tolerance, out)


def _anchor_bins(df: DataFrame, keys: list[str], value: str, tolerance: float, out: str) -> DataFrame:
    kind = df.schema[value].dataType
    scratch: list[str] = []
    cell = F.floor(F.col(value) / (CELL * tolerance))
    values = staged(df.where(F.col(value).isNotNull()).select(*keys, value).distinct().withColumn("_cell", cell), "values", scratch)
    groups = max(1, -(-values.count() // GROUP_VALUES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = F.pmod(F.xxhash64(*keys, "_cell"), F.lit(groups)).alias("_group")
    fields = [*[df.schema[k] for k in keys], T.StructField(value, kind), T.StructField("_cell", T.LongType())]
    opened = values.groupBy(dealt).applyInPandas(_openings(keys, value, tolerance), T.StructType([*fields, T.StructField("_last", kind), T.StructField("_sure", T.BooleanType())]))
    openings = staged(opened, "openings", scratch)
    along = Window.partitionBy(*keys).orderBy("_cell")
    starts = openings.groupBy(*keys, "_cell").agg(F.min(value).alias("_start"))
    starts = starts.withColumns({"_next": F.lead("_cell").over(along), "_later": F.lead("_start", 2).over(along), "_number": F.row_number().over(along)})
    starts = staged(starts, "starts", scratch)

    node, root = F.struct(*keys, F.col(value).alias("v")), F.struct(*keys, F.col("_start").alias("v"))
    reached = starts.where("_number = 1").select(root.alias("node"))
    if not starts.where("_next is not null").isEmpty():
        asked = keyed_join(openings, starts, [*keys, "_cell"]).where("_next is not null").drop("_start", "_number")
        asks = asked.select(*keys, value, F.col("_next").alias("_cell"), "_last", F.coalesce("_later", value).alias("_later"), F.col("_later").isNotNull().alias("_goes_on"), "_sure", F.lit(True).alias("_asks"))
        openers = openings.select(*keys, value, "_cell", "_last", F.col(value).alias("_later"), F.lit(False).alias("_goes_on"), "_sure", F.lit(False).alias("_asks"))
        # A later bucket begins further beyond than the tolerance.
        found = asks.unionByName(openers).groupBy(dealt).applyInPandas(_seek(keys, value, tolerance), T.StructType([*fields[:-1], T.StructField("_sure", T.BooleanType()), T.StructField("_to", kind)]))
        steps = staged(found.where("_to is not null").select(node.alias("node"), F.struct(*keys, F.col("_to").alias("v")).alias("to"), "_sure"), "steps", scratch)
        reached = staged(reached.union(steps.where("_sure").select("to")).distinct(), "reached", scratch)
        steps, known, count = steps.drop("_sure"), 0, reached.count()
        while count > known:  # a round reaches all within twice the steps, so where it adds none there are none
            onward = reached.join(steps, "node").select("to")
            reached = staged(reached.union(onward).distinct(), "reached", scratch)
            known, count = count, reached.count()
            if count > known:
                steps = staged(steps.join(steps.select(F.col("node").alias("to"), F.col("to").alias("then")), "to").select("node", F.col("then").alias("to")), "steps", scratch)
    taken = openings.withColumn("node", node).join(reached, "node", "left_semi").select(*keys, "_cell", F.col(value).alias("_opening"), F.col("_last").alias("_end"))
    known = keyed_join(starts.select(*keys, "_cell"), taken, [*keys, "_cell"], "left")
    known = known.withColumn("_before", F.last("_end", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    known = known.select(*keys, "_cell", F.col("_opening").isNotNull().alias("_opens"), F.coalesce("_opening", "_before").alias("_opening"), F.coalesce("_before", "_opening").alias("_before"))
    scanned = keyed_join(values, known, [*keys, "_cell"]).groupBy(dealt).applyInPandas(_anchored(keys, value, tolerance, out), T.StructType([*fields[:-1], T.StructField(out, kind)]))
    scanned = staged(scanned, "anchors")
    drop(df.sparkSession, scratch)
    return keyed_join(df, scanned, [*keys, value])


def band_count(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """keys, bands: number of bins of :func:`anchor_bins`; a key of nulls only is left out."""
    return anchor_bins(df, keys, value, tolerance).groupBy(*keys).agg(F.count_distinct("anchor").alias("bands"))


def two_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, low_mean, high_mean, cut: Lloyd's algorithm on one dimension from the least and
    greatest value until no value changes sides; rows above ``cut`` are in the upper half. Where
    all values are equal both means are that value. Nulls do not count, a null key is one like
    others, and one of nulls only is left out.

    Every round is one aggregation of counted distinct values joined to a row a key; a cut only
    ever moves to fit its halves better, so rounds end.
    """
    scratch: list[str] = []
    counts = staged(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")), "values", scratch)
    low, high = F.min(value).cast("double").alias("low_mean"), F.max(value).cast("double").alias("high_mean")
    means = staged(counts.groupBy(*keys).agg(low, high, F.lit(-1).cast("long").alias("_above")), "means", before := [])
    cut = (F.col("low_mean") + F.col("high_mean")) / 2
    while True:
        up = F.col(value) > F.col("_cut")
        mean = lambda side: F.sum(F.when(side, F.col(value) * F.col("_n"))) / F.sum(F.when(side, F.col("_n")))  # noqa: B023, E731
        old = means.select(*keys, cut.alias("_cut"), F.col("_above").alias("_was"))
        sides = keyed_join(counts, old, keys).groupBy(*keys, "_was").agg(mean(~up).alias("_l"), mean(up).alias("_h"), F.sum(F.when(up, F.col("_n")).otherwise(0)).alias("_above"))
        new = staged(sides.select(*keys, F.col("_l").alias("low_mean"), F.coalesce("_h", "_l").alias("high_mean"), "_above", "_was"), "means", last := [])
        settled = new.where("_above <> _was").isEmpty()
        drop(df.sparkSession, before)
        before, means = last, new
        if settled:
            found = staged(means.select(*keys, "low_mean", "high_mean", cut.alias("cut")), "cuts")
            drop(df.sparkSession, before)
            drop(df.sparkSession, scratch)
            return found
