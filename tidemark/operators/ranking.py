"""Top lists, suppression, sampling by rank, duplicates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.keys import keyed_join
from tidemark.operators.ranges import in_places
from tidemark.operators.sessions import running
from tidemark.plans.staging import drop, staged


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, with rank from 1; rows that are equal in it come
    in any order. A null key is one like others. Partitions cut their own rows to ``k`` first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


#: Rows of a key, the best left, that one task goes through in a round of suppression.
HEAD = 20_000


def _suppressed(k: int, ratio: float, tie: str):
    """The best rows left of a key, in order, that none before them suppresses, up to ``k`` in all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        have, ties = int(pdf["_have"].iloc[0]), pdf[tie].tolist()
        start, end, whole = pdf["_start"].to_numpy(), pdf["_end"].to_numpy(), pdf["_whole"].to_numpy(bool)
        kept, seen = np.empty(0, np.int64), set()
        for i in range(len(pdf)):
            if have + len(kept) == k:
                break
            name = None if pd.isna(ties[i]) else ties[i]
            shared = np.minimum(end[kept], end[i]) - np.maximum(start[kept], start[i])
            shorter = np.minimum(end[kept] - start[kept], end[i] - start[i])
            if name in seen or whole[i] and (whole[kept] & (shared >= 0) & (shared >= ratio * shorter)).any():
                continue
            seen.add(name)
            kept = np.append(kept, i)
        return pdf.iloc[kept].assign(rank=np.arange(have + 1, have + len(kept) + 1, dtype=np.int32))

    return run


def top_k_suppressed(df: DataFrame, keys: list[str], score: str, tie: str, start: str, end: str, k: int, ratio: float) -> DataFrame:
    """Up to ``k`` intervals of each key by falling score (ties to the smaller ``tie``), passing
    over those whose overlap with a chosen one is at least ``ratio`` of the shorter: ``df``'s
    columns and rank. A null key is one like others, a null or NaN score is the last; an interval with a
    null end, or one before its start, overlaps nothing; rows that share their key's ``tie`` are one.

    Keys of up to HEAD rows are taken one to a task. Where one has more, one task a key goes in each round
    through its HEAD best rows left. A key that has fewer is done, as is
    one with ``k`` chosen; of the others, what the round has chosen suppresses rows of the rest before
    the next one. So rounds follow how many rows the chosen ones suppress, not ``k``.
    """
    spark, scratch = df.sparkSession, []
    order = F.struct(F.col(score).isNull(), -F.col(score), F.col(tie))
    whole = F.coalesce(F.col(start) <= F.col(end), F.lit(False))
    sides = {f"_{n}": F.when(whole, F.col(c)).otherwise(F.lit(0)) for n, c in (("start", start), ("end", end))}
    rest, chosen = df.withColumns({**sides, "_whole": whole, "_order": order, "_have": F.lit(0)}), None
    schema = T.StructType([*df.schema, T.StructField("rank", T.IntegerType()), *[rest.schema[c] for c in ("_start", "_end", "_whole", "_order")]])
    best = Window.partitionBy(*keys).orderBy("_order")
    run = lambda pdf: _suppressed(k, ratio, tie)(pdf)[schema.names]
    if df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > HEAD).isEmpty():
        return rest.withColumn("_place", F.row_number().over(best)).groupBy(*keys).applyInPandas(run, schema).select(*df.columns, "rank")
    while True:
        head = staged(rest.withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= HEAD), "head", scratch)
        kept = staged(head.groupBy(*keys).applyInPandas(run, schema), "kept", scratch)
        chosen = kept if chosen is None else chosen.unionByName(kept)
        full = head.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_order").alias("_last")).where(F.col("_n") == HEAD)
        have = chosen.groupBy(*keys).agg(F.count("*").cast("int").alias("_have")).where(F.col("_have") < k)
        open_ = staged(keyed_join(full.drop("_n"), have, keys), "open", scratch)
        if open_.isEmpty():
            break
        new = kept.groupBy(*keys).agg(F.collect_list(F.struct("_start", "_end", "_whole", F.col(tie).alias("_tie"))).alias("_by"))  # up to ``k``
        left = keyed_join(keyed_join(rest.drop("_have"), open_, keys), new, keys, "left").where(F.col("_order") > F.col("_last"))
        shared = lambda o: F.least(F.col("_end"), o["_end"]) - F.greatest(F.col("_start"), o["_start"])
        shorter = lambda o: F.least(F.col("_end") - F.col("_start"), o["_end"] - o["_start"])
        gone = lambda o: F.col(tie).eqNullSafe(o["_tie"]) | (F.col("_whole") & o["_whole"] & (shared(o) >= 0) & (shared(o) >= ratio * shorter(o)))
        rest = staged(left.where(~F.coalesce(F.exists("_by", gone), F.lit(False))).drop("_last", "_by"), "rest", scratch)
    told = staged(chosen.select(*df.columns, "rank"), "chosen")
    drop(spark, scratch)
    return told


def rerank(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Ranks from 1 anew within each key, after rows were merged or removed; rows that are equal in the
    order come in any. A null key is one like others. Rows are ranked in ranges, so a key may hold any
    share of them. :func:`sorted_places` ranks a whole table."""
    ranked = staged(in_places(df, keys, list(order), scratch := [], "_place"), "ranked")
    drop(df.sparkSession, scratch)
    return ranked.withColumn("rank", F.col("_place") + 1).drop("_place")


def sorted_places(df: DataFrame, *order: Column) -> DataFrame:
    """All rows of ``df`` and place: their number from 1 in the order of ``order``, which is total.

    Rows are dealt in ranges, sorted inside each, and staged with the number of their range; the
    sizes of the ranges before a row's own are added. Only one row a range meets the others.
    """
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = staged(dealt, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn("place", (inside + F.col("_before")).cast("long")).select(*df.columns, "place")


def uniform_sample(df: DataFrame, keys: list[str], most: int, t: str, tie: str, bucket: int) -> DataFrame:
    """At most ``most`` rows of each key at even steps of the order of ``t``, ``tie``: places
    floor(i * n / most). Rows are numbered in buckets of ``t``, so a key may hold any share of
    them; a null key is one like others."""
    placed = running(df, keys, t, [tie], F.lit(1), bucket, "_i", "_n").withColumn("_i", F.col("_i") - 1)
    nth = F.ceil(F.col("_i") * most / F.col("_n"))
    return placed.where((F.col("_n") <= most) | ((nth < most) & (F.floor(nth * F.col("_n") / most) == F.col("_i")))).drop("_i", "_n")


def stride_sample(df: DataFrame, keys: list[str], most: int, t: str, tie: str, bucket: int) -> DataFrame:
    """Every ceil(n / most)-th row of each key, from the first; order, buckets and null keys as in
    :func:`uniform_sample`."""
    placed = running(df, keys, t, [tie], F.lit(1), bucket, "_i", "_n")
    return placed.where((F.col("_i") - 1) % F.ceil(F.col("_n") / most) == 0).drop("_i", "_n")


def first_of_key(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """One row for each composite key, the first in ``order``; keys may round values."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    best = keyed.groupBy(*names).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_b"))
    return best.select("_b.*")
