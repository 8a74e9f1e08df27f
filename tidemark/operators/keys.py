"""Joins on keys of which null is a value like others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all ``keys`` are equal, two nulls too.

    The join is on one struct of the keys, so it hashes and shuffles like any equi-join.
    """
    key = F.struct(*keys).alias("_key") if keys else F.lit(0).alias("_key")
    others = [c for c in right.columns if c not in keys]
    return left.withColumn("_key", key).join(right.select(key, *others), "_key", how).drop("_key")
