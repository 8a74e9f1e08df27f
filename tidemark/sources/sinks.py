"""Results written for others: delimited text, JSON lines, original rows by lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """With a header in every part; arrays and structs become JSON text."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def original_rows(source: DataFrame, chosen: DataFrame) -> DataFrame:
    """The source's rows whose lineage key (source_file, source_row) is among ``chosen``."""
    return source.join(chosen.select("source_file", "source_row"), ["source_file", "source_row"], "left_semi")
