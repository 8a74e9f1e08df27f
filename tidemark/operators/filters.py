"""Filters by what a report's reader has filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, text: dict[str, str] | None = None, ranges: dict[str, tuple] | None = None, among: dict[str, list] | None = None) -> DataFrame:
    """Rows whose columns hold the given ``text`` (case aside, blanks around it do not count), lie in
    the closed ``ranges`` (an open end is None) and are one of ``among``.

    A blank text, a range with two open ends and an empty list ask for nothing. A null meets no
    criterion that asks for something. All are plain predicates, which the scan takes.
    """
    for name, wanted in (text or {}).items():
        if wanted.strip():
            df = df.where(F.contains(F.lower(name), F.lit(wanted.strip().lower())))
    for name, (low, high) in (ranges or {}).items():
        df = df if low is None else df.where(F.col(name) >= low)
        df = df if high is None else df.where(F.col(name) <= high)
    for name, wanted in (among or {}).items():
        df = df.where(F.col(name).isin(wanted)) if wanted else df
    return df
