"""Text export of a time range."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..frame import Series
from ..operators.scan import time_range

DIGITS = 15


@F.pandas_udf(T.StringType())
def _decimals(v: pd.Series) -> pd.Series:
    """Rounded from the exact binary value, which the JVM's formatting, rounding the shortest decimal form, can't do."""
    parts = (f"{x:.{DIGITS}e}".split("e") for x in v)
    return pd.Series([f"{x[0]}e{int(x[1])}" if len(x) > 1 else "" for x in parts], index=v.index)


def exact(c: Column) -> Column:
    """Scientific form with fifteen decimals that reads back as a number; ``NaN``, ``inf`` and ``-inf``; empty for null."""
    text = F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(_decimals(c))
    return F.coalesce(text, F.lit(""))


def export_rows(df: DataFrame, s: Series, channels: Sequence[str], a: float, b: float) -> DataFrame:
    """(row_id, column_1, ..): the rows of ``[a, b]`` as text, time first."""
    columns = [s.t, *channels]
    return time_range(df, s, a, b).select(s.t, s.row, *(exact(F.col(c)).alias(f"column_{i + 1}") for i, c in enumerate(columns)))


def export_csv(df: DataFrame, s: Series, channels: Sequence[str], a: float, b: float, path: str) -> None:
    """Writes the range as CSV files with a header, ordered by time and row id over all files."""
    rows = export_rows(df, s, channels, a, b).orderBy(s.t, s.row)
    rows.select(*(f"column_{i + 1}" for i in range(len(channels) + 1))).write.mode("overwrite").csv(path, header=True, emptyValue="", quote="")
