"""Ordered series on DataFrames, and scans over them in one or two levels.

A series is a set of rows with a time, a value and a row id; its order is
(time, row id), so that equal times stay apart.  ``by`` names the columns that
tell series from each other.

A window over one long series would put all its rows into one partition.  Where
a series names a ``chunk`` column - a number that never falls along the order -
the scans run in two levels instead: within each (series, chunk) first, then over
one summary row for each chunk, whose result is joined back to the chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


#: Parts of a time span that are counted for each chunk of rows wanted.
_FINE = 16


@dataclass(frozen=True)
class Series:
    """Column names of a table of series."""

    t: str = "t"
    v: str = "v"
    row: str = "row_id"
    by: tuple[str, ...] = ()
    chunk: str | None = None

    @property
    def order(self) -> tuple[str, str]:
        return self.t, self.row

    @property
    def keys(self) -> tuple[str, ...]:
        return (*self.by, self.chunk) if self.chunk else self.by

    def window(self, reverse: bool = False) -> WindowSpec:
        """The order within a series, or within a chunk of it."""
        turn = F.desc if reverse else F.asc
        return Window.partitionBy(*self.keys).orderBy(*(turn(c) for c in self.order))

    def of_chunks(self, reverse: bool = False) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy((F.desc if reverse else F.asc)(self.chunk))

    def whole(self) -> Series:
        return replace(self, chunk=None)


def finite(v: Column | str) -> Column:
    """Neither null nor NaN nor infinite."""
    v = F.col(v) if isinstance(v, str) else v
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def above(v: Column, level: Column | float) -> Column:
    """``v > level``, false for NaN and null."""
    return F.coalesce((v > level) & ~F.isnan(v), F.lit(False))


def at_least(v: Column, level: Column | float) -> Column:
    """``v >= level``, false for NaN and null."""
    return F.coalesce((v >= level) & ~F.isnan(v), F.lit(False))


def below(v: Column, level: Column | float) -> Column:
    return F.coalesce(v < level, F.lit(False))


def at_most(v: Column, level: Column | float) -> Column:
    return F.coalesce(v <= level, F.lit(False))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null keys matching each other; without keys every row meets the one row of the right side."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    if not keys:
        return left.join(F.broadcast(right), how=how) if how != "inner" else left.crossJoin(F.broadcast(right))
    same = reduce(and_, (left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys))
    return left.join(right, same, how).drop(*(f"_right_{k}" for k in keys))


def chunked(df: DataFrame, s: Series, chunks: int, name: str = "chunk_id") -> tuple[DataFrame, Series]:
    """The rows with a chunk number by equal parts of each series' time span; times must be finite."""
    span = df.groupBy(*s.by).agg(F.min(s.t).alias("_low"), F.max(s.t).alias("_high"))
    part = F.floor((F.col(s.t) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * chunks)
    out = join_on(df, span, s.by).withColumn(name, F.least(F.coalesce(part, F.lit(0)), F.lit(chunks - 1)).cast("int"))
    return out.drop("_low", "_high"), replace(s, chunk=name)


def chunked_by_rows(df: DataFrame, s: Series, rows: int, name: str = "chunk_id") -> tuple[DataFrame, Series]:
    """The rows with a chunk number, so that a chunk holds some ``rows`` of them however unevenly the times lie; times must be finite.

    Rows are counted in equal parts of each series' time span, some ``_FINE`` for each
    chunk wanted, and neighbouring parts are taken together; only a part that is
    itself fuller makes a larger chunk.
    """
    span = df.groupBy(*s.by).agg(F.min(s.t).alias("_low"), F.max(s.t).alias("_high"), (F.ceil(F.count("*") / rows) * _FINE).alias("_parts"))
    part = F.floor((F.col(s.t) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * F.col("_parts"))
    placed = join_on(df, span, s.by).withColumn("_part", F.least(F.coalesce(part, F.lit(0)), F.col("_parts") - 1)).drop("_low", "_high", "_parts")
    counts = placed.groupBy(*s.by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*s.by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    chunks = counts.select(*s.by, "_part", F.floor(F.coalesce(before, F.lit(0)) / rows).cast("int").alias(name))
    return join_on(placed, chunks, (*s.by, "_part")).drop("_part"), replace(s, chunk=name)


def numbered(df: DataFrame, s: Series, name: str) -> DataFrame:
    """Adds the row's number in its series, from 1."""
    df = df.withColumn(name, F.row_number().over(s.window()).cast("long"))
    if not s.chunk:
        return df
    counts = df.groupBy(*s.keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(s.of_chunks().rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    return join_on(df, base, s.keys).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def lagged(df: DataFrame, s: Series, name: str, *values: str, reverse: bool = False) -> DataFrame:
    """Adds a struct of the named columns of the row before (after, if ``reverse``); null at a series' end."""
    value = F.struct(*values)
    step = F.lag(value).over(s.window(reverse))
    if not s.chunk:
        return df.withColumn(name, step)
    df = df.withColumns({name: step, "_edge": F.row_number().over(s.window(reverse)) == 1})
    ends = df.groupBy(*s.keys).agg((F.min_by if reverse else F.max_by)(value, F.struct(*s.order)).alias("_end"))
    carried = ends.withColumn("_carried", F.lag("_end").over(s.of_chunks(reverse))).drop("_end")
    return join_on(df, carried, s.keys).withColumn(name, F.when(F.col("_edge"), F.col("_carried")).otherwise(F.col(name))).drop("_carried", "_edge")


def running_sum(df: DataFrame, s: Series, name: str, value: Column) -> DataFrame:
    """Adds the sum of ``value`` from a series' first row to this one; null counts as 0."""
    df = df.withColumn("_value", F.coalesce(value, F.lit(0.0)))
    df = df.withColumn(name, F.sum("_value").over(s.window().rowsBetween(Window.unboundedPreceding, 0)))
    if s.chunk:
        totals = df.groupBy(*s.keys).agg(F.sum("_value").alias("_total"))
        before = F.sum("_total").over(s.of_chunks().rowsBetween(Window.unboundedPreceding, -1))
        base = totals.withColumn("_before", F.coalesce(before, F.lit(0.0))).drop("_total")
        df = join_on(df, base, s.keys).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
    return df.drop("_value")


def latest(df: DataFrame, s: Series, name: str, value: Column, reverse: bool = False) -> DataFrame:
    """Adds the last ``value`` that is not null among the rows before this one (after it, if ``reverse``)."""
    df = df.withColumn("_value", value)
    past = s.window(reverse).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(name, F.last("_value", ignorenulls=True).over(past))
    if s.chunk:
        pick = F.min_by if reverse else F.max_by
        ends = df.groupBy(*s.keys).agg(pick(F.col("_value"), F.when(F.col("_value").isNotNull(), F.struct(*s.order))).alias("_end"))
        before = s.of_chunks(reverse).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
        df = join_on(df, carried, s.keys).withColumn(name, F.coalesce(name, "_carried")).drop("_carried")
    return df.drop("_value")


def nth_smallest(df: DataFrame, s: Series, ranks: dict[str, Column], buckets: int = 1024) -> DataFrame:
    """For each series the finite values at the given ranks, counted from 0 among n sorted values.

    ``ranks`` are expressions of ``n``.  Values are counted in equal-width buckets
    first, and only the buckets that hold a wanted rank are ordered, so no
    series is ever sorted as a whole.
    """
    df = df.where(finite(s.v)).select(*s.by, F.col(s.v).alias("_v"))
    span = df.groupBy(*s.by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    bucket = F.least(F.floor(F.coalesce((F.col("_v") - F.col("_low")) / width, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")
    placed = join_on(df, span, s.by).select(*s.by, "_v", bucket.alias("_bucket"))
    upto = Window.partitionBy(*s.by).orderBy("_bucket")
    counts = placed.groupBy(*s.by, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = span.select(*s.by, F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))).alias("_w")).select(*s.by, "_w.*")
    found = join_on(counts, wanted, s.by).where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
    found = found.select(*s.by, "_bucket", "name", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("_left"))
    values = join_on(placed, found, (*s.by, "_bucket")).groupBy(*s.by, "name", "_left", "_v").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*s.by, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hit = values.withColumn("_upto", F.sum("_n").over(order)).where("_left < _upto and _left >= _upto - _n")
    out = hit.groupBy(*s.by).agg(*(F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in ranks))
    return join_on(out, span.drop("_low", "_high"), s.by)
