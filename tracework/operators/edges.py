"""Edges with hysteresis, clock crossings and symbol-period recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..frame import Series, above, at_least, at_most, below, join_on, lagged, latest, nth_smallest
from .align import following

POLARITIES = ("rising", "falling", "both")


def quartiles(df: DataFrame, s: Series) -> DataFrame:
    """(.., q25, q75, n): the sorted finite values at n / 4 and 3 n / 4, rounded down, without interpolation."""
    return nth_smallest(df, s, {"q25": F.floor(F.col("n") / 4), "q75": F.floor(F.col("n") * 3 / 4)})


def thresholds(df: DataFrame, s: Series) -> DataFrame:
    """(.., lo, hi): a tenth of the quartiles' distance on either side of their middle."""
    middle, margin = (F.col("q25") + F.col("q75")) / 2, (F.col("q75") - F.col("q25")) * 0.10
    return quartiles(df, s).select(*s.by, (middle - margin).alias("lo"), (middle + margin).alias("hi"))


def _checked(polarity: str) -> str:
    if polarity not in POLARITIES:
        raise ValueError(f"polarity is one of {POLARITIES}")
    return polarity


def schmitt(df: DataFrame, s: Series, polarity: str = "rising", levels: DataFrame | None = None) -> DataFrame:
    """(.., row_id, t, t_cross): rows where a trigger with hysteresis fires, and the interpolated time of passing its level.

    ``levels`` has (.., lo, hi); by default the quartile thresholds.  Rising fires on
    passing ``hi`` from below once it is armed by a value under ``lo`` - armed at
    first; falling is the mirror image; both fires on each change between the
    two sides, from the low side at first.  NaN and null never pass a level.
    """
    _checked(polarity)
    df = join_on(df.select(*s.keys, s.t, s.row, s.v), levels if levels is not None else thresholds(df, s), s.by)
    df = lagged(df, s, "_p", s.t, s.v)
    v, p, lo, hi, there = F.col(s.v), F.col(f"_p.{s.v}"), F.col("lo"), F.col("hi"), F.col("_p").isNotNull()
    if polarity == "rising":
        event = F.when(at_most(p, hi) & above(v, hi), 1).when(there & below(v, lo), 0)
    elif polarity == "falling":
        event = F.when(at_least(p, lo) & below(v, lo), 1).when(there & above(v, hi), 0)
    else:
        event = F.when(there & above(v, hi), 1).when(there & below(v, lo), 0)
    df = latest(df.withColumn("_event", event), s, "_state", F.col("_event"))
    state = F.coalesce(F.col("_state"), F.lit(0))
    fires = (F.col("_event") == 1) & (state == 0)
    if polarity == "both":
        fires = fires | ((F.col("_event") == 0) & (state == 1))
    level = F.when(F.col("_event") == 1, F.lit(1)).otherwise(0)
    passed = F.when(level == 1, lo if polarity == "falling" else hi).otherwise(lo)
    cross = F.col(f"_p.{s.t}") + (passed - p) / F.nullif(v - p, F.lit(0.0)) * (F.col(s.t) - F.col(f"_p.{s.t}"))
    return df.where(F.coalesce(fires, F.lit(False))).select(*s.keys, s.row, s.t, cross.alias("t_cross"))


def clock_crossings(df: DataFrame, s: Series, polarity: str = "rising", level: Column | None = None) -> DataFrame:
    """(.., row_id, t): interpolated times at which the value passes a level, by default the middle of the quartiles; no hysteresis."""
    _checked(polarity)
    if level is None:
        df = join_on(df.select(*s.keys, s.t, s.row, s.v), quartiles(df, s).select(*s.by, ((F.col("q25") + F.col("q75")) / 2).alias("_level")), s.by)
    else:
        df = df.select(*s.keys, s.t, s.row, s.v, level.alias("_level"))
    df = lagged(df, s, "_p", s.t, s.v)
    v, p, m = F.col(s.v), F.col(f"_p.{s.v}"), F.col("_level")
    up, down = at_most(p, m) & above(v, m), at_least(p, m) & below(v, m)
    hit = {"rising": up, "falling": down, "both": up | down}[polarity]
    t = F.col(f"_p.{s.t}") + (m - p) / F.nullif(v - p, F.lit(0.0)) * (F.col(s.t) - F.col(f"_p.{s.t}"))
    return df.where(hit).select(*s.keys, s.row, t.alias(s.t))


def symbol_period(edges: DataFrame, s: Series, t: str = "t_cross") -> DataFrame:
    """(.., ui, n_periods) from edge times, for series with three edges at least.

    The positive gaps are sorted; the first cluster ends where a gap is more than
    1.5 times the one before; its mean leaves out the lowest tenth and what lies
    above the index at nine tenths.  A cluster too small for that gives its middle gap.
    """
    order = Window.partitionBy(*s.by).orderBy(t, s.row)
    gaps = edges.select(*s.by, (F.col(t) - F.lag(t).over(order)).alias("gap"), F.count("*").over(Window.partitionBy(*s.by)).alias("_edges"))
    gaps = gaps.where((F.col("_edges") >= 3) & (F.col("gap") > 0) & ~F.isnan("gap"))
    rank = Window.partitionBy(*s.by).orderBy("gap")
    gaps = gaps.select(*s.by, "gap", (F.row_number().over(rank) - 1).alias("i"), F.lag("gap").over(rank).alias("_before"))
    breaks = F.min(F.when((F.col("i") > 0) & (F.col("gap") / F.greatest("_before", F.lit(1e-30)) > 1.5), F.col("i")))
    size = gaps.groupBy(*s.by).agg(F.coalesce(breaks, F.count("*")).alias("n"))
    placed = join_on(gaps, size, s.by)
    lo, hi = F.floor(F.col("n") / 10), F.floor(F.col("n") * 9 / 10)
    taken = F.when(hi > lo, F.col("i").between(lo, hi)).otherwise(F.col("i") == F.floor(F.col("n") / 2))
    return placed.where(taken).groupBy(*s.by).agg(F.avg("gap").alias("ui"), F.first("n").alias("n_periods"))


def auto_period(df: DataFrame, s: Series) -> DataFrame:
    """(.., ui, n_periods) of the rising hysteresis edges of each series."""
    return symbol_period(schmitt(df, s, "rising"), s)


def fixed_triggers(df: DataFrame, s: Series, ui: float) -> DataFrame:
    """(.., k, row_id, t): for k = 0, 1, ... the first sample at or after ``t0 + k * ui``, until none is left.

    A gap longer than ``ui`` gives its far sample once for each period skipped.
    """
    if not ui > 0:
        raise ValueError("ui must be positive")
    span = df.groupBy(*s.by).agg(F.min(s.t).alias("_t0"), F.max(s.t).alias("_t1"))
    ticks = span.select(*s.by, "_t0", "_t1", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_t1") - F.col("_t0")) / ui))).alias("k"))
    ticks = ticks.select(*s.by, "k", (F.col("_t0") + F.col("k") * ui).alias("_tick")).where(F.col("_tick").isNotNull())
    return following(ticks, df, s, "_tick", "k").drop("_tick")
