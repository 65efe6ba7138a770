"""Pulse measurements: period, frequency, duty cycle, widths, rise and fall time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..frame import Series, above, at_least, at_most, below, join_on, lagged, numbered
from .stats import range_stats
from .scan import time_range
from .threshold import EPSILON, interpolated


def levels(df: DataFrame, s: Series) -> DataFrame:
    """(.., n_rows, low, high) of series of four rows at least whose values differ; NaN is passed over, infinities count."""
    v = F.when(~F.isnan(s.v), F.col(s.v))
    found = df.groupBy(*s.by).agg(F.count("*").alias("n_rows"), F.min(v).alias("low"), F.max(v).alias("high"))
    return found.where((F.col("n_rows") >= 4) & (F.col("high") - F.col("low") >= EPSILON))


def crossings(df: DataFrame, s: Series, level: Column | float | None = None) -> DataFrame:
    """(.., row_id, t, direction): rows where the value first is above (``rising``) or no longer above (``falling``) a level, by default the middle of each series."""
    if level is None:
        df = join_on(df, levels(df, s), s.by)
        level = (F.col("high") + F.col("low")) / 2
    df = lagged(df.withColumn("_level", F.lit(level) if isinstance(level, float | int) else level), s, "_p", s.v)
    v, p, m = F.col(s.v), F.col(f"_p.{s.v}"), F.col("_level")
    direction = F.when(at_most(p, m) & above(v, m), "rising").when(above(p, m) & at_most(v, m), "falling")
    return df.withColumn("direction", direction).where("direction is not null").select(*s.keys, s.row, s.t, "direction")


def _edge(flagged: DataFrame, s: Series, rising: bool, mode: str) -> DataFrame:
    """(.., dt) of the first edge: from its first crossing of one level to the first crossing of the other after it."""
    name = "rise_time" if rising else "fall_time"
    v, p = F.col(s.v), F.col(f"_p.{s.v}")
    ten, ninety = F.col("low") + F.lit(0.1) * (F.col("high") - F.col("low")), F.col("low") + F.lit(0.9) * (F.col("high") - F.col("low"))
    start, stop = (ten, ninety) if rising else (ninety, ten)
    crosses = (lambda x: below(p, x) & at_least(v, x)) if rising else (lambda x: above(p, x) & at_most(v, x))
    at = lambda x: interpolated(F.col(f"_p.{s.t}"), p, F.col(s.t), v, x)
    marked = flagged.select(*s.by, "_rn", F.when(crosses(start), at(start)).alias("_from"), F.when(crosses(stop), at(stop)).alias("_to"))
    marked = marked.where("_from is not null or _to is not null")
    first = marked.where("_from is not null").groupBy(*s.by).agg(F.min("_rn").alias("_start"), F.min_by("_from", "_rn").alias("_t0"))
    later = F.col("_rn") > F.col("_start") if mode == "reference" else F.col("_rn") >= F.col("_start")
    reached = join_on(marked.where("_to is not null"), first, s.by).where(later)
    return reached.groupBy(*s.by).agg((F.min_by("_to", "_rn") - F.first("_t0")).alias(name)).where(F.col(name) > 0)


def pulse(df: DataFrame, s: Series, mode: str = "exact") -> DataFrame:
    """(.., period, frequency, duty_cycle, pos_width, neg_width, rise_time, fall_time), null where there is none.

    The period is the mean gap of two or more rising middle crossings; the duty
    cycle is the share of time before samples above the middle.  An edge that
    passes both its levels between two samples counts; ``mode="reference"`` looks
    for the second level only from the next sample on.  A series of fewer than
    four rows, or without any change, gives no row.
    """
    if mode not in ("exact", "reference"):
        raise ValueError("mode is exact or reference")
    df = df.select(*s.keys, s.t, s.row, s.v)
    known = levels(df, s)
    df = numbered(lagged(join_on(df, known, s.by), s, "_p", s.t, s.v), s, "_rn")
    mid = (F.col("high") + F.col("low")) / 2
    rising = at_most(F.col(f"_p.{s.v}"), mid) & above(F.col(s.v), mid)
    edge_t, dt = F.when(rising, F.col(s.t)), F.when(above(F.col(s.v), mid), F.col(s.t) - F.col(f"_p.{s.t}"))
    told = df.groupBy(*s.by).agg(
        F.count(edge_t).alias("_edges"), F.min_by(edge_t, F.when(rising, F.col("_rn"))).alias("_first"), F.max_by(edge_t, F.when(rising, F.col("_rn"))).alias("_last"),
        (F.max_by(s.t, "_rn") - F.min_by(s.t, "_rn")).alias("_total"), F.coalesce(F.sum(dt), F.lit(0.0)).alias("_high_time"),
    )
    period = F.when(F.col("_edges") >= 2, (F.col("_last") - F.col("_first")) / (F.col("_edges") - 1))
    told = told.withColumn("period", F.when(period > 0, period))
    duty = F.when(F.col("period").isNotNull() & (F.col("_total") > 0), F.col("_high_time") / F.col("_total") * 100)
    told = told.withColumn("duty_cycle", duty).select(
        *s.by, "period", (1 / F.col("period")).alias("frequency"), "duty_cycle",
        (F.col("duty_cycle") / 100 * F.col("period")).alias("pos_width"), ((100 - F.col("duty_cycle")) / 100 * F.col("period")).alias("neg_width"),
    )
    for rises in (True, False):
        told = join_on(told, _edge(df, s, rises, mode), s.by, "left")
    return told


def measurements(df: DataFrame, s: Series, a: float, b: float, mode: str = "exact") -> DataFrame:
    """The five statistics and seven pulse metrics of each series within ``[a, b]``."""
    return join_on(range_stats(df, s, a, b), pulse(time_range(df, s, a, b), s, mode), s.by, "left")
