"""Thresholds: crossings of a level, and two-valued traces with exact edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..frame import Series, above, lagged

EPSILON = 2.220446049250313e-16


def interpolated(t0: Column, v0: Column, t1: Column, v1: Column, level: Column | float) -> Column:
    """The time at which the line from (t0, v0) to (t1, v1) meets a level; ``t0`` where it hardly rises or falls."""
    dv = v1 - v0
    steep = F.abs(dv) >= EPSILON
    return F.when(steep, t0 + (level - v0) / F.when(steep, dv) * (t1 - t0)).otherwise(t0)


def over(df: DataFrame, s: Series, level: float) -> DataFrame:
    """Rows strictly above a level; never NaN."""
    return df.where(above(F.col(s.v), float(level)))


def binarised(df: DataFrame, s: Series, level: float) -> DataFrame:
    """(.., row_id, point, t, v): 1 above the level, else 0; a crossing puts both values at the time where the line between the samples meets it.

    Points of one row come in the order of ``point``; a series of fewer than two rows gives none.
    """
    level = F.lit(float(level))
    df = lagged(lagged(df, s, "_p", s.t, s.v), s, "_next", s.t, reverse=True)
    v, pt, pv = F.col(s.v), F.col(f"_p.{s.t}"), F.col(f"_p.{s.v}")
    up, was = above(v, level), F.when(F.col("_p").isNotNull(), above(pv, level))
    dv = v - pv
    crosses = F.coalesce((up != was) & (F.abs(dv) > EPSILON), F.lit(False))  # with NaN beside it there is no line
    crosses = crosses & ~F.isnan(dv)
    at = pt + (level - pv) / F.when(crosses, dv) * (F.col(s.t) - pt)
    value = lambda flag: F.when(flag, 1.0).otherwise(0.0)
    point = lambda t, flag: F.struct(t.alias("t"), value(flag).alias("v"))
    points = F.when(crosses, F.array(point(at, was), point(at, up), point(F.col(s.t), up))).otherwise(F.array(point(F.col(s.t), up)))
    alone = F.col("_p").isNull() & F.col("_next").isNull()
    return df.where(~alone).select(*s.keys, s.row, F.posexplode(points).alias("point", "_x")).select(*s.keys, s.row, "point", F.col("_x.t").alias(s.t), F.col("_x.v").alias(s.v))
