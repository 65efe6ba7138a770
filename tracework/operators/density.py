"""Density rasters: how often a trace passes each pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..frame import Series, finite, lagged


def raster(df: DataFrame, s: Series, x: tuple[float, float], y: tuple[float, float], width: int, height: int) -> DataFrame:
    """(.., px, py, n) for pixels that at least one line of the trace passes.

    A sample's line to the next one counts in the column that holds its time, in
    both where it lies on a border.  Values beyond the range are drawn at the
    border, NaN at the bottom (value 0 of the range).  A column's runs are
    summed as +1 at the lower end and -1 above the upper.
    """
    (x0, x1), (y0, y1) = x, y
    span = x1 - x0
    if span <= 0 or y1 - y0 <= 0 or width < 1 or height < 1:
        return df.select(*s.by, F.lit(0).alias("px"), F.lit(0).alias("py"), F.lit(0).cast("long").alias("n")).limit(0)
    raw = (F.col(s.v) - y0) / (y1 - y0) * height
    px_of = F.when(F.isnan(raw) | raw.isNull(), 0).otherwise(F.least(F.greatest(raw, F.lit(-2147483648.0)), F.lit(2147483647.0)).cast("int"))
    df = df.where(finite(s.t)).select(*s.keys, s.t, s.row, px_of.alias("_y"))
    df = lagged(df, s, "_next", "_y", reverse=True).where("_next is not null").where(F.col(s.t).between(float(x0), float(x1)))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(height - 1))
    low, high = F.least("_y", "_next._y"), F.greatest("_y", "_next._y")
    near = F.floor((F.col(s.t) - x0) / span * width).cast("int")
    runs = df.select(*s.by, s.t, clamp(low).alias("_low"), clamp(high).alias("_high"), F.explode(F.array(near - 1, near, near + 1)).alias("px"))
    left, right = x0 + F.col("px") / float(width) * span, x0 + (F.col("px") + 1) / float(width) * span
    runs = runs.where(F.col("px").between(0, width - 1) & (F.col(s.t) >= left) & (F.col(s.t) <= right))
    steps = runs.select(*s.by, "px", F.inline(F.array(F.struct(F.col("_low").alias("_at"), F.lit(1).alias("_d")), F.struct((F.col("_high") + 1).alias("_at"), F.lit(-1).alias("_d")))))
    steps = steps.groupBy(*s.by, "px", "_at").agg(F.sum("_d").alias("_d"))
    column = Window.partitionBy(*s.by, "px").orderBy("_at")
    steps = steps.select(*s.by, "px", "_at", F.sum("_d").over(column.rowsBetween(Window.unboundedPreceding, 0)).alias("n"), F.lead("_at").over(column).alias("_to"))
    full = steps.where((F.col("n") > 0) & F.col("_to").isNotNull())
    return full.select(*s.by, "px", F.explode(F.sequence(F.col("_at"), F.col("_to") - 1)).alias("py"), "n")
