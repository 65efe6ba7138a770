"""Statistics from mergeable partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..frame import Series, finite, join_on
from .scan import of_chunks, time_range

PARTIAL = ("vmin", "vmax", "vsum", "vsumsq", "vcount")


def partials(v: Column | str) -> list[Column]:
    """Aggregates over the finite values: (vmin, vmax, vsum, vsumsq, vcount); null and 0 where there is none."""
    v = F.col(v) if isinstance(v, str) else v
    real = F.when(finite(v), v)
    return [F.min(real).alias("vmin"), F.max(real).alias("vmax"), F.sum(real).alias("vsum"), F.sum(real * real).alias("vsumsq"), F.count(real).alias("vcount")]


def merged() -> list[Column]:
    """Aggregates that combine partials."""
    return [F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"), F.sum("vsum").alias("vsum"), F.sum("vsumsq").alias("vsumsq"), F.sum("vcount").alias("vcount")]


def finished(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """(.., vmin, vmax, mean, rms, vpp, n) of partials with two finite samples at least."""
    n = F.col("vcount")
    return partial.where(n >= 2).select(*by, "vmin", "vmax", (F.col("vsum") / n).alias("mean"), F.sqrt(F.col("vsumsq") / n).alias("rms"), (F.col("vmax") - F.col("vmin")).alias("vpp"), n.alias("n"))


def range_stats(df: DataFrame, s: Series, a: float, b: float) -> DataFrame:
    """Statistics of each series within ``[a, b]``: one scan, combined before the shuffle."""
    return finished(time_range(df, s, a, b).groupBy(*s.by).agg(*partials(s.v)), s.by)


def extent(df: DataFrame, s: Series) -> DataFrame:
    """(.., n_rows, x_min, x_max): rows of any time, and the finite times' range."""
    t = F.when(finite(s.t), F.col(s.t))
    return df.groupBy(*s.by).agg(F.count("*").alias("n_rows"), F.min(t).alias("x_min"), F.max(t).alias("x_max"))


def chunk_stats(samples: DataFrame, s: Series, names: Sequence[str]) -> DataFrame:
    """The zone map and partial statistics of each chunk, a row for each channel, from one pass over the samples.

    (.., chunk, t_min, t_max, row_count, row_offset, ch, vmin, vmax, vsum, vsumsq, vcount)
    """
    t = F.when(finite(s.t), F.col(s.t))
    inside = [F.when(finite(s.t), F.col(n)) for n in names]
    each = [c.alias(f"_{i}_{k}") for i, v in enumerate(inside) for k, c in zip(PARTIAL, partials(v))]
    wide = samples.groupBy(*s.keys).agg(F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.count("*").alias("row_count"), *each)
    before = Window.partitionBy(*s.by).orderBy(s.chunk).rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("row_offset", F.coalesce(F.sum("row_count").over(before), F.lit(0)))
    rows = F.array(*(F.struct(F.lit(n).alias("ch"), *(F.col(f"_{i}_{k}").alias(k) for k in PARTIAL)) for i, n in enumerate(names)))
    return wide.select(*s.keys, "t_min", "t_max", "row_count", "row_offset", F.inline(rows))


def stats_from_chunks(samples: DataFrame, stats: DataFrame, s: Series, names: Sequence[str], a: float, b: float) -> DataFrame:
    """Range statistics for each channel, answered from the chunk table where a chunk lies inside ``[a, b]``; only the chunks on the border are read."""
    keys = [*s.by, "ch"]
    if not a < b:
        return finished(stats.limit(0), keys)
    whole = (F.col("t_min") >= float(a)) & (F.col("t_max") <= float(b))
    touched = (F.col("t_max") >= float(a)) & (F.col("t_min") <= float(b))
    inside = stats.where(whole).select(*keys, *PARTIAL)
    border = stats.where(touched & ~whole).select(*s.keys).distinct()
    edge = of_chunks(samples, border, s.chunk).join(border, list(s.keys), "left_semi")
    read = time_range(edge, s, a, b).unpivot([*s.by], list(names), "ch", "_v").groupBy(*keys).agg(*partials("_v"))
    return finished(inside.unionByName(read).groupBy(*keys).agg(*merged()), keys)


def y_range(df: DataFrame, s: Series, margin: float = 0.05) -> DataFrame:
    """(.., y_lo, y_hi): the finite values' range with a margin on either side."""
    v = F.when(finite(s.v), F.col(s.v))
    low, high = F.min(v), F.max(v)
    return df.groupBy(*s.by).agg((low - (high - low) * margin).alias("y_lo"), (high + (high - low) * margin).alias("y_hi"))


def linked_y_range(df: DataFrame, s: Series, margin: float = 0.1) -> DataFrame:
    """(center, half): one range for all series together, its half span widened by the margin."""
    v = F.when(finite(s.v), F.col(s.v))
    low, high = F.min(v), F.max(v)
    return df.agg(((low + high) / 2).alias("center"), ((high - low) / 2 * (1 + margin)).alias("half"))


def tone_mapped(grid: DataFrame, value: str, name: str = "tone", by: Sequence[str] = ()) -> DataFrame:
    """The grid with ``log(1 + v) / log(1 + max)``; 0 where the grid holds nothing."""
    top = grid.groupBy(*by).agg(F.max(value).alias("_top"))
    tone = F.coalesce(F.log1p(value) / F.nullif(F.log1p("_top"), F.lit(0.0)), F.lit(0.0))
    return join_on(grid, top, by).withColumn(name, tone).drop("_top")
