"""Statistics of a stream in windows of event time; an addition of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.stats import finished, partials


def windowed_partials(stream: DataFrame, ts: str, v: str, width: str, slide: str | None = None, late: str = "0 seconds", by: Sequence[str] = ()) -> DataFrame:
    """(start, end, .., vmin, vmax, vsum, vsumsq, vcount) of each window, final once the watermark has passed it.

    Works on batches too.  Rows later than ``late`` behind the newest are dropped by a stream.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    told = stream.withWatermark(ts, late).groupBy(window.alias("_w"), *by).agg(*partials(v))
    return told.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "vmin", "vmax", "vsum", "vsumsq", "vcount")


def windowed_stats(stream: DataFrame, ts: str, v: str, width: str, slide: str | None = None, late: str = "0 seconds", by: Sequence[str] = ()) -> DataFrame:
    """(start, end, .., vmin, vmax, mean, rms, vpp, n) of windows with two finite samples at least."""
    return finished(windowed_partials(stream, ts, v, width, slide, late, by), ["start", "end", *by])
