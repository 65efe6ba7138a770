"""Range scans, envelopes and thinning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..frame import Series, finite, join_on, numbered


NAMED_CHUNKS = 10_000


def time_range(df: DataFrame, s: Series, a: float, b: float) -> DataFrame:
    """Rows with ``a <= t <= b``; none if ``a >= b``.  NaN, infinite and null times never match."""
    if not a < b:
        return df.limit(0)
    return df.where(F.col(s.t).between(float(a), float(b)) & finite(s.t))


def chunk_range(samples: DataFrame, chunk_stats: DataFrame, s: Series, a: float, b: float) -> DataFrame:
    """A range scan of one recording that names the chunks its zone map allows, so that files of other chunks are not opened."""
    if not a < b:
        return samples.limit(0)
    hit = chunk_stats.where((F.col("t_max") >= float(a)) & (F.col("t_min") <= float(b))).select(s.chunk).distinct()
    return time_range(of_chunks(samples, hit, s.chunk), s, a, b)


def of_chunks(samples: DataFrame, wanted: DataFrame, chunk: str) -> DataFrame:
    """The rows of the wanted chunks: up to ``NAMED_CHUNKS`` as a list that reaches the files, beyond it as the bounds of the list and a join."""
    some = sorted(r[0] for r in wanted.select(chunk).distinct().limit(NAMED_CHUNKS + 1).collect())
    if len(some) <= NAMED_CHUNKS:
        return samples.where(F.col(chunk).isin(some))
    low, high = wanted.agg(F.min(chunk), F.max(chunk)).first()
    return samples.where(F.col(chunk).between(low, high)).join(wanted.select(F.col(chunk).alias("_wanted")).distinct(), F.col(chunk) == F.col("_wanted"), "left_semi")


def channels(df: DataFrame, s: Series, names: Sequence[str]) -> DataFrame:
    """Time, row id and the named channels; a channel that is not there gives no rows."""
    if any(n not in df.columns for n in names):
        return df.select(*s.by, s.t, s.row).limit(0)
    return df.select(*s.by, *([s.chunk] if s.chunk else []), s.t, s.row, *names)


def long(df: DataFrame, s: Series, names: Sequence[str], name: str = "ch") -> DataFrame:
    """One row for each sample and channel: (.., ch, v)."""
    keep = [*s.by, *([s.chunk] if s.chunk else []), s.t, s.row]
    return df.unpivot(keep, list(names), name, s.v)


def delayed(df: DataFrame, s: Series, delay: float) -> DataFrame:
    """The series moved along the time axis."""
    return df.withColumn(s.t, F.col(s.t) + F.lit(float(delay)))


def cursor_range(x: tuple[float, float], cursors: tuple[float, float] | None) -> tuple[float, float]:
    """The view, cut to the span between two cursors where they are set."""
    if cursors is None:
        return x
    return max(min(cursors), x[0]), min(max(cursors), x[1])


def go_to(x: tuple[float, float], t: float) -> tuple[float, float]:
    """The view moved so that ``t`` is at its centre."""
    half = (x[1] - x[0]) / 2
    return t - half, t + half


def head_fraction(df: DataFrame, s: Series, share: float) -> DataFrame:
    """The first ``share`` of each series' time span."""
    span = df.where(finite(s.t)).groupBy(*s.by).agg(F.min(s.t).alias("_low"), F.max(s.t).alias("_high"))
    return join_on(df, span, s.by).where(F.col(s.t) <= F.col("_low") + (F.col("_high") - F.col("_low")) * float(share)).drop("_low", "_high")


def stride_for(rows: Column, max_points: int) -> Column:
    """Rows that one envelope bin takes so that at most ``max_points`` points come out."""
    return F.when(rows > max_points // 2, F.ceil(rows * 2 / max_points)).otherwise(F.lit(1)).cast("long")


def envelope(df: DataFrame, s: Series, stride: int | None = None, max_points: int | None = None, estimated_rows: int | None = None) -> DataFrame:
    """(.., row_id, t, v): each bin of ``stride`` rows gives its least value at its first time, and its greatest if that is more.

    Without a stride it follows from ``max_points`` and the rows of each series, or
    ``estimated_rows``.  A bin whose first value is NaN or null gives that one
    point; NaN and null elsewhere in a bin are passed over.
    """
    if (stride is None) == (max_points is None):
        raise ValueError("give either stride or max_points")
    df = numbered(df.where(finite(s.t)), s, "_rn")
    if stride is not None:
        width = F.lit(int(stride))
    elif estimated_rows is not None:
        width = stride_for(F.lit(int(estimated_rows)), max_points)
    else:
        df = join_on(df, df.groupBy(*s.by).agg(F.count("*").alias("_rows")), s.by)
        width = stride_for(F.col("_rows"), max_points)
    v = F.col(s.v)
    df = df.select(*s.by, s.t, s.row, v.alias("_v"), F.floor((F.col("_rn") - 1) / width).alias("_bin"), ((F.col("_rn") - 1) % width == 0).alias("_opens"))
    real = F.when(~F.isnan("_v"), F.col("_v"))
    opening = lambda c: F.max(F.when(F.col("_opens"), F.col(c)))  # noqa: E731  (of one row: aggregates of plain numbers are hashed, not sorted)
    bins = df.groupBy(*s.by, "_bin").agg(opening(s.t).alias(s.t), opening(s.row).alias(s.row), opening("_v").alias("_first"), F.min(real).alias("_low"), F.max(real).alias("_high"))
    blank = F.col("_first").isNull() | F.isnan("_first")
    low = F.when(blank, F.col("_first")).otherwise(F.col("_low"))
    high = F.when(~blank & (F.col("_high") > F.col("_low")), F.col("_high"))
    pair = F.array(F.struct(F.lit(True).alias("is"), low.alias("v")), F.struct(high.isNotNull().alias("is"), high.alias("v")))
    points = bins.select(*s.by, s.t, s.row, F.posexplode(pair).alias("point", "_p"))
    return points.where("_p.is").select(*s.by, s.row, "point", s.t, F.col("_p.v").alias(s.v))


def envelopes(df: DataFrame, s: Series, names: Sequence[str], **how) -> DataFrame:
    """Envelopes of several channels from one scan: (.., ch, row_id, point, t, v)."""
    return envelope(long(df, s, names), replace(s, by=(*s.by, "ch")), **how)


def thinned(df: DataFrame, s: Series, step: int) -> DataFrame:
    """Every ``step``-th row from the first."""
    return numbered(df, s, "_rn").where((F.col("_rn") - 1) % int(step) == 0).drop("_rn")


def first_rows(df: DataFrame, s: Series, n: int) -> DataFrame:
    """The first ``n`` rows of each series."""
    return numbered(df, s, "_rn").where(F.col("_rn") <= int(n)).drop("_rn")


def point_budget(stale: int) -> int:
    """Points that a channel may take when ``stale`` of them are read at once."""
    return min(max(1_500_000 // max(stale, 1), 20_000), 400_000)
