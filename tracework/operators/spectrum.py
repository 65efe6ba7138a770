"""Magnitude spectra by the fast Fourier transform."""

from __future__ import annotations

from collections.abc import Iterator
from enum import StrEnum

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..frame import Series, finite
from .scan import first_rows

MAX_SAMPLES = 131_072


class Taper(StrEnum):
    RECTANGLE = "rectangle"
    HANNING = "hanning"
    BLACKMAN_HARRIS = "blackman_harris"


class Scale(StrEnum):
    LINEAR = "linear"
    DB = "db"


_COSINES = {Taper.RECTANGLE: (1.0,), Taper.HANNING: (0.5, 0.5), Taper.BLACKMAN_HARRIS: (0.35875, 0.48829, 0.14128, 0.01168)}


def taper(n: int, kind: Taper | str = Taper.HANNING) -> np.ndarray:
    """The symmetric window of n samples: alternating cosines over n - 1 steps."""
    angle = 2 * np.pi * np.arange(n) / max(n - 1, 1)
    return sum((-1) ** k * a * np.cos(k * angle) for k, a in enumerate(_COSINES[Taper(kind)])) * np.ones(n)


def taper_column(i: Column, n: Column, kind: Taper | str = Taper.HANNING) -> Column:
    """The window's value at row ``i`` of ``n``, counted from 0."""
    angle = 2 * np.pi * i / (n - 1)
    total = F.lit(0.0)
    for k, a in enumerate(_COSINES[Taper(kind)]):
        total = total + (-1) ** k * a * F.cos(k * angle)
    return total


def decibel(magnitude: Column) -> Column:
    """20 log10, -200 at 1e-15 and below."""
    return F.when(magnitude > 1e-15, 20 * F.log10(magnitude)).otherwise(-200.0)


def magnitudes(x: np.ndarray, kind: Taper | str, scale: Scale | str) -> np.ndarray:
    """Spectra of the rows of x [m, n]: mean taken off, tapered, padded to a power of two, scaled to amplitude."""
    n = x.shape[1]
    w = taper(n, kind)
    size = 1 << (n - 1).bit_length()
    mag = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w, size, axis=1)) / (w.sum() * 0.5)
    if Scale(scale) == Scale.DB:
        with np.errstate(divide="ignore"):
            mag = np.where(mag > 1e-15, 20 * np.log10(np.where(mag > 1e-15, mag, 1)), -200.0)
    return mag


def spectrum(df: DataFrame, s: Series, kind: Taper | str = Taper.HANNING, scale: Scale | str = Scale.LINEAR, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """(.., k, freq, mag) of each series' first ``max_samples`` rows, which bounds what one task holds.

    The sample rate follows from the first and last time.  Fewer than four rows,
    or times that do not rise, give nothing.
    """
    kind, scale = Taper(kind), Scale(scale)
    kept = first_rows(df.where(finite(s.t)).select(*s.keys, s.t, s.row, s.v), s, max_samples).select(*s.by, s.t, s.row, s.v)
    schema = T.StructType([*(kept.schema[c] for c in s.by), T.StructField("k", T.IntegerType()), T.StructField("freq", T.DoubleType()), T.StructField("mag", T.DoubleType())])

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([s.t, s.row])
        t, n = p[s.t].to_numpy(float), len(p)
        dt = (t[-1] - t[0]) / (n - 1) if n > 1 else 0.0
        if n < 4 or dt <= 0:
            return pd.DataFrame({f.name: [] for f in schema})
        mag = magnitudes(p[s.v].to_numpy(float)[None], kind, scale)[0]
        size = 2 * (len(mag) - 1)
        return pd.DataFrame({**dict(zip(s.by, ([x] * len(mag) for x in key))), "k": np.arange(len(mag), dtype=np.int32), "freq": np.arange(len(mag)) / dt / size, "mag": mag})[[f.name for f in schema]]

    return kept.groupBy(*s.by).applyInPandas(one, schema)


def spectra_of_arrays(df: DataFrame, key: str, array: str, rate: float = 1.0, kind: Taper | str = Taper.HANNING, scale: Scale | str = Scale.LINEAR) -> DataFrame:
    """(key, k, freq, mag) of series stored as arrays with ``rate`` samples a second; arrays of equal length are transformed together, without a shuffle.

    Arrays that are null, shorter than four or hold a null give nothing.
    """
    kind, scale = Taper(kind), Scale(scale)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column(1)))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                part = batch.take(pa.array(at))
                mag = magnitudes(np.asarray(part.column(1).flatten(), float).reshape(-1, n)[:, :MAX_SAMPLES], kind, scale)
                m = mag.shape[1]
                k = np.tile(np.arange(m, dtype=np.int32), len(at))
                yield pa.record_batch([part.column(0).take(pa.array(np.repeat(np.arange(len(at)), m))), pa.array(k), pa.array(k * rate / (2 * (m - 1))), pa.array(mag.ravel())], [key, "k", "freq", "mag"])

    kept = df.where((F.size(array) >= 4) & F.forall(array, lambda x: x.isNotNull())).select(key, F.col(array).cast("array<double>"))
    kind_of_key = df.schema[key].dataType.simpleString()
    return kept.mapInArrow(transform, f"`{key}` {kind_of_key}, k int, freq double, mag double")
