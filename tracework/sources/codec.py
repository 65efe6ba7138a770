"""A compact byte form of one channel's chunk: times by second differences and values by exclusive or of their bits, both under zstd."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, types as T

from ..frame import Series

LEVEL = 1
_HEAD = struct.Struct("<ddI")
_SIZE = struct.Struct("<I")


def encode(t: np.ndarray, v: np.ndarray) -> bytes:
    """Bytes of equally long times and values, exact to the bit; none for no rows."""
    t, v = np.ascontiguousarray(t, np.float64), np.ascontiguousarray(v, np.float64)
    if len(t) != len(v):
        raise ValueError("times and values differ in number")
    if not len(t):
        return b""
    steps = np.diff(t.view(np.int64))
    second = np.concatenate([steps[:1], np.diff(steps)])
    changes = v.view(np.uint64)[1:] ^ v.view(np.uint64)[:-1]
    packed = [zstandard.ZstdCompressor(level=LEVEL).compress(x.tobytes()) for x in (second, changes)]
    return _HEAD.pack(t[0], v[0], len(t)) + b"".join(_SIZE.pack(len(x)) + x for x in packed)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The times and values of ``encode``'s bytes; none for a run too short to hold a row."""
    if len(data) < _HEAD.size + 2 * _SIZE.size:
        return np.zeros(0), np.zeros(0)
    t0, v0, n = _HEAD.unpack_from(data)
    at, parts = _HEAD.size, []
    for _ in range(2):
        (size,) = _SIZE.unpack_from(data, at)
        at += _SIZE.size
        parts.append(zstandard.ZstdDecompressor().decompress(data[at : at + size]) if n > 1 else b"")
        at += size
    if not n:
        return np.zeros(0), np.zeros(0)
    first = np.array([t0]).view(np.int64)
    t = np.concatenate([first, first + np.cumsum(np.cumsum(np.frombuffer(parts[0], np.int64)))]).view(np.float64)
    v = np.bitwise_xor.accumulate(np.concatenate([np.array([v0]).view(np.uint64), np.frombuffer(parts[1], np.uint64)])).view(np.float64)
    return t, v


def encoded(df: DataFrame, s: Series) -> DataFrame:
    """(.., n, data) for each chunk of each series, in order of time and row id."""
    schema = T.StructType([*(df.schema[c] for c in s.keys), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by([(s.t, "ascending"), (s.row, "ascending")])
        data = encode(group.column(s.t).to_numpy(), group.column(s.v).to_numpy())
        return pa.table([*(group.column(c).slice(0, 1) for c in s.keys), pa.array([group.num_rows]), pa.array([data], pa.binary())], names=[f.name for f in schema])

    return df.select(*s.keys, s.t, s.row, s.v).groupBy(*s.keys).applyInArrow(one, schema)


def decoded(df: DataFrame, s: Series) -> DataFrame:
    """(.., i, t, v): the rows of encoded chunks, numbered from 0 within each."""
    schema = T.StructType([*(df.schema[c] for c in s.keys), T.StructField("i", T.LongType()), T.StructField(s.t, T.DoubleType()), T.StructField(s.v, T.DoubleType())])
    keys = len(s.keys)

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(keys).to_pylist()):
                t, v = decode(data or b"")
                same = pa.array(np.full(len(t), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in range(keys)), pa.array(np.arange(len(t))), pa.array(t), pa.array(v)], [f.name for f in schema])

    return df.select(*s.keys, "data").mapInArrow(open_, schema)
