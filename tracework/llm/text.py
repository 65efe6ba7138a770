"""Vectorised text kernels shared by the corpus operators.

Texts arrive as Arrow batches; the kernels work on the UTF-8 buffer with numpy,
so no per-character or per-word Python runs.  A *word* is a maximal run of
ASCII letters, digits and non-ASCII characters of the lower-cased text, other
than the blocks of general, Latin-1 and CJK punctuation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Bytes of text one numpy kernel call works on; bounds a worker's memory.
BLOCK_BYTES = 1 << 20

#: A word as a regular expression.
WORD = "[0-9A-Za-z\u00c0-\u1fff\u2080-\u2fff\u3040-\U0010ffff]+"

_WORD = np.zeros(256, bool)
_WORD[[c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128]] = True
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
_BYTE = ((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to words."""
    inside = _WORD[data]
    two = np.flatnonzero(data[:-1] == 0xC2)  # U+0080 to U+00BF
    inside[two] = inside[two + 1] = False
    if len(data) > 2:
        lead, next_ = data[:-2], data[1:-1]
        three = np.flatnonzero(((lead == 0xE2) & ((next_ & 0xFE) == 0x80)) | ((lead == 0xE3) & (next_ == 0x80)))  # U+2000 to U+207F, U+3000 to U+303F
        for k in range(3):
            inside[three + k] = False
    return inside


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix) over an array of integers."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``max_bytes`` of text; a longer text is a slice of its own."""
    n = batch.num_rows
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    end = np.cumsum(size)
    at = 0
    while at < n:
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + max_bytes, side="right")))
        to = min(to, at + 65_000)
        yield batch.slice(at, to - at)
        at = to


def utf8(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null counts as empty) and the n + 1 offsets."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """The words of a block of texts in order; ``ptr[i]:ptr[i + 1]`` are those of text i."""

    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    doc: np.ndarray
    ptr: np.ndarray
    data: np.ndarray

    def string(self, i: int) -> str:
        return self.data[self.start[i] : self.start[i] + self.length[i]].tobytes().decode("utf-8", "replace")


def words(texts: pa.Array) -> Words:
    data, off = utf8(texts)
    n = len(off) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(n + 1, np.int64), data)
    inside = word_bytes(data)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < len(data)]
    first[at] = inside[at]  # a text's first byte begins a word of its own
    start = np.flatnonzero(first)
    if not len(start):
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(n + 1, np.int64), data)
    length = np.add.reduceat(inside, start, dtype=np.int64)
    reach = np.diff(np.append(start, len(data)))
    value = _BYTE[data[start[0] :]]
    value *= inside[start[0] :]
    value *= POWERS[(np.arange(start[0], len(data)) - np.repeat(start, reach)) & 4095]
    h = mix(np.add.reduceat(value, start - start[0]))
    ptr = np.searchsorted(start, off)
    return Words(h, start, length, np.repeat(np.arange(n), np.diff(ptr)), ptr, data)


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text index and word hash (48 bits) of each distinct word of each text, sorted."""
    key = np.sort((w.doc.astype(np.uint64) << np.uint64(48)) | (w.hash >> np.uint64(16)))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64(2**48 - 1)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra ones never reach Python or clash with the operator's, not even by another case of letters."""
    names = df.columns
    if any(sum(n.lower() == c.lower() for n in names) > 1 for c in columns):
        df = df.toDF(*(n if n in columns else f"_{i}" for i, n in enumerate(names)))
    return df.select(*[F.col(f"`{c}`") for c in columns])
