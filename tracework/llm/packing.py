"""Sequence packing by power-of-two decomposition (operator 9).

A document of n tokens (its subword ids and the end-of-text id) is cut into
consecutive pieces whose lengths are powers of two: as many of ``max_length``
as fit, then the binary digits of the rest, longest first.  Pieces of equal
length form a bucket; a batch takes ``batch_tokens`` tokens of one bucket, so no
sequence crosses documents and none is padded.  Nothing is shuffled: batches
are filled partition by partition.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .text import POWERS, blocks, documents, mix, only

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_OF_TEXT = 50256
MAX_LENGTH = 8192
BATCH_TOKENS = 65536

SCHEMA = "length int, batch long, doc_id long, piece int, first_token long, tokens array<int>"
_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(path: str = TOKENIZER) -> tiktoken.Encoding:
    """The tokenizer of a rank file, loaded once in a process."""
    if path not in _encoders:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_ids(path: str, text: str) -> np.ndarray:
    raw = encoder(path)._core_bpe.encode_to_tiktoken_buffer(text, set())
    return np.frombuffer(raw, np.uint32).astype(np.int32)


#: Classes of code points in ``PATTERN``: letters, numbers, white space, others, and those that are unassigned here and may be anything elsewhere.
_LETTER, _NUMBER, _SPACE, _OTHER, _UNSURE = range(5)
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SLOTS = 1 << 20
#: Pieces beyond this many characters are encoded one by one.
_LONG = 64
_kinds: list[np.ndarray] = []
_caches: dict[str, "_Cache"] = {}


def _classes() -> np.ndarray:
    if not _kinds:
        of = {"L": _LETTER, "N": _NUMBER}
        kind = np.array([_UNSURE if (c := unicodedata.category(chr(i))) == "Cn" else of.get(c[0], _OTHER) for i in range(0x110000)], np.uint8)
        kind[_SPACES] = _SPACE
        _kinds.append(kind)
    return _kinds[0]


def piece_starts(cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of ``PATTERN`` begin in code points of classes ``kind``; ``first`` marks the texts' first ones."""
    n = len(cp)
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    begin = run.copy()
    ends = np.append(run[1:], True)
    last = np.append(first[1:], True)
    space = kind == _SPACE
    tail = space & ends & ~last  # the last space before other characters: a piece of its own, or joined to them if it is a blank
    begin |= tail
    blank = np.flatnonzero(tail & (cp == 32))
    begin[blank + 1] = False
    quote = np.flatnonzero(run & begin & (cp == 39) & ~last)
    if len(quote):
        c1 = cp[quote + 1]
        second = np.minimum(quote + 2, n - 1)
        c2 = np.where((quote + 2 < n) & ~first[second], cp[second], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        quote, size = quote[one | two], np.where(one, 2, 3)[one | two]
        begin[quote + 1] = False
        after = quote + size
        after = after[after < n]
        begin[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(begin)


class _Cache:
    """Ids of pieces by hash, in a direct-mapped table: a piece that takes another's slot is encoded again when it returns."""

    def __init__(self):
        self.key, self.at, self.n = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int64), np.zeros(_SLOTS, np.int64)
        self.clear()

    def clear(self) -> None:
        self.key[:] = 0
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def add(self, pieces: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces' ids are from now on, and how many each has."""
        n = np.array([len(x) for x in pieces], np.int64)
        to = self.used + int(n.sum())
        if to > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(to, np.int32))
        self.ids[self.used : to] = np.fromiter(chain.from_iterable(pieces), np.int32, to - self.used)
        at = self.used + np.cumsum(n) - n
        self.used = to
        return at, n


def block_ids(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, equal to ``token_ids`` of each, and how many each has; null counts as empty."""
    texts = [t or "" for t in texts.to_pylist()]
    size = np.array([len(t) for t in texts], np.int64)
    text = "".join(texts)
    if not text:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes().take(cp)
    off = np.append(0, np.cumsum(size))
    if (kind == _UNSURE).any():
        ids = [token_ids(path, t) for t in texts]
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
    first = np.zeros(len(cp), bool)
    first[off[:-1][size > 0]] = True
    start = piece_starts(cp, kind, first)
    length = np.diff(np.append(start, len(cp)))
    place = np.arange(len(cp)) - np.repeat(start, length)
    value = cp.astype(np.uint64)
    value += np.uint64(1)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(29)
    value *= POWERS.take(place & (len(POWERS) - 1))
    h = mix(np.add.reduceat(value, start) ^ length.astype(np.uint64))
    h[h == 0] = 1
    core, cache = encoder(path)._core_bpe, _caches.setdefault(path, _Cache())
    if cache.used > 1 << 24:
        cache.clear()
    slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
    found = (cache.key.take(slot) == h) & (length <= _LONG)
    at, n = cache.at.take(slot), cache.n.take(slot)
    lost = np.flatnonzero(~found)
    if len(lost):
        long_ = length[lost] > _LONG
        _, pick, same = np.unique(np.where(long_, np.uint64(2**63) + lost.astype(np.uint64), h[lost] >> np.uint64(1)), return_index=True, return_inverse=True)
        pick = lost[pick]
        encode = core.encode_single_piece
        new_at, new_n = cache.add([encode(text[a:b].encode()) for a, b in zip(start[pick].tolist(), (start[pick] + length[pick]).tolist())])
        at[lost], n[lost] = new_at[same], new_n[same]
        keep = length[pick] <= _LONG
        s = slot[pick[keep]]
        cache.key[s], cache.at[s], cache.n[s] = h[pick[keep]], new_at[keep], new_n[keep]
    total = np.append(0, np.cumsum(n))
    place = np.repeat(at - total[:-1], n)
    place += np.arange(total[-1])
    return cache.ids.take(place), np.diff(total[np.searchsorted(start, off)])


def piece_lengths(n: np.ndarray, max_length: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' lengths for documents of ``n`` tokens in order, and the document each belongs to."""
    if max_length & (max_length - 1) or max_length < 1:
        raise ValueError("max_length must be a power of two")
    top = max_length.bit_length() - 1
    digits = np.column_stack([n >> top, *((n >> k) & 1 for k in range(top - 1, -1, -1))])
    doc, digit = np.nonzero(digits)
    times = digits[doc, digit]
    return np.repeat(1 << (top - digit), times), np.repeat(doc, times)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, max_length: int = MAX_LENGTH, batch_tokens: int = BATCH_TOKENS, end_of_text: int = END_OF_TEXT) -> DataFrame:
    """One row for each piece: (length, batch, doc_id, piece, first_token, tokens).

    All rows of a batch have the same length; the last batch of a bucket in a
    partition may hold fewer rows.  Joining a document's pieces in order of
    ``piece`` gives its ids back, ``end_of_text`` last.  A null or empty text
    has no pieces; a null ``doc_id`` is carried as it is, and a row that
    repeats another is packed again.  Very long texts are cut like all others.
    An empty table gives no rows.  Other columns are not read.
    """
    room = np.array([max(1, batch_tokens >> k) for k in range(max_length.bit_length())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        filled = np.zeros(len(room), np.int64)
        for batch in batches:
            for block in blocks(batch):
                ids, size = block_ids(tokenizer, block.column("text"))
                ids = np.insert(ids, np.cumsum(size)[size > 0], end_of_text)
                size += size > 0
                length, doc = piece_lengths(size, max_length)
                if not len(length):
                    continue
                kind = np.log2(length).astype(np.int64)
                order = np.argsort(kind, kind="stable")
                count = np.bincount(kind, minlength=len(room))
                rank = np.empty(len(kind), np.int64)
                rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(count) - count, count)
                batch_no = base | (((filled[kind] + rank) // room[kind]) << 6) | kind
                filled += count
                end = np.cumsum(length)
                pieces = np.bincount(doc, minlength=len(size))
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = (end - length) - (np.cumsum(size) - size)[doc]
                tokens = pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids))
                yield pa.record_batch(
                    [pa.array(length.astype(np.int32)), pa.array(batch_no), block.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(begin), tokens],
                    ["length", "batch", "doc_id", "piece", "first_token", "tokens"],
                )

    return only(docs, "doc_id", "text").where("text is not null and text <> ''").mapInArrow(cut, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
