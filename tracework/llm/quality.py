"""Quality classifier: an additive model with pairwise interactions (operator 10).

Each feature has a lookup table over its bins, and so have the strongest pairs
of features.  Boosting cycles over the tables: at each turn a shallow tree is
fitted to the present gradient on one feature's (or pair's) bins and added to
its table with a small rate.  Scoring is binning and adding up looked-up
values, vectorised.  The fit uses a bounded sample of labelled rows; all
documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import blocks, distinct, documents, only, utf8, words

#: Labelled rows that the fit uses at most, drawn by a hash of ``doc_id``.
TRAIN_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 60
PAIR_ROUNDS = 20
PAIRS = 6
RATE = 0.15
THRESHOLD = 0.5

FEATURES = ["log_bytes", "log_words", "word_length", "short_words", "upper", "digits", "symbols", "bangs", "bars", "non_ascii", "distinct_words", "repeats", "line_length", "same_line_starts"]

_IS = np.zeros((6, 256), bool)
_IS[0, 65:91] = True
_IS[1, 48:58] = True
_IS[2, [ord(c) for c in "#$%&*^~<>{}[]\\/_=+@|"]] = True
_IS[3, [ord("!")]] = True
_IS[4, [ord("|")]] = True
_IS[5, 128:] = True


def features(texts: pa.Array) -> np.ndarray:
    """[n, len(FEATURES)] for whole texts; all zero for a null or empty one."""
    data, off = utf8(texts, lower=False)
    size = np.diff(off)
    w = words(texts)
    n = np.diff(w.ptr)
    some, any_words = np.maximum(size, 1), np.maximum(n, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (c[off[1:]] - c[off[:-1]]) / some

    def per_word(values: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return (c[w.ptr[1:]] - c[w.ptr[:-1]]) / any_words

    doc, _ = distinct(w)
    lines = share(data == 10) * some + (size > 0)
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    # words that begin a line with the word that began the line before
    opens = np.zeros(len(w.hash), bool)
    if len(w.hash):
        breaks = np.concatenate(([0], np.cumsum(w.data == 10)))
        line = breaks[w.start]
        opens[0] = True
        opens[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(opens)
    same = np.zeros(len(texts))
    if len(first) > 1:
        hit = (w.hash[first[1:]] == w.hash[first[:-1]]) & (w.doc[first[1:]] == w.doc[first[:-1]])
        same = np.bincount(w.doc[first[1:]][hit], minlength=len(texts)) / np.maximum(lines, 1)
    return np.column_stack(
        [np.log1p(size), np.log1p(n), per_word(w.length), per_word(w.length <= 3), *(share(_IS[k][data]) for k in range(6)),
         np.bincount(doc, minlength=len(texts)) / any_words, per_word(again), np.log1p(size / np.maximum(lines, 1)), same]
    )


@dataclass
class Additive:
    """Bin edges, intercept and lookup tables; ``pairs`` maps two features to a table over their coarse bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality for each row."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for pair in self.pairs for f in pair}
        for (f, g), table in self.pairs.items():
            total += table[bins[f], bins[g]]
        return 1 / (1 + np.exp(-total))


def _cut(grad: np.ndarray, hess: np.ndarray) -> tuple[int, float]:
    """The best split point of a run of bins and its gain."""
    g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
    if not len(g):
        return 0, 0.0
    gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - grad.sum() ** 2 / (hess.sum() + 1)
    at = int(gain.argmax())
    return at + 1, float(gain[at])


def tree_1d(grad: np.ndarray, hess: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A shallow tree over ordered bins: the value of each bin's leaf."""
    cuts = [(0, len(grad))]
    while len(cuts) < leaves:
        options = [(_cut(grad[a:b], hess[a:b]), a, b) for a, b in cuts]
        (at, gain), a, b = max(options, key=lambda o: o[0][1])
        if gain <= 1e-9:
            break
        cuts.remove((a, b))
        cuts += [(a, a + at), (a + at, b)]
    value = np.zeros(len(grad))
    for a, b in cuts:
        value[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return value


def tree_2d(grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of depth two over a grid, first one axis, then the other on either side; values and gain."""
    best, values = 0.0, np.zeros_like(grad)
    for turn in (False, True):
        g, h = (grad.T, hess.T) if turn else (grad, hess)
        for at in range(1, len(g)):
            value, gain = np.zeros_like(g), -(g.sum() ** 2) / (h.sum() + 1)
            for side in (slice(0, at), slice(at, None)):
                gs, hs = g[side].sum(0), h[side].sum(0)
                cut, _ = _cut(gs, hs)
                for part in (slice(0, cut), slice(cut, None)):
                    gain += gs[part].sum() ** 2 / (hs[part].sum() + 1)
                    value[side, part] = gs[part].sum() / (hs[part].sum() + 1)
            if gain > best:
                best, values = gain, value.T if turn else value
    return values, best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of the main effects, then of the pairs with the largest first gain."""
    if len(y):
        edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
        coarse = [np.unique(np.quantile(x[:, f], np.arange(1, PAIR_BINS) / PAIR_BINS)) for f in range(x.shape[1])]
    else:
        edges = coarse = [np.zeros(0)] * len(FEATURES)
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Additive(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    total = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = gradient()
            step = RATE * tree_1d(np.bincount(b, g, len(edges[f]) + 1), np.bincount(b, h, len(edges[f]) + 1))
            model.tables[f] += step
            total += step[b]

    def grid(f: int, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[f]) + 1, len(coarse[g]) + 1
        cell = small[f] * shape[1] + small[g]
        grad, hess = gradient()
        return np.bincount(cell, grad, shape[0] * shape[1]).reshape(shape), np.bincount(cell, hess, shape[0] * shape[1]).reshape(shape), cell

    gains = sorted(((tree_2d(*grid(f, g)[:2])[1], f, g) for f, g in combinations(range(x.shape[1]), 2)), reverse=True)
    chosen = [(f, g) for gain, f, g in gains[:PAIRS] if gain > 0]
    model.pairs = {p: np.zeros((len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p in chosen:
            g, h, cell = grid(*p)
            step = RATE * tree_2d(g, h)[0]
            model.pairs[p] += step
            total += step.ravel()[cell]
    return model


def _columns() -> str:
    return ", ".join(f"{f} double" for f in FEATURES)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Additive:
    """The model fitted on at most ``train_rows`` labelled documents; a document with several labels counts with each."""
    labels = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    rows = only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column("quality").cast(pa.float64()), *(pa.array(c) for c in features(block.column("text")).T)], ["quality", *FEATURES])

    t = rows.mapInArrow(measure, f"quality double, {_columns()}").toArrow().to_pandas().sort_values(["quality", *FEATURES])
    return fit(t[FEATURES].to_numpy(float), (t["quality"].to_numpy() > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame, model: Additive | None = None) -> DataFrame:
    """(doc_id, score, good) for every row: the probability of good quality and whether it reaches ``THRESHOLD``.

    A null or empty text has all features zero, scores 0 and is not good.  Null
    and repeated ``doc_id`` are answered row by row.  Without labels, or with
    labels of one kind only, every text scores the same share.  An empty table
    gives no rows.  Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                x = features(block.column("text"))
                score = np.where(x[:, 0] > 0, held.value.score(x), 0.0)
                yield pa.record_batch([block.column("doc_id"), pa.array(score), pa.array(score >= THRESHOLD)], ["doc_id", "score", "good"])

    return only(docs, "doc_id", "text").mapInArrow(apply, "doc_id long, score double, good boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
