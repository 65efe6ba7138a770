"""Language identification as a mixture (operator 6).

Each language is a distribution over byte trigrams, counted on a bounded sample
of labelled rows.  A document is a mixture: every word comes from one language
with that document's proportions, and has the product of its trigrams'
probabilities.  Expectation-maximisation estimates the proportions; a uniform
component, ``und``, stands for text of no known language.

The language set is chosen by penalised likelihood: among the sets of the k
largest proportions the one with the least
``-2 log L + penalty * (k - 1) * log(words)``.  Where even the full mixture
gains less over the best single language than one more language costs, that
language is the answer and no further fit is needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .text import Words, blocks, documents, only, words

TRAIN_DOCS = 500
BUCKETS = 1 << 16
SMOOTHING = 0.5
ITERATIONS = 12
PENALTY = 2.0
UNKNOWN = "und"
MAX_UNKNOWN = 0.5

SCHEMA = "doc_id long, lang string, share double, langs array<string>, shares array<double>, n_words int, accepted boolean"


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # [len(langs) + 1, BUCKETS], the last row is the unknown


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each byte of a word or at the byte after it, word by word, and where each word begins in that list."""
    n = w.length + 1
    begin = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(begin, n)
    place = np.repeat(w.start, n) + at
    data = np.append(w.data, 32).astype(np.int64)
    last = np.repeat(w.length, n)
    b0 = np.where(at == last, 32, data[place])
    b1 = np.where(at >= 1, data[place - 1], 32)
    b2 = np.where(at >= 2, data[place - 2], 32)
    return ((b0 * 40503) ^ (b1 * 10007) ^ (b2 * 31013 + (b2 << 9))) & (BUCKETS - 1), begin


def letters(w: Words) -> Words:
    """The words without a digit: numbers and codes tell no language."""
    if not len(w.hash):
        return w
    digit = np.concatenate(([0], np.cumsum((w.data >= 48) & (w.data <= 57))))
    keep = digit[w.start + w.length] == digit[w.start]
    doc = w.doc[keep]
    return Words(w.hash[keep], w.start[keep], w.length[keep], doc, np.searchsorted(doc, np.arange(len(w.ptr))), w.data)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for block in blocks(batch):
            w = letters(words(block.column("text")))
            if not len(w.hash):
                continue
            code, begin = trigrams(w)
            lang = np.array(block.column("lang").to_pylist(), dtype=object)[np.repeat(w.doc, np.diff(np.append(begin, len(code))))]
            for name in set(lang):
                total[name] = total.get(name, 0) + np.bincount(code[lang == name], minlength=BUCKETS)
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "code", "n"])


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Trigram counts of at most ``train_docs`` labelled rows of each language, drawn by a hash of ``doc_id``."""
    docs = only(docs, "doc_id", "text", "lang")
    draw = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = docs.where("lang is not null and doc_id is not null").select("doc_id", "lang").withColumn("r", F.row_number().over(draw)).where(F.col("r") <= train_docs)
    sample = docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").where("lang is not null and text is not null")
    rows = sample.select("text", "lang").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(rows["lang"].unique()) if len(rows) else []
    count = np.zeros((len(langs), BUCKETS))
    for i, name in enumerate(langs):
        own = rows[rows["lang"] == name]
        count[i, own["code"].to_numpy()] = own["n"].to_numpy()
    logp = np.log((count + SMOOTHING) / (count.sum(1, keepdims=True) + SMOOTHING * BUCKETS)) if langs else count
    return Model(langs, np.vstack([logp, np.full(BUCKETS, -np.log(BUCKETS))]).astype(np.float32))


def fit(p: np.ndarray, ptr: np.ndarray, allowed: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, np.ndarray]:
    """EM for each document: p[word, component] likelihoods (scaled), allowed[document, component]; proportions and log likelihood."""
    n = np.diff(ptr)
    pi = allowed / allowed.sum(1, keepdims=True)
    for _ in range(iterations):
        r = p * np.repeat(pi, n, axis=0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-30)
        pi = (np.add.reduceat(r, ptr[:-1], axis=0) / n[:, None]).astype(np.float32)
    mix = (p * np.repeat(pi, n, axis=0)).sum(1)
    return pi, np.add.reduceat(np.log(np.maximum(mix, 1e-30)), ptr[:-1], dtype=np.float64)


def mixtures(w: Words, model: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a block with words: its index, and the chosen set's proportions (0 outside the set)."""
    k = len(model.langs) + 1
    n = np.diff(w.ptr)
    full = np.flatnonzero(n)
    if not len(full):
        return full, np.zeros((0, k))
    code, begin = trigrams(w)
    score = np.stack([np.add.reduceat(row[code], begin) for row in model.logp], axis=1)
    score -= score.max(1, keepdims=True)
    p = np.exp(score)
    n = n[full]
    ptr = np.append(0, np.cumsum(n))
    pi, ll = fit(p, ptr, np.ones((len(full), k), np.float32))
    single = np.add.reduceat(np.maximum(score, -69.0), ptr[:-1], axis=0, dtype=np.float64)
    out = np.zeros_like(pi)
    best = single.argmax(1)
    out[np.arange(len(full)), best] = 1
    least = single[np.arange(len(full)), best]
    cost = penalty * np.log(np.maximum(n, 2))
    open_ = np.flatnonzero(2 * (ll - least) > cost)
    if not len(open_):
        return full, out
    rank = np.argsort(np.argsort(-pi[open_], axis=1, kind="stable"), axis=1)
    rows = np.repeat(np.isin(np.arange(len(full)), open_), n)
    own = np.append(0, np.cumsum(n[open_]))
    score_of = -2 * least[open_]
    for size in range(2, k + 1):
        allowed = (rank < size).astype(np.float32)
        part, got = fit(p[rows], own, allowed)
        value = -2 * got + (size - 1) * cost[open_]
        better = value < score_of
        out[open_[better]] = part[better]
        score_of = np.minimum(score_of, value)
    return full, out


def identify(docs: DataFrame, model: Model | None = None, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, lang, share, langs, shares, n_words, accepted) for every row, very long texts as a whole; an empty table gives no rows.

    ``langs`` is the chosen set by falling share (ties by name), ``lang`` and
    ``share`` its first member.  Words with a digit are left out.  A document is rejected
    if it has no other word (null, empty, numbers only) - then ``lang`` is ``und``, the share 0 and the set empty -
    or if ``und`` makes up more than half of it.  Null ``doc_id`` and repeated
    rows are answered row by row.  Without a labelled row all text is ``und``.
    Other columns are not read.
    """
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = [*model.langs, UNKNOWN]
        for batch in batches:
            for block in blocks(batch):
                w = letters(words(block.column("text")))
                full, pi = mixtures(w, model, penalty)
                langs = [[] for _ in range(block.num_rows)]
                shares = [[] for _ in range(block.num_rows)]
                for i, row in zip(full, pi):
                    top = sorted((-row[j], names[j]) for j in np.flatnonzero(row > 0))
                    langs[i], shares[i] = [x for _, x in top], [float(-x) for x, _ in top]
                unknown = np.zeros(block.num_rows)
                unknown[full] = pi[:, -1]
                n = np.diff(w.ptr)
                yield pa.record_batch(
                    [block.column("doc_id"), pa.array([x[0] if x else UNKNOWN for x in langs], pa.string()), pa.array([x[0] if x else 0.0 for x in shares], pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(n.astype(np.int32)), pa.array((n > 0) & (unknown <= MAX_UNKNOWN))],
                    ["doc_id", "lang", "share", "langs", "shares", "n_words", "accepted"],
                )

    return only(docs, "doc_id", "text").mapInArrow(answer, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows that ``identify`` accepts, with the columns they came with; the text is scored in place, without a join.

    Rows with a null or empty text, or with numbers only, go; a null ``doc_id``,
    repeated rows and very long texts are judged row by row as a whole, and extra
    columns pass through.  An empty table gives no rows.
    """
    model = model or train(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                w = letters(words(block.column("text")))
                full, pi = mixtures(w, held.value)
                ok = np.zeros(block.num_rows, bool)
                ok[full] = pi[:, -1] <= MAX_UNKNOWN
                yield block.filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
