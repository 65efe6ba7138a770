"""Toxicity scores from an induced lexicon (operator 7).

Seeds are the terms that the labels mark most strongly as toxic or as clean on
a bounded labelled sample, in which near copies count once.  Over the whole
corpus, the words found near toxic seeds more often than chance (positive
pointwise mutual information, of counts over all documents) become, with all
seeds, the nodes of a graph whose edges are the positive PMI of two nodes within
``window`` words.  No minimum depends on the size of the corpus.  That copies of
one passage don't make its words nodes, a word must be met in many contexts: each
toxic seed with the two words on either side of it sets one of 64 bits for the
words around it, and ``MIN_CONTEXTS`` bits must be set.  All counts are sums and
unions over occurrences, so that they don't depend on how the rows are cut.

One random walk restarts at the toxic seeds, one at the clean ones; the
difference of the two visiting frequencies over their sum, shrunk by the visits
that a seed usually has from the others, is a term's polarity.  A document scores
the polarity of its distinct terms above ``MIN_POLARITY``; the threshold is set on
the labelled sample.  The graph is walked on the driver up to ``DRIVER_EDGES`` edges;
a larger one stays a table, and each step sends the visits out and sums them up
by node, in whole units of ``_UNIT`` so that both ways agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .dedup import near_duplicates
from .storage import saved
from .text import Words, blocks, documents, mix, only, words

#: Labelled rows used for seeds and threshold at most, drawn by a hash of ``doc_id``.
TRAIN_ROWS = 20_000
#: What a seed needs: labelled documents that hold it, the root of its log likelihood ratio, and for a toxic one its share of toxic ones.
SEED_DOCS = 5
SEED_Z = 4.5
SEED_PRECISION = 0.6
CLEAN_Z = 3.0
WINDOW = 25
#: What a node needs: times near a toxic seed, bits set of 64 by the contexts (some 18 distinct ones), and PMI in bits.
MIN_NEAR = 20
MIN_CONTEXTS = 16
MIN_PMI = 3.0
#: Times that two nodes must stand together to be joined, and their PMI in bits.
MIN_EDGE = 3
MIN_EDGE_PMI = 1.0
RESTART = 0.3
STEPS = 30
#: Polarity is shrunk by this many times the visits that a seed usually has from the others, so that a rarely visited term has little.
SHRINK = 2.0
MIN_POLARITY = 0.4
#: Edges walked on the driver, and candidate words whose counts are broadcast; beyond either, the work stays in tables.
DRIVER_EDGES = 2_000_000
BROADCAST_WORDS = 2_000_000
_UNIT = 2.0**50


@dataclass
class Lexicon:
    """Terms with a polarity from -1 (clean) to 1 (toxic), sorted by hash, and the score from which a document is toxic."""

    hash: np.ndarray
    polarity: np.ndarray
    terms: list[str]
    threshold: float = 0.0

    def score(self, w: Words, n: int) -> np.ndarray:
        """The summed polarity of each text's distinct terms at or above ``MIN_POLARITY``."""
        strong = self.polarity >= MIN_POLARITY
        known, weight = self.hash[strong], self.polarity[strong]
        if not len(known) or not len(w.hash):
            return np.zeros(n)
        at = lookup(known, w.hash)
        ok = np.flatnonzero(at >= 0)
        key = np.unique(w.doc[ok] * len(known) + at[ok])
        return np.bincount(key // len(known), weight[key % len(known)], minlength=n).astype(float)  # of nothing, bincount gives integers


def lookup(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash among the sorted known ones, or -1; a bitmap turns most words away first."""
    out = np.full(len(h), -1, np.int64)
    if not len(known) or not len(h):
        return out
    bits = np.zeros(1 << 20, bool)
    low = np.uint64(bits.size - 1)
    bits[known & low] = True
    may = np.flatnonzero(bits[h & low])
    at = np.minimum(np.searchsorted(known, h[may]), len(known) - 1)
    out[may] = np.where(known[at] == h[may], at, -1)
    return out


def _labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic) of the sample."""
    labels = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    return only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).alias("toxic"))


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            w = words(block.column("text"))
            if not len(w.hash):
                continue
            key = np.stack([w.doc.astype(np.uint64), w.hash], axis=1)
            _, first = np.unique(key, axis=0, return_index=True)
            at = pa.array(w.doc[first])
            yield pa.record_batch([pa.array([w.string(i) for i in first], pa.string()), block.column("toxic").take(at), block.column("copy").take(at)], ["term", "toxic", "copy"])


def seeds(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Toxic and clean seed terms of a labelled sample (toxic, copy) by the signed root of their log likelihood ratio, copies left out; precision counts all rows."""
    n = {bool(r[0]): r[1] for r in sample.where("not copy").groupBy("toxic").count().toLocalIterator()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    if not n1 or not n0:
        return [], []
    own = {"a": "toxic and not copy", "b": "not toxic and not copy", "all_a": "toxic", "all_b": "not toxic"}
    counts = sample.mapInArrow(_label_counts, "term string, toxic boolean, copy boolean").groupBy("term").agg(*(F.count_if(F.expr(x)).alias(c) for c, x in own.items())).where(F.col("a") + F.col("b") >= SEED_DOCS)
    a, b, n = F.col("a"), F.col("b"), float(n1 + n0)

    def part(x, row, column):  # one cell of the table word x label: observed times log of observed over expected
        return F.when(x > 0, x * F.log(x * n / (row * column))).otherwise(0.0)

    has, lacks = a + b, n - a - b
    g = part(a, has, n1) + part(b, has, n0) + part(n1 - a, lacks, n1) + part(n0 - b, lacks, n0)
    z = F.signum(a * n0 - b * n1) * F.sqrt(F.greatest(2 * g, F.lit(0.0)))
    t = counts.select("term", z.alias("z"), ((F.col("all_a") + 0.5) / (F.col("all_a") + F.col("all_b") + 1)).alias("precision")).where(F.abs("z") >= 2.0).toArrow().to_pandas().sort_values(["z", "term"])
    up = t[(t["z"] >= SEED_Z) & (t["precision"] >= SEED_PRECISION)]
    down = t[t["z"] <= -CLEAN_Z]
    return sorted(up["term"]), sorted(down["term"])


def _contexts(w: Words, place: np.ndarray) -> np.ndarray:
    """A hash of the words at the places with the two words on either side of each, within its text."""
    h = np.zeros(len(place), np.uint64)
    for step in (-2, -1, 0, 1, 2):
        at = np.clip(place + step, 0, len(w.hash) - 1)
        h = mix(h ^ np.where(w.doc[at] == w.doc[place], w.hash[at], 0), step + 2)
    return h


def _near(seeds: np.ndarray, window: int):
    """Rows (h, near, contexts): how often a word stands near seeds, and the bits of the seeds' contexts; h = null has the sum over all words."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "near", "contexts"]
        mass = 0
        for batch in batches:
            for block in blocks(batch):
                w = words(block.column("text"))
                at = lookup(seeds, w.hash)
                hit = np.flatnonzero(at >= 0)
                if not len(hit):
                    continue
                bit = np.uint64(1) << (_contexts(w, hit) >> np.uint64(58))
                low, high = np.maximum(hit - window, w.ptr[w.doc[hit]]), np.minimum(hit + window + 1, w.ptr[w.doc[hit] + 1])
                size = high - low
                place = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                other = w.hash[place] != np.repeat(w.hash[hit], size)
                h, bits = w.hash[place[other]], np.repeat(bit, size)[other]
                if not len(h):
                    continue
                mass += len(h)
                order = np.argsort(h, kind="stable")
                begin = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
                yield pa.record_batch([pa.array(x) for x in (h[order][begin].view(np.int64), np.diff(np.append(begin, len(h))), np.bitwise_or.reduceat(bits[order], begin).view(np.int64))], names)
        yield pa.record_batch([pa.array([x], pa.int64()) for x in (None, mass, 0)], names)

    return near


def _occurrences(known: np.ndarray | None):
    """Rows (h, n): how often each known word, or else every word, occurs; h = null has the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, np.zeros(0 if known is None else len(known), np.int64)
        for batch in batches:
            for block in blocks(batch):
                h = words(block.column("text")).hash
                total += len(h)
                if known is not None:
                    at = lookup(known, h)
                    n += np.bincount(at[at >= 0], minlength=len(n))
                elif len(h):
                    u, times = np.unique(h, return_counts=True)
                    yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(times)], ["h", "n"])
        own = np.flatnonzero(n)
        yield pa.record_batch([pa.array([None, *(known[own].view(np.int64).tolist() if len(own) else ())], pa.int64()), pa.array(np.append(total, n[own]))], ["h", "n"])

    return count


def _edges(known: np.ndarray, window: int):
    """Rows (key, n, term): pairs of nodes a <= b within ``window`` words under a * v + b; under -1 - a a node's own count and spelling."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, single, spelled, kept, size = len(known), np.zeros(len(known), np.int64), {}, [], 0
        unseen = np.ones(v, bool)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = map(np.concatenate, zip(*kept))
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            return key[begin], np.add.reduceat(n[order], begin)

        for batch in batches:
            for block in blocks(batch):
                w = words(block.column("text"))
                at = lookup(known, w.hash)
                place = np.flatnonzero(at >= 0)
                node, doc = at[place], w.doc[place]
                single += np.bincount(node, minlength=v)
                new, first = np.unique(node[unseen[node]], return_index=True)
                for x, i in zip(new.tolist(), place[unseen[node]][first].tolist()):
                    spelled[x] = w.string(i)
                unseen[new] = False
                for k in range(1, window + 1):
                    ok = np.flatnonzero((doc[k:] == doc[:-k]) & (place[k:] - place[:-k] <= window)) if len(place) > k else np.zeros(0, np.int64)
                    if not len(ok):
                        break
                    a, b = node[ok], node[ok + k]
                    kept.append((np.minimum(a, b) * v + np.maximum(a, b), np.ones(len(a), np.int64)))
                    size += len(a)
                if size > 4_000_000:
                    kept = [merged()]
                    size = len(kept[0][0])
        if kept:
            key, n = merged()
            for i in range(0, len(key), 100_000):
                k = key[i : i + 100_000]
                yield pa.record_batch([pa.array(k), pa.array(n[i : i + 100_000]), pa.nulls(len(k), pa.string())], ["key", "n", "term"])
        x = np.flatnonzero(single)
        yield pa.record_batch([pa.array(-1 - x), pa.array(single[x]), pa.array([spelled[i] for i in x.tolist()], pa.string())], ["key", "n", "term"])

    return edges


def pushed(x: np.ndarray, a: np.ndarray, b: np.ndarray, go: np.ndarray, back: np.ndarray) -> np.ndarray:
    """What the columns of x [v, k] send along edges a - b, in whole units of 1 / ``_UNIT``."""
    v = len(x)
    return np.stack([np.rint((np.bincount(b, y[a] * go, v) + np.bincount(a, y[b] * back, v)) * _UNIT).astype(np.int64) for y in x.T], axis=1)


@dataclass
class Graph:
    """Edges (a, b, n) between nodes with their own counts ``single``: arrays, or a written table where they are many."""

    single: np.ndarray
    total: int
    window: int
    edges: object

    def over(self, f, names: tuple[str, ...]) -> list[np.ndarray]:
        """f(a, b, n) -> columns, added up by the first one (a node) over all edges."""
        if not isinstance(self.edges, DataFrame):
            return list(f(*self.edges))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = [[np.asarray(x.column(c)) for c in ("a", "b", "n")] for x in batches]
            if t:
                columns = f(*map(np.concatenate, zip(*t)))
                yield pa.record_batch([pa.array(c) for c in columns], list(names))

        schema = ", ".join(f"{c} long" for c in names)
        got = self.edges.mapInArrow(part, schema).groupBy(names[0]).agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
        return [got.column(c).to_numpy() for c in names]

    def walks(self, starts: np.ndarray, restart: float = RESTART, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
        """Visits [v, k] of walks that restart at the columns of ``starts``, and what a last step brings each node.

        A step's probability is the other word's share of the word's contexts, by how far it beats chance; contexts outside the graph keep the walk where it is.
        """
        v, single, total, window = len(self.single), self.single, self.total, self.window

        def flow(a, b, n):  # PMI in bits, and how much of a node's contexts the edge is, by how far it beats chance
            pmi = np.log2(n * total / (2.0 * window * single[a] * single[b]))
            return pmi, n * pmi / (2.0 * window)

        def sums(x, scale):
            def f(a, b, n):
                w = flow(a, b, n)[1]
                out = pushed(x, a, b, w / (single[a] * scale[a]), w / (single[b] * scale[b]))
                at = np.flatnonzero(out.any(1))
                return at, *out[at].T

            at, *columns = self.over(f, ("node", *(f"c{k}" for k in range(x.shape[1]))))
            out = np.zeros((v, x.shape[1]))
            out[at] = np.stack(columns, axis=1) / _UNIT
            return out

        def leaving(a, b, n):  # what a node sends, before it is scaled to one at most
            w = flow(a, b, n)[1]
            out = np.rint((np.bincount(a, w / single[a], v) + np.bincount(b, w / single[b], v)) * 2.0**32).astype(np.int64)
            at = np.flatnonzero(out)
            return at, out[at]

        def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                yield pa.record_batch([pa.array([flow(*(np.asarray(x.column(c)) for c in ("a", "b", "n")))[0].max(initial=0.0)])], ["top"])

        top = (self.edges.mapInArrow(strongest, "top double").agg(F.max("top")).first()[0] or 0) if isinstance(self.edges, DataFrame) else flow(*self.edges)[0].max(initial=0.0)
        top = max(float(top), 1.0)
        at, out = self.over(leaving, ("node", "out"))
        send = np.zeros(v)
        send[at] = out / 2.0**32 / top
        scale = np.maximum(send, 1.0)
        stay = 1 - send / scale
        p0 = starts / np.maximum(starts.sum(0), 1)
        x = p0
        for _ in range(steps):
            x = restart * p0 + (1 - restart) * (x * stay[:, None] + sums(x, scale * top))
        return x, sums(x, scale * top)


def graph(docs: DataFrame, nodes: np.ndarray, window: int = WINDOW, total: int | None = None, driver_edges: int = DRIVER_EDGES) -> tuple[Graph, list[str]]:
    """The positive PMI graph of the nodes (sorted hashes) over all documents, and their spellings."""
    v = len(nodes)
    rows = saved(docs.mapInArrow(_edges(nodes, window), "key long, n long, term string").groupBy("key").agg(F.sum("n").alias("n"), F.min("term").alias("term")).where(f"key < 0 or n >= {MIN_EDGE}"))
    own = rows.where("key < 0").toArrow()
    single, terms = np.ones(v, np.int64), [""] * v
    at = -1 - own.column("key").to_numpy()
    single[at] = own.column("n").to_numpy()
    for i, t in zip(at.tolist(), own.column("term").to_pylist()):
        terms[i] = t
    if total is None:
        total = docs.mapInArrow(_occurrences(np.zeros(0, np.uint64)), "h long, n long").agg(F.sum("n")).first()[0] or 0
    held = docs.sparkSession.sparkContext.broadcast(single)
    least = 2.0**MIN_EDGE_PMI * 2.0 * window / max(total, 1)

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, n = np.asarray(batch.column("key")), np.asarray(batch.column("n"))
            a, b = key // v, key % v
            ok = np.flatnonzero((a != b) & (n >= least * held.value[a] * held.value[b]))
            yield pa.record_batch([pa.array(x[ok]) for x in (a, b, n)], ["a", "b", "n"])

    edges = saved(rows.where("key >= 0").mapInArrow(strong, "a long, b long, n long"))
    if edges.count() > driver_edges:
        return Graph(single, total, window, edges), terms
    t = edges.orderBy("a", "b").toArrow()
    return Graph(single, total, window, tuple(t.column(c).to_numpy() for c in ("a", "b", "n"))), terms


def polarities(g: Graph, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Polarity of each node from the walks of the toxic and the clean seeds (places of nodes)."""
    starts = np.zeros((len(g.single), 2))
    starts[toxic, 0] = 1
    starts[clean, 1] = 1
    visits, came = g.walks(starts)
    t, c = visits.T
    usual = np.median(came[toxic, 0]) * (1 - RESTART) / RESTART  # what a toxic term gets from the others
    return (t - c) / (t + c + SHRINK * usual + 1e-30)


def induce(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, window: int = WINDOW, driver_edges: int = DRIVER_EDGES, broadcast_words: int = BROADCAST_WORDS) -> Lexicon:
    """The lexicon of a corpus; empty if the labels mark nothing."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    sample = saved(_labelled(docs, labels, train_rows))
    copies = near_duplicates(sample).select(F.col("doc_id").alias("_copy"))  # ids of the sample; else the words of a copied text would look like seeds
    sample = sample.join(F.broadcast(copies), sample["doc_id"] == copies["_copy"], "left").select("text", "toxic", F.col("_copy").isNotNull().alias("copy"))
    toxic, clean = seeds(sample)
    if not toxic:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), [], np.inf)
    up, down = (np.unique(words(pa.array(x, pa.string())).hash) for x in (toxic, clean))
    near = saved(docs.mapInArrow(_near(up, window), "h long, near long, contexts long").groupBy("h").agg(F.sum("near").alias("near"), F.bit_or("contexts").alias("contexts")))
    mass = near.where("h is null").first()["near"]
    met = near.where(F.col("h").isNotNull() & (F.col("near") >= MIN_NEAR) & (F.bit_count("contexts") >= MIN_CONTEXTS))
    known = None
    if met.count() <= broadcast_words:
        known = np.sort(met.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    counts = saved(docs.mapInArrow(_occurrences(known), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.where("h is null").first()["n"]
    chance = 2.0**MIN_PMI * mass / max(total, 1)
    chosen = met.join(counts, "h").where(F.col("near") >= chance * F.col("n")).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    nodes = np.unique(np.concatenate([up, down, chosen]))
    g, terms = graph(docs, nodes, window, total, driver_edges)
    return Lexicon(nodes, polarities(g, np.searchsorted(nodes, up), np.searchsorted(nodes, down)), terms)


def calibrated(lexicon: Lexicon, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Lexicon:
    """The lexicon with the threshold that gives the labelled sample the best F1; of equal ones the middle between two scores."""
    rows = _labelled(only(docs, "doc_id", "text"), labels, train_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.record_batch([pa.array(lexicon.score(words(block.column("text")), block.num_rows)), block.column("toxic")], ["score", "toxic"])

    t = rows.mapInArrow(scored, "score double, toxic boolean").toArrow().to_pandas().sort_values("score", ascending=False)
    score, y = t["score"].to_numpy(), t["toxic"].to_numpy(bool)
    last = np.flatnonzero(np.append(score[1:] != score[:-1], True)) if len(score) else []
    best, lexicon.threshold = -1.0, np.inf
    for i in last:
        if score[i] <= 0:
            break
        f1 = 2 * y[: i + 1].sum() / (i + 1 + y.sum())
        if f1 > best:
            best, lexicon.threshold = f1, float((score[i] + (score[i + 1] if i + 1 < len(score) else 0.0)) / 2)
    return lexicon


def score(docs: DataFrame, labels: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, score, toxic) for every row.

    A text without a lexicon term - also a null or empty one - scores 0 and is not
    toxic; equal texts score alike, and very long ones are read whole.  Null and
    repeated ``doc_id`` are answered row by row.  Without labels
    of both kinds, or without a term that they mark, all scores are 0.  An empty
    table gives no rows.  Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon or calibrated(induce(docs, labels), docs, labels))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                s = held.value.score(words(block.column("text")), block.num_rows)
                yield pa.record_batch([block.column("doc_id"), pa.array(s), pa.array((s > 0) & (s >= held.value.threshold))], ["doc_id", "score", "toxic"])

    return only(docs, "doc_id", "text").mapInArrow(apply, "doc_id long, score double, toxic boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
