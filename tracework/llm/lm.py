"""Language-model scoring with causal self-attention, trained in numpy (operator 4).

Texts become subword ids of a public tokenizer, kept once in the shared folder.
Counts of all ids over all documents give the vocabulary and a Huffman tree; the
model predicts an id as the path of binary decisions to its leaf, so that a
probability is normalised without a pass over the vocabulary.

The model is one attention layer over a window of ``WINDOW`` ids: embeddings and
positions, queries, keys and values, a causal mask, a residual, and a vector and
bias for each inner node.  Training takes every id of every document as a target
once: each file of ids is cut into windows side by side where it lies, and
nothing is shuffled but parameters.  A round gives one file to each core; all of
its workers take Adam steps from the same start, and the mean of their
parameters, weighted by their windows, starts the next round on new files, so
that steps grow with the input.  Only a corpus too small for ``MIN_STEPS`` steps
is gone through again until there are as many.

Scoring covers a document with windows that overlap by ``OVERLAP`` ids.  An id is
scored once, in the first window that holds it; all windows of a block go
through one batched masked attention.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import TOKENIZER, block_ids, encoder
from .storage import saved
from .text import blocks, documents, only

WIDTH = 16
WINDOW = 32
OVERLAP = 8
BATCH = 256
MIN_STEPS = 300
RATE = 0.01
#: Nodes next to the root that scoring computes for all states by one product; deeper ones only where a path needs them.
BUSY_NODES = 64
#: Windows that one pass of the batched attention holds, in scoring and within a batch of training, which asks for more arrays.
SCORE_BATCH = 128
PASS = 128
#: States whose paths are walked together in training, those of words that are near in the tree.
TILE = 512
#: Parameters that one row carries, and the unit in which workers' parameters are summed as integers, so that no order of summing shows.
_PART = 1 << 14
_UNIT = 1 << 20

SCHEMA = "doc_id long, n_tokens int, log_loss double, perplexity double"


@dataclass
class Tree:
    """Huffman paths: inner nodes and turns (+1, -1) of word w at ``ptr[w]:ptr[w + 1]``, from the leaf to the root, those below the busy ones before ``cut[w]``; ``word`` maps a subword id to w, ``rank`` w to its leaf's place from one side of the tree to the other, and ``ranked`` back."""

    word: np.ndarray
    ptr: np.ndarray
    cut: np.ndarray
    node: np.ndarray
    turn: np.ndarray
    bias: np.ndarray
    rank: np.ndarray
    ranked: np.ndarray


def huffman(ids: np.ndarray, count: np.ndarray, size: int = 0) -> Tree:
    """The tree of the ids with their counts; ids without a count, of ``size`` in all, share the path of the rarest."""
    order = np.argsort(ids)
    ids, count = ids[order], count[order]
    v = len(ids)
    word = np.full(max(size, int(ids[-1]) + 1 if v else 0), int(np.argmin(count)) if v else 0, np.int64)
    word[ids] = np.arange(v)
    heap = [(int(c), i) for i, c in enumerate(count)]
    heapq.heapify(heap)
    parent, side, total, right = np.zeros(2 * v, np.int64), np.zeros(2 * v), np.zeros(2 * v), np.zeros(2 * v)
    top, kids = v, []
    while len(heap) > 1:
        (c1, a), (c2, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], side[a], parent[b], side[b] = top, 1, top, -1
        total[top], right[top] = c1 + c2, c1
        kids.append((a, b))
        heapq.heappush(heap, (c1 + c2, top))
        top += 1
    ptr, node, turn = [0], [], []
    for i in range(v):
        at = i
        while at != top - 1:
            node.append(parent[at] - v)
            turn.append(side[at])
            at = parent[at]
        ptr.append(len(node))
    share = ((right[v:top] + 0.5) / (total[v:top] + 1))[::-1]
    node = top - v - 1 - np.array(node, np.int64)  # the busiest nodes, those near the root, first
    ptr = np.array(ptr)
    deep = np.concatenate(([0], np.cumsum(node >= BUSY_NODES)))
    ranked, ahead = [], [top - 1] if v else []
    while ahead:
        at = ahead.pop()
        ahead += kids[at - v] if at >= v else ()
        ranked += (at,) if at < v else ()
    ranked = np.array(ranked, np.int64)
    return Tree(word, ptr, ptr[:-1] + np.diff(deep[ptr]), node, np.array(turn, np.float32), np.log(share / (1 - share)).astype(np.float32), np.argsort(ranked), ranked)


def _order(key: np.ndarray, size: int) -> np.ndarray:
    """The order that sorts keys below ``size``."""
    return np.argsort(key.astype(np.uint16 if size <= 1 << 16 else np.int64), kind="stable")


def _add_at(out: np.ndarray, key: np.ndarray, values: np.ndarray) -> None:
    """``out[key] += values``, of equal keys all."""
    order = _order(key, len(out))
    key = key.take(order)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    out[key.take(first)] += np.add.reduceat(values.take(order, axis=0), first, axis=0)


def _path(y: np.ndarray, begin: np.ndarray, end: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, node and turn of each step ``begin[y]:end[y]`` of the words' paths."""
    low = begin.take(y)
    n = end.take(y) - low
    place = np.repeat(low - (np.cumsum(n) - n), n)
    place += np.arange(len(place))
    return np.repeat(np.arange(len(y)), n), tree.node.take(place), tree.turn.take(place)


class Model:
    """Parameters as views of one flat vector, so that workers' results average as vectors."""

    def __init__(self, vocabulary: int, width: int = WIDTH, window: int = WINDOW, flat: np.ndarray | None = None):
        self.v, self.d, self.t = vocabulary, width, window
        inner = max(vocabulary - 1, 1)
        shapes = {"e": (vocabulary + 1, width), "p": (window, width), "a": (width, 3 * width), "o": (width, width), "n": (inner, width), "b": (inner,)}
        size = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(size, np.float32) if flat is None else flat.astype(np.float32)
        self.part, at = {}, 0
        for name, shape in shapes.items():
            n = int(np.prod(shape))
            self.part[name] = self.flat[at : at + n].reshape(shape)
            at += n

    @classmethod
    def start(cls, tree: Tree, width: int = WIDTH, window: int = WINDOW) -> Model:
        """Small random weights; the nodes' biases give every id its corpus frequency."""
        m = cls(len(tree.ptr) - 1, width, window)
        rng = np.random.default_rng(7)
        for name in "epao":
            m.part[name][:] = rng.normal(0, 0.3 if name in "ao" else 0.1, m.part[name].shape)
        m.part["b"][: len(tree.bias)] = tree.bias
        return m

    def hidden(self, x: np.ndarray, start: int = 0) -> tuple[np.ndarray, tuple]:
        """States [B, T - start, d] from ``start`` on for inputs [B, T] under a causal mask, and what the gradient needs."""
        w, d = self.part, self.d
        t = x.shape[1]
        h0 = w["e"].take(x, axis=0)
        h0 += w["p"][:t]
        s = np.repeat(np.array([d**-0.25, d**-0.25, 1], w["a"].dtype), d)  # queries and keys share the scale of their product
        qku = (h0.reshape(-1, d) @ (w["a"] * s)).reshape(-1, t, 3 * d)
        q, k, u = qku[:, start:, :d], qku[..., d : 2 * d], qku[..., 2 * d :]
        e = q @ k.transpose(0, 2, 1)
        np.clip(e, -60, 60, out=e)  # far from what a float holds, so no maximum has to be taken off
        np.exp(e, out=e)
        e *= np.tri(t, dtype=np.float32)[start:]
        r = 1 / (e @ np.ones((t, 1), e.dtype))
        c = e @ u
        c *= r
        h = c @ w["o"]
        h += h0[:, start:]
        return h, (h0, q, k, u, e, r, c, s)

    def _turns(self, h: np.ndarray, y: np.ndarray, tree: Tree) -> list[tuple]:
        """(row, node, turn, score against the turn) of the paths' steps, below the busy nodes and at them."""
        n, b = self.part["n"], self.part["b"]
        row, node, turn = _path(y, tree.ptr, tree.cut, tree)
        z = np.einsum("ij,ij->i", h.take(row, axis=0), n.take(node, axis=0))
        z += b.take(node)
        z *= -turn
        busy = min(BUSY_NODES, len(b))
        row2, node2, turn2 = _path(y, tree.cut, tree.ptr[1:], tree)
        dense = h @ n[:busy].T
        dense += b[:busy]
        z2 = dense.ravel().take(row2 * busy + node2)
        z2 *= -turn2
        return [(row, node, turn, z), (row2, node2, turn2, z2)]

    def losses(self, h: np.ndarray, y: np.ndarray, tree: Tree) -> np.ndarray:
        """-log p of each word y given its state h."""
        out = np.zeros(len(y))
        for row, _, _, z in self._turns(h, y, tree):
            np.minimum(z, 80, out=z)
            np.exp(z, out=z)
            out += np.bincount(row, np.log(z + 1), len(y))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, ok: np.ndarray, tree: Tree, into: Model | None = None) -> Model:
        """Gradient of the mean loss over the positions ``ok`` of windows x [B, T] with targets y [B, T], in the model ``into`` if one is given."""
        full = into or Model(self.v, self.d, self.t)
        full.flat.fill(0)
        w, g, d = self.part, full.part, self.d
        passes = [(slice(at, at + PASS), *self.hidden(x[at : at + PASS])) for at in range(0, len(x), PASS)]
        h = np.concatenate([h.reshape(-1, d) for _, h, _ in passes])
        place = np.flatnonzero(ok)
        rank = tree.rank.take(y.ravel().take(place))
        order = _order(rank, self.v)
        place = place.take(order)
        dh = np.zeros((*x.shape, d), h.dtype)
        dh.reshape(-1, d)[place] = self._paths_gradient(g, h.take(place, axis=0), tree.ranked.take(rank.take(order)), tree)
        dx = np.empty_like(dh)
        for at, h, (h0, q, k, u, e, r, c, s) in passes:
            own = np.empty((*h.shape[:2], 3 * d), h.dtype)
            g["o"] += c.reshape(-1, d).T @ dh[at].reshape(-1, d)
            dc = (dh[at].reshape(-1, d) @ w["o"].T).reshape(h.shape)
            dc *= r
            ds = dc @ u.transpose(0, 2, 1)
            ds -= np.einsum("btd,btd->bt", dc, c)[..., None]  # the mean under the weights
            ds *= e
            np.matmul(ds, k, out=own[..., :d])
            np.matmul(ds.transpose(0, 2, 1), q, out=own[..., d : 2 * d])
            np.matmul(e.transpose(0, 2, 1), dc, out=own[..., 2 * d :])
            own = own.reshape(-1, 3 * d)
            g["a"] += h0.reshape(-1, d).T @ own * s
            np.matmul(own, (w["a"] * s).T, out=dx[at].reshape(-1, d))
        dx += dh
        _add_at(g["e"], x.ravel(), dx.reshape(-1, d))
        g["p"][: x.shape[1]] += dx.sum(0)
        full.flat *= np.float32(1 / max(1, len(place)))
        return full

    def _paths_gradient(self, g: dict[str, np.ndarray], rows: np.ndarray, y: np.ndarray, tree: Tree) -> np.ndarray:
        """Gradient of the summed loss by the states ``rows`` with words y, in order of the tree's leaves; what the nodes get is added to ``g``.

        The paths of near leaves share nodes, so that products of a tile's states with its few nodes take little more than the steps themselves.
        """
        n, b = self.part["n"], self.part["b"]
        back = np.empty_like(rows)
        row, node, turn = _path(y, tree.ptr, tree.ptr[1:], tree)
        bias = b.take(node)
        cut = np.searchsorted(row, np.arange(0, len(rows) + TILE, TILE))
        met, local = np.zeros(len(b), bool), np.zeros(len(b), np.int64)
        dz = np.empty(len(row), rows.dtype)
        for at, (low, high) in zip(range(0, len(rows), TILE), zip(cut, cut[1:])):
            here, own, t = rows[at : at + TILE], node[low:high], turn[low:high]
            met[own] = True
            used = np.flatnonzero(met)
            met[used] = False
            local[used] = np.arange(len(used))
            vectors = n.take(used, axis=0)
            dense = here @ vectors.T
            place = row[low:high] - at
            place *= len(used)
            place += local.take(own)
            z = dense.ravel().take(place)
            z += bias[low:high]
            z *= t
            np.minimum(z, 80, out=z)
            np.exp(z, out=z)
            np.subtract(-1, z, out=z)
            np.divide(t, z, out=dz[low:high])
            dense.fill(0)
            dense.ravel()[place] = dz[low:high]
            g["n"][used] += (here.T @ dense).T
            np.matmul(dense, vectors, out=back[at : at + TILE])
        g["b"] += np.bincount(node, dz, len(b))
        return back


class Adam:
    """Adam over a model's flat vector; the moments are kept from step to step."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate, self.steps = model, rate, 0
        self.m, self.s, self.work = (np.zeros_like(model.flat) for _ in range(3))
        self.gradient = Model(model.v, model.d, model.t)

    def step(self, x: np.ndarray, y: np.ndarray, ok: np.ndarray, tree: Tree) -> None:
        self.steps += 1
        flat = self.model.gradient(x, y, ok, tree, self.gradient).flat
        for at in range(0, len(flat), _PART):  # in a core's cache
            g, m, s, work, own = (v[at : at + _PART] for v in (flat, self.m, self.s, self.work, self.model.flat))
            m *= 0.9
            m += np.multiply(g, 0.1, out=work)
            s *= 0.98
            g *= g
            s += np.multiply(g, 0.02, out=work)
            np.sqrt(np.multiply(s, 1 / (1 - 0.98**self.steps), out=work), out=work)
            work += 1e-8
            np.divide(m, work, out=work)
            work *= self.rate / (1 - 0.9**self.steps)
            own -= work


def windows(size: np.ndarray, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Document and first id of each window; the k-th begins at k * (window - overlap)."""
    stride = window - overlap
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - window) // stride)), 0)
    doc = np.repeat(np.arange(len(size)), n)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * stride


def laid_out(words: np.ndarray, size: np.ndarray, doc: np.ndarray, first: np.ndarray, begin_id: int, window: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and the positions to score for windows of a block's words: the input at a position is the word before it."""
    base = (np.cumsum(size) - size)[doc]
    place = first[:, None] + np.arange(window)
    inside = place < size[doc][:, None]
    at = np.where(inside, base[:, None] + place, 0)
    y = words[at]
    x = np.where(place > 0, words[np.maximum(at - 1, 0)], begin_id)
    new = (first[:, None] == 0) | (np.arange(window) >= overlap)
    return np.where(inside, x, begin_id), y, inside & new


def id_type(tokenizer: str) -> type:
    """The least type that holds the tokenizer's ids."""
    return np.uint16 if encoder(tokenizer).max_token_value < 1 << 16 else np.uint32


def _tokenised(tokenizer: str, kind: type):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                ids, size = block_ids(tokenizer, block.column("text"))
                raw = pa.py_buffer(ids.astype(kind).tobytes())
                off = pa.py_buffer(np.append(0, np.cumsum(size) * np.dtype(kind).itemsize).astype(np.int32).tobytes())
                yield pa.record_batch([block.column("doc_id"), pa.Array.from_buffers(pa.binary(), len(size), [None, off, raw])], ["doc_id", "ids"])

    return tokenise


def _ids(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column in a row, and how many each text has."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    ids = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].view(kind) if raw is not None and off[-1] > off[0] else np.zeros(0, kind)
    return ids, np.diff(off).astype(np.int64) // np.dtype(kind).itemsize


def _token_blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from blocks(batch, "ids", 1 << 19)


def _counted(kind: type, size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for block in _token_blocks(batch):
                total += np.bincount(_ids(block.column("ids"), kind)[0], minlength=size)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])

    return count


def _work(held, kind: type, rate: float, passes: int):
    """Trains on the ids of a partition from the parameters held: rows (part, windows, sums) of ``_PART`` parameters times the windows, in units of 1 / ``_UNIT``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, flat = held.value
        model = Model(len(tree.ptr) - 1, flat=flat.copy())
        adam, n = Adam(model, rate), 0
        for batch in batches:
            for k, block in enumerate(b for b in _token_blocks(batch) for _ in range(passes)):
                ids, size = _ids(block.column("ids"), kind)
                x, y, ok = laid_out(tree.word.take(ids), size, *windows(size, overlap=0), len(tree.ptr) - 1, overlap=0)
                order = np.random.default_rng(n + k).permutation(len(x))  # a batch mixes documents
                n += len(x)
                for at in range(0, len(order), BATCH):
                    some = order[at : at + BATCH]
                    adam.step(x[some], y[some], ok[some], tree)
        if n:
            sums = np.rint(model.flat.astype(np.float64) * (n * _UNIT)).astype(np.int64)
            at = range(0, len(sums), _PART)
            yield pa.record_batch([pa.array(np.arange(len(at), dtype=np.int32)), pa.array([n] * len(at)), pa.array([sums[i : i + _PART].tobytes() for i in at], pa.binary())], ["part", "windows", "sums"])

    return work


PARTS = "part int, windows long, sums binary"


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PARTS`` added up by part as they come: a partition holds one row a part, however many workers there are."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for part, n, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "windows", "sums"))):
            n0, sums0 = total.get(part, (0, 0))
            total[part] = n0 + n, sums0 + np.frombuffer(sums, np.int64)
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([s.tobytes() for _, s in total.values()], pa.binary())], ["part", "windows", "sums"])


def mean_of(rows: DataFrame, parts: int) -> np.ndarray | None:
    """The parameters' mean over workers, weighted by windows."""
    done = sorted(zip(*rows.repartition(min(parts, rows.sparkSession.sparkContext.defaultParallelism), "part").mapInArrow(added, PARTS).toArrow().to_pydict().values()))
    return np.concatenate([np.frombuffer(s, np.int64) / (n * _UNIT) for _, n, s in done]).astype(np.float32) if done else None


def fitted(tokens: DataFrame, kind: type = np.uint16, size: int = 1 << 16, min_steps: int = MIN_STEPS, workers: int | None = None) -> tuple[Tree, Model]:
    """The tree over all ids of the corpus and the model trained on all of them; ``tokens`` is a written table, each of whose files has one worker."""
    spark = tokens.sparkSession
    counts = tokens.mapInArrow(_counted(kind, size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    tree = huffman(counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64), size)
    model = Model.start(tree)
    if len(counts) < 2:
        return tree, model
    files = sorted(tokens.inputFiles())
    workers = workers or spark.sparkContext.defaultParallelism
    rounds = [files[i : i + workers] for i in range(0, len(files), workers)]
    steps = int(counts["n"].sum()) // (WINDOW * BATCH) * len(rounds) // len(files)  # of one worker after another
    for i in range(len(rounds)):
        held = spark.sparkContext.broadcast((tree, model.flat))
        rows = spark.read.schema(tokens.schema).parquet(*rounds[i]).select("ids").mapInArrow(_work(held, kind, RATE / (1 + i) ** 0.5, max(1, min_steps // max(steps, 1))), PARTS)
        flat = mean_of(rows, -(-len(model.flat) // _PART))
        held.unpersist()
        if flat is not None:
            model = Model(len(tree.ptr) - 1, flat=flat)
    return tree, model


def document_losses(ids: np.ndarray, size: np.ndarray, tree: Tree, model: Model) -> np.ndarray:
    """Summed -log p of each document of a block."""
    out = np.zeros(len(size))
    if not len(tree.ptr) > 1:
        return out
    words = tree.word.take(ids)
    doc, first = windows(size)
    for start, some in (0, np.flatnonzero(first == 0)), (OVERLAP, np.flatnonzero(first)):  # the ids of the overlap are scored in the window before
        for at in range(0, len(some), SCORE_BATCH):
            d, f = doc.take(some[at : at + SCORE_BATCH]), first.take(some[at : at + SCORE_BATCH])
            x, y, ok = laid_out(words, size, d, f, len(tree.ptr) - 1)
            ok = ok[:, start:]
            loss = model.losses(model.hidden(x, start)[0][ok], y[:, start:][ok], tree)
            out += np.bincount(np.broadcast_to(d[:, None], ok.shape)[ok], loss, minlength=len(size))
    return out


def score(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, log_loss, perplexity) for every row: the summed loss in nats, and exp of its mean.

    A null or empty text has no ids, loss 0 and a null perplexity.  Null and
    repeated ``doc_id`` are answered row by row; equal texts have equal losses.
    Whole texts are scored however long.  An empty table gives no rows.  Other
    columns are not read.
    """
    kind = id_type(tokenizer)
    tokens = saved(only(docs, "doc_id", "text").mapInArrow(_tokenised(tokenizer, kind), "doc_id long, ids binary"))
    held = docs.sparkSession.sparkContext.broadcast(fitted(tokens, kind, encoder(tokenizer).max_token_value + 1))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, model = held.value
        for batch in batches:
            for block in _token_blocks(batch):
                ids, size = _ids(block.column("ids"), kind)
                loss = document_losses(ids, size, tree, model)
                ppl = pa.array(np.exp(np.minimum(loss / np.maximum(size, 1), 700)), mask=size == 0)
                yield pa.record_batch([block.column("doc_id"), pa.array(size.astype(np.int32)), pa.array(loss), ppl], ["doc_id", "n_tokens", "log_loss", "perplexity"])

    return tokens.mapInArrow(apply, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
