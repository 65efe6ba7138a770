"""Exact k nearest neighbours with an M-tree (operator 3).

Leaf pages hold up to ``PAGE`` vectors around a routing vector, with a covering
radius and each entry's distance to it; nodes hold ``FANOUT`` pages likewise.
A search keeps a heap of nodes and pages by the least distance at which they
could hold anything nearer, and ends when no open entry can beat the k-th
neighbour found.  Before any distance is computed the stored parent distances
are tried: by the triangle inequality an entry differs from its parent's
distance to the query by at least ``|d(query, parent) - d(entry, parent)|``.
Queries that lie near the same page search together, so that distances are
matrix products - in single precision, with a bound on its error, for what can
be told apart by it; what may be nearer is computed again by differences.

Every vector is a query.  The searched vectors are taken in waves of at most
``WAVE_BYTES``: each wave's tree is broadcast, and all queries go through it with
the neighbours and bounds they have from the waves before.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import saved
from .text import only

K = 10
PAGE = 256
FANOUT = 16
QUERIES = 512
WAVE_BYTES = 32 << 20
#: Slack on squared distances from matrix products; what passes is computed again by differences.
_SLACK = 1e-9
#: Values beyond which products are taken in double precision, and candidates that are merged at once.
_SINGLE = 1e15
_PENDING = 2048


@dataclass
class Tree:
    """Vectors in page order with ids and distances to the page's routing vector; page i is ``begin[i]:begin[i + 1]``."""

    x: np.ndarray
    ids: np.ndarray
    norm: np.ndarray
    to_page: np.ndarray
    begin: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    to_node: np.ndarray
    node_center: np.ndarray
    node_radius: np.ndarray

    def halves(self) -> tuple[np.ndarray, float]:
        """The vectors with half their squared norms beside them, in single precision where it holds them, and the largest norm; kept with the tree."""
        if not hasattr(self, "_halves"):
            top = float(np.abs(self.x).max(initial=0))
            self._halves = np.column_stack((self.x, self.norm / 2)).astype(np.float32 if top < _SINGLE else np.float64), float(np.sqrt(self.norm.max(initial=0)))
        return self._halves


def _spread(x: np.ndarray, index: np.ndarray) -> Iterator[np.ndarray]:
    """Pages of near vectors: halved again and again between two vectors far apart."""
    if len(index) <= PAGE:
        yield index
        return
    part = x[index]
    a = part[np.argmax(((part - part[0]) ** 2).sum(1))]
    b = part[np.argmax(((part - a) ** 2).sum(1))]
    side = np.argsort(part @ (b - a), kind="stable")
    half = len(index) // 2
    yield from _spread(x, index[side[:half]])
    yield from _spread(x, index[side[half:]])


def build(ids: np.ndarray, x: np.ndarray) -> Tree:
    order, begin, center, radius, to_page = [], [0], [], [], []
    for page in _spread(x, np.arange(len(x))) if len(x) else ():
        part = x[page]
        c = part[np.argmin(((part - part.mean(0)) ** 2).sum(1))]
        d = np.sqrt(((part - c) ** 2).sum(1))
        near = np.argsort(d, kind="stable")
        order.append(page[near])
        to_page.append(d[near])
        center.append(c)
        radius.append(d.max())
        begin.append(begin[-1] + len(page))
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    center, radius = np.array(center).reshape(-1, x.shape[1]), np.array(radius)
    to_node, node_center, node_radius = np.zeros(len(center)), [], []
    for at in range(0, len(center), FANOUT):
        part = center[at : at + FANOUT]
        c = part[np.argmin(((part - part.mean(0)) ** 2).sum(1))]
        d = np.sqrt(((part - c) ** 2).sum(1))
        to_node[at : at + FANOUT] = d
        node_center.append(c)
        node_radius.append((d + radius[at : at + FANOUT]).max())
    x = x[order]
    return Tree(x, ids[order], (x**2).sum(1), np.concatenate(to_page) if to_page else np.zeros(0), np.array(begin), center, radius, to_node, np.array(node_center).reshape(-1, center.shape[1]), np.array(node_radius))


def _distance(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (c**2).sum(1) - 2 * q @ c.T, 0))


def _merge(row: np.ndarray, dist: np.ndarray, ids: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> None:
    """Puts candidates into the sorted neighbour lists [queries, k]; ties by id."""
    rows, place = np.unique(row, return_inverse=True)
    k = best_d.shape[1]
    r = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
    d = np.concatenate([best_d[rows].ravel(), dist])
    i = np.concatenate([best_i[rows].ravel(), ids])
    order = np.lexsort((i, d, r))
    r, d, i = r[order], d[order], i[order]
    start = np.searchsorted(r, np.arange(len(rows)))
    take = start[:, None] + np.arange(k)
    best_d[rows], best_i[rows] = d[take], i[take]


def search(tree: Tree, qid: np.ndarray, q: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> int:
    """Best-first search for a block of queries, in place; how many distances were computed."""
    computed = 0
    if not len(tree.x):
        return computed
    norm = (q**2).sum(1)
    x, top = tree.halves()
    halves = np.column_stack((q, np.full(len(q), -1.0)))
    if x.dtype == np.float32 and np.abs(q).max(initial=0) < _SINGLE:
        halves = halves.astype(np.float32)
    elif x.dtype == np.float32:
        x = np.column_stack((tree.x, tree.norm / 2))
    # of q x - |x|^2 / 2 as computed: rounded factors, products and sums
    slack = (q.shape[1] + 8) * float(np.finfo(x.dtype).eps) * (np.sqrt(norm) * top + top**2 / 2 + norm) + 1e-30
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def merge() -> None:
        nonlocal waiting
        if pending:
            _merge(*(np.concatenate(c) for c in zip(*pending)), best_d, best_i)
            pending.clear()
            waiting = 0

    heap: list[tuple[float, int, int]] = []
    to_nodes = _distance(q, tree.node_center)
    computed += to_nodes.size
    for n in range(len(tree.node_center)):
        heap.append((float(np.maximum(to_nodes[:, n] - tree.node_radius[n], 0).min()), 0, n))
    heapq.heapify(heap)
    to_page = np.full((len(q), len(tree.center)), np.nan)
    while heap:
        bound, is_page, n = heapq.heappop(heap)
        if waiting > _PENDING or not is_page:
            merge()
        reach = best_d[:, -1]
        if bound > reach.max() + _SLACK:
            break
        if not is_page:
            pages = np.arange(n * FANOUT, min((n + 1) * FANOUT, len(tree.center)))
            # parent distances first: only the pages that some query can still need are measured
            least = np.abs(to_nodes[:, n, None] - tree.to_node[pages]) - tree.radius[pages]
            pages = pages[(least <= reach[:, None] + _SLACK).any(0)]
            to_page[:, pages] = _distance(q, tree.center[pages])
            computed += len(q) * len(pages)
            for p in pages:
                low = np.maximum(to_page[:, p] - tree.radius[p], 0)
                open_ = low <= reach + _SLACK
                if open_.any():
                    heapq.heappush(heap, (float(low[open_].min()), 1, int(p)))
            continue
        some = np.flatnonzero(to_page[:, n] - tree.radius[n] <= reach + _SLACK)
        if not len(some):
            continue
        d = to_page[some, n]
        b, e = tree.begin[n], tree.begin[n + 1]
        held = tree.to_page[b:e]
        low, high = np.searchsorted(held, (d - reach[some]).min() - _SLACK), np.searchsorted(held, (d + reach[some]).max() + _SLACK, side="right")
        if low >= high:
            continue
        b, e = b + low, b + high
        all_ = len(some) == len(q)
        near = (halves if all_ else halves[some]) @ x[b:e].T
        computed += near.size
        # |q - x|^2 <= reach^2, for every pair that it may hold of
        least = (norm[some] - reach[some] ** 2) / 2
        least = least - slack[some] - np.abs(least) * 1e-6
        k = best_d.shape[1]
        if e - b > k + 1 and np.isinf(reach).any():  # no bound yet: only k others of this page, and the query itself, can be the nearest of it
            top_k = np.partition(near, -(k + 1), axis=1)[:, -(k + 1)].astype(np.float64)
            least = np.maximum(least, top_k - 2 * slack[some] - np.abs(top_k) * 1e-6)
        least = least.astype(near.dtype)
        open_ = np.flatnonzero(near.max(1) >= least)
        r, c = np.nonzero(near[open_] >= least[open_, None])
        r = open_[r]
        own = tree.ids[b + c] == qid[some[r]]
        r, c = some[r[~own]], b + c[~own]
        if len(r):
            dist = np.sqrt(((q[r] - tree.x[c]) ** 2).sum(1))
            keep = (dist < best_d[r, -1]) | ((dist == best_d[r, -1]) & (tree.ids[c] < best_i[r, -1])) | (best_i[r, -1] == _NONE)
            if keep.any():
                pending.append((r[keep], dist[keep], tree.ids[c[keep]]))
                waiting += int(keep.sum())
    merge()
    return computed


_NONE = np.iinfo(np.int64).max


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def _one_size(vectors: DataFrame, dim: int, k: int, wave_bytes: int) -> DataFrame:
    spark = vectors.sparkSession
    n = vectors.count()
    waves = max(1, -(-n * dim * 8 // wave_bytes))
    state = vectors.withColumns({"d": F.array().cast("array<double>"), "i": F.array().cast("array<bigint>")})
    state = state.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    for wave in range(waves):
        t = vectors.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).toArrow().sort_by("id")
        column = t.column("v").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
        held = spark.sparkContext.broadcast(build(t.column("id").to_numpy(), _vectors(column, dim) if t.num_rows else np.zeros((0, dim))))

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tree = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q, qid = _vectors(batch.column("v"), dim), batch.column("id").to_numpy()
                d, i = np.full((len(q), k), np.inf), np.full((len(q), k), _NONE)
                old = np.asarray(pc.list_value_length(batch.column("i")))
                fill = np.arange(k) < old[:, None]
                d[fill], i[fill] = np.asarray(batch.column("d").flatten()), np.asarray(batch.column("i").flatten())
                home = np.concatenate([np.argmin(_distance(q[a : a + 1024], tree.center), axis=1) for a in range(0, len(q), 1024)]) if len(tree.center) else np.zeros(len(q))
                order = np.argsort(home, kind="stable")
                for a in range(0, len(order), QUERIES):
                    block = order[a : a + QUERIES]
                    bd, bi = d[block], i[block]
                    search(tree, qid[block], q[block], bd, bi)
                    d[block], i[block] = bd, bi
                found = i != _NONE
                off = pa.array(np.append(0, np.cumsum(found.sum(1))).astype(np.int32))
                yield pa.record_batch([batch.column("id"), batch.column("v"), pa.ListArray.from_arrays(off, pa.array(d[found])), pa.ListArray.from_arrays(off, pa.array(i[found]))], ["id", "v", "d", "i"])

        state = state.mapInArrow(look, "id long, v array<float>, d array<double>, i array<bigint>")
        if wave < waves - 1:
            state = saved(state)
    pairs = state.select("id", F.posexplode(F.arrays_zip("i", "d")).alias("at", "x"))
    return pairs.select(F.col("id").alias("vec_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.i").alias("neighbor_id"), F.col("x.d").alias("distance"))


def nearest(embeddings: DataFrame, k: int = K, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(vec_id, rank, neighbor_id, distance): the ``k`` nearest other vectors of each vector, Euclidean, ties by id.

    Rows whose id or vector is null, whose vector is empty or holds a null or a
    value that is not finite, are left out.  A ``vec_id`` on several rows counts
    with its least vector.  Vectors are compared with those of their own length
    only.  Where there are fewer than k others, all are given.  An empty table
    gives no rows.  Other columns are not read.
    """
    vectors = only(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    whole = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    vectors = saved(vectors.where("id is not null and v is not null and size(v) > 0").where(whole).groupBy("id").agg(F.min("v").alias("v")))
    sizes = [r[0] for r in vectors.select(F.size("v")).distinct().orderBy(F.size("v")).toLocalIterator()]
    out = None
    for dim in sizes:
        part = _one_size(vectors.where(F.size("v") == dim), dim, k, wave_bytes)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], "vec_id long, rank int, neighbor_id long, distance double")


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("distance", F.round("distance", 6))


ORACLE = f"""
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance
FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id,
  LATERAL (SELECT list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d)
)
WHERE rank <= {K}
"""
