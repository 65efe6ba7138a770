"""SimHash near-duplicates found with BK-trees (operator 2).

Every text gets a 128-bit SimHash over its distinct words.  Two documents are
near copies if their fingerprints differ in at most ``radius`` bits; groups are
the connected components of that relation and the least ``doc_id`` stays.

Search.  A table samples ``key_bits`` random bits, which cut the distinct
fingerprints into shards; two fingerprints that differ in d bits share a shard
of one table with probability ``(1 - d / 128) ** key_bits``.  The key is as wide as
the number of fingerprints asks for, so that shards hold some ``SHARD`` of them at
every size, and there are as many tables as give a pair at the radius itself the
chance ``RECALL``: nearer pairs meet more often, and groups also join through
their other members.

Each shard is a BK-tree: an item hangs under its parent at the edge of their
integer Hamming distance, one child an edge.  Every fingerprint is a query of its
shard in every table and follows only the edges within ``radius`` of its own
distance to the node; nothing caps a shard or the partners found in it.  All
trees of a table grow level by level at once, as arrays, and so do the searches.

The fingerprints are broadcast while they take at most ``broadcast_bytes``; a task
grows and searches the trees of a slice of a table's shards.  Beyond that size
the same kernel runs on shards co-located by a shuffle of (table, key), in
partitions of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import dropped, saved
from .text import blocks, distinct, documents, mix, only, words

RADIUS = 20
SHARD = 32
RECALL = 0.98
BROADCAST_BYTES = 64 << 20
_PAIRS = 1 << 21
#: Rows of shards (24 bytes each) that one partition of the shuffled search holds on average.
_ROWS = 1 << 20


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each text as two int64 words [n, 2], and its number of distinct words."""
    doc, h = distinct(words(texts))
    n = len(texts)
    ptr = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(ptr)
    full = np.flatnonzero(count)
    bits = np.zeros((n, 128), bool)
    for s in (0, 1) if len(full) else ():
        each = np.unpackbits(mix(h, s).view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(each, ptr[full], axis=0, dtype=np.int32)
        bits[full, 64 * s : 64 * s + 64] = ones * 2 > count[full, None]
    return np.packbits(bits, axis=1).view(np.int64), count


def _simhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch):
            f, n = fingerprints(part.column("text"))
            yield pa.record_batch([part.column("doc_id"), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(n)], ["doc_id", "h1", "h2", "n_words"])


def plan(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """Key bits for n fingerprints, and the tables that let a pair at the radius meet with probability ``RECALL``."""
    bits = max(8, round(np.log2(max(n, 1) / SHARD)))
    return bits, int(np.ceil(np.log(1 - RECALL) / np.log1p(-((1 - radius / 128) ** bits))))


def bit_samples(tables: int, key_bits: int) -> np.ndarray:
    rng = np.random.default_rng(20240101)
    return np.array([rng.choice(128, key_bits, replace=False) for _ in range(tables)])


def shard_keys(f: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The sampled bits of each fingerprint as one integer."""
    u = f.view(np.uint64)
    key = np.zeros(len(f), np.uint64)
    for b in sample:
        key = (key << np.uint64(1)) | ((u[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
    return key


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances; the bits of an unsigned view are counted, as those of a signed integer are its absolute value's."""
    bits = np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int16)
    return bits[..., 0] + bits[..., 1]


@dataclass
class Trees:
    """BK-trees as arrays: node k holds ``item[k]``; its children are the nodes whose ``under`` is k * 256 + edge, which rises with the node."""

    item: np.ndarray
    under: np.ndarray
    roots: int


def grow(f: np.ndarray, key: np.ndarray) -> tuple[Trees, np.ndarray]:
    """A BK-tree for each distinct key, grown level by level, and the root that each row's key has."""
    order = np.argsort(key, kind="stable")
    group = key[order]
    items, under, made, roots, root_of = [], [], 0, 0, np.zeros(len(key), np.int64)
    rest = order
    while len(rest):
        new = np.append(True, group[1:] != group[:-1])
        node = made + np.cumsum(new) - 1
        first = rest[new]
        items.append(first)
        if made == 0:
            roots = len(first)
            root_of[rest] = node
        else:
            under.append(group[new])
        left = np.flatnonzero(~new)
        parent = node[left] - made
        group = node[left] * 256 + _apart(f[rest[left]], f[first[parent]])
        made += len(first)
        by = np.argsort(group, kind="stable")
        rest, group = rest[left][by], group[by]
    return Trees(np.concatenate(items) if items else np.zeros(0, np.int64), np.concatenate(under) if under else np.zeros(0, np.int64), roots), root_of


def search(f: np.ndarray, trees: Trees, queries: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, item) within the radius in the trees of the queries' roots, level by level."""
    q, node = queries, root
    while len(q):
        d = _apart(f[q], f[trees.item[node]]).astype(np.int64)
        hit = d <= radius
        yield q[hit], trees.item[node[hit]]
        low = np.searchsorted(trees.under, node * 256 + np.maximum(d - radius, 0))
        high = np.searchsorted(trees.under, node * 256 + np.minimum(d + radius, 255), side="right")
        n = high - low
        child = np.repeat(low - (np.cumsum(n) - n), n)
        q, node = np.repeat(q, n), child + np.arange(len(child)) + trees.roots


def shard_pairs(f: np.ndarray, key: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal keys whose fingerprints are within ``radius``, each once."""
    trees, root = grow(f, key)
    size = np.bincount(root, minlength=1)
    order = np.argsort(root, kind="stable")
    total = np.cumsum(size[root[order]])  # nodes that the queries can meet
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")))
        for q, i in search(f, trees, order[at:to], root[order[at:to]], radius):
            once = q < i
            yield q[once], i[once]
        at = to


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of the connected component of each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _linked(ids: np.ndarray, f: np.ndarray, key: np.ndarray, radius: int) -> pa.RecordBatch:
    """A star for each component found among the shards: (member, least member)."""
    label = np.arange(len(f))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in shard_pairs(f, key, radius):
        held.append((a, b))
        if sum(len(x) for x, _ in held) > _PAIRS:  # contracted as they come: a dense shard's pairs are never held together
            a, b = map(np.concatenate, zip(*held))
            label, held = stars(label[a], label[b], len(f))[label], []
    if held:
        a, b = map(np.concatenate, zip(*held))
        label = stars(label[a], label[b], len(f))[label]
    low = np.full(len(f), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)
    root = low[label]
    out = root != ids
    return pa.record_batch([pa.array(ids[out]), pa.array(root[out])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating large and small stars until nothing moves."""
    edges = saved(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b a", "m b")
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b a", "m b").where("a <> b").unionByName(low.selectExpr("a", "m b"))
        old, edges = edges, saved(small.distinct())
        dropped(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.selectExpr("a node", "b root")
        seen = now


def _groups(docs: DataFrame, radius: int, broadcast_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2) of each row with a word, and (h1, h2, root, keep_id) of each distinct fingerprint: its group and the least ``doc_id`` there."""
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    prints = saved(docs.mapInArrow(_simhash, "doc_id long, h1 long, h2 long, n_words long").where("n_words > 0").drop("n_words"))
    unique = saved(prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()))
    n = unique.count()
    key_bits, tables = plan(n, radius)
    samples = bit_samples(tables, key_bits)
    if n * 24 <= broadcast_bytes:
        t = unique.toArrow().sort_by("node")
        held = spark.sparkContext.broadcast((t.column("node").to_numpy(), np.stack([t.column("h1").to_numpy(), t.column("h2").to_numpy()], axis=1)))
        slices = max(1, -(-spark.sparkContext.defaultParallelism // tables), n * tables // (_ROWS * tables))

        def one_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, f = held.value
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    key = shard_keys(f, samples[k // slices])
                    own = np.flatnonzero(mix(key) % np.uint64(slices) == k % slices)
                    yield _linked(ids[own], f[own], key[own], radius)

        edges = spark.range(0, tables * slices, 1, tables * slices).mapInArrow(one_slice, "a long, b long")
    else:

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                f = np.stack([batch.column("h1").to_numpy(), batch.column("h2").to_numpy()], axis=1)
                for i, s in enumerate(samples):
                    key = mix(shard_keys(f, s) ^ (np.uint64(i) << np.uint64(48)))  # key bits stay below 48
                    yield pa.record_batch([pa.array(key.view(np.int64)), *[batch.column(c) for c in ("node", "h1", "h2")]], ["key", "node", "h1", "h2"])

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(list(batches))
            if t.num_rows:
                t = t.sort_by("node")
                f = np.stack([t.column("h1").to_numpy(), t.column("h2").to_numpy()], axis=1)
                yield _linked(t.column("node").to_numpy(), f, t.column("key").to_numpy().view(np.uint64), radius)

        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables // _ROWS)
        edges = unique.select("node", "h1", "h2").mapInArrow(spread, "key long, node long, h1 long, h2 long").repartition(parts, "key").mapInArrow(shards, "a long, b long")
    roots = components(edges)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = unique.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keep = members.where("root <> node").unionByName(members.join(roots.where("node = root").select("node"), "node", "left_semi").select(members.columns)).groupBy("root").agg(F.min("doc_id").alias("keep_id"))
    return prints, members.join(keep, "root", "left").select("h1", "h2", "root", F.coalesce("keep_id", "doc_id").alias("keep_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, keep_id) for each document that is a copy: the group's least ``doc_id`` is kept.

    Texts without a word (null, empty, punctuation only) are compared with
    nothing and are no copies.  Rows with a null ``doc_id`` are skipped.  Rows are
    compared by their texts, also where they share a ``doc_id``: such repeats alone
    give no row, and an id whose rows hold several texts is named for each of
    them that is a copy.  Whole texts are hashed however long.  Other columns are
    not read.  An empty table gives no rows.
    """
    prints, groups = _groups(docs, radius, broadcast_bytes)
    return prints.join(groups, ["h1", "h2"]).where("doc_id <> keep_id").select("doc_id", "keep_id").distinct()


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without their near copies, with the columns they came with: of each group the row of the least ``doc_id`` stays.

    Rows with a null ``doc_id`` and rows whose text has no word (null, empty) all
    stay.  Rows that share a ``doc_id`` are judged each by its text: a copy goes, another text
    stays, and of equal or near texts under one id one row stays.  Texts are hashed
    whole however long; extra columns pass through, whatever their names.  An
    empty table gives no rows.
    """
    prints, groups = _groups(docs, RADIUS, BROADCAST_BYTES)
    found = saved(prints.join(groups, ["h1", "h2"]).select(F.col("doc_id").alias("_copy"), "h1", "h2", "root", "keep_id"))
    ids = docs["doc_id"].cast("long")
    again = saved(only(docs, "doc_id").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_again")).count().where("count > 1").select("_again"))
    copies = saved(found.where("_copy <> keep_id").join(again, found["_copy"] == again["_again"], "left_anti").select("_copy"))
    if copies.count() * 24 <= BROADCAST_BYTES:  # else both sides are shuffled
        copies = F.broadcast(copies)
    left = docs.join(copies, ids == copies["_copy"], "left_anti")
    if again.isEmpty():
        return left
    return left.join(again, ids == again["_again"], "left_anti").unionByName(_own_rows(docs.join(again, ids == again["_again"], "left_semi"), found))


def _own_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows that share ids, those whose text is no copy: judged by fingerprint."""
    names = docs.columns
    numbered = saved(docs.toDF(*(f"_c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id()))
    at = {c: f"_c{names.index(c)}" for c in ("doc_id", "text")}
    prints = numbered.select(F.struct("_row", F.col(at["doc_id"]).cast("long").alias("id")).alias("doc_id"), F.col(at["text"]).alias("text")).mapInArrow(_simhash, "doc_id struct<_row:long,id:long>, h1 long, h2 long, n_words long")
    prints = prints.select("doc_id._row", "doc_id.id", "h1", "h2", "n_words")
    groups = found.select("h1", "h2", "root", "keep_id").distinct()
    judged = prints.join(groups, ["h1", "h2"], "left").withColumn("_nth", F.row_number().over(Window.partitionBy("root", "id").orderBy("h1", "h2", "_row")))
    stay = judged.where("n_words = 0 or (id = keep_id and _nth = 1)").select("_row")
    return numbered.join(stay, "_row", "left_semi").drop("_row").toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
