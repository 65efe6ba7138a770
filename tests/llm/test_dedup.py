import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, documents, result
from tracework.llm import dedup
from tracework.llm.text import WORD, mix, words

RNG = np.random.default_rng(5)
VOCABULARY = np.array([f"w{i:04d}" for i in range(5000)])


def text(n=150):
    return " ".join(RNG.choice(VOCABULARY, n))


def edited(t, share):
    own = t.split()
    for i in RNG.choice(len(own), int(len(own) * share), replace=False):
        own[i] = str(RNG.choice(VOCABULARY))
    return " ".join(own)


@pytest.fixture(scope="module")
def rows():
    base = [text() for _ in range(150)]
    out = list(base)
    for t in base[:40]:
        out += [t, edited(t, 0.03), edited(t, 0.05)]
    hot = text()
    out += [edited(hot, 0.02) for _ in range(400)]
    return list(enumerate(out))


def plain_fingerprint(t):
    """SimHash by loops: each distinct word's hashed bits vote."""
    votes, own = np.zeros(128, int), sorted(set(re.findall(WORD, (t or "").lower())))
    for w in own:
        h = words(pa.array([w])).hash >> np.uint64(16)
        bits = np.concatenate([np.unpackbits(mix(h, s).view(np.uint8)) for s in (0, 1)])
        votes += 2 * bits.astype(int) - 1
    return (votes > 0, len(own))


def brute(rows, radius=dedup.RADIUS):
    """Groups over all pairs within the radius, by loops: {doc_id: least doc_id}."""
    prints = [(i, *plain_fingerprint(t)) for i, t in rows]
    parent = {i: i for i, _, _ in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bits = np.array([f for _, f, _ in prints])
    for k, (i, f, n) in enumerate(prints):
        for m in np.flatnonzero((bits[:k] != f).sum(1) <= radius):
            if n and prints[m][2]:
                a, b = sorted((top(i), top(prints[m][0])))
                parent[b] = a
    return {i: top(i) for i, _, _ in prints if top(i) != i}


def test_matches_brute_force(spark, rows):
    got = dict(result(dedup.near_duplicates(documents(spark, rows))))
    want = brute(rows)
    assert set(got) <= set(want)
    assert len(set(got.items()) & set(want.items())) >= 0.98 * len(want)
    assert all(got.get(i) == want.get(i) for i in range(150, 270, 3))  # exact copies are all found


def test_pairs_at_the_radius_meet():
    """Recall by distance against all pairs, on sizes with keys of different widths."""
    for n in (2000, 40_000):
        f = RNG.integers(-(2**63), 2**63 - 1, (n, 2))
        for i in range(1, 600, 2):
            flip = np.zeros(128, np.uint8)
            flip[RNG.permutation(128)[: dedup.RADIUS]] = 1
            f[i] = f[i - 1] ^ np.packbits(flip).view(np.int64)
        bits, tables = dedup.plan(n)
        found = set()
        for sample in dedup.bit_samples(tables, bits):
            for a, b in dedup.shard_pairs(f, dedup.shard_keys(f, sample), dedup.RADIUS):
                found |= set(zip(a.tolist(), b.tolist()))
        assert sum((i - 1, i) in found for i in range(1, 600, 2)) >= 0.9 * 300
        assert all(a < b for a, b in found)
    assert dedup.plan(40_000)[0] > dedup.plan(2000)[0]


def test_shuffled_search_equals_broadcast_search(spark, rows):
    docs = documents(spark, rows)
    assert result(dedup.near_duplicates(docs), "doc_id") == result(dedup.near_duplicates(docs, broadcast_bytes=0), "doc_id")


def test_trees_hang_items_at_their_distance_and_searches_follow_only_near_edges(monkeypatch):
    f = RNG.integers(-(2**63), 2**63 - 1, (1500, 2))
    f[700:1400] = f[:700]
    f[700:1400, 0] ^= 1 << RNG.integers(0, 60, 700)
    key = RNG.integers(0, 5, 1500).astype(np.uint64)
    key[700:1400] = key[:700]
    trees, root = dedup.grow(f, key)
    assert sorted(trees.item.tolist()) == list(range(1500)) and trees.roots == 5
    assert len(set(trees.under.tolist())) == len(trees.under)  # one child an edge
    for k, under in enumerate(trees.under.tolist()):
        assert dedup._apart(f[trees.item[k + 5]], f[trees.item[under // 256]]) == under % 256
    children = {}
    for k, under in enumerate(trees.under.tolist()):
        children.setdefault(under // 256, []).append((under % 256, k + 5))

    def visit(q, node, radius, seen):
        seen.append(node)
        d = int(dedup._apart(f[q], f[trees.item[node]]))
        for edge, child in children.get(node, ()):
            if abs(edge - d) <= radius:
                visit(q, child, radius, seen)

    for radius in (3, 20):
        visited = []
        monkeypatch.setattr(dedup, "_apart", lambda a, b, f=dedup._apart: (visited.append(len(a)), f(a, b))[1])
        got = {(a, b) for q, i in dedup.search(f, trees, np.arange(1500), root, radius) for a, b in zip(q.tolist(), i.tolist())}
        monkeypatch.undo()
        assert got == {(a, b) for a, b in np.argwhere(dedup._apart(f[:, None], f[None]) <= radius).tolist() if key[a] == key[b]}
        want = []
        for q in range(1500):
            visit(q, int(root[q]), radius, want)
        assert sum(visited) == len(want) < (0.5 if radius == 3 else 1) * sum(np.bincount(key.astype(int)) ** 2)


def test_dense_shard_groups_all():
    f = np.zeros((3000, 2), np.int64)
    f[:, 0] = np.arange(3000)
    out = dedup._linked(np.arange(3000), f, np.zeros(3000, np.uint64), 20)
    assert out.num_rows == 2999 and set(out.column("b").to_pylist()) == {0}


def test_awkward_rows(spark):
    docs = documents(spark, [*awkward(), (907, "word other " * 20_000), (3, "word other " * 20_000)])
    assert result(dedup.near_duplicates(docs), "doc_id") == [(905, 3), (907, 3)]
    left = result(dedup.drop_copies(docs).select("doc_id", "text"))
    assert sorted((i is None, i or 0) for i, _ in left) == sorted((i is None, i or 0) for i in [900, 901, 902, 903, None, 904, 906, 3])


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = text(), text(), text()
    rows = [(7, a), (7, b), (9, a), (9, c), (9, c + " again"), (11, b), (12, c), (5, None), (5, ""), (5, "!"), (13, edited(c, 0.02)), (None, a), (None, a)]
    docs = documents(spark, rows)
    assert result(dedup.near_duplicates(docs), "doc_id") == [(9, 7), (11, 7), (12, 9), (13, 9)]
    left = [(i, t) for i, t in result(dedup.drop_copies(docs).select("doc_id", "text"))]
    assert len([t for i, t in left if i == 9]) == 1 and [t for i, t in left if i == 9][0] in (c, c + " again")
    assert sorted((x for x in left if x[0] != 9), key=str) == sorted([(7, a), (7, b), (5, None), (5, ""), (5, "!"), (None, a), (None, a)], key=str)
    assert dedup.drop_copies(docs).columns == docs.columns


def test_empty_table(spark):
    docs = documents(spark, [])
    assert dedup.near_duplicates(docs).count() == 0
    assert dedup.drop_copies(docs).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert dict(result(dedup.components(edges))) == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_columns_that_differ_by_case(spark):
    from tracework.llm.text import only

    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, TEXT string")
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert result(only(df, "doc_id", "text")) == [(1, "a")]
