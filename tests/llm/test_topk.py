import numpy as np
import pytest

from tests.llm.helpers import result
from tracework.llm import topk


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, distance double, rank int")


def brute(rows, k):
    out = []
    for i, v in rows:
        others = sorted((float(np.sqrt(((np.float64(v) - np.float64(w)) ** 2).sum())), j) for j, w in rows if j != i and len(w) == len(v))
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(others[:k])]
    return out


def same(got, want):
    got, want = sorted(got), sorted(want)
    return [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


@pytest.mark.parametrize("waves", [1, 5])
def test_matches_brute_force(spark, waves):
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(0, 1, (500, 8)), rng.normal(8, 0.3, (200, 8))]), 1).astype(np.float32)
    x[300:340] = x[300]  # ties and repeated vectors
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    assert same(result(topk.nearest(table(spark, rows), k=7, wave_bytes=len(x) * 64 // waves)), brute(rows, 7))


def test_clusters_are_pruned():
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 1, (20, 1, 16)) * 50 + rng.normal(0, 1, (20, 512, 16))).reshape(-1, 16)
    ids = np.arange(len(x))
    tree = topk.build(ids, x)
    d, i = np.full((128, 10), np.inf), np.full((128, 10), topk._NONE)
    assert topk.search(tree, ids[:128], x[:128], d, i) < 0.2 * 128 * len(x)
    full = np.sqrt(((x[:128, None] - x[None]) ** 2).sum(2))
    full[np.arange(128), np.arange(128)] = np.inf
    assert (np.sort(i) == np.sort(np.argsort(full, axis=1)[:, :10])).all()


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0]), (None, [1.0, 1.0]), (4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (2, [30.0, 40.0]), (2, [3.0, 4.0])]
    got = sorted(result(topk.nearest(table(spark, rows), k=5)))
    assert got == [(1, 1, 3, 0.0), (1, 2, 2, 5.0), (2, 1, 1, 5.0), (2, 2, 3, 5.0), (3, 1, 1, 0.0), (3, 2, 2, 5.0)]
    assert topk.nearest(table(spark, [])).count() == 0
    assert topk.nearest(table(spark, [(1, [1.0])])).count() == 0


def test_few_pairs_are_measured_exactly(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2048, 32))
    x /= np.sqrt((x**2).sum(1))[:, None]
    tree, handed, merge = topk.build(np.arange(len(x)), x), [], topk._merge
    monkeypatch.setattr(topk, "_merge", lambda row, *rest: (handed.append(len(row)), merge(row, *rest)))
    d, i = np.full((256, 10), np.inf), np.full((256, 10), topk._NONE)
    computed = topk.search(tree, np.arange(256), x[:256], d, i)
    assert sum(handed) < 0.05 * computed


@pytest.mark.parametrize("scale", [1e-25, 1.0, 1e18])
def test_single_precision_loses_no_neighbour(scale):
    rng = np.random.default_rng(5)
    x = ((1000 + rng.normal(0, 1e-3, (600, 16))) * scale).astype(np.float32).astype(np.float64)  # nearer than products in single precision can tell
    x[100:140] = x[100]
    ids = rng.permutation(len(x))
    tree = topk.build(ids, x)
    d, i = np.full((len(x), 10), np.inf), np.full((len(x), 10), topk._NONE)
    topk.search(tree, ids, x, d, i)
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    full[np.arange(len(x)), np.arange(len(x))] = np.inf
    want = np.array([ids[np.lexsort((ids, row))[:10]] for row in full])
    assert (i == want).all()
