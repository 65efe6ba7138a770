import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, documents, result
from tracework.llm import quality

RNG = np.random.default_rng(9)


def text(good):
    words = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(1, 9))) for _ in range(RNG.integers(20, 120))]
    if not good:
        kind = RNG.integers(3)
        words = [w.upper() + "!!" for w in words] if kind == 0 else [words[0]] * len(words) if kind == 1 else [w + "$%" for w in words]
    return " ".join(words)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    truth = RNG.random(600) < 0.7
    rows = [(i, text(g)) for i, g in enumerate(truth)]
    model = quality.train(documents(spark, rows[:300]), labels(spark, [(i, int(g)) for i, g in enumerate(truth)]))
    got = {r["doc_id"]: r for r in quality.classify(documents(spark, rows[300:]), None, model).collect()}
    assert np.mean([got[i]["good"] == truth[i] for i in range(300, 600)]) > 0.95


def test_pairs_learn_what_single_features_cannot():
    x = np.zeros((2000, len(quality.FEATURES)))
    x[:, :3] = RNG.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) >= 0.5) == y) > 0.95
    alone = quality.Additive(model.edges, model.coarse, model.intercept, model.tables)
    assert np.mean((alone.score(x) >= 0.5) == y) < 0.7


def test_scores_are_sums_of_looked_up_values():
    x, y = RNG.random((500, len(quality.FEATURES))), (RNG.random(500) < 0.5).astype(float)
    m = quality.fit(x, y)
    for row in x[:20]:
        total = m.intercept + sum(t[sum(v >= e for e in m.edges[f])] for f, (t, v) in enumerate(zip(m.tables, row)))
        total += sum(t[sum(row[f] >= e for e in m.coarse[f]), sum(row[g] >= e for e in m.coarse[g])] for (f, g), t in m.pairs.items())
        assert m.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_features_by_hand():
    f = dict(zip(quality.FEATURES, quality.features(pa.array(["The THE cat!\nThe dog | é9"]))[0]))
    n = len("The THE cat!\nThe dog | é9".encode())
    assert f["log_bytes"] == pytest.approx(np.log1p(n)) and f["log_words"] == pytest.approx(np.log1p(6))
    assert f["upper"] == pytest.approx(5 / n) and f["digits"] == pytest.approx(1 / n) and f["bars"] == pytest.approx(1 / n)
    assert f["distinct_words"] == pytest.approx(4 / 6) and f["repeats"] == pytest.approx(1 / 6) and f["same_line_starts"] == pytest.approx(1 / 2)


def test_awkward_rows(spark):
    rows = awkward()
    docs, marks = documents(spark, rows), labels(spark, [(904, 1), (904, 0), (905, 0), (900, 0), (None, 1), (904, None), (12345, 1)])
    out = result(quality.classify(docs, marks))
    assert len(out) == len(rows) and (900, 0.0, False) in out and (901, 0.0, False) in out
    assert quality.classify(documents(spark, []), marks).count() == 0
    assert {s for _, s, _ in result(quality.classify(documents(spark, [(1, "a b"), (2, "c d e")]), labels(spark, [])))} == {0.5}


def leaf_gain(g, h):
    return g.sum() ** 2 / (h.sum() + 1)


def test_trees_are_the_best_of_all_cuts():
    for n, m in ((5, 4), (1, 6), (7, 1)):
        grad, hess = RNG.normal(size=(n, m)), RNG.random((n, m))
        at, gain = quality._cut(grad[0], hess[0])
        all_ = [leaf_gain(grad[0][:k], hess[0][:k]) + leaf_gain(grad[0][k:], hess[0][k:]) - leaf_gain(grad[0], hess[0]) for k in range(1, m)]
        assert (at, gain) == ((int(np.argmax(all_)) + 1, pytest.approx(max(all_))) if all_ else (0, 0.0))
        want = 0.0
        for g, h in ((grad, hess), (grad.T, hess.T)):
            for k in range(1, len(g)):
                total = -leaf_gain(g, h)
                for side in (slice(0, k), slice(k, None)):
                    gs, hs = g[side].sum(0), h[side].sum(0)
                    total += max([leaf_gain(gs[:c], hs[:c]) + leaf_gain(gs[c:], hs[c:]) for c in range(1, len(gs))] or [leaf_gain(gs, hs)])
                want = max(want, total)
        assert quality.tree_2d(grad, hess)[1] == pytest.approx(want)


def test_boosting_is_that_of_a_plain_loop(monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 3)
    monkeypatch.setattr(quality, "PAIR_ROUNDS", 2)
    x, y = np.zeros((80, len(quality.FEATURES))), (RNG.random(80) < 0.4).astype(float)
    x[:, :3] = RNG.random((80, 3))
    m = quality.fit(x, y)
    total = [float(np.log(y.mean() / (1 - y.mean())))] * 80
    tables = [np.zeros(len(e) + 1) for e in m.edges]
    pairs = {p: np.zeros_like(t) for p, t in m.pairs.items()}

    def sums(shape, place):
        g, h = np.zeros(shape), np.zeros(shape)
        for i in range(80):
            p = 1 / (1 + np.exp(-total[i]))
            g[place(i)] += y[i] - p
            h[place(i)] += p * (1 - p)
        return g, h

    for _ in range(3):
        for f, e in enumerate(m.edges):
            place = lambda i, f=f, e=e: sum(x[i, f] >= c for c in e)
            step = quality.RATE * quality.tree_1d(*sums(len(e) + 1, place))
            tables[f] += step
            total = [t + step[place(i)] for i, t in enumerate(total)]
    for _ in range(2):
        for f, g in m.pairs:
            place = lambda i, f=f, g=g: (sum(x[i, f] >= c for c in m.coarse[f]), sum(x[i, g] >= c for c in m.coarse[g]))
            step = quality.RATE * quality.tree_2d(*sums(pairs[f, g].shape, place))[0]
            pairs[f, g] += step
            total = [t + step[place(i)] for i, t in enumerate(total)]
    assert all(a == pytest.approx(b) for a, b in zip(m.tables, tables)) and all(m.pairs[p] == pytest.approx(t) for p, t in pairs.items())
    assert m.score(x) == pytest.approx(1 / (1 + np.exp(-np.array(total))))
