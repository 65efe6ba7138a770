import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, documents, result
from tracework.llm import lm


def small():
    tree = lm.huffman(np.arange(6), np.array([5, 3, 8, 1, 2, 9]))
    return tree, lm.Model.start(tree, 4, 8)


def test_probabilities_sum_to_one():
    tree, m = small()
    h = m.hidden(np.array([[6, 1, 2]]))[0][0]
    for state in h:
        loss = m.losses(np.repeat(state[None], 6, 0), np.arange(6), tree)
        assert np.exp(-loss).sum() == pytest.approx(1, abs=1e-5)


def test_start_gives_corpus_frequencies():
    tree, m = small()
    loss = m.losses(np.zeros((6, 4), np.float32), np.arange(6), tree)
    assert np.exp(-loss) == pytest.approx(np.array([5, 3, 8, 1, 2, 9]) / 28, abs=0.05)


def test_attention_is_causal():
    _, m = small()
    a, b = m.hidden(np.array([[6, 1, 2, 3]]))[0], m.hidden(np.array([[6, 1, 5, 0]]))[0]
    assert np.allclose(a[:, :2], b[:, :2]) and not np.allclose(a[:, 2:], b[:, 2:])


@pytest.mark.parametrize("busy", [0, 2, 64])
def test_gradient(busy, monkeypatch):
    monkeypatch.setattr(lm, "BUSY_NODES", busy)
    tree, m = small()
    x, y = np.array([[6, 1, 2, 3, 0], [6, 5, 5, 1, 2]]), np.array([[1, 2, 3, 0, 4], [5, 5, 1, 2, 0]])
    ok = np.ones((2, 5), bool)
    ok[1, 4] = False
    got = m.gradient(x, y, ok, tree)

    def loss(flat):
        other, at = lm.Model(6, 4, 8), 0
        for name, part in other.part.items():
            other.part[name], at = flat[at : at + part.size].reshape(part.shape), at + part.size
        return other.losses(other.hidden(x)[0][ok], y[ok], tree).mean()

    flat = m.flat.astype(float)
    want = [(loss(flat + e) - loss(flat - e)) / 2e-4 for e in np.eye(len(flat)) * 1e-4]
    assert got.flat == pytest.approx(np.array(want), abs=1e-5)


def test_gradient_does_not_depend_on_passes_and_tiles(monkeypatch):
    rng = np.random.default_rng(8)
    tree = lm.huffman(np.arange(300), rng.integers(1, 1000, 300) ** 2)
    m = lm.Model.start(tree)
    x, y, ok = rng.integers(0, 301, (20, 32)), rng.integers(0, 300, (20, 32)), rng.random((20, 32)) < 0.9
    whole = m.gradient(x, y, ok, tree).flat
    for passes, tile in ((1, 7), (7, 1), (64, 640)):
        monkeypatch.setattr(lm, "PASS", passes)
        monkeypatch.setattr(lm, "TILE", tile)
        assert m.gradient(x, y, ok, tree).flat == pytest.approx(whole, abs=1e-6)
    assert not m.gradient(x, y, np.zeros_like(ok), tree).flat.any()


def test_leaves_are_ranked_from_one_side_of_the_tree_to_the_other():
    tree = lm.huffman(np.arange(50), np.random.default_rng(9).integers(1, 500, 50))
    turns = [tuple(tree.turn[tree.ptr[w] : tree.ptr[w + 1]][::-1].tolist()) for w in tree.ranked]
    assert turns == sorted(turns) and np.array_equal(tree.rank[tree.ranked], np.arange(50))


def test_a_step_of_training_takes_little_memory():
    rng = np.random.default_rng(10)
    tree = lm.huffman(np.arange(2000), rng.integers(1, 1000, 2000))
    m = lm.Model.start(tree)
    x, y = rng.integers(0, 2001, (lm.BATCH, lm.WINDOW)), rng.integers(0, 2000, (lm.BATCH, lm.WINDOW))
    tracemalloc.start()
    m.gradient(x, y, np.ones_like(x, bool), tree)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20


def test_no_state_of_an_overlap_is_scored_again(monkeypatch):
    tree, _ = small()
    states = []
    monkeypatch.setattr(lm.Model, "hidden", lambda self, *a, f=lm.Model.hidden: (out := f(self, *a), states.append(out[0].shape[:2]))[0])
    lm.document_losses(np.zeros(32 + 24 * 9 + 32, np.int64), np.array([32 + 24 * 9, 32]), tree, lm.Model.start(tree))
    assert sum(a * b for a, b in states) == 32 + 24 * 9 + 32


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 500])
def test_each_id_is_scored_once(n):
    doc, first = lm.windows(np.array([n, 7]))
    ids = np.arange(n + 7)
    x, y, ok = lm.laid_out(ids, np.array([n, 7]), doc, first, 9999)
    assert sorted(y[ok].tolist()) == list(range(n + 7))
    before = dict(zip(y[ok].tolist(), x[ok].tolist()))
    assert all(before[i] == (9999 if i in (0, n) else i - 1) for i in range(n + 7))


def test_block_scores_equal_a_plain_loop():
    tree, _ = small()
    m = lm.Model.start(tree)
    rng = np.random.default_rng(1)
    ids, size = rng.integers(0, 6, 150), np.array([100, 0, 50])
    got = lm.document_losses(ids, size, tree, m)
    at = 0
    for total, n in zip(got, size):
        own, loss = ids[at : at + n], 0.0
        for i in range(n):
            k = max(0, -(-(i + 1 - lm.WINDOW) // (lm.WINDOW - lm.OVERLAP)))
            begin = k * (lm.WINDOW - lm.OVERLAP)
            x = [own[j - 1] if j else 6 for j in range(begin, i + 1)]
            loss += m.losses(m.hidden(np.array([x]))[0][0, -1:], own[i : i + 1], tree)[0]
        assert total == pytest.approx(loss, rel=1e-4)
        at += n


def table(spark, folder, ids, files):
    rows = [(i, bytearray(x.astype(np.uint16).tobytes())) for i, x in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id long, ids binary").repartition(files).write.parquet(str(folder))
    return spark.read.parquet(str(folder))


def test_every_id_is_a_target_of_training_once(monkeypatch):
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 32, 33, 57, 500, 90])
    ids = [rng.integers(0, 6, n).astype(np.uint16) for n in size]
    batch = pa.record_batch({"ids": pa.array([i.tobytes() for i in ids], pa.binary())})
    tree, _ = small()
    seen = []
    monkeypatch.setattr(lm.Adam, "step", lambda self, x, y, ok, tree: seen.append((x[ok], y[ok])))
    held = type("Held", (), {"value": (tree, lm.Model.start(tree).flat)})
    (out,) = lm._work(held, np.uint16, 0.01, 1)(iter([batch]))
    x, y = map(np.concatenate, zip(*seen))
    want = [(a, b) for own in ids for a, b in zip([6, *tree.word[own][:-1].tolist()], tree.word[own].tolist())]
    assert sorted(zip(x.tolist(), y.tolist())) == sorted(want)
    assert out.column("windows")[0].as_py() == sum(-(-n // lm.WINDOW) for n in size)


def test_the_mean_is_weighted_by_windows(spark, monkeypatch):
    monkeypatch.setattr(lm, "_PART", 3)
    rng = np.random.default_rng(4)
    flats, weight = rng.normal(size=(9, 8)), rng.integers(1, 50, 9)
    rows = []
    for flat, n in zip(flats, weight.tolist()):
        sums = np.rint(flat * n * lm._UNIT).astype(np.int64)
        rows += [(i, n, bytearray(sums[3 * i : 3 * i + 3].tobytes())) for i in range(3)]
    got = [lm.mean_of(spark.createDataFrame(rng.permutation(np.array(rows, object)).tolist(), lm.PARTS).repartition(k), 3) for k in (1, 4)]
    assert np.array_equal(*got) and got[0] == pytest.approx(np.average(flats, axis=0, weights=weight), abs=1e-5)
    assert lm.mean_of(spark.createDataFrame([], lm.PARTS), 3) is None


def test_training_is_that_of_a_plain_loop_over_rounds(spark, tmp_path):
    rng = np.random.default_rng(5)
    ids = [rng.integers(0, 6, 400) for _ in range(12)]
    tokens = table(spark, tmp_path / "t", ids, 3)
    tree, got = lm.fitted(tokens, min_steps=0, workers=2)
    files = sorted(tokens.inputFiles())
    model = lm.Model.start(tree)
    for i, chosen in enumerate((files[:2], files[2:])):
        flats, weight = [], []
        for file in chosen:
            own, n = lm.Model(6, flat=model.flat.copy()), 0
            docs = [np.frombuffer(x, np.uint16) for x in spark.read.parquet(file).toPandas()["ids"]]
            size = np.array([len(x) for x in docs])
            x, y, ok = lm.laid_out(tree.word[np.concatenate(docs)], size, *lm.windows(size, overlap=0), 6, overlap=0)
            order = np.random.default_rng(0).permutation(len(x))
            adam = lm.Adam(own, lm.RATE / (1 + i) ** 0.5)
            for at in range(0, len(x), lm.BATCH):
                adam.step(*(v[order[at : at + lm.BATCH]] for v in (x, y, ok)), tree)
            flats.append(own.flat), weight.append(len(x))
        model = lm.Model(6, flat=np.average(flats, axis=0, weights=weight))
    assert got.flat == pytest.approx(model.flat, abs=1e-4)


def test_steps_grow_with_the_input(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    rounds = []
    monkeypatch.setattr(lm, "mean_of", lambda rows, parts, f=lm.mean_of: (rounds.append(1), f(rows, parts))[1])
    for files in (2, 8):
        lm.fitted(table(spark, tmp_path / str(files), [rng.integers(0, 6, 300) for _ in range(4 * files)], files), workers=2)
    assert len(rounds) == 1 + 4


def test_learns_more_than_frequencies(spark):
    rng = np.random.default_rng(2)
    phrases = ["the cat sat on the mat", "a dog ran over the hill", "birds fly south in autumn", "rain falls on the plain"]
    rows = [(i, ". ".join(rng.choice(phrases, 60))) for i in range(300)]
    shuffled = [(1000 + i, " ".join(rng.permutation(t.split()))) for i, t in rows[:20]]
    out = {r["doc_id"]: r for r in lm.score(documents(spark, rows + shuffled)).collect()}
    plain = np.mean([out[i]["log_loss"] / out[i]["n_tokens"] for i, _ in rows])
    mixed = np.mean([out[i]["log_loss"] / out[i]["n_tokens"] for i, _ in shuffled])
    assert plain < 1.5 < mixed


def test_awkward_rows(spark):
    rows = awkward()
    out = result(lm.score(documents(spark, rows)).select("doc_id", "n_tokens", "log_loss", "perplexity"))
    assert len(out) == len(rows) and (900, 0, 0.0, None) in out and (901, 0, 0.0, None) in out
    assert all(n > 0 and loss > 0 and ppl > 1 for i, n, loss, ppl in out if i not in (900, 901))
    assert lm.score(documents(spark, [])).count() == 0
    assert result(lm.score(documents(spark, [(1, "a")])).select("log_loss", "perplexity")) == [(0.0, 1.0)]
