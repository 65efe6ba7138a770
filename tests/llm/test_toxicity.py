import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, documents, result
from tracework.llm import toxicity as tx
from tracework.llm.text import blocks, words

BAD = ["vile", "nasty", "awful", "rotten", "hateful", "wicked", "foul", "mean", "cruel", "ugly"]


def corpus(n=1500, seed=2):
    rng = np.random.default_rng(seed)
    plain = np.array([f"p{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)])
    rows, toxic = [], []
    for i in range(n):
        t = list(rng.choice(plain, rng.integers(40, 120)))
        bad = rng.random() < 0.15
        if bad:
            for w in rng.choice(BAD, 5, replace=False):
                t.insert(int(rng.integers(len(t))), str(w))
        rows.append((i, " ".join(t)))
        toxic.append(int(bad))
    return rows, toxic


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_accuracy_and_induced_terms(spark):
    rows, toxic = corpus()
    marks = labels(spark, [(i, toxic[i]) for i in range(0, 500)])
    docs = documents(spark, rows)
    lexicon = tx.calibrated(tx.induce(docs, marks), docs, marks)
    polarity = dict(zip(lexicon.terms, lexicon.polarity))
    assert all(polarity.get(w, 0) >= tx.MIN_POLARITY for w in BAD)
    assert not [t for t, p in polarity.items() if p >= tx.MIN_POLARITY and t not in BAD]
    got = {r["doc_id"]: r["toxic"] for r in tx.score(docs, marks, lexicon).collect()}
    assert np.mean([got[i] == bool(toxic[i]) for i in range(500, 1500)]) > 0.98


def test_clean_documents_take_no_term_away(spark):
    rows, toxic = corpus(700)
    rng = np.random.default_rng(4)
    rows += [(2000 + i, " ".join(["grim", *rng.permutation(BAD)[:9]])) for i in range(6)]  # 54 meetings with seeds
    marks = labels(spark, [(i, toxic[i]) for i in range(500)])
    docs = documents(spark, rows).select("doc_id", "text")
    clean = spark.range(5000, 5300, 1, 8).selectExpr("id doc_id", "repeat('so it ', 100000) text")  # 60 million words
    for table in (docs, docs.unionByName(clean)):
        lexicon = tx.induce(table, marks)
        polarity = dict(zip(lexicon.terms, lexicon.polarity))
        assert polarity.get("grim", -1) > 0 and all(polarity.get(w, 0) >= tx.MIN_POLARITY for w in BAD)


def plain_walks(single, total, window, a, b, n, starts):
    """Visits and a last step's arrivals by a dense matrix."""
    v = len(single)
    pmi = np.log2(n * total / (2 * window * single[a] * single[b]))
    flow = n * pmi / max(pmi.max(initial=0), 1) / (2 * window)
    m = np.zeros((v, v))
    m[a, b], m[b, a] = flow / single[a], flow / single[b]
    m /= np.maximum(m.sum(1), 1)[:, None]
    full = m + np.diag(1 - m.sum(1))
    p0 = starts / np.maximum(starts.sum(0), 1)
    p = p0
    for _ in range(tx.STEPS):
        p = tx.RESTART * p0 + (1 - tx.RESTART) * (full.T @ p)
    return p, m.T @ p


@pytest.mark.parametrize("edges", [0, 60])
def test_walks_match_a_dense_matrix_on_the_driver_and_in_tables(spark, edges):
    rng = np.random.default_rng(0)
    a, b = np.triu_indices(14, 1)
    keep = np.sort(rng.permutation(len(a))[:edges])
    a, b, single = a[keep], b[keep], rng.integers(50, 90, 14)
    n = rng.integers(20, 60, len(a))
    starts = np.zeros((14, 2))
    starts[[0, 3], 0] = starts[[1, 5, 6], 1] = 1
    want = plain_walks(single, 4000, 2, a, b, n, starts)
    table = spark.createDataFrame([tuple(map(int, x)) for x in zip(a, b, n)], "a long, b long, n long").repartition(3)
    for held in ((a, b, n), table):
        got = tx.Graph(single, 4000, 2, held).walks(starts)
        assert got[0] == pytest.approx(want[0]) and got[1] == pytest.approx(want[1])
        assert got[0].sum(0) == pytest.approx([1, 1])


def brute(rows, marks, window):
    """The lexicon by loops over words: seeds, nodes, edges, walks and polarity."""
    split = [(i, t.split()) for i, t in rows]
    mark = dict(marks)
    own = [(set(w), mark[i]) for i, w in split if i in mark]
    n1, n0 = sum(x for _, x in own), sum(1 - x for _, x in own)
    up, down = [], []
    for term in set().union(*(w for w, _ in own)):
        c = np.array([[sum(term in w and x == y for w, x in own) for y in (1, 0)]], float)
        c = np.vstack([c, [n1 - c[0, 0], n0 - c[0, 1]]])
        if c[0].sum() < tx.SEED_DOCS:
            continue
        want = c.sum(1)[:, None] * c.sum(0) / c.sum()
        g = sum(x * np.log(x / e) for x, e in zip(c.ravel(), want.ravel()) if x > 0)
        z = np.sign(c[0, 0] * n0 - c[0, 1] * n1) * np.sqrt(max(2 * g, 0))
        if z >= tx.SEED_Z and (c[0, 0] + 0.5) / (c[0].sum() + 1) >= tx.SEED_PRECISION:
            up.append(term)
        elif z <= -tx.CLEAN_Z:
            down.append(term)
    near, contexts, count, mass = {}, {}, {}, 0
    for _, w in split:
        for i, x in enumerate(w):
            count[x] = count.get(x, 0) + 1
            if x in up:
                for y in w[max(0, i - window) : i + window + 1]:
                    if y != x:
                        mass += 1
                        near[y] = near.get(y, 0) + 1
                        contexts.setdefault(y, set()).add(tuple(w[j] if 0 <= j < len(w) else "" for j in range(i - 2, i + 3)))
    total = sum(count.values())
    nodes = {x for x in near if near[x] >= tx.MIN_NEAR and near[x] * total >= 2**tx.MIN_PMI * mass * count[x]}
    assert not [x for x in nodes if tx.MIN_CONTEXTS <= len(contexts[x]) < 30]  # else the hashes would decide
    nodes = {x for x in nodes if len(contexts[x]) >= 30} | set(up) | set(down)
    nodes = sorted(nodes, key=lambda x: int(words(pa.array([x])).hash[0]))
    place = {x: k for k, x in enumerate(nodes)}
    pairs = {}
    for _, w in split:
        for i, x in enumerate(w):
            for y in w[i + 1 : i + window + 1]:
                if x in place and y in place and x != y:
                    key = tuple(sorted((place[x], place[y])))
                    pairs[key] = pairs.get(key, 0) + 1
    single = np.array([count[x] for x in nodes])
    pairs = {k: n for k, n in pairs.items() if n >= tx.MIN_EDGE and np.log2(n * total / (2 * window * single[k[0]] * single[k[1]])) >= tx.MIN_EDGE_PMI}
    a, b, n = (np.array(x, int) for x in (*zip(*pairs), list(pairs.values())))
    starts = np.array([[x in up, x in down] for x in nodes], float)
    visits, came = plain_walks(single, total, window, a, b, n, starts)
    t, c = visits.T
    usual = np.median(came[starts[:, 0] > 0, 0]) * (1 - tx.RESTART) / tx.RESTART
    return dict(zip(nodes, (t - c) / (t + c + tx.SHRINK * usual + 1e-30)))


def test_lexicon_is_that_of_plain_loops_however_the_rows_are_cut(spark, monkeypatch):
    rows, toxic = corpus(600)
    rng = np.random.default_rng(8)
    rows += [(3000 + i, " ".join(rng.permutation(["grim", "dire", *BAD, *(f"x{i}{k}" for k in range(5))]))) for i in range(40)]  # terms without a label
    marks = [(i, toxic[i]) for i in range(500)] + [(3000 + i, 1) for i in range(3)]
    rows += [(4000 + i, "good kind " + " ".join(f"y{i}{k}" for k in range(4))) for i in range(200)]  # clean seeds
    marks += [(4000 + i, 0) for i in range(200)]
    want = brute(rows, marks, 5)
    assert {"grim", "dire", "good", *BAD} <= set(want)
    got = []
    for parts, block, edges in ((1, 1 << 20, 1 << 20), (3, 100, 1 << 20), (2, 5000, 0)):
        monkeypatch.setattr(tx, "blocks", lambda batch, block=block: blocks(batch, max_bytes=block))
        lexicon = tx.induce(documents(spark, rows).repartition(parts), labels(spark, marks), window=5, driver_edges=edges, broadcast_words=10**6 if edges else 0)
        got.append(dict(zip(lexicon.terms, lexicon.polarity)))
    assert got[0].keys() == want.keys() and got[0] == got[1]
    assert [got[0][t] for t in sorted(want)] == pytest.approx([want[t] for t in sorted(want)], abs=1e-6)
    assert [got[2][t] for t in sorted(want)] == pytest.approx([want[t] for t in sorted(want)], abs=1e-6)


def test_a_copied_text_brings_no_terms(spark):
    rows, toxic = corpus(700)
    rows += [(5000 + i, "grim " + " ".join(BAD)) for i in range(300)]
    lexicon = tx.induce(documents(spark, rows), labels(spark, [(i, toxic[i]) for i in range(500)]))
    assert "grim" not in lexicon.terms


def test_counts_match_loops():
    texts = ["x a y b x c z a", "a b a b a b", "q q q"]
    known = np.sort(words(pa.array(["a", "b", "x"])).hash)
    batch = pa.record_batch({"text": pa.array(texts)})
    name = {int(h): t for t, h in zip("abcxyzq", words(pa.array(list("abcxyzq"))).hash)}
    got = {}
    for out in tx._edges(known, 2)(iter([batch])):
        for key, n, _ in zip(*(c.to_pylist() for c in out.columns)):
            if key >= 0:
                pair = tuple(sorted((name[int(known[key // 3])], name[int(known[key % 3])])))
                got[pair] = got.get(pair, 0) + n
    want = {}
    for t in texts:
        w = t.split()
        for i in range(len(w)):
            for j in range(i + 1, min(i + 3, len(w))):
                if {w[i], w[j]} <= set("abx"):
                    key = tuple(sorted((w[i], w[j])))
                    want[key] = want.get(key, 0) + 1
    assert got == want


def test_awkward_rows(spark):
    rows = awkward()
    for marks in ([(904, 1), (905, 0), (900, 1), (None, 1), (901, None)], []):
        out = result(tx.score(documents(spark, rows), labels(spark, marks)))
        assert len(out) == len(rows) and all(s == 0 and not t for _, s, t in out)
    assert tx.score(documents(spark, []), labels(spark, [])).count() == 0
    lexicon = tx.Lexicon(words(pa.array(["word"])).hash, np.array([1.0]), ["word"], 0.5)
    out = {i: (s, t) for i, s, t in result(tx.score(documents(spark, rows), None, lexicon))}
    assert out[905] == (1.0, True) and out[904] == (0.0, False)
