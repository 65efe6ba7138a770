import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import awkward, documents, result
from tracework.llm import langid
from tracework.llm.text import words

RNG = np.random.default_rng(3)
SYLLABLES = {"aa": ["ka", "ra", "to", "mi", "sen"], "bb": ["sch", "ung", "ein", "ver", "keit"], "cc": ["ción", "ñar", "que", "os", "ez"]}


def text(lang, n=80):
    return " ".join("".join(RNG.choice(SYLLABLES[lang], RNG.integers(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(SYLLABLES) * 40)]
    return langid.train(documents(spark, rows))


def test_held_out_accuracy(spark, trained):
    rows = [(i, text(lang, 20), lang) for i, lang in enumerate(list(SYLLABLES) * 30)]
    got = {r["doc_id"]: r for r in langid.identify(documents(spark, rows), trained).collect()}
    assert np.mean([got[i]["lang"] == lang for i, _, lang in rows]) > 0.98
    assert all(got[i]["accepted"] for i, _, _ in rows)
    assert np.mean([len(got[i]["langs"]) == 1 for i, _, _ in rows]) > 0.9


def test_mixture_proportions(spark, trained):
    rows = [(1, text("aa", 300) + " " + text("bb", 100)), (2, " ".join(text(x, 100) for x in SYLLABLES))]
    one, two = langid.identify(documents(spark, rows), trained).orderBy("doc_id").collect()
    assert one["langs"] == ["aa", "bb"] and one["shares"] == pytest.approx([0.75, 0.25], abs=0.05)
    assert sorted(two["langs"]) == list(SYLLABLES) and two["shares"] == pytest.approx([1 / 3] * 3, abs=0.05)


def test_em_matches_a_plain_loop(trained):
    w = langid.letters(words(pa.array([text("aa", 30) + " " + text("bb", 15)])))
    code, begin = langid.trigrams(w)
    score = np.stack([np.add.reduceat(row[code], begin) for row in trained.logp], axis=1)
    p = np.exp(score - score.max(1, keepdims=True))
    pi, ll = langid.fit(p, np.array([0, len(p)]), np.ones((1, 4), np.float32))
    want = np.full(4, 0.25)
    for _ in range(langid.ITERATIONS):
        total = np.zeros(4)
        for row in p.astype(float):
            total += row * want / (row * want).sum()
        want = total / len(p)
    assert pi[0] == pytest.approx(want, abs=1e-4)
    assert ll[0] == pytest.approx(np.log((p * want).sum(1)).sum(), abs=1e-2)


def test_awkward_rows(spark, trained):
    rows = [*awkward(), (910, "12345 678 99-00"), (911, "漢字漢字 漢字 字漢漢 漢字字")]
    out = {}
    for r in langid.identify(documents(spark, rows), trained).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == len(rows) and len(out[904]) == 2
    for i in (900, 901, 902, 903, 910):
        assert (out[i][0]["lang"], out[i][0]["langs"], out[i][0]["n_words"], out[i][0]["accepted"]) == ("und", [], 0, False)
    assert out[911][0]["lang"] == "und" and not out[911][0]["accepted"]
    kept = langid.keep_identified(documents(spark, rows), trained)
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(str(r["doc_id"]) for rs in out.values() for r in rs if r["accepted"])
    assert kept.columns == documents(spark, []).columns


def test_without_labels_or_rows(spark):
    assert langid.identify(documents(spark, [])).count() == 0
    assert result(langid.identify(documents(spark, [(1, "some text")])).select("lang", "accepted")) == [("und", False)]


def test_the_set_is_the_best_of_all_by_penalised_likelihood(trained):
    from itertools import combinations

    texts = [text("aa", 40), text("aa", 60) + " " + text("cc", 30), " ".join(text(x, 40) for x in SYLLABLES), text("bb", 50) + " 漢字漢 字漢字漢 漢漢字字", text("cc", 3)]
    w = langid.letters(words(pa.array(texts)))
    _, got = langid.mixtures(w, trained)
    code, begin = langid.trigrams(w)
    score = np.stack([np.add.reduceat(row[code], begin) for row in trained.logp], axis=1).astype(float)
    for i in range(len(texts)):
        own = score[w.ptr[i] : w.ptr[i + 1]]
        p = np.exp(own - own.max(1, keepdims=True))
        best = {}
        for size in range(1, 5):
            for chosen in combinations(range(4), size):
                part = np.array([1 / size if k in chosen else 0 for k in range(4)])
                for _ in range(200):  # until it stands still
                    r = p * part
                    part = (r / np.maximum(r.sum(1, keepdims=True), 1e-300)).mean(0)
                best[chosen] = -2 * np.log(np.maximum((p * part).sum(1), 1e-30)).sum() + (size - 1) * langid.PENALTY * np.log(max(len(p), 2))
        assert tuple(np.flatnonzero(got[i])) == min(best, key=best.get), texts[i]
