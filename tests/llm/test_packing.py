import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import awkward, documents, result
from tracework.llm import packing


@given(st.lists(st.integers(0, 100_000), max_size=20), st.integers(0, 13))
def test_lengths_are_the_binary_form(sizes, top):
    length, doc = packing.piece_lengths(np.array(sizes, np.int64), 1 << top)
    for i, n in enumerate(sizes):
        own = length[doc == i].tolist()
        assert sum(own) == n and own == sorted(own, reverse=True)
        assert all(x & (x - 1) == 0 and x <= 1 << top for x in own)
        small = [x for x in own if x < 1 << top]
        assert len(small) == len(set(small))


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from(["'", "s", "t", "r", "e", "v", "l", "m", "d", "L", " ", "\n", "\t", "\x85", "\x1c", "\u00a0", "é", "漢", "\u0301", "1", "²", "!", "🙂", "\u0378", "x"]), max_size=12), max_size=5))
def test_ids_of_blocks_are_those_of_each_text(texts):
    texts = [*texts, None, "word " * 9 + "x" * 100]
    ids, size = packing.block_ids(packing.TOKENIZER, pa.array(texts))
    want = [packing.token_ids(packing.TOKENIZER, t or "").tolist() for t in texts]
    assert size.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_pieces_that_take_each_others_slot(monkeypatch):
    monkeypatch.setattr(packing, "_SLOTS", 4)
    monkeypatch.setattr(packing, "_caches", {})
    texts = ["one two three four five six one two", "six five seven eight nine", "one two", "x" * 200 + " one"] * 3
    for text in texts:
        assert packing.block_ids(packing.TOKENIZER, pa.array([text]))[0].tolist() == packing.token_ids(packing.TOKENIZER, text).tolist()


def test_round_trip(spark):
    rows = [(1, "Hello world, this is it."), (2, "é" * 5000), *awkward()]
    out = result(packing.pack(documents(spark, rows), max_length=64, batch_tokens=128), "doc_id", "piece")
    enc = packing.encoder()
    by_doc = {}
    for length, _, doc, piece, first, tokens in out:
        assert len(tokens) == length and length & (length - 1) == 0
        by_doc.setdefault(doc, []).append((piece, first, tokens))
    texts = {i: t for i, t in rows if t}
    texts[904] *= 2  # the repeated row is packed again
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = [x for _, _, tokens in sorted(pieces, key=lambda p: p[:2]) for x in tokens] if doc != 904 else None
        if ids is not None:
            assert ids[-1] == packing.END_OF_TEXT and enc.decode(ids[:-1]) == texts[doc]
            assert [f for _, f, _ in sorted(pieces)] == np.cumsum([0, *(len(t) for _, _, t in sorted(pieces)[:-1])]).tolist()


def test_batches_hold_one_length_and_are_full(spark):
    rows = [(i, "some words in a text " * (i % 9 + 1)) for i in range(300)]
    out = packing.pack(documents(spark, rows), max_length=32, batch_tokens=64).toPandas()
    each = out.groupby("batch").agg(n=("length", "size"), kinds=("length", "nunique"), length=("length", "first"))
    assert (each.kinds == 1).all() and (each.n <= 64 // each.length).all()
    short = each[each.n < 64 // each.length]
    assert len(short) <= 6 * documents(spark, rows).rdd.getNumPartitions()


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0
