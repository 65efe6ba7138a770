import re

from tests.llm.helpers import awkward, documents, result
from tracework.llm import decontaminate as dc
from tracework.llm.text import WORD

ITEM = "The quick brown fox, jumps over the lazy dog while seven wise owls watch."
ITEMS = [(1, ITEM), (2, "Four words are enough"), (3, "too short"), (4, None), (None, ITEM), (5, ITEM)]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, items, ngram=dc.NGRAM, least=dc.MIN_WORDS):
    """Windows compared one by one; maximal runs of matched windows."""
    word = re.compile(WORD)
    out = set()
    for doc, text in rows:
        if doc is None or not text:
            continue
        found = [(m.group().lower(), m.start(), m.end()) for m in word.finditer(text)]
        for item, wanted in items:
            w = [x.lower() for x in word.findall(wanted or "")]
            if item is None or len(w) < least:
                continue
            k = min(ngram, len(w))
            grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            last = None
            for i in range(len(found) - k + 2):
                if i <= len(found) - k and tuple(x for x, _, _ in found[i : i + k]) in grams:
                    begin = i if last is None or i > last + k - 1 else begin
                    if last is not None and i > last + k - 1:
                        out.add((doc, item, found[first][1], found[last + k - 1][2], last + k - first))
                        last = None
                    if last is None:
                        first = i
                    last = i
                elif last is not None and (i > last + k - 1 or i > len(found) - k):
                    out.add((doc, item, found[first][1], found[last + k - 1][2], last + k - first))
                    last = None
    return out


def test_matches_brute_force(spark):
    rows = [
        (1, f"before {ITEM} after"), (2, ITEM.upper().replace(" ", " *** ")), (3, "Çà été: " + ITEM.replace("fox,", "fox\n")), (4, "jumps over the lazy dog while seven wise people"),
        (5, "the quick brown fox jumps over the"), (6, f"{ITEM} {ITEM}"), (7, "four words are enough"), (8, "xfour words are enough"), (9, "four words are enoughx"),
        (10, "four words are"), (11, "enough"), *awkward(),
    ]
    got = set(result(dc.contaminated_spans(documents(spark, rows), benchmark(spark))))
    assert got == brute(rows, ITEMS)
    assert {i for i, *_ in got} == {1, 2, 3, 4, 6, 7}


def test_offsets_are_of_the_original_text(spark):
    text = "É Ünï 漢字 🙂 — four — WORDS, are\n(enough)! é"
    [(_, _, a, b, n)] = result(dc.contaminated_spans(documents(spark, [(1, text)]), benchmark(spark)))
    assert text[a:b] == "four — WORDS, are\n(enough" and n == 4


def test_slices_find_the_same(spark, monkeypatch):
    docs = documents(spark, [(1, ITEM), (2, "four words are enough")])
    whole = sorted(result(dc.contaminated_spans(docs, benchmark(spark))))
    monkeypatch.setattr(dc, "SLICE_BYTES", 50)
    assert sorted(result(dc.contaminated_spans(docs, benchmark(spark)))) == whole
    assert dc.drop_contaminated(docs, benchmark(spark)).count() == 0


def test_drops_only_contaminated_rows(spark):
    rows = [(1, ITEM), (2, "clean text"), (None, "no id"), *awkward()]
    left = dc.drop_contaminated(documents(spark, rows), benchmark(spark))
    assert left.count() == len(rows) - 1 and left.columns == documents(spark, []).columns and left.where("doc_id = 1").count() == 0


def test_empty_tables(spark):
    assert dc.contaminated_spans(documents(spark, []), benchmark(spark)).count() == 0
    docs = documents(spark, [(1, ITEM)])
    assert dc.contaminated_spans(docs, benchmark(spark, [])).count() == 0
    assert dc.drop_contaminated(docs, benchmark(spark, [])).count() == 1


def test_answers_are_matched_too(spark):
    items = spark.createDataFrame([(1, "what is it that is asked here", "an answer of several words")], "item_id long, question string, answer string")
    docs = documents(spark, [(1, "is an answer of several words then"), (2, "so what is it that is asked here")])
    assert [r[0] for r in result(dc.contaminated_spans(docs, items, columns=("question", "answer")), "doc_id")] == [1, 2]


def test_texts_of_one_item_merge_and_one_word_is_an_answer(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h", "c d e f", "h i j k", "Paris!"), (2, None, "", "forty two", "h i j k")], "item_id long, q string, a string, b string, c string")
    text = "x a b c d e f g h i j k then parisian (PARIS) forty two"
    docs = documents(spark, [(1, text), (2, "paris-forty twofold")])
    got = result(dc.contaminated_spans(docs, items, columns=("q", "a", "b", "c")), "doc_id", "item_id", "start")
    assert [(d, i, text[a:b] if d == 1 else None, n) for d, i, a, b, n in got] == [(1, 1, "a b c d e f g h i j k", 11), (1, 1, "PARIS", 1), (1, 2, "h i j k", 4), (1, 2, "forty two", 2), (2, 1, None, 1)]


def test_a_short_answer_alone_drops_nothing(spark):
    docs = documents(spark, [(1, "too short to tell"), (2, "four words are enough here")])
    assert [r["doc_id"] for r in dc.drop_contaminated(docs, benchmark(spark)).collect()] == [1]
