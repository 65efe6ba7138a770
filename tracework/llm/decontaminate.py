"""Benchmark decontamination with one Aho-Corasick automaton (operator 1).

Test texts and documents are normalised alike: lower-cased, every run of
characters that are neither letters nor digits becomes one space.  The patterns
are all windows of ``ngram`` words of a test text, or the whole text where it
is shorter.  The automaton of all patterns scans each document once; hits are
mapped back through the normalisation to character offsets of the original
text, and overlapping windows of the same item are merged into one span.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import blocks, documents, only, utf8, word_bytes

NGRAM = 8
#: Shorter item texts give no pattern; at 1 even a one-word answer is matched, whole and between word borders.
MIN_WORDS = 1
#: Words of a passage from which a document counts as contaminated: shorter answers stand in any text by chance.
DROP_WORDS = 4
#: Pattern text one automaton holds; a larger benchmark is scanned in slices of this size.
SLICE_BYTES = 16 << 20

SCHEMA = "doc_id long, item_id long, start long, end long, n_words int"
_built: dict[str, tuple[ahocorasick.Automaton, list[np.ndarray]]] = {}


def normalised(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's normalised bytes (each word followed by one space), their places in the lower-cased bytes, the text each place belongs to, those bytes, and the texts' offsets."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    data, off = utf8(texts)
    inside = word_bytes(data)
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    at = np.flatnonzero(keep)
    norm = np.where(inside[at], data[at], 32).astype(np.uint8)
    return norm.tobytes(), at, np.searchsorted(off, at, side="right") - 1, data, off


def item_words(text: str | None) -> list[str]:
    """The normalised words of a test text, as UTF-8 read as Latin-1, the automaton's alphabet."""
    return normalised(pa.array([text], pa.string()))[0].decode("latin-1").split(" ")[:-1]


def patterns(items: Sequence[tuple[int, str | None]], ngram: int = NGRAM, min_words: int = MIN_WORDS) -> dict[str, tuple[int, list[int]]]:
    """Pattern text to (words in it, ids of the items that have it)."""
    found: dict[str, tuple[int, list[int]]] = {}
    for item, text in items:
        w = item_words(text)
        if item is None or len(w) < min_words:
            continue
        k = min(ngram, len(w))
        for i in range(len(w) - k + 1):
            ids = found.setdefault(" ".join(w[i : i + k]) + " ", (k, []))[1]
            if item not in ids:
                ids.append(item)
    return found


def slices_of(benchmark: DataFrame, ngram: int = NGRAM, min_words: int = MIN_WORDS, columns: Sequence[str] = ("text",)) -> list[dict]:
    """The patterns of a benchmark, in as many parts as their size asks for; one part at least."""
    rows = sorted((r[0], x or "") for r in only(benchmark, "item_id", *columns).toLocalIterator() if r[0] is not None for x in r[1:])
    slices: list[dict] = [{}]
    size, last = 0, None
    for item, text in rows:
        if size > SLICE_BYTES and item != last:  # an item stays whole, so that its windows can be merged
            slices.append({})
            size = 0
        last = item
        for pattern, (k, ids) in patterns([(item, text)], ngram, min_words).items():
            held = slices[-1].setdefault(pattern, (k, []))[1]
            held += [i for i in ids if i not in held]
            size += len(pattern)
    return slices


def _automaton(key: str, held: dict[str, tuple[int, list[int]]]) -> tuple[ahocorasick.Automaton, list]:
    if key not in _built:
        _built.clear()
        a, values = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for text, (_, ids) in held.items():
            a.add_word(text, len(values))
            values.append((len(text), np.array(ids, np.int64)))
        a.make_automaton()
        _built[key] = a, values
    return _built[key]


def spans(doc_ids: np.ndarray, texts: pa.Array, automaton: ahocorasick.Automaton, values: list) -> dict[str, np.ndarray]:
    """Merged hits of a block of texts."""
    norm, at, doc, data, off = normalised(texts)
    text = norm.decode("latin-1")
    rows = []
    for end, v in automaton.iter(text):
        size, ids = values[v]
        begin = end - size + 1
        if (begin == 0 or norm[begin - 1] == 32) and doc[begin] == doc[end]:
            rows += [(doc[begin], i, begin, end) for i in ids]
    if not rows:
        return {}
    d, i, b, e = np.array(rows, np.int64).T
    order = np.lexsort((b, i, d))
    d, i, b, e = d[order], i[order], b[order], e[order]
    group = np.append(0, np.cumsum((d[1:] != d[:-1]) | (i[1:] != i[:-1]))) * (len(norm) + 1)
    upto = np.maximum.accumulate(e + group)  # the furthest end so far in the same text and item
    new = np.append(True, (b + group)[1:] > upto[:-1])
    first = np.flatnonzero(new)
    d, i, b, e = d[first], i[first], b[first], np.maximum.reduceat(e, first)
    begins = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(begins)))  # characters before each byte
    start = chars[at[b]] - chars[off[d]]
    stop = chars[at[e - 1] + 1] - chars[off[d]]
    spaces = np.concatenate(([0], np.cumsum(np.frombuffer(norm, np.uint8) == 32)))
    return {"doc_id": doc_ids[d], "item_id": i, "start": start, "end": stop, "n_words": (spaces[e + 1] - spaces[b]).astype(np.int32)}


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, min_words: int = MIN_WORDS, columns: Sequence[str] = ("text",)) -> DataFrame:
    """(doc_id, item_id, start, end, n_words): each passage of a document that repeats ``ngram`` or more consecutive words of a test item.

    ``columns`` names the item's texts (question, answers, ...), each matched on
    its own.  Offsets count characters of the document's text, end exclusive.
    Null and empty texts, rows with a null ``doc_id`` and items with a null id
    give nothing; so do item texts of fewer than ``min_words`` words.  Item texts
    shorter than ``ngram`` words, as answers are, match whole; overlapping passages
    of one item are one span.  Very long texts are scanned whole.  Equal rows of the
    table give their spans once, and an item that several rows repeat counts once.
    An empty table on either side gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    hits = None
    for part in slices_of(benchmark, ngram, min_words, columns):
        held, key = spark.sparkContext.broadcast(part), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            if not held.value:
                return
            automaton, values = _automaton(key, held.value)
            for batch in batches:
                for block in blocks(batch):
                    if out := spans(block.column("doc_id").to_numpy(), block.column("text"), automaton, values):
                        yield pa.RecordBatch.from_pydict(out)

        got = docs.mapInArrow(scan, SCHEMA)
        hits = got if hits is None else hits.unionByName(got)
    return hits.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = DROP_WORDS) -> DataFrame:
    """The rows that hold no passage of a test item of at least ``min_words`` words, with the columns they came with.

    Texts are filtered where they are, without a join.  Rows with a null or empty
    text and a null ``doc_id`` stay, rows that repeat another go or stay with it,
    very long texts are scanned whole, and extra columns pass through.  An empty
    benchmark takes nothing away; an empty table gives no rows.
    """
    for part in slices_of(benchmark, min_words=min_words):
        held, key = docs.sparkSession.sparkContext.broadcast(part), uuid.uuid4().hex

        def keep(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[pa.RecordBatch]:
            automaton, values = _automaton(key, held.value) if held.value else (None, [])
            for batch in batches:
                for block in blocks(batch):
                    hit = spans(np.arange(block.num_rows), block.column("text"), automaton, values) if automaton else {}
                    ok = np.ones(block.num_rows, bool)
                    ok[hit.get("doc_id", np.zeros(0, int))] = False
                    yield block.filter(pa.array(ok))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_WORD = "[0-9A-Za-z\\x{c0}-\\x{1fff}\\x{2080}-\\x{2fff}\\x{3040}-\\x{10ffff}]+"


def _sql_words(table: str, key: str) -> str:
    """(key, i, word, start, end) of a table's distinct texts, by the lengths of the words and of what lies between them."""
    return f"""SELECT {key}, i, word, upto - length(word) AS start, upto AS "end", n FROM (
      SELECT *, sum(length(between_) + length(word)) OVER (PARTITION BY {key}, text ORDER BY i) AS upto FROM (
        SELECT {key}, text, unnest(ws) AS word, unnest(ss[1:len(ws)]) AS between_, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (
          SELECT {key}, text, regexp_extract_all(lower(text), '{_SQL_WORD}') AS ws, regexp_split_to_array(lower(text), '{_SQL_WORD}') AS ss
          FROM (SELECT DISTINCT {key}, text FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL))))"""


def _sql_grams(words: str, key: str) -> str:
    """Windows of MIN_WORDS to NGRAM words."""
    part = f"OVER (PARTITION BY {key} ORDER BY i)"
    return " UNION ALL ".join(
        f"""SELECT {key}, i, n, {k} AS k, start, lead("end", {k - 1}) {part} AS "end", concat_ws(' ', {", ".join(["word", *(f"lead(word, {j}) {part}" for j in range(1, k))])}) AS gram, lead(word, {k - 1}) {part} AS last FROM {words}"""
        for k in range(MIN_WORDS, NGRAM + 1)
    )


ORACLE = f"""
WITH dw AS ({_sql_words("documents", "doc_id")}), bw AS ({_sql_words("benchmark", "item_id")}),
b AS (SELECT DISTINCT item_id, k, gram FROM ({_sql_grams("bw", "item_id")}) WHERE last IS NOT NULL AND k = least(n, {NGRAM})),
d AS (SELECT * FROM ({_sql_grams("dw", "doc_id")}) WHERE last IS NOT NULL AND k IN (SELECT k FROM b)),
hit AS (SELECT doc_id, item_id, d.k, i, start, "end", CASE WHEN i <= max(i + d.k - 1) OVER w THEN 0 ELSE 1 END AS fresh FROM d JOIN b USING (gram, k) WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY i, d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY i, k ROWS UNBOUNDED PRECEDING) AS g FROM hit)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end", CAST(max(i + k) - min(i) AS INTEGER) AS n_words
FROM run GROUP BY doc_id, item_id, g
"""
