"""Information-theoretic sanitisation of personal data (operator 8).

Protected entities (mail addresses, telephone numbers, network addresses, card
and account numbers, secrets) are recognised by form, each of a class; names of
persons and street addresses have no such form and are not protected.  Numbers
count as accounts only with a card issuer's prefix and length, a checksum that
holds, a known grouping or a word such as "account" before them.  How
strongly a term t reveals a class c is estimated over the whole corpus from
co-occurrence within ``window`` words of an entity:

    disclosure(t, c) = log(N * n(t, c) / (n(t) * n(c))) / log(N / n(c))

with document counts, the pointwise mutual information over the information
that the class holds; 1 means that the term gives the class away, 0 that it
tells nothing.  An entity's own value always discloses 1 and is generalised to
its class.  In a document that holds an entity of c, a term is removed from
``REMOVE`` on, and generalised to the class's context from ``GENERALISE`` on.
Terms count only with ``MIN_SUPPORT`` distinct entity values, so that copies of
one document reveal nothing new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .storage import saved
from .text import WORD, blocks, documents, only, words

WINDOW = 8
MIN_SUPPORT = 5
GENERALISE = 0.75
REMOVE = 0.9
#: Candidate terms broadcast for counting; beyond it all words are counted and joined.
BROADCAST_TERMS = 4_000_000

#: What a document must hold to have any entity at all; the entities' own patterns run only there, so it has to match wherever ``ENTITY`` does.
#: It runs in RE2, whose \d and \s are ASCII only: \p{Nd} and the class of spaces stand for those of ``re``.
MAYBE = (
    r"@|\p{Nd}[\p{Nd} ().-]{5,}\p{Nd}|[A-Z]{2}\p{Nd}{2}(?: ?[A-Z0-9]{4}){2}|[0-9a-fA-F]{32}"
    r"|(?i:token|secret|password|passwd|key)[\s\v\x1c-\x1f\x{85}\p{Z}]*[=:]|AKIA|gh[pousr]_|sk-"
)
ENTITY = re.compile(
    r"(?P<MAIL>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<SECRET>(?i:\b(?:access[ _-]?|auth[ _-]?|api[ _-]?|secret[ _-]?|private[ _-]?)?(?:(?:password|passwd)\s*[=:]\s*[\"']?|(?:token|secret|key)\s*[=:]\s*[\"']?(?=[^\s\"'&<>]*\d)))(?P<value>[^\s\"'&<>]{6,})"
    r"|\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{20,})"
    r"|(?<![0-9A-Za-z])[0-9a-fA-F]{32,}(?![0-9A-Za-z]))"
    r"|(?P<NETWORK>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<PHONE>(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]\d{3,4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d[ ,])(?:\d{3} \d{3}[ -]\d{4}|(?!\d{3}-\d{2}-\d{4}(?!\w))0\d{1,4}(?:[ .-]\d{2,4}){2,4}))(?!\w|[.,]\d))"
    r"|(?P<ACCOUNT>(?<![\w.])(?:(?P<card>\d{13,19})|(?P<groups>\d{4}(?P<sep>[ -])\d{4}(?P=sep)\d{4}(?P=sep)\d{4}(?:(?P=sep)\d{3})?|\d{4}(?P<gap>[ -])\d{6}(?P=gap)\d{5})|(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<plain>\d{8,12}))(?!\w|[.,]\d)"
    r"|\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)\b)"
)
#: Words before a plain number of 8 to 12 digits that make it an account's.
_ACCOUNT_WORD = re.compile(r"(?i)\b(?:account|acct|card|iban|ssn|passport|konto|kontonummer|compte|carte|cuenta|tarjeta)\b\W{0,3}(?:(?:no|nr|num|number|numero|número|nummer)\b\W{0,3})?$")
#: Prefixes of the large card issuers with the lengths of their numbers.
_ISSUER = re.compile(r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|(?:6011|64[4-9]\d|65\d\d)\d{12}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}|62\d{14,17}")
_IBAN = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
_TERM = re.compile(WORD)


def _luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def _is_account(m: re.Match, text: str) -> bool:
    if m.group("iban"):
        code = m.group("iban").replace(" ", "")
        return _IBAN.get(code[:2]) == len(code) or 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    if whole := m.group("card") or m.group("groups"):
        digits = "".join(str(int(c)) for c in whole if c.isdigit())
        return bool(_ISSUER.fullmatch(digits)) or bool(m.group("card")) and len(digits) >= 14 and _luhn(digits)
    return bool(m.group("ssn")) or bool(_ACCOUNT_WORD.search(text, max(0, m.start() - 40), m.start()))


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of each protected entity, in order and apart from each other."""
    found = []
    at = 0
    while m := ENTITY.search(text, at):
        kind = next(k for k in ("MAIL", "SECRET", "NETWORK", "PHONE", "ACCOUNT") if m.group(k) is not None)
        at = m.end()
        if kind != "ACCOUNT" or _is_account(m, text):
            found.append((*(m.span("value") if m.group("value") is not None else m.span()), kind))
    return found


def _maybe(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)))


def _terms_before(text: str, edge: int, place: int, n: int) -> list[str]:
    """The last n terms between ``edge`` and ``place``, however far they are."""
    reach = 64 * n
    while True:
        low = max(edge, place - reach)
        terms = _TERM.findall(text, low, place)
        if low > edge:
            terms = terms[1:]  # it may begin before ``low``
        if len(terms) >= n or low == edge:
            return terms[-n:]
        reach *= 8


def _terms_after(text: str, place: int, edge: int, n: int) -> list[str]:
    return [m.group() for m in islice(_TERM.finditer(text, place, edge), n)]


def near_terms(text: str, found: list[tuple[int, int, str]], window: int) -> dict[tuple[str, str], set[str]]:
    """(class, term) to all entity values near which the term stands, outside all entities."""
    out: dict[tuple[str, str], set[str]] = {}
    for k, (start, end, kind) in enumerate(found):
        for step in (-1, 1):
            left, at, place = window, k, start if step < 0 else end
            while left:
                other = found[at + step] if 0 <= at + step < len(found) else None
                edge = (other[1] if step < 0 else other[0]) if other else (0 if step < 0 else len(text))
                terms = _terms_before(text, edge, place, left) if step < 0 else _terms_after(text, place, edge, left)
                for t in terms:
                    out.setdefault((kind, t.lower()), set()).add(text[start:end])
                left -= len(terms)
                if not other:
                    break
                at, place = at + step, (other[0] if step < 0 else other[1])
    return out


def _scan(window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                texts = block.column("text")
                kinds, terms, values, first = [], [], [], []  # first: one row a document and term
                for i in _maybe(texts):
                    text = texts[i].as_py()
                    found = entities(text)
                    for kind in {k for _, _, k in found}:
                        kinds.append(kind), terms.append(None), values.append(None), first.append(True)
                    for (kind, term), own in near_terms(text, found, window).items():
                        for k, value in enumerate(own):
                            kinds.append(kind), terms.append(term), values.append(value), first.append(k == 0)
                if kinds:
                    yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(terms, pa.string()), pa.array(values, pa.string()), pa.array(first)], ["class", "term", "value", "first"])

    return scan


def _counts(docs: DataFrame, terms: list[str] | None) -> DataFrame:
    """(h, n): documents that hold each word, for the given words or for all."""
    known = None if terms is None else np.unique(words(pa.array(terms, pa.string())).hash)
    bits = np.zeros(1 << 20, bool)
    if known is not None:
        bits[known & np.uint64(bits.size - 1)] = True
    held = docs.sparkSession.sparkContext.broadcast((known, bits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = held.value
        total = np.zeros(0 if known is None else len(known), np.int64)
        for batch in batches:
            for block in blocks(batch):
                w = words(block.column("text"))
                h, doc = w.hash, w.doc
                if known is not None:
                    may = np.flatnonzero(bits[h & np.uint64(bits.size - 1)])
                    at = np.searchsorted(known, h[may])
                    ok = known[np.minimum(at, len(known) - 1)] == h[may] if len(known) else np.zeros(0, bool)
                    key = np.unique(doc[may][ok] * len(known) + at[ok])
                    total += np.bincount(key % max(len(known), 1), minlength=len(known))
                elif len(h):
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    h, n = np.unique(h[np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))], return_counts=True)
                    yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
        if known is not None and total.any():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(known[at].view(np.int64)), pa.array(total[at])], ["h", "n"])

    return docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def disclosures(docs: DataFrame, window: int = WINDOW, min_support: int = MIN_SUPPORT, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(class, term, support, n_both, n_term, n_class, disclosure) for each term near ``min_support`` distinct entity values of a class, over all documents."""
    docs = only(docs, "text").where("text is not null")
    found = saved(docs.mapInArrow(_scan(window), "class string, term string, value string, first boolean"))
    classes = found.where("term is null").groupBy("class").agg(F.count("*").alias("n_class"))
    near = saved(found.where("term is not null").groupBy("class", "term").agg(F.count_if("first").alias("n_both"), F.countDistinct("value").alias("support")).where(F.col("support") >= min_support))
    total = docs.count()
    terms = None
    if near.select("term").distinct().count() <= broadcast_terms:
        terms = [r[0] for r in near.select("term").distinct().toLocalIterator()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column("term"))
            ok = np.flatnonzero(np.diff(w.ptr))  # one word each
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(ok)) for c in b.columns), pa.array(w.hash[w.ptr[ok]].view(np.int64))], [*b.schema.names, "h"])

    near = near.mapInArrow(hashed, "class string, term string, n_both long, support long, h long")
    gain = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_class")))
    held = F.log(F.lit(float(total)) / F.col("n_class"))
    return (
        near.join(saved(_counts(docs, terms)).withColumnRenamed("n", "n_term"), "h")
        .join(F.broadcast(classes), "class")
        .select("class", "term", "support", "n_both", "n_term", "n_class", F.when(F.col("n_class") < total, gain / held).otherwise(0.0).alias("disclosure"))
    )


def clean_text(text: str, terms: dict[tuple[str, str], bool]) -> tuple[str, int, int, list[str]]:
    """The sanitised text, how many entities and how many terms were replaced, and the classes found.

    ``terms`` has (class, term) to whether the term is removed, else generalised.
    """
    found = entities(text)
    kinds = sorted({k for _, _, k in found})
    n_terms = 0

    def replaced(m: re.Match) -> str:
        nonlocal n_terms
        hit = [(k, terms[k, m.group().lower()]) for k in kinds if (k, m.group().lower()) in terms]
        if not hit:
            return m.group()
        n_terms += 1
        return "[REMOVED]" if any(gone for _, gone in hit) else f"[{hit[0][0]} CONTEXT]"

    out, at = [], 0
    for start, end, kind in [*found, (len(text), len(text), "")]:
        between = text[at:start]
        out.append(_TERM.sub(replaced, between) if terms and found else between)
        if kind:
            out.append(f"[{kind}]")
        at = end
    return "".join(out), len(found), n_terms, kinds


def _held_terms(docs: DataFrame) -> dict[tuple[str, str], bool]:
    rows = disclosures(docs).where(F.col("disclosure") >= GENERALISE).select("class", "term", F.col("disclosure") >= REMOVE)
    return {(c, t): gone for c, t, gone in rows.toLocalIterator()}


def sanitise(docs: DataFrame, terms: dict[tuple[str, str], bool] | None = None) -> DataFrame:
    """(doc_id, text, n_entities, n_terms, classes) for every row: the text with entities generalised to their class and revealing terms generalised or removed.

    A document without an entity keeps its text to the letter.  A null text stays
    null and an empty one empty, with zero counts; null and repeated ``doc_id``
    are answered row by row.  Very long texts are treated whole.  An empty table
    gives no rows.  Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(_held_terms(docs) if terms is None else terms)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                texts, n, m, kinds = _cleaned(block.column("text"), held.value)
                yield pa.record_batch([block.column("doc_id"), texts, pa.array(n), pa.array(m), pa.array(kinds, pa.list_(pa.string()))], ["doc_id", "text", "n_entities", "n_terms", "classes"])

    return only(docs, "doc_id", "text").mapInArrow(apply, "doc_id long, text string, n_entities int, n_terms int, classes array<string>")


def _cleaned(texts: pa.Array, terms: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, list[list[str]]]:
    n, m, kinds = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32), [[] for _ in range(len(texts))]
    changed: dict[int, str] = {}
    for i in _maybe(texts):
        out, n[i], m[i], kinds[i] = clean_text(texts[i].as_py(), terms)
        if n[i]:
            changed[i] = out
    if changed:
        mask = np.zeros(len(texts), bool)
        mask[list(changed)] = True
        texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], texts.type))
    return texts, n, m, kinds


def sanitised_documents(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, ``text`` sanitised and ``n_chars``, where there is one, its new length.

    Every row stays: null and empty texts as they are, a null or repeated ``doc_id``
    row by row, very long texts as a whole, extra columns untouched.  An empty
    table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(_held_terms(docs))
    names = docs.columns

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for block in blocks(batch):
                columns = list(block.columns)
                columns[at] = _cleaned(block.column("text"), held.value)[0]
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pc.utf8_length(columns[at]).cast(columns[k].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(apply, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return sanitise(documents(spark, sf_dir))
