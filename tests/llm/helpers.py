"""Small tables with the awkward rows that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the caller's table.
EXTRA = ["h1", "h2", "item_id", "_copy", "_hit", "score", "a", "b", "n", "term", "keep_id", "tokens", "ids"]


def documents(spark, rows):
    """Rows of (doc_id, text[, lang]) with extra columns whose names clash with the operators' own."""
    rows = [(*r, None)[:3] for r in rows]
    full = [(i, t, lang, "s", len(t) if t is not None else None, *range(len(EXTRA))) for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA + "".join(f", {c} int" for c in EXTRA))


def awkward(long_text="word other "):
    """Null and empty texts, a null id, repeated rows, a text without words, a very long text."""
    return [(900, None), (901, ""), (902, "  \n\t "), (903, "!!! ***"), (None, "text without an id"), (904, "a repeated row of text"), (904, "a repeated row of text"), (905, long_text * 20_000), (906, "Ünïcödé 漢字 тест 🙂 é")]


def result(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
