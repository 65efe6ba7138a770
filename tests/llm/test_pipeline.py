import corpus_pipeline
import numpy as np
import pytest

from tests.llm.helpers import documents
from tracework.llm import dedup, decontaminate, langid, packing, pii, queries


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    folder = tmp_path_factory.mktemp("sf")
    syllables = {"en": ["the", "ing", "ed", "on", "sh"], "de": ["sch", "ung", "ein", "ver", "keit"]}

    def text(lang, n=60):
        return " ".join("".join(rng.choice(syllables[lang], rng.integers(2, 5))) for _ in range(n))

    item = text("en", 20)
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200, rows[0][1], "en"), (201, rows[1][1] + " more", "de"), (300, text("en") + " " + item + " " + text("en"), "en"), (400, None, "en"), (401, "", "de"), (402, "漢字漢字 字漢漢 漢字字", None)]
    rows += [(500, text("en") + " mail me@mail.example.com now", "en")]
    spark.createDataFrame([(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_act_on_what_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    left = set(range(120)) | {200, 201, 300, 400, 401, 402, 500}
    gone = {"language": {400, 401, 402}, "near copies": {200, 201}, "benchmark": {300}, "personal data": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        left -= gone[name]
        assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} == left, name
    assert "me@mail" not in docs.where("doc_id = 500").first()["text"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == left
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_stages_match_the_operators(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    accepted = ids(langid.identify(docs).where("accepted"))
    assert ids(stages["language"](spark, docs, sf)) == accepted
    copies = {r[0] for r in dedup.near_duplicates(docs).collect()}
    assert ids(stages["near copies"](spark, docs, sf)) == sorted(set(ids(docs)) - copies)
    hits = {r["doc_id"] for r in decontaminate.contaminated_spans(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert ids(stages["benchmark"](spark, docs, sf)) == sorted(set(ids(docs)) - hits)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert {r["doc_id"]: r["text"] for r in stages["personal data"](spark, docs, sf).collect()} == clean
    assert stages["packing"](spark, docs, sf).count() == packing.pack(docs).count()


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(q.startswith(f"op{n}_") for q in found) for n in range(1, 11)] == [1] * 10 and "pipeline" in found
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_awkward_documents(spark, sf, tmp_path):
    """Null, repeated and clashing ids, empty and very long texts, equal rows, an empty benchmark and columns named as the operators' own."""
    rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120").collect())
    one, two = rows[0][1], rows[1][1]
    odd = [(None, one, "en"), (None, None, None), (None, "", None), (0, one, "en"), (3, two + " and more of it", "de"), (700, " ".join(t for _, t, _ in rows[2:60]) * 8, None), (701, two, "de"), (702, "!!! ***", None)]
    documents(spark, rows + odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(i for i, _ in left if i is not None) == sorted([*range(120), 700]) and [t for i, t in left if i is None] == [one]
    assert [t for i, t in left if i == 3] == [rows[3][1]] and [t for i, t in left if i == 0] == [one]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {None, *range(120), 700}
