"""Corpus preparation: stages that each read what the one before kept.

``STAGES`` names them in order; each is a function of (spark, docs, sf_dir).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracework.llm import decontaminate, dedup, langid, packing, pii
from tracework.llm.storage import saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go, and with them null, empty and wordless texts; a null ``doc_id`` and repeated rows are judged row by row."""
    return langid.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least ``doc_id``; rows with a null one stay, rows that share one are judged by their texts."""
    return dedup.drop_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark of four words or more go; an empty benchmark takes none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are generalised or removed; every document stays, also one that is null or empty."""
    return pii.sanitised_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left; null and empty texts have none, and a row that repeats another is packed again."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("personal data", sanitise),
    ("packing", pack),
]

#: The stages score, group and tokenise beyond SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table; each but the last is written to the shared folder and read again.

    Texts are taken whole however long, extra columns pass through all stages but
    the last whatever their names, and an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
