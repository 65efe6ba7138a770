"""Wide numeric text files into a chunked Parquet layout with statistics for each chunk.

Under a root folder lie three tables:

``recordings``   one row for each file: columns, rows, lines skipped, time range, fingerprint
``samples``      row_id, chunk_id, t, ch0, ch1, ..., by recording and bucket of chunks
``chunk_stats``  zone map and partial aggregates of each chunk and channel
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..frame import Series, finite, lagged, numbered
from ..operators.stats import chunk_stats
from ..shared import hadoop_path

ROWS_PER_CHUNK = 100_000
CHUNKS_PER_BUCKET = 64
_NUMBER = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def recording_id(path: str) -> str:
    """A name for the whole path, so that files of one stem stay apart."""
    return hashlib.sha256(path.encode()).hexdigest()[:16]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _block, _at): lines without their line ends, and their place in the file, or in a folder's files by name."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.regexp_replace("value", r"\r$", "").alias("value"), F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))


def count_columns(spark: SparkSession, path: str) -> int:
    """Fields of the first line that is not blank; 0 for a file without one."""
    row = lines(spark, path).where(F.trim("value") != "").orderBy("_block", "_at").select(F.size(F.split(F.trim("value"), ",", -1))).first()
    return row[0] if row else 0


def number(field: Column) -> Column:
    """A field as a double, without blanks and one pair of quotes; NaN where it is no number."""
    text = F.trim(F.regexp_replace(F.trim(field), r'^"(.*)"$', "$1"))
    return F.coalesce(F.when(text.rlike(_NUMBER), text.try_cast("double")), F.lit(float("nan")))


def parse_lines(text: DataFrame, n_cols: int, keep: Sequence[str] = ()) -> DataFrame:
    """(.., _ok, t, ch0, ..) of the lines in ``value`` that are not blank; ``_ok`` is false where the number of fields differs."""
    split = text.where("value <> ''").withColumn("_f", F.split("value", ",", -1))
    names = ["t", *(f"ch{i}" for i in range(n_cols - 1))]
    return split.select(*keep, (F.size("_f") == n_cols).alias("_ok"), *(number(F.get("_f", F.lit(i))).alias(n) for i, n in enumerate(names)))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Hash of the path, sizes and times of change of the file or a folder's files, as the file system tells them: no line is read."""
    system, place = hadoop_path(spark, path)
    files = [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in system.listStatus(place) if not x.getPath().getName().startswith(("_", "."))]
    return hashlib.sha256(repr(sorted(files)).encode()).hexdigest()


def ingest(spark: SparkSession, path: str, root: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Converts a file; its row of ``recordings``.

    Lines with another number of fields than the first are dropped and counted,
    fields that are no numbers become NaN.  Rows keep the file's order as a dense
    ``row_id``.  A file without rows, or with fewer than two columns, is an error.
    """
    n_cols = count_columns(spark, path)
    if n_cols < 2:
        raise ValueError(f"{path} has {n_cols} columns; a time and a channel are needed")
    name = recording_id(path)
    staged = f"{root}/_staging/{name}"
    parse_lines(lines(spark, path), n_cols, ["_block", "_at"]).write.mode("overwrite").parquet(staged)  # once: places in the file must not change between jobs
    rows = spark.read.parquet(staged)
    names = [f"ch{i}" for i in range(n_cols - 1)]
    place = Series(t="_at", row="_at", chunk="_block")
    samples = numbered(rows.where("_ok").drop("_ok"), place, "row_id").withColumn("row_id", F.col("row_id") - 1)
    samples = samples.withColumn("chunk_id", F.floor(F.col("row_id") / rows_per_chunk).cast("int"))
    samples = samples.select(F.lit(name).alias("recording_id"), F.floor(F.col("chunk_id") / CHUNKS_PER_BUCKET).cast("int").alias("chunk_bucket"), "chunk_id", "row_id", "t", *names)
    ordered = samples.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id", "row_id")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id", "chunk_bucket").parquet(f"{root}/samples")
    own = read_samples(spark, root, name)
    s = Series(by=("recording_id",), chunk="chunk_id")
    chunk_stats(own, s, names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").parquet(f"{root}/chunk_stats")
    t = F.when(finite("t"), F.col("t"))
    back = lagged(own.where(finite("t")), Series(t="row_id", by=("recording_id",), chunk="chunk_id"), "_p", "t").where(F.col("t") < F.col("_p.t"))
    told = own.groupBy("recording_id").agg(F.count("*").alias("n_rows"), F.min(t).alias("x_min"), F.max(t).alias("x_max"), (F.max("chunk_id") + 1).alias("n_chunks"))
    if told.isEmpty():
        raise ValueError(f"{path} has no row with {n_cols} fields")
    skipped, falls = rows.where("not _ok").count(), not back.isEmpty()
    told = told.select(
        F.lit(path).alias("source_path"), F.lit(fingerprint(spark, path)).alias("fingerprint"), "n_rows", F.lit(skipped).cast("long").alias("n_skipped"), F.lit(n_cols).alias("n_cols"),
        F.array(*(F.lit(f"column_{i + 1}") for i in range(n_cols))).alias("columns"), "x_min", "x_max", "n_chunks", F.lit(rows_per_chunk).cast("long").alias("rows_per_chunk"), F.lit(not falls).alias("is_monotone"), "recording_id",
    )
    hadoop_path(spark, staged)[0].delete(hadoop_path(spark, staged)[1], True)
    told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").parquet(f"{root}/recordings")
    return recordings(spark, root).where(F.col("recording_id") == name)


def recordings(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/recordings").withColumn("recording_id", F.col("recording_id").cast("string"))


def read_samples(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One recording's samples; chunk buckets outside a later filter are not opened."""
    return spark.read.option("basePath", f"{root}/samples").parquet(f"{root}/samples/recording_id={name}").withColumn("recording_id", F.lit(name))


def read_chunk_stats(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{root}/chunk_stats").parquet(f"{root}/chunk_stats/recording_id={name}").withColumn("recording_id", F.lit(name))


def open_recording(spark: SparkSession, path: str, root: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(its row of ``recordings``, samples, chunk statistics) of a file, converted only if it is new or has changed."""
    name = recording_id(path)
    row = _known(spark, root, name)
    if row is None or row.first()["fingerprint"] != fingerprint(spark, path):
        row = ingest(spark, path, root, rows_per_chunk)
    return row, read_samples(spark, root, name), read_chunk_stats(spark, root, name)


def _known(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    system, folder = hadoop_path(spark, f"{root}/recordings/recording_id={name}")
    if not system.exists(folder):
        return None
    return recordings(spark, root).where(F.col("recording_id") == name)
