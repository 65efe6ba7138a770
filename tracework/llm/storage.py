"""Tables kept between jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import hadoop_path, shared_dir


def saved(df: DataFrame, *by: str) -> DataFrame:
    """The rows of ``df`` written as Parquet in the shared folder, in folders ``by`` column values, and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracework-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Removes a table that ``saved`` gave, once nothing reads it any more; other tables are left as they are."""
    if df is not None and hasattr(df, "_saved_at"):
        _remove(df.sparkSession, df._saved_at)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            system, place = hadoop_path(spark, path)
            system.delete(place, True)
    except Exception:  # the session has ended; its folder goes with it
        pass
