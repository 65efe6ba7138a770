"""Times the conversion of a numeric text file: rows and bytes a second, and the size of what is written.

    python bench_ingest.py FILE FOLDER
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tracework.sources.ingest import ingest


def main(path: str, root: str) -> None:
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '*')}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    row = ingest(spark, path, root).first()
    took = time.perf_counter() - began
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{root}/samples") for f in files)
    print(json.dumps({"rows": row["n_rows"], "seconds": round(took, 3), "rows_per_s": round(row["n_rows"] / took), "mb_per_s": round(os.path.getsize(path) / took / 1e6, 1), "stored_mb": round(size / 1e6, 1)}))
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:3])
