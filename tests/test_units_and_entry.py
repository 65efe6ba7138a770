import math
import os
import re
import shutil
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from tracework.functions import units
from tracework.streaming.windows import windowed_partials, windowed_stats

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_format_si(spark):
    cases = {1.5e12: "1.5000 TV", 999.0e6: "0.9990 GV", 2.5e6: "2.5000 MV", 999.0: "0.9990 kV", 0.9991: "0.9991 V", 5e-3: "5.0000 mV", 2e-6: "2.0000 uV", -3e-9: "-3.0000 nV", 1e-12: "1.0000 pV", 1.5e-13: "1.5000e-13 V", 0.0: "0 V", math.nan: "---", math.inf: "---", None: None}
    assert column(spark, list(cases), lambda c: units.format_si(c, "V")) == list(cases.values())


def test_format_voltage_and_scientific(spark):
    assert column(spark, [0.0, 0.5, -0.25, 1.0, 12.3456], units.format_voltage) == ["0.000 V", "500.000 mV", "-250.000 mV", "1.000 V", "12.346 V"]
    assert column(spark, [1.5e-7, 2e10, 1.0], lambda c: units.scientific(c, 3)) == ["1.500e-7", "2.000e10", "1.000e0"]


def test_units(spark):
    for unit in units.TIME:
        assert column(spark, [2.0], lambda c: units.to_seconds(units.from_seconds(c, unit), unit))[0] == pytest.approx(2.0)
    for unit in units.VOLTAGE:
        assert column(spark, [2.0], lambda c: units.to_volts(units.from_volts(c, unit), unit))[0] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        units.to_seconds(F.lit(1), "h")
    assert units.cursor_places(0.0, 10.0) == (3.5, 6.5) and units.per_division(10.0) == 1.0
    assert column(spark, [0.0, 4.0], lambda c: units.cursor_delta(c, F.lit(0.0))[1]) == [None, 0.25]


def test_streamed_windows_equal_batch(spark, tmp_path):
    rows = [(i, float(i % 13) if i % 7 else math.nan, "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "s long, v double, k string").select(F.timestamp_seconds("s").alias("ts"), "v", "k")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_partials(stream, "ts", "v", "1 minute", late="1 hour", by=["k"]).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    batch = windowed_partials(df, "ts", "v", "1 minute", by=["k"])
    assert sorted(map(str, spark.table("w").collect())) == sorted(map(str, batch.collect())) and batch.count() == 20
    assert windowed_stats(df, "ts", "v", "1 minute", "30 seconds").count() == 21


def test_library_does_not_need_the_corpus_part():
    for folder, _, files in os.walk(f"{ROOT}/tracework"):
        if os.path.basename(folder) != "llm" and "/llm/" not in folder + "/":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", open(f"{folder}/{f}").read(), re.M), f


def test_entry_without_the_corpus_part(tmp_path):
    for name in ("tracework", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{name}") else shutil.copy)(f"{ROOT}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tracework/llm", ignore_errors=True)
    code = textwrap.dedent("""
        import __spark_entry__ as e
        q, o = e.queries(), e.oracle_sql()
        assert len(q) > 60 and set(o) == set(q) and 'pipeline' not in q and not [k for k in q if k.startswith('op')]
    """)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_entry_runs(spark):
    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert e.entry(spark).count() == 5 and set(e.oracle_sql()) <= set(e.queries())


def test_queries_match_their_sql(spark):
    import duckdb

    from tracework.plans import recordings, waveform

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    db = duckdb.connect()
    for t in ("events", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    text = lambda x: "" if x is None or x != x else repr(float(x) + 0.0) if isinstance(x, float) else str(x)
    sql = waveform.ORACLE_SQL | recordings.ORACLE_SQL
    for name, query in (waveform.QUERIES | recordings.QUERIES).items():
        got, want = query(spark, folder).toPandas(), db.execute(sql[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        rows = [sorted(tuple(map(text, r)) for r in x[cols].itertuples(index=False)) for x in (got, want)]
        assert rows[0] == rows[1], name
