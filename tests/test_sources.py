import math
import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tracework.frame import Series
from tracework.operators import stats
from tracework.sources import codec, export, ingest

DIRTY = 't,a,b\r\n0.5, 1.5 ,"2.5"\n\n1.0,2.0\n1.5,,x\n2.0,1.0d,inf\n2.5,nan,-1e-3,9\n3.0,+4,.5\r\n'


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def same(a, b):
    return len(a) == len(b) and all(np.array_equal(np.array(x, float), np.array(y, float), equal_nan=True) for x, y in zip(a, b))


def test_dirty_file(spark, tmp_path):
    path, root = write(tmp_path / "dirty.csv", DIRTY), str(tmp_path / "store")
    row = ingest.ingest(spark, path, root, rows_per_chunk=2).first()
    assert (row["n_rows"], row["n_skipped"], row["n_cols"], row["n_chunks"], row["is_monotone"]) == (5, 2, 3, 3, True)
    assert row["columns"] == ["column_1", "column_2", "column_3"] and (row["x_min"], row["x_max"]) == (0.5, 3.0)
    nan = math.nan
    got = [tuple(r) for r in ingest.read_samples(spark, root, row["recording_id"]).orderBy("row_id").select("row_id", "t", "ch0", "ch1").collect()]
    assert same(got, [(0, nan, nan, nan), (1, 0.5, 1.5, 2.5), (2, 1.5, nan, nan), (3, 2.0, nan, math.inf), (4, 3.0, 4.0, 0.5)])


@pytest.mark.parametrize("rows_per_chunk", [1, 7, 1000])
def test_chunks_do_not_change_results(spark, tmp_path, rows_per_chunk):
    rng = np.random.default_rng(3)
    data = np.column_stack([np.arange(200) * 0.01, rng.normal(0, 1, (200, 2))])
    path = write(tmp_path / "x.csv", "".join(",".join(map(repr, r.tolist())) + "\n" for r in data))
    row, samples, kept = ingest.open_recording(spark, path, str(tmp_path / "store"), rows_per_chunk)
    got = np.array(samples.orderBy("row_id").select("t", "ch0", "ch1").collect())
    assert np.array_equal(got, data) and row.first()["n_chunks"] == -(-200 // rows_per_chunk)
    s = Series(by=("recording_id",), chunk="chunk_id")
    for r in stats.stats_from_chunks(samples, kept, s, ["ch0", "ch1"], 0.255, 1.745).collect():
        part = data[(data[:, 0] >= 0.255) & (data[:, 0] <= 1.745), 1 + int(r["ch"][2:])]
        assert (r["vmin"], r["vmax"], r["n"]) == (part.min(), part.max(), len(part))
        assert r["rms"] == pytest.approx(np.sqrt((part**2).mean()))


def test_many_splits_keep_the_order(spark, tmp_path):
    path = write(tmp_path / "long.csv", "".join(f"{i},{i * 2}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        row = ingest.ingest(spark, path, str(tmp_path / "store"), 1000).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    samples = ingest.read_samples(spark, str(tmp_path / "store"), row["recording_id"])
    assert samples.where("row_id <> t or chunk_id <> floor(row_id / 1000)").count() == 0 and samples.count() == 20_000


def test_cache_and_errors(spark, tmp_path):
    path, root = write(tmp_path / "a.csv", "1,2\n0,3\n"), str(tmp_path / "store")
    first = ingest.open_recording(spark, path, root)[0].first()
    assert not first["is_monotone"]
    assert ingest.open_recording(spark, path, root)[0].first() == first
    write(path, "1,2\n2,3\n3,4\n")
    os.utime(path, (1, 1))
    row, samples, _ = ingest.open_recording(spark, path, root)
    assert row.first()["n_rows"] == 3 and samples.count() == 3
    other = write(tmp_path / "a.txt", "5,6\n")
    ingest.ingest(spark, other, root)
    assert ingest.recordings(spark, root).count() == 2
    for bad in ("", "1\n2\n"):
        with pytest.raises(ValueError):
            ingest.ingest(spark, write(tmp_path / "bad.csv", bad), root)


def test_a_folder_of_files_is_read_by_name_and_leaves_no_staging(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(5):
        write(folder / f"part-{i}.csv", "".join(f"{k},{k}\n" for k in range(i * 10, i * 10 + 10)))
    row, samples, _ = ingest.open_recording(spark, str(folder), str(tmp_path / "store"), 7)
    assert row.first()["is_monotone"] and samples.where("row_id <> t").count() == 0 and samples.count() == 50
    assert not os.listdir(tmp_path / "store/_staging")
    before = ingest.fingerprint(spark, str(folder))
    assert before == ingest.fingerprint(spark, str(folder))
    write(folder / "part-5.csv", "50,50\n")
    assert ingest.fingerprint(spark, str(folder)) != before


def test_many_chunks_are_joined_instead_of_named(spark, tmp_path, monkeypatch):
    from tracework.operators import scan

    path = write(tmp_path / "m.csv", "".join(f"{i},{i}\n" for i in range(1000)))
    _, samples, kept = ingest.open_recording(spark, path, str(tmp_path / "store"), 10)
    s = Series(by=("recording_id",), chunk="chunk_id")
    want = [scan.chunk_range(samples, kept, s, 95.0, 905.0).count(), stats.stats_from_chunks(samples, kept, s, ["ch0"], 95.0, 905.0).collect()]
    monkeypatch.setattr(scan, "NAMED_CHUNKS", 1)
    assert want == [scan.chunk_range(samples, kept, s, 95.0, 905.0).count(), stats.stats_from_chunks(samples, kept, s, ["ch0"], 95.0, 905.0).collect()] and want[0] == 811


def test_range_reads_only_its_chunks(spark, tmp_path):
    from tracework.operators import scan

    path = write(tmp_path / "r.csv", "".join(f"{i},{i}\n" for i in range(1000)))
    row, samples, kept = ingest.open_recording(spark, path, str(tmp_path / "store"), 100)
    part = scan.chunk_range(samples, kept, Series(chunk="chunk_id"), 250.0, 260.0)
    assert part.count() == 11
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "chunk_id" in plan.split("PushedFilters")[1]


def test_export_reads_back(spark, tmp_path):
    v = [0.1, -1.3e-9, 12345.678, math.inf, math.nan, 0.0]
    df = spark.createDataFrame([(i, i * 0.5, x) for i, x in enumerate(v)], "row_id long, t double, v double")
    export.export_csv(df, Series(), ["v"], 0.0, 2.0, str(tmp_path / "out"))
    text = sorted(line for f in os.listdir(tmp_path / "out") if f.endswith(".csv") for line in open(tmp_path / "out" / f).read().splitlines())
    assert "column_1,column_2" in text and "1.000000000000000e0,1.234567800000000e4" in text
    rows = [tuple(map(float, x.split(","))) for x in text if not x.startswith("column")]
    assert same(sorted(rows), [(i * 0.5, x) for i, x in enumerate(v[:5])])


def test_codec_cases():
    assert codec.encode(np.zeros(0), np.zeros(0)) == b"" and len(codec.decode(b"")[0]) == 0
    for t, v in (([1.0], [42.0]), ([-1.32e-6, -1.31e-6, -1.30e-6], [-0.036, -0.035, -0.034]), (np.arange(10_000) * 7.3e-9, 0.5 * np.sin(np.arange(10_000) * 0.01) + 0.3 * np.cos(np.arange(10_000) * 0.037))):
        a, b = codec.decode(codec.encode(np.array(t), np.array(v)))
        assert np.array_equal(a, t) and np.array_equal(b, v)
    t, v = 1e-6 + np.arange(100_000) * 1e-9, np.sin(0.001 * np.arange(100_000))
    data = codec.encode(t, v)
    assert np.array_equal(codec.decode(data)[1], v) and 2 * len(data) < 16 * len(t)
    with pytest.raises(ValueError):
        codec.encode(np.zeros(2), np.zeros(1))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.floats(), st.floats()), max_size=50))
def test_codec_is_exact(rows):
    t, v = (np.array(x, float) for x in (zip(*rows) if rows else ([], [])))
    a, b = codec.decode(codec.encode(t, v))
    assert a.tobytes() == t.tobytes() and b.tobytes() == v.tobytes()


def test_codec_on_chunks(spark):
    df = spark.createDataFrame([(g, c, i, float(i), float(i * g)) for g in (1, 2) for c in (0, 1) for i in range(c * 5, c * 5 + 5)], "g long, chunk int, row_id long, t double, v double")
    s = Series(by=("g",), chunk="chunk")
    back = codec.decoded(codec.encoded(df, s), s).withColumn("row_id", F.col("i") + F.col("chunk") * 5).drop("i")
    assert sorted(map(tuple, back.select("g", "chunk", "row_id", "t", "v").collect())) == sorted(map(tuple, df.collect()))
