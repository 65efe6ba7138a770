import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import loops
from tracework.frame import Series, chunked, chunked_by_rows, latest, lagged, nth_smallest, numbered, running_sum
from tracework.operators import align, density, edges, eye, mathch, measure, scan, spectrum, stats, threshold

S = Series(by=("series",))
NAN, INF = math.nan, math.inf
RNG = np.random.default_rng(11)


def walk(n, nan=0.0):
    v = np.round(np.cumsum(RNG.normal(0, 1, n)), 1)
    v[RNG.random(n) < nan] = NAN
    t = np.cumsum(RNG.integers(0, 3, n)) * 0.5  # equal times too
    return list(zip(t.tolist(), v.tolist()))


SERIES = {
    **{i: walk(120) for i in range(6)}, **{i: walk(120, 0.08) for i in range(6, 12)}, 20: [], 21: [(0.0, 1.0)], 22: [(0.0, 1.0), (1.0, 2.0)], 23: [(0.0, 1.0), (1.0, 0.0), (2.0, 1.0)],
    24: [(float(i), float(i // 5 % 2)) for i in range(60)], 25: [(float(i), float(i >= 10)) for i in range(30)], 26: [(float(i), 3.0) for i in range(12)], 27: [(float(i), i * 0.5) for i in range(40)],
    28: [(0.0, NAN), (1.0, NAN), (2.0, 1.0), (3.0, NAN)], 29: [(i * 0.1, math.sin(i * 0.3)) for i in range(200)],
}


def table(spark, series=SERIES, chunk=None):
    rows = [(k, i, t, v, i // chunk if chunk else 0) for k, points in series.items() for i, (t, v) in enumerate(points)]
    RNG.shuffle(rows)
    return spark.createDataFrame([(int(a), int(b), float(c), float(d), int(e)) for a, b, c, d, e in rows], "series long, row_id long, t double, v double, chunk long")


@pytest.fixture(scope="module")
def df(spark):
    return table(spark).cache()


def points(frame, *order, cols=("t", "v")):
    out = {}
    for r in frame.orderBy("series", *order).collect():
        out.setdefault(r["series"], []).append(tuple(r[c] for c in cols))
    return out


def same(got, want):
    assert set(got) == {k for k, p in want.items() if p}
    for k, p in got.items():
        assert len(p) == len(want[k]), k
        for a, b in zip(p, want[k]):
            assert all((x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-12, nan_ok=True) for x, y in zip(a, b)), (k, a, b)


@pytest.mark.parametrize("stride", [1, 2, 7, 50])
def test_envelope(df, stride):
    got = points(scan.envelope(df, S, stride=stride), "row_id", "point")
    same(got, {k: loops.envelope(p, stride) for k, p in SERIES.items()})


def test_envelope_budget(spark):
    frame = table(spark, {1: [(float(i), float(i % 7)) for i in range(1000)]})
    assert scan.envelope(frame, S, max_points=100).count() <= 100
    assert scan.envelope(frame, S, max_points=5000).count() == 1000
    assert scan.envelope(frame, S, max_points=100, estimated_rows=40).count() == 1000
    with pytest.raises(ValueError):
        scan.envelope(frame, S)


def test_batched_envelope_equals_single(df):
    wide = df.withColumns({"x": F.col("v"), "y": F.col("v") * 2}).drop("v")
    both = scan.envelopes(wide, S, ["x", "y"], stride=5)
    one = scan.envelope(wide.withColumnRenamed("y", "v"), S, stride=5)
    assert sorted(map(str, both.where("ch = 'y'").drop("ch").collect())) == sorted(map(str, one.collect()))


def test_range_scans(df):
    assert scan.time_range(df, S, 5.0, 5.0).count() == 0 and scan.time_range(df, S, 6.0, 5.0).count() == 0
    assert scan.time_range(df, S, 2.0, 3.0).count() == sum(2.0 <= t <= 3.0 for p in SERIES.values() for t, _ in p)
    assert scan.cursor_range((0, 10), None) == (0, 10) and scan.cursor_range((0, 10), (8, -3)) == (0, 8)
    assert scan.go_to((0, 10), 20) == (15, 25) and scan.point_budget(3) == 400_000 and scan.point_budget(10_000) == 20_000
    assert scan.channels(df, S, ["none"]).count() == 0
    assert scan.thinned(df, S, 50).count() == sum(-(-len(p) // 50) for p in SERIES.values())
    assert scan.first_rows(df, S, 3).count() == sum(min(3, len(p)) for p in SERIES.values())


def one(spark, values, t=None):
    return spark.createDataFrame([(1, i, float(t[i]) if t else float(i), v) for i, v in enumerate(values)], "series long, row_id long, t double, v double")


def test_partials(spark):
    assert tuple(one(spark, [1.0, NAN, 3.0, INF, -2.0]).agg(*stats.partials("v")).first()) == (-2.0, 3.0, 2.0, 14.0, 3)
    assert tuple(one(spark, [NAN, NAN, None]).agg(*stats.partials("v")).first()) == (None, None, None, None, 0)
    a, b = (one(spark, x).agg(*stats.partials("v")) for x in ([1.0, 2.0], [0.5, 4.0]))
    assert tuple(a.unionByName(b).agg(*stats.merged()).first()) == (0.5, 4.0, 7.5, 21.25, 4)
    empty = one(spark, [NAN]).agg(*stats.partials("v"))
    assert a.unionByName(empty).agg(*stats.merged()).first()["vcount"] == 2


def test_stats_from_partials(spark):
    schema = "chunk long, t_min double, t_max double, ch string, vmin double, vmax double, vsum double, vsumsq double, vcount long"
    chunks = spark.createDataFrame([(0, 0.0, 10.0, "v", -1.0, 1.0, 0.0, 2.0, 2), (1, 10.0, 20.0, "v", -3.0, 2.0, -1.0, 13.0, 2)], schema)
    none = spark.createDataFrame([], "chunk long, t double, row_id long, v double")
    r = stats.stats_from_chunks(none, chunks, Series(chunk="chunk"), ["v"], -1.0, 21.0).first()
    assert (r["vmin"], r["vmax"], r["mean"], r["n"]) == (-3.0, 2.0, -0.25, 4) and r["rms"] == pytest.approx(math.sqrt(3.75))
    assert stats.finished(one(spark, [1.0]).agg(*stats.partials("v")), []).count() == 0


@pytest.mark.parametrize("size", [1, 7, 1000])
@pytest.mark.parametrize("span", [(-1.0, 1e9), (3.0, 40.0), (20.0, 20.5), (1e6, 2e6)])
def test_stats_from_chunks_equal_scan(spark, size, span):
    frame = table(spark, {1: walk(300, 0.1)}, size).withColumn("w", F.col("v") * 2)
    s = Series(chunk="chunk")
    kept = stats.chunk_stats(frame, s, ["v", "w"])
    got = {r["ch"]: r for r in stats.stats_from_chunks(frame, kept, s, ["v", "w"], *span).collect()}
    for ch in ("v", "w"):
        want = stats.range_stats(frame, Series(v=ch), *span).first()
        assert (want is None and ch not in got) or all(got[ch][c] == pytest.approx(want[c]) for c in want.asDict())
    assert scan.chunk_range(frame, kept, s, *span).count() == scan.time_range(frame, s, *span).count()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scans_do_not_depend_on_chunks(spark, size):
    series = {k: p for k, p in SERIES.items() if k < 12}
    frame = table(spark, series, size)
    flat, cut = S, replace(S, chunk="chunk")

    def run(s):
        out = running_sum(latest(lagged(numbered(frame, s, "n"), s, "p", "t", "v"), s, "e", F.when(F.col("v") > 1, F.col("row_id"))), s, "sum", F.when(~F.isnan("v"), F.col("v")))
        out = lagged(latest(out, s, "later", F.when(F.col("v") > 1, F.col("row_id")), reverse=True), s, "next", "t", reverse=True)
        return points(out, "t", "row_id", cols=("n", "e", "later", "sum", "row_id")), [str(r) for r in out.orderBy("series", "t", "row_id").select("p", "next").collect()]

    (a, pa), (b, pb) = run(flat), run(cut)
    same(b, a)
    assert pa == pb


def test_time_chunks_are_monotone(spark):
    frame, s = chunked(table(spark, {1: walk(200), 2: walk(50)}).drop("chunk"), S, 8)
    for rows in points(frame, "t", "row_id", cols=("chunk_id",)).values():
        assert rows == sorted(rows) and 0 <= rows[0][0] and rows[-1][0] <= 7


def test_nth_smallest(spark):
    series = {1: walk(200, 0.1), 2: [(0.0, 5.0)] * 30, 3: [(0.0, INF), (1.0, 2.0), (2.0, 1.0)]}
    got = {r["series"]: r for r in nth_smallest(table(spark, series), S, {"low": F.lit(0), "mid": F.floor(F.col("n") / 2)}, buckets=16).collect()}
    for k, p in series.items():
        v = sorted(x for _, x in p if math.isfinite(x))
        assert (got[k]["low"], got[k]["mid"], got[k]["n"]) == (v[0], v[len(v) // 2], len(v))


def test_chunks_of_rows_are_monotone_and_bounded(spark):
    burst = [(i * 1e-3, float(i)) for i in range(300)] + [(100.0 + i, 0.0) for i in range(50)]
    frame, s = chunked_by_rows(table(spark, {1: walk(200), 2: burst, 3: [(5.0, 1.0)] * 4}).drop("chunk"), S, 20)
    for rows in points(frame, "t", "row_id", cols=("chunk_id",)).values():
        ids = [r[-1] for r in rows]
        assert ids == sorted(ids)
    sizes = {(r["series"], r["chunk_id"]): r["count"] for r in frame.groupBy("series", "chunk_id").count().collect()}
    assert max(n for (k, _), n in sizes.items() if k == 1) <= 40 and sum(sizes.values()) == 554
    assert max(n for (k, _), n in sizes.items() if k == 2) < 350 and s.chunk == "chunk_id"
    a, b = (points(numbered(frame, x, "n"), "t", "row_id", cols=("n",)) for x in (s, S))
    assert a == b


@pytest.mark.parametrize("chunk", [None, 7])
def test_derivative_and_integral(spark, chunk):
    series = {k: p for k, p in SERIES.items() if k < 6 or k > 20 and k != 28}
    frame, s = table(spark, series, chunk or 1), replace(S, chunk="chunk" if chunk else None)
    same(points(mathch.derivative(frame, s), "t", "row_id"), {k: sorted(loops.derivative(p)) for k, p in series.items()} | {k: loops.derivative(p) for k, p in series.items()})
    same(points(mathch.integral(frame, s), "t", "row_id"), {k: loops.integral(p) for k, p in series.items()})


def test_math_channels(spark):
    frame = one(spark, [1.0, -2.0, 3.0]).withColumn("w", F.lit(2.0))
    got = {op: [r["v"] for r in mathch.MathChannel(op, "v", "w").apply(frame, S).orderBy("row_id").collect()] for op in ("add", "subtract", "multiply", "invert", "abs")}
    assert got == {"add": [3.0, 0.0, 5.0], "subtract": [-1.0, -4.0, 1.0], "multiply": [2.0, -4.0, 6.0], "invert": [-1.0, 2.0, -3.0], "abs": [1.0, 2.0, 3.0]}
    names = [mathch.MathChannel(op, "A", "B").name for op in mathch.Op]
    assert names == ["A+B", "A-B", "A*B", "-A", "|A|", "d(A)/dt", "int(A)"]
    with pytest.raises(ValueError):
        mathch.MathChannel("add", "A")
    registry = mathch.Registry()
    slope = registry.add(mathch.MathChannel("derivative", "v"))
    both = registry.add(mathch.MathChannel("add", slope, "w"), "both")
    assert [r["v"] for r in registry.points(frame, S, both).orderBy("row_id").collect()] == [None, -1.0, 7.0]
    registry.remove("both")
    with pytest.raises(KeyError):
        registry.points(frame, S, "both")


@pytest.mark.parametrize("mode", ["exact", "reference"])
def test_pulse(df, mode):
    cols = ("period", "frequency", "duty_cycle", "pos_width", "neg_width", "rise_time", "fall_time")
    got = points(measure.pulse(df, S, mode), cols=cols)
    want = {k: loops.pulse(p, mode == "reference") for k, p in SERIES.items()}
    same(got, {k: [w] if w else [] for k, w in want.items()})


def test_pulse_of_square_and_step(df):
    exact = {r["series"]: r for r in measure.pulse(df, S).collect()}
    assert exact[24]["period"] == 10.0 and exact[24]["rise_time"] == pytest.approx(0.8) and exact[25]["rise_time"] == pytest.approx(0.8)
    old = {r["series"]: r for r in measure.pulse(df, S, "reference").collect()}
    assert old[24]["rise_time"] == pytest.approx(10.8) and old[25]["rise_time"] is None


def test_pulse_with_chunks(spark):
    series = {k: SERIES[k] for k in (0, 1, 7, 24)}
    frame = table(spark, series, 7)
    assert sorted(map(str, measure.pulse(frame, replace(S, chunk="chunk")).collect())) == sorted(map(str, measure.pulse(frame, S).collect()))


@pytest.mark.parametrize("level", [0.5, 0.0, -3.0])
def test_binarised(df, level):
    same(points(threshold.binarised(df, S, level), "row_id", "point"), {k: loops.binarised(p, level) for k, p in SERIES.items()})
    assert threshold.over(df, S, level).count() == sum(v > level for p in SERIES.values() for _, v in p)


@pytest.mark.parametrize("chunk", [None, 7])
@pytest.mark.parametrize("polarity", edges.POLARITIES)
def test_schmitt(spark, polarity, chunk):
    series = {k: p for k, p in SERIES.items() if any(math.isfinite(v) for _, v in p)}
    s = replace(S, chunk="chunk" if chunk else None)
    got = points(edges.schmitt(table(spark, series, chunk or 1), s, polarity), "row_id", cols=("row_id",))
    same(got, {k: [(i,) for i in loops.schmitt(p, polarity, *loops.thresholds(p))] for k, p in series.items()})


def test_symbol_period(spark):
    for n in (3, 4, 11, 21, 101):
        times = np.cumsum(RNG.choice([1.0, 1.1, 0.9, 3.0], n)).tolist()
        frame = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "series long, row_id long, t_cross double")
        assert edges.symbol_period(frame, S).first()["ui"] == pytest.approx(loops.symbol_period(times))
    few = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0)], "series long, row_id long, t_cross double")
    assert edges.symbol_period(few, S).count() == 0


@pytest.mark.parametrize("polarity", edges.POLARITIES)
def test_clock(df, polarity):
    series = {k: p for k, p in SERIES.items() if any(math.isfinite(v) for _, v in p)}
    got = points(edges.clock_crossings(df, S, polarity), "row_id", cols=("t",))
    same(got, {k: [(t,) for t in loops.clock(p, polarity)] for k, p in series.items()})


def test_alignment_does_not_depend_on_chunks(spark):
    series = {k: SERIES[k] for k in (0, 1, 24)}
    frame, cut = table(spark, series, 7), replace(S, chunk="chunk")
    left = spark.createDataFrame([(k, i, float(t)) for k in series for i, t in enumerate(np.linspace(-3, 80, 60))], "series long, row_id long, t double")
    assert sorted(map(str, align.nearest(left, frame, cut).collect())) == sorted(map(str, align.nearest(left, frame, S).collect()))
    assert sorted(map(str, edges.fixed_triggers(frame, cut, 2.0).collect())) == sorted(map(str, edges.fixed_triggers(frame, S, 2.0).collect()))
    clock = table(spark, {k: SERIES[k + 2 if k < 24 else 29] for k in series}, 7)
    found = [sorted(map(str, eye.triggers(frame, s, 2.0, clock=clock).collect())) for s in (cut, S)]
    assert found[0] == found[1] and found[0]


def test_nearest(spark):
    samples = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 0.0), (4.0, 0.0)]
    times = [-5.0, 0.0, 0.4, 0.5, 0.6, 1.0, 1.5, 3.0, 3.1, 4.0, 99.0]
    left = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "series long, row_id long, t double")
    got = points(align.nearest(left, table(spark, {1: samples}), S), "left_id", cols=("row_id",))
    assert [i for (i,) in got[1]] == loops.nearest(times, samples)
    assert align.nearest(left, table(spark, {2: samples}), S).count() == 0


def test_fixed_triggers(spark):
    series = {1: [(0.0, 0.0), (1.0, 0.0), (9.5, 0.0), (10.0, 0.0)], 2: walk(50)}
    got = points(edges.fixed_triggers(table(spark, series), S, 2.0), "k", cols=("row_id",))
    same(got, {k: [(i,) for i in loops.fixed(p, 2.0)] for k, p in series.items()})


def test_eye_grid(spark):
    series = {1: walk(80), 2: SERIES[24]}
    frame = table(spark, series)
    starts = {1: [0, 5, 30, 79], 2: [3, 3, 20]}
    hits = spark.createDataFrame([(k, n, i, float(series[k][i][0])) for k, own in starts.items() for n, i in enumerate(own)], "series long, seg long, row_id long, t double")
    y = spark.createDataFrame([(1, -10.0, 10.0), (2, -0.1, 1.1)], "series long, y_lo double, y_hi double")
    segs = eye.segments(frame, S, hits, 9.0)
    got = points(eye.grid(segs, S, 9.0, y, (16, 8)), "x_bin", "y_bin", cols=("x_bin", "y_bin", "weight"))
    for k, (lo, hi) in {1: (-10.0, 10.0), 2: (-0.1, 1.1)}.items():
        want = loops.eye_grid(series[k], starts[k], 9.0, lo, hi, 16, 8)
        assert {(x, z): pytest.approx(w) for x, z, w in got[k]} == want
    assert {r["series"]: (r["n_segments"], r["n_samples"]) for r in eye.counters(segs, S).collect()}[2] == (3, 27)


def test_whole_eye(spark):
    s = Series()
    frame = table(spark, {1: SERIES[24]}).drop("series")
    out = eye.eye(frame, s, 0.0, 100.0, n_ui=2, size=(32, 16))
    assert out.count() > 0 and out.agg(F.max("x_bin")).first()[0] <= 31
    assert eye.eye(frame.limit(5), s, 0.0, 100.0) is None and eye.eye(frame, s, 0.0, 100.0, n_ui=1) is None
    flat = table(spark, {1: SERIES[26]}).drop("series")
    assert eye.eye(flat, s, 0.0, 100.0) is None
    assert eye.eye(flat, s, 0.0, 100.0, ui=4.0).count() == 0  # a constant has no height


def test_density(spark):
    series = {1: walk(100), 2: [(float(i), [0.0, 50.0, NAN, -50.0, INF][i % 5]) for i in range(21)], 3: [(0.0, 1.0)]}
    got = points(density.raster(table(spark, series), S, (0.0, 20.0), (-8.0, 8.0), 10, 12), "px", "py", cols=("px", "py", "n"))
    for k, p in series.items():
        assert {(x, z): n for x, z, n in got.get(k, [])} == loops.density(p, (0.0, 20.0), (-8.0, 8.0), 10, 12)
    assert density.raster(table(spark, series), S, (1.0, 1.0), (0.0, 1.0), 4, 4).count() == 0


def test_spectrum_of_a_sine(spark):
    n, rate, f = 1024, 1000.0, 125.0
    frame = one(spark, [3.0 + 2.0 * math.sin(2 * math.pi * f * i / rate) for i in range(n)], [i / rate for i in range(n)])
    for kind in spectrum.Taper:
        top = spectrum.spectrum(frame, S, kind).orderBy(F.desc("mag")).first()
        assert top["freq"] == pytest.approx(f, rel=1e-6) and top["mag"] == pytest.approx(2.0, rel=0.01)
    assert spectrum.spectrum(frame, S, scale="db").orderBy(F.desc("mag")).first()["mag"] == pytest.approx(20 * math.log10(2), abs=0.1)


def test_spectrum_matches_direct_sum(spark):
    v = RNG.normal(0, 1, 20)
    got = [r["mag"] for r in spectrum.spectrum(one(spark, v.tolist()), S, "blackman_harris").orderBy("k").collect()]
    w = spectrum.taper(20, "blackman_harris")
    x = (v - v.mean()) * w
    want = [abs(sum(x[i] * np.exp(-2j * np.pi * k * i / 32) for i in range(20))) / (w.sum() / 2) for k in range(17)]
    assert got == pytest.approx(want)
    assert spectrum.spectrum(one(spark, [1.0, 2.0, 3.0]), S).count() == 0
    assert spectrum.spectrum(one(spark, [1.0] * 5, [1.0] * 5), S).count() == 0
    assert spectrum.spectrum(one(spark, v.tolist()), S, max_samples=8).count() == 5
    assert (np.array([spectrum.magnitudes(np.ones((1, 8)), "hanning", "db")]) == -200).all()


def test_arrays_equal_rows(spark):
    rows = [(1, RNG.normal(0, 1, 16).tolist()), (2, RNG.normal(0, 1, 10).tolist()), (3, [1.0, 2.0]), (4, None), (5, [1.0, None, 2.0, 3.0])]
    out = spectrum.spectra_of_arrays(spark.createDataFrame(rows, "id long, x array<double>"), "id", "x", 10.0)
    for key, v in rows[:2]:
        want = spectrum.spectrum(one(spark, v, [i / 10 for i in range(len(v))]), S).orderBy("k").collect()
        got = out.where(F.col("id") == key).orderBy("k").collect()
        assert [(r["k"], pytest.approx(r["freq"]), pytest.approx(r["mag"])) for r in got] == [(r["k"], r["freq"], r["mag"]) for r in want]
    assert {r["id"] for r in out.collect()} == {1, 2}


def test_ranges_and_tone(spark):
    frame = one(spark, [0.0, 10.0, NAN, INF])
    assert tuple(stats.y_range(frame, Series()).first()) == (-0.5, 10.5)
    assert tuple(stats.linked_y_range(frame, Series()).first()) == (5.0, 5.5)
    grid = spark.createDataFrame([(1, 0.0), (1, 3.0), (2, 0.0)], "g long, w double")
    got = sorted(tuple(r) for r in stats.tone_mapped(grid, "w", by=["g"]).select("g", "w", "tone").collect())
    assert got == [(1, 0.0, 0.0), (1, 3.0, 1.0), (2, 0.0, 0.0)]


@pytest.mark.parametrize("chunk", [None, 1, 7, 1000])
def test_drawing_and_counting_without_segments(spark, chunk):
    series = {1: walk(80), 2: SERIES[24], 3: walk(90, 0.1), 4: SERIES[22]}
    starts = {1: [0, 5, 5, 30, 79], 2: [3, 3, 20, 21], 3: [*range(0, 90, 4)], 4: [0, 1]}
    frame, s = table(spark, series, chunk), replace(S, chunk="chunk") if chunk else S
    hits = spark.createDataFrame([(k, n, i, float(series[k][i][0])) for k, own in starts.items() for n, i in enumerate(own)], "series long, seg long, row_id long, t double")
    y = spark.createDataFrame([(1, -10.0, 10.0), (2, -0.1, 1.1), (3, -5.0, 5.0), (4, 1.0, 1.0)], "series long, y_lo double, y_hi double")
    for width, size in (9.0, (16, 8)), (8.0, (32, 4)), (0.7, (8, 8)):  # whole numbers of cells a step, too
        segs = eye.segments(frame, S, hits, width)
        want = points(eye.grid(segs, S, width, y, size), "x_bin", "y_bin", cols=("x_bin", "y_bin", "weight"))
        got = points(eye.drawn(frame, s, hits, width, y, size), "x_bin", "y_bin", cols=("x_bin", "y_bin", "weight"))
        assert {k: {(x, z): pytest.approx(w, abs=1e-8) for x, z, w in p if w > 1e-8} for k, p in want.items()} == {k: {(x, z): w for x, z, w in p if w > 1e-8} for k, p in got.items()}
        assert sorted(map(str, eye.counted(frame, s, hits, width).collect())) == sorted(map(str, eye.counters(segs, S).collect()))


def test_drawing_makes_no_segments(spark):
    rows, near = 20_000, 5_000  # 100 million pairs of a line and a start
    t, v = np.arange(rows) * 1e-3, np.arange(rows) % 4 * 1.0
    lines = t[:-1], np.arange(rows - 1), t[1:], v[:-1], v[1:]
    out = eye.draw(lines, (t[::4], np.arange(0, rows, 4)), 1e3, (8, 8))
    steps = 1 + np.maximum(np.abs(v[1:] - v[:-1]), 1)
    seen = np.arange(rows - 1) // 4 + 1
    assert len(t[::4]) == near and out.sum() == pytest.approx((steps * seen).sum())
