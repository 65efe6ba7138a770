"""Queries over the driver's tables, by name, with the SQL that states each of them.

The events table serves as a recording: its times in seconds since 2024-01-01,
``value`` as the first channel and the number in ``props`` as the second, one
series for each event type or all events as one.  The embeddings serve as
series of equal length.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..frame import Series, chunked, chunked_by_rows, numbered
from ..functions import units
from ..operators import align, density, edges, eye, mathch, measure, scan, spectrum, stats, threshold
from ..shared import shared_dir
from ..sources import codec, ingest
from ..sources.export import export_rows
from ..streaming.windows import windowed_stats

A, B = 100_000.0, 2_000_000.0
EPOCH = datetime(2024, 1, 1)
LEVEL = 50.0
WHOLE = Series()
TYPED = Series(by=("event_type",))
ROWS_PER_CHUNK = 1000
CHUNK_ROWS = 100_000

_typed_cut: dict[tuple[str, str, int], str] = {}
_cut: dict[tuple[str, str, int], str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EV = """WITH ev AS (
  SELECT event_id AS row_id, event_type, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS t,
         value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events
)"""


def events(spark: SparkSession, sf_dir: str, span: tuple[float, float] | None = None) -> DataFrame:
    """(row_id, event_type, t, v, k); a span in seconds, widened by one on either side, prunes the files by their own timestamps."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    if span:
        low, high = (EPOCH + timedelta(seconds=x) for x in (span[0] - 1, span[1] + 1))
        raw = raw.where(F.col("ts").between(F.lit(low.isoformat(" ")).cast("timestamp_ntz"), F.lit(high.isoformat(" ")).cast("timestamp_ntz")))
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6
    return raw.select(F.col("event_id").alias("row_id"), "event_type", t.alias("t"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def by_time(spark: SparkSession, sf_dir: str, rows: int = 2000) -> tuple[DataFrame, Series]:
    """All events as one series, in chunks of some ``rows`` rows in order of time, so that no window holds it whole however long it is or unevenly it lies; cut once for a session, as a store's rows are."""
    key = spark.sparkContext.applicationId, sf_dir, rows
    if key not in _cut:
        path = f"{shared_dir(spark)}/tracework-chunks-{abs(hash(key)):x}"
        chunked_by_rows(events(spark, sf_dir), WHOLE, rows)[0].write.mode("overwrite").parquet(path)
        _cut[key] = path
    return spark.read.parquet(_cut[key]), Series(chunk="chunk_id")


def typed(spark: SparkSession, sf_dir: str, span: tuple[float, float] | None = None) -> tuple[DataFrame, Series]:
    """A series for each event type, in chunks of bounded rows, so that no window holds one whole; cut once for a session, as a store's rows are."""
    key = spark.sparkContext.applicationId, sf_dir, CHUNK_ROWS
    if key not in _typed_cut:
        path = f"{shared_dir(spark)}/tracework-typed-{abs(hash(key)):x}"
        chunked_by_rows(events(spark, sf_dir), TYPED, CHUNK_ROWS)[0].write.mode("overwrite").parquet(path)
        _typed_cut[key] = path
    df = spark.read.parquet(_typed_cut[key])
    return df.where(F.col("t").between(*span)) if span else df, Series(by=("event_type",), chunk="chunk_id")


def by_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Series]:
    """All events as one recording in chunks of equal row counts."""
    df, s = by_time(spark, sf_dir)
    df = numbered(df, s, "n").withColumn("chunk_id", F.floor((F.col("n") - 1) / ROWS_PER_CHUNK).cast("int")).drop("n")
    return df, Series(chunk="chunk_id")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + 0.0


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


# ---- scans ---------------------------------------------------------------

_STATS = """min(v) AS vmin, max(v) AS vmax, round(avg(v), 6) AS mean, round(sqrt(sum(v * v) / count(v)), 6) AS rms,
  round(max(v) - min(v), 6) AS vpp, count(v) AS n"""


def _rounded_stats(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "vmin", "vmax", r("mean").alias("mean"), r("rms").alias("rms"), r("vpp").alias("vpp"), "n")


@query("range_stats", f"{EV} SELECT event_type, {_STATS} FROM ev WHERE t BETWEEN {A} AND {B} GROUP BY event_type HAVING count(v) >= 2")
def range_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_stats(stats.range_stats(events(spark, sf_dir, (A, B)), TYPED, A, B), "event_type")


@query("time_range", f"{EV} SELECT row_id, event_type, t, v FROM ev WHERE t BETWEEN {A} AND {B}")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.time_range(events(spark, sf_dir, (A, B)), TYPED, A, B).select("row_id", "event_type", "t", "v")


@query("cursor_range", f"{EV} SELECT row_id, t, v FROM ev WHERE t BETWEEN {A} AND 1500000.0")
def cursor_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = scan.cursor_range((A, B), (1_500_000.0, 50_000.0))
    return scan.time_range(events(spark, sf_dir, (a, b)), WHOLE, a, b).select("row_id", "t", "v")


@query("go_to_time", f"{EV} SELECT row_id, t, v FROM ev WHERE t BETWEEN 50000.0 AND 1950000.0")
def go_to_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = scan.go_to((A, B), 1_000_000.0)
    return scan.time_range(events(spark, sf_dir, view), WHOLE, *view).select("row_id", "t", "v")


@query("channels", f"{EV} SELECT row_id, t, k FROM ev")
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.channels(events(spark, sf_dir), WHOLE, ["k"])


@query("delay", f"{EV} SELECT row_id, t + 12.5 AS t, v FROM ev WHERE t + 12.5 BETWEEN {A} AND {B}")
def delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.time_range(scan.delayed(events(spark, sf_dir), WHOLE, 12.5), WHOLE, A, B).select("row_id", "t", "v")


@query("head_fraction", f"{EV}, span AS (SELECT event_type, min(t) AS a, max(t) AS b FROM ev GROUP BY event_type) SELECT row_id, event_type, t FROM ev JOIN span USING (event_type) WHERE t <= a + (b - a) * 0.25")
def head_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.head_fraction(events(spark, sf_dir), TYPED, 0.25).select("row_id", "event_type", "t")


@query("row_number", f"{EV} SELECT row_id, row_number() OVER (ORDER BY t, row_id) AS n FROM ev")
def row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(*by_time(spark, sf_dir), "n").select("row_id", "n")


@query("thinned", f"{EV} SELECT row_id, event_type, t, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, row_id) AS n FROM ev) WHERE (n - 1) % 7 = 0")
def thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.thinned(*typed(spark, sf_dir), 7).select("row_id", "event_type", "t", "v")


@query("first_rows", f"{EV} SELECT row_id, event_type, t, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, row_id) AS n FROM ev) WHERE n <= 100")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.first_rows(*typed(spark, sf_dir), 100).select("row_id", "event_type", "t", "v")


def _envelope_sql(part: str, keys: str, source: str, width: str) -> str:
    return f"""{EV}, src AS ({source}), numbered AS (SELECT *, row_number() OVER ({part} ORDER BY t, row_id) AS rn, count(*) OVER ({part}) AS total FROM src),
    bins AS (SELECT {keys} (rn - 1) // ({width}) AS bin, arg_min(t, rn) AS t, arg_min(row_id, rn) AS row_id, min(v) AS lo, max(v) AS hi FROM numbered GROUP BY ALL)
    SELECT {keys} row_id, 0 AS point, t, lo AS v FROM bins UNION ALL SELECT {keys} row_id, 1 AS point, t, hi AS v FROM bins WHERE hi > lo"""


@query("envelope", _envelope_sql("PARTITION BY event_type", "event_type,", "SELECT * FROM ev", "50"))
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.envelope(*typed(spark, sf_dir), stride=50)


@query("envelope_whole", _envelope_sql("", "", "SELECT * FROM ev", "CASE WHEN total > 250 THEN CAST(ceil(total * 2 / 500) AS BIGINT) ELSE 1 END"))
def envelope_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.envelope(*by_time(spark, sf_dir), max_points=500)


@query("envelope_channels", _envelope_sql("PARTITION BY event_type, ch", "event_type, ch,", "SELECT row_id, event_type, t, 'v' AS ch, v FROM ev UNION ALL SELECT row_id, event_type, t, 'k' AS ch, k AS v FROM ev", "40"))
def envelope_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = typed(spark, sf_dir)
    out = scan.envelopes(df.withColumnRenamed("v", "x"), s, ["x", "k"], stride=40)
    return out.withColumn("ch", F.when(F.col("ch") == "x", "v").otherwise("k"))


# ---- statistics ----------------------------------------------------------

_PARTIAL = "min(v) AS vmin, max(v) AS vmax, round(sum(v), 4) AS vsum, round(sum(v * v), 2) AS vsumsq, count(v) AS vcount"
_CHUNKED = f"{EV}, c AS (SELECT *, CAST((row_number() OVER (ORDER BY t, row_id) - 1) // {ROWS_PER_CHUNK} AS INTEGER) AS chunk_id FROM ev), two AS (SELECT chunk_id, t, 'v' AS ch, v FROM c UNION ALL SELECT chunk_id, t, 'k' AS ch, k AS v FROM c)"


@query("extent", f"{EV} SELECT event_type, count(*) AS n_rows, min(t) AS x_min, max(t) AS x_max FROM ev GROUP BY event_type")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extent(events(spark, sf_dir), TYPED)


@query("chunk_stats", f"{_CHUNKED} SELECT chunk_id, min(t) AS t_min, max(t) AS t_max, count(*) AS row_count, CAST(chunk_id AS BIGINT) * {ROWS_PER_CHUNK} AS row_offset, ch, {_PARTIAL} FROM two GROUP BY chunk_id, ch")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = by_rows(spark, sf_dir)
    return stats.chunk_stats(df, s, ["v", "k"]).withColumns({"vsum": r("vsum", 4), "vsumsq": r("vsumsq", 2)})


@query("merged_stats", f"{EV} SELECT event_type, {_PARTIAL} FROM ev GROUP BY event_type")
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = chunked(events(spark, sf_dir), TYPED, 16)
    parts = df.groupBy(*s.keys).agg(*stats.partials("v"))
    return parts.groupBy(*s.by).agg(*stats.merged()).withColumns({"vsum": r("vsum", 4), "vsumsq": r("vsumsq", 2)})


@query("y_range", f"{EV} SELECT event_type, round(min(v) - (max(v) - min(v)) * 0.05, 6) AS y_lo, round(max(v) + (max(v) - min(v)) * 0.05, 6) AS y_hi FROM ev GROUP BY event_type")
def y_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.y_range(events(spark, sf_dir), TYPED).select("event_type", r("y_lo").alias("y_lo"), r("y_hi").alias("y_hi"))


@query("linked_y_range", f"{EV} SELECT round((min(v) + max(v)) / 2, 6) AS center, round((max(v) - min(v)) / 2 * 1.1, 6) AS half FROM ev")
def linked_y_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.linked_y_range(events(spark, sf_dir), WHOLE).select(r("center").alias("center"), r("half").alias("half"))


@query("windowed_stats", f"""SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS "end", event_type, min(value) AS vmin, max(value) AS vmax,
  round(avg(value), 6) AS mean, round(sqrt(sum(value * value) / count(value)), 6) AS rms, round(max(value) - min(value), 6) AS vpp, count(value) AS n FROM events GROUP BY 1, 2, 3 HAVING count(value) >= 2""")
def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _rounded_stats(windowed_stats(df, "ts", "value", "1 day", by=["event_type"]), "start", "end", "event_type")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


# ---- math channels -------------------------------------------------------


def _math(op: str, sql: str) -> None:
    @query(f"math_{op}", f"{EV} SELECT row_id, t, round({sql}, 6) + 0.0 AS v FROM ev")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = events(spark, sf_dir)
        channel = mathch.MathChannel(op, "v", "k" if mathch.Op(op).binary else None)
        return channel.apply(df, WHOLE).withColumn("v", r("v"))


for _op, _sql in {"add": "v + k", "subtract": "v - k", "multiply": "v * k", "invert": "-v", "abs": "abs(v)"}.items():
    _math(_op, _sql)

_DERIVATIVE = "SELECT {keys} row_id, round((t + pt) / 2, 7) AS t, round((v - pv) / (t - pt), 6) + 0.0 AS v FROM (SELECT *, lag(t) OVER ({part} ORDER BY t, row_id) AS pt, lag(v) OVER ({part} ORDER BY t, row_id) AS pv FROM {source}) WHERE abs(t - pt) > 2.220446049250313e-16"
_INTEGRAL = "SELECT {keys} row_id, t, round(coalesce(sum((v + pv) / 2 * (t - pt)) OVER ({part} ORDER BY t, row_id ROWS UNBOUNDED PRECEDING), 0) / 1e6, 6) AS v FROM (SELECT *, lag(t) OVER ({part} ORDER BY t, row_id) AS pt, lag(v) OVER ({part} ORDER BY t, row_id) AS pv FROM ev)"
_TYPED = {"keys": "event_type,", "part": "PARTITION BY event_type", "source": "ev"}
_ONE = {"keys": "", "part": "", "source": "ev"}


@query("derivative", f"{EV} {_DERIVATIVE.format(**_TYPED)}")
def derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mathch.derivative(*typed(spark, sf_dir)).withColumns({"t": r("t", 7), "v": r("v")}).drop("chunk_id")


@query("derivative_whole", f"{EV} {_DERIVATIVE.format(**_ONE)}")
def derivative_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mathch.derivative(*by_time(spark, sf_dir)).select("row_id", r("t", 7).alias("t"), r("v").alias("v"))


@query("integral", f"{EV} {_INTEGRAL.format(**_TYPED)}")
def integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mathch.integral(*typed(spark, sf_dir)).withColumn("v", r(F.col("v") / 1e6)).drop("chunk_id")


@query("integral_whole", f"{EV} {_INTEGRAL.format(**_ONE)}")
def integral_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mathch.integral(*by_time(spark, sf_dir)).select("row_id", "t", r(F.col("v") / 1e6).alias("v"))


@query("math_of_math", f"{EV}, s AS (SELECT row_id, event_type, t, abs(v - k) AS v FROM ev) {_DERIVATIVE.format(keys='event_type,', part='PARTITION BY event_type', source='s')}")
def math_of_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = mathch.Registry()
    difference = registry.add(mathch.MathChannel("subtract", "v", "k"))
    size = registry.add(mathch.MathChannel("abs", difference))
    slope = registry.add(mathch.MathChannel("derivative", size))
    out = registry.points(*typed(spark, sf_dir), slope)
    return out.withColumns({"t": r("t", 7), "v": r("v")}).drop("chunk_id")


# ---- thresholds and measurements -----------------------------------------


@query("over_threshold", f"{EV} SELECT row_id, t, v FROM ev WHERE v > {LEVEL}")
def over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.over(events(spark, sf_dir), WHOLE, LEVEL).select("row_id", "t", "v")


def _lag(part: str = "PARTITION BY event_type", source: str = "ev") -> str:
    return f"SELECT *, lag(t) OVER ({part} ORDER BY t, row_id) AS pt, lag(v) OVER ({part} ORDER BY t, row_id) AS pv, row_number() OVER ({part} ORDER BY t, row_id) AS rn FROM {source}"


@query(
    "binarised",
    f"""{EV}, p AS ({_lag()}), x AS (SELECT *, pv IS NOT NULL AND (v > {LEVEL}) <> (pv > {LEVEL}) AS crossed FROM p)
    SELECT event_type, row_id, 0 AS point, round(pt + ({LEVEL} - pv) / (v - pv) * (t - pt), 6) AS t, CASE WHEN pv > {LEVEL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM x WHERE crossed
    UNION ALL SELECT event_type, row_id, 1 AS point, round(pt + ({LEVEL} - pv) / (v - pv) * (t - pt), 6) AS t, CASE WHEN v > {LEVEL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM x WHERE crossed
    UNION ALL SELECT event_type, row_id, CASE WHEN crossed THEN 2 ELSE 0 END AS point, round(t, 6) AS t, CASE WHEN v > {LEVEL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM x""",
)
def binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.binarised(*typed(spark, sf_dir), LEVEL).withColumn("t", r("t")).drop("chunk_id")


_LEVELS = f"{EV}, lv AS (SELECT event_type, count(*) AS n, min(v) AS lo, max(v) AS hi FROM ev GROUP BY event_type HAVING count(*) >= 4 AND max(v) - min(v) >= 2.220446049250313e-16), p AS (SELECT * FROM ({_lag()}) JOIN lv USING (event_type))"


@query("crossings", f"{_LEVELS} SELECT event_type, row_id, t, CASE WHEN v > (hi + lo) / 2 THEN 'rising' ELSE 'falling' END AS direction FROM p WHERE (pv <= (hi + lo) / 2 AND v > (hi + lo) / 2) OR (pv > (hi + lo) / 2 AND v <= (hi + lo) / 2)")
def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.crossings(*typed(spark, sf_dir)).drop("chunk_id")


def _edge_sql(name: str, start: str, stop: str, below: str, reached: str, mode: str) -> str:
    line = lambda x: f"CASE WHEN abs(v - pv) < 2.220446049250313e-16 THEN pt ELSE pt + ({x} - pv) / (v - pv) * (t - pt) END"
    return f"""{name} AS (
      SELECT f.event_type, min_by(c.tt, c.rn) - any_value(f.tf) AS {name}
      FROM (SELECT event_type, min(rn) AS rn0, arg_min({line(start)}, rn) AS tf FROM p WHERE pv {below} {start} AND v {reached} {start} GROUP BY event_type) f
      JOIN (SELECT event_type, rn, {line(stop)} AS tt FROM p WHERE pv {below} {stop} AND v {reached} {stop}) c ON f.event_type = c.event_type AND c.rn {mode} f.rn0
      GROUP BY f.event_type)"""


def _pulse_sql(mode: str) -> str:
    ten, ninety = "(lo + 0.1 * (hi - lo))", "(lo + 0.9 * (hi - lo))"
    return f"""{_LEVELS}, g AS (
      SELECT event_type, count(*) FILTER (WHERE up) AS edges, max(t) FILTER (WHERE up) - min(t) FILTER (WHERE up) AS gap, max(t) - min(t) AS total, coalesce(sum(t - pt) FILTER (WHERE v > (hi + lo) / 2), 0) AS high
      FROM (SELECT *, coalesce(pv <= (hi + lo) / 2 AND v > (hi + lo) / 2, false) AS up FROM p) GROUP BY event_type
    ), m AS (SELECT event_type, CASE WHEN edges >= 2 AND gap > 0 THEN gap / (edges - 1) END AS period, high, total FROM g),
    {_edge_sql("rise_time", ten, ninety, "<", ">=", mode)}, {_edge_sql("fall_time", ninety, ten, ">", "<=", mode)}
    SELECT event_type, round(period, 6) AS period, round(1 / period, 9) AS frequency, round(CASE WHEN period IS NOT NULL THEN high / total * 100 END, 6) AS duty_cycle,
      round(high / total * period, 4) AS pos_width, round((1 - high / total) * period, 4) AS neg_width, round(CASE WHEN rise_time > 0 THEN rise_time END, 6) AS rise_time, round(CASE WHEN fall_time > 0 THEN fall_time END, 6) AS fall_time
    FROM m LEFT JOIN rise_time USING (event_type) LEFT JOIN fall_time USING (event_type)"""


def _rounded_pulse(df: DataFrame) -> DataFrame:
    digits = {"period": 6, "frequency": 9, "duty_cycle": 6, "pos_width": 4, "neg_width": 4, "rise_time": 6, "fall_time": 6}
    return df.withColumns({c: r(c, n) for c, n in digits.items()})


@query("pulse", _pulse_sql(">="))
def pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_pulse(measure.pulse(*typed(spark, sf_dir)))


@query("pulse_reference_mode", _pulse_sql(">"))
def pulse_reference_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_pulse(measure.pulse(*typed(spark, sf_dir), mode="reference"))


@query("measurements", f"{_pulse_sql('>=').replace('FROM events', f'FROM events WHERE (epoch_us(ts) - epoch_us(TIMESTAMP ' + chr(39) + '2024-01-01 00:00:00' + chr(39) + f')) / 1e6 BETWEEN {A} AND {B}').replace('FROM m LEFT', 'FROM m JOIN (SELECT event_type, ' + _STATS + ' FROM ev GROUP BY event_type) st USING (event_type) LEFT').replace('SELECT event_type, round(period', 'SELECT event_type, vmin, vmax, mean, rms, vpp, st.n, round(period')}")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _rounded_pulse(measure.measurements(*typed(spark, sf_dir, (A, B)), A, B))
    return out.withColumns({c: r(c) for c in ("mean", "rms", "vpp")})


# ---- edges ---------------------------------------------------------------

_QUART = "q AS (SELECT event_type, max(v) FILTER (WHERE i = n // 4) AS q25, max(v) FILTER (WHERE i = 3 * n // 4) AS q75, any_value(n) AS n FROM (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev) GROUP BY event_type)"


def _LEVELS_OF(ev: str) -> str:
    return f"{ev}, {_QUART}"


_TH = f"{EV}, {_QUART}, th AS (SELECT event_type, (q25 + q75) / 2 - (q75 - q25) * 0.10 AS lo, (q25 + q75) / 2 + (q75 - q25) * 0.10 AS hi FROM q), p AS (SELECT * FROM ({_lag()}) JOIN th USING (event_type))"


@query("quartiles", f"{EV}, {_QUART} SELECT event_type, q25, q75, n FROM q")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.quartiles(events(spark, sf_dir), TYPED)


_EVENT = {"rising": ("pv <= hi AND v > hi", "v < lo"), "falling": ("pv >= lo AND v < lo", "v > hi"), "both": ("v > hi", "v < lo")}


def _schmitt(polarity: str, part: str = "PARTITION BY event_type", th: str = _TH) -> str:
    on, off = _EVENT[polarity]
    fires = "(e = 1 AND coalesce(st, 0) = 0)" + (" OR (e = 0 AND st = 1)" if polarity == "both" else "")
    level = {"rising": "hi", "falling": "lo", "both": "CASE WHEN e = 1 THEN hi ELSE lo END"}[polarity]
    return f"""{th}, e AS (SELECT *, CASE WHEN rn > 1 AND {on} THEN 1 WHEN rn > 1 AND {off} THEN 0 END AS e FROM p),
    s AS (SELECT *, last_value(e IGNORE NULLS) OVER ({part} ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM e),
    hit AS (SELECT event_type, row_id, t, pt + ({level} - pv) / (v - pv) * (t - pt) AS t_cross FROM s WHERE {fires})"""


def _add_schmitt(polarity: str) -> None:
    @query(f"schmitt_{polarity}", f"{_schmitt(polarity)} SELECT event_type, row_id, t, round(t_cross, 6) AS t_cross FROM hit")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edges.schmitt(*typed(spark, sf_dir), polarity).withColumn("t_cross", r("t_cross")).drop("chunk_id")


for _polarity in edges.POLARITIES:
    _add_schmitt(_polarity)

_TH_WHOLE = _TH.replace("PARTITION BY event_type", "").replace("SELECT * FROM (SELECT *, lag", "SELECT * FROM (SELECT *, lag").replace("SELECT event_type, v, row_number", "SELECT 'all' AS event_type, v, row_number").replace("JOIN th USING (event_type)", "JOIN (SELECT lo, hi FROM th) ON true")


@query("schmitt_whole", f"{_schmitt('rising', '', _TH_WHOLE)} SELECT row_id, t, round(t_cross, 6) AS t_cross FROM hit")
def schmitt_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.schmitt(*by_time(spark, sf_dir), "rising").select("row_id", "t", r("t_cross").alias("t_cross"))


@query(
    "symbol_period",
    f"""{_schmitt("rising")}, gaps AS (
      SELECT event_type, gap, row_number() OVER (PARTITION BY event_type ORDER BY gap) - 1 AS i, lag(gap) OVER (PARTITION BY event_type ORDER BY gap) AS before
      FROM (SELECT event_type, t_cross - lag(t_cross) OVER (PARTITION BY event_type ORDER BY t_cross, row_id) AS gap, count(*) OVER (PARTITION BY event_type) AS edges FROM hit) WHERE edges >= 3 AND gap > 0
    ), size AS (SELECT event_type, coalesce(min(i) FILTER (WHERE i > 0 AND gap / greatest(before, 1e-30) > 1.5), count(*)) AS n FROM gaps GROUP BY event_type)
    SELECT event_type, round(avg(gap), 6) AS ui, CAST(any_value(n) AS BIGINT) AS n_periods FROM gaps JOIN size USING (event_type)
    WHERE CASE WHEN n * 9 // 10 > n // 10 THEN i BETWEEN n // 10 AND n * 9 // 10 ELSE i = n // 2 END GROUP BY event_type""",
)
def symbol_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.auto_period(*typed(spark, sf_dir)).select("event_type", r("ui").alias("ui"), F.col("n_periods").cast("long").alias("n_periods"))


_CLOCK = f"{EV}, {_QUART}, p AS (SELECT *, (q25 + q75) / 2 AS m FROM ({_lag()}) JOIN q USING (event_type))"
_HITS = {"rising": "pv <= m AND v > m", "falling": "pv >= m AND v < m", "both": "(pv <= m AND v > m) OR (pv >= m AND v < m)"}


def _add_clock(polarity: str) -> None:
    @query(f"clock_{polarity}", f"{_CLOCK} SELECT event_type, row_id, round(pt + (m - pv) / (v - pv) * (t - pt), 6) AS t FROM p WHERE {_HITS[polarity]}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edges.clock_crossings(*typed(spark, sf_dir), polarity).withColumn("t", r("t")).drop("chunk_id")


for _polarity in edges.POLARITIES:
    _add_clock(_polarity)

_SIGNAL = "sig AS (SELECT row_id, t, v FROM ev WHERE event_type <> 'error')"


@query(
    "clock_nearest",
    f"""{_CLOCK}, {_SIGNAL}, ck AS (SELECT row_id AS left_id, pt + (m - pv) / (v - pv) * (t - pt) AS left_t FROM p WHERE event_type = 'error' AND pv <= m AND v > m),
    n AS (SELECT left_id, left_t, s.row_id, s.t FROM ck ASOF LEFT JOIN sig s ON ck.left_t <= s.t),
    b AS (SELECT left_id, s.row_id AS brow, s.t AS bt FROM ck ASOF LEFT JOIN sig s ON ck.left_t > s.t)
    SELECT left_id, round(left_t, 6) AS left_t, CASE WHEN t IS NULL OR abs(t - left_t) > abs(bt - left_t) THEN brow ELSE row_id END AS row_id, CASE WHEN t IS NULL OR abs(t - left_t) > abs(bt - left_t) THEN bt ELSE t END AS t FROM n JOIN b USING (left_id)""",
)
def clock_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = by_time(spark, sf_dir)
    clock = edges.clock_crossings(df.where("event_type = 'error'"), s)
    out = align.nearest(clock, df.where("event_type <> 'error'"), s)
    return out.select("left_id", r("left_t").alias("left_t"), "row_id", "t")


@query(
    "fixed_triggers",
    f"""{EV}, span AS (SELECT event_type, min(t) AS a, max(t) AS b FROM ev GROUP BY event_type),
    tick AS (SELECT event_type, k, a + k * 5000.0 AS tick FROM span, LATERAL (SELECT unnest(generate_series(0, CAST(floor((b - a) / 5000.0) AS BIGINT))) AS k))
    SELECT tick.event_type, tick.k, ev.row_id, ev.t FROM tick ASOF JOIN ev ON tick.event_type = ev.event_type AND tick.tick <= ev.t""",
)
def fixed_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.fixed_triggers(events(spark, sf_dir), TYPED, 5000.0)


# ---- eye diagrams and rasters --------------------------------------------

WIDTH = 20_000.0
_SEGS = f"{_schmitt('rising')}, seg AS (SELECT h.event_type, h.row_id AS seg, e.row_id, e.t - h.t AS t_off, e.v FROM hit h JOIN ev e ON h.event_type = e.event_type AND e.t < h.t + {WIDTH} AND (e.t > h.t OR (e.t = h.t AND e.row_id >= h.row_id)))"


def _triggered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Series, DataFrame]:
    df, s = typed(spark, sf_dir)
    return df, s, edges.schmitt(df, s).select("event_type", F.col("row_id").alias("seg"), "row_id", "t")


@query("eye_segments", f"{_SEGS} SELECT event_type, seg, row_id, round(t_off, 6) AS t_off, v FROM seg")
def eye_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, _, hits = _triggered(spark, sf_dir)
    return eye.segments(df, TYPED, hits, WIDTH).withColumn("t_off", r("t_off"))


@query("eye_counters", f"{_SEGS}, c AS (SELECT event_type, seg, count(*) AS n FROM seg GROUP BY event_type, seg HAVING count(*) >= 2) SELECT event_type, count(*) AS n_segments, CAST(sum(n) AS BIGINT) AS n_samples FROM c GROUP BY event_type")
def eye_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eye.counted(*_triggered(spark, sf_dir), WIDTH)


def _GRID_OF(ev: str, extra: str, hits: str, gx: int, gy: int, seg: str = "row_id") -> str:
    """The cells ``g`` of the segments after the triggers ``hits``; ``extra`` has wd(w), the width."""
    levels = f"{ev}, {_QUART}, th AS (SELECT event_type, (q25 + q75) / 2 - (q75 - q25) * 0.10 AS lo, (q25 + q75) / 2 + (q75 - q25) * 0.10 AS hi FROM q), p AS (SELECT * FROM ({_lag()}) JOIN th USING (event_type))"
    return f"""{_schmitt("rising", th=levels)}{extra},
  seg AS (SELECT h.event_type, h.{seg} AS seg, e.row_id, e.t - h.t AS t_off, e.v FROM {hits} h CROSS JOIN wd JOIN ev e ON h.event_type = e.event_type AND e.t < h.t + w AND (e.t > h.t OR (e.t = h.t AND e.row_id >= h.row_id))),
  yr AS (SELECT event_type, min(v) - (max(v) - min(v)) * 0.05 AS y_lo, max(v) + (max(v) - min(v)) * 0.05 AS y_hi FROM ev GROUP BY event_type),
  xy AS (SELECT event_type, seg, t_off, row_id, t_off / w * {gx} AS x0, (v - y_lo) / (y_hi - y_lo) * {gy} AS y0 FROM seg JOIN yr USING (event_type) CROSS JOIN wd),
  ln AS (SELECT *, lead(x0) OVER w AS x1, lead(y0) OVER w AS y1 FROM xy WINDOW w AS (PARTITION BY event_type, seg ORDER BY t_off, row_id)),
  st AS (SELECT *, CAST(greatest(ceil(greatest(abs(x1 - x0), abs(y1 - y0))), 1) AS BIGINT) AS n FROM ln WHERE x1 IS NOT NULL),
  pt AS (SELECT event_type, x0 + i / n * (x1 - x0) AS fx, y0 + i / n * (y1 - y0) AS fy FROM st, LATERAL (SELECT unnest(generate_series(0, n)) AS i)),
  sp AS (SELECT event_type, floor(fx) AS xi, floor(fy) AS yi, fx - floor(fx) AS wx, fy - floor(fy) AS wy FROM pt),
  cell AS (SELECT event_type, xi AS x, yi AS y, (1 - wx) * (1 - wy) AS w FROM sp UNION ALL SELECT event_type, xi + 1, yi, wx * (1 - wy) FROM sp UNION ALL SELECT event_type, xi, yi + 1, (1 - wx) * wy FROM sp UNION ALL SELECT event_type, xi + 1, yi + 1, wx * wy FROM sp),
  g AS (SELECT event_type, CAST(x AS INTEGER) AS x_bin, CAST(y AS INTEGER) AS y_bin, sum(w) AS weight FROM cell WHERE x BETWEEN 0 AND {gx - 1} AND y BETWEEN 0 AND {gy - 1} AND w > 0 GROUP BY ALL)"""


_GRID = _GRID_OF(EV, f", wd AS (SELECT {WIDTH}::DOUBLE AS w)", "hit", 64, 32)


def _eye_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s, hits = _triggered(spark, sf_dir)
    return eye.drawn(df, s, hits, WIDTH, stats.y_range(df, TYPED), (64, 32))


@query("eye_grid", f"{_GRID} SELECT event_type, x_bin, y_bin, round(weight, 4) AS weight FROM g WHERE weight > 0.0001")
def eye_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eye_grid(spark, sf_dir).where("weight > 0.0001").withColumn("weight", r("weight", 4))


@query("eye_tone", f"{_GRID} SELECT event_type, x_bin, y_bin, round(ln(1 + weight) / ln(1 + max(weight) OVER (PARTITION BY event_type)), 4) AS tone FROM g QUALIFY weight > 0.0001")
def eye_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tone_mapped(_eye_grid(spark, sf_dir), "weight", by=["event_type"]).where("weight > 0.0001").select("event_type", "x_bin", "y_bin", r("tone", 4).alias("tone"))


@query(
    "density",
    f"""{EV}, ln AS (SELECT event_type, t, y, lead(y) OVER (PARTITION BY event_type ORDER BY t, row_id) AS y1 FROM (SELECT event_type, row_id, t, CAST(trunc((v - 0.0) / 200.0 * 40) AS INTEGER) AS y FROM ev)),
    c AS (SELECT *, CAST(floor((t - {A}) / {B - A} * 80) AS INTEGER) AS near FROM ln WHERE y1 IS NOT NULL AND t BETWEEN {A} AND {B}),
    run AS (SELECT event_type, near + d AS px, greatest(least(least(y, y1), 39), 0) AS lo, greatest(least(greatest(y, y1), 39), 0) AS hi FROM c, (VALUES (-1), (0), (1)) x(d)
      WHERE near + d BETWEEN 0 AND 79 AND t >= {A} + (near + d) / 80.0::DOUBLE * {B - A} AND t <= {A} + (near + d + 1) / 80.0::DOUBLE * {B - A})
    SELECT event_type, px, CAST(py AS INTEGER) AS py, count(*) AS n FROM run, LATERAL (SELECT unnest(generate_series(lo, hi)) AS py) GROUP BY ALL""",
)
def density_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.raster(*typed(spark, sf_dir), (A, B), (0.0, 200.0), 80, 40)


# ---- spectra -------------------------------------------------------------

_TAPER = {
    "rectangle": "1.0",
    "hanning": "0.5 - 0.5 * cos(2 * pi() * i / (n - 1))",
    "blackman_harris": "0.35875 - 0.48829 * cos(2 * pi() * i / (n - 1)) + 0.14128 * cos(4 * pi() * i / (n - 1)) - 0.01168 * cos(6 * pi() * i / (n - 1))",
}


def _fft_sql(kind: str, scale: str) -> str:
    value = {"linear": "round(m, 6)", "db": "round(CASE WHEN m > 1e-15 THEN 20 * log10(m) ELSE -200.0 END, 4)"}[scale]
    return f"""WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM embeddings),
    w AS (SELECT vec_id, i, n, (v - avg(v) OVER (PARTITION BY vec_id)) * ({_TAPER[kind]}) AS y, sum({_TAPER[kind]}) OVER (PARTITION BY vec_id) AS ws FROM x),
    m AS (SELECT vec_id, k, any_value(n) AS n, sqrt(sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2) / (any_value(ws) * 0.5) AS m
      FROM w, LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k) GROUP BY vec_id, k)
    SELECT vec_id, CAST(k AS INTEGER) AS k, k / n AS freq, {value} AS mag FROM m WHERE k > 0"""


def _add_fft(kind: str, scale: str) -> None:
    @query(f"fft_{kind}_{scale}", _fft_sql(kind, scale))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        out = spectrum.spectra_of_arrays(df, "vec_id", "embedding", 1.0, kind, scale)
        return out.where("k > 0").withColumn("mag", r("mag", 6 if scale == "linear" else 4))  # k = 0 is rounding noise once the mean is off


for _kind in spectrum.Taper:
    for _scale in spectrum.Scale:
        _add_fft(str(_kind), str(_scale))


@query(
    "fft_rows",
    _fft_sql("hanning", "linear"),
)
def fft_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("row_id"), F.col("i").cast("double").alias("t"), F.col("v").cast("double").alias("v"))
    return spectrum.spectrum(rows, Series(by=("vec_id",))).where("k > 0").withColumn("mag", r("mag"))


@query("taper_column", "SELECT CAST(i AS INTEGER) AS i, " + ", ".join(f"round({sql}, 9) + 0.0 AS {kind}" for kind, sql in _TAPER.items()) + " FROM (SELECT unnest(range(64)) AS i, 64 AS n)")
def taper_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.range(64)
    return df.select(F.col("id").cast("int").alias("i"), *(r(spectrum.taper_column(F.col("id"), F.lit(64), k), 9).alias(str(k)) for k in spectrum.Taper))


# ---- pairs, units, text --------------------------------------------------


@query("xy", f"{EV} SELECT row_id, t, v AS x, k AS y FROM ev")
def xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.xy(events(spark, sf_dir), WHOLE, "v", "k")


@query("by_row", f"{EV}, a AS (SELECT row_number() OVER (ORDER BY t, row_id) AS row_id, t, v FROM ev WHERE event_type = 'error'), b AS (SELECT row_number() OVER (ORDER BY t, row_id) AS row_id, v FROM ev WHERE event_type = 'click') SELECT row_id, a.t, a.v AS a, b.v AS b FROM a JOIN b USING (row_id)")
def by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = by_time(spark, sf_dir)
    a, b = (numbered(df.where(F.col("event_type") == kind), s, "n").select(F.col("n").alias("row_id"), "t", "v") for kind in ("error", "click"))
    return align.by_row(a, b, WHOLE)


_SI = "CASE WHEN x = 0 THEN '0 V' " + " ".join(f"WHEN abs(x) >= {scale} * 0.999 THEN printf('%.4f {p}V', x / {scale})" for scale, p in (("1e12", "T"), ("1e9", "G"), ("1e6", "M"), ("1e3", "k"), ("1e0", ""), ("1e-3", "m"), ("1e-6", "u"), ("1e-9", "n"), ("1e-12", "p"))) + " END"


@query("format_si", f"{EV} SELECT row_id, {_SI} AS text FROM (SELECT row_id, (v * k - 3) * 0.123456789 * (CASE row_id % 3 WHEN 0 THEN 1e-6 WHEN 1 THEN 1e3 ELSE 1e0 END) AS x FROM ev)")
def format_si(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("v") * F.col("k") - 3) * 0.123456789 * F.when(F.col("row_id") % 3 == 0, 1e-6).when(F.col("row_id") % 3 == 1, 1e3).otherwise(1.0)
    return events(spark, sf_dir).select("row_id", units.format_si(x, "V").alias("text"))


@query("format_voltage", f"{EV} SELECT row_id, CASE WHEN v = 0 THEN '0.000 V' WHEN abs(v) < 1 THEN printf('%.3f mV', v * 1e3) ELSE printf('%.3f V', v) END AS text FROM ev")
def format_voltage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("row_id", units.format_voltage(F.col("v")).alias("text"))


@query("units", f"{EV} SELECT row_id, round(t * 1e3, 3) AS t_ms, round(t * 1e6, 0) AS t_us, round(v * 1e3, 3) AS v_mv, round(v * 1e-3, 6) AS v_from_mv, round(k * 1e-9, 15) AS k_from_ns, abs(v - k) AS delta, CASE WHEN v <> k THEN round(1 / abs(v - k), 9) END AS inverse, k / 10 AS per_div FROM ev")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v, k = F.col("t"), F.col("v"), F.col("k")
    delta, inverse = units.cursor_delta(v, k)
    return events(spark, sf_dir).select(
        "row_id", r(units.from_seconds(t, "ms"), 3).alias("t_ms"), r(units.from_seconds(t, "us"), 0).alias("t_us"), r(units.from_volts(v, "mV"), 3).alias("v_mv"), r(units.to_volts(v, "mV")).alias("v_from_mv"),
        r(units.to_seconds(k, "ns"), 15).alias("k_from_ns"), delta.alias("delta"), r(inverse, 9).alias("inverse"), units.per_division(k).alias("per_div"),
    )


@query("export_rows", f"{EV} SELECT row_id, t, v FROM ev WHERE t BETWEEN {A} AND 300000.0")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export_rows(events(spark, sf_dir, (A, 300_000.0)), WHOLE, ["v"], A, 300_000.0)
    return rows.select("row_id", F.col("column_1").cast("double").alias("t"), F.col("column_2").cast("double").alias("v"))


@query("codec", f"{_CHUNKED} SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY t, row_id) - 1 AS i, t, v FROM c")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, s = by_rows(spark, sf_dir)
    return codec.decoded(codec.encoded(df, s), s)


@query(
    "parsed_lines",
    f"""{EV} SELECT row_id, round(t, 6) AS t, CASE WHEN row_id % 7 = 0 THEN -1.0::DOUBLE ELSE v END AS ch0, CASE WHEN row_id % 5 = 0 THEN -1.0::DOUBLE ELSE k END AS ch1 FROM ev WHERE row_id % 10 NOT IN (3, 4)""",
)
def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines with ragged rows, empty fields, quotes and words, parsed as a file's would be."""
    n = F.col("row_id")
    first = F.when(n % 7 == 0, F.lit("volts")).when(n % 2 == 0, F.format_string(' "%s" ', F.col("v"))).otherwise(F.col("v").cast("string"))
    line = F.concat_ws(",", F.col("t").cast("string"), first, F.when(n % 5 == 0, F.lit("")).otherwise(F.col("k").cast("string")))
    line = F.when(n % 10 == 3, F.concat(line, F.lit(",1"))).when(n % 10 == 4, F.lit("1,2")).otherwise(line)
    rows = ingest.parse_lines(events(spark, sf_dir).select("row_id", line.alias("value")), 3, ["row_id"]).where("_ok")
    return rows.select("row_id", r("t").alias("t"), F.nanvl("ch0", F.lit(-1.0)).alias("ch0"), F.nanvl("ch1", F.lit(-1.0)).alias("ch1"))
