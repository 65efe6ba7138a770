"""Queries over a written store, over values with gaps, and of whole eye diagrams.

The store holds the events as a text file would: written once for a session
and tables, converted, and opened again by each query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..frame import Series
from ..operators import density, edges, eye, mathch, scan, stats
from ..shared import shared_dir
from ..sources import export, ingest
from .waveform import _CHUNKED, _DERIVATIVE, _GRID_OF, _LEVELS_OF, _PARTIAL, _STATS, _TYPED, A, B, EV, ROWS_PER_CHUNK, TYPED, WHOLE, _rounded_stats, events, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_written: dict[tuple[str, str], str] = {}


def query(name: str, sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def text_file(spark: SparkSession, sf_dir: str) -> str:
    """The events as lines ``t,v,k`` in order of time, with a line too short after every 50th, in a folder of files."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _written:
        path = f"{shared_dir(spark)}/tracework-text-{abs(hash(key)):x}"
        rows = events(spark, sf_dir).repartitionByRange("t", "row_id").sortWithinPartitions("t", "row_id")
        line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("t", "v", "k")))
        short = F.when(F.col("row_id") % 50 == 0, F.array(line, F.lit("1,2"))).otherwise(F.array(line))
        rows.select(F.explode(short).alias("value")).write.mode("overwrite").text(path)
        _written[key] = path
    return _written[key]


def opened(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = text_file(spark, sf_dir)
    return ingest.open_recording(spark, path, f"{path}-store", ROWS_PER_CHUNK)


_ONE_FILE = Series(by=("recording_id",), chunk="chunk_id")


@query("store_recording", f"{EV} SELECT count(*) AS n_rows, count(*) FILTER (WHERE row_id % 50 = 0) AS n_skipped, 3 AS n_cols, min(t) AS x_min, max(t) AS x_max, CAST((count(*) - 1) // {ROWS_PER_CHUNK} + 1 AS INTEGER) AS n_chunks, true AS is_monotone FROM ev")
def store_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[0].select("n_rows", "n_skipped", "n_cols", "x_min", "x_max", F.col("n_chunks").cast("int").alias("n_chunks"), "is_monotone")


@query("store_samples", f"{_CHUNKED} SELECT chunk_id, row_number() OVER (ORDER BY t, row_id) - 1 AS row_id, t, v AS ch0, k AS ch1 FROM c")
def store_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[1].select("chunk_id", "row_id", "t", "ch0", "ch1")


@query("store_chunk_stats", f"{_CHUNKED} SELECT chunk_id, min(t) AS t_min, max(t) AS t_max, count(*) AS row_count, CAST(chunk_id AS BIGINT) * {ROWS_PER_CHUNK} AS row_offset, CASE ch WHEN 'v' THEN 'ch0' ELSE 'ch1' END AS ch, {_PARTIAL} FROM two GROUP BY chunk_id, ch")
def store_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opened(spark, sf_dir)[2].drop("recording_id").withColumns({"vsum": r("vsum", 4), "vsumsq": r("vsumsq", 2)})


@query("store_range", f"{EV}, n AS (SELECT row_number() OVER (ORDER BY t, row_id) - 1 AS row_id, t, v AS ch0, k AS ch1 FROM ev) SELECT row_id, t, ch0, ch1 FROM n WHERE t BETWEEN {A} AND {B}")
def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples, kept = opened(spark, sf_dir)
    return scan.chunk_range(samples, kept, _ONE_FILE, A, B).select("row_id", "t", "ch0", "ch1")


@query("stats_from_chunks", f"{_CHUNKED} SELECT CASE ch WHEN 'v' THEN 'ch0' ELSE 'ch1' END AS ch, {_STATS} FROM two WHERE t BETWEEN {A} AND {B} GROUP BY ch HAVING count(v) >= 2")
def stats_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, samples, kept = opened(spark, sf_dir)
    return _rounded_stats(stats.stats_from_chunks(samples, kept, _ONE_FILE, ["ch0", "ch1"], A, B), "ch")


@query("store_columns", "SELECT 3 AS n_columns")
def store_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(ingest.count_columns(spark, text_file(spark, sf_dir))).alias("n_columns"))


_E15 = "regexp_replace(regexp_replace(printf('%.15e', {x}), 'e\\+0?(\\d+)$', 'e\\1'), 'e-0?(\\d+)$', 'e-\\1')"


@query("export_text", f"{EV} SELECT row_id, {_E15.format(x='t')} AS column_1, {_E15.format(x='v')} AS column_2 FROM ev WHERE t BETWEEN {A} AND 300000.0")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of an exported file, field by field."""
    return export.export_rows(events(spark, sf_dir, (A, 300_000.0)), WHOLE, ["v"], A, 300_000.0).select("row_id", "column_1", "column_2")


# ---- values with gaps ----------------------------------------------------

GAPS = """CASE WHEN event_id % 31 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 37 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 41 = 0 THEN '-Infinity'::DOUBLE WHEN event_id % 43 = 0 THEN NULL ELSE value END"""
EV_GAPS = EV.replace("value AS v", f"{GAPS} AS v")
#: NaN as null, for which no comparison holds either; then finite values alone.
EV_ORDERED = EV.replace("value AS v", f"CASE WHEN event_id % 31 <> 0 THEN {GAPS} END AS v")
EV_FINITE = EV.replace("value AS v", f"CASE WHEN isfinite({GAPS}) THEN {GAPS} END AS v")


def gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with NaN, infinite and null values at fixed rows."""
    n = F.col("row_id")
    v = F.when(n % 31 == 0, F.lit(float("nan"))).when(n % 37 == 0, F.lit(float("inf"))).when(n % 41 == 0, F.lit(float("-inf"))).when(n % 43 != 0, F.col("v"))
    return events(spark, sf_dir).withColumn("v", v)


@query("range_stats_gaps", f"{EV_FINITE} SELECT event_type, {_STATS} FROM ev WHERE t BETWEEN {A} AND {B} GROUP BY event_type HAVING count(v) >= 2")
def range_stats_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_stats(stats.range_stats(gapped(spark, sf_dir), TYPED, A, B), "event_type")


@query("merged_stats_gaps", f"{EV_FINITE} SELECT event_type, {_PARTIAL} FROM ev GROUP BY event_type")
def merged_stats_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = gapped(spark, sf_dir).groupBy("event_type", F.pmod("row_id", F.lit(7))).agg(*stats.partials("v"))
    return parts.groupBy("event_type").agg(*stats.merged()).withColumns({"vsum": r("vsum", 4), "vsumsq": r("vsumsq", 2)})


@query("y_range_gaps", f"{EV_FINITE} SELECT event_type, round(min(v) - (max(v) - min(v)) * 0.05, 6) AS y_lo, round(max(v) + (max(v) - min(v)) * 0.05, 6) AS y_hi FROM ev GROUP BY event_type")
def y_range_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.y_range(gapped(spark, sf_dir), TYPED).select("event_type", r("y_lo").alias("y_lo"), r("y_hi").alias("y_hi"))


@query("quartiles_gaps", _LEVELS_OF(EV_FINITE).replace("FROM ev)", "FROM ev WHERE v IS NOT NULL)") + " SELECT event_type, q25, q75, n FROM q")
def quartiles_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.quartiles(gapped(spark, sf_dir), TYPED)


@query(
    "envelope_gaps",
    f"""{EV_GAPS}, n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY t, row_id) - 1) // 20 AS bin, row_number() OVER (PARTITION BY event_type ORDER BY t, row_id) AS rn FROM ev),
    b AS (SELECT event_type, bin, arg_min(t, rn) AS t, arg_min(row_id, rn) AS row_id, arg_min(struct_pack(x := v), rn).x AS head, min(v) FILTER (WHERE NOT isnan(v)) AS lo, max(v) FILTER (WHERE NOT isnan(v)) AS hi FROM n GROUP BY ALL)
    SELECT event_type, row_id, 0 AS point, t, CASE WHEN head IS NULL OR isnan(head) THEN NULL ELSE lo END AS v FROM b
    UNION ALL SELECT event_type, row_id, 1 AS point, t, hi AS v FROM b WHERE head IS NOT NULL AND NOT isnan(head) AND hi > lo""",
)
def envelope_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.envelope(gapped(spark, sf_dir), TYPED, stride=20).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def _schmitt_gaps(polarity: str) -> str:
    on, off = {"rising": ("pv <= hi AND v > hi", "v < lo"), "falling": ("pv >= lo AND v < lo", "v > hi"), "both": ("v > hi", "v < lo")}[polarity]
    fires = "(e = 1 AND coalesce(st, 0) = 0)" + (" OR (e = 0 AND st = 1)" if polarity == "both" else "")
    order = "PARTITION BY event_type ORDER BY t, row_id"
    return f"""{_LEVELS_OF(EV_ORDERED).replace("FROM ev)", "FROM ev WHERE v IS NOT NULL AND isfinite(v))")},
    th AS (SELECT event_type, (q25 + q75) / 2 - (q75 - q25) * 0.10 AS lo, (q25 + q75) / 2 + (q75 - q25) * 0.10 AS hi FROM q),
    p AS (SELECT *, lag(v) OVER ({order}) AS pv, row_number() OVER ({order}) AS rn FROM ev JOIN th USING (event_type)),
    e AS (SELECT *, CASE WHEN rn > 1 AND {on} THEN 1 WHEN rn > 1 AND {off} THEN 0 END AS e FROM p),
    s AS (SELECT *, last_value(e IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM e)
    SELECT event_type, row_id, t FROM s WHERE {fires}"""


def _add_schmitt(polarity: str) -> None:
    @query(f"schmitt_{polarity}_gaps", _schmitt_gaps(polarity))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return edges.schmitt(gapped(spark, sf_dir), TYPED, polarity).select("event_type", "row_id", "t")


for _polarity in edges.POLARITIES:
    _add_schmitt(_polarity)


@query(
    "density_gaps",
    f"""{EV_GAPS}, ln AS (SELECT event_type, t, y, lead(y) OVER (PARTITION BY event_type ORDER BY t, row_id) AS y1 FROM (SELECT event_type, row_id, t, CASE WHEN v IS NULL OR isnan(v) THEN 0 WHEN isinf(v) THEN CASE WHEN v > 0 THEN 2147483647 ELSE -2147483648 END ELSE CAST(trunc((v - 0.0) / 200.0 * 40) AS INTEGER) END AS y FROM ev)),
    c AS (SELECT *, CAST(floor((t - {A}) / {B - A} * 80) AS INTEGER) AS near FROM ln WHERE y1 IS NOT NULL AND t BETWEEN {A} AND {B}),
    run AS (SELECT event_type, near + d AS px, greatest(least(least(y, y1), 39), 0) AS lo, greatest(least(greatest(y, y1), 39), 0) AS hi FROM c, (VALUES (-1), (0), (1)) x(d)
      WHERE near + d BETWEEN 0 AND 79 AND t >= {A} + (near + d) / 80.0::DOUBLE * {B - A} AND t <= {A} + (near + d + 1) / 80.0::DOUBLE * {B - A})
    SELECT event_type, px, CAST(py AS INTEGER) AS py, count(*) AS n FROM run, LATERAL (SELECT unnest(generate_series(lo, hi)) AS py) GROUP BY ALL""",
)
def density_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.raster(gapped(spark, sf_dir), TYPED, (A, B), (0.0, 200.0), 80, 40)


# ---- eye diagrams and registries as a whole ------------------------------

EYE = A, 300_000.0
_EV_EYE = EV.replace("FROM events", f"FROM events WHERE (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 BETWEEN {EYE[0]} AND {EYE[1]}").replace("event_type, (", "'all' AS event_type, event_type AS kind, (")
_UI = """gaps AS (
      SELECT gap, row_number() OVER (ORDER BY gap) - 1 AS i, lag(gap) OVER (ORDER BY gap) AS before FROM (SELECT t_cross - lag(t_cross) OVER (ORDER BY t_cross, row_id) AS gap, count(*) OVER () AS edges FROM hit) WHERE edges >= 3 AND gap > 0
    ), size AS (SELECT coalesce(min(i) FILTER (WHERE i > 0 AND gap / greatest(before, 1e-30) > 1.5), count(*)) AS n FROM gaps),
    ui AS (SELECT avg(gap) AS ui FROM gaps, size WHERE CASE WHEN n * 9 // 10 > n // 10 THEN i BETWEEN n // 10 AND n * 9 // 10 ELSE i = n // 2 END)"""


@query("eye_auto", _GRID_OF(_EV_EYE, f", {_UI}, wd AS (SELECT 3 * ui AS w FROM ui)", "hit", *eye.GRID) + " SELECT x_bin, y_bin, round(weight, 4) AS weight FROM g WHERE weight > 0.0001")
def eye_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series with the period found from it, on the full grid."""
    out = eye.eye(events(spark, sf_dir, EYE), WHOLE, *EYE)
    return out.where("weight > 0.0001").withColumn("weight", r("weight", 4))


_CLOCKED = """, ck AS (SELECT kind, row_id, t, v, lag(t) OVER (ORDER BY t, row_id) AS pt, lag(v) OVER (ORDER BY t, row_id) AS pv FROM ev WHERE kind = 'error'),
    md AS (SELECT (max(v) FILTER (WHERE i = n // 4) + max(v) FILTER (WHERE i = 3 * n // 4)) / 2 AS m FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM ev WHERE kind = 'error')),
    cx AS (SELECT row_id AS left_id, pt + (m - pv) / (v - pv) * (t - pt) AS left_t FROM ck, md WHERE pv <= m AND v > m),
    nx AS (SELECT left_id, left_t, s.row_id, s.t FROM cx ASOF LEFT JOIN ev s ON cx.left_t <= s.t),
    bf AS (SELECT left_id, s.row_id AS brow, s.t AS bt FROM cx ASOF LEFT JOIN ev s ON cx.left_t > s.t),
    near AS (SELECT 'all' AS event_type, left_id AS seg, CASE WHEN t IS NULL OR abs(t - left_t) > abs(bt - left_t) THEN brow ELSE row_id END AS row_id, CASE WHEN t IS NULL OR abs(t - left_t) > abs(bt - left_t) THEN bt ELSE t END AS t FROM nx JOIN bf USING (left_id))"""


@query("eye_clock", _GRID_OF(_EV_EYE, f"{_CLOCKED}, wd AS (SELECT 2 * 700.0::DOUBLE AS w)", "near", 96, 48, "seg") + " SELECT x_bin, y_bin, round(weight, 4) AS weight FROM g WHERE weight > 0.0001")
def eye_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments from the samples nearest to a clock's rising crossings; the clock is the events of one type."""
    df = events(spark, sf_dir, EYE)
    out = eye.eye(df, WHOLE, *EYE, n_ui=2, ui=700.0, clock=df.where("event_type = 'error'"), size=(96, 48))
    return out.where("weight > 0.0001").withColumn("weight", r("weight", 4))


@query("math_of_derivative", f"{EV}, d AS ({_DERIVATIVE.format(**(_TYPED | {'source': '(SELECT row_id, event_type, t, v - k AS v FROM ev)'}))}) SELECT row_id, ev.t, round(abs(x), 6) AS v FROM ev LEFT JOIN (SELECT row_id, v AS x FROM d) USING (row_id)")
def math_of_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row-wise channel of a derivative of a difference."""
    registry = mathch.Registry()
    slope = registry.add(mathch.MathChannel("derivative", registry.add(mathch.MathChannel("subtract", "v", "k"))))
    size = registry.add(mathch.MathChannel("abs", slope))
    return registry.points(events(spark, sf_dir), TYPED, size).select("row_id", "t", r("v").alias("v"))
