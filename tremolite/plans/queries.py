"""The engine's queries over the driver's tables, with SQL that gives the same rows.

The tables aren't structural: events stand for recorded responses (user: entity, type: dof), line
items for connectors (order) between points (part), quantities for samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import normal, series
from ..operators import accumulators as A
from ..operators import entities, graphs, vectors
from ..operators import recorders as R
from ..operators import reliability as P
from ..operators import series as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name, with its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with t in seconds since 1970."""
    t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t.alias("t"))


EVENTS = "(SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten thousandths of a pseudo time for every event: t = event_id / 100."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") / 100.0).alias("t"))


# recorders


@query("""SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS step, min(t) AS t, max(CASE WHEN event_type = 'click' THEN value END) AS value_click,
    max(CASE WHEN event_type = 'view' THEN value END) AS value_view FROM """ + EVENTS + """
    WHERE event_type IN ('click', 'view') AND user_id IN (SELECT c_custkey FROM customer) GROUP BY 1, 2""")
def r01_node_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("step", F.floor(F.col("t") / 86400).cast("long"))
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return R.project(rows, nodes, ["click", "view"], ["step"], "user_id", "event_type", time="t")


GATE = """RECURSIVE e AS (SELECT user_id, t, event_id, value FROM """ + EVENTS + """), g AS (
    SELECT user_id, min(t) AS t FROM e GROUP BY user_id UNION ALL
    SELECT g.user_id, min(e.t) FROM g JOIN e ON e.user_id = g.user_id AND e.t > g.t AND e.t - (g.t + 40000) >= -40000 * 1e-5 GROUP BY g.user_id)"""


@query("WITH " + GATE + " SELECT e.user_id, e.event_id, e.t FROM g JOIN e USING (user_id, t)")
def r02_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "t")
    return R.gate(rows, ["user_id"], 40000.0).where("emitted").select("user_id", "event_id", "t")


@query("""SELECT l_suppkey AS entity_tag, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS value_a, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS value_r
    FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1""")
def r03_element_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_tag"), F.col("l_returnflag").alias("dof"), F.col("l_quantity").alias("value"))
    return R.project(rows, None, ["A", "R"], []).withColumnsRenamed({"value_A": "value_a", "value_R": "value_r"})


@query("""WITH w AS (SELECT *, min(value) OVER o AS a, max(value) OVER o AS b, max(abs(value)) OVER o AS c FROM """ + EVENTS + """ WINDOW o AS (PARTITION BY user_id, event_type))
    SELECT user_id, event_type, min(value) AS v_min, max(value) AS v_max, max(abs(value)) AS v_absmax, min(CASE WHEN value = a THEN t END) AS t_min, min(CASE WHEN value = b THEN t END) AS t_max, min(CASE WHEN abs(value) = c THEN t END) AS t_absmax FROM w GROUP BY 1, 2""")
def r04_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.envelope(events(spark, sf_dir), ["user_id", "event_type"], time="t")


@query("SELECT c_nationkey, c_mktsegment, min(c_acctbal) AS v_min, max(c_acctbal) AS v_max, max(abs(c_acctbal)) AS v_absmax FROM customer GROUP BY 1, 2")
def r05_element_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.envelope(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal")


DAILY = "(SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS step, max(value) AS value FROM " + EVENTS + " GROUP BY 1, 2)"
DRIFT = "SELECT a.step, a.user_id AS i, b.user_id AS j, (b.value - a.value) / (1 + a.user_id % 3) AS drift FROM " + DAILY + " a JOIN " + DAILY + " b ON a.step = b.step AND b.user_id = a.user_id + 1"


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.floor(F.col("t") / 86400).cast("long").alias("step")).agg(F.max("value").alias("value"))


def _pairs(daily: DataFrame) -> DataFrame:
    return daily.select("user_id").distinct().select(F.col("user_id").alias("i"), (F.col("user_id") + 1).alias("j"), (1 + F.col("user_id") % 3).cast("double").alias("length"))


@query("SELECT step, i, j, round(drift, 6) + 0.0 AS drift FROM (" + DRIFT + ")")
def r06_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    return rounded(R.drift(daily, _pairs(daily), ["step"], "user_id"), "drift")


@query("SELECT i, j, round(min(drift), 6) + 0.0 AS v_min, round(max(drift), 6) + 0.0 AS v_max, round(max(abs(drift)), 6) AS v_absmax FROM (" + DRIFT + ") GROUP BY 1, 2")
def r07_drift_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    return rounded(R.drift_envelope(daily, _pairs(daily), ["step"], "user_id"), "v_min", "v_max", "v_absmax")


@query("SELECT user_id, event_type, round(sqrt(avg(value * value)), 6) AS rms, count(value) AS n FROM events GROUP BY 1, 2")
def r08_node_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.rms(events(spark, sf_dir), ["user_id", "event_type"]), "rms")


@query("SELECT l_suppkey, round(sqrt(avg(l_extendedprice * l_extendedprice)), 4) AS rms, count(l_extendedprice) AS n FROM lineitem GROUP BY 1")
def r09_element_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.rms(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice"), "rms", digits=4)


@query("SELECT l_orderkey, round(sqrt(sum(l_quantity * l_quantity)), 6) AS norm FROM lineitem GROUP BY 1")
def r10_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.norm(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity"), "norm")


@query("""SELECT user_id, round(min(norm), 6) AS v_min, round(max(norm), 6) AS v_max, round(max(abs(norm)), 6) AS v_absmax FROM
    (SELECT user_id, floor(t / 86400) AS step, sqrt(sum(value * value)) AS norm FROM """ + EVENTS + """ GROUP BY 1, 2) GROUP BY 1""")
def r11_norm_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("step", F.floor(F.col("t") / 86400))
    return rounded(R.norm_envelope(rows, ["user_id", "step"], ["user_id"]), "v_min", "v_max", "v_absmax")


@query("SELECT c_custkey AS user_id, coalesce(max(abs(value)), 0.0) AS max_abs FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def r12_max_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return R.max_abs(users, table(spark, sf_dir, "events"), "user_id")


@query("WITH " + GATE + " SELECT e.user_id, e.event_id, CASE WHEN g.t IS NULL THEN 0.0 ELSE e.value END AS value FROM e LEFT JOIN g USING (user_id, t)")
def r13_pattern_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "t", "value")
    return R.pattern_factor(rows, ["user_id"], 40000.0).select("user_id", "event_id", "value")


@query("WITH " + GATE + """, w AS (SELECT e.user_id, e.event_id, e.t, max(abs(e.value)) OVER o / 600.0 AS damage, g.t IS NOT NULL AS emitted FROM e LEFT JOIN g USING (user_id, t) WINDOW o AS (PARTITION BY e.user_id ORDER BY e.t))
    SELECT user_id, event_id, round(last_value(CASE WHEN emitted THEN damage END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t), 6) AS damage FROM w""")
def r14_damage_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("user_id", "event_id", "t", F.col("value").alias("defo"), F.lit(0.0).alias("force"))
    rows = A.park_ang(rows, ["user_id"], "t", 600.0, 0.1, 1.0).select("user_id", "event_id", "t", "damage")
    held = R.held_when_closed(R.gate(rows, ["user_id"], 40000.0), ["user_id"], "damage")
    return rounded(held.select("user_id", "event_id", "damage"), "damage")


@query("""WITH gone AS (SELECT DISTINCT l_orderkey AS tag FROM lineitem WHERE abs(l_quantity) > 49)
    SELECT o_orderkey AS tag, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT tag FROM gone) AND o_orderkey NOT IN (SELECT tag + 1 FROM gone)""")
def r15_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tag"), "o_custkey")
    links = orders.select("tag", (F.col("tag") + 1).alias("dependant"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_tag"), F.col("l_quantity").alias("value"))
    return R.removed(orders, links, rows, 49.0)


@query("SELECT user_id, event_id, round(value - lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id), 6) + 0.0 AS increment FROM events")
def r16_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return rounded(R.increments(rows, ["user_id"], "event_id", "value").drop("value"), "increment")


@query("SELECT vec_id, round(sqrt(2 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm, 2 * len(embedding) AS size FROM embeddings")
def r18_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    both = R.composite(v, v)
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(vectors.norm(both), 5).alias("norm"), F.size(both).cast("long").alias("size"))


# time series

T = "(SELECT event_id, event_id / 100.0::DOUBLE AS t FROM events)"


def _series(name: str, sql: str, factor: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return steps(spark, sf_dir).select("event_id", r6(factor(F.col("t"))).alias("factor"))

    run.__name__ = name
    query(f"SELECT event_id, round({sql}, 6) + 0.0 AS factor FROM {T}")(run)


_inside = "CASE WHEN t >= 2 AND t <= 90 THEN {} ELSE 0.0 END".format
_k = "(((t + {0} - 2) / 7e0) - floor((t + {0} - 2) / 7e0))".format
_series("t01_constant", "2.5::DOUBLE", lambda t: series.constant(t, 2.5))
_series("t02_linear", "1.75::DOUBLE * t", lambda t: series.linear(t, 1.75))
_series("t03_rectangular", _inside("3e0"), lambda t: series.rectangular(t, 2.0, 90.0, 3.0))
_series("t04_trig", _inside("3e0 * sin(2 * pi() * (t - 2) / 7e0 + 0.4e0 - 7e0 / (2 * pi()) * asin(0.5e0 / 3e0)) + 0.5e0"), lambda t: series.trigonometric(t, 2.0, 90.0, 7.0, 0.4, 3.0, 0.5))
_tk = _k("(0.3e0 - 0.5e0 / (3e0 / 1.75e0))")
_series("t05_triangle", _inside(f"(CASE WHEN {_tk} < 0.25 THEN 12e0 * {_tk} WHEN {_tk} < 0.75 THEN 3e0 - 12e0 * ({_tk} - 0.25e0) ELSE -3e0 + 12e0 * ({_tk} - 0.75e0) END) + 0.5e0"), lambda t: series.triangle(t, 2.0, 90.0, 7.0, 0.3, 3.0, 0.5))
_series("t06_pulse", _inside(f"CASE WHEN {_k('0.3e0')} < 0.4 THEN 3.5e0 ELSE 0.5e0 END"), lambda t: series.pulse(t, 2.0, 90.0, 7.0, 0.4, 0.3, 3.0, 0.5))
_series("t07_ramp", "0.5e0 + 3e0 * (CASE WHEN t <= 5 THEN 0 WHEN t <= 5 + 0.2e0 * 41 / 2 THEN power((t - 5) / 41, 2) * 2 / (0.2e0 * 1.8e0) WHEN t <= 46 - 0.2e0 * 41 / 2 THEN 0.5e0 + (t - 5 - 20.5e0) / 41 * 2 / 1.8e0 WHEN t <= 46 THEN 1 - power((t - 46) / 41, 2) * 2 / (0.2e0 * 1.8e0) ELSE 1 END)", lambda t: series.ramp(t, 5.0, 41.0, 0.2, 0.5, 3.0))
_arg = "(2 * pi() * t / 7e0 - pi() * 2e0 + 30e0 * pi() / 180)"
_series("t08_velocity_pulse", _inside(f"1.5e0 * pi() / (7e0 * 2e0) * (sin(2 * pi() * t / 14e0) * cos({_arg}) - 2e0 * sin({_arg}) * (1 - cos(2 * pi() * t / 14e0)))"), lambda t: series.velocity_pulse(t, 2.0, 90.0, 7.0, 2.0, 30.0, 1.5))
_wd = "(2e0 * sqrt(1 - 0.05e0 * 0.05e0))"
_series("t24_delta_filter", "CASE WHEN abs(t - 50) > 3e0 + 1e-14 THEN 0 ELSE 1 - abs(t - 50) / 3e0 END", lambda t: series.delta_filter(t - 50, 3.0))
_series("t24_koo_filter", f"CASE WHEN t - 5 < 0 THEN 0 ELSE -(2e0 / sqrt(1 - 0.0025e0) * sin({_wd} * (t - 5)) + 0.2e0 * cos({_wd} * (t - 5))) * exp(-0.1e0 * (t - 5)) END", lambda t: series.koo_filter(t - 5, 2.0, 0.05))
_series("t24_displacement_filter", f"CASE WHEN t - 5 < 0 THEN 0 ELSE sin({_wd} * (t - 5)) * exp(-0.1e0 * (t - 5)) END", lambda t: series.oscillator_filter(t - 5, 2.0, 0.05))
_series("t24_velocity_filter", f"CASE WHEN t - 5 < 0 THEN 0 ELSE ({_wd} * cos({_wd} * (t - 5)) - 0.1e0 * sin({_wd} * (t - 5))) * exp(-0.1e0 * (t - 5)) END", lambda t: series.oscillator_filter(t - 5, 2.0, 0.05, "velocity"))
_series("t24_acceleration_filter", f"CASE WHEN t - 5 < 0 THEN 0 ELSE (0.01e0 * sin({_wd} * (t - 5)) - 0.2e0 * {_wd} * cos({_wd} * (t - 5)) - {_wd} * {_wd} * sin({_wd} * (t - 5))) * exp(-0.1e0 * (t - 5)) END", lambda t: series.oscillator_filter(t - 5, 2.0, 0.05, "acceleration"))
_series("t25_constant_modulation", "0.7::DOUBLE", lambda t: series.constant_modulation(t, 0.7))
_series("t25_gamma_modulation", "0.2e0 * power(t, 1.5e0) * exp(-0.3e0 * t)", lambda t: series.gamma_modulation(t, 0.2, 1.5, 0.3))
_series("t25_trapezoid_modulation", "CASE WHEN t < 10 THEN 0 WHEN t < 30 THEN 2e0 / 20 * (t - 10) WHEN t < 60 THEN 2e0 WHEN t < 80 THEN 2e0 - 2e0 / 20 * (t - 60) ELSE 0 END", lambda t: series.trapezoid_modulation(t, 10.0, 30.0, 60.0, 80.0, 2.0))
_series("t25_koo_modulation", "CASE WHEN t < 0 THEN 0 WHEN t < 5 THEN t * t / 25e0 WHEN t < 10 THEN 1 ELSE exp(-0.5e0 * (t - 10e0)) END", lambda t: series.koo_modulation(t, 5.0, 10.0))
_series("t26_jonswap", "CASE WHEN t < 1 OR t > 60 THEN 0 ELSE power(3.3e0, exp(-(t - 20) * (t - 20) / (2 * power(CASE WHEN t < 20 THEN 0.07e0 ELSE 0.09e0 END, 2) * 400))) * 81e5 * power(t, -5) * exp(-1.25e0 * power(t / 20, -4)) END", lambda t: series.jonswap_spectrum(t, 1.0, 60.0, 81e5, 20.0, 3.3))
_series("t26_narrow_band", "CASE WHEN t < 10 OR t > 60 THEN 0 ELSE 1.2e0 END", lambda t: series.narrow_band_spectrum(t, 10.0, 60.0, 1.2))
_series("t26_points_spectrum", "CASE WHEN t < 10 OR t > 60 THEN 0 WHEN t <= 30 THEN 1e0 + (t - 10) / 20 * 2 ELSE 3e0 - (t - 30) / 30 * 2.5e0 END", lambda t: series.points_spectrum(t, [(10.0, 1.0), (30.0, 3.0), (60.0, 0.5)]))

PULSES = [(0.0, 1.0), (7.5, -0.5), (20.0, 2.0), (44.0, -1.0), (70.0, 0.75)]


@query("""SELECT event_id, CASE WHEN t = 0 THEN 0 ELSE round(0.1e0 + 2e0 * 0.8e0 * (SELECT sum(u * CASE WHEN t - ti < 0 THEN 0 ELSE sin(""" + _wd + """ * (t - ti)) * exp(-0.1e0 * (t - ti)) END)
    FROM (VALUES (0e0, 1e0), (7.5e0, -0.5e0), (20e0, 2e0), (44e0, -1e0), (70e0, 0.75e0)) p(ti, u)), 6) END + 0.0 AS factor FROM """ + T)
def t09_random_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulses = spark.createDataFrame(PULSES, "ti double, u double")
    out = S.random_process(steps(spark, sf_dir), pulses, F.lit(0.8), lambda lag: series.oscillator_filter(lag, 2.0, 0.05), 0.1, 2.0)
    return rounded(out.select("event_id", "factor"), "factor")


@query("""SELECT event_id, CASE WHEN t = 0 THEN 0 ELSE round(0.1e0 + (SELECT sum(sqrt(2 * 1.2e0 * 0.5e0) * a * cos(((i + 0.5e0) * 0.5e0 + 0.2e0) * t + ph))
    FROM (VALUES (0, 1e0, 0.1e0), (1, -0.5e0, 1.1e0), (2, 0.7e0, 2.1e0), (3, 0.2e0, 3e0)) w(i, a, ph)), 6) END + 0.0 AS factor FROM """ + T)
def t10_spectral_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    waves = spark.createDataFrame([(0, 1.0, 0.1), (1, -0.5, 1.1), (2, 0.7, 2.1), (3, 0.2, 3.0)], "i int, a double, phase double")
    out = S.spectral_process(steps(spark, sf_dir), waves, F.lit(1.2), 0.2, 0.5, 0.1)
    return rounded(out.select("event_id", "factor"), "factor")


@query("""WITH p AS (SELECT user_id, t, value FROM """ + EVENTS + """ WHERE event_id % 2 = 0), q AS (SELECT user_id, event_id, t FROM """ + EVENTS + """ WHERE event_id % 2 = 1),
    b AS (SELECT q.*, p.t AS t0, p.value AS v0 FROM q ASOF LEFT JOIN p ON q.user_id = p.user_id AND q.t >= p.t),
    c AS (SELECT b.*, p.t AS t1, p.value AS v1 FROM b ASOF LEFT JOIN p ON b.user_id = p.user_id AND b.t <= p.t)
    SELECT user_id, event_id, round(CASE WHEN t0 IS NULL OR t1 IS NULL THEN 0 WHEN t1 = t0 THEN v0 ELSE v0 + (t - t0) / (t1 - t0) * (v1 - v0) END, 5) + 0.0 AS factor FROM c""")
def t11_path_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    path = rows.where("event_id % 2 = 0").select("user_id", "t", F.col("value").alias("v"))
    asked = rows.where("event_id % 2 = 1").select("user_id", "event_id", "t")
    out = asked.join(S.interpolate_times(asked, path, ["user_id"]), ["user_id", "t"])
    return rounded(out.select("user_id", "event_id", "factor"), "factor", digits=5)


@query("""WITH p AS (SELECT user_id, row_number() OVER o - 1 AS i, value AS a, lead(value) OVER o AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    q AS (SELECT user_id, event_id, (event_id % 997) / 10e0 AS t FROM events)
    SELECT q.user_id, q.event_id, round(coalesce(2e0 * (a + (t / 1.5e0 - i) * (b - a)), 0), 6) + 0.0 AS factor FROM q LEFT JOIN p ON p.user_id = q.user_id AND p.i = floor(t / 1.5e0)""")
def t12_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    path = e.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("i"), F.col("value").alias("v"))
    times = e.select("user_id", "event_id", ((F.col("event_id") % 997) / 10.0).alias("t"))
    return rounded(S.interpolate(times, path, ["user_id"], 1.5, factor=2.0).select("user_id", "event_id", "factor"), "factor")


TRAP = "(SELECT user_id, event_id, 0.5e0 * 0.01e0 * (value + lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id)) AS area, value FROM events)"


@query("SELECT user_id, event_id, round(sum(area) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS integral FROM " + TRAP)
def t13_integrate_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.integrate_trapezoid(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 0.01)
    return rounded(out.select("user_id", "event_id", "integral"), "integral")


@query("""WITH s AS (SELECT user_id, event_id, CASE WHEN row_number() OVER o % 2 = 0 THEN 1e0 ELSE -1e0 END AS sg, 2 / 0.5e0 * (value - lag(value, 1, 0.0) OVER o) AS st FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, round(sg * sum(sg * st) OVER (PARTITION BY user_id ORDER BY event_id), 4) + 0.0 AS derivative FROM s""")
def t14_differentiate_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.differentiate_trapezoid(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 0.5)
    return rounded(out.select("user_id", "event_id", "derivative"), "derivative", digits=4)


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER o % 2 AS odd, 0.01e0 / 3 * (lag(value, 2, 0.0) OVER o + 4 * lag(value, 1, 0.0) OVER o + value) AS area FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, round(sum(area) OVER (PARTITION BY user_id, odd ORDER BY event_id), 6) AS integral FROM s""")
def t15_integrate_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.integrate_simpson(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 0.01)
    return rounded(out.select("user_id", "event_id", "integral"), "integral")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    r AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, 0e0 AS f2, 0e0 AS f1, 0e0 AS v2, 0e0 AS v1 FROM events
    UNION ALL SELECT s.user_id, s.event_id, s.i, r.f1, 3 * (s.value - r.v2) / 0.5e0 - r.f2 - 4 * r.f1, r.v1, s.value FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
    SELECT user_id, event_id, f1 AS derivative FROM r WHERE i > 0""")
def t16_differentiate_simpson(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return S.differentiate_simpson(rows, ["user_id"], "event_id", "value", 0.5).select("user_id", "event_id", "derivative")


@query("SELECT user_id, 1.5e0 * max(abs(value)) AS peak, round(count(value) * 0.02e0, 6) AS duration FROM events GROUP BY 1")
def t17_peak_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.peak_factor(table(spark, sf_dir, "events"), ["user_id"], "value", 0.02, 1.5), "duration")


@query("""WITH v AS (SELECT user_id, event_id, sum(area) OVER (PARTITION BY user_id ORDER BY event_id) AS velocity FROM """ + TRAP + """),
    d AS (SELECT *, 0.5e0 * 0.01e0 * (velocity + lag(velocity, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id)) AS area FROM v)
    SELECT user_id, event_id, round(velocity, 8) AS velocity, round(sum(area) OVER (PARTITION BY user_id ORDER BY event_id), 8) AS displacement FROM d""")
def t18_ground_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.ground_motion(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 0.01)
    return rounded(out.select("user_id", "event_id", "velocity", "displacement"), "velocity", "displacement", digits=8)


WEIGHTS = [("click", 0.5), ("view", 0.3), ("error", -0.2)]


@query("""WITH c AS (SELECT user_id % 10 AS record, event_id % 50 AS t, sum(w * value) AS value FROM events JOIN (VALUES ('click', 0.5e0), ('view', 0.3e0), ('error', -0.2e0)) x(event_type, w) USING (event_type) GROUP BY 1, 2)
    SELECT record, round(greatest(max(value), 0.0), 6) AS peak, max(t) AS duration FROM c GROUP BY 1""")
def t19_combined_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("record"), F.col("event_type").alias("motion"), (F.col("event_id") % 50).alias("t"), F.col("value").alias("v"))
    weights = spark.createDataFrame(WEIGHTS, "motion string, weight double")
    return rounded(S.combined_peak(S.combined_motion(rows, weights, ["record"]), ["record"]), "peak")


DAYS = "(SELECT DISTINCT CAST(user_id % 25 AS INTEGER) AS pattern, CAST(floor(t / 86400) AS BIGINT) - 19723 AS day FROM " + EVENTS + ")"


@query("SELECT c_custkey, day, round(c_acctbal * CASE WHEN day >= 2 AND day <= 24 THEN 0.25e0 ELSE 0 END, 6) + 0.0 AS load FROM " + DAYS + " JOIN customer ON c_nationkey = pattern")
def t20_pattern_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.floor(F.col("t") / 86400) - 19723).cast("long")
    times = events(spark, sf_dir).select((F.col("user_id") % 25).cast("int").alias("pattern"), day.alias("day")).distinct()
    loads = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("pattern"), F.col("c_acctbal").alias("value"))
    factor = series.rectangular(F.col("day").cast("double"), 2.0, 24.0, 0.25)
    return rounded(S.applied_loads(loads, times, factor).select("c_custkey", "day", "load"), "load")


POINTS = [(5.0, 1.0), (10.0, 2.5), (25.0, 2.0), (40.0, 0.5)]
SA = "CASE WHEN {0} <= 5 THEN 1e0 WHEN {0} <= 10 THEN 1e0 + ({0} - 5) / 5e0 * 1.5e0 WHEN {0} <= 25 THEN 2.5e0 - ({0} - 10) / 15e0 * 0.5e0 WHEN {0} <= 40 THEN 2e0 - ({0} - 25) / 15e0 * 1.5e0 ELSE 0.5e0 END".format


@query("SELECT p_partkey, round(" + SA("p_size") + ", 6) AS sa FROM part")
def t21_spectrum_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", r6(S.spectrum_value(F.col("p_size").cast("double"), POINTS)).alias("sa"))


@query("""WITH m AS (SELECT vec_id AS mode, 1.0 + vec_id % 7 AS lam, 0.1e0 * (1 + vec_id % 5) AS participation FROM embeddings),
    v AS (SELECT vec_id AS mode, unnest(range(64)) AS node, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT mode, node, round(v * participation * """ + SA("(2 * pi() / sqrt(lam))") + """ / lam, 6) + 0.0 AS u FROM v JOIN m USING (mode)""")
def t22_modal_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "mode")
    modes = e.select("mode", (1.0 + F.col("mode") % 7).alias("lam"), (0.1 * (1 + F.col("mode") % 5)).alias("participation"))
    vectors_ = e.select("mode", F.posexplode(F.col("embedding").cast("array<double>")).alias("node", "v"))
    return rounded(S.modal_displacements(modes, vectors_, POINTS).select("mode", F.col("node").cast("long").alias("node"), "u"), "u")


@query("""WITH v AS (SELECT vec_id AS mode, unnest(range(64)) AS node, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
    m AS (SELECT range AS node, 1 + range % 4 AS mass FROM range(64)), s AS (SELECT mode, sum(v * mass * v) AS g, sum(v * mass) AS l FROM v JOIN m USING (node) GROUP BY 1)
    SELECT mode, round(g, 5) AS generalised_mass, round(l / g, 5) + 0.0 AS participation, round(l * l / g, 5) AS effective_mass, round(l * l / g / 160, 6) AS ratio, round(sum(l * l / g / 160) OVER (ORDER BY mode), 5) AS cumulative FROM s""")
def t23_modal_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mode"), F.posexplode(F.col("embedding").cast("array<double>")).alias("node", "v")).withColumn("dof", F.lit(1))
    masses = spark.range(64).select(F.col("id").cast("int").alias("node"), F.lit(1).alias("dof"), (1 + F.col("id") % 4).cast("double").alias("mass"), F.lit(1.0).alias("r"))
    out = S.modal_properties(v, masses)
    return rounded(rounded(out, "ratio"), "generalised_mass", "participation", "effective_mass", "cumulative", digits=5)


# vectors, matrices and sets

VECS = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"


def _vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm2, round(power(list_sum(list_transform(x, lambda v: power(abs(v), 3))), 1 / 3e0), 6) AS norm3, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS norm0 FROM " + VECS)
def m01_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _vecs(spark, sf_dir).select("vec_id", r6(vectors.norm(x)).alias("norm2"), r6(vectors.p_norm(x, 3)).alias("norm3"), r6(vectors.p_norm(x, 0)).alias("norm0"))


@query("SELECT vec_id, round(x[1] / sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) + 0.0 AS first, len(x) AS size, 0.0 AS zero, 100 AS resized FROM " + VECS)
def m02_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _vecs(spark, sf_dir).select("vec_id", r6(vectors.normalized(x)[0]).alias("first"), F.size(x).cast("long").alias("size"), vectors.zero(x)[0].alias("zero"), F.size(vectors.resized(x, 100)).alias("resized"))


@query("SELECT vec_id, unnest(range(64)) AS i, round(2 * unnest(x) - 0.5e0 * unnest(list_reverse(x)), 6) + 0.0 AS v FROM " + VECS)
def m03_add_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = vectors.combined(F.col("x"), 2.0, F.reverse("x"), -0.5)
    out = _vecs(spark, sf_dir).select("vec_id", F.posexplode(y).alias("i", "v"))
    return rounded(out.withColumn("i", F.col("i").cast("long")), "v")


MATRIX = "(SELECT l_suppkey % 40 AS i, l_partkey % 50 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("i"), (F.col("l_partkey") % 50).alias("j")).agg(F.sum("l_quantity").alias("v"))


@query("SELECT a.i, round(sum(a.v * (1 + a.j % 3)), 4) AS v FROM " + MATRIX + " a GROUP BY 1")
def m04_matrix_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(50).select(F.col("id").alias("i"), (1.0 + F.col("id") % 3).alias("v"))
    return rounded(vectors.times_vector(_matrix(spark, sf_dir), x), "v", digits=4)


@query("SELECT vec_id, round(x[4], 6) AS a, round(x[1], 6) AS b, NULL::DOUBLE AS c FROM " + VECS)
def m05_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vectors.gathered(F.col("x"), F.array(F.lit(3), F.lit(0), F.lit(64)))
    return _vecs(spark, sf_dir).select("vec_id", F.round(got[0], 6).alias("a"), F.round(got[1], 6).alias("b"), got[2].alias("c"))


@query("SELECT l_partkey * 4 + l_linenumber % 4 AS equation, round(sum(l_extendedprice), 2) AS value FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1")
def m06_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("element"), (F.col("l_linenumber") % 4).alias("local"), F.col("l_extendedprice").alias("v"))
    keys = rows.select("element", "local").distinct()
    dof_map = keys.withColumn("equation", F.when(F.col("element") % 9 == 0, F.lit(-1)).otherwise(F.col("element") * 4 + F.col("local")))
    return rounded(vectors.assemble(rows, dof_map, ["element", "local"]), "value", digits=2)


@query("SELECT vec_id, round(x[11] + 2 * x[1], 6) + 0.0 AS a, round(x[2], 6) + 0.0 AS b FROM " + VECS)
def m07_assemble_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    y = vectors.placed(x, vectors.extracted(x, 0, 5), 10, 2.0)
    return _vecs(spark, sf_dir).select("vec_id", r6(y[10]).alias("a"), r6(y[1]).alias("b"))


@query("SELECT vec_id, round(x[1] + 1.5e0, 6) AS a, round(x[1] * 1.5e0, 6) + 0.0 AS b, round(x[1] / 1.5e0, 6) + 0.0 AS c, round(x[1] - 1.5e0, 6) AS d FROM " + VECS)
def m08_scalar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vecs(spark, sf_dir).select("vec_id", *(r6(vectors.scaled(F.col("x"), op, 1.5)[0]).alias(n) for n, op in (("a", "+"), ("b", "*"), ("c", "/"), ("d", "-"))))


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(x, list_reverse(x)), lambda p: p[1] * p[2])), 6) + 0.0 AS dot, round(x[3] * x[64], 6) + 0.0 AS outer_2_0 FROM " + VECS)
def m09_dot_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.reverse("x")
    return _vecs(spark, sf_dir).select("vec_id", r6(vectors.dot(x, y)).alias("dot"), r6(vectors.outer(x, y)[2][0]).alias("outer_2_0"))


@query("SELECT vec_id, false AS all_zero, x = x AS same FROM " + VECS)
def m10_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vecs(spark, sf_dir).select("vec_id", vectors.equals(F.col("x"), 0.0).alias("all_zero"), (F.col("x") == F.col("x")).alias("same"))


@query("SELECT i, v FROM " + MATRIX + " WHERE i = j")
def m11_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.diagonal(_matrix(spark, sf_dir))


@query("""SELECT vec_id, round((b * d - c * e) / (a * d - c * c), 5) + 0.0 AS x0, round((a * e - c * b) / (a * d - c * c), 5) + 0.0 AS x1, round(d / (a * d - c * c), 5) + 0.0 AS inv00
    FROM (SELECT vec_id, 2 + x[1] AS a, 3 + x[2] AS d, x[3] AS c, x[4] AS b, x[5] AS e FROM """ + VECS + ")")
def m12_solve_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    m = F.array(F.array(2 + x[0], x[2]), F.array(x[2], 3 + x[1]))
    rows = _vecs(spark, sf_dir).select("vec_id", m.alias("m"), F.array(x[3], x[4]).alias("b"))
    rows = rows.select("vec_id", vectors.solved("m", "b").alias("s"), vectors.inverted("m").alias("n"))
    return rows.select("vec_id", r6(F.col("s")[0], 5).alias("x0"), r6(F.col("s")[1], 5).alias("x1"), r6(F.col("n")[0][0], 5).alias("inv00"))


@query("WITH m AS " + MATRIX + " SELECT a.i, b.i AS j, round(sum(a.v * b.v), 2) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY 1, 2")
def m13_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return rounded(vectors.multiply(m, m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")), "v", digits=2)


@query("WITH m AS " + MATRIX + " SELECT a.j AS i, b.j, round(sum(a.v * b.v * (1 + a.i % 2)), 2) AS v FROM m a JOIN m b ON a.i = b.i GROUP BY 1, 2")
def m14_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.range(40).select(F.col("id").alias("i"), F.col("id").alias("j"), (1.0 + F.col("id") % 2).alias("v"))
    return rounded(vectors.triple(_matrix(spark, sf_dir), b), "v", digits=2)


@query("SELECT i, j, v FROM " + MATRIX + " WHERE i % 2 = 0 AND j < 10")
def m15_sub_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.sub_matrix(_matrix(spark, sf_dir), spark.range(0, 40, 2).withColumnRenamed("id", "i"), spark.range(10).withColumnRenamed("id", "j"))


@query("SELECT j AS i, round(sum(v * (1 + i % 3)), 4) AS v FROM " + MATRIX + " GROUP BY 1")
def m16_transpose_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(40).select(F.col("id").alias("i"), (1.0 + F.col("id") % 3).alias("v"))
    return rounded(vectors.times_vector(_matrix(spark, sf_dir), x, transpose=True), "v", digits=4)


@query("WITH m AS " + MATRIX + " SELECT i, j, round(sum(v), 4) AS v FROM (SELECT i, j, 2 * v AS v FROM m UNION ALL SELECT j, i, -0.5e0 * v FROM m) GROUP BY 1, 2")
def m17_add_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return rounded(vectors.added(m, 2.0, m, -0.5, transpose_b=True), "v", digits=4)


@query("SELECT vec_id, round((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + c * c), 5) + 0.0 AS low, round((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + c * c), 5) + 0.0 AS high FROM (SELECT vec_id, x[1] AS a, x[2] AS d, x[3] AS c FROM " + VECS + ")")
def m18_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    rows = _vecs(spark, sf_dir).select("vec_id", vectors.eigenvalues(F.array(F.array(x[0], x[2]), F.array(x[2], x[1]))).alias("e"))
    return rows.select("vec_id", r6(F.col("e")[0], 5).alias("low"), r6(F.col("e")[1], 5).alias("high"))


@query("""SELECT vec_id, round(cos(a) + u * u * (1 - cos(a)), 6) + 0.0 AS r00, round(cos(a / 2), 6) AS q0 FROM
    (SELECT vec_id, x[4] AS a, x[1] / sqrt(x[1] * x[1] + x[2] * x[2] + x[3] * x[3]) AS u FROM """ + VECS + ")")
def m19_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis, angle = F.slice("x", 1, 3), F.col("x")[3]
    return _vecs(spark, sf_dir).select("vec_id", r6(vectors.rotation(axis, angle)[0][0]).alias("r00"), F.round(vectors.versor(axis, angle)[0], 6).alias("q0"))


@query("""SELECT l_orderkey, list_sort(list_distinct(list_append(ids, 7))) AS inserted, CAST(coalesce(list_position(u, ids[1]), 0) - 1 AS INTEGER) AS place, len(list_filter(ids, lambda v: v <> ids[1])) AS rest, len(u) AS n
    FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_suppkey) AS ids, list_sort(list_distinct(list(l_partkey))) AS u FROM lineitem GROUP BY 1)""")
def m20_index_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_partkey")).alias("ids"))
    ids = F.col("ids")
    u = vectors.unique(ids)
    return rows.select("l_orderkey", vectors.inserted(ids, F.lit(7).cast("long")).alias("inserted"), vectors.location(u, ids[0]).alias("place"), F.size(vectors.without(ids, ids[0])).cast("long").alias("rest"), F.size(u).cast("long").alias("n"))


# distributions: density, cumulative probability at a quantity, inverse at a probability

SAMPLES = "(SELECT DISTINCT l_quantity AS x, l_quantity / 51e0 AS p FROM lineitem)"


def _law(name: str, law: D.Distribution, pdf: str, cdf: str, inverse: str | None, shift: float = 0.0) -> None:
    """inverse None: the inverse has no closed form, and the query returns the probability at it, p again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = F.col("l_quantity")
        rows = table(spark, sf_dir, "lineitem").select((q - shift).alias("x"), (q / 51.0).alias("p")).distinct()
        rows = rows.withColumn("inverse", law.inverse(F.col("p")))
        back = law.cdf(F.col("inverse")) if inverse is None else F.col("inverse")
        return rows.select("x", r6(law.pdf(F.col("x"))).alias("pdf"), r6(law.cdf(F.col("x"))).alias("cdf"), r6(back, 5).alias("inverse"))

    run.__name__ = name
    source = SAMPLES if not shift else f"(SELECT x - {shift} AS x, p FROM {SAMPLES})"
    query(f"SELECT x, round({pdf}, 6) + 0.0 AS pdf, round({cdf}, 6) + 0.0 AS cdf, round({inverse or 'p'}, 5) + 0.0 AS inverse FROM {source}")(run)


_law("p01_beta", D.Beta(0.0, 60.0, 2.0, 3.0), "(x / 60) * power(1 - x / 60, 2) * 12 / 60", "6 * power(x / 60, 2) - 8 * power(x / 60, 3) + 3 * power(x / 60, 4)", None)
_law("p02_chi_square", D.ChiSquare(6.0), "power(x / 2, 2) * exp(-x / 2) / 4", "1 - exp(-x / 2) * (1 + x / 2 + power(x / 2, 2) / 2)", None)
_law("p03_exponential", D.Exponential(0.05), "0.05e0 * exp(-0.05e0 * x)", "1 - exp(-0.05e0 * x)", "-ln(1 - p) / 0.05e0")
_law("p04_gamma", D.Gamma(3.0, 0.2), "0.2e0 / 2 * power(0.2e0 * x, 2) * exp(-0.2e0 * x)", "1 - exp(-0.2e0 * x) * (1 + 0.2e0 * x + power(0.2e0 * x, 2) / 2)", None)
_law("p05_gumbel", D.Gumbel(20.0, 0.1), "0.1e0 * exp(-0.1e0 * (x - 20) - exp(-0.1e0 * (x - 20)))", "exp(-exp(-0.1e0 * (x - 20)))", "20 - ln(-ln(p)) / 0.1e0")
_law("p06_laplace", D.Laplace(25.0, 0.2), "0.1e0 * exp(-0.2e0 * abs(x - 25))", "CASE WHEN x < 25 THEN 0.5e0 * exp(-0.2e0 * abs(x - 25)) ELSE 1 - 0.5e0 * exp(-0.2e0 * abs(x - 25)) END", "CASE WHEN p < 0.5 THEN 25 + ln(2 * p) / 0.2e0 ELSE 25 - ln(2 * (1 - p)) / 0.2e0 END")
_law("p07_lognormal", D.Lognormal(3.0, 0.5), "exp(-0.5e0 * power((ln(x) - 3) / 0.5e0, 2)) / (sqrt(2 * pi()) * 0.5e0 * x)", normal.cdf_sql("((ln(x) - 3) / 0.5e0)"), f"exp(3 + 0.5e0 * {normal.inverse_sql('p')})")
_law("p07_negative_lognormal", D.Lognormal(3.0, 0.5, False), "CASE WHEN x < 0 THEN exp(-0.5e0 * power((ln(greatest(-x, 1e-300)) - 3) / 0.5e0, 2)) / (sqrt(2 * pi()) * 0.5e0 * -x) ELSE 0 END", f"CASE WHEN x < 0 THEN 1 - {normal.cdf_sql('((ln(greatest(-x, 1e-300)) - 3) / 0.5e0)')} ELSE 1 END", f"-exp(3 + 0.5e0 * {normal.inverse_sql('(1 - p)')})", 25.5)
_law("p08_normal", D.Normal(25.0, 8.0), normal.pdf_sql("((x - 25) / 8e0)") + " / 8e0", normal.cdf_sql("((x - 25) / 8e0)"), f"25 + 8e0 * {normal.inverse_sql('p')}")
_law("p09_pareto", D.Pareto(2.5, 5.0), "CASE WHEN x >= 5 THEN 2.5e0 / 5 * power(5 / x, 3.5e0) ELSE 0 END", "CASE WHEN x >= 5 THEN 1 - power(5 / x, 2.5e0) ELSE 0 END", "5 * power(1 - p, -1 / 2.5e0)")
_law("p11_rayleigh", D.Rayleigh(20.0), "2 * x / 400e0 * exp(-power(x / 20e0, 2))", "1 - exp(-power(x / 20e0, 2))", "20 * sqrt(-ln(1 - p))")
_law("p12_shifted_exponential", D.ShiftedExponential(0.1, 10.0), "CASE WHEN x >= 10 THEN 0.1e0 * exp(-0.1e0 * (x - 10)) ELSE 0 END", "CASE WHEN x >= 10 THEN 1 - exp(-0.1e0 * (x - 10)) ELSE 0 END", "10 - ln(1 - p) / 0.1e0")
_law("p13_shifted_rayleigh", D.ShiftedRayleigh(20.0, 10.0), "CASE WHEN x > 10 THEN 2 * (x - 10) / 400e0 * exp(-power((x - 10) / 20e0, 2)) ELSE 0 END", "CASE WHEN x > 10 THEN 1 - exp(-power((x - 10) / 20e0, 2)) ELSE 0 END", "10 + 20 * sqrt(-ln(1 - p))")
_law("p14_type1_largest", D.Type1LargestValue(15.0, 0.2), "0.2e0 * exp(-0.2e0 * (x - 15) - exp(-0.2e0 * (x - 15)))", "exp(-exp(-0.2e0 * (x - 15)))", "15 - ln(-ln(p)) / 0.2e0")
_law("p15_type1_smallest", D.Type1SmallestValue(30.0, 0.1), "0.1e0 * exp(0.1e0 * (x - 30) - exp(0.1e0 * (x - 30)))", "1 - exp(-exp(0.1e0 * (x - 30)))", "30 + ln(-ln(1 - p)) / 0.1e0")
_law("p16_type2_largest", D.Type2LargestValue(10.0, 3.0), "3e0 / 10 * power(10 / x, 4) * exp(-power(10 / x, 3))", "exp(-power(10 / x, 3))", "10 * power(-ln(p), -1 / 3e0)")
_law("p17_type3_smallest", D.Type3SmallestValue(5.0, 25.0, 2.0), "CASE WHEN x > 5 THEN 2e0 / 20 * ((x - 5) / 20e0) * exp(-power((x - 5) / 20e0, 2)) ELSE 0 END", "CASE WHEN x > 5 THEN 1 - exp(-power((x - 5) / 20e0, 2)) ELSE 0 END", "5 + 20 * power(-ln(1 - p), 1 / 2e0)")
_law("p18_uniform", D.Uniform(10.0, 40.0), "CASE WHEN x BETWEEN 10 AND 40 THEN 1 / 30e0 ELSE 0 END", "CASE WHEN x < 10 THEN 0 WHEN x > 40 THEN 1 ELSE (x - 10) / 30e0 END", "p * 30 + 10")
_law("p19_user_defined", D.UserDefined(((0.0, 0.0), (20.0, 0.04), (50.0, 0.0))), "CASE WHEN x < 0 OR x > 50 THEN 0 WHEN x <= 20 THEN 0.002e0 * x ELSE 0.04e0 - (x - 20) * 0.04e0 / 30 END", "CASE WHEN x <= 20 THEN 0.001e0 * x * x WHEN x <= 50 THEN 1 - 0.04e0 / 60 * power(50 - x, 2) ELSE 1 END", "CASE WHEN p <= 0.4 THEN sqrt(p / 0.001e0) ELSE 50 - sqrt((1 - p) * 60 / 0.04e0) END")
_law("p20_weibull", D.Weibull(25.0, 1.5), "1.5e0 / 25 * power(x / 25, 0.5e0) * exp(-power(x / 25, 1.5e0))", "1 - exp(-power(x / 25, 1.5e0))", "25 * power(-ln(1 - p), 1 / 1.5e0)")
_law("p10_from_python", D.FromPython(lambda x: 0.0 * x + 0.02, lambda x: x / 51, lambda p: 51 * p), "0.02e0", "x / 51e0", "51 * p")


# reliability


def _uniform_sql(*keys: str) -> str:
    return "(CAST('0x' || substr(md5('1:' || " + " || ':' || ".join(keys) + "), 1, 13) AS BIGINT) / 4503599627370496e0)"


def _edge_sql(*keys: str) -> str:
    return f"least(greatest({_uniform_sql(*keys)}, 1e-7), 0.9999999e0)"


@query(f"SELECT event_id, round(u, 9) AS u, round({normal.inverse_sql('least(greatest(u, 1e-7), 0.9999999e0)')}, 6) + 0.0 AS z FROM (SELECT event_id, {_uniform_sql('event_id')} AS u FROM events)")
def p21_random_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").select("event_id", P.uniform("event_id").alias("u"), P.standard_normal("event_id").alias("z"))
    return rounded(rounded(out, "u", digits=9), "z")


@query(f"""SELECT x, round({normal.inverse_sql('(1 - exp(-0.05e0 * x))')}, 5) + 0.0 AS u, round(-ln(1 - {normal.cdf_sql('(x / 51e0)')}) / 0.05e0, 5) AS back FROM {SAMPLES}""")
def p22_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    law = D.Exponential(0.05)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    return rows.select("x", r6(P.to_standard(F.col("x"), law), 5).alias("u"), r6(P.from_standard(F.col("x") / 51.0, law), 5).alias("back"))


@query(f"SELECT x, round({normal.cdf_sql('(x / 51e0)')} * {normal.cdf_sql('0.3e0')}, 6) AS independent, round({normal.cdf_sql('least(x / 51e0, 0.3e0)')}, 6) AS dependent FROM {SAMPLES}")
def p23_bivariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x")).distinct()
    at = lambda rho: P.bivariate_cdf(F.col("x") / 51.0, F.lit(0.3), F.lit(rho))
    return rows.select("x", r6(at(0.0)).alias("independent"), r6(at(1.0)).alias("dependent"))


@query(f"""SELECT n, failures, round(pf, 6) AS pf, round(sqrt((1 - pf) / (pf * n)), 6) AS cov FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN -ln(1 - a) - 5 * b <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures, avg(CASE WHEN -ln(1 - a) - 5 * b <= 0 THEN 1e0 ELSE 0e0 END) AS pf
    FROM (SELECT {normal.cdf_sql('a')} AS a, {normal.cdf_sql('b')} AS b FROM (SELECT {normal.inverse_sql('a')} AS a, {normal.inverse_sql('b')} AS b FROM (SELECT {_edge_sql('range', "'0'")} AS a, {_edge_sql('range', "'1'")} AS b FROM range(200000)))))""")
def p24_monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = P.draw(spark, 200_000, {"x1": D.Exponential(1.0), "x2": D.Uniform(0.0, 5.0)})
    return rounded(P.monte_carlo(samples, P.limit_state("x1 - x2", ["x1", "x2"])), "pf", "cov")


@query("""WITH d AS (SELECT user_id, event_id, CASE WHEN value > 60 THEN value / 490e0 ELSE 0 END AS q FROM events), r AS (SELECT user_id, count(*) OVER o AS k, sum(q) OVER o AS s, sum(q * q) OVER o AS s2 FROM d WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    v AS (SELECT user_id, k, s / k AS pf, CASE WHEN s > 0 THEN sqrt(greatest((s2 / k - (s / k) * (s / k)) / k, 0)) / (s / k) END AS cov FROM r), f AS (SELECT user_id, min(k) AS k FROM v WHERE (k >= 40 OR cov <= 0.3) AND k > 2 GROUP BY 1)
    SELECT user_id, k, round(pf, 6) AS pf, round(cov, 6) AS cov FROM f JOIN v USING (user_id, k)""")
def p25_stopped_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 60, F.col("value") / 490.0).otherwise(0.0).alias("q"))
    return rounded(P.stopped_sampling(draws, 0.3, 40, "event_id", "q", ["user_id"]), "pf", "cov")


@query(f"""SELECT round(avg(CASE WHEN 3 - 0.8e0 * (a + 2) - 0.6e0 * (b + 1.5e0) <= 0 THEN exp(0.5e0 * a * a + 0.5e0 * b * b - 0.5e0 * (a + 2) * (a + 2) - 0.5e0 * (b + 1.5e0) * (b + 1.5e0)) ELSE 0 END), 6) AS pf, count(*) AS n
    FROM (SELECT {normal.inverse_sql('a')} AS a, {normal.inverse_sql('b')} AS b FROM (SELECT {_edge_sql('range', "'0'")} AS a, {_edge_sql('range', "'1'")} AS b FROM range(100000)))""")
def p26_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = P.with_standard_normals(spark.range(100_000), ["a", "b"], "id").withColumns({"a": F.col("a") + 2.0, "b": F.col("b") + 1.5})
    u = [F.col("a"), F.col("b")]
    rows = drawn.select((F.when(F.lit(3.0) - 0.8 * u[0] - 0.6 * u[1] <= 0, P.importance_weight(u, [2.0, 1.5])).otherwise(0.0)).alias("q"))
    return rows.agg(F.round(F.avg("q"), 6).alias("pf"), F.count("*").alias("n"))


GRADS = "(SELECT l_suppkey AS lsf, l_linenumber AS rv, sum(l_quantity) / 1000e0 AS gradient FROM lineitem GROUP BY 1, 2)"
RHO = "(SELECT * FROM (VALUES (1, 2, 0.3e0), (2, 3, -0.2e0), (1, 5, 0.1e0)) c(rv1, rv2, rho))"


def _fosm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    grads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("lsf"), F.col("l_linenumber").alias("rv")).agg((F.sum("l_quantity") / 1000.0).alias("gradient"))
    variables = spark.range(1, 8).select(F.col("id").cast("int").alias("rv"), (0.5 + 0.25 * F.col("id")).alias("stdv"))
    return grads, variables, spark.createDataFrame([(1, 2, 0.3), (2, 3, -0.2), (1, 5, 0.1)], "rv1 int, rv2 int, rho double")


@query("WITH s AS (SELECT lsf, rv, gradient * (0.5e0 + 0.25e0 * rv) AS s FROM " + GRADS + """)
    SELECT lsf, round(sum(x), 5) AS variance, round(sqrt(sum(x)), 5) AS stdv FROM (SELECT lsf, s * s AS x FROM s UNION ALL SELECT a.lsf, 2 * rho * a.s * b.s FROM s a JOIN """ + RHO + " c ON a.rv = rv1 JOIN s b ON b.lsf = a.lsf AND b.rv = rv2) GROUP BY 1")
def p27_fosm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.fosm(*_fosm(spark, sf_dir), ["lsf"]), "variance", "stdv", digits=5)


@query("WITH s AS (SELECT lsf, rv, gradient * (0.5e0 + 0.25e0 * rv) AS s FROM " + GRADS + ") SELECT lsf, rv, round(s / sqrt(sum(s * s) OVER (PARTITION BY lsf)), 6) AS importance FROM s")
def p28_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    grads, variables, _ = _fosm(spark, sf_dir)
    return rounded(P.fosm_importance(grads, variables, ["lsf"]), "importance")


CURVES = "(SELECT l_suppkey AS lsf, 1.5e0 + (l_suppkey % 5) / 4e0 AS beta, (l_linenumber - 3) / 20e0 AS kappa FROM lineitem)"


@query(f"""SELECT lsf, round(min({normal.cdf_sql('(-beta)')}), 8) AS pf1, round(min({normal.cdf_sql('(-beta)')}) * exp(-0.5e0 * sum(ln(1 + {normal.pdf_sql('beta')} / {normal.cdf_sql('(-beta)')} * kappa))), 8) AS pf2 FROM {CURVES} GROUP BY 1""")
def p30_sorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lsf"), (1.5 + (F.col("l_suppkey") % 5) / 4.0).alias("beta"), ((F.col("l_linenumber") - 3) / 20.0).alias("kappa"))
    return rounded(P.sorm_breitung(rows, ["lsf"]), "pf1", "pf2", digits=8)


@query(f"""SELECT part, round(parameter, 6) + 0.0 AS parameter, CASE WHEN ok THEN round(1 - {normal.cdf_sql('parameter')}, 6) ELSE -1 END AS pf, CASE WHEN ok THEN round({normal.pdf_sql('(-parameter)')} / 2e0 * 0.7e0, 6) ELSE -1 END AS pdf
    FROM (SELECT p_partkey AS part, -2 + range * 0.25e0 AS parameter, (p_partkey + range) % 11 <> 0 AS ok FROM part, range(17))""")
def p31_fragility(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = P.sweep(spark, -2.0, 2.0, 16).withColumn("k", F.round((F.col("parameter") + 2) / 0.25).cast("long"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.expr("explode(sequence(0L, 16L))").alias("k")).join(F.broadcast(values), "k")
    rows = rows.withColumns({"beta": F.col("parameter"), "slope": F.lit(0.7), "gradient_norm": F.lit(2.0), "ok": (F.col("part") + F.col("k")) % 11 != 0})
    return rounded(P.fragility(rows).select("part", "parameter", "pf", "pdf"), "parameter", "pf", "pdf")


@query("SELECT a, b, round(g, 6) + 0.0 AS g FROM (SELECT i.range * 0.5e0 AS a, -1 + j.range * 0.25e0 AS b, (i.range * 0.5e0) * (i.range * 0.5e0) - 3 * (-1 + j.range * 0.25e0) AS g FROM range(21) i, range(9) j)")
def p34_function_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.function_grid(spark, P.limit_state("a * a - 3 * b", ["a", "b"]), {"a": (0.0, 10.0, 21), "b": (-1.0, 1.0, 9)}), "g")


@query("SELECT l_orderkey, l_linenumber, l_partkey, rv, round(gradient, 3) + 0.0 AS gradient FROM (SELECT *, unnest(['q', 'd']) AS rv, unnest([2 * l_quantity + 0.001e0, -10.0]) AS gradient FROM lineitem)")
def p36_finite_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"))
    out = P.finite_differences(rows, {"q": 0.001, "d": 0.001}, lambda x: x["q"] * x["q"] - 10 * x["d"], ["l_orderkey", "l_linenumber", "l_partkey"])
    return rounded(out, "gradient", digits=3)


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_quantity * (1 - l_discount) - 40 <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM lineitem GROUP BY 1")
def p39_limit_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.limit_state("q * (1 - d) - 40", ["q", "d"])
    rows = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "q", "l_discount": "d"}).withColumn("fail", (g <= 0).cast("long"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("fail").alias("failures"))


# accumulators

CYCLES = "(SELECT user_id, event_id, value - 245 AS defo, (value - 245) / 3e0 + CASE WHEN event_id % 2 = 0 THEN 5e0 ELSE -5e0 END AS force FROM events)"


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    force = (F.col("value") - 245) / 3.0 + F.when(F.col("event_id") % 2 == 0, 5.0).otherwise(-5.0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - 245).alias("defo"), force.alias("force"), F.lit(2.0).alias("stiffness"))


@query("WITH c AS (SELECT *, 0.5e0 * (force + lag(force, 1, 0.0) OVER o) * (defo - lag(defo, 1, 0.0) OVER o) AS de FROM " + CYCLES + """ WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    d AS (SELECT *, max(abs(defo)) OVER o / 300e0 + 0.1e0 * (sum(de) OVER o - 0.5e0 * force * force / 2) / 50e0 / 300e0 AS x FROM c WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, round(greatest(max(x) OVER (PARTITION BY user_id ORDER BY event_id), 0), 5) AS damage FROM d""")
def c01_park_ang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.park_ang(_cycles(spark, sf_dir), ["user_id"], "event_id", 300.0, 0.1, 50.0, stiffness="stiffness")
    return rounded(out.select("user_id", "event_id", "damage"), "damage", digits=5)


SERIES = "WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM "


@query(SERIES + CYCLES + """),
    r AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, 0e0 AS d, 0e0 AS f, 0e0 AS cycle, 0e0 AS spent, 0e0 AS fresh, 0e0 AS cyclic, 0e0 AS damage FROM events
    UNION ALL SELECT user_id, event_id, i, d, f, cycle, spent, fresh, cyclic, greatest(damage, cyclic + fresh - fresh * cyclic) FROM (
        SELECT *, CASE WHEN (cycle - el) / (1e6 - spent) >= 0 THEN power((cycle - el) / (1e6 - spent), 1.2e0) ELSE 0e0 END AS fresh FROM (
            SELECT *, CASE WHEN least(cycle, spent) < f * f / 4 THEN 0e0 ELSE f * f / 4 END AS el FROM (
                SELECT user_id, event_id, i, d, f, damage, CASE WHEN f = 0 THEN 0e0 WHEN x THEN 0.5e0 * f * (d - zero) ELSE cycle0 + 0.5e0 * (f + f0) * (d - d0) END AS cycle,
                    CASE WHEN f = 0 THEN spent0 WHEN x THEN spent0 + 0.5e0 * f * (d - zero) ELSE spent0 + 0.5e0 * (f + f0) * (d - d0) END AS spent,
                    CASE WHEN f = 0 THEN cyclic0 + fresh0 - fresh0 * cyclic0 WHEN x THEN cyclic0 + ended - ended * cyclic0 ELSE cyclic0 END AS cyclic FROM (
                    SELECT *, CASE WHEN x AND (cycle0 + head) / (1e6 - spent0 - head) >= 0 THEN power((cycle0 + head) / (1e6 - spent0 - head), 1.2e0) ELSE 0e0 END AS ended FROM (
                        SELECT *, 0.5e0 * f0 * (zero - d0) AS head FROM (
                            SELECT *, f0 * f < 0 AS x, CASE WHEN abs(f0 + f) < 1e-6 THEN (d + d0) / 2 ELSE (f0 * d + f * d0) / (f0 + f) END AS zero FROM (
                                SELECT s.user_id, s.event_id, s.i, s.defo AS d, s.force AS f, r.d AS d0, r.f AS f0, r.cycle AS cycle0, r.spent AS spent0, r.fresh AS fresh0, r.cyclic AS cyclic0, r.damage
                                FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1))))))))
    SELECT user_id, event_id, round(damage, 5) AS damage FROM r WHERE i > 0""")
def c02_hysteretic_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.hysteretic_energy(_cycles(spark, sf_dir), ["user_id"], "event_id", 1e6, 1.2)
    return rounded(out.select("user_id", "event_id", "damage"), "damage", digits=5)


@query("SELECT user_id, event_id, round(max(CASE WHEN defo >= 0 THEN defo / 200e0 ELSE abs(defo / -300e0) END) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS damage FROM " + CYCLES)
def c03_normalized_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.normalized_peak(_cycles(spark, sf_dir), ["user_id"], "event_id", 200.0, -300.0)
    return rounded(out.select("user_id", "event_id", "damage"), "damage")


@query(SERIES + CYCLES + """),
    r AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, 0e0 AS d, 0e0 AS f, 0e0 AS most, 0e0 AS least, 0e0 AS fp, 0e0 AS pp, 0e0 AS fn, 0e0 AS pn, 0e0 AS damage FROM events
    UNION ALL SELECT user_id, event_id, i, d, f, greatest(most, d), least(least, d), fp, pp, fn, pn, greatest(damage, (pp + fp) / (1e5 + fp) + (pn + fn) / (1e5 + fn) - (pp + fp) / (1e5 + fp) * ((pn + fn) / (1e5 + fn))) FROM (
        SELECT user_id, event_id, i, d, f, most, least, damage,
            fp + CASE WHEN d > 0 THEN own WHEN d < 0 AND d0 > 0 THEN 0.5e0 * (zero + f0) * (0 - d0) WHEN d = 0 AND d0 > 0 THEN 0.5e0 * (f + f0) * (d - d0) ELSE 0 END AS fp, pp + CASE WHEN d > 0 THEN main ELSE 0 END AS pp,
            fn + CASE WHEN d < 0 THEN own WHEN d > 0 AND d0 < 0 THEN 0.5e0 * (zero + f0) * (0 - d0) WHEN d = 0 AND d0 < 0 THEN 0.5e0 * (f + f0) * (d - d0) ELSE 0 END AS fn, pn + CASE WHEN d < 0 THEN main ELSE 0 END AS pn FROM (
            SELECT *, CASE WHEN d * d0 < 0 AND NOT beyond THEN 0.5e0 * (f + zero) * d WHEN d * d0 < 0 THEN 0.5e0 * (f + f0) * (d - d0) WHEN NOT beyond THEN 0.5e0 * (f + d0) * (d - d0)
                    ELSE 0.5e0 * (f0 + (f - f0) * (edge - d0) / (d - d0) + f0) * (edge - d0) END AS own,
                CASE WHEN beyond AND d * d0 >= 0 THEN 0.5e0 * (f + f0 + (f - f0) * (edge - d0) / (d - d0)) * (d - edge) ELSE 0 END AS main FROM (
                SELECT *, abs(d) > abs(edge) AS beyond, CASE WHEN abs(d - d0) > 1e-6 THEN f0 - (f - f0) * d0 / (d - d0) ELSE 0.5e0 * (f + f0) END AS zero FROM (
                    SELECT s.user_id, s.event_id, s.i, s.defo AS d, s.force AS f, r.d AS d0, r.f AS f0, r.most, r.least, r.fp, r.pp, r.fn, r.pn, r.damage, CASE WHEN s.defo > 0 THEN r.most ELSE r.least END AS edge
                    FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)))))
    SELECT user_id, event_id, round(damage, 5) AS damage FROM r WHERE i > 0""")
def c04_kratzig(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.kratzig(_cycles(spark, sf_dir), ["user_id"], "event_id", 1e5, 1e5)
    return rounded(out.select("user_id", "event_id", "damage"), "damage", digits=5)


@query(SERIES + """(SELECT user_id, event_id, value - 245 AS p FROM events)), q AS (SELECT 1e0 / 0.02e0 * 2 * (2e0 / 0.02e0 + 1e0) AS k1, 100e0 AS k, 0.02e0 / 0.98e0 * 100 AS h),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS i, 0e0 AS u, 0e0 AS v, 0e0 AS a, 0e0 AS up, 0e0 AS u_max, 0e0 AS a_max, 0e0 AS t_a_max FROM events
    UNION ALL SELECT user_id, i, u, v, a, CASE WHEN sgn = 0 THEN up ELSE (k * u - sgn * 50) / (k + h) END, greatest(u_max, abs(u)), greatest(a_max, abs(a)), CASE WHEN abs(a) > a_max THEN i * 0.02e0 ELSE t_a_max END FROM (
        SELECT user_id, i, k, h, sgn, u, 100 * (u - u0) - v0 AS v, 10000 * (u - u0) - 200 * v0 - a0 AS a, up, u_max, a_max, t_a_max FROM (
            SELECT *, CASE WHEN sgn = 0 THEN trial ELSE (target - sgn * 50 * k / (k + h)) / (k1 + k * h / (k + h)) END AS u FROM (
                SELECT *, CASE WHEN abs(k * (trial - up) - h * up) > 50 THEN sign(k * (trial - up) - h * up) ELSE 0 END AS sgn FROM (
                    SELECT *, (target + k * up) / (k1 + k) AS trial FROM (
                        SELECT s.user_id, s.i, r.u AS u0, r.v AS v0, r.a AS a0, r.up, r.u_max, r.a_max, r.t_a_max, q.*, s.p + k1 * r.u + (200 + 1e0) * r.v + r.a AS target
                        FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1, q))))))
    SELECT user_id, round(u_max, 6) AS u_max, round(u, 6) + 0.0 AS u_end, round(up, 6) + 0.0 AS u_plastic, round(a_max, 5) AS a_max, round(t_a_max, 6) AS t_a_max FROM r QUALIFY i = max(i) OVER (PARTITION BY user_id)""")
def c08_oscillator(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") - 245).alias("force"))
    out = A.oscillator_responses(rows, ["user_id"], "event_id", "force", 0.02, 1.0, 0.05, 100.0, 50.0, 0.02)
    return rounded(rounded(out, "u_max", "u_end", "u_plastic", "t_a_max"), "a_max", digits=5)


ITER = "(SELECT user_id, value, lag(value) OVER o AS before, row_number() OVER o AS i, first_value(value) OVER o AS first, sum(value) OVER o AS total, 500 - value AS other, 500 - lag(value) OVER o AS other_before FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id))"


def _code(ok: str, bad: str, most: int) -> str:
    return f"""WITH f AS (SELECT user_id, min(CASE WHEN ({ok}) AND i <= {most} THEN i END) AS c, min(CASE WHEN ({bad}) AND i <= {most} THEN i END) AS f, max(i) AS n FROM x GROUP BY 1)
        SELECT user_id, CAST(CASE WHEN c IS NOT NULL AND (f IS NULL OR c <= f) THEN c WHEN f IS NOT NULL OR n >= {most} THEN -2 ELSE -1 END AS INTEGER) AS code FROM f"""


def _iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", (500 - F.col("value")).alias("other"))


def _test(name: str, sql: str, run: Callable[[DataFrame], DataFrame]) -> None:
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(_iterations(spark, sf_dir))

    made.__name__ = name
    query(sql)(made)


_counted = "(SELECT *, sum(CASE WHEN {} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS inc FROM " + ITER + ")"
_plain = ITER
_keys = (["user_id"], "event_id")
_test("v01_norm_disp_incr", _code("value <= 5", "false", 40).replace("FROM x", "FROM " + _plain), lambda d: A.converge_norm(d, *_keys, "value", 5.0, 40))
_test("v02_norm_unbalance", _code("value <= 5", "inc > 6", 40).replace("FROM x", "FROM " + _counted.format("value > before")), lambda d: A.converge_norm(d, *_keys, "value", 5.0, 40, 6))
_test("v03_energy_incr", _code("0.5e0 * abs(value) <= 3", "false", 40).replace("FROM x", "FROM " + _plain), lambda d: A.converge_energy(d, *_keys, "value", 3.0, 40))
_test("v04_relative_disp", _code("value / first <= 0.05", "false", 40).replace("FROM x", "FROM " + _plain), lambda d: A.converge_relative(d, *_keys, "value", 0.05, 40))
_test("v05_relative_unbalance", _code("value / 400e0 <= 0.02", "false", 40).replace("FROM x", "FROM " + _plain), lambda d: A.converge_relative(d.withColumn("start", F.lit(400.0)), *_keys, "value", 0.02, 40, "start"))
_test("v06_relative_energy", _code("abs(other / (500 - first)) <= 0.1", "false", 40).replace("FROM x", "FROM " + _plain), lambda d: A.converge_relative(d, *_keys, "other", 0.1, 40))
_test("v07_relative_total", _code("value / total <= 0.001", "false", 50).replace("FROM x", "FROM " + _plain), lambda d: A.converge_relative_total(d, *_keys, "value", 0.001, 50))
_test("v08_fixed_iterations", _code("i = 60", "false", 60).replace("FROM x", "FROM " + _plain), lambda d: A.converge_fixed(d, *_keys, 60))
_test("v09_disp_and_unbalance", _code("value <= 200 AND other <= 320", "inc > 8", 40).replace("FROM x", "FROM " + _counted.format("value > before OR other > other_before")), lambda d: A.converge_both(d, *_keys, "value", "other", 200.0, 320.0, 40, 8))
_test("v10_disp_or_unbalance", _code("value <= 3 OR other <= 15", "inc > 0", 40).replace("FROM x", "FROM " + _counted.format("value > before AND other > other_before")), lambda d: A.converge_either(d, *_keys, "value", "other", 3.0, 15.0, 40, 0))


@query(SERIES + """(SELECT user_id, event_id, CAST(CASE WHEN value > 480 THEN -1 ELSE CAST(floor(value % 9 + 2) AS INTEGER) END AS INTEGER) AS iterations FROM events)),
    r AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, NULL::INTEGER AS iterations, NULL::DOUBLE AS dt, 0.01e0 AS step, false AS ended FROM events
    UNION ALL SELECT s.user_id, s.event_id, s.i, s.iterations, CASE WHEN r.ended THEN NULL ELSE r.step END,
        CASE WHEN least(r.step * 5 / greatest(1, abs(s.iterations)), 0.05e0) < 1e-4 THEN 1e-4 - 2.220446049250313e-16 ELSE least(r.step * 5 / greatest(1, abs(s.iterations)), 0.05e0) END,
        r.ended OR (s.iterations < 0 AND r.step < 1e-4) FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)
    SELECT user_id, event_id, iterations, dt FROM r WHERE i > 0""")
def v13_adaptive_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 480, -1).otherwise((F.col("value") % 9 + 2).cast("int")).alias("iterations"))
    return A.adaptive_steps(rows, ["user_id"], "event_id", 0.01, 1e-4, 0.05, 5)


# entities and topology


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_tag"), F.col("l_partkey").alias("node_tag")).distinct()


LINKS = "(SELECT DISTINCT l_orderkey AS element_tag, l_partkey AS node_tag FROM lineitem)"


def _model(spark: SparkSession, sf_dir: str) -> entities.Model:
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("tag"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("crds"), F.lit(2).alias("ndf"), F.lit(True).alias("active"))
    return entities.Model(spark, {"nodes": nodes})


@query("SELECT p_partkey AS tag FROM part UNION SELECT s_suppkey + 1000000 FROM supplier")
def d01_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).cast("int").alias("tag")).unionByName(table(spark, sf_dir, "part").where("p_partkey < 50").select(F.col("p_partkey").cast("int").alias("tag")))
    return _model(spark, sf_dir).add("nodes", more).table("nodes").select(F.col("tag").cast("long").alias("tag"))


@query("SELECT p_partkey AS tag FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def d02_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("int").alias("tag")).distinct()
    return _model(spark, sf_dir).remove("nodes", gone).table("nodes").select(F.col("tag").cast("long").alias("tag"))


@query("SELECT p_partkey AS tag, p_size::DOUBLE AS x, p_retailprice AS y FROM part")
def d03_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).table("nodes").select(F.col("tag").cast("long").alias("tag"), F.col("crds")[0].alias("x"), F.col("crds")[1].alias("y"))


@query("SELECT 0 AS axis, min(p_size)::DOUBLE AS low, max(p_size)::DOUBLE AS high FROM part UNION ALL SELECT 1, min(p_retailprice), max(p_retailprice) FROM part")
def d04_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).bounds()


@query("SELECT l_orderkey AS element_tag, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS INTEGER) AS position, l_partkey AS node_tag FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def d05_element_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _links(spark, sf_dir).groupBy(F.col("element_tag").alias("tag")).agg(F.sort_array(F.collect_list("node_tag")).alias("node_tags"))
    return entities.element_nodes(rows)


@query("SELECT c_nationkey AS class_tag, c_mktsegment AS class_type, count(*) AS count FROM customer GROUP BY 1, 2")
def d06_element_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.element_classes(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("class_tag"), F.col("c_mktsegment").alias("class_type")))


@query("SELECT event_id, value FROM events WHERE user_id = 42 AND event_type = 'click'")
def d07_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "response")
    return entities.responses_of(rows, 42, "click", "user_id").select("event_id", "value")


@query("WITH k AS " + LINKS + " SELECT 'element' AS kind, element_tag AS member FROM k WHERE element_tag IN (1, 2, 3, 5, 8) GROUP BY 2 UNION ALL SELECT DISTINCT 'node', node_tag FROM k WHERE element_tag IN (1, 2, 3, 5, 8)")
def d10_region_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.region(_links(spark, sf_dir), elements=[1, 2, 3, 5, 8], nodes=[1])


@query("SELECT DISTINCT 'node' AS kind, node_tag AS member FROM " + LINKS + " WHERE node_tag BETWEEN 20 AND 90")
def d11_region_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.region(_links(spark, sf_dir), node_range=(90, 20), only=True)


@query("SELECT p_partkey AS node_tag, d AS dof FROM part, (VALUES (1), (3)) x(d) WHERE abs(p_size - 7) <= 1e-10")
def d12_fix_by_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).fix([1, 0, 1], axis=0, at=7.0).table("sp").select(F.col("node_tag").cast("long").alias("node_tag"), "dof")


@query("WITH k AS " + LINKS + " SELECT element_tag FROM k GROUP BY 1 HAVING bool_and(node_tag % 3 <> 0)")
def d14_region_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    return entities.region_elements(links, links.where("node_tag % 3 <> 0").select("node_tag"))


@query("SELECT DISTINCT l_suppkey AS node, l_linenumber AS dof FROM lineitem WHERE l_suppkey = 7")
def d15_constrained_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_linenumber").alias("dof"))
    return entities.constrained(rows, "node", "dof", 7)


@query("SELECT o_custkey AS node_tag, o_orderkey AS load_tag, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'")
def d16_load_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("node_tag"), F.col("o_orderkey").alias("load_tag"), F.col("o_totalprice").alias("value"))


@query("SELECT p_partkey AS tag, CASE WHEN p_partkey BETWEEN 30 AND 60 THEN 5.5 ELSE p_retailprice END AS value FROM part")
def d18_set_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag"), F.lit("element").alias("entity_kind"), F.col("p_partkey").alias("entity_tag"), F.col("p_retailprice").alias("value"))
    return entities.Model(spark, {"parameters": params}).set_parameter(5.5, low=60, high=30).table("parameters").select("tag", "value")


@query("SELECT CAST(1 + j.range * 21 + i.range AS INTEGER) AS tag, round(i.range * 0.5e0 + j.range * 0.1e0, 6) AS x, round(j.range * 0.4e0, 6) AS y FROM range(21) i, range(11) j")
def d19_block2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = entities.block2d(spark, 20, 10, [(0.0, 0.0), (10.0, 0.0), (11.0, 4.0), (1.0, 4.0)])
    return nodes.select("tag", r6(F.col("crds")[0]).alias("x"), r6(F.col("crds")[1]).alias("y"))


@query("SELECT user_id + 1 AS constrained, event_id, round(0.5e0 * sum(value), 6) AS value FROM events GROUP BY 1, 2")
def d22_tied_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("node_tag"), F.lit(1).alias("dof"), "value")
    users = values.select(F.col("node_tag").alias("id")).distinct()
    mp = users.select(F.col("id").alias("tag"), F.col("id").alias("retained"), (F.col("id") + 1).alias("constrained"), F.lit(1).alias("retained_dof"), F.lit(1).alias("constrained_dof"), F.lit(0.5).alias("coefficient"))
    return rounded(entities.tied_values(mp, values, ["event_id"]).select("constrained", "event_id", "value"), "value")


# graphs


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.sharing_graph(_links(spark, sf_dir), "node_tag", "element_tag")


EDGES = "(SELECT DISTINCT a.node_tag AS a, b.node_tag AS b FROM k a JOIN k b ON a.element_tag = b.element_tag AND a.node_tag < b.node_tag)"


@query("WITH k AS " + LINKS + " SELECT v AS vertex, count(*) AS degree FROM (SELECT a AS v FROM " + EDGES + " UNION ALL SELECT b FROM " + EDGES + ") GROUP BY 1")
def g02_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.vertices(_edges(spark, sf_dir))


@query("WITH k AS " + LINKS + " SELECT a, b FROM " + EDGES + " UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey < 100")
def g03_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "part").where("p_partkey < 100").select((F.col("p_partkey") + 1).alias("a"), F.col("p_partkey").alias("b"))
    return graphs.merge(_edges(spark, sf_dir), more)


@query("WITH k AS (SELECT DISTINCT l_orderkey AS element_tag, l_partkey * 2 - 400 AS node_tag FROM lineitem WHERE l_partkey * 2 - 400 >= 0) SELECT a, b FROM " + EDGES)
def g04_dof_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _links(spark, sf_dir).select("element_tag", (F.col("node_tag") * 2 - 400).alias("equation"))
    return graphs.sharing_graph(rows, "equation", "element_tag", least=0)


@query("SELECT DISTINCT a.element_tag AS a, b.element_tag AS b FROM " + LINKS + " a JOIN " + LINKS + " b ON a.node_tag = b.node_tag AND a.element_tag < b.element_tag")
def g06_element_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.sharing_graph(_links(spark, sf_dir), "element_tag", "node_tag")


@query("SELECT p_partkey AS vertex, row_number() OVER (ORDER BY p_partkey) - 1 AS number FROM part")
def g08_simple_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.simple_numbering(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertex")))


CHAIN = "(SELECT p_partkey AS a, p_partkey + 1 AS b FROM part UNION ALL SELECT p_partkey, p_partkey * 7 % (SELECT count(*) FROM part) FROM part)"


@query("WITH RECURSIVE e AS (SELECT a, b FROM " + CHAIN + " UNION SELECT b, a FROM " + CHAIN + """), f AS (SELECT 1::BIGINT AS vertex, 0 AS level UNION SELECT e.b, f.level + 1 FROM f JOIN e ON e.a = f.vertex WHERE f.level < 40)
    SELECT vertex, CAST(min(level) AS INTEGER) AS level FROM f GROUP BY 1""")
def g08_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    one = part.withColumn("b", F.col("a") + 1)
    far = part.select("a", (F.col("a") * 7 % F.lit(part.count())).alias("b"))
    return graphs.levels(one.unionByName(far), 1)


@query("WITH k AS " + LINKS + " SELECT a, b, CAST(a % 4 AS INTEGER) AS part_a, CAST(b % 4 AS INTEGER) AS part_b FROM " + EDGES + " WHERE a % 4 <> b % 4")
def g09_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    labels = graphs.vertices(edges).select("vertex", (F.col("vertex") % 4).cast("int").alias("part"))
    return graphs.boundary(edges, labels).select("a", "b", "part_a", "part_b")


@query("""WITH k AS """ + LINKS + """, e AS """ + EDGES + """, v AS (SELECT v AS vertex, CAST(least(v % 5, 3) AS INTEGER) AS part, 1.0::DOUBLE AS weight FROM (SELECT a AS v FROM e UNION SELECT b FROM e)),
    l AS (SELECT part, sum(weight) AS load FROM v GROUP BY 1), w AS (SELECT part AS worst, load AS top, (SELECT avg(load) FROM l) AS mean FROM l ORDER BY load DESC, part LIMIT 1),
    n AS (SELECT x.a AS vertex, first(o.part ORDER BY l.load, o.part) AS dest, min(l.load) AS light FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x JOIN v o ON o.vertex = x.b JOIN l ON l.part = o.part GROUP BY 1)
    SELECT vertex, CASE WHEN part = worst AND top > mean AND light < top THEN dest ELSE part END AS part, weight FROM v LEFT JOIN n USING (vertex), w""")
def g10_shed_heaviest(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    labels = graphs.vertices(edges).select("vertex", F.least(F.col("vertex") % 5, F.lit(3)).cast("int").alias("part"), F.lit(1.0).alias("weight"))
    return graphs.shed_heaviest(labels, edges)


# sources


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS commit_tag FROM events")
def s09_commit_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.snapshots import with_commit_tags

    return with_commit_tags(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey, printf('%.3f', l_quantity) AS text FROM lineitem")
def s10_formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import formatted

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", formatted(F.col("l_quantity"), 3).alias("text"))


@query("SELECT conv_id AS file, turn AS line, text FROM conversations WHERE turn > 0 AND turn < (SELECT max(turn) FROM conversations c WHERE c.conv_id = conversations.conv_id)")
def s21_strip_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import strip_data

    c = table(spark, sf_dir, "conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    lines = c.withColumn("__last", last).select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.when(F.col("turn") == 0, "<Data>").when(F.col("turn") == F.col("__last"), "</Data>").otherwise(F.col("text")).alias("text"))
    return strip_data(lines)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 250000 AND o_custkey >= 10")
def s24_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import search_catalogue

    return search_catalogue(table(spark, sf_dir, "orders"), o_totalprice=(1000.0, 250000.0), o_custkey=(10, None)).select("o_orderkey", "o_totalprice")


@query("SELECT user_id AS file, CAST(i AS INTEGER) AS i, 0.02::DOUBLE AS dt, round(i * 0.02e0, 6) AS t, round(value, 4) AS v FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)")
def s25_read_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import read_record

    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) + 1
    body = e.select(F.col("user_id").alias("file"), n.alias("line"), F.format_string("  %.4f ", F.col("value")).alias("text"))
    users = e.select("user_id").distinct()
    head = users.select(F.col("user_id").alias("file"), F.explode(F.array(F.struct(F.lit(0).alias("line"), F.lit("record of a station").alias("text")), F.struct(F.lit(1).alias("line"), F.lit("NPTS=  100, DT= 0.02 SEC").alias("text")))).alias("x")).select("file", "x.*")
    return rounded(read_record(head.unionByName(body)), "t", "v", digits=4)


@query("SELECT l_shipmode AS solver, num_equations, time_seconds FROM (SELECT l_returnflag AS l_shipmode, l_partkey AS num_equations, l_quantity AS time_seconds, CASE WHEN l_linenumber = 7 THEN -999 ELSE 0 END AS status FROM lineitem) WHERE status <> -999 AND num_equations > 0 AND time_seconds IS NOT NULL")
def s30_solver_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.text import solver_timings

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("solver"), F.col("l_partkey").alias("num_equations"), F.col("l_quantity").alias("time_seconds"), F.when(F.col("l_linenumber") == 7, -999).otherwise(0).alias("status"))
    return solver_timings(rows).drop("status")


# extension points


@query("SELECT user_id, event_id, round(200e0 * ((value - 245) / 1000), 6) + 0.0 AS stress FROM events")
def u10_drive_model_elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.registry import drive_model

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("value") - 245) / 1000).alias("strain"))
    out = drive_model(rows, ["user_id"], "event_id", "strain", "Elastic", modulus=200.0)
    return rounded(out.select("user_id", "event_id", "stress"), "stress")

