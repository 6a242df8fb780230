"""Queries of entities, graphs, reliability and dispatch by name, beyond those in ``queries``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal, series
from ..operators import accumulators as A
from ..operators import entities, graphs
from ..operators import reliability as P
from ..operators import series as S
from .queries import CYCLES, EDGES, ITER, LINKS, SERIES, _code, _cycles, _edges, _iterations, _links, _model, events, query, r6, rounded, steps, table

# entities


@query("SELECT p_partkey AS tag, 0 AS position, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 1, p_retailprice FROM part")
def d08_node_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, sf_dir).node_values("coord").withColumn("tag", F.col("tag").cast("long"))


@query("SELECT user_id AS tag, event_id AS position, value FROM events WHERE event_type = 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def d08_node_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_tag"), F.col("event_id").alias("dof"), F.col("event_type").alias("response"), "value")
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("tag"))
    return _model(spark, sf_dir).node_values("view", facts, wanted)


@query("SELECT l_orderkey AS element_tag, l_linenumber AS section, l_returnflag AS response, l_partkey AS position, l_quantity AS value FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 2")
def d09_section_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_tag"), F.col("l_linenumber").alias("section"), F.col("l_returnflag").alias("response"), F.col("l_partkey").alias("position"), F.col("l_quantity").alias("value"))
    return entities.section_values(facts, None, 2, "R")


@query("WITH k AS " + LINKS + " SELECT DISTINCT node_tag FROM k WHERE element_tag IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def d13_region_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("element_tag"))
    return entities.region_nodes(_links(spark, sf_dir), chosen)


@query("SELECT * FROM (VALUES (1, 'element', 10, 2.5::DOUBLE), (1, 'element', 11, 2.5), (1, 'element', 12, 2.5), (2, 'node', 4, 7.0), (3, 'pattern', 1, 0.5)) p(tag, entity_kind, entity_tag, value)")
def d17_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = entities.Model(spark).create_parameter(1, "element", [10, 11], 1.0).create_parameter(2, "node", [4], 7.0).create_parameter(3, "pattern", [1], 0.5)
    model = model.add_to_parameter(1, "element", [12]).update_parameter(1, 2.5)
    return model.table("parameters").join(model.parameter_tags(), "tag").select("tag", "entity_kind", "entity_tag", "value")


@query("SELECT 12.5::DOUBLE AS time, true AS constant_loads, 0.0::DOUBLE AS reset")
def d20_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir).at(12.5).with_constant_loads()
    return spark.createDataFrame([(model.time, model.constant_loads, model.with_constant_loads(0.0).time)], "time double, constant_loads boolean, reset double")


@query("SELECT o_orderkey AS tag, o_orderkey NOT IN (1, 2, 3, 7) AS active FROM orders")
def d21_active_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tag"), F.lit(True).alias("active"))
    return entities.Model(spark, {"elements": elements}).activate([1, 2, 3, 7], False).table("elements").select("tag", "active")


# series and patterns


@query("SELECT event_id, round(CASE WHEN t >= 2 AND t <= 90 THEN 3e0 * sin(2 * pi() * (t - 2) / 7e0 + 0.4e0) ELSE 0 END, 6) + 0.0 AS factor FROM (SELECT event_id, event_id / 100e0 AS t FROM events)")
def t27_series_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = series.factor("Trig", F.col("t"), start=2.0, finish=90.0, period=7.0, phase=0.4, factor=3.0)
    return steps(spark, sf_dir).select("event_id", r6(factor).alias("factor"))


@query("""WITH p AS (SELECT user_id, row_number() OVER o AS i, value AS a, lead(value) OVER o AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    z AS (SELECT user_id, i, a, b FROM p UNION ALL SELECT user_id, 0, 0, a FROM p WHERE i = 1), m AS (SELECT user_id, max(i) AS n, arg_max(a, i) AS last FROM z GROUP BY 1), q AS (SELECT user_id, event_id, (event_id % 997) / 4e0 AS t FROM events)
    SELECT q.user_id, q.event_id, round(CASE WHEN t < 5 THEN 0 WHEN floor((t - 5) / 1.5e0) >= n THEN 2 * last ELSE 2 * (a + ((t - 5) / 1.5e0 - i) * (b - a)) END, 6) + 0.0 AS factor
    FROM q JOIN m USING (user_id) LEFT JOIN z ON z.user_id = q.user_id AND z.i = floor((t - 5) / 1.5e0)""")
def t11_path_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path of equal steps that starts late, after a zero, and holds its last value."""
    path = S.numbered(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value")
    times = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") % 997) / 4.0).alias("t"))
    out = S.interpolate(times, path, ["user_id"], 1.5, factor=2.0, start=5.0, use_last=True, prepend_zero=True)
    return rounded(out.select("user_id", "event_id", "factor"), "factor")


@query("""WITH p AS (SELECT user_id, row_number() OVER o - 1 AS i, value AS a, lead(value) OVER o AS b FROM events WINDOW o AS (PARTITION BY user_id ORDER BY event_id)), n AS (SELECT user_id, CAST(floor(max(i) * 0.02e0 / 0.05e0 + 1e-9) AS BIGINT) AS n FROM p GROUP BY 1),
    g AS (SELECT user_id, unnest(range(n + 1)) AS k FROM n), v AS (SELECT g.user_id, g.k, CASE WHEN b IS NULL THEN a ELSE a + (k * 2.5e0 - i) * (b - a) END AS v FROM g JOIN p ON p.user_id = g.user_id AND p.i = floor(k * 2.5e0))
    SELECT user_id, k AS i, round(v, 7) AS v, round(sum(0.025e0 * (v + coalesce(w, 0))) OVER (PARTITION BY user_id ORDER BY k), 7) AS integral FROM (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY k) AS w FROM v)""")
def t13_resampled_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.resampled(table(spark, sf_dir, "events"), ["user_id"], "event_id", "value", 0.02, 0.05)
    out = S.integrate_trapezoid(rows, ["user_id"], "i", "v", 0.05)
    return rounded(out.select("user_id", "i", "v", "integral"), "v", "integral", digits=7)


@query("SELECT c_custkey AS node, day, round(-c_acctbal * a, 4) + 0.0 AS load FROM (SELECT CAST(floor(epoch_us(ts) / 864e8) AS BIGINT) - 19723 AS day, sum(value) AS a FROM events GROUP BY 1), customer WHERE c_nationkey < 13 AND c_acctbal <> 0")
def t20_uniform_excitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground motion in one direction on all dofs with mass in it."""
    motion = events(spark, sf_dir).groupBy((F.floor(F.col("t") / 86400) - 19723).cast("long").alias("day")).agg(F.sum("value").alias("value")).withColumn("direction", F.lit(1))
    masses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_nationkey") < 13, 1).otherwise(2).alias("direction"), F.col("c_acctbal").alias("mass"))
    return rounded(S.uniform_excitation(masses, motion, ["direction"], "day").select("node", "day", "load"), "load", digits=4)


@query("SELECT s_suppkey AS node, s_nationkey AS dof, day, round(a, 4) AS imposed FROM (SELECT user_id % 10 AS motion, CAST(floor(epoch_us(ts) / 864e8) AS BIGINT) - 19723 AS day, sum(value) AS a FROM events GROUP BY 1, 2) JOIN supplier ON s_suppkey % 10 = motion")
def t20_multi_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    motions = events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("motion"), (F.floor(F.col("t") / 86400) - 19723).cast("long").alias("day")).agg(F.sum("value").alias("value"))
    supports = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("dof"), (F.col("s_suppkey") % 10).alias("motion"))
    return rounded(S.multi_support(supports, motions, "day"), "imposed", digits=4)


@query("""WITH a AS (SELECT user_id, event_id, value, sum(x) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM (SELECT *, 0.5e0 * 0.01e0 * (value + lag(value, 1, 0.0) OVER (PARTITION BY user_id ORDER BY event_id)) AS x FROM events)),
    s AS (SELECT *, CASE WHEN row_number() OVER o % 2 = 0 THEN 1e0 ELSE -1e0 END AS sg, 2 / 0.01e0 * (value - lag(value, 1, 0.0) OVER o) AS st FROM a WINDOW o AS (PARTITION BY user_id ORDER BY event_id)),
    m AS (SELECT user_id, value, d, sg * sum(sg * st) OVER (PARTITION BY user_id ORDER BY event_id) AS acc FROM s)
    SELECT user_id, round(max(abs(acc)), 3) AS peak_acceleration, round(max(abs(value)), 6) AS peak_velocity, round(max(abs(d)), 6) AS peak_displacement FROM m GROUP BY 1""")
def t18_motion_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of motions given as velocities."""
    out = S.motion_peaks(S.ground_motion(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 0.01, "velocity"), ["user_id"])
    return rounded(rounded(out, "peak_velocity", "peak_displacement"), "peak_acceleration", digits=3)


# graphs


@query("WITH k AS " + LINKS + ", e AS " + EDGES + " SELECT a, b FROM (SELECT a, b FROM e UNION SELECT s_suppkey, s_suppkey + 1 FROM supplier) WHERE a <> 5 AND b <> 5")
def g01_changed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1).alias("a"), F.col("s_suppkey").alias("b"))
    return graphs.remove_vertex(graphs.add_edges(_edges(spark, sf_dir), more), 5)


@query("WITH k AS (SELECT DISTINCT l_orderkey AS element_tag, l_suppkey AS node_tag FROM lineitem) SELECT a, b FROM " + EDGES)
def g05_group_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_tag"), F.col("l_suppkey").alias("dof_group")).distinct()
    return graphs.sharing_graph(rows, "dof_group", "element_tag")


@query("WITH k AS " + LINKS + ", e AS " + EDGES + " SELECT v AS vertex, count(*) AS degree, coalesce(any_value(p_retailprice), 0) AS weight FROM (SELECT a AS v FROM e UNION ALL SELECT b FROM e) LEFT JOIN part ON p_partkey = v AND p_size > 25 GROUP BY 1")
def g07_weighted_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("vertex"), F.col("p_retailprice").alias("weight"))
    return graphs.vertices(_edges(spark, sf_dir), weights)


@query("""WITH k AS """ + LINKS + """, e AS """ + EDGES + """, v AS (SELECT v AS vertex, CAST(least(v % 5, 3) AS INTEGER) AS part, 1.0::DOUBLE AS weight FROM (SELECT a AS v FROM e UNION SELECT b FROM e)),
    l AS (SELECT part, sum(weight) AS load FROM v GROUP BY 1), n AS (SELECT x.a AS vertex, first(o.part ORDER BY l.load, o.part) AS dest, min(l.load) AS light FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x JOIN v o ON o.vertex = x.b JOIN l ON l.part = o.part GROUP BY 1)
    SELECT vertex, CASE WHEN load > 1.5e0 * light THEN dest ELSE part END AS part, weight FROM v JOIN l USING (part) LEFT JOIN n USING (vertex)""")
def g10_release_heavier(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    labels = graphs.vertices(edges).select("vertex", F.least(F.col("vertex") % 5, F.lit(3)).cast("int").alias("part"), F.lit(1.0).alias("weight"))
    return graphs.release_heavier(labels, edges, 1.5)


# reliability


@query(f"SELECT s_suppkey, round(beta, 5) AS beta, round({normal.cdf_sql('(-beta)')}, 6) AS pf, round(slope, 4) AS gradient_norm FROM (SELECT s_suppkey, (2 + s_nationkey / 10e0) / sqrt(1 + power(s_suppkey % 3, 2)) AS beta, sqrt(1 + power(s_suppkey % 3, 2)) AS slope FROM supplier)")
def p29_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design points of linear limit states g = c - u1 - k u2, one for each supplier."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (2 + F.col("s_nationkey") / 10.0).alias("c"), (F.col("s_suppkey") % 3).cast("double").alias("k"))
    out = P.form_each(rows, ["s_suppkey"], lambda u, c, k: c - u[0] - k * u[1], 2, ["c", "k"])
    return rounded(rounded(rounded(out, "beta", digits=5), "pf"), "gradient_norm", digits=4)


@query(f"SELECT round(p, 6) AS parameter, round({normal.cdf_sql('(-p / sqrt(1.25e0))')}, 6) AS pf FROM (SELECT 1 + range * 0.125e0 AS p FROM range(17))")
def p32_parametric_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.form_each(P.sweep(spark, 1.0, 3.0, 16), ["parameter"], lambda u, p: p - u[0] - 0.5 * u[1], 2, ["parameter"])
    return rounded(out.select("parameter", "pf"), "parameter", "pf")


@query(f"SELECT l_suppkey AS system, round(max(p), 6) AS low, round(1 - exp(sum(ln(1 - p))), 6) AS high FROM (SELECT l_suppkey, {normal.cdf_sql('(-beta)')} AS p FROM (SELECT l_suppkey, 1 + l_quantity / 20e0 AS beta FROM lineitem)) GROUP BY 1")
def p33_series_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("system"), (1 + F.col("l_quantity") / 20.0).alias("beta"))
    return rounded(P.series_bounds(rows, ["system"]), "low", "high")


@query("SELECT p_partkey, round(x * x + 3 * y, 7) AS one, round(x * x + 3 * y + x * y, 7) AS two FROM (SELECT p_partkey, p_size / 10e0 AS x, p_retailprice / 1000e0 AS y FROM part)")
def p35_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Univariate and bivariate surrogates, exact for the functions they are fitted to."""
    points = P.experimental_points(-2.0, 2.0, 3)
    one = P.univariate_surrogate(lambda x: x[0] ** 2 + 3 * x[1], np.zeros(2), points)
    two = P.bivariate_surrogate(lambda x: x[0] ** 2 + 3 * x[1] + x[0] * x[1], np.zeros(2), points)
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("x"), (F.col("p_retailprice") / 1000.0).alias("y"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["x", "y"]].to_numpy()
        return pd.DataFrame({"p_partkey": pdf["p_partkey"], "one": [one(v) for v in at], "two": [two(v) for v in at]})

    return rounded(P.run_per_sample(rows, each, "p_partkey long, one double, two double"), "one", "two", digits=7)


@query("SELECT p_size AS size, round(p_size / 25e0, 4) AS curvature FROM (SELECT DISTINCT p_size FROM part)")
def p37_curvatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First principal curvature of g = 3 - u1 + k u2² / 2 at its design point (3, 0)."""
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct()

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in pdf["size"]:
            g = lambda u, k=size / 25.0: 3 - u[0] + k * u[1] ** 2 / 2
            found = {"u": np.array([3.0, 0.0]), "alpha": np.array([1.0, 0.0]), "gradient_norm": 1.0}
            out.append((size, float(P.principal_curvatures(g, found)[0])))
        return pd.DataFrame(out, columns=["size", "curvature"])

    return rounded(P.run_per_sample(rows, each, "size int, curvature double"), "curvature", digits=4)


@query("SELECT p_size AS size, round(sqrt(p_size), 6) AS root FROM (SELECT DISTINCT p_size FROM part)")
def p38_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct()
    each = lambda pdf: pd.DataFrame({"size": pdf["size"], "root": [P.secant_root(lambda x, a=a: x * x - a, 0.0, 60.0) for a in pdf["size"]]})
    return rounded(P.run_per_sample(rows, each, "size int, root double"), "root")


@query("SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'error'")
def p40_sensitivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "response", "user_id": "node"})
    return entities.responses_of(facts, 7, "error", "node").select("event_id", "value")


# dispatch


@query("SELECT user_id, event_id, round(max(CASE WHEN force >= 0 THEN force / 90e0 ELSE abs(force / -80e0) END) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS damage FROM " + CYCLES)
def c06_damage_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.DAMAGE["NormalizedPeak"](_cycles(spark, sf_dir), ["user_id"], "event_id", 90.0, -80.0, kind="force")
    return rounded(out.select("user_id", "event_id", "damage"), "damage")


@query(SERIES + """(SELECT event_type AS user_id, event_id, (value - 245) / 10 AS p FROM events)), q AS (SELECT 2 / 0.01e0 * (2 / 0.01e0 * 2 + 2 * 0.1e0 * sqrt(160e0)) AS k1, 2 * 0.1e0 * sqrt(160e0) AS c, 80e0 AS k, 0.3e0 / 0.7e0 * 80 AS h),
    r AS (SELECT DISTINCT event_type AS user_id, 0::BIGINT AS i, 0.05e0 AS u, 0e0 AS v, 0e0 AS a, 0.05e0 AS up, 0.2e0 AS u_max FROM events
    UNION ALL SELECT user_id, i, u, v, a, CASE WHEN sgn = 0 THEN up ELSE (k * u - sgn * 6) / (k + h) END, greatest(u_max, abs(u)) FROM (
        SELECT user_id, i, k, h, sgn, u, 200 * (u - u0) - v0 AS v, 40000 * (u - u0) - 400 * v0 - a0 AS a, up, u_max FROM (
            SELECT *, CASE WHEN sgn = 0 THEN trial ELSE (target - sgn * 6 * k / (k + h)) / (k1 + k * h / (k + h)) END AS u FROM (
                SELECT *, CASE WHEN abs(k * (trial - up) - h * up) > 6 THEN sign(k * (trial - up) - h * up) ELSE 0 END AS sgn FROM (
                    SELECT *, (target + k * up) / (k1 + k) AS trial FROM (
                        SELECT s.user_id, s.i, r.u AS u0, r.v AS v0, r.a AS a0, r.up, r.u_max, q.*, s.p + k1 * r.u + (4 * 2 / 0.01e0 + c) * r.v + 2 * r.a AS target FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1, q))))))
    SELECT user_id AS record, round(u_max, 5) AS u_max, round(u, 5) + 0.0 AS u_end, round(up, 5) + 0.0 AS u_plastic FROM r QUALIFY i = max(i) OVER (PARTITION BY user_id)""")
def c07_oscillator_with_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long record for each type, from a residual displacement and after an earlier maximum."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("record"), "event_id", ((F.col("value") - 245) / 10).alias("force"))
    out = A.oscillator_responses(rows, ["record"], "event_id", "force", 0.01, 2.0, 0.1, 80.0, 6.0, 0.3, residual=0.05, before=0.2)
    return rounded(out.select("record", "u_max", "u_end", "u_plastic"), "u_max", "u_end", "u_plastic", digits=5)


@query(_code("value <= 8", "false", 30).replace("FROM x", "FROM " + ITER))
def v12_test_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.TESTS["NormDispIncr"](_iterations(spark, sf_dir), ["user_id"], "event_id", "value", 8.0, 30)
