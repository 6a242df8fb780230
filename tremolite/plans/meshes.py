"""Queries that number, part and balance whole graphs of the driver's tables, and follow chains to their ends.

What has no order of its own in SQL (which vertex lies in which part) is answered by facts that it must have: sizes
within their bounds, edges cut and edges across. These queries give them beside figures that SQL has too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entities, graphs, numbering, partitions
from ..operators import recorders as R
from ..operators.parallel import shuffled, written
from .queries import CHAIN, EDGES, LINKS, _edges, _links, query, table


def _levels_sql(name: str, root: str) -> str:
    return f"""f{name} AS (SELECT ({root}) AS v, 0 AS level UNION SELECT e.b, f.level + 1 FROM f{name} f JOIN e ON e.a = f.v WHERE f.level < 9),
    l{name} AS (SELECT v, min(level) AS level FROM f{name} GROUP BY 1), h{name} AS (SELECT max(level) AS h FROM l{name}),
    c{name} AS (SELECT first(v ORDER BY degree, v) AS v FROM l{name} JOIN d USING (v) WHERE level = (SELECT h FROM h{name}))"""


BOTH = "e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0), d AS (SELECT a AS v, count(*) AS degree FROM e GROUP BY 1)"


@query("WITH RECURSIVE k AS " + LINKS + ", e0 AS MATERIALIZED " + EDGES + ", " + BOTH.replace("AS (", "AS MATERIALIZED (") + ", " + ", ".join([_levels_sql("1", "SELECT first(v ORDER BY degree, v) FROM d"), _levels_sql("2", "SELECT v FROM c1"), _levels_sql("3", "SELECT v FROM c2")]) + """,
    l AS MATERIALIZED (SELECT * FROM l1 WHERE (SELECT h FROM h2) <= (SELECT h FROM h1) UNION ALL SELECT * FROM l2 WHERE (SELECT h FROM h2) > (SELECT h FROM h1) AND (SELECT h FROM h3) <= (SELECT h FROM h2)
        UNION ALL SELECT * FROM l3 WHERE (SELECT h FROM h2) > (SELECT h FROM h1) AND (SELECT h FROM h3) > (SELECT h FROM h2)),
    n AS (SELECT v, level, CAST(0 AS BIGINT) AS place FROM l WHERE level = 0
        UNION ALL SELECT v, level, row_number() OVER (ORDER BY parent, degree, v) - 1 FROM (SELECT l.v, l.level, d.degree, min(n.place) AS parent FROM n JOIN e ON e.a = n.v JOIN l ON l.v = e.b AND l.level = n.level + 1 JOIN d ON d.v = l.v GROUP BY ALL)),
    s AS (SELECT level, sum(count(*)) OVER (ORDER BY level) - count(*) AS start FROM l GROUP BY 1)
    SELECT v AS vertex, CAST((SELECT count(*) FROM l) - 1 - start - place AS BIGINT) AS number FROM n JOIN s USING (level)""")
def g08_reverse_cuthill_mckee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.cuthill_mckee(_edges(spark, sf_dir))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"))
    return part.withColumn("b", F.col("a") + 1).unionByName(part.select("a", (F.col("a") * 7 % F.lit(part.count())).alias("b")))


@query("WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM " + CHAIN + " WHERE a <> b), v AS (SELECT a FROM e UNION SELECT b FROM e) SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges, 0 AS edges_across, (SELECT count(*) FROM v) AS numbers, (SELECT count(*) - 1 FROM v) AS last_number, 3 AS separators")
def g08_nested_dissection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two depths of separators on the graph of parts: no edge joins what a separator parts, and numbers are gapless."""
    edges = written(numbering.both_ways(_chain(spark, sf_dir)).where("a < b"))
    blocks = written(numbering.nested_dissection(edges, 2))
    facts = blocks.agg(F.count("*").alias("vertices"), F.countDistinct("number").alias("numbers"), F.max("number").alias("last_number"), F.countDistinct(F.when(F.col("separator"), F.col("block"))).alias("separators"))
    across = numbering.crossing(edges, blocks).agg(F.count("*").alias("edges_across"))
    return facts.join(across).join(edges.agg(F.count("*").alias("edges")))


@query("WITH k AS " + LINKS + ", e AS MATERIALIZED " + EDGES + ", v AS (SELECT a AS v FROM e UNION SELECT b FROM e) SELECT CAST(range AS INTEGER) AS part, (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e WHERE a % 4 <> b % 4) AS cut_by_tag, true AS within, true AS cuts_fewer FROM range(4)")
def g09_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts of the graph of parts: each within 5 % of the mean (or one vertex), the cut under that of parts by tag."""
    edges = partitions.Squares(*graphs.sharing_pairs(_links(spark, sf_dir), "node_tag", "element_tag"))
    rows = written(partitions.multilevel_parts(edges, 4))
    sizes = rows.groupBy("part").agg(F.sum("weight").alias("load"))
    by_tag = edges.rows.agg(F.count(F.when(F.col("a") % 4 != F.col("b") % 4, 1)).alias("cut_by_tag"))
    with shuffled(spark, lie=True):
        cut = written(edges.labelled(rows, "part").where("part_a <> part_b").agg(F.count("*").alias("cut")))
    total = rows.agg(F.count("*").alias("vertices"), F.sum("weight").alias("total"))
    within = F.abs(F.col("load") - F.col("total") / 4) <= F.greatest(F.lit(1.0), 0.05 * F.col("total") / 4)
    return sizes.join(by_tag).join(cut).join(total).select("part", "vertices", "cut_by_tag", within.alias("within"), (F.col("cut") < F.col("cut_by_tag")).alias("cuts_fewer"))


@query("WITH e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM " + CHAIN + """ WHERE a <> b), v AS (SELECT v, least(v % 5, 3) AS part FROM (SELECT a AS v FROM e UNION SELECT b FROM e)), l AS (SELECT part, count(*) AS load FROM v GROUP BY 1)
    SELECT (SELECT count(*) FROM e JOIN v x ON x.v = a JOIN v y ON y.v = b WHERE x.part <> y.part) AS cut_before, (SELECT CAST(max(load) - min(load) AS DOUBLE) FROM l) AS spread_before, true AS cut_lower, true AS spread_not_higher, (SELECT CAST(count(*) AS DOUBLE) FROM v) AS load""")
def g10_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange between four parts by tag, one of them twice as heavy, for at most six rounds."""
    edges = written(numbering.both_ways(_chain(spark, sf_dir)).where("a < b"))
    labels = written(graphs.vertices(edges).select("vertex", F.least(F.col("vertex") % 5, F.lit(3)).cast("int").alias("part"), F.lit(1.0).alias("weight")))
    after = written(partitions.exchanged(edges, labels, 6))

    def facts(rows: DataFrame, name: str) -> DataFrame:
        loads = rows.groupBy("part").agg(F.sum("weight").alias("load")).agg((F.max("load") - F.min("load")).alias(f"spread_{name}"), F.sum("load").alias(f"load_{name}"))
        return loads.join(graphs.boundary(edges, rows).agg(F.count("*").alias(f"cut_{name}")))

    both = facts(labels, "before").join(facts(after, "after"))
    return both.select("cut_before", "spread_before", (F.col("cut_after") < F.col("cut_before")).alias("cut_lower"), (F.col("spread_after") <= F.col("spread_before")).alias("spread_not_higher"), F.col("load_after").alias("load"))


FOLLOWS = "(SELECT o_orderkey AS tag, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dependant FROM orders)"


@query("WITH RECURSIVE gone AS (SELECT DISTINCT l_orderkey AS tag FROM lineitem WHERE abs(l_quantity) > 49 UNION SELECT dependant FROM gone JOIN " + FOLLOWS + " USING (tag) WHERE dependant IS NOT NULL) SELECT o_orderkey AS tag, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT tag FROM gone)")
def r15_removed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose line items went over the limit are removed, with all later orders of the same customer."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tag"), "o_custkey")
    follows = orders.select("tag", F.lead("tag").over(Window.partitionBy("o_custkey").orderBy("tag")).alias("dependant")).where("dependant is not null")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_tag"), F.col("l_quantity").alias("value"))
    return R.removed(orders, follows, rows, 49.0, chained=True)


TIED = "(SELECT o_orderkey AS constrained, lag(o_orderkey) OVER w AS retained, 0.5e0 AS coefficient FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey) UNION ALL SELECT o_orderkey, lag(o_orderkey, 2) OVER w, 0.25e0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"


@query("WITH RECURSIVE t AS (SELECT * FROM " + TIED + """ WHERE retained IS NOT NULL), c AS (SELECT DISTINCT constrained FROM t),
    w AS (SELECT constrained, retained, coefficient FROM t UNION ALL SELECT w.constrained, t.retained, w.coefficient * t.coefficient FROM w JOIN t ON t.constrained = w.retained)
    SELECT constrained, retained, round(sum(coefficient), 9) AS coefficient FROM w WHERE retained NOT IN (SELECT constrained FROM c) GROUP BY 1, 2""")
def d22_chained_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is tied to the two before it of the same customer, so all in the end to the first."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").where("o_orderkey is not null")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    one = lambda k, c: F.struct(F.lag("o_orderkey", k).over(w).alias("retained"), F.lit(c).alias("coefficient"))
    ties = orders.select(F.col("o_orderkey").alias("constrained"), F.array(one(1, 0.5), one(2, 0.25)).alias("to")).select("constrained", F.inline("to"))
    ties = ties.where("retained is not null").withColumns({"constrained_dof": F.lit(1), "retained_dof": F.lit(1)})
    return entities.resolved(ties).where("not open").select("constrained", "retained", F.round("coefficient", 9).alias("coefficient"))


STANDARD = "(l_quantity - 25.5) / 14.43 AS x, (l_discount - 0.05) / 0.0316 AS z"


@query("SELECT l_returnflag, count(*) AS n, count(CASE WHEN abs(3 - 0.6e0 * x - 0.8e0 * z) <= 6 THEN 1 END) AS n_plane, round(avg(CASE WHEN abs(3 - 0.6e0 * x - 0.8e0 * z) <= 6 THEN 3 - 0.6e0 * x - 0.8e0 * z END), 6) AS plane, round(avg(-1 + sqrt(1 + 2 * (2.5e0 + 0.1e0 * z * z))), 6) AS curved FROM (SELECT l_returnflag, " + STANDARD + " FROM lineitem) GROUP BY 1")
def p34_plane_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from a plane of samples to two limit states, by root finding: one linear, one quadratic in the distance."""
    from ..operators.surfaces import line_roots

    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", ((F.col("l_quantity") - 25.5) / 14.43).alias("x"), ((F.col("l_discount") - 0.05) / 0.0316).alias("z"))
    plane = line_roots(lambda r, x, z: 3 - 0.6 * x - 0.8 * z - r, -6.0, 6.0, "x", "z")
    curved = line_roots(lambda r, z: 2.5 + 0.1 * z * z - r - 0.5 * r * r, 0.0, 8.0, "z")
    rows = rows.select("l_returnflag", plane.alias("plane"), curved.alias("curved"))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("plane").alias("n_plane"), F.round(F.avg("plane"), 6).alias("plane"), F.round(F.avg("curved"), 6).alias("curved"))


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, count(*)::DOUBLE AS a, sum(x) AS b, sum(x * x) AS c, sum(x * x * x) AS d, sum(x * x * x * x) AS e, sum(y) AS p, sum(x * y) AS q, sum(x * x * y) AS r
        FROM (SELECT l_returnflag, (l_quantity - 25.5) / 14.43 AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY 1),
    t AS (SELECT *, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS det FROM s)
    SELECT l_returnflag, n, round((p * (c * e - d * d) - b * (q * e - d * r) + c * (q * d - c * r)) / det, 5) AS c0, round((a * (q * e - d * r) - p * (b * e - c * d) + c * (b * r - q * c)) / det, 5) AS c1,
        round((a * (c * r - q * d) - b * (b * r - q * c) + p * (b * d - c * c)) / det, 5) AS c2 FROM t""")
def p25_response_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price as a quadratic of quantity in every return flag: least squares by sums over all line items."""
    from ..operators.surfaces import least_squares

    x = (F.col("l_quantity") - 25.5) / 14.43
    fit = least_squares(table(spark, sf_dir, "lineitem"), ["l_returnflag"], [F.lit(1.0), x, x * x], F.col("l_extendedprice") / 1000)
    return fit.select("l_returnflag", "n", *(F.round(F.get("coefficients", F.lit(i)), 5).alias(f"c{i}") for i in range(3)))
