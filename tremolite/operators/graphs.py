"""Graphs of models: who shares what, numbering, partitions and their balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import level_structure
from .parallel import settled, written

#: Groups that a member carries along at most, and pairs that a task tells apart.
CARRIED, TASK = 16, 1 << 19


def vertices(edges: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Vertices of undirected edges (a, b) with their degree; ``weights`` may add (vertex, weight)."""
    ends = edges.select(F.col("a").alias("vertex")).unionByName(edges.select(F.col("b").alias("vertex")))
    out = ends.groupBy("vertex").agg(F.count("*").alias("degree"))
    return out if weights is None else out.join(weights, "vertex", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with more added: each once, its smaller end first, no loops."""
    both = edges.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.where("a < b").distinct()


def remove_vertex(edges: DataFrame, vertex: int) -> DataFrame:
    """Edges without those of a vertex."""
    return edges.where((F.col("a") != vertex) & (F.col("b") != vertex))


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """Union of two graphs' edges."""
    return add_edges(one, other)


def sharing_graph(links: DataFrame, member: str, group: str, least: int | None = None) -> DataFrame:
    """An edge for each pair of members that share a group: nodes that share an element, elements that share
    a node, or equations (``least`` 0) that share an element.

    The pairs of a group are the result asked for. Members of at most CARRIED groups bring those below the one that they meet
    in along; a pair of them counts in the least group that they share, so its rows need no shuffle to be told apart.
    Other pairs are dealt by both ends, about TASK to a task, and repeated ones dropped. Sides of a join
    are shuffled by the group alone, so adaptive execution may split a large group's rows.
    """
    rows = links.select(F.col(member).alias("m"), F.col(group).alias("g")).where("m is not null and g is not null")
    if least is not None:
        rows = rows.where(F.col("m") >= least)
    rows = written(rows.distinct())
    wide = written(rows.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > CARRIED))
    total, held = rows.count(), wide.agg(F.sum("n")).first()[0] or 0
    side = lambda t, c: t.select(F.col("m").alias(c), "g", *(F.col(x).alias(f"{x}_{c}") for x in t.columns if x not in ("m", "g")))
    if 2 * held > total:
        return _once(side(rows, "a").join(side(rows, "b"), "g").where("a < b"), rows)
    few = rows if not held else rows.join(wide, "m", "left_anti")
    few = few.groupBy("m").agg(F.array_sort(F.collect_list("g")).alias("gs")).select("m", "gs", F.posexplode("gs").alias("k", "g"))
    few = few.select("m", "g", F.slice("gs", 1, F.col("k")).alias("less"))
    pairs = side(few, "a").join(side(few, "b"), "g").where((F.col("a") < F.col("b")) & ~F.arrays_overlap("less_a", "less_b")).select("a", "b")
    if not held:
        return pairs
    many = written(rows.join(wide, "m", "left_semi"))
    ends = side(many, "x").join(side(rows.join(wide.select("m", F.lit(True).alias("wide")), "m", "left"), "y"), "g")
    ends = ends.where("x <> y and (wide_y is null or x < y)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.unionByName(_once(ends, rows))


def sharing_pairs(links: DataFrame, member: str, group: str) -> tuple[DataFrame, int]:
    """The edges (a, b), a < b, of ``sharing_graph``, once for each group that both ends share, and a bound of how many rows
    these are: for those who deal out edges anyway and tell them apart where they come to lie."""
    rows = written(links.select(F.col(member).alias("m"), F.col(group).alias("g")).where("m is not null and g is not null").distinct())
    most = rows.groupBy("g").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    return rows.withColumnRenamed("m", "a").join(rows.withColumnRenamed("m", "b"), "g").where("a < b").select("a", "b"), int(most)


def _once(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Distinct ``pairs`` of members (m) of a group (g), in as many tasks as all pairs need."""
    n = rows.groupBy("g").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    return pairs.select("a", "b").repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(n // TASK) + 1), "a", "b").distinct()


def simple_numbering(rows: DataFrame, vertex: str = "vertex") -> DataFrame:
    """Numbers from 0 in the order of the tags, by counts per range partition and not in one task. The placed
    rows are settled first, so a lost executor can't change where the ranges are cut."""
    placed = rows.select(vertex).distinct().repartitionByRange(vertex).sortWithinPartitions(vertex)
    at = F.monotonically_increasing_id()
    placed = settled(placed.select(vertex, F.shiftright(at, 33).alias("__p"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("__k")))
    starts = placed.groupBy("__p").count()
    starts = starts.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__before"))
    return placed.join(starts, "__p").select(vertex, (F.col("__before") + F.col("__k")).alias("number"))


def levels(edges: DataFrame, root: int, rounds: int | None = None) -> DataFrame:
    """Breadth-first level of each vertex reached from ``root``: of all, or of those within ``rounds`` steps."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct())
    start = edges.sparkSession.createDataFrame([(root,)], "vertex long")
    return level_structure(both, start, rounds).select(F.col("vertex").cast("long").alias("vertex"), "level")


def reverse_cuthill_mckee(edges: list[tuple[int, int]]) -> list[int]:
    """Vertices in reverse Cuthill-McKee order, for a graph small enough for the driver: from the vertex of
    least degree of each component, breadth first by degree, reversed."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order: list[int] = []
    seen: set[int] = set()
    for start in sorted(near, key=lambda v: (len(near[v]), v)):
        if start in seen:
            continue
        seen.add(start)
        queue = [start]
        for v in queue:
            new = sorted(near[v] - seen, key=lambda x: (len(near[x]), x))
            seen.update(new)
            queue += new
        order += queue
    return order[::-1]


def minimum_degree(edges: list[tuple[int, int]]) -> list[int]:
    """Elimination order that always takes the vertex of least degree and joins its neighbours; small graphs."""
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order = []
    while near:
        v = min(near, key=lambda x: (len(near[x]), x))
        around = near.pop(v)
        for x in around:
            near[x] = (near[x] | around) - {x, v}
        order.append(v)
    return order


def bandwidth(edges: DataFrame, numbers: DataFrame) -> DataFrame:
    """Largest difference between the numbers of the ends of an edge."""
    n = lambda c, to: numbers.select(F.col("vertex").alias(c), F.col("number").alias(to))
    return edges.join(n("a", "na"), "a").join(n("b", "nb"), "b").agg(F.max(F.abs(F.col("na") - F.col("nb"))).alias("bandwidth"))


def partition(vertex_rows: DataFrame, parts: int, vertex: str = "vertex", seed: int = 0) -> DataFrame:
    """A part for every vertex by hash; a label column may replace it."""
    return vertex_rows.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), vertex), F.lit(parts)).cast("int"))


def boundary(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges whose ends have different parts."""
    of = lambda c, to: labels.select(F.col("vertex").alias(c), F.col("part").alias(to))
    return edges.join(of("a", "part_a"), "a").join(of("b", "part_b"), "b").where("part_a <> part_b")


def shed_heaviest(labels: DataFrame, edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """One round of balancing: boundary vertices of the heaviest part, if over ``factor`` times the mean load, move to
    their lightest neighbouring part. ``labels`` has (vertex, part, weight)."""
    loads = labels.groupBy("part").agg(F.sum("weight").alias("load"))
    worst = loads.agg(F.max_by("part", F.struct("load", -F.col("part"))).alias("__worst"), F.max("load").alias("__top"), F.avg("load").alias("__mean"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(labels.select(F.col("vertex").alias("b"), F.col("part").alias("to")), "b").join(loads.withColumnRenamed("part", "to"), "to")
    lightest = near.groupBy("a").agg(F.min_by("to", F.struct("load", "to")).alias("__to"), F.min("load").alias("__light")).withColumnRenamed("a", "vertex")
    rows = labels.join(lightest, "vertex", "left").join(F.broadcast(worst))
    move = (F.col("part") == F.col("__worst")) & (F.col("__top") > factor * F.col("__mean")) & (F.col("__light") < F.col("__top"))
    return rows.select("vertex", F.when(move, F.col("__to")).otherwise(F.col("part")).alias("part"), "weight")


def release_heavier(labels: DataFrame, edges: DataFrame, factor: float = 1.0) -> DataFrame:
    """One round of balancing: boundary vertices of every part go to their lightest neighbouring part, if their own is
    over ``factor`` times as heavy. ``labels`` has (vertex, part, weight)."""
    loads = labels.groupBy("part").agg(F.sum("weight").alias("load"))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(labels.select(F.col("vertex").alias("b"), F.col("part").alias("to")), "b").join(loads.withColumnRenamed("part", "to"), "to")
    lightest = near.groupBy("a").agg(F.min_by("to", F.struct("load", "to")).alias("__to"), F.min("load").alias("__light")).withColumnRenamed("a", "vertex")
    rows = labels.join(loads.withColumnRenamed("load", "__own"), "part").join(lightest, "vertex", "left")
    move = F.col("__own") > factor * F.col("__light")
    return rows.select("vertex", F.when(move, F.col("__to")).otherwise(F.col("part")).alias("part"), "weight")
