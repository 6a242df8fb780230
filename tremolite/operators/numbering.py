"""Numbering of graphs of any size: components, level structures, Cuthill-McKee order, nested dissection.

Edges are undirected rows (a, b); repeated ones and loops count for nothing. All components are worked on at once, so
the number of rounds is that of the deepest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parallel import SMALL, bucketed, forgotten, in_shuffles, shuffled, written
from .ranks import ranked

#: Levels that are found before all so far are written together.
SETTLE = 32


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once each, without loops."""
    one = edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return one.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))


def components(edges: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(vertex, component) of every vertex with an edge; a component is named by its least vertex.

    ``near``, if given, has the edges ``both_ways`` in buckets of ``a``. First every vertex joins the least of itself and its
    neighbours, and only edges between those are followed on: in a dense graph they are few.
    """
    near = bucketed(both_ways(edges), "a") if near is None else near
    with shuffled(near.sparkSession):
        joined = written(near.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        of = lambda c: joined.select(F.col("a").alias(c), F.col("m").alias(f"m_{c}"))
        links = near.where("a < b").join(of("a"), "a").join(of("b"), "b").where("m_a <> m_b").select(F.col("m_a").alias("a"), F.col("m_b").alias("b"))
        named = written(_linked(links)).select(F.col("vertex").alias("m"), "component")
        return written(joined.join(named, "m", "left").select(F.col("a").alias("vertex"), F.coalesce("component", "m").alias("component")))


def _linked(edges: DataFrame) -> DataFrame:
    """``components`` by rounds over all edges.

    Each round links the neighbours of a vertex to the least of them, larger ones and then smaller ones, so that
    distances shrink by half; it ends when nothing changes.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).distinct())
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = written(near.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        before, links = links, written(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        forgotten(before, large)
    return links.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())


def level_structure(near: DataFrame, roots: DataFrame, rounds: int | None = None) -> DataFrame:
    """(vertex, root, level): breadth-first levels from ``roots`` (vertex), one in a component, over edges that ``near`` has
    both ways; of all vertices, or of those within ``rounds`` steps. A neighbour lies one level away at most, so only
    the last two levels are left out of the next. Levels are joined by shuffles: none goes through the driver."""
    with shuffled(near.sparkSession):
        found = last = written(roots.select("vertex", F.col("vertex").alias("root"), F.lit(0).alias("level")))
        before = last.limit(0)
        level = 0
        while rounds is None or level < rounds:
            level += 1
            step = near.join(last, near["a"] == last["vertex"]).select(F.col("b").alias("vertex"), "root").distinct()
            new = written(step.join(last.select("vertex").unionByName(before.select("vertex")), "vertex", "left_anti").withColumn("level", F.lit(level)))
            if new.isEmpty():
                break
            found, before, last = found.unionByName(new), last, new
            if level % SETTLE == 0:
                found = written(found.repartition("vertex"))
    return found


def peripheral_levels(near: DataFrame, degrees: DataFrame, members: DataFrame) -> DataFrame:
    """(vertex, root, level) from a pseudo-peripheral root in every component: the vertex of least degree, given up for
    that of least degree in its last level for as long as the levels become more. Ties: the least vertex."""
    facts = members.join(degrees, "vertex")
    first = lambda by: F.min_by("vertex", F.struct("degree", "vertex")).alias(by)
    roots = facts.groupBy("component").agg(first("vertex")).select("vertex")
    best, tried = None, written(level_structure(near, roots))
    while True:
        tall = tried.groupBy("root").agg(F.max("level").alias("height"))
        if best is not None:
            of = lambda t, root, height: t.join(members, "vertex").where("level = 0").select("component", F.col("vertex").alias(root)).join(t.groupBy("root").agg(F.max("level").alias(height)).withColumnRenamed("root", root), root)
            won = written(of(tried, "new", "more").join(of(best, "old", "less"), "component").where("more > less").select("new", "old"))
            if won.isEmpty():
                return best
            kept = best.join(won.select(F.col("old").alias("root")), "root", "left_anti").select("vertex", "root", "level")
            tried = tried.join(won.select(F.col("new").alias("root")), "root", "left_semi").select("vertex", "root", "level")
            best = written(kept.unionByName(tried))
            tall = tried.groupBy("root").agg(F.max("level").alias("height"))
        else:
            best = tried
        last = tried.join(tall, "root").where("level = height")
        roots = last.join(degrees, "vertex").groupBy("root").agg(first("start")).where("start <> root").select(F.col("start").alias("vertex"))
        roots = written(roots)
        if roots.isEmpty():
            return best
        tried = written(level_structure(near, roots))


def cuthill_mckee(edges: DataFrame, vertices: DataFrame | None = None, reverse: bool = True) -> DataFrame:
    """(vertex, number) from 0 in reverse Cuthill-McKee order (``reverse`` False: in the order itself).

    Components follow each other by their least vertex, from a pseudo-peripheral vertex each. In a level, vertices
    are ordered by the number of their first neighbour in the level before, degree and vertex, which is the order
    in which a queue would take them. ``vertices`` may add some without edges, each a component. Every level is
    numbered by ranks over ranges. The order depends on the graph alone. No edges and no vertices: no rows.
    """
    near = bucketed(both_ways(edges), "a")
    degrees = written(near.groupBy(F.col("a").alias("vertex")).agg(F.count("*").alias("degree")))
    members = components(edges, near)
    levels = written(peripheral_levels(near, degrees, members).join(degrees, "vertex"))
    last = levels.where("level = 0").select("vertex", "root", F.lit(0).cast("long").alias("place"))
    placed, level = last.withColumn("level", F.lit(0)), 0
    while True:
        level += 1
        next_ = levels.where(F.col("level") == level).select(F.col("vertex").alias("b"), "root", "degree")
        parents = near.join(last.select(F.col("vertex").alias("a"), "place"), "a").join(next_, "b").groupBy(F.col("b").alias("vertex"), "root", "degree").agg(F.min("place").alias("parent"))
        last = written(ranked(parents, ["parent", "degree", "vertex"], ["root"], name="place").select("vertex", "root", "place"))
        if last.isEmpty():
            break
        placed = placed.unionByName(last.withColumn("level", F.lit(level)))
        if level % SETTLE == 0:
            placed = written(placed.repartition("vertex"))
    sizes = levels.join(members, "vertex").groupBy("component", "root", "level").agg(F.count("*").alias("n"))
    if vertices is not None:
        alone = vertices.select(F.col("vertex").cast("long").alias("vertex")).distinct().join(members, "vertex", "left_anti")
        sizes = sizes.unionByName(alone.select(F.col("vertex").alias("component"), F.col("vertex").alias("root"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("n")))
        placed = placed.unionByName(alone.select("vertex", F.col("vertex").alias("root"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("level")))
    starts = ranked(sizes.withColumn("n", F.col("n").cast("double")), ["component", "level"], weight="n", name="start").select("root", "level", F.col("start").cast("long").alias("start"))
    numbers = placed.join(starts, ["root", "level"]).select("vertex", (F.col("start") + F.col("place")).alias("number"))
    if not reverse:
        return numbers
    numbers = written(numbers)
    return numbers.select("vertex", (F.lit(numbers.count() - 1) - F.col("number")).alias("number"))


@in_shuffles(most=SMALL)
def nested_dissection(edges: DataFrame, depth: int, vertices: DataFrame | None = None) -> DataFrame:
    """(vertex, block, separator, number): an elimination order by recursive vertex separators.

    Block 1 is cut into blocks 2 and 3, block c into 2c and 2c + 1, ``depth`` times (at most 16), all blocks of a depth
    at once: ``partitions.multilevel_parts`` halves each, and the ends of its cut edges on the side that has fewer of
    them become the separator, which keeps the number of the block that it cuts. Numbers from 0 take a block's
    first half, its second half and its separator last, in a separator or an uncut block by vertex. No edge
    joins two blocks neither of which contains the other. ``vertices`` may add some without edges.
    """
    from .partitions import multilevel_parts

    near = written(both_ways(edges))
    every = near.select(F.col("a").alias("vertex"))
    if vertices is not None:
        every = every.unionByName(vertices.select(F.col("vertex").cast("long").alias("vertex")))
    open_ = written(every.distinct().withColumn("block", F.lit(1).cast("long")))
    done = open_.limit(0).withColumn("separator", F.lit(True))
    for _ in range(min(depth, 16)):
        of = lambda c: open_.select(F.col("vertex").alias(c), F.col("block").alias(f"block_{c}"))
        inside = written(near.where("a < b").join(of("a"), "a").join(of("b"), "b").where("block_a = block_b").select("a", "b", F.col("block_a").alias("block")))
        if inside.isEmpty():
            break
        halves = written(multilevel_parts(inside.select("a", "b"), 2, open_.select("vertex", F.col("block").alias("cell"))))
        side = lambda c: halves.select(F.col("vertex").alias(c), F.col("part").alias(f"part_{c}"))
        cut = inside.join(side("a"), "a").join(side("b"), "b").where("part_a <> part_b")
        ends = written(cut.select("block", F.explode(F.array(F.struct(F.col("a").alias("vertex"), F.col("part_a").alias("part")), F.struct(F.col("b").alias("vertex"), F.col("part_b").alias("part")))).alias("e")).select("block", "e.*").distinct())
        fewer = ends.groupBy("block", "part").agg(F.count("*").alias("n")).groupBy("block").agg(F.min_by("part", F.struct("n", "part")).alias("part"))
        between = ends.join(fewer, ["block", "part"], "left_semi").select("vertex", "block")
        done = written(done.unionByName(between.withColumn("separator", F.lit(True))))
        left = halves.join(between.select("vertex"), "vertex", "left_anti")
        open_ = written(left.select("vertex", (2 * F.col("cell") + F.col("part")).alias("block")))
    rows = written(done.unionByName(open_.withColumn("separator", F.lit(False))))
    sizes = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count("*").alias("n")).collect()}
    total: dict[int, int] = {}
    for c in sorted({b >> k for b in sizes for k in range(b.bit_length())}, reverse=True):
        total[c] = sizes.get(c, 0) + total.get(2 * c, 0) + total.get(2 * c + 1, 0)
    low = {1: 0}
    for c in sorted(total):
        low[2 * c], low[2 * c + 1] = low[c], low[c] + total.get(2 * c, 0)
    own = [(c, low[c] + total.get(2 * c, 0) + total.get(2 * c + 1, 0)) for c in sizes]
    starts = rows.sparkSession.createDataFrame(own, "block long, start long")
    numbered = ranked(rows, ["vertex"], ["block"], name="place")
    return numbered.join(F.broadcast(starts), "block").select("vertex", "block", "separator", (F.col("start") + F.col("place")).alias("number"))


def crossing(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges whose ends lie in blocks (vertex, block) neither of which contains the other; none in a right dissection."""
    of = lambda c: blocks.select(F.col("vertex").alias(c), F.col("block").alias(f"block_{c}"))
    low, high = F.least("block_a", "block_b"), F.greatest("block_a", "block_b")
    above = F.call_function("shiftright", high, F.length(F.bin(high)) - F.length(F.bin(low)))
    return edges.join(of("a"), "a").join(of("b"), "b").where(above != low)
