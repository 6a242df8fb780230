"""Partition of graphs: coarsening by heavy-edge matching, refinement under a capacity, exchange between parts.

A vertex may carry a ``cell``: then every cell is a graph of its own, edges between cells count for nothing, and all
cells are cut at once. Loads are sums of vertex weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import components, level_structure
from .parallel import SMALL, bucketed, forgotten, in_shuffles, sent_to_all, written
from .ranks import ranked

#: How far the load of a part may lie from the mean of its cell.
SLACK = 0.05
#: Vertices for each part at which coarsening ends, and proposals in one step of it.
COARSE, PROPOSALS = 32, 2
#: Rounds without a move that end an exchange.
STILL = 3
#: Edges, and edges for each vertex, over which a graph is laid in squares; edges of a square from which there are more squares.
MANY, DENSE, SQUARE = 1 << 16, 16, 1 << 23
#: Heaviest edges of a vertex that ``strongest`` keeps.
STRONGEST = 3
#: Vertices of a dense graph for each leader of a star, and how far vertices shrink before all edges are merged.
STAR, SHRINK = 16, 256


class Squares:
    """Edges (a, b, w), each once with a < b, of a dense graph: in buckets of the squares that a hash of each end gives.

    A table of vertices goes to the squares of a row or column, so joins with either end leave the edges where they lie,
    and sums over the edges of a vertex shrink in a square before they are shuffled: if computed ``shuffled`` with ``lie``.
    What comes to a square is hashed, so its edges aren't sorted for a join either.
    """

    def __init__(self, edges: DataFrame, most: int | None = None):
        """``edges`` may be named again and again if ``most`` says how many rows there are at most: each then counts once, with
        weight 1, and is told apart in its square."""
        self.sparkSession = edges.sparkSession
        self.side = max(8, int(((edges.count() if most is None else most) / SQUARE) ** 0.5) + 1)
        self.buckets = max(1, int(self.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ends = [(self._line("a") * self.side + self._line("b")).alias("square"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")]
        if most is None:
            rows = edges.select(*ends, (F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)).alias("w"))
        else:
            rows = edges.select(*ends).repartition(self.buckets, "square").distinct().withColumn("w", F.lit(1.0))
        self.rows = bucketed(rows, "square")
        self.count, self._degrees = self.rows.count(), None
        #: Sums of whole numbers are the same in any order, so they may be kept up to date by differences.
        self.whole = self.rows.where("w <> floor(w)").isEmpty()

    def _line(self, c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(self.side)).cast("int")

    def _at(self, table: DataFrame, end: str) -> DataFrame:
        table = table.withColumnRenamed("vertex", end).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(self.side - 1))))
        line, other = self._line(end), F.col("other")
        square = line * self.side + other if end == "a" else other * self.side + line
        return table.withColumn("square", square).drop("other").repartition(self.buckets, "square").hint("shuffle_hash")

    def touching(self, table: DataFrame) -> DataFrame:
        """Edges with an end in ``table`` (vertex, ...), once for each such end: that end as ``near``, the other as ``vertex``, w, ..."""
        one = self.rows.join(self._at(table, "a"), ["square", "a"]).withColumnsRenamed({"a": "near", "b": "vertex"})
        two = self.rows.join(self._at(table, "b"), ["square", "b"]).withColumnsRenamed({"b": "near", "a": "vertex"})
        return one.unionByName(two).drop("square")

    def labelled(self, table: DataFrame, label: str) -> DataFrame:
        """Edges (a, b, w) with the ``label`` of both ends, from ``table`` (vertex, label)."""
        of = lambda c: self._at(table.select("vertex", F.col(label).alias(f"{label}_{c}")), c)
        return self.rows.join(of("a"), ["square", "a"]).join(of("b"), ["square", "b"]).drop("square")

    def degrees(self) -> DataFrame:
        """(vertex, degree): the weight of a vertex's edges; summed once."""
        if self._degrees is None:
            of = lambda c: self.rows.groupBy(F.col(c).alias("vertex")).agg(F.sum("w").alias("degree"))
            self._degrees = written(of("a").unionByName(of("b")).groupBy("vertex").agg(F.sum("degree").alias("degree")))
        return self._degrees

    def both(self) -> DataFrame:
        return written(_flipped(self.rows.select("a", "b", "w")))

    def strongest(self, seed: int) -> DataFrame:
        """The STRONGEST heaviest edges of every vertex, both ways; ties go by a hash that both ends share."""
        order = Window.partitionBy("a").orderBy(F.desc("w"), F.xxhash64(F.lit(seed), F.least("a", "b"), F.greatest("a", "b")), "b")
        rows = _flipped(self.rows.select("a", "b", "w")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= STRONGEST)
        return written(_flipped(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").distinct()))

    def merged(self, mates: DataFrame) -> DataFrame:
        """Edges (a, b, w), each once with a < b, between the vertices that ``mates`` (vertex, coarse) merge into."""
        rows = self.labelled(mates, "coarse").where("coarse_a <> coarse_b")
        return written(rows.groupBy(F.least("coarse_a", "coarse_b").alias("a"), F.greatest("coarse_a", "coarse_b").alias("b")).agg(F.sum("w").alias("w")))


def _flipped(rows: DataFrame) -> DataFrame:
    """Edges (a, b, w) and the same from b to a."""
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"), "w")
    return rows.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))


def _laid(rows: DataFrame, n: int) -> DataFrame | Squares:
    """Edges, each once, of ``n`` vertices: in squares if there are many for each, else both ways."""
    count = rows.count()
    return Squares(rows) if count > max(MANY, DENSE * n) else written(_flipped(rows))


def graph(edges: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, w) both ways, with the weights of repeated ones summed, and vertices (vertex, cell, weight), as written tables.

    ``edges`` may have ``w`` (else 1), ``vertices`` may have ``cell`` (else 0) and ``weight`` (else 1); vertices that only
    edges name get those defaults. Repeated vertices count once, with their largest weight.
    """
    rows, nodes = _once(edges, vertices)
    return written(_flipped(rows)), nodes


def _once(edges: DataFrame | Squares, vertices: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``graph`` with edges once each, the smaller end as a."""
    if isinstance(edges, Squares):
        rows, named = edges.rows.select("a", "b", "w"), edges.degrees()
    else:
        w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
        rows = edges.where("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), w.alias("w"))
        rows = written(rows.groupBy("a", "b").agg(F.sum("w").alias("w")))
        named = rows.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    named = named.select("vertex", F.lit(None).cast("long").alias("cell"), F.lit(None).cast("double").alias("weight"))
    if vertices is not None:
        given = lambda c, kind: (F.col(c) if c in vertices.columns else F.lit(None)).cast(kind).alias(c)
        named = named.unionByName(vertices.select(F.col("vertex").cast("long").alias("vertex"), given("cell", "long"), given("weight", "double")))
    nodes = written(named.groupBy("vertex").agg(F.coalesce(F.max("cell"), F.lit(0).cast("long")).alias("cell"), F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight")))
    if vertices is not None and "cell" in vertices.columns:
        of = lambda c: nodes.select(F.col("vertex").alias(c), F.col("cell").alias(f"cell_{c}"))
        rows = written(rows.join(of("a"), "a").join(of("b"), "b").where("cell_a = cell_b").select("a", "b", "w"))
    return rows, nodes


def heavy_matching(edges: DataFrame, nodes: DataFrame, limits: DataFrame, seed: int) -> DataFrame:
    """(vertex, coarse): pairs of vertices that propose to each other, named by the smaller one; the rest by themselves.

    Everyone proposes to the neighbour over its heaviest edge whose joint weight is within the cell's ``limit``; ties
    go by a hash that both ends share, so of any set of ties some are mutual. Those left over propose again.
    """
    far = lambda c, to: nodes.select(F.col("vertex").alias(c), F.col("weight").alias(to), *(["cell"] if c == "a" else []))
    fit = edges.join(far("a", "wa"), "a").join(far("b", "wb"), "b").join(limits, "cell").where("wa + wb <= limit").select("a", "b", "w")
    open_, pairs = written(fit), None
    for i in range(PROPOSALS):
        tie = F.xxhash64(F.lit(seed * PROPOSALS + i), F.least("a", "b"), F.greatest("a", "b"))
        choice = written(open_.groupBy("a").agg(F.max_by("b", F.struct("w", tie, "b")).alias("b")))
        mutual = choice.join(choice.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi").where("a < b")
        pairs = mutual if pairs is None else pairs.unionByName(mutual)
        if i + 1 < PROPOSALS:
            taken = mutual.select(F.explode(F.array("a", "b")).alias("t"))
            open_ = open_.join(taken, F.col("a") == F.col("t"), "left_anti").join(taken, F.col("b") == F.col("t"), "left_anti")
    mates = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("vertex"), F.col("a").alias("coarse")), F.struct(F.col("b").alias("vertex"), F.col("a").alias("coarse")))).alias("m")).select("m.*")
    return written(nodes.select("vertex").join(mates, "vertex", "left").select("vertex", F.coalesce("coarse", "vertex").alias("coarse")))


def contracted(edges: DataFrame, nodes: DataFrame, mates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose vertices are the pairs: weights summed, parallel edges merged, loops gone."""
    of = lambda c: mates.select(F.col("vertex").alias(c), F.col("coarse").alias(f"coarse_{c}"))
    rows = edges.join(of("a"), "a").join(of("b"), "b").where("coarse_a <> coarse_b")
    rows = rows.groupBy(F.col("coarse_a").alias("a"), F.col("coarse_b").alias("b")).agg(F.sum("w").alias("w"))
    return written(rows), written(nodes.join(mates, "vertex").groupBy(F.col("coarse").alias("vertex")).agg(F.first("cell").alias("cell"), F.sum("weight").alias("weight")))


def starred(edges: Squares, nodes: DataFrame, whole: DataFrame | None, limits: DataFrame, seed: int, share: float) -> DataFrame:
    """(vertex, coarse) of ``nodes``, whose members ``whole`` (vertex, coarse) names (None: each is its own): a ``share`` of them by hash are leaders, and each
    other joins the leader that pulls it most, named by the leader; those without one stay by themselves.

    Where the joint weight is over the cell's ``limit``, members are dealt out by hash to stars of half of that, and those
    that even so find no room stay by themselves: no star outweighs the limit, none is a long task.
    """
    leads = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(1 << 20)) < int(share * (1 << 20))
    if whole is None:
        to = lambda x, y: edges.rows.where(leads(y) & ~leads(x)).select(F.col(x).alias("vertex"), F.col(y).alias("lead"), "w")
        pulls = to("a", "b").unionByName(to("b", "a"))
    else:
        pulls = edges.touching(whole.where(leads("coarse")).withColumnRenamed("coarse", "lead")).groupBy("vertex", "lead").agg(F.sum("w").alias("w"))
        pulls = pulls.join(whole.where(~leads("coarse")), "vertex").groupBy(F.col("coarse").alias("vertex"), "lead").agg(F.sum("w").alias("w"))
    best = F.max(F.struct("w", F.xxhash64(F.lit(seed), "vertex", "lead").alias("h"), "lead")).alias("best")
    choice = pulls.groupBy("vertex").agg(best).select("vertex", "best.lead", "best.w")
    choice = choice.join(nodes, "vertex").join(nodes.select(F.col("vertex").alias("lead"), F.col("weight").alias("held")), "lead").join(limits, "cell")
    choice = written(choice.where("weight + held <= limit").select("vertex", "lead", "w", "weight", "held", "limit"))
    stars = F.when(F.col("held") + F.col("total") <= F.col("limit"), F.lit(1)).otherwise(F.ceil(2 * (F.col("held") + F.col("total")) / F.col("limit")))
    choice = choice.join(choice.groupBy("lead").agg(F.sum("weight").alias("total")), "lead").withColumn("star", F.pmod(F.xxhash64(F.lit(seed), "vertex"), stars))
    turns = Window.partitionBy("lead", "star").orderBy(F.desc("w"), "vertex").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum("weight").over(turns) + F.when(F.col("star") == 0, F.col("held")).otherwise(0.0)
    joined = choice.select("vertex", "limit", held.alias("sum"), F.when(F.col("star") == 0, F.col("lead")).otherwise(F.first("vertex").over(turns)).alias("coarse"))
    return written(nodes.select("vertex").join(joined.where("sum <= limit").select("vertex", "coarse"), "vertex", "left").select("vertex", F.coalesce("coarse", "vertex").alias("coarse")))


def shrunk(edges: Squares, nodes: DataFrame, limits: DataFrame, seed: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(vertex, coarse) and the coarse vertices: stars of stars of at most some STAR vertices each, in as many rounds as bring them
    to ``least``, or until less than a quarter merges. So the edges of a dense graph are merged once for many halvings."""
    whole, v, n = None, nodes, nodes.count()
    rounds = max(1, math.ceil(math.log(n / least, STAR) - 0.1))
    share = min(0.5, 0.8 * least / n) ** (1 / rounds)
    for turn in range(rounds):
        mates = starred(edges, v, whole, limits, seed * 64 + turn, share)
        whole = mates if whole is None else written(whole.withColumnRenamed("coarse", "by").join(mates.withColumnRenamed("vertex", "by"), "by").select("vertex", "coarse"))
        v = written(v.join(mates, "vertex").groupBy(F.col("coarse").alias("vertex")).agg(F.first("cell").alias("cell"), F.sum("weight").alias("weight")))
        before, n = n, v.count()
        if n > 0.75 * before:
            break
    return whole, v


def by_levels(edges: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """(vertex, part): every cell's vertices in the order of their components and of levels from the least vertex, cut into
    runs of equal load."""
    members = written(components(edges))
    levels = level_structure(edges, members.groupBy("component").agg(F.min("vertex").alias("vertex")))
    order = nodes.join(members, "vertex", "left").join(levels.select("vertex", "level"), "vertex", "left")
    order = order.select("vertex", "cell", "weight", F.coalesce("component", "vertex").alias("component"), F.coalesce("level", F.lit(0)).alias("level"))
    order = ranked(order, ["component", "level", "vertex"], ["cell"], "weight", "before")
    total = nodes.groupBy("cell").agg(F.sum("weight").alias("total"))
    part = F.floor((F.col("before") + F.col("weight") / 2) * parts / F.col("total")).cast("int")
    return order.join(total, "cell").select("vertex", F.least(part, F.lit(parts - 1)).alias("part"))


def _loads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell", "part").agg(F.sum("weight").alias("load"))


def _pulls(edges: DataFrame | Squares, rows: DataFrame) -> DataFrame:
    """(vertex, to, pull): the weight of a vertex's edges to each part that it touches."""
    if isinstance(edges, Squares) and edges.whole:  # what crosses is summed, the rest of a vertex's edges pull it to its own part
        end = lambda x, y: F.struct(F.col(x).alias("vertex"), F.col(f"part_{y}").alias("to"), F.col("w").alias("pull"))
        cross = edges.labelled(rows, "part").where("part_a <> part_b").select(F.inline(F.array(end("a", "b"), end("b", "a"))))
        cross = written(cross.groupBy("vertex", "to").agg(F.sum("pull").alias("pull")))
        own = edges.degrees().join(rows.select("vertex", F.col("part").alias("to")), "vertex").join(cross.groupBy("vertex").agg(F.sum("pull").alias("gone")), "vertex", "left")
        return cross.unionByName(own.select("vertex", "to", (F.col("degree") - F.coalesce("gone", F.lit(0.0))).alias("pull")).where("pull > 0"))
    if isinstance(edges, Squares):
        return edges.touching(rows.select("vertex", F.col("part").alias("to"))).groupBy("vertex", "to").agg(F.sum("w").alias("pull"))
    near = rows.select(F.col("vertex").alias("b"), F.col("part").alias("to"))
    return edges.join(near, "b").groupBy(F.col("a").alias("vertex"), "to").agg(F.sum("w").alias("pull"))


def _pulls_after(pulls: DataFrame, edges: Squares, moved: DataFrame) -> DataFrame:
    """``_pulls`` after vertices ``moved`` (vertex, part, to), by the differences that these make."""
    now = F.inline(F.array(F.struct(F.col("part").alias("to"), (-F.col("w")).alias("pull")), F.struct("to", F.col("w").alias("pull"))))
    more = edges.touching(moved.select("vertex", "part", "to")).select("vertex", now)
    return pulls.unionByName(more.groupBy("vertex", "to").agg(F.sum("pull").alias("pull"))).groupBy("vertex", "to").agg(F.sum("pull").alias("pull")).where("pull <> 0")


def independent(edges: DataFrame | Squares, wishes: DataFrame, seed: int) -> DataFrame:
    """The ``wishes`` (vertex, gain, ...) of vertices none of whose neighbours wishes more; their gains add up exactly.

    In a dense graph wishes go to the squares of both ends, and only those that are beaten there are sent on.
    """
    rank = lambda gain, v: F.struct(F.col(gain).alias("gain"), F.xxhash64(F.lit(seed), F.col(v)).alias("h"), F.col(v).alias("vertex"))
    if isinstance(edges, Squares):
        wish = written(wishes)
        beaten = edges.labelled(wish, "gain").select(F.when(rank("gain_a", "a") < rank("gain_b", "b"), F.col("a")).otherwise(F.col("b")).alias("vertex"))
        return wish.join(beaten.distinct(), "vertex", "left_anti")
    wish = written(wishes.withColumn("rank", rank("gain", "vertex")))
    mine, other = wish.select(F.col("vertex").alias("a"), F.col("rank").alias("mine")), wish.select(F.col("vertex").alias("b"), F.col("rank").alias("other"))
    beaten = edges.join(mine, "a").join(other, "b").where("other > mine").select(F.col("a").alias("vertex")).distinct()
    return wish.join(beaten, "vertex", "left_anti").drop("rank")


def _running(by: list[str], weight: str = "weight"):
    """The weight of those who gain more, and one's own, among the movers of a part: fewer than its vertices, whose load
    is bounded, sorted and summed as a stream."""
    w = Window.partitionBy(*by).orderBy(F.desc("gain"), "vertex").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(weight).over(w)


def refined(edges: DataFrame | Squares, nodes: DataFrame, labels: DataFrame, parts: int, slack: float = SLACK, rounds: int | None = None) -> DataFrame:
    """Labels (vertex, part) with a smaller cut: vertices go to the part that pulls them most, round after round.

    In a round only vertices none of whose neighbours gains more may move, so the cut falls by the sum of the
    gains. Movers into a part are admitted by gain while its load stays under the mean by 1 + ``slack``, those out of
    one while it stays over the mean by 1 - ``slack``. Ends when nobody moves, or after ``rounds``.
    """
    rows = written(nodes.join(labels, "vertex"))
    means = nodes.groupBy("cell").agg((F.sum("weight") / parts).alias("mean"))
    full = nodes.select("cell").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kept = written(_pulls(edges, rows)) if isinstance(edges, Squares) else None
    turn = 0
    while rounds is None or turn < rounds:
        turn += 1
        loads = full.join(_loads(rows), ["cell", "part"], "left").join(means, "cell").select("cell", "part", F.coalesce("load", F.lit(0.0)).alias("load"), "mean")
        pulls = (_pulls(edges, rows) if kept is None else kept).join(rows, "vertex")
        own = F.coalesce(F.max(F.when(F.col("to") == F.col("part"), F.col("pull"))), F.lit(0.0))
        best = F.max(F.when(F.col("to") != F.col("part"), F.struct("pull", F.xxhash64(F.lit(turn), "vertex", "to").alias("h"), "to")))
        wish = pulls.groupBy("vertex", "cell", "part", "weight").agg(own.alias("own"), best.alias("best"))
        wish = wish.where("best.pull > own").select("vertex", "cell", "part", "weight", F.col("best.to").alias("to"), (F.col("best.pull") - F.col("own")).alias("gain"))
        wish = independent(edges, wish, turn).withColumns({"into": _running(["cell", "to"]), "outof": _running(["cell", "part"])})
        at = lambda c, load: loads.select("cell", F.col("part").alias(c), F.col("load").alias(load), *(["mean"] if c == "to" else []))
        wish = wish.join(at("to", "there"), ["cell", "to"]).join(at("part", "here"), ["cell", "part"])
        moved = wish.where((F.col("there") + F.col("into") <= (1 + slack) * F.col("mean")) & (F.col("here") - F.col("outof") >= (1 - slack) * F.col("mean"))).select("vertex", "part", "to")
        if kept is not None:
            moved = written(moved)
            if moved.isEmpty():
                break
        before, rows = rows, written(rows.select("vertex", "cell", "weight", "part").join(moved.select("vertex", "to"), "vertex", "left").select("vertex", "cell", "weight", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("moved")))
        forgotten(before)
        if kept is None and rows.where("moved").isEmpty():
            break
        if kept is not None and turn != rounds:
            before, kept = kept, written(_pulls_after(kept, edges, moved) if edges.whole else _pulls(edges, rows))
            forgotten(before)
    return rows.select("vertex", "cell", "weight", "part")


@in_shuffles(most=SMALL, lie=True)
def multilevel_parts(edges: DataFrame | Squares, parts: int, vertices: DataFrame | None = None, slack: float = SLACK, rounds: int = 4) -> DataFrame:
    """(vertex, cell, weight, part): every cell of the graph in ``parts`` parts of near equal load and a small cut.

    Matching merges pairs over heavy edges until a part has some COARSE vertices left or less than a quarter of them
    merges (no merged vertex outweighs half of ``slack``); the coarsest graph is cut along its levels; then the labels go
    back, graph by graph, each ``refined``, the whole graph in at most ``rounds`` and the others in half as many. Loads stay within ``slack`` of the mean as far as
    single vertices allow it. Columns of ``edges`` and ``vertices`` as in ``graph``. Empty graph: no rows.

    Dense graphs lie in ``Squares`` (``edges`` may be such) and shrink by stars instead of pairs, by up to SHRINK from one to the
    next, as their edges hardly become fewer before.
    """
    e, v = _once(edges, vertices)
    n = v.count()
    given = isinstance(edges, Squares) and (vertices is None or "cell" not in vertices.columns) and edges.count > max(MANY, DENSE * n)
    e = edges if given else _laid(e, n)
    cells = v.groupBy("cell").agg(F.sum("weight").alias("total"))
    limits = written(cells.select("cell", (F.col("total") / parts * slack / 2).alias("limit")))
    enough, down = COARSE * parts * limits.count(), []
    while n > enough:
        if isinstance(e, Squares):
            mates, fewer = shrunk(e, v, limits, len(down), max(enough, n // SHRINK))
            left = fewer.count()
        else:
            mates = heavy_matching(e, v, limits, len(down))
            coarser, fewer = contracted(e, v, mates)
            left = fewer.count()
        if left > 0.75 * n:
            break
        down.append((e, v, mates))
        e, v, n = _laid(e.merged(mates), left) if isinstance(e, Squares) else coarser, fewer, left
    labels = by_levels(e.both() if isinstance(e, Squares) else e, v, parts)
    rows = refined(e, v, labels, parts, slack, rounds)
    while down:
        e, v, mates = down.pop()
        labels = mates.join(rows.select(F.col("vertex").alias("coarse"), "part"), "coarse").select("vertex", "part")
        rows = refined(e, v, labels, parts, slack, max(1, rounds // 2) if down else rounds)
    return rows


def cut_weight(edges: DataFrame, labels: DataFrame, w: Column | None = None) -> float:
    """Weight of the edges (each once) whose ends have different parts."""
    of = lambda c: labels.select(F.col("vertex").alias(c), F.col("part").alias(f"part_{c}"))
    rows = edges.join(of("a"), "a").join(of("b"), "b").where("part_a <> part_b")
    return rows.agg(F.sum(F.lit(1.0) if w is None else w)).first()[0] or 0.0


@in_shuffles
def exchanged(edges: DataFrame, labels: DataFrame, rounds: int | None = None) -> DataFrame:
    """Labels (vertex, part, weight) after exchange between parts, to a standstill (or for ``rounds``).

    In a round, boundary vertices none of whose neighbours gains more are candidates for the part that pulls
    them most or for their lightest neighbour. Parts pair up, each with one other at most, by the best
    candidate between them. Between two parts, candidates of equal weight swap in the order of their gains
    while a swap shrinks the cut; the others go from the heavier to the lighter part while they don't enlarge
    the cut and the lighter one stays the lighter. So neither the cut nor the spread of the loads (largest less
    smallest) rises in any round, and one of the cut and the sum of squared loads falls whenever a vertex moves.
    A round that moves nothing is followed by others whose pairs are drawn by hash; it ends after more than STILL in
    succession, or when no candidate is left.
    """
    e, _ = graph(edges)
    rows = written(labels.select(F.col("vertex").cast("long").alias("vertex"), "part", F.col("weight").cast("double").alias("weight")))
    turn = still = 0
    while rounds is None or turn < rounds:
        turn += 1
        loads = written(rows.groupBy("part").agg(F.sum("weight").alias("load")))
        pulls = _pulls(e, rows).join(rows, "vertex")
        own = F.coalesce(F.max(F.when(F.col("to") == F.col("part"), F.col("pull"))), F.lit(0.0)).alias("own")
        others = F.collect_list(F.when(F.col("to") != F.col("part"), F.struct("to", "pull"))).alias("others")
        wish = pulls.groupBy("vertex", "part", "weight").agg(own, others).select("vertex", "part", "weight", "own", F.explode("others").alias("o")).select("vertex", "part", "weight", F.col("o.to").alias("to"), (F.col("o.pull") - F.col("own")).alias("gain"))
        at = lambda c, load: sent_to_all(loads.select(F.col("part").alias(c), F.col("load").alias(load)))  # noqa: E731, B023
        wish = written(wish.join(at("part", "here"), "part").join(at("to", "there"), "to"))
        useful = (F.col("gain") > 0) | ((F.col("gain") == 0) & (F.col("here") >= F.col("there") + 2 * F.col("weight")))
        pair = F.struct(F.least("part", "to").alias("p"), F.greatest("part", "to").alias("q"))
        worthy = ["gain", (F.col("here") - F.col("there")).alias("d"), F.xxhash64(F.lit(turn), F.least("part", "to"), F.greatest("part", "to")).alias("h")]
        worth = wish.where(useful).select(pair.alias("pair"), F.struct(*(worthy if not still else worthy[::-1])).alias("best"))
        worth = written(worth.groupBy("pair").agg(F.max("best").alias("best")).select("pair.*", "best"))
        if worth.isEmpty():
            break
        ends = worth.select("p", "q", "best", F.explode(F.array("p", "q")).alias("part"))
        choice = ends.groupBy("part").agg(F.max_by(F.struct("p", "q"), F.struct("best", "p", "q")).alias("c")).select("c.*")
        paired = sent_to_all(written(choice.groupBy("p", "q").agg(F.count("*").alias("n")).where("n = 2").select("p", "q")))
        live = wish.withColumns({"p": F.least("part", "to"), "q": F.greatest("part", "to")}).join(paired, ["p", "q"])
        live = independent(e, live.select("vertex", "part", "weight", "to", "gain", "here", "there", "p", "q"), turn)
        turns = Window.partitionBy("part", "to", "weight").orderBy(F.desc("gain"), "vertex")
        live = written(live.withColumn("k", F.row_number().over(turns)))
        lower = live.where("part = p").select("p", "q", "weight", "k", F.col("vertex").alias("u"), F.col("gain").alias("gu"))
        upper = live.where("part = q").select("p", "q", "weight", "k", F.col("vertex").alias("v"), F.col("gain").alias("gv"))
        swaps = lower.join(upper, ["p", "q", "weight", "k"]).where("gu + gv > 0").select(F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.col("q").alias("to")), F.struct(F.col("v").alias("vertex"), F.col("p").alias("to")))).alias("s")).select("s.*")
        single = live.join(swaps.select("vertex"), "vertex", "left_anti").where("gain >= 0 and here > there").drop("k")
        single = single.withColumn("gone", _running(["part"])).where("2 * gone <= here - there").select("vertex", "to")
        moved = written(swaps.unionByName(single))
        if moved.isEmpty():
            still += 1
            if still > STILL:
                break
            continue
        still = 0
        before, rows = rows, written(rows.join(moved, "vertex", "left").select("vertex", F.coalesce("to", "part").alias("part"), "weight"))
        forgotten(before, wish, live)
    return rows
