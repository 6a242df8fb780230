"""Numbering and partition of graphs against plain versions and their own promises."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tremolite.operators import numbering, partitions
from tremolite.operators.graphs import bandwidth
from tremolite.operators.parallel import written
from tremolite.operators.ranks import ranked


def random_edges(rng, n, m, parts=1):
    """Edges within blocks of vertices, with loops and repeats."""
    out = []
    for _ in range(m):
        k = rng.randrange(parts)
        out.append((rng.randrange(n) * parts + k, rng.randrange(n) * parts + k))
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


def near_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def plain_levels(near, root):
    level, queue = {root: 0}, [root]
    for v in queue:
        for x in near[v]:
            if x not in level:
                level[x] = level[v] + 1
                queue.append(x)
    return level


def plain_rcm(edges, alone=()):
    near, order, seen = near_of(edges), [], set()
    key = lambda v: (len(near[v]), v)
    for least in sorted([*near, *(v for v in alone if v not in near)]):
        if least in seen:
            continue
        members = plain_levels(near, least)
        root = min(members, key=key)
        levels = plain_levels(near, root)
        while True:
            top = max(levels.values())
            start = min((v for v in levels if levels[v] == top), key=key)
            other = plain_levels(near, start)
            if max(other.values()) <= top:
                break
            root, levels = start, other
        queue = [root]
        seen.add(root)
        for v in queue:
            new = sorted(near[v] - seen, key=key)
            seen.update(new)
            queue += new
        order += queue
    return {v: len(order) - 1 - i for i, v in enumerate(order)}


@pytest.mark.parametrize("n, m, parts", [(30, 60, 1), (12, 16, 4), (25, 24, 2)])
def test_reverse_cuthill_mckee(spark, n, m, parts):
    rng = random.Random(n)
    edges = random_edges(rng, n, m, parts)
    alone = [1000, 3, 1001]
    got = numbering.cuthill_mckee(frame(spark, edges), spark.createDataFrame([(v,) for v in alone], "vertex long"))
    numbers = {r.vertex: r.number for r in got.collect()}
    assert numbers == plain_rcm(edges, alone)
    plain = max((abs(numbers[a] - numbers[b]) for a, b in edges if a in numbers and b in numbers), default=0)
    assert bandwidth(frame(spark, edges), got).first().bandwidth == plain


def test_a_path_keeps_its_band(spark, monkeypatch):
    """Deeper than the rounds after which levels are settled together; tags shuffled."""
    monkeypatch.setattr(numbering, "SETTLE", 3)
    tags = list(range(11))
    random.Random(2).shuffle(tags)
    path = list(zip(tags, tags[1:], strict=False))
    got = numbering.cuthill_mckee(frame(spark, path))
    assert bandwidth(frame(spark, path), got).first().bandwidth == 1
    assert numbering.cuthill_mckee(frame(spark, [])).count() == 0
    assert numbering.cuthill_mckee(frame(spark, [(4, 4)])).count() == 0


def grid(w, h):
    at = lambda x, y: y * w + x
    return [(at(x, y), at(x + 1, y)) for y in range(h) for x in range(w - 1)] + [(at(x, y), at(x, y + 1)) for y in range(h - 1) for x in range(w)]


def test_parts_of_a_grid(spark):
    edges = frame(spark, grid(14, 14))
    rows = written(partitions.multilevel_parts(edges, 2))
    loads = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("weight").alias("n")).collect()}
    assert sorted(loads) == [0, 1] and sum(loads.values()) == 196
    assert all(abs(n / 98 - 1) <= 0.05 for n in loads.values())
    hashed = rows.withColumn("part", F.pmod(F.xxhash64("vertex"), F.lit(2)))
    assert partitions.cut_weight(edges, rows) <= 30 < partitions.cut_weight(edges, hashed) / 4  # 14 is the best


def test_parts_of_cells_and_weights(spark):
    """Two cells are cut each by itself; weights count; a cut edge's weight too."""
    edges = [(a, b, 1.0) for a, b in grid(8, 8)] + [(a + 100, b + 100, 1.0) for a, b in grid(8, 8)] + [(5, 105, 50.0)]
    vertices = spark.createDataFrame([(v, v // 100, 1.0 + (v % 2)) for v in [*range(64), *range(100, 164)]], "vertex long, cell long, weight double")
    rows = partitions.multilevel_parts(spark.createDataFrame(edges, "a long, b long, w double"), 2, vertices).collect()
    loads = defaultdict(float)
    for r in rows:
        assert r.cell == r.vertex // 100 and r.weight == 1 + r.vertex % 2
        loads[r.cell, r.part] += r.weight
    assert len(rows) == 128 and len(loads) == 4 and all(abs(n / 48 - 1) <= 0.06 for n in loads.values())
    assert partitions.multilevel_parts(frame(spark, []), 3).count() == 0
    star = partitions.multilevel_parts(frame(spark, [(0, i) for i in range(1, 150)]), 3)
    assert {r.part: r.n for r in star.groupBy("part").agg(F.count("*").alias("n")).collect()} == pytest.approx({0: 50, 1: 50, 2: 50}, abs=3)


def test_matching_is_mutual(spark):
    edges, nodes = partitions.graph(frame(spark, random_edges(random.Random(3), 40, 120)))
    limits = spark.createDataFrame([(0, 2.0)], "cell long, limit double")
    mates = {r.vertex: r.coarse for r in partitions.heavy_matching(edges, nodes, limits, 1).collect()}
    pairs = defaultdict(list)
    for v, c in mates.items():
        pairs[c].append(v)
    linked = {(r.a, r.b) for r in edges.collect()}
    assert all(len(p) == 1 or (len(p) == 2 and tuple(p) in linked and c == min(p)) for c, p in pairs.items())
    assert len(pairs) < 0.7 * len(mates)


def test_dissection(spark):
    rng = random.Random(1)
    edges = grid(7, 7) + [(a + 200, b + 200) for a, b in random_edges(rng, 30, 40)]
    rows = numbering.nested_dissection(frame(spark, edges), 2, spark.createDataFrame([(999,)], "vertex long"))
    rows = written(rows)
    got = rows.collect()
    every = {v for e in edges if e[0] != e[1] for v in e} | {999}
    assert {r.vertex for r in got} == every and sorted(r.number for r in got) == list(range(len(every)))
    assert numbering.crossing(frame(spark, edges), rows).count() == 0
    block = {r.vertex: r.block for r in got}
    inside = lambda low, high: bin(high).startswith(bin(low))
    assert all(inside(*sorted((block[a], block[b]))) for a, b in edges if a != b)
    number = {r.vertex: r.number for r in got}
    separators = {r.block for r in got if r.separator}
    for r in got:  # a separator comes after all that it parts
        if r.separator:
            assert all(number[v] < r.number for v, b in block.items() if b != r.block and inside(r.block, b))
    assert separators and all(r.separator == (r.block in separators) for r in got if r.block in separators)


def test_exchange(spark):
    rng = random.Random(1)
    edges = grid(10, 10) + random_edges(rng, 100, 20)
    rows = [(v, min(rng.randrange(6), 3), float(rng.choice([1, 1, 1, 2]))) for v in range(100)]
    e = frame(spark, edges)
    near = {tuple(sorted(x)) for x in edges if x[0] != x[1]}
    weights = {x: sum(tuple(sorted(y)) == x for y in edges) for x in near}

    def state(labels):
        part = {r[0]: r[1] for r in labels}
        loads = defaultdict(float)
        for _, p, w in labels:
            loads[p] += w
        return sum(w for (a, b), w in weights.items() if part[a] != part[b]), max(loads.values()) - min(loads.values())

    before, labels = state(rows), spark.createDataFrame(rows, "vertex long, part int, weight double")
    for rounds in (1, None):
        after = written(partitions.exchanged(e, labels, rounds))
        got = [(r.vertex, r.part, r.weight) for r in after.collect()]
        assert sorted((v, w) for v, _, w in got) == sorted((v, w) for v, _, w in rows)
        now = state(got)
        assert now[0] <= before[0] and now[1] <= before[1]
    assert now[0] < before[0] and now[1] < before[1]
    again = state([(r.vertex, r.part, r.weight) for r in partitions.exchanged(e, after).collect()])
    assert again[0] <= now[0] and again[1] <= now[1]


def test_ranks(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.randrange(3), float(rng.randrange(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, g string, k int, w double")
    got = {r.i: (r.rank, r.sum) for r in ranked(ranked(df, ["k", "i"], ["g"]), ["k", "i"], ["g"], "w", "sum").collect()}
    for i, g, k, _ in rows:
        earlier = [r for r in rows if r[1] == g and (r[2], r[0]) < (k, i)]
        assert got[i] == (len(earlier), sum(r[3] for r in earlier))


def test_levels_join_by_shuffles(spark, monkeypatch):
    """No level goes through the driver: what is computed for one is computed without broadcasts, and the setting comes back."""
    from tremolite.operators import graphs, numbering, parallel

    seen, plain = [], parallel.written
    monkeypatch.setattr(numbering, "written", lambda df: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or plain(df))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    chain = spark.range(10).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.vertex: r.level for r in graphs.levels(chain, 3).collect()} == {i: abs(i - 3) for i in range(11)}
    assert len(seen) > 5 and set(seen) == {"-1"} and spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_exchange_joins_by_shuffles(spark, monkeypatch):
    """Vertices and edges of an exchange never go through the driver; loads and pairs of parts are named for a broadcast."""
    from tremolite.operators import parallel

    seen, plain = [], parallel.written
    monkeypatch.setattr(partitions, "written", lambda df: seen.append(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) or plain(df))
    ring = spark.range(12).select(F.col("id").alias("a"), ((F.col("id") + 1) % 12).alias("b"))
    labels = spark.range(12).select(F.col("id").alias("vertex"), (F.col("id") % 2).cast("int").alias("part"), F.lit(1.0).alias("weight"))
    after = partitions.exchanged(ring, labels, 2)
    assert set(seen) == {"-1"} and after.count() == 12 and partitions.cut_weight(ring, after) <= 12


def test_partition_and_dissection_broadcast_small_tables_only(spark, monkeypatch):
    """What a partition's or a dissection's levels send through the driver is bounded: no table over SMALL is broadcast there."""
    from tremolite.operators import parallel

    seen, plain = [], parallel.written
    monkeypatch.setattr(partitions, "written", lambda df: seen.append(int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))) or plain(df))
    monkeypatch.setattr(numbering, "written", lambda df: seen.append(int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))) or plain(df))
    assert numbering.nested_dissection(frame(spark, grid(4, 4)), 1).count() == 16
    assert partitions.multilevel_parts(frame(spark, grid(4, 4)), 2).count() == 16
    assert len(seen) > 5 and max(seen) <= parallel.SMALL


def test_edges_in_squares_stay_there(spark):
    """Pulls, differences of pulls, independent wishes and merged edges are those of edges both ways, and no edge is shuffled for its ends."""
    from tremolite.operators.parallel import SMALL, shuffled

    rng = random.Random(4)
    once = frame(spark, sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(900)})).withColumn("w", 1.0 + F.col("a") % 3)
    once = written(once)
    squares, both = partitions.Squares(once), written(partitions._flipped(once))
    rows = written(spark.range(60).select(F.col("id").alias("vertex"), (F.col("id") % 3).cast("int").alias("part")))
    wishes = written(rows.select("vertex", (1.0 + F.col("vertex") * 7 % 5).alias("gain")))
    mates = rows.select("vertex", F.col("vertex").bitwiseAND(56).alias("coarse"))
    moved = rows.where("vertex % 11 = 0").withColumn("to", (F.col("part") + 1) % 3)
    after = rows.select("vertex", F.when(F.col("vertex") % 11 == 0, (F.col("part") + 1) % 3).otherwise(F.col("part")).alias("part"))
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.select(*x.columns).collect()))
    with shuffled(spark, most=SMALL, lie=True):
        assert same(partitions._pulls(squares, rows), partitions._pulls(both, rows))
        assert same(partitions._pulls_after(partitions._pulls(squares, rows), squares, moved), partitions._pulls(both, after))
        got = partitions.independent(squares, wishes, 1)
        assert 0 < got.count() < 60 and same(got, partitions.independent(both, wishes, 1))
        assert partitions.independent(squares, wishes.limit(0), 1).count() == 0
        nodes = rows.select("vertex", F.lit(0).alias("cell"), F.lit(1.0).alias("weight"))
        assert same(squares.merged(mates), partitions.contracted(both, nodes, mates)[0].where("a < b"))
        strong = squares.strongest(0).groupBy("a").agg(F.max("w").alias("m"), F.count("*").alias("n"))
        assert strong.where(F.col("n") < partitions.STRONGEST).isEmpty() and same(strong.select("a", "m"), both.groupBy("a").agg(F.max("w").alias("m")))
    with shuffled(spark, lie=True):
        plan = squares.labelled(rows, "part").select("part_a", "part_b")._jdf.queryExecution().executedPlan().toString()
    assert squares.whole and plan.count("Exchange ") == 2


def test_components_of_dense_graphs_follow_few_links(spark, monkeypatch):
    seen, linked = [], numbering._linked
    monkeypatch.setattr(numbering, "_linked", lambda links: seen.append(links.distinct().count()) or linked(links))
    rng = random.Random(11)
    edges = [(100 * k + a, 100 * k + b) for k in range(3) for a in range(60) for b in range(a) if rng.random() < 0.7] + [(900, 901), (901, 902), (902, 903), (950, 950)]
    got = {r.vertex: r.component for r in numbering.components(frame(spark, edges)).collect()}
    assert got == {100 * k + a: 100 * k for k in range(3) for a in range(60)} | {i: 900 for i in range(900, 904)}
    assert seen[0] < len(edges) / 10


def test_buckets_are_not_shuffled(spark):
    from tremolite.operators.parallel import bucketed, forgotten, shuffled

    near = bucketed(numbering.both_ways(frame(spark, [(i, (7 * i + 1) % 50) for i in range(50)])), "a")
    assert spark.catalog.listTables() == []
    with shuffled(spark):
        joined = near.join(spark.range(10).withColumnRenamed("id", "a"), "a")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
        assert joined.count() == near.where("a < 10").count() > 0
    forgotten(near)


def test_dense_graphs_shrink_by_stars(spark, monkeypatch):
    """A dense graph is brought down in few rounds of stars; none outweighs the limit, each hangs together, and edges aren't sorted."""
    from tremolite.operators.parallel import SMALL, shuffled

    rng = random.Random(9)
    pairs = {(i, j) for i in range(400) for j in range(i + 1, 400) if rng.random() < (0.3 if i // 100 == j // 100 else 0.02)} | {(0, j) for j in range(1, 400)}
    squares = partitions.Squares(frame(spark, sorted(pairs)))
    nodes = written(spark.range(400).select(F.col("id").alias("vertex"), F.lit(0).alias("cell"), F.lit(1.0).alias("weight")))
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    limits = spark.createDataFrame([(0, 9.0)], "cell long, limit double")
    with shuffled(spark, most=SMALL, lie=True):
        mates = partitions.starred(squares, nodes, None, limits, 1, 0.1)
        stars = defaultdict(set)
        for r in mates.collect():
            stars[r.coarse].add(r.vertex)
        assert sum(map(len, stars.values())) == 400 and max(map(len, stars.values())) <= 9 and len(stars) < 150
        assert all(any(x <= near[v] | {v} for v in range(400)) and c in x for c, x in stars.items())
        whole, fewer = partitions.shrunk(squares, nodes, limits, 0, 60)
        assert whole.count() == 400 and fewer.agg(F.sum("weight"), F.max("weight")).first()[0] == 400 and fewer.agg(F.max("weight")).first()[0] <= 9
        plan = squares.labelled(nodes, "cell")._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    seen, plain = [], partitions.written
    monkeypatch.setattr(partitions, "written", lambda df: seen.append(1) or plain(df))
    monkeypatch.setattr(partitions, "MANY", 1000)
    parts = written(partitions.multilevel_parts(squares, 2, rounds=1))
    assert len(seen) < 40  # 59 when vertices were matched in pairs
    assert parts.count() == 400 and all(abs(r.n - 200) <= 10 for r in parts.groupBy("part").agg(F.sum("weight").alias("n")).collect())


def test_repeated_edges_of_squares_count_once(spark):
    """Pairs that share many groups are told apart in their square, and pulls are sums of what crosses and of degrees."""
    from tremolite.operators import graphs
    from tremolite.operators.parallel import SMALL, shuffled

    rng = random.Random(2)
    links = spark.createDataFrame([(rng.randrange(30), rng.randrange(40)) for _ in range(300)] + [(None, 1), (3, None)], "m int, g long")
    want = {tuple(r) for r in graphs.sharing_graph(links, "m", "g").collect()}
    pairs, most = graphs.sharing_pairs(links, "m", "g")
    squares = partitions.Squares(pairs, most)
    rows = squares.rows.collect()
    assert len(want) == len(rows) == squares.count <= pairs.count() <= most and {(r.a, r.b) for r in rows} == want and {r.w for r in rows} == {1.0}
    degree = defaultdict(int)
    for a, b in want:
        degree[a] += 1
        degree[b] += 1
    assert {r.vertex: r.degree for r in squares.degrees().collect()} == degree
    labels = spark.range(30).select(F.col("id").alias("vertex"), F.lit(0).alias("part"))
    with shuffled(spark, most=SMALL, lie=True):
        assert {r.vertex: (r.to, r.pull) for r in partitions._pulls(squares, labels).collect()} == {v: (0, n) for v, n in degree.items()}
    none, most = graphs.sharing_pairs(links.where("m < 0"), "m", "g")
    assert most == 0 and partitions.multilevel_parts(partitions.Squares(none, most), 2).count() == 0
