"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import forgotten, matched, staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Alternates large-star and small-star (each node's larger neighbours, then its smaller ones, are
    linked to its least neighbour) until nothing changes. Least neighbours are found by partial
    aggregation and joined back, so no task gathers the neighbours of a node; every round is
    checkpointed and the one before deleted. Links with a null end or from a node to itself are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v and v is not null").distinct()
    edges = staged(edges)
    mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("lx"), F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, matched(F.col("x"), F.col("lx"))).select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = staged(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "lu")
        small = large.join(least, matched(F.col("u"), F.col("lu"))).select("v", "m").where("v > m").withColumnsRenamed({"v": "u", "m": "v"})
        before, edges = edges, staged(small.unionByName(least.withColumnsRenamed({"lu": "u", "m": "v"})).distinct())
        forgotten(large)
        forgotten(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
