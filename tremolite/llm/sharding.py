"""Proportional stratified interleaving of a corpus into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import matched, ranked, staged


def stratified_shards(df: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Assign every row to one of ``shards`` shards whose row counts differ by one at most.

    Rows of a source are put in a seeded order, by a hash of the text and then of the id. Their
    fractional rank, (rank + 1/2) / rows of the source, sorts all rows; the sorted rows are cut
    into equal runs, so every shard holds every source in proportion. Equal texts have equal hashes
    and so near-equal fractional ranks, in whatever source they are; all take the rank of their first
    row, and so share a shard unless a cut runs through their group.

    Returns id, source, size (UTF-8 bytes of the text plus 8; a null text has none), text_crc32, shard,
    slot (gapless from 0 in each shard). Null sources form a stratum. Repeated rows each get a place
    of their own. Fewer rows than shards leave some shards empty; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.lit(seed), text).alias("k"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("k2"),
    )
    first = ranked(rows, ["k", "k2", "id", "crc"], group="source", rank="r", total="m")
    order = first.withColumn("f", (F.col("r") + F.lit(0.5)) / F.col("m")).select("f", "k", "k2", "id", "source", "size", "crc")
    order = staged(order)
    copies = order.groupBy("k").agg(F.min("f").alias("f1"), F.count("*").alias("c")).where("c > 1").select(F.col("k").alias("ck"), "f1")
    order = order.join(copies, matched(F.col("k"), F.col("ck")), "left").withColumn("f", F.coalesce("f1", "f")).drop("f1", "ck")
    placed = staged(ranked(order, ["f", "k", "k2", "id"], rank="p"))
    n = placed.count()
    shard = F.expr(f"(p * {shards}) div {max(1, n)}")
    first_of = F.expr(f"(((p * {shards}) div {max(1, n)}) * {n} + {shards - 1}) div {shards}")
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("crc").alias("text_crc32"), shard.cast("int").alias("shard"), (F.col("p") - first_of).alias("slot"))
