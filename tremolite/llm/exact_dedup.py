"""Exact deduplication by 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import matched, maybe_in, staged

#: Tasks among which the copies of one text are dealt when bytes are compared.
SALTS = 16


def content_hash(text: Column) -> Column:
    """The 128 bits by which rows are grouped."""
    return F.unhex(F.md5(text))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical in all bytes after ``normalise`` (default: no change); a null
    text counts as empty. ``keep`` is ``smallest`` or ``largest``: which id of a group stays.

    Only hashes are grouped and joined, pre-aggregated before the shuffle. For hashes seen more
    than once, the smallest and largest text are compared: the copies are dealt out by a salt, and
    each task sends on one pair for a hash (a bit map keeps texts of other hashes out of the shuffle). Only where those differ (a collision) are the texts
    themselves made part of the key.

    Empty table: empty result. Rows that repeat an id and text are all marked alike. A null id is
    never kept if its group has another id; in a group without ids, ``keep_id`` is null and all rows
    are kept. Other columns, whatever their names, are ignored.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), (normalise(text) if normalise else text).alias("t"))
    thin = staged(rows.select("id", hashed(F.col("t")).alias("h"), F.sha2("t", 256).alias("sha")))
    repeated = staged(thin.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = maybe_in(rows.withColumn("h", hashed(F.col("t"))), repeated, "h")
    again = again.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi")
    collided = staged(again.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b").select("h"))
    keyed = thin.withColumn("sub", F.lit(None).cast("string"))
    if not collided.isEmpty():
        apart = rows.withColumn("h", hashed(F.col("t"))).join(collided, "h", "left_semi")
        keyed = keyed.join(collided, "h", "left_anti").select("id", "h", "sha", "sub").unionByName(apart.select("id", "h", F.sha2("t", 256).alias("sha"), F.col("t").alias("sub")))
    groups = keyed.groupBy("h", "sub").agg(pick("id").alias("keep_id"), F.count("*").alias("group_size")).withColumnsRenamed({"h": "gh", "sub": "gsub"})
    same = matched(F.col("h"), F.col("gh")) & F.col("sub").eqNullSafe(F.col("gsub"))
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return keyed.join(groups, same).select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))
