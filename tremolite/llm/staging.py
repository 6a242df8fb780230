"""Materialised intermediate tables and distributed ranks.

Lineage is cut with reliable checkpoints in ``spark.checkpoint.dir``, a folder that the
driver and all executors share, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bits of the map that ``maybe_in`` broadcasts: a megabyte, whatever the number of keys.
SLOTS = 1 << 23
#: Plans made while this is set have their shuffle files deleted as soon as they have run.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share. Only a session on one machine
    (a test) may name none and gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tremolite-"))
    return sc.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df``, computed once and written to the shared checkpoint folder. Its shuffles, which nothing reads again, are deleted."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forgotten(df: DataFrame) -> None:
    """Delete the rows of a ``staged`` table that a later one has replaced."""
    kept = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if kept.isDefined():
        removed(df.sparkSession, kept.get())


def matched(a, b):
    """That keys a and b are equal, said so that a hot key can be split.

    An aggregate's output lies by its key, and a join on that very key would take it as it lies;
    adaptive execution then can't split the other side's hot partition. The second equality makes
    the (small) aggregated side move once more, and the join splittable.
    """
    return (F.hash(a) == F.hash(b)) & (a == b)


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text (null: empty), as 32 hexadecimal digits."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` may be among ``keys`` (a column of that name): none that is goes missing, few others stay.

    A bit map of fixed size (at most SLOTS / 64 rows of one long) is broadcast, so that rows which
    no join would match aren't shuffled. With far more keys than slots it lets all rows through.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    bits = keys.select(slot.alias("__slot")).distinct().groupBy(F.expr("__slot div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(__slot % 64 as int)))").alias("__bits"))
    marked = rows.withColumn("__slot", slot).join(F.broadcast(bits), F.expr("__slot div 64") == F.col("__word"))
    return marked.where("shiftrightunsigned(__bits, cast(__slot % 64 as int)) & 1 = 1").select(*rows.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(y, text, h) of the documents whose 0/1 labels have the least hashed ids, at most ``size`` of them.

    The labels are cut to size by id first; so few ids are broadcast, and no text is shuffled. Labels repeated for an
    id count once, by the smallest. Of documents that repeat an id all count, but of the rows that are found, too,
    only ``size`` are kept, by hashes of id and text.
    """
    few = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).cast("double").alias("y")).withColumn("h", F.xxhash64("l_id"))
    few = few.where("l_id is not null").orderBy("h", "l_id").limit(size)
    found = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(few), F.col("d_id") == F.col("l_id"))
    return found.withColumn("h2", F.xxhash64("text")).orderBy("h", "h2").limit(size).select("y", "text", "h")


def ranked(df: DataFrame, order: list, group: str | None = None, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Add the 0-based ``rank`` of each row in ``order``, within ``group`` if named.

    A range-partitioned sort places the rows, so neither a hot group nor equal keys land in
    one task as long as ``order`` ends in something distinct; only one count per
    (partition, group) is then gathered. ``total``, if named, gets the size of the group.
    ``order`` holds column names. The result is materialised: partition numbers stay as they are.
    """
    keys = [*([group] if group else []), *order]
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.monotonically_increasing_id()
    placed = staged(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .withColumn("__part", F.shiftright(at, 33).cast("int")).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    by = [group] if group else []
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        starts = starts.withColumn(total, F.sum("__n").over(Window.partitionBy(*by)))
    starts = starts.withColumnsRenamed({"__part": "__of", **({group: "__group"} if group else {})})
    same = F.col("__part") == F.col("__of")
    if group:
        same &= F.col(group).eqNullSafe(F.col("__group"))
    position = F.col("__at") - F.col("__first") + F.col("__before")
    return placed.join(starts, same).select(*df.columns, *([total] if total else []), position.alias(rank))
