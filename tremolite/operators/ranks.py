"""Ranks and running sums over rows of any number, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .parallel import written


def ranked(df: DataFrame, order: list[str], group: list[str] | None = None, weight: str | None = None, name: str = "rank") -> DataFrame:
    """Add to each row the number of rows before it in ``order`` within its ``group``, or the sum of their ``weight``.

    Rows are placed by ranges of (group, order) and written with their range, so that a lost executor can't change the ranges;
    sums run inside a range, and one total per range and group is carried on to the next. Neither a large group
    nor a frequent value of a leading column lies in one task, as long as ``order`` ends in something distinct.
    """
    group = group or []
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(df.repartitionByRange(n, *group, *order).withColumn("__p", F.spark_partition_id()))
    one = F.col(weight) if weight else F.lit(1).cast("long")
    inside = Window.partitionBy("__p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0) if weight else F.lit(0).cast("long")
    placed = placed.withColumn("__inside", F.coalesce(F.sum(one).over(inside), zero))
    totals = placed.groupBy("__p", *group).agg(F.sum(one).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), zero)
    starts = totals.select(F.col("__p").alias("__q"), *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), before.alias("__before"))
    same = F.col("__p") == F.col("__q")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return placed.join(starts, same).select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name))
