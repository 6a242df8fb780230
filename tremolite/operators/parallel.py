"""What a parallel model does by hand, in Spark's terms: where rows are, small data to all, partitions by label, timings."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

#: Most bytes that ``sent_to_all`` broadcasts.
LIMIT = 64 << 20
#: Most bytes of a table that ``in_shuffles`` lets the optimiser broadcast, where rounds grow with the logarithm of the input.
SMALL = 256 << 10


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which the driver and all executors share; only a session on one machine
    may name none and gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tremolite-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder, so that its rows and their places stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table of its own in the shared folder: for rounds of a loop.

    A checkpoint hands the constraints that the optimiser knows of its rows on to the next plan, and over many rounds
    of renamed columns these grow faster than the rounds. A table that is read again brings none.
    """
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    table = df.sparkSession.read.schema(df.schema).parquet(folder)
    table._folder = folder
    return table


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a ``written`` table in as many buckets of ``key`` as a shuffle has partitions: joins and sums by ``key`` take
    its rows as they lie. For large tables that a loop joins again and again."""
    spark = df.sparkSession
    folder, name = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", f"table_{uuid.uuid4().hex}"
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", folder).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018
    spark.sql(f"DROP TABLE {name}")  # the name; its rows lie in ``folder``
    table._folder = folder
    return table


def forgotten(*tables: DataFrame) -> None:
    """Delete the rows of ``written`` tables that later ones have replaced; other tables are left alone."""
    for table in tables:
        if folder := table.__dict__.get("_folder"):
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffled(spark: SparkSession, most: int = -1, lie: bool = False) -> Iterator[None]:
    """What is computed in a block joins by shuffles, but for tables that are named for a broadcast or hold ``most`` bytes: a
    broadcast goes through the driver, and over the rounds of a loop many tables that are each small enough add up there.
    With ``lie``, rows that are dealt by one of the columns that they are joined by stay where they lie."""
    keys = dict.fromkeys(("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), str(most))
    if lie:
        keys["spark.sql.requireAllClusterKeysForCoPartition"] = "false"
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def in_shuffles(f: Callable[..., DataFrame] | None = None, most: int = -1, lie: bool = False) -> Callable[..., DataFrame]:
    """``f`` of a table first, computed ``shuffled``; its last step may still be open, and is planned as the session has it."""
    if f is None:
        return partial(in_shuffles, most=most, lie=lie)

    @wraps(f)
    def run(df: DataFrame, *args, **named) -> DataFrame:
        with shuffled(df.sparkSession, most, lie):
            return f(df, *args, **named)

    return run


def process_of(df: DataFrame) -> DataFrame:
    """Rows with the number of the partition that holds them, and how many there are."""
    return df.withColumn("pid", F.spark_partition_id())


def process_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def sent_to_all(df: DataFrame) -> DataFrame:
    """A table for a broadcast join, if the optimiser's estimate of its size is under 64 MB; else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= LIMIT else df


def barrier(df: DataFrame) -> DataFrame:
    """All of ``df`` is computed, and written to the checkpoint folder, before anything that follows."""
    return settled(df)


def by_label(df: DataFrame, label: str, parts: int) -> DataFrame:
    """Rows placed by a partition label."""
    return df.repartition(parts, label)


@contextmanager
def timed() -> Iterator[dict[str, float]]:
    """Wall and CPU seconds of the driver in a block."""
    out: dict[str, float] = {}
    wall, cpu = time.perf_counter(), time.process_time()
    try:
        yield out
    finally:
        out["wall"], out["cpu"] = time.perf_counter() - wall, time.process_time() - cpu


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with its row count observed as it runs."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
