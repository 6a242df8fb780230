"""Snapshots of a whole model under integer commit tags, and tables of doubles keyed by commit tag."""

from __future__ import annotations

import glob
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

OK, UNKNOWN, WIDTH, DUPLICATE = 0, -1, -2, -1


class SnapshotStore:
    """Tables saved as Parquet, one folder a table, partitioned by commit tag; a tag read back is one partition."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, tables: dict[str, DataFrame], tag: int) -> None:
        """Save all tables under a tag, replacing what the tag held."""
        for name, df in tables.items():
            rows = df.withColumn("commit_tag", F.lit(tag))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit_tag").parquet(f"{self.path}/{name}")

    def restore(self, names: list[str], tag: int) -> dict[str, DataFrame]:
        """The tables as saved under a tag."""
        return {name: self.spark.read.parquet(f"{self.path}/{name}").where(F.col("commit_tag") == tag).drop("commit_tag") for name in names}

    def tags(self, name: str) -> DataFrame:
        """Tags that a table was saved under: partition values only, no data is read."""
        return self.spark.read.parquet(f"{self.path}/{name}").select("commit_tag").distinct()

    def record(self, name: str, df: DataFrame, tag: int) -> None:
        """Append one table's state at a commit."""
        df.withColumn("commit_tag", F.lit(tag)).write.mode("append").partitionBy("commit_tag").parquet(f"{self.path}/{name}")


class TableStore:
    """Named tables of doubles: created once, appended to in rows of their width. Errors are codes: -1 for a
    table that exists already, has no columns, or is unknown; -2 for a row of another width."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.columns: dict[str, list[str]] = {}

    def create(self, name: str, columns: list[str]) -> int:
        if name in self.columns or not columns:
            return DUPLICATE
        self.columns[name] = list(columns)
        schema = self.spark.createDataFrame([(name, i, c) for i, c in enumerate(columns)], "table_name string, position int, column_name string")
        schema.coalesce(1).write.mode("overwrite").json(f"{self.path}/{name}.schema")
        self._empty(name).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return OK

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(["commit_tag long", *(f"`{c}` double" for c in self.columns[name])]))

    def insert(self, name: str, rows: DataFrame | list[tuple], commit_tag: int | None = None) -> int:
        """Append rows; a DataFrame may bring its own commit_tag."""
        if name not in self.columns:
            return UNKNOWN
        columns = self.columns[name]
        if isinstance(rows, list):
            if any(len(r) != len(columns) for r in rows):
                return WIDTH
            rows = self.spark.createDataFrame([tuple(float(v) for v in r) for r in rows], ", ".join(f"`{c}` double" for c in columns))
        own = [c for c in rows.columns if c != "commit_tag"]
        if len(own) != len(columns):
            return WIDTH
        tag = F.lit(commit_tag).cast("long") if commit_tag is not None else (F.col("commit_tag").cast("long") if "commit_tag" in rows.columns else F.lit(0).cast("long"))
        rows.select(tag.alias("commit_tag"), *(F.col(o).cast("double").alias(c) for o, c in zip(own, columns, strict=True))).write.mode("append").parquet(f"{self.path}/{name}")
        return OK

    def read(self, name: str, commit_tag: int | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df if commit_tag is None else df.where(F.col("commit_tag") == commit_tag)


def with_commit_tags(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows numbered from 0 in each stream: the row counter is the commit tag."""
    return rows.withColumn("commit_tag", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def write_jdbc(df: DataFrame, url: str, table: str, run: int, **options: str) -> None:
    """Append a run's rows to a database table."""
    df.withColumn("run_id", F.lit(run)).write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def read_jdbc(spark: SparkSession, url: str, table: str, run: int, **options: str) -> DataFrame:
    """A run's rows; the filter goes to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(F.col("run_id") == run)


def in_file(path: str) -> Callable:
    """What opens the SQLite database in a file that the driver and all executors share. SQLite keeps a NaN as a null."""
    local = path.removeprefix("file:")

    def connect():
        import sqlite3

        return sqlite3.connect(local, timeout=3600)

    return connect


#: Column types of a database for those of Spark.
KINDS = {"string": "TEXT", "float": "DOUBLE PRECISION", "double": "DOUBLE PRECISION", "binary": "BLOB", "boolean": "SMALLINT", "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT"}
#: Rows that one call brings to or from a database.
FETCHED = 10000


def write_rows(df: DataFrame, connect: Callable, table: str, run: int) -> None:
    """Append a run's rows to a database table over DB-API connections (with ? marks), which ``connect`` opens anywhere.

    Every task writes its rows in one transaction, under its number as ``part``, and first takes back what an earlier
    attempt at it left, so a repeated task adds no row twice.
    """
    columns = ", ".join(f'"{c}" {KINDS[t]}' for c, t in df.dtypes)
    names = ", ".join(f'"{c}"' for c in df.columns)
    marks = ", ".join("?" * len(df.columns))
    db = connect()
    db.execute(f'CREATE TABLE IF NOT EXISTS "{table}" (run_id INTEGER, part INTEGER, {columns})')
    db.execute(f'CREATE INDEX IF NOT EXISTS "{table}_part" ON "{table}" (run_id, part)')
    db.commit()
    db.close()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, db, n = TaskContext.get().partitionId(), connect(), 0
        db.execute(f'DELETE FROM "{table}" WHERE run_id = ? AND part = ?', (run, part))
        for batch in batches:
            db.executemany(f'INSERT INTO "{table}" (run_id, part, {names}) VALUES ({run}, {part}, {marks})', zip(*(c.to_pylist() for c in batch.columns), strict=True))
            n += batch.num_rows
        db.commit()
        db.close()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    df.mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def read_rows(spark: SparkSession, connect: Callable, table: str, run: int, schema: str) -> DataFrame:
    """A run's rows with ``run_id``, as ``schema`` names and types them; run and part are selected in the database, a task for each part."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    db = connect()
    parts = db.execute(f'SELECT max(part) FROM "{table}" WHERE run_id = ?', (run,)).fetchone()[0]
    db.close()
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    names = ", ".join(f'"{c}"' for c in kinds.names)

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = connect()
        for part in (p for batch in batches for p in batch.column(0).to_pylist()):
            found = db.execute(f'SELECT {names} FROM "{table}" WHERE run_id = ? AND part = ?', (run, part))
            while rows := found.fetchmany(FETCHED):
                values = [pa.array(v).cast(t) for v, t in zip(zip(*rows, strict=True), kinds.types, strict=True)]
                yield pa.RecordBatch.from_arrays(values, schema=kinds)
        db.close()

    n = 0 if parts is None else parts + 1
    return spark.range(0, n, 1, max(1, n)).mapInArrow(get, schema).withColumn("run_id", F.lit(run))


class SnapshotSource(DataSource):
    """A Spark data source over saved snapshots: options ``path`` (of a store, on a shared file system), ``table``, ``tag``.

    Register it with ``spark.dataSource.register(SnapshotSource)`` and read with ``format("tremolite_snapshot")``.
    Every file of the tag is a partition of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "tremolite_snapshot"

    def _files(self) -> list[str]:
        folder = f"{self.options['path'].removeprefix('file:')}/{self.options['table']}/commit_tag={self.options['tag']}"
        return sorted(glob.glob(f"{folder}/*.parquet"))

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files = self._files()
        if not files:
            raise ValueError(f"nothing saved as {self.options['table']!r} under tag {self.options['tag']}")
        return from_arrow_schema(pq.read_schema(files[0]))

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self._files())


class SnapshotReader(DataSourceReader):
    """Reads the files of a snapshot in Arrow batches."""

    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition):
        import pyarrow.parquet as pq

        with pq.ParquetFile(partition.value) as f:
            yield from f.iter_batches()


STORES: dict[str, Callable] = {"File": SnapshotStore, "Table": TableStore}


def open_store(kind: str, spark: SparkSession, path: str) -> SnapshotStore | TableStore:
    """A store by its kind; others may be registered in STORES."""
    if kind not in STORES:
        raise ValueError(f"unknown store {kind!r}; known: {', '.join(STORES)}")
    return STORES[kind](spark, path)
