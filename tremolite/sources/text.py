"""Text records and streams: delimited output, described data, acceleration records, catalogues, mesh exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERWRITE, APPEND = "overwrite", "append"


def formatted(value: Column, precision: int = 6, scientific: bool = False) -> Column:
    """A number as text, fixed or scientific."""
    return F.format_string(f"%.{precision}{'e' if scientific else 'f'}", value.cast("double"))


def write_text(df: DataFrame, path: str, csv: bool = False, precision: int = 6, scientific: bool = False, mode: str = OVERWRITE, order: list[str] | None = None) -> None:
    """Rows as delimited text, numbers formatted; ``order`` picks and orders the columns."""
    numbers = {"double", "float"}
    rows = df.select(*(order or df.columns))
    rows.select(*(formatted(F.col(c), precision, scientific).alias(c) if t in numbers else F.col(c) for c, t in rows.dtypes)).write.mode(mode).option("sep", "," if csv else " ").csv(path)


def read_text(spark: SparkSession, path: str, schema: str, csv: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", "," if csv else " ").csv(path)


def write_described(df: DataFrame, path: str, mode: str = OVERWRITE) -> None:
    """Rows as XML records with their column names."""
    df.write.mode(mode).option("rootTag", "Output").option("rowTag", "Data").format("xml").save(path)


def read_described(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "Data").schema(schema).load(path)


def write_binary(df: DataFrame, path: str, mode: str = OVERWRITE) -> None:
    df.write.mode(mode).parquet(path)


def binary_to_text(spark: SparkSession, source: str, target: str) -> None:
    spark.read.parquet(source).write.mode(OVERWRITE).option("sep", "\t").csv(target)


def text_to_binary(spark: SparkSession, source: str, target: str, schema: str) -> None:
    spark.read.schema(schema).option("sep", "\t").csv(source).write.mode(OVERWRITE).parquet(target)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files, each file read whole by one task: lines of a file have an order."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


#: Ends a record in a bundle: the record separator of ASCII, which no line of a record may hold.
RECORD_END = "\x1e"


def write_records(records: DataFrame, path: str, name: str = "file", value: str = "value") -> None:
    """Whole records as text, many to a file, each after a line with its name: there are as many files as tasks, not as many
    as records, whose making and listing would be most of the work. Names of several lines and records that hold
    RECORD_END fail."""
    named, body = F.col(name).cast("string"), F.coalesce(F.col(value).cast("string"), F.lit(""))
    whole = F.concat(named, F.lit("\n"), body)
    bad = named.isNull() | named.contains("\n") | whole.contains(RECORD_END)
    records.select(F.when(bad, F.raise_error(F.concat(F.lit("not a record for a bundle: "), F.coalesce(named, F.lit("no name"))))).otherwise(whole).alias("value")).write.option("lineSep", RECORD_END).text(path)


def bundled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the records that ``write_records`` wrote, as ``numbered_lines`` gives them of files of their own."""
    whole = spark.read.option("lineSep", RECORD_END).text(path)
    cut = F.instr("value", "\n")
    return whole.select(F.substr("value", F.lit(1), cut - 1).alias("file"), F.posexplode(F.split(F.substr("value", cut + 1), r"\r?\n")).alias("line", "text"))


def strip_data(lines: DataFrame, file: str = "file", line: str = "line", text: str = "text") -> DataFrame:
    """Lines between <Data> and </Data>, by a running flag in each file."""
    w = Window.partitionBy(file).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum(F.col(text).contains("<Data>").cast("int")).over(w)
    closed = F.sum(F.col(text).contains("</Data>").cast("int")).over(w)
    return lines.withColumn("__in", opened > closed).where(F.col("__in") & ~F.col(text).contains("<Data>")).drop("__in")


#: Fixed formats: number of points and step on a record's last header line, in its two styles.
STYLES = (r"NPTS\s*=\s*([0-9]+)\s*,\s*DT\s*=\s*([0-9.Ee+-]+)", r"^\s*([0-9]+)\s+([0-9.Ee+-]+)\s+NPTS,\s*DT")


def read_record(lines: DataFrame, file: str = "file", line: str = "line", text: str = "text") -> DataFrame:
    """(file, i, dt, t, v) of acceleration records: the header line with number of points and step, then all numbers."""
    t = F.upper(text)
    heads = lines.select(file, line, *(F.regexp_extract(t, p, g).alias(f"__{n}{g}") for n, p in enumerate(STYLES) for g in (1, 2)))
    dt = F.when(F.col("__02") != "", F.col("__02")).when(F.col("__12") != "", F.col("__12"))
    found = heads.withColumn("__dt", dt.cast("double")).where("__dt is not null").groupBy(file).agg(F.max(line).alias("__head"), F.max_by("__dt", line).alias("dt"))
    body = lines.join(found, file).where(F.col(line) > F.col("__head"))
    numbers = body.select(file, line, "dt", F.posexplode(F.split(F.trim(text), r"\s+")).alias("__p", "__v")).where("__v <> ''")
    i = F.row_number().over(Window.partitionBy(file).orderBy(line, "__p")) - 1
    return numbers.withColumn("i", i).select(file, "i", "dt", (F.col("i") * F.col("dt")).alias("t"), F.col("__v").try_cast("double").alias("v"))


def search_catalogue(catalogue: DataFrame, **bounds: tuple[float | None, float | None]) -> DataFrame:
    """Records whose magnitude, distance, velocity, peak or place lie in inclusive bounds; None is open."""
    hit = F.lit(True)
    for column, (low, high) in bounds.items():
        if low is not None:
            hit &= F.col(column) >= low
        if high is not None:
            hit &= F.col(column) <= high
    return catalogue.where(hit)


def solver_timings(timings: DataFrame) -> DataFrame:
    """Usable rows of a solver benchmark (solver, num_equations, time_seconds, status): completed, with a size and a time."""
    return timings.where((F.col("status") != -999) & (F.col("num_equations") > 0) & F.col("time_seconds").isNotNull()).orderBy("solver", "num_equations")


def write_vtk(nodes: DataFrame, elements: DataFrame, path: str) -> None:
    """Points and cells as tables of legacy VTK lines, numbered in tag order; a reader concatenates the three parts."""
    c = lambda i: F.coalesce(F.get("crds", F.lit(i)), F.lit(0.0)).cast("string")
    nodes.orderBy("tag").select(F.concat_ws(" ", c(0), c(1), c(2)).alias("value")).write.mode(OVERWRITE).text(f"{path}/points")
    elements.orderBy("tag").select(F.concat_ws(" ", F.size("node_tags").cast("string"), F.array_join(F.transform("node_tags", lambda n: n.cast("string")), " ")).alias("value")).write.mode(OVERWRITE).text(f"{path}/cells")
    counts = nodes.sparkSession.createDataFrame([(f"# vtk DataFile Version 3.0\nmodel\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {nodes.count()} double\nCELLS {elements.count()}",)], "value string")
    counts.coalesce(1).write.mode(OVERWRITE).text(f"{path}/header")


def write_gmsh(nodes: DataFrame, elements: DataFrame, path: str) -> None:
    """Node and element lines of a Gmsh 2 mesh."""
    c = lambda i: F.coalesce(F.get("crds", F.lit(i)), F.lit(0.0)).cast("string")
    nodes.select(F.concat_ws(" ", F.col("tag").cast("string"), c(0), c(1), c(2)).alias("value")).write.mode(OVERWRITE).text(f"{path}/nodes")
    kinds = F.element_at(F.create_map(*(F.lit(x) for pair in ((2, 1), (3, 2), (4, 3), (8, 5)) for x in pair)), F.size("node_tags"))
    elements.select(F.concat_ws(" ", F.col("tag").cast("string"), kinds.cast("string"), F.lit("0"), F.array_join(F.transform("node_tags", lambda n: n.cast("string")), " ")).alias("value")).write.mode(OVERWRITE).text(f"{path}/elements")
