"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept vector per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import matched, staged

#: Most vectors on which the cells are fitted, and most cells: both bound what the driver holds and broadcasts.
SAMPLE = 20_000
CELLS = 2048
PER_CELL = 400
#: Most cells that a vector is compared in, on average over the sample.
VISITS = 6
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centres of the unit vectors x by Lloyd's rounds on cosines; empty cells keep their centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return np.unique(centres, axis=0)


def walls(centres: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Distances of the home centres from all centres, never too small by rounding."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (centres[home] @ centres.T))) + 1e-6


def visited(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Every unit vector's home cell, and which cells it is compared in: those that may be home to a vector within ``reach`` (a chord)."""
    near = x @ centres.T
    home = near.argmax(1)
    return home, near[np.arange(len(x)), home][:, None] - near <= reach * walls(centres, home) + 1e-9


def fitted_cells(x: np.ndarray, total: int, reach: float) -> np.ndarray:
    """Centres for ``total`` vectors like the sample x: as many as PER_CELL asks for, halved until a vector visits
    VISITS cells at most on average. Where walls are near everywhere, more cells would only mean more copies."""
    k = max(1, min(CELLS, math.ceil(total / PER_CELL)))
    while True:
        centres = spherical_kmeans(x, k)
        some = [visited(x[i : i + 256], centres, reach)[1].sum() for i in range(0, min(len(x), 2048), 256)]
        if len(centres) == 1 or sum(some) <= VISITS * min(len(x), 2048):
            return centres
        k = len(centres) // 2


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one: finite, not zero, of this width."""
    column = column.cast(pa.large_list(pa.float64()))
    good = pc.equal(pc.fill_null(pc.list_value_length(column), -1), width).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(column.filter(pa.array(good)))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if width else np.zeros((int(good.sum()), 0))
    scale = np.abs(x).max(1, initial=0)
    with np.errstate(all="ignore"):
        y = x / scale[:, None]
        y /= np.sqrt((y * y).sum(1))[:, None]
    ok = np.isfinite(scale) & (scale > 0) & np.isfinite(y).all(1)
    good[np.flatnonzero(good)[~ok]] = False
    return y[ok], good


def _placed(centres: np.ndarray, width: int, reach: float):
    """Every vector once for each cell that it is compared in, ``home`` in one of them. Vectors of another
    length than the cells' are all in one cell, apart by their labels."""
    names = ["node", "label", "w", "cell", "home", "unit"]

    def out(batch: pa.RecordBatch, rows: np.ndarray, cell: np.ndarray, home: np.ndarray, unit: list[bytes]) -> pa.RecordBatch:
        pick = pa.array(rows)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pick) for c in range(3)), pa.array(cell, pa.int32()), pa.array(home), pa.array(unit, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, good = _unit(batch.column(3), width)
            at = np.flatnonzero(good)
            for i in range(0, len(y), 1024):
                part, rows = np.ascontiguousarray(y[i : i + 1024]), at[i : i + 1024]
                home, near = visited(part, centres, reach)
                row, cell = np.nonzero(near)
                yield out(batch, rows[row], cell, home[row] == cell, [part[r].tobytes() for r in row.tolist()])
            for other in pc.unique(pc.list_value_length(batch.column(3))).to_pylist():
                if other and other != width:
                    y, good = _unit(batch.column(3), other)
                    yield out(batch, np.flatnonzero(good), np.zeros(len(y)), np.ones(len(y), bool), [v.tobytes() for v in y])

    return run


def _products(cosine: float):
    """Counts and links of every block pair: rows against the home rows of a cell. A row counts for as many as it weighs."""
    names = ["label", "cell", "rows", "homes", "id", "w", "as_row", "as_home", "unit"]

    def links(group: dict) -> pa.RecordBatch:
        ids, as_row, as_home = np.array(group["id"], np.int64), np.array(group["as_row"]), np.array(group["as_home"])
        unit = np.frombuffer(b"".join(group["unit"]), np.float64).reshape(len(ids), -1)
        row, home = np.flatnonzero(as_row), np.flatnonzero(as_home)
        weight = np.array(group["w"], np.int64)[home]
        counts = np.zeros(len(row), np.int64)
        parent = np.arange(len(ids))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        a, b = [], []
        for i in range(0, len(row), 256):
            part = row[i : i + 256]
            near = unit[part] @ unit[home].T >= cosine
            near &= ids[part][:, None] != ids[home][None]
            counts[i : i + 256] = near @ weight
            for r in np.flatnonzero(near.any(1)).tolist():
                mine = find(part[r])
                for other in np.unique(parent[home[near[r]]]).tolist():
                    other = find(other)
                    if other != mine:
                        parent[other] = mine
                        a.append(int(ids[part[r]]))
                        b.append(int(ids[other]))
        some = np.flatnonzero(counts)
        zero = np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[row[some]], np.array(a, np.int64)])), pa.array(np.concatenate([np.full(len(some), -1), np.array(b, np.int64)])), pa.array(np.concatenate([counts[some], zero]))], ["id", "other", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key = {c: [] for c in names[4:]}, None
        for batch in batches:
            plain = {c: x.to_pylist() for c, x in zip(names, batch.columns, strict=True)}
            keys = list(zip(*(plain[c] for c in names[:4]), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j and keys[i] != key:
                    if len(group["id"]) > 1:
                        yield links(group)
                    group, key = {c: [] for c in names[4:]}, keys[i]
                for c in names[4:]:
                    group[c] += plain[c][i:j]
        if len(group["id"]) > 1:
            yield links(group)

    return run


def embedding_near_duplicates(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept`` (id = component_id).

    Vectors are linked when their labels are equal and their cosine, in double precision, is at least
    ``cosine``. Equal vectors of a label are one class, of which one is compared and counts for all ids.
    Spherical k-means, fitted on at most 20,000 vectors (those of the least hashes), gives at most 2,048
    cells, and fewer if vectors would lie near the walls of too many. A vector is compared in its home cell
    and in every cell whose wall lies within the chord that ``cosine`` allows, so no pair is lost to a wall:
    the bound is exact and the fit of the cells only affects speed. In a cell, blocks of at most 1,024 rows
    meet blocks of at most 1,024 home rows, each pair of blocks in a task of its own; a block pair returns
    counts and a spanning set of links, never all pairs. Components are then found on those links.

    The cells are of the commonest length; the vectors of a label and another length are all compared
    with one another, block by block. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, as do rows whose label is null: n_links 0, kept. Rows that repeat an id,
    label and vector count as one vector and get equal rows; an id with different vectors stands for
    different vectors, each row with the links of its own. Ids are integers; a null id links with
    nothing, and its component is null. Empty table: empty result. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.expr("id is not null and label is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)")
    rows = staged(rows.withColumns({"usable": F.coalesce(usable, F.lit(False)), "d1": F.xxhash64("label", "vector"), "d2": F.xxhash64(F.lit(1), "label", "vector"), "row": F.monotonically_increasing_id()}))
    ids = rows.where("usable").groupBy("d1", "d2", "id").agg(F.min("row").alias("row"))
    classes = staged(ids.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("id").alias("leader"), F.count("*").alias("w")).withColumnsRenamed({"d1": "c1", "d2": "c2"}))
    out = rows.select("row", "id", F.when(F.col("usable"), F.col("d1")).alias("d1"), "d2").join(classes, matched(F.col("d1"), F.col("c1")) & (F.col("d2") == F.col("c2")), "left").select("row", "id", "node", "leader", "w")
    first = rows.join(classes.select("node", "w"), matched(F.col("row"), F.col("node"))).select("node", "label", "w", "vector", "d1")
    widths = first.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return _result(out.withColumns({"n": F.lit(0), "least": F.lit(None).cast("long")}), id_col)
    width, total = widths
    sample = first.where(F.size("vector") == width).orderBy("d1").limit(SAMPLE).select("vector").toArrow()
    y, _ = _unit(sample.column(0).combine_chunks(), width)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    centres = fitted_cells(y, total, reach)
    placed = first.select("node", F.concat_ws(":", F.size("vector"), "label").alias("label"), "w", "vector").mapInArrow(_placed(centres, width, reach), "node long, label string, w long, cell int, home boolean, unit binary")
    placed = staged(placed)

    cells = placed.groupBy("label", "cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("m")).where("m > 0").withColumnsRenamed({"label": "cl", "cell": "cc"})
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    both = placed.join(cells, (F.col("label") == F.col("cl")) & matched(F.col("cell"), F.col("cc"))).withColumn("row_block", F.pmod(F.xxhash64("node"), blocks("n")).cast("int")).withColumn("home_block", F.pmod(F.xxhash64("node", F.lit(1)), blocks("m")).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    flags = lambda a, b: (F.lit(a).alias("as_row"), F.lit(b).alias("as_home"))
    as_row = both.select("label", "cell", F.col("row_block").alias("rows"), F.explode(upto("m")).alias("homes"), "node", "w", *flags(True, False), "unit")
    as_home = both.where("home").select("label", "cell", F.explode(upto("n")).alias("rows"), F.col("home_block").alias("homes"), "node", "w", *flags(False, True), "unit")
    by = ["label", "cell", "rows", "homes"]
    met = as_row.unionByName(as_home).repartition(*by).sortWithinPartitions(*by)
    made = staged(met.mapInArrow(_products(cosine), "id long, other long, n long"))
    counts = made.where("other = -1").groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "n_node")
    linked = components(made.where("other <> -1"), "id", "other").withColumnsRenamed({"node": "f_node", "component": "f_group"})
    linked = staged(linked.join(classes.select("node", "leader"), F.col("f_node") == F.col("node")).select("f_node", "f_group", "leader"))
    leaders = linked.groupBy("f_group").agg(F.min("leader").alias("least")).withColumnRenamed("f_group", "l_group")
    linked = linked.join(leaders, matched(F.col("f_group"), F.col("l_group"))).select("f_node", "least")
    out = out.join(counts, matched(F.col("node"), F.col("n_node")), "left").join(linked, matched(F.col("node"), F.col("f_node")), "left")
    return _result(out, id_col)


def _result(df: DataFrame, id_col: str) -> DataFrame:
    component = F.coalesce("least", "leader", "id").cast("long")
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))
    return df.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
