"""The entity model: keyed tables of points, connectors, constraints, loads, regions and parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .parallel import forgotten, written

#: Schemas of the tables that a model knows; others may be added.
SCHEMAS = {
    "nodes": "tag int, crds array<double>, ndf int, active boolean",
    "elements": "tag int, class_tag int, class_type string, node_tags array<int>, active boolean",
    "sp": "tag long, node_tag int, dof int, value double, pattern int",
    "mp": "tag int, retained int, constrained int, retained_dof int, constrained_dof int, coefficient double",
    "patterns": "tag int, series int, kind string",
    "node_loads": "tag int, pattern int, node_tag int, dof int, value double",
    "element_loads": "tag int, pattern int, element_tag int, class_tag int, data array<double>",
    "regions": "tag int, kind string, member int",
    "parameters": "tag int, name string, entity_kind string, entity_tag int, value double",
}


@dataclass(frozen=True)
class Model:
    """Tables by name; every change gives a new model. Tags are unique in a table."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    time: float = 0.0
    constant_loads: bool = False
    meta: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A full scan; empty if nothing was added."""
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], SCHEMAS[name])

    def _with(self, name: str, df: DataFrame) -> Model:
        return replace(self, tables={**self.tables, name: df})

    def add(self, name: str, rows: DataFrame) -> Model:
        """Add rows whose tag is new; a row with a tag that the table has is refused and the old one stays."""
        old = self.table(name)
        w = Window.partitionBy("tag").orderBy(*([c for c in rows.columns if c != "tag"] or ["tag"]))
        once = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        return self._with(name, old.unionByName(once.join(old, "tag", "left_anti"), allowMissingColumns=True))

    def refused(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that ``add`` would refuse for a tag already there."""
        return rows.join(self.table(name), "tag", "left_semi")

    def remove(self, name: str, tags: list[int] | DataFrame) -> Model:
        """Remove by tag."""
        df = self.table(name)
        return self._with(name, df.join(tags, "tag", "left_anti") if isinstance(tags, DataFrame) else df.where(~F.col("tag").isin(tags)))

    def remove_constraints(self, constrained: int | None = None, node: int | None = None, dof: int | None = None, pattern: int | None = None) -> Model:
        """Remove multi-point constraints of a constrained node, or single-point ones of a node, dof and pattern."""
        model = self
        if constrained is not None:
            model = model._with("mp", model.table("mp").where(F.col("constrained") != constrained))
        if node is not None:
            hit = F.col("node_tag") == node
            for c, v in (("dof", dof), ("pattern", pattern)):
                hit &= F.lit(True) if v is None else F.col(c).eqNullSafe(F.lit(v))
            model = model._with("sp", model.table("sp").where(~hit))
        return model

    def get(self, name: str, tag: int) -> DataFrame:
        """Point lookup."""
        return self.table(name).where(F.col("tag") == tag)

    def counts(self) -> dict[str, int]:
        return {name: df.count() for name, df in self.tables.items()}

    def bounds(self) -> DataFrame:
        """Least and largest coordinate in each direction."""
        return self.table("nodes").select(F.posexplode("crds").alias("axis", "x")).groupBy("axis").agg(F.min("x").alias("low"), F.max("x").alias("high"))

    def activate(self, tags: list[int], on: bool = True) -> Model:
        """Switch elements on or off."""
        return self._with("elements", self.table("elements").withColumn("active", F.when(F.col("tag").isin(tags), F.lit(on)).otherwise(F.col("active"))))

    def at(self, time: float) -> Model:
        return replace(self, time=time)

    def with_constant_loads(self, time: float | None = None) -> Model:
        """Hold the loads as they are; optionally set the time."""
        return replace(self, constant_loads=True, time=self.time if time is None else time)

    def fix(self, dofs: list[int], tags: list[int] | None = None, axis: int | None = None, at: float = 0.0, tol: float = 1e-10) -> Model:
        """Fix the dofs (1-based) flagged 1, of nodes by tag, or of all whose coordinate on an axis is within tol of ``at``."""
        nodes = self.table("nodes")
        nodes = nodes.where(F.col("tag").isin(tags)) if tags is not None else nodes.where(F.abs(F.get("crds", F.lit(axis)) - at) <= tol)
        flagged = [i for i, flag in enumerate(dofs, 1) if flag]
        rows = nodes.select(F.col("tag").alias("node_tag"), F.explode(F.array(*(F.lit(i) for i in flagged))).alias("dof"))
        rows = rows.join(self.table("sp").select("node_tag", "dof"), ["node_tag", "dof"], "left_anti")
        top = self.table("sp").agg(F.coalesce(F.max("tag"), F.lit(0)).alias("__top"))
        # a tag made of node and dof is unique without numbering all rows in one place
        rows = rows.join(F.broadcast(top)).select((F.col("__top") + F.col("node_tag").cast("long") * 100 + F.col("dof")).alias("tag"), "node_tag", "dof", F.lit(0.0).alias("value"), F.lit(None).cast("int").alias("pattern"))
        return self._with("sp", self.table("sp").unionByName(rows))

    def set_parameter(self, value: float, elements: list[int] | None = None, low: int | None = None, high: int | None = None) -> Model:
        """Set a value for parameters of the listed elements, or of an inclusive range of them."""
        tag = F.col("entity_tag")
        hit = tag.isin(elements) if elements is not None else within(tag, low, high)
        hit &= F.col("entity_kind") == "element"
        return self._with("parameters", self.table("parameters").withColumn("value", F.when(hit, F.lit(value)).otherwise(F.col("value"))))

    def create_parameter(self, tag: int, kind: str, entities: list[int], value: float = 0.0, name: str = "") -> Model:
        """A new parameter with its components: one row for each entity it acts on. A tag that is taken is refused."""
        if not self.get("parameters", tag).isEmpty():
            raise ValueError(f"parameter {tag} exists")
        return self.add_to_parameter(tag, kind, entities, value, name)

    def add_to_parameter(self, tag: int, kind: str, entities: list[int], value: float | None = None, name: str = "") -> Model:
        """More components of a parameter; ``kind`` is element, node (its displacement) or pattern (its load factor)."""
        if kind not in ("element", "node", "pattern"):
            raise ValueError(f"unknown kind {kind!r}")
        if value is None:
            value = self.get("parameters", tag).agg(F.max("value")).first()[0] or 0.0
        rows = self.spark.createDataFrame([(tag, name, kind, e, float(value)) for e in entities], SCHEMAS["parameters"])
        return self._with("parameters", self.table("parameters").unionByName(rows, allowMissingColumns=True))

    def parameter_tags(self) -> DataFrame:
        """Tags in use."""
        return self.table("parameters").select("tag").distinct()

    def node_values(self, what: str, facts: DataFrame | None = None, tags: DataFrame | None = None) -> DataFrame:
        """(tag, position, value) of nodes: coordinates, number of dofs, or a recorded response from ``facts``
        (entity_tag, dof, response, value)."""
        if what in ("coord", "ndf"):
            nodes = self.table("nodes")
            out = nodes.select("tag", F.posexplode("crds").alias("position", "value")) if what == "coord" else nodes.select("tag", F.lit(0).alias("position"), F.col("ndf").cast("double").alias("value"))
        else:
            out = facts.where(F.col("response") == what).select(F.col("entity_tag").alias("tag"), F.col("dof").alias("position"), "value")
        return out if tags is None else out.join(tags.select("tag").distinct(), "tag", "left_semi")

    def update_parameter(self, tag: int, value: float) -> Model:
        return self._with("parameters", self.table("parameters").withColumn("value", F.when(F.col("tag") == tag, F.lit(value)).otherwise(F.col("value"))))


def within(tag: Column, a: int, b: int) -> Column:
    """In an inclusive range whose bounds may come reversed."""
    return tag.between(min(a, b), max(a, b))


def element_nodes(elements: DataFrame, tag: str = "tag", nodes: str = "node_tags") -> DataFrame:
    """(element, position, node) for every end of every element."""
    return elements.select(F.col(tag).alias("element_tag"), F.posexplode(nodes).alias("position", "node_tag"))


def element_classes(elements: DataFrame) -> DataFrame:
    """Number of elements of each class."""
    return elements.groupBy("class_tag", "class_type").count()


def responses_of(responses: DataFrame, tag: int, response: str, entity: str = "entity_tag") -> DataFrame:
    """Recorded responses of one entity."""
    return responses.where((F.col(entity) == tag) & (F.col("response") == response))


def section_values(facts: DataFrame, element: int | None, section: int | None, response: str) -> DataFrame:
    """Recorded responses of element sections (element_tag, section, response, position, value); None means all."""
    hit = F.col("response") == response
    for column, wanted in (("element_tag", element), ("section", section)):
        hit &= F.lit(True) if wanted is None else F.col(column) == wanted
    return facts.where(hit)


def region_nodes(links: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes that the elements of a region touch. ``links`` has (element_tag, node_tag)."""
    return links.join(elements.select("element_tag").distinct(), "element_tag", "left_semi").select("node_tag").distinct()


def region_elements(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Elements all of whose nodes are in a region: its nodes are counted on both sides, by partial sums."""
    marked = links.join(nodes.select("node_tag").distinct().withColumn("__in", F.lit(1)), "node_tag", "left")
    counts = marked.groupBy("element_tag").agg(F.count("*").alias("__n"), F.count("__in").alias("__m"))
    return counts.where("__n = __m").select("element_tag")


def region(links: DataFrame, elements: list[int] | None = None, nodes: list[int] | None = None, element_range: tuple[int, int] | None = None, node_range: tuple[int, int] | None = None, only: bool = False) -> DataFrame:
    """(kind, member) of a region given by elements or nodes, as lists or inclusive ranges.

    Unless ``only``, elements bring their nodes, and nodes bring the elements that lie in them wholly. With
    both elements and nodes (and not ``only``) the nodes are ignored.
    """
    pick = lambda c, listed, span: F.col(c).isin(listed) if listed is not None else within(F.col(c), *span)
    by_element = elements is not None or element_range is not None
    by_node = nodes is not None or node_range is not None
    parts = []
    if by_element:
        chosen = links.where(pick("element_tag", elements, element_range)).select("element_tag").distinct()
        parts.append(chosen.select(F.lit("element").alias("kind"), F.col("element_tag").alias("member")))
        if not only:
            parts.append(region_nodes(links, chosen).select(F.lit("node").alias("kind"), F.col("node_tag").alias("member")))
    if by_node and (only or not by_element):
        chosen = links.where(pick("node_tag", nodes, node_range)).select("node_tag").distinct()
        parts.append(chosen.select(F.lit("node").alias("kind"), F.col("node_tag").alias("member")))
        if not only:
            parts.append(region_elements(links, chosen).select(F.lit("element").alias("kind"), F.col("element_tag").alias("member")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def constrained(table: DataFrame, node: str, dof: str | None = None, of: int | None = None) -> DataFrame:
    """Distinct constrained (or retained, or fixed) nodes, or dofs of one node."""
    rows = table if of is None else table.where(F.col(node) == of)
    return rows.select(*[c for c in (node, dof) if c]).distinct()


def tied_values(mp: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Values of constrained dofs: the sum of coefficient times retained value. ``values`` has (by, node_tag, dof, value)."""
    retained = values.withColumnsRenamed({"node_tag": "retained", "dof": "retained_dof"})
    rows = mp.drop("tag").join(retained, ["retained", "retained_dof"])
    return rows.groupBy(*by, "constrained", "constrained_dof").agg(F.sum(F.col("coefficient") * F.col("value")).alias("value"))


def resolved(ties: DataFrame) -> DataFrame:
    """Linear relations (constrained, constrained_dof, retained, retained_dof, coefficient) with every retained dof that is
    itself constrained replaced by what it is tied to, to the end of every chain, and terms of equal dofs summed.

    Each round puts the relations as they stand into themselves, so chains shorten by half: as many rounds as the
    logarithm of the longest one. A term is known to be ``inner`` (its retained dof is constrained) from the relation that
    brings it. What is inner after n rounds stands for paths of 2^n steps; relations that have such terms when that is
    more than there are constrained dofs lie on or behind a cycle: their rows, with ``open`` true, are those given, and the
    others have ``open`` false. A null coefficient counts as 0, and relations that name no dof as none.
    """
    key = lambda a: [f"{a}", f"{a}_dof"]
    named = "constrained is not null and constrained_dof is not null and retained is not null and retained_dof is not null"
    given = ties.where(named).select(*key("constrained"), *key("retained"), F.coalesce(F.col("coefficient").cast("double"), F.lit(0.0)).alias("coefficient"))
    total = lambda t, *more: t.groupBy(*key("constrained"), *key("retained"), *more).agg(F.sum("coefficient").alias("coefficient"))
    given = written(total(given))
    bound = given.select(F.col("constrained").alias("retained"), F.col("constrained_dof").alias("retained_dof")).distinct()
    rows = written(given.join(bound.withColumn("__inner", F.lit(True)), key("retained"), "left").select(*given.columns, F.coalesce("__inner", F.lit(False)).alias("inner")))
    length, longest = 1, bound.count()
    while going := not rows.where("inner").isEmpty():
        if length > longest:
            break
        terms = rows.select(F.col("constrained").alias("retained"), F.col("constrained_dof").alias("retained_dof"), F.col("retained").alias("next"), F.col("retained_dof").alias("next_dof"), F.col("coefficient").alias("c"), F.col("inner").alias("more"))
        put = rows.where("inner").drop("inner").join(terms, key("retained")).select(*key("constrained"), F.col("next").alias("retained"), F.col("next_dof").alias("retained_dof"), (F.col("coefficient") * F.col("c")).alias("coefficient"), F.col("more").alias("inner"))
        before, rows = rows, written(total(rows.where("not inner").unionByName(put), "inner"))
        forgotten(before)
        length *= 2
    ended = rows.drop("inner").withColumn("open", F.lit(False))
    if not going:
        return ended
    stuck = written(rows.where("inner").select(*key("constrained")).distinct())
    left = given.join(stuck, key("constrained"), "left_semi")
    return ended.join(stuck, key("constrained"), "left_anti").unionByName(left.withColumn("open", F.lit(True)))


def rigid_links(nodes: DataFrame, retained: int, constrained_nodes: list[int], plane: tuple[int, int] = (0, 1), kind: str = "diaphragm") -> DataFrame:
    """Relations of rigid links in a plane: translations follow the retained node's, plus its rotation (dof 3 of a
    plane, counted from 1) times the distance; a ``rod`` ties translations alone, a ``beam`` the rotation too."""
    a, b = plane
    at = lambda i: F.get("crds", F.lit(i))
    base = nodes.where(F.col("tag") == retained).select(at(a).alias("__xa"), at(b).alias("__xb"))
    rows = nodes.where(F.col("tag").isin(constrained_nodes)).join(F.broadcast(base))
    da, db = at(a) - F.col("__xa"), at(b) - F.col("__xb")
    term = lambda c, r, k: F.struct(F.lit(c).alias("constrained_dof"), F.lit(r).alias("retained_dof"), k.cast("double").alias("coefficient"))
    terms = [term(a + 1, a + 1, F.lit(1.0)), term(b + 1, b + 1, F.lit(1.0))]
    if kind != "rod":
        terms += [term(a + 1, 3, -db), term(b + 1, 3, da)]
    if kind == "beam":
        terms.append(term(3, 3, F.lit(1.0)))
    return rows.select(F.lit(retained).alias("retained"), F.col("tag").alias("constrained"), F.explode(F.array(*terms)).alias("x")).select("retained", "constrained", "x.*")


def pressure_values(pressure: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pressure of each node that has one."""
    return nodes.join(pressure, "tag").select("tag", "pressure")


def block2d(spark: SparkSession, nx: int, ny: int, corners: list[tuple[float, float]], first_node: int = 1, first_element: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and four-sided elements of an nx by ny block with the given corners, counter-clockwise, mapped bilinearly."""
    grid = spark.range((nx + 1) * (ny + 1)).select("id", (F.col("id") % (nx + 1)).alias("i"), F.expr(f"id div {nx + 1}").alias("j"))
    r, s = 2 * F.col("i") / nx - 1, 2 * F.col("j") / ny - 1
    shape = [(1 - r) * (1 - s) / 4, (1 + r) * (1 - s) / 4, (1 + r) * (1 + s) / 4, (1 - r) * (1 + s) / 4]
    crds = F.array(*(sum((w * c[k] for w, c in zip(shape, corners, strict=True)), F.lit(0.0)) for k in range(2)))
    nodes = grid.select((F.col("id") + first_node).cast("int").alias("tag"), crds.alias("crds"))
    cells = spark.range(nx * ny).select("id", (F.col("id") % nx).alias("i"), F.expr(f"id div {nx}").alias("j"))
    at = lambda di, dj: ((F.col("j") + dj) * (nx + 1) + F.col("i") + di + first_node).cast("int")
    return nodes, cells.select((F.col("id") + first_element).cast("int").alias("tag"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("node_tags"))


def block3d(spark: SparkSession, nx: int, ny: int, nz: int, corners: list[tuple[float, float, float]], first_node: int = 1, first_element: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes and eight-node elements of a block with eight corners: the lower four counter-clockwise, then the upper."""
    mx, my = nx + 1, ny + 1
    split = lambda d, a, b: d.select("id", (F.col("id") % a).alias("i"), (F.expr(f"id div {a}") % b).alias("j"), F.expr(f"id div {a * b}").alias("k"))
    grid = split(spark.range(mx * my * (nz + 1)), mx, my)
    r, s, t = (F.col(c) / n for c, n in (("i", nx), ("j", ny), ("k", nz)))
    flat = lambda u: [(1 - r) * (1 - s) * u, r * (1 - s) * u, r * s * u, (1 - r) * s * u]
    shape = flat(1 - t) + flat(t)
    crds = F.array(*(sum((w * c[k] for w, c in zip(shape, corners, strict=True)), F.lit(0.0)) for k in range(3)))
    nodes = grid.select((F.col("id") + first_node).cast("int").alias("tag"), crds.alias("crds"))
    at = lambda di, dj, dk: ((F.col("k") + dk) * (mx * my) + (F.col("j") + dj) * mx + F.col("i") + di + first_node).cast("int")
    ring = lambda dk: [at(0, 0, dk), at(1, 0, dk), at(1, 1, dk), at(0, 1, dk)]
    cells = split(spark.range(nx * ny * nz), nx, ny)
    return nodes, cells.select((F.col("id") + first_element).cast("int").alias("tag"), F.array(*ring(0), *ring(1)).alias("node_tags"))
