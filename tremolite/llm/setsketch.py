"""Near-duplicate documents by SetSketch registers.

Every document's set of word shingles is summarised by registers that hold exponentially spaced
truncated minima: register i is floor(1 - log_b(min of h_i)) over the set, clipped to 0..LEVELS + 1,
with h_i exponentially distributed. Registers of a union are maxima of registers, so sketches merge,
and two sets agree in a register with a probability that rises with their Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets as B
from .components import components
from .staging import matched, maybe_in, staged, text_hash

REGISTERS = 192
BASE = 1.001
LEVELS = 65534
RATE = 20.0
#: A pair whose best similarity at or above the threshold is less likely than its best one by this many nats isn't verified.
NATS = 20.0
#: Chance of missing a pair exactly at the threshold, over all bands.
MISS = 1e-5
BLOCK = 256

_SEEDS = B.mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def registers(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The registers of the sets of hashes that begin at ``starts`` in h (none empty): sets x REGISTERS."""
    least = np.empty((len(starts), REGISTERS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        least[:, i] = np.minimum.reduceat(h * seed, starts)
    uniform = (least.astype(np.float64) + 1.0) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / math.log(BASE)), 0, LEVELS + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def bands(threshold: float) -> tuple[int, int]:
    """(bands, registers in each): the longest bands that keep the chance of a miss under MISS."""
    for r in range(16, 0, -1):
        if (1 - threshold**r) ** (REGISTERS // r) <= MISS:
            return REGISTERS // r, r
    return REGISTERS, 1


def plausible(mine: np.ndarray, others: np.ndarray, n: np.ndarray | int, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the other sketches may belong to a set at ``threshold`` or more from mine (one sketch, or one for each).

    Joint estimation by likelihood: with both set sizes known, the counts of registers where mine
    is larger, smaller and equal have a multinomial law with one free parameter, the similarity.
    """
    over, under = (mine > others).sum(1), (mine < others).sum(1)
    level = REGISTERS - over - under
    u, v = n / (n + sizes), sizes / (n + sizes)
    most = np.minimum(u / v, v / u)
    j = np.concatenate([np.linspace(0, threshold, 40, endpoint=False), np.linspace(threshold, 1, 25)])
    allowed = j[None, :] <= most[:, None] + 1e-12
    j = np.minimum(j[None, :], most[:, None])
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    a, b = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    fit = sum(k[:, None] * np.log(np.maximum(q, 1e-12)) for k, q in ((over, a), (under, b), (level, 1 - a - b)))
    fit = np.where(allowed, fit, -np.inf)
    return (fit[:, 40:].max(1) >= fit.max(1) - NATS) & (most >= threshold - 1e-9)


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, at = B.text_buffers(batch.column(2))
            for i, j in B.runs(at):
                h, rows = B.shingle_sets(b[at[i] : at[j]], at[i : j + 1] - at[i], k)
                n = np.bincount(rows, minlength=j - i)
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
                one, two = np.zeros((2, j - i), np.uint64)
                sketch = [None] * (j - i)
                if len(starts):
                    have = rows[starts]
                    one[have] = np.add.reduceat(B.mixed(h), starts)
                    two[have] = np.add.reduceat(B.mixed(h ^ np.uint64(0x5DEECE66D1CE4E5B)), starts)
                    for r, x in zip(have.tolist(), registers(h, starts), strict=True):
                        sketch[r] = x.tobytes()
                out = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["id", "hash", "n", "d1", "d2", "sketch"])
                B.shrink_powers()

    return run


def _packed(column: pa.Array) -> np.ndarray:
    """Sketches of a binary column, one a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _likely(threshold: float):
    """Pairs (a, b) whose two sketches leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                na, nb = (part.column(c).to_numpy().astype(float) for c in (2, 3))
                pick = pa.array(np.flatnonzero(plausible(_packed(part.column(4)), _packed(part.column(5)), na, nb, threshold)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick)], ["a", "b"])

    return run


def _met(threshold: float):
    """Links between groups that meet in a bucket: for each block pair (strangers against members, sorted by
    key, left, right), enough of the pairs that the sketches leave possible to keep every connection."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        group = np.array([r[4] for r in rows])
        stranger = np.array([r[3] for r in rows]) == 0
        n = np.array([r[5] for r in rows], float)
        regs = np.stack([np.frombuffer(r[6], np.uint16) for r in rows])
        root = np.unique(group, return_inverse=True)[1]
        found = []
        for i in np.flatnonzero(stranger).tolist():
            others = np.flatnonzero((root != root[i]) & ~stranger)
            if len(others):
                for j in others[plausible(regs[i], regs[others], n[i], n[others], threshold)].tolist():
                    if root[i] != root[j]:
                        root[root == root[i]] = root[j]
                        found.append((int(group[i]), int(group[j])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def closed() -> pa.RecordBatch:
            pairs = links(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][:3] != row[:3]:
                    yield closed()
                    rows = []
                rows.append(row)
        yield closed()

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


class _Group:
    """The members of one block pair, and its links: enough of them to keep every connection."""

    def __init__(self, key: tuple, within: bool):
        self.key, self.within, self.ids, self.sides, self.sets, self.sketches = key, within, [], [], [], []

    def links(self, percent: int) -> list[tuple[int, int]]:
        n = np.array([len(x) for x in self.sets])
        regs = np.stack([np.frombuffer(x, np.uint16) for x in self.sketches])
        root = np.arange(len(n))
        found = []
        for i in range(1, len(n)):
            near = np.flatnonzero(plausible(regs[i], regs[:i], n[i], n[:i], percent / 100))
            if not self.within:
                near = near[np.array(self.sides)[near] != self.sides[i]]
            near = near[np.argsort(-(regs[near] == regs[i]).sum(1), kind="stable")]
            for j in near.tolist():
                if root[i] != root[j]:
                    both = _common(self.sets[i], self.sets[j])
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        root[root == root[i]] = root[j]
                        found.append((self.ids[i], self.ids[j]))
        return found


def _verified(k: int, percent: int):
    names = ["component", "left", "right", "side", "node", "sketch", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = None

        def closed(g):
            pairs = g.links(percent) if g and len(g.ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            column = dict(zip(names, batch.columns, strict=True))
            b, at = B.text_buffers(column["text"])
            plain = {c: column[c].to_pylist() for c in names[:5]}
            for i, j in B.runs(at):
                h, rows = B.shingle_sets(b[at[i] : at[j]], at[i : j + 1] - at[i], k)
                cut = np.searchsorted(rows, np.arange(j - i + 1))
                for r in range(i, j):
                    key = tuple(plain[c][r] for c in names[:3])
                    if group is None or group.key != key:
                        yield closed(group)
                        group = _Group(key, key[1] == key[2])
                    group.ids.append(plain["node"][r])
                    group.sides.append(plain["side"][r])
                    group.sets.append(h[cut[r - i] : cut[r - i + 1]].copy())
                    group.sketches.append(column["sketch"][r].as_py())
                B.shrink_powers()
        yield closed(group)

    return run


def _dealt(members: DataFrame, group: str, member: str) -> DataFrame:
    """Members with ``blocks``, the number of blocks of their group, and ``own``, the block they are in."""
    sizes = members.groupBy(group).agg(F.count("*").alias("size")).withColumnRenamed(group, "__g")
    dealt = members.join(sizes, matched(F.col(group), F.col("__g"))).drop("__g").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size")
    return dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))


def candidate_groups(leaders: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the nodes that may have a partner at ``threshold``, from (node, n, sketch).

    Nodes are banded on register values. Each meets the least node of its bucket (found by partial
    aggregation), and the sketches of both decide whether they may be linked; components of those links are
    groups. Where a bucket holds several groups, the members that aren't in the least node's group (the
    strangers, mostly there by chance) are compared with all members, block by block, so every pair that
    shares a bucket has been judged by its sketches or is in one group already. Only links that join
    groups are passed on.
    """
    count, r = bands(threshold)
    keys = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * (2 * r) + 1, F.lit(2 * r))))
    banded = leaders.select("node", F.explode(keys).alias("key"))
    least = banded.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"), "first")
    bucket = staged(banded.join(least, matched(F.col("key"), F.col("k"))).select("key", "node", "first"))
    meet = bucket.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    one = leaders.select(F.col("node").alias("x"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = leaders.select(F.col("node").alias("y"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    known = meet.join(one, matched(F.col("a"), F.col("x"))).join(two, matched(F.col("b"), F.col("y"))).select("a", "b", "na", "nb", "sa", "sb")
    group = staged(components(known.mapInArrow(B.tidied(_likely(threshold)), "a long, b long")))

    of = bucket.join(group.withColumnRenamed("node", "g_node"), matched(F.col("node"), F.col("g_node")), "left").select("key", "node", "first", F.coalesce("component", "node").alias("g"))
    own = F.max(F.when(F.col("node") == F.col("first"), F.col("g")))
    mixed = of.groupBy("key").agg(own.alias("g0"), F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("c")).where("low < high").select(F.col("key").alias("k"), "g0", "c")
    met = of.join(mixed, matched(F.col("key"), F.col("k"))).select("key", "node", "g", (F.col("g") != F.col("g0")).alias("strange"), "c")
    strangers = met.where("strange").groupBy("key").agg(F.count("*").alias("s")).withColumnRenamed("key", "k")
    met = met.join(strangers, matched(F.col("key"), F.col("k"))).drop("k").join(leaders.withColumnRenamed("node", "x"), matched(F.col("node"), F.col("x"))).drop("x")
    block = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(F.col(c) / BLOCK)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.ceil(F.col(c) / BLOCK).cast("int") - 1))
    strange = met.where("strange").select("key", block("s", 0).alias("left"), each("c").alias("right"), F.lit(0).alias("side"), "g", "n", "sketch")
    members = met.select("key", each("s").alias("left"), block("c", 1).alias("right"), F.lit(1).alias("side"), "g", "n", "sketch")
    by = ["key", "left", "right"]
    more = components(strange.unionByName(members).repartition(*by).sortWithinPartitions(*by).mapInArrow(B.tidied(_met(threshold)), "a long, b long"))
    more = staged(more).withColumnsRenamed({"node": "m_node", "component": "m_component"})
    every = group.select("node", "component").unionByName(more.join(group, F.col("m_node") == F.col("node"), "left_anti").select(F.col("m_node").alias("node"), F.col("m_node").alias("component")))
    return every.join(more, matched(F.col("component"), F.col("m_node")), "left").select("node", F.coalesce("m_component", "component").alias("component"))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id``, ``kept`` (id = component_id), ``group``, ``text_hash``.

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return, with A-Z lower-cased; a document's set has its distinct ``k``-word shingles. Two
    documents are linked if 100 * intersection >= percent * union; a component is what links reach.

    1. One pass over the texts gives each document's set size, a 128-bit digest of the set and its
       sketch. Documents with equal digests are one class, which the row with the least row number
       stands for; that number, not the id, names the class.
    2. ``candidate_groups`` bands and compares the sketches of the classes.
    3. The texts of groups are read again (a bit map keeps the others out of the shuffle) and dealt to
       tasks, one block of at most 256 texts against another, so no task holds a large group. Inside,
       pairs not connected yet that the joint likelihood leaves possible are confirmed on full sets.
    4. Components of the confirmed links, spread to all members of the classes.

    The chance that two documents exactly at the threshold share no band is under 1e-5, less above
    it. ``group`` is a number that a component's rows share; ``text_hash`` the MD5 of the text. Null and
    empty texts, and texts of white space only, have the empty set: n_shingles 0, linked with nothing.
    An id that repeats with different texts stands for different documents: each row gets the component
    of its own text. Rows that repeat an id and text share a class. A null id is never the least; a
    component without ids has a null component_id and all its rows are kept. Empty table: empty result.
    Ids are integers; other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_hash(F.col(text_col)).alias("hash"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(B.tidied(_sketches(k)), "id long, hash string, n long, d1 long, d2 long, sketch binary")
    made = staged(made.withColumn("row", F.monotonically_increasing_id()))
    known = ["n", "d1", "d2"]
    classes = made.where("n > 0").groupBy(*known).agg(F.min("row").alias("node"), F.min("id").alias("leader")).withColumnsRenamed({c: f"c_{c}" for c in known})
    same = (F.col("n") == F.col("c_n")) & matched(F.col("d1"), F.col("c_d1")) & (F.col("d2") == F.col("c_d2"))
    member = staged(made.join(classes, same, "left").select("row", "id", "hash", "n", "node", "leader", F.when(F.col("row") == F.col("node"), F.col("sketch")).alias("sketch")))
    leaders = member.where("row = node").select("node", "n", "sketch")

    candidate = staged(candidate_groups(leaders, percent / 100))
    keyed = member.where("row = node").select(F.col("node").alias("x"), F.col("id").alias("k_id"), F.col("hash").alias("k_hash"), "sketch")
    dealt = staged(_dealt(candidate, "component", "node").join(keyed, matched(F.col("node"), F.col("x"))).drop("x"))
    wanted = maybe_in(rows, dealt.select(F.col("k_hash").alias("hash")), "hash")
    texts = dealt.join(wanted, matched(F.col("k_hash"), F.col("hash")) & F.col("k_id").eqNullSafe(F.col("id")))
    texts = texts.select("component", "blocks", "own", "node", "sketch", "text").dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = texts.select("component", "own", "node", "sketch", "text", other).select("component", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), F.col("own").alias("side"), "node", "sketch", "text")
    by = ["component", "left", "right"]
    links = staged(paired.repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(B.tidied(_verified(k, percent)), "a long, b long"))

    found = components(links).withColumnsRenamed({"node": "f_node", "component": "f_group"})
    out = member.drop("sketch").join(found, matched(F.col("node"), F.col("f_node")), "left").withColumn("group", F.coalesce("f_group", "node", "row"))
    linked = out.where("f_group is not null").groupBy("f_group").agg(F.min("leader").alias("least")).withColumnRenamed("f_group", "l_group")
    out = out.join(linked, matched(F.col("f_group"), F.col("l_group")), "left")
    component = F.coalesce("least", "leader", "id")
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "group", F.col("hash").alias("text_hash"))
