"""How filters of documents act on one another in every order, from sums over the edges of their lattice.

The sets of filters already applied form a lattice; applying one more filter is an edge from a set to the next. A
document counts on each of the (for five filters 80) edges as kept, removed or redundant, whatever order led to the
set, so every order (120, of 5 steps each) is a path of edges whose sums are known.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import matched, staged

#: Fixed value: white space between words, as the inside of a character class.
WHITE = r"\x20\x09-\x0D"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def word_list(text: Column) -> Column:
    """Maximal runs of characters other than white space."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda w: w != "")


def few_words(least: int = 200):
    return lambda text, words: F.size(words) < least


def few_distinct_words(percent: int = 50):
    return lambda text, words: 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def many_capitals(percent: int = 2):
    """More A-Z characters than ``percent`` of the code points."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return lambda text, words: 100 * (F.length(text) - F.length(F.translate(text, capitals, ""))) > percent * F.length(text)


def with_signs(signs: str = "[#$%&*|]"):
    return lambda text, words: text.rlike(signs)


#: What a filter looks at (the text, its words) to say that a document fails; None: the text is that of a smaller id.
FILTERS = {"A": few_words(), "B": few_distinct_words(), "C": many_capitals(), "D": with_signs(), "E": None}


def failures(docs: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id``, ``part`` (the source; null: empty) and ``fails`` (a bit for each filter, in order) of every row.

    A null text counts as empty. Texts are identical when their SHA-256 is. Of the hashes only those seen more than
    once, with their least id, are joined back; ids equal to the least don't fail, nor do null ids.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", word_list(F.col("text")))
    bit = lambda failing, i: F.when(failing, 1 << i).otherwise(0)
    own = sum((bit(f(F.col("text"), F.col("words")), i) for i, f in enumerate(filters.values()) if f), F.lit(0))
    copies = [i for i, f in enumerate(filters.values()) if f is None]
    thin = rows.select("id", "part", own.cast("int").alias("fails"), *([F.unhex(F.sha2("text", 256)).alias("h")] if copies else []))
    if not copies:
        return thin
    thin = staged(thin)
    first = thin.groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("same"), "least")
    copy = sum(bit(F.col("id") > F.col("least"), i) for i in copies)
    return thin.join(first, matched(F.col("h"), F.col("same")), "left").select("id", "part", (F.col("fails") + copy).alias("fails"))


def labelled(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """``failed`` with ``good`` and ``toxic``: whether any label of the id says 1."""
    said = labels.groupBy(F.col(id_col).alias("l_id")).agg(F.coalesce(F.bool_or(F.col(good) == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col(toxic) == 1), F.lit(False)).alias("toxic"))
    said = said.where("good or toxic")
    joined = failed.join(said, matched(F.col("id"), F.col("l_id")), "left")
    return joined.select("part", "fails", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def lattice_edges(outcomes: DataFrame, n: int) -> DataFrame:
    """Sums over all rows of ``outcomes`` (part, fails, good, toxic) for each part and edge of the lattice of ``n`` filters:
    ``applied`` (a bit for each filter applied already), ``next`` (the filter that follows), COUNTS.

    Rows alike in part, failures and labels are counted before they meet the edges, so what is multiplied by the
    number of edges is at most 2^(n + 2) rows a part.
    """
    alike = outcomes.groupBy("part", "fails", "good", "toxic").agg(F.count("*").alias("n"))
    edges = [(applied, f) for f in range(n) for applied in range(1 << n) if not applied >> f & 1]
    alike = alike.withColumn("edge", F.explode(F.array(*(F.struct(F.lit(a).alias("applied"), F.lit(f).alias("next")) for a, f in edges))))
    alike = alike.select("part", "fails", "good", "toxic", "n", "edge.*")
    failing = F.expr("fails >> next & 1 = 1")
    gone = F.expr("fails & applied <> 0")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    sums = [count(~failing & ~gone), count(failing & ~gone), count(failing & gone), count(F.expr("fails = 1 << next")), count(failing & ~gone & F.col("good")), count(failing & ~gone & F.col("toxic"))]
    return alike.groupBy("part", "applied", "next").agg(*(s.cast("long").alias(c) for s, c in zip(sums, COUNTS, strict=True)))


def lattice_paths(spark: SparkSession, names: list[str]) -> DataFrame:
    """Every order of the filters, step by step: ``filter_order``, ``step`` (from 1), ``applied`` and ``next`` of its edge."""
    rows = []
    for order in permutations(range(len(names))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each part (source; null: empty), order of the filters and step: ``kept`` after it, ``removed`` by it,
    ``redundant`` (failing its filter but removed earlier), ``unique_fails`` (failing its filter only), ``good_lost`` and
    ``toxic_lost`` (removed by it and labelled so), ``shapley`` (removed by its filter, summed over all orders).

    Texts are read once; rows equal in all columns count each. Labels repeated for an id count once, null labels
    not at all, and a null id has none. Empty table: empty result. Other columns are ignored. ``filters`` are few:
    the orders of n filters are n!.
    """
    names = list(filters)
    n = len(names)
    edges = staged(lattice_edges(labelled(failures(docs, filters, id_col, text_col, source_col), labels), n))
    before = F.bit_count("applied")
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), before + 1)
    shares = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * weight).cast("long").alias("shapley"))
    steps = F.broadcast(lattice_paths(docs.sparkSession, names))
    return edges.join(shares, ["part", "next"]).join(steps, ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")
