"""Temperature mixing of sources, realised as epochs that each permute blocks of rows, the last one cut at the budget."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import matched, staged, text_hash

ROWS_PER_BLOCK = 2048
#: Most super-blocks of a source (a power of two); only the one at the cut has its blocks ordered.
SUPER = 4096
GRID = 16


def _measures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy in nats, most repetitions if the least repeated source is taken once) of p^a / sum p^a, for each a, in one pass."""
    p = F.col("p")
    rows = shares.agg(*(x for i, a in enumerate(exponents) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"e{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"u{i}"), F.min(F.pow(p, F.lit(a - 1))).alias(f"l{i}")))).first()
    return [(math.log(rows[f"z{i}"]) - a * rows[f"e{i}"] / rows[f"z{i}"], rows[f"u{i}"] / rows[f"l{i}"]) for i, a in enumerate(exponents)]


def fitted_exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None, rounds: int = 8) -> float:
    """The exponent in [0, 1] that meets ``entropy`` or ``repetition``: the smallest (flattest) that
    repeats no source more than ``repetition`` times as often as another, or the largest whose
    entropy, as a share of the log of the number of sources, reaches ``entropy``.

    Both fall as the exponent rises, so the interval is cut again and again; every pass over the
    shares tries 16 inner points.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give one of entropy and repetition")
    n = shares.count()
    if n < 2:
        return 1.0
    lo, hi = 0.0, 1.0
    low_ok = (lambda m: m[0] >= entropy * math.log(n)) if entropy is not None else (lambda m: m[1] > repetition * (1 + 1e-9))
    ends = _measures(shares, [lo, hi])
    if low_ok(ends[1]):
        return hi
    if not low_ok(ends[0]):
        return lo
    for _ in range(rounds):
        points = [lo + (hi - lo) * (i + 1) / (GRID + 1) for i in range(GRID)]
        good = sum(1 for m in _measures(shares, points) if low_ok(m))
        lo, hi = (points[good - 1] if good else lo), (points[good] if good < GRID else hi)
    return lo if entropy is not None else hi


def temperature_mix(df: DataFrame, entropy: float | None = None, repetition: float | None = None, budget_tokens: int | None = None, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per drawn copy: id, source, n_tokens, weight, epoch (from 0), block, ``turn``, ``place``, ``text_hash``.

    A source's share is its part of all tokens (runs of characters other than white space; null
    texts have none). Weights are shares to the fitted exponent, normalised. The budget is
    ``budget_tokens``, or by default the least at which no source is taken less than once, so that
    no document is lost. A source whose part of the budget is q of its t tokens gives q div t whole
    epochs and a last one cut at the rest: rows are dealt into blocks by a hash of id and text (and
    blocks into at most 4,096 super-blocks), every epoch permutes super-blocks, the blocks in them and the
    rows in these by hashes of its own, and of the last epoch whole blocks are taken while they fit, and of the
    block at the cut the first rows that fit. ``turn`` says when a block's turn comes in its epoch and
    ``place`` when a row's comes in its block: rows sorted by epoch,
    turn, block and place are the mixture in order.

    Sources are never gathered on the driver, nor is any source in one task: sums per super-block are
    ordered, and sums per block only within the super-block at a source's cut. Null sources are one
    source. Sources without any token are taken once. Documents without tokens go with their block.
    Rows equal in id, source and text share block, turn and place, and are all drawn as often. Empty
    table: empty result. Other columns are ignored.
    """
    tokens = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"\S+")).cast("long")
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("s"), tokens.alias("t"), text_hash(F.col(text_col)).alias("h"))
    rows = staged(rows.withColumn("k", F.xxhash64(F.lit(seed), "id", "h")))
    sums = staged(rows.groupBy("s").agg(F.sum("t").alias("st"), F.count("*").alias("sn")))
    total = sums.agg(F.sum("st")).first()[0] or 0
    shares = sums.where("st > 0").select((F.col("st") / F.lit(max(1, total))).alias("p"))
    exponent = fitted_exponent(shares, entropy, repetition) if total else 1.0
    z, least = shares.agg(F.sum(F.pow("p", F.lit(exponent))), F.min(F.pow("p", F.lit(exponent - 1)))).first()
    z, least = z or 1.0, least or 1.0
    budget = budget_tokens if budget_tokens is not None else total * z / least
    weight = F.when(F.col("st") > 0, F.pow(F.col("st") / F.lit(max(1, total)), F.lit(exponent)) / F.lit(z)).otherwise(F.lit(0.0))
    plan = sums.withColumn("weight", weight).withColumn("q", F.when(F.col("st") > 0, F.round(F.col("weight") * F.lit(float(budget)))).otherwise(0).cast("long"))
    if repetition is not None and budget_tokens is None:
        plan = plan.withColumn("q", F.least("q", F.floor(F.col("st") * F.lit(float(repetition))).cast("long")))
    plan = plan.withColumn("whole", F.when(F.col("st") > 0, F.expr("q div st")).otherwise(1)).withColumn("rest", F.when(F.col("st") > 0, F.col("q") - F.col("whole") * F.col("st")).otherwise(0))
    plan = plan.withColumn("blocks", F.ceil(F.col("sn") / F.lit(ROWS_PER_BLOCK)).cast("long")).select(F.col("s").alias("ps"), "weight", "whole", "rest", "blocks")
    supers = F.least(F.col("blocks"), F.lit(SUPER))
    dealt = rows.join(plan, F.col("s").eqNullSafe(F.col("ps"))).withColumn("block", F.pmod("k", "blocks")).withColumn("super", F.pmod("block", supers))
    dealt = staged(dealt.select("id", "s", "t", "h", "k", "weight", "whole", "rest", "block", "super"))
    mixed = lambda *c: F.shiftright(F.xxhash64(F.lit(seed), *c), 32)
    major = lambda epoch: mixed(epoch, F.col("super")).bitwiseAND(F.lit(-SUPER)) + F.col("super")
    turn = lambda epoch: F.shiftleft(major(epoch), 32) + mixed(epoch, F.col("block"), F.lit(1)) + F.lit(1 << 31)
    place = lambda epoch: F.xxhash64(epoch, "k")
    last = F.col("whole")
    per = staged(dealt.groupBy("s", "super", "block").agg(F.sum("t").alias("bt"), F.first("whole").alias("whole"), F.first("rest").alias("rest")))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    great = per.groupBy("s", "super", "whole", "rest").agg(F.sum("bt").alias("gt"))
    great = great.withColumn("left", F.col("rest") - F.coalesce(F.sum("gt").over(upto("s").orderBy(major(last))), F.lit(0)))
    great = great.select(F.col("s").alias("gs"), F.col("super").alias("gg"), "gt", "left")
    per = per.join(great, F.col("s").eqNullSafe(F.col("gs")) & (F.col("super") == F.col("gg"))).drop("gs", "gg")
    at_cut = (F.col("left") > 0) & (F.col("left") < F.col("gt"))
    inner = per.where(at_cut).withColumn("room", F.col("left") - F.coalesce(F.sum("bt").over(upto("s").orderBy(turn(last), "block")), F.lit(0)))
    outer = per.where(~at_cut).withColumn("room", F.when(F.col("left") > 0, F.col("bt")).otherwise(F.lit(0)))
    per = inner.unionByName(outer).select(F.col("s").alias("bs"), F.col("block").alias("bb"), "bt", "room")
    dealt = dealt.join(per, F.col("s").eqNullSafe(F.col("bs")) & matched(F.col("block"), F.col("bb"))).drop("bs", "bb")
    cut = (F.col("room") > 0) & (F.col("room") < F.col("bt"))
    first = Window.partitionBy("s", "block").orderBy(place(last), "k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.where(cut).withColumn("extra", (F.sum("t").over(first) <= F.col("room")).cast("long"))
    outside = dealt.where(~cut).withColumn("extra", ((F.col("room") > 0) & (F.col("rest") > 0)).cast("long"))
    drawn = inside.unionByName(outside).withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0")
    drawn = drawn.withColumn("epoch", F.explode(F.expr("sequence(0L, copies - 1)")))
    return drawn.select(F.col("id").alias(id_col), F.col("s").alias(source_col), F.col("t").alias("n_tokens"), "weight", "epoch", "block", turn(F.col("epoch")).alias("turn"), place(F.col("epoch")).alias("place"), F.col("h").alias("text_hash"))
