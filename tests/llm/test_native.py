"""Exact dedup, sharding and mixing against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, document_rows, frame
from tremolite.llm import mixing
from tremolite.llm.exact_dedup import exact_dedup
from tremolite.llm.mixing import temperature_mix
from tremolite.llm.sharding import stratified_shards

WEAK = lambda t: F.unhex(F.substring(F.md5(t), 1, 2))  # noqa: E731  so few bits that texts collide


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, keep, weak):
    rows = document_rows(random.Random(1), 300)
    got = exact_dedup(frame(spark, rows), keep=keep, **({"hashed": WEAK} if weak else {})).collect()
    same = defaultdict(list)
    for r in rows:
        same[r[1] or ""].append(r[0])
    best = max if keep == "largest" else min
    want = {r[0]: (best(same[r[1] or ""]), len(same[r[1] or ""]), r[0] == best(same[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


def test_exact_dedup_awkward(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    long = "x" * 3_000_000
    rows = [(1, long, None, None, 0), (2, long, None, None, 0), (None, "a", None, None, 0), (None, "a", None, None, 0), (3, "b", None, None, 0), (3, "b", None, None, 0), (None, "b", None, None, 0)]
    got = exact_dedup(frame(spark, rows).withColumns({"id": F.lit(9), "t": F.lit("z"), "h": F.lit(1)})).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([(1, 1, 2, True), (2, 1, 2, False), (None, None, 2, True), (None, None, 2, True), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False)])


def test_exact_dedup_same_as_sql(spark):
    from tests.oracle import SF, database, differences
    from tremolite.llm.queries import QUERIES, SQL

    for name, sql in SQL.items():
        assert differences(spark, QUERIES[name], sql, database(), SF) == []


def check_shards(rows, got, shards):
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(str(rng.random()) for _ in range(3)), "en", "s0" if i % 3 else f"s{i % 4}", 0) for i in range(1000)]
    got = stratified_shards(frame(spark, rows), 7).collect()
    check_shards(rows, got, 7)
    share = Counter(r[3] for r in rows)
    by = Counter((r.source, r.shard) for r in got)
    for s, n in share.items():
        assert all(abs(by[s, k] - n / 7) <= 2 for k in range(7))


def test_shards_keep_copies_together(spark):
    rows = [(i, f"text {i // 3}", "en", f"s{i % 4}", 0) for i in range(900)]
    got = stratified_shards(frame(spark, rows), 6).collect()
    check_shards(rows, got, 6)
    text = {r[0]: r[1] for r in rows}
    places = defaultdict(set)
    for r in got:
        places[text[r.doc_id]].add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 5


def test_shards_awkward(spark):
    assert stratified_shards(frame(spark, []), 4).count() == 0
    rows = document_rows(random.Random(3), 200)
    df = frame(spark, rows).withColumns({"f": F.lit(1), "p": F.lit(1), "r": F.lit(1), "size": F.lit(1)})
    check_shards(rows, stratified_shards(df, 24).collect(), 24)
    hot = [(i, "same", None, "one", 0) for i in range(500)]
    check_shards(hot, stratified_shards(frame(spark, hot), 24).collect(), 24)
    twice = [(5, "a", None, "s", 0)] * 10 + [(None, None, None, None, 0)] * 3
    got = stratified_shards(frame(spark, twice), 3).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [4, 4, 5]


def plain_mix(rows, repetition):
    """Copies of each source and its tokens under the flattest exponent that repeats none more often."""
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[3]] += len((r[1] or "").split())
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items() if t}
    lo, hi = 0.0, 1.0
    ratio = lambda a: (min(p.values()) / max(p.values())) ** (a - 1)
    if ratio(0.0) <= repetition:
        hi = 0.0
    for _ in range(200):
        a = (lo + hi) / 2
        lo, hi = (lo, a) if ratio(a) <= repetition else (a, hi)
    z = sum(x**hi for x in p.values())
    budget = total * z / min(x ** (hi - 1) for x in p.values())
    return tokens, {s: x**hi / z for s, x in p.items()}, {s: x**hi / z * budget for s, x in p.items()}


@pytest.mark.parametrize("blocks", [4, 2048])
def test_mixing(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", blocks)
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 30))), "en", rng.choice(["a"] * 8 + ["b", "b", "c"]), 0) for i in range(800)]
    got = temperature_mix(frame(spark, rows), repetition=2.0).collect()
    tokens, weights, quota = plain_mix(rows, 2.0)
    copies = Counter(r.doc_id for r in got)
    assert set(copies) == {r[0] for r in rows} and max(copies.values()) <= 2
    drawn = Counter()
    for r in got:
        drawn[r.source] += r.n_tokens
        assert r.weight == pytest.approx(weights[r.source], rel=1e-6)
    for s, q in quota.items():
        assert q - 31 <= drawn[s] <= q + 1
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)


def test_mixing_entropy_and_budget(spark):
    rows = [(i, "a b c d", "en", "x" if i % 10 else "y", 0) for i in range(1000)]
    got = temperature_mix(frame(spark, rows), entropy=0.8, budget_tokens=2000).collect()
    n = Counter(r.source for r in got)
    share = n["y"] / (n["x"] + n["y"])
    import math

    assert -(share * math.log(share) + (1 - share) * math.log(1 - share)) == pytest.approx(0.8 * math.log(2), abs=0.01)
    assert 1990 <= 4 * len(got) <= 2000


@pytest.mark.parametrize("supers", [2, 4096])
def test_mixing_permutes_blocks(spark, monkeypatch, supers):
    """Epochs have orders of their own, blocks stay together, and the last epoch is the beginning of its whole order."""
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 16)
    monkeypatch.setattr(mixing, "SUPER", supers)
    rng = random.Random(14)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 9))), "en", "x" if i % 3 else "y", 0) for i in range(600)]
    total = sum(len(r[1].split()) for r in rows)
    order = lambda got, s, e: [(r.turn, r.block, r.place, r.doc_id, r.n_tokens) for r in sorted(got, key=lambda r: (r.turn, r.block, r.place)) if (r.source, r.epoch) == (s, e)]
    whole = temperature_mix(frame(spark, rows), entropy=0.5, budget_tokens=4 * total).collect()
    cut = temperature_mix(frame(spark, rows), entropy=0.5, budget_tokens=int(1.6 * total)).collect()
    for s in "xy":
        first, second, part = order(whole, s, 0), order(whole, s, 1), order(cut, s, 1)
        assert [r[3] for r in first] != [r[3] for r in second] and sorted(r[3] for r in first) == sorted(r[3] for r in second)
        blocks = [r[1] for r in second]
        assert len([1 for a, b in zip(blocks, blocks[1:]) if a != b]) + 1 == len(set(blocks)) > 3
        assert 0 < len(part) < len(second) and part == second[: len(part)]
        room = sum(r[4] for r in part)
        quota = round(sum(r[4] for r in first) * 1.6)
        assert sum(r[4] for r in first) + room <= quota + 1 and sum(r[4] for r in first) + room + 10 > quota - 10


def test_mixing_awkward(spark):
    assert temperature_mix(frame(spark, []), repetition=2.0).count() == 0
    none = [(i, None, None, None, 0) for i in range(5)]
    assert Counter(r.doc_id for r in temperature_mix(frame(spark, none), repetition=2.0).collect()) == Counter(range(5))
    rows = document_rows(random.Random(5), 200)
    df = frame(spark, rows).withColumns({"s": F.lit("q"), "t": F.lit(1), "block": F.lit(1)})
    assert {r.doc_id for r in temperature_mix(df, repetition=3.0).collect()} == {r[0] for r in rows}
    one = [(1, "a b", None, "s", 0)] * 4
    assert Counter(r.doc_id for r in temperature_mix(frame(spark, one, SCHEMA), repetition=2.0).collect()) == {1: 4}
