"""Near-duplicate texts and vectors against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import document_rows, frame, groups, near_groups, shingle_set
from tremolite.llm import bytesets, embed_dedup, setsketch
from tremolite.llm.components import components
from tremolite.llm.embed_dedup import embedding_near_duplicates
from tremolite.llm.setsketch import near_duplicates


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80), (1, 60)])
@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(setsketch, "BLOCK", block)
    rows = document_rows(random.Random(k), 160, (1, 90))
    sizes, want = near_groups(rows, k, percent)
    got = {r.doc_id: r for r in near_duplicates(frame(spark, rows), k, percent).collect()}
    assert len(got) == len(rows)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (sizes[i], want[i], want[i] == i) for i in want}


def test_chain_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 120]), "en", "s", 0) for i in range(28)] + [(100 + i, " ".join([*words[:150], f"x{i}"]), "en", "s", 0) for i in range(40)]
    sizes, want = near_groups(rows, 3, 80)
    got = near_duplicates(frame(spark, rows), 3, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes


def test_near_awkward(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    long = " ".join(str(i) for i in range(200_000))
    rows = [(1, long, None, None, 0), (2, long + " end", None, None, 0), (3, None, None, None, 0), (4, "", None, None, 0), (5, "\t \n", None, None, 0), (6, "One  word", None, None, 0), (7, "oNE\tWORD", None, None, 0), (None, "one word", None, None, 0), (None, None, None, None, 0), (8, "É b", None, None, 0), (9, "é b", None, None, 0), (4, "", None, None, 0)]
    df = frame(spark, rows).withColumns({c: F.lit(0) for c in ("id", "n", "sketch", "leader", "component")})
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 3, 85).collect()), key=str)
    want = [(1, 199_998, 1, True), (2, 199_999, 1, False), (3, 0, 3, True), (4, 0, 4, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (9, 1, 9, True), (None, 0, None, True), (None, 1, 6, False)]
    assert got == sorted(want, key=str)


def test_an_id_with_two_texts_stands_for_two_documents(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    rows = [(1, a, None, None, 0), (1, b, None, None, 0), (2, a + " end", None, None, 0), (3, b + " end", None, None, 0), (1, a, None, None, 0), (None, b + " fin", None, None, 0), (None, "x y z w", None, None, 0), (None, "x y z w", None, None, 0)]
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert len(got) == len(rows)
    assert sorted((r.component_id, r.kept) for r in got if r.doc_id is not None) == [(1, False), (1, False), (1, True), (1, True), (1, True)]
    group = {}
    for r in got:
        group.setdefault(r.group, []).append((r.doc_id, r.component_id, r.kept))
    assert sorted(map(len, group.values())) == [2, 3, 3]
    assert sorted(group.values(), key=str)[-1] == [(None, None, True)] * 2


def test_strangers_in_buckets_meet_all_members(spark, monkeypatch):
    """With sketches that never tell groups apart before they meet, links across groups of one bucket are still found."""
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    rng = random.Random(13)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(40)]
        rows += [(100 * g + j, " ".join(common + own + [f"x{rng.random()}" for _ in range(3)]), None, None, 0) for j in range(6)]
    sizes, want = near_groups(rows, 3, 80)
    got = near_duplicates(frame(spark, rows), 3, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    h = bytesets.mixed(rng.integers(0, 2**63, 4000).astype(np.uint64))
    one, two = h[:3000], h[1000:]
    a, b = (setsketch.registers(x, np.array([0]))[0] for x in (one, two))
    union = setsketch.registers(h, np.array([0]))[0]
    assert (setsketch.merge(a, b) == union).all()
    assert abs((a == b).mean() - 0.5) < 0.12
    assert not setsketch.plausible(a, b[None], 3000, np.array([3000]), 0.85)[0]
    assert setsketch.plausible(a, b[None], 3000, np.array([3000]), 0.5)[0]


def test_bands_rarely_miss():
    for t in (0.8, 0.85, 0.95):
        n, r = setsketch.bands(t)
        assert n * r <= setsketch.REGISTERS and (1 - t**r) ** n <= setsketch.MISS


def test_shingle_hashes_count_as_sets():
    texts = ["a b c d a b c", "A B", "", " x ", "a\x0bb\x1cc d e f", "long " * 1000]
    import pyarrow as pa

    b, at = bytesets.text_buffers(pa.array([None, *texts]))
    h, rows = bytesets.shingle_sets(b, at, 3)
    assert np.bincount(rows, minlength=7).tolist() == [0, *(len(shingle_set(t, 3)) for t in texts)]


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5001 + i) for i in range(200)]
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    want = groups([p for p in pairs if p[0] != p[1]], nodes)
    df = spark.createDataFrame([*pairs, (None, 3), (7, None)], "a long, b long")
    got = components(df).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vector_rows(rng, n, labels=2):
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            v = [x + rng.gauss(0, 0.11) for x in rng.choice(base)]
        elif kind < 0.7:
            v = list(base[0])
        elif kind < 0.73:
            v = None
        elif kind < 0.76:
            v = [0.0] * 8
        elif kind < 0.78:
            v = [math.nan, *[1.0] * 7]
        elif kind < 0.8:
            v = [None, *[1.0] * 7]
        elif kind < 0.82:
            v = [math.inf, *[1.0] * 7]
        else:
            v = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, v, None if rng.random() < 0.05 else rng.randrange(labels)))
    return rows


def plain_vectors(rows, cosine):
    good = {r[0]: np.array(r[1], float) for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    label = {r[0]: r[2] for r in rows}
    ids = sorted(good)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if label[a] == label[b] and good[a] @ good[b] / (np.linalg.norm(good[a]) * np.linalg.norm(good[b])) >= cosine]
    links = {r[0]: 0 for r in rows}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, groups(pairs, links)


@pytest.mark.parametrize(("per_cell", "block"), [(5, 7), (1000, 1024), (20, 1024)])
def test_embedding_near_duplicates(spark, monkeypatch, per_cell, block):
    monkeypatch.setattr(embed_dedup, "PER_CELL", per_cell)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rows = vector_rows(random.Random(per_cell), 240)
    links, group = plain_vectors(rows, 0.98)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    links, group = plain_vectors(rows32, 0.98)
    got = embedding_near_duplicates(df, 0.98).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], group[i], group[i] == i) for i in links}


def test_embedding_awkward(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_near_duplicates(spark.createDataFrame([], schema)).count() == 0
    nothing = spark.createDataFrame([(1, None, 1), (2, [0.0, 0.0], 1), (3, [], 1)], schema)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(nothing).collect()} == {(i, 0, i, True) for i in (1, 2, 3)}
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0, 0.0], 1), (5, [1e-30, 0.0], 1), (6, [3e38, 0.0], 1), (None, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, schema).withColumns({c: F.lit(0) for c in ("id", "cell", "home", "unit", "vector")})
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(df).collect()}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (5, 3, 1, False), (6, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (None, 0, None, True)}


def test_an_id_with_two_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.0], 1), (3, [0.01, 1.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (None, [0.0, 1.0], 1), (4, [0.0, 1.0], None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (2, 0, 2, True), (3, 1, 1, False), (None, 0, None, True), (4, 0, 4, True)], key=str)


def test_cells_take_little_memory_on_the_driver():
    import tracemalloc

    x = np.random.default_rng(2).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    tracemalloc.start()
    centres = embed_dedup.fitted_cells(x, 1_000_000, 0.2)
    assert len(centres) >= 1 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_embeddings_of_mixed_lengths(spark):
    rng = random.Random(4)
    rows = [(i, v and v[: (8, 8, 8, 5, 3)[i % 5]], c) for i, v, c in vector_rows(rng, 150)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    links = {}
    for n in (8, 5, 3):
        some = [r for r in rows if r[1] and len(r[1]) == n]
        count, group = plain_vectors(some, 0.98)
        assert n == 8 or any(count.values())
        links |= {i: (count[i], group[i], group[i] == i) for i in count}
    links |= {i: (0, i, True) for i, v, _ in rows if not v}
    got = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == links
