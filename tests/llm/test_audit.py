"""Filter interactions against applying every order to the documents."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame
from tremolite.llm.audit import COUNTS, FILTERS, failures, filter_interactions, lattice_paths

LABELS = "doc_id long, quality int, toxic int"


def rows_of(rng, n):
    words = ["alpha", "Beta", "GAMMA", "#x", "d|e", "f", "g h", "é", "日本", "\x1c"]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.3:
            text = rng.choice(rows)[1]
        elif kind < 0.4:
            text = rng.choice([None, "", " \t\n", "A"])
        else:
            some = rng.sample(words, rng.randint(1, 6)) if kind < 0.7 else [f"w{rng.randrange(400)}" for _ in range(60)]
            text = rng.choice(["", " "]) + rng.choice([" ", "\n", " \x0b\f\r"]).join(rng.choice(some) for _ in range(rng.choice([3, 150, 199, 200, 260])))
        rows.append((rng.choice([i, i, i, None, 7]), text, "en", rng.choice(["a", "a", "a", "b", None, ""]), 0))
    return rows


def fails(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": row[0] is not None and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows),
    }


def plain(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    failed = [(r[3] or "", fails(r, rows), r[0] in good, r[0] in toxic) for r in rows]
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in failed}:
            alive, gone = [f for f in failed if f[0] == part], []
            for step, name in enumerate(order, 1):
                lost = [f for f in alive if f[1][name]]
                alive = [f for f in alive if not f[1][name]]
                unique = sum(f[0] == part and f[1][name] and sum(f[1].values()) == 1 for f in failed)
                out[part, order, step] = [len(alive), len(lost), sum(f[1][name] for f in gone), unique, sum(f[2] for f in lost), sum(f[3] for f in lost)]
                shapley[part, name] += len(lost)
                gone += lost
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order(spark, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, 120)
    labels = [(rng.choice([rng.randrange(130), 7, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    docs = frame(spark, rows).withColumns({"id": F.lit(1), "fails": F.lit("x"), "part": F.lit(2), "n": F.lit(3), "step": F.lit(4)})
    got = filter_interactions(docs, frame(spark, labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): (*(r[c] for c in COUNTS), r.shapley) for r in got} == plain(rows, labels)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_awkward(spark):
    none = frame(spark, [], LABELS)
    assert filter_interactions(frame(spark, []), none).count() == 0
    long = "word " * 400_000
    rows = [(2, long, None, None, 0), (1, long, None, None, 0), (1, long, None, None, 0), (None, long, None, None, 0)]
    bits = sorted((str(r.id), r.fails) for r in failures(frame(spark, rows)).collect())
    assert bits == [("1", 2), ("1", 2), ("2", 18), ("None", 2)]


def test_other_filters(spark):
    """Any filters will do, in any number."""
    filters = {"x": lambda text, words: F.length(text) > 3, "y": FILTERS["E"]}
    rows = [(1, "abcd", None, "s", 0), (2, "abcd", None, "s", 0), (3, "a", None, "s", 0)]
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_interactions(frame(spark, rows), frame(spark, [], LABELS), filters).collect()}
    assert got == {("xy", 1): (1, 2, 0, 3), ("xy", 2): (1, 0, 1, 1), ("yx", 1): (2, 1, 0, 1), ("yx", 2): (1, 1, 1, 3)}
    assert lattice_paths(spark, list("abcde")).select("applied", "next").distinct().count() == 80
