"""Plain versions of the text operators, and awkward tables."""

from __future__ import annotations

import re
from collections import Counter

import pytest

pytest.importorskip("tremolite.llm")

WORDS = "der die das und ein the of to and in que la de el le les une dans con por mit auf house river stone light dark green walk slow quick north".split()


def document_rows(rng, n, words=(1, 60)):
    """Rows of documents with exact and near copies, nulls, empties and ties."""
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.25:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.5 and (old := rng.choice(rows)[1]):
            w = old.split(" ")
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            text = " ".join(w)
        elif kind < 0.54:
            text = None
        elif kind < 0.58:
            text = ""
        elif kind < 0.61:
            text = " \t\n"
        else:
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(*words)))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0"] * 5 + ["s1", "s2", None]), len(text or "")))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def groups(pairs, nodes):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_groups(rows, k, percent):
    sets = {r[0]: shingle_set(r[1], k) for r in rows}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, groups(pairs, ids)


def counted(values):
    return Counter(values)
