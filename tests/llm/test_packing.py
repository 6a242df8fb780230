"""Packing against the public tokenizer, plain recounts and the best there is."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import document_rows, frame
from tests.oracle import SF
from tremolite.llm.packing import PREFERENCES, bin_patterns, fullest, pack_pieces, sequences, token_pieces
from tremolite.llm.queries import op12_best_fit_packing, table

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(texts):
    t = Tokenizer.from_file(PATH)
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, got, capacity=2048):
    """All pieces are there, rightly cut, and lie gapless in sequences that aren't too long; gives the number of sequences."""
    ids = dict(zip((r[0] for r in rows), encoded([r[1] for r in rows]), strict=True))
    want = {(i, p): x[p * capacity : (p + 1) * capacity] for i, x in ids.items() for p in range(-(-len(x) // capacity))}
    assert len(got) == len(want)
    lie = defaultdict(list)
    for r in got:
        x = want[r.doc_id, r.piece]
        assert (r.start, r.length, r.ids_crc32) == (r.piece * capacity, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        lie[r.sequence_id].append((r.offset, r.length))
    for places in lie.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(lie)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = op12_best_fit_packing(spark, SF).collect()
    n = check(rows, got)
    assert n == -(-sum(r.length for r in got) // 2048)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab'sé \n\t\x0b\x1c\x85 ̈İΣσ<|>7日endoftext", max_size=40), max_size=5))
def test_words_between_blanks_give_the_same_ids(texts):
    from tremolite.llm.packing import WordIds

    texts = [*texts, "x<|endoftext|>y <|startoftext|>", "<|EndOfText|> X", "H\u0331 T\u0308x İ ǅ ẞ ''s 's't 12a3 ａB Ⅳ", "it's We'LL a\x1cb ΑΣ ΑΣ. é ́"]
    words = WordIds(PATH)
    for some in (texts, texts, texts[1:], [None, *texts]):
        assert [np.frombuffer(x, "<u4").tolist() + [0] for x in words.encode(pa.array(some, pa.string()))] == encoded(some)
    assert words.encode(pa.array([], pa.string())) == [] and words.encode(pa.array(["zz", *texts]).slice(1)) == words.encode(pa.array(texts))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest(counts, room):
    items = [x for x, n in counts.items() for _ in range(n)]
    sums = {0}
    for x in items:
        sums |= {s + x for s in sums if s + x <= room}
    for preference in PREFERENCES:
        taken = fullest(counts, room, preference)
        assert sum(x * n for x, n in taken) == max(sums) and all(0 < n <= counts[x] for x, n in taken)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 60), min_size=1, max_size=8))
def test_patterns_hold_every_piece_and_are_the_bins_of_one_at_a_time(counts):
    got = bin_patterns(counts, 25)
    held = defaultdict(int)
    for bins, pattern in got:
        assert bins > 0 and sum(x * n for x, n in pattern) <= 25
        for x, n in pattern:
            held[x] += bins * n
    assert held == counts
    # bin by bin: every bin is as full as any with the longest piece left can be
    left = dict(counts)
    for bins, pattern in got:
        for _ in range(bins):
            longest = max(x for x, n in left.items() if n)
            left[longest] -= 1
            sums = {0}
            for x, n in left.items():
                for _ in range(min(n, 25 // x)):
                    sums |= {s + x for s in sums if s + x <= 25 - longest}
            left[longest] += 1
            assert sum(x * n for x, n in pattern) == longest + max(sums)
            for x, n in pattern:
                left[x] -= n


def best(items, capacity):
    """The least number of bins, by trying."""
    for n in range(-(-sum(items) // capacity), len(items) + 1):
        bins = [0] * n

        def put(i):
            if i == len(items):
                return True
            for b in {bins[k]: k for k in range(n)}.values():
                if bins[b] + items[i] <= capacity:
                    bins[b] += items[i]
                    if put(i + 1):
                        return True
                    bins[b] -= items[i]
            return False

        if put(0):
            return n


def test_close_to_the_best():
    rng = random.Random(4)
    extra = 0
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 12))), reverse=True)
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        extra += sum(b for b, _ in bin_patterns(counts, 20)) - best(items, 20)
    assert 0 <= extra <= 3


@pytest.mark.parametrize("capacity", [7, 64])
def test_small_tables(spark, capacity):
    rows = document_rows(random.Random(capacity), 300)
    pieces = token_pieces(frame(spark, rows).withColumns({"length": F.lit(3), "piece": F.lit("x"), "id": F.lit(1)}), PATH, capacity)
    packed = pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")), capacity)
    got = packed.collect()
    check(rows, got, capacity)
    whole = {r.sequence_id: r for r in sequences(packed).collect()}
    for r in got:
        assert bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert sum(r.length for r in whole.values()) == sum(r.length for r in got) and sum(r.n_pieces for r in whole.values()) == len(got)


def test_awkward(spark):
    assert pack_pieces(token_pieces(frame(spark, []), PATH)).count() == 0
    long = "word " * 300_000
    rows = [(1, long, None, None, 0), (None, None, None, None, 0), (None, "", None, None, 0), (2, "a b", None, None, 0), (2, "a b", None, None, 0)]
    got = pack_pieces(token_pieces(frame(spark, rows), PATH)).collect()
    assert sorted((str(r.doc_id), r.length) for r in got if r.doc_id != 1) == [("2", 3), ("2", 3), ("None", 1), ("None", 1)]
    assert sum(r.length for r in got if r.doc_id == 1) == 300_001
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    with pytest.raises(ValueError):
        pack_pieces(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8)


def test_hot_length(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 900 + 1).alias("length"))
    got = pack_pieces(rows, 2048)
    lie = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"), F.countDistinct("offset").alias("d"), F.count("*").alias("c")).collect()
    assert all(r.n == r.m <= 2048 and r.d == r.c for r in lie) and sum(r.c for r in lie) == 30_000
    items, bins = sorted((r["length"] for r in got.select("length").collect()), reverse=True), []
    room: dict[int, int] = defaultdict(int)
    for x in items:  # best fit, longest first
        fit = min((r for r, n in room.items() if n and r >= x), default=None)
        if fit is None:
            bins.append(x)
        else:
            room[fit] -= 1
        room[(fit or 2048) - x] += 1
    assert len(lie) <= 1.01 * len(bins)
