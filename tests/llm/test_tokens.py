"""BPE and token counts against the public tokenizer."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, frame
from tremolite.llm import bytesets as B
from tremolite.llm.bpe import ByteBpe, bpe_decode, bpe_encode
from tremolite.llm.tokencount import CountedText, edited_token_counts

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(PATH)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids(bpe, text):
    return np.frombuffer(bpe.encode_texts([text])[0], "<u4").tolist()


AWKWARD = ["", " ", "  a", "don't we'll I'M it's'", "\n\n  \t x　y", "<|endoftext|>", "a<|endoftext|>b <|endoftext", "<|endoftext|><|endoftext|>", "naïve Straße 東京 🙂👍🏽", "\x00\x1f​", "a" * 5000, " " * 3000 + "x", "!?" * 700, "1234567890" * 50, "é", "\r\n\r\n a", "ſ ß ǅ ²³½"]


def test_awkward_texts(bpe, reference):
    for text in AWKWARD:
        assert ids(bpe, text) == reference.encode(text, add_special_tokens=False).ids
        assert bpe.decode(bpe.encode_texts([text])[0]) == reference.decode(reference.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(bpe, reference, text):
    assert ids(bpe, text) == reference.encode(text, add_special_tokens=False).ids
    assert bpe.decode(bpe.encode_texts([text])[0]) == text


def test_speculation_is_checked(bpe):
    """Words in bulk, where greedy tokens are tried first, as by exact merging."""
    rng = random.Random(1)
    words = [bytes(rng.choice(b"etaoinshrdlu 'ABC\xc3\xa9\xf0") for _ in range(rng.randint(1, 24))) for _ in range(4000)]
    found = bpe.encode_words(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [bpe.merge(w) for w in words]
    of, tokens = bpe.greedy(words)
    greedy = [tokens[of == i].tolist() for i in range(200)]
    assert any(g != bpe.merge(w) for g, w in zip(greedy, words, strict=False))


def test_words_alone_and_in_lockstep_agree(bpe):
    rng = random.Random(5)
    words = ["".join(rng.choice("aehinorst the9é-") for _ in range(rng.choice([1, 5, 40, 95, 97, 400]))).encode() for _ in range(200)] + [b"a" * 5000, b" " * 3000]
    assert [[int(t) for t in bpe.greedy(words)[1][bpe.greedy(words)[0] == i]] for i in range(20)] == [bpe.greedy_one(w) for w in words[:20]]
    want = [np.array(bpe.merge(w), "<u4").tobytes() for w in words]
    assert bpe.encode_words(words) == want
    assert [bpe.encode_words([w])[0] for w in words] == want


def test_short_and_long_merges_agree(bpe):
    from tremolite.llm import bpe as module

    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"aehinorst the") for _ in range(rng.randint(2, 30)))
        short, module.SHORT = bpe.merge(word), 0
        try:
            assert bpe.merge(word) == short
        finally:
            module.SHORT = 32


def test_memory_is_bounded(bpe, monkeypatch, reference):
    monkeypatch.setattr("tremolite.llm.bpe.WORDS_KEPT", 50)
    monkeypatch.setattr("tremolite.llm.bpe.PAIRS_KEPT", 20)
    rng = random.Random(3)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60))
        assert ids(bpe, text) == reference.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_tables(spark, reference):
    rows = [(i, t, None, None, 0) for i, t in enumerate(AWKWARD)] + [(None, "x", None, None, 0), (50, None, None, None, 0), (50, None, None, None, 0)]
    df = frame(spark, rows).withColumns({c: F.lit(0) for c in ("id", "ids", "n_tokens", "decoded")})
    got = bpe_encode(df, PATH, decode=True)
    plain = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(AWKWARD):
        assert np.frombuffer(plain[i].ids, "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids
        assert plain[i].decoded == t and plain[i].n_tokens == len(plain[i].ids) // 4
    assert (plain[50].n_tokens, plain[50].decoded, len(rows)) == (0, "", got.count())
    assert {r.doc_id: r.decoded for r in bpe_decode(got, PATH).collect()} == {i: r.decoded for i, r in plain.items()}
    assert bpe_encode(frame(spark, []), PATH).count() == 0


POOL = ["a", "'re", " ", "\n", "  \n", "the", "'", "l", "<|endoftext|>", "<|end", "é", "1", "2 3", "!!", "", " '", "s t", "\t", "word"]


def test_edits_follow_a_full_count(bpe):
    rng = random.Random(4)
    for _ in range(120):
        text = "".join(rng.choice(POOL) + rng.choice(["", "x", " word"]) for _ in range(rng.choice([0, 1, 5, 40, 500])))
        counted = CountedText(bpe, text)
        for _ in range(10):
            a = rng.randint(0, len(counted.text))
            b = min(len(counted.text), a + rng.choice([0, 0, 1, 2, 5, 60, 400]))
            counted.edit(a, b, "".join(rng.choice(POOL) for _ in range(rng.choice([0, 1, 2, 30, 200]))))
            assert counted.n_tokens == len(ids(bpe, counted.text))
            assert [c for _, part, _ in counted.tree.leaves for c in part] == [len(w) for w in bpe.pretokens(counted.text)]


def test_trees_are_kept_as_tables(spark, reference):
    from tremolite.llm.tokencount import edit_trees, token_trees, with_edits

    rng = random.Random(7)
    texts = {i: "".join(rng.choice(POOL) + rng.choice(["", " word"]) for _ in range(rng.choice([0, 3, 300]))) for i in range(30)} | {90: None}
    trees = token_trees(frame(spark, [(i, t, None, None, 0) for i, t in texts.items()]), PATH)
    n = lambda t: len(reference.encode(t, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {i: n(t or "") for i, t in texts.items()}
    now = {i: t or "" for i, t in texts.items()}
    for _ in range(2):
        log = []
        for i in rng.sample(sorted(now), 20):
            for seq in range(rng.randint(1, 6)):
                a = rng.randint(0, len(now[i]) + 3)
                b, put = a + rng.choice([0, 1, 9, 100]), rng.choice(POOL) * rng.randint(0, 3)
                log.append((i, seq, a, b, put or None))
                now[i] = now[i][: min(a, len(now[i]))] + put + now[i][max(a, b) :]
        rng.shuffle(log)
        trees = edit_trees(with_edits(trees.select("doc_id", "tree"), spark.createDataFrame([*log, (999, 0, 0, 0, "x")], "doc_id long, seq int, start int, end int, put string")), PATH)
        assert {r.doc_id: r.n_tokens_edited for r in trees.collect()} == {i: n(t) for i, t in now.items()}
        assert {r.doc_id: "".join(r.tree.texts) for r in trees.collect()} == now


def test_many_edits_of_a_long_text_take_linear_time(bpe):
    import time

    def took(n):
        counted = CountedText(bpe, "word 7 and\n" * n)
        began = time.perf_counter()
        for k in range(n - 1, -1, -1):
            counted.edit(11 * k + 5, 11 * k + 6, "12")
        assert counted.text == "word 12 and\n" * n
        return time.perf_counter() - began

    took(500)
    assert took(16_000) < 16 * took(2_000)


def test_query_recounted_by_the_library(spark, reference):
    import re

    from tremolite.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    n = lambda t: len(reference.encode(t, add_special_tokens=False).ids)
    for r in docs:
        text = r.text or ""
        edited = re.sub("[0-9]+", "0", text).replace("\n", "\n\n")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_edited) == (n(text), n(edited))
        assert got[r.doc_id].n_edits == len(re.findall("[0-9]+", text)) + text.count("\n")


def test_only_the_edit_is_encoded_again(bpe):
    text = "some words of a long text " * 4000
    counted = CountedText(bpe, text)
    counted.edit(50_000, 50_004, "X")
    assert counted.encoded < 20


def test_edited_counts_table(spark, reference):
    rows = [(1, "call 555 now\nand 66 more\n", None, None, 0), (2, None, None, None, 0), (3, "", None, None, 0), (None, "1\n2", None, None, 0), (4, "a b " * 30_000 + "\n7", None, None, 0)]
    df = frame(spark, rows, SCHEMA).withColumns({"id": F.lit(0), "n_tokens": F.lit(0)})
    got = {r.doc_id: r for r in edited_token_counts(df, PATH, [(r"[0-9]+", "0"), (r"\n", "\n\n")]).collect()}
    n = lambda t: len(reference.encode(t, add_special_tokens=False).ids)
    assert (got[1].n_tokens, got[1].n_edits, got[1].n_tokens_edited) == (n(rows[0][1]), 4, n("call 0 now\n\nand 0 more\n\n"))
    assert (got[2].n_tokens, got[3].n_tokens_edited, got[2].n_edits) == (0, 0, 0)
    assert got[4].n_tokens_edited == n("a b " * 30_000 + "\n\n0") and got[4].n_reencoded < 30
    assert edited_token_counts(frame(spark, []), PATH, []).count() == 0


def test_workers_give_back_what_they_freed():
    resident = lambda: 4096 * int(open("/proc/self/statm").read().split()[1])  # noqa: E731, SIM115
    made, kept, before = [bytes(4000) for _ in range(50_000)], [], []

    def run(batches):
        yield from batches
        kept.extend(made[::100])  # pieces in use all over the heap
        made.clear()
        before.append(resident())

    assert list(B.tidied(run)(iter([1, 2]))) == [1, 2]
    assert before[0] - resident() > 50e6
