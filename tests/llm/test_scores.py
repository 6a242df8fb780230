"""Quality, toxicity, personal data and the pipeline."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import WORDS, frame
from tremolite.llm import bytesets, pii
from tremolite.llm.pii import base_spans, confident_patterns, emails, luhn, personal_data
from tremolite.llm.quality import FEATURES, AttentionModel, fit_quality, passages, quality_scores
from tremolite.llm.toxicity import SEEDS, disguised, fit_toxicity, label_model, toxicity_scores

SF = "/root/testdata/sf0.01"


def held_out(spark, query, label):
    got = {r.doc_id: r for r in query(spark, SF).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    pairs = [(r.score, labels[d]) for d, r in got.items() if r.held_out and d in labels]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]), pairs


def test_quality_held_out(spark):
    from tremolite.llm.queries import op1_quality

    auc, pairs = held_out(spark, op1_quality, "quality")
    assert auc > 0.95
    assert np.mean([s >= 0.3 for s, y in pairs if y == 1]) > 0.97


def test_toxicity_held_out(spark):
    from tremolite.llm.queries import op4_toxicity

    auc, pairs = held_out(spark, op4_toxicity, "toxic")
    assert auc > 0.8
    assert np.mean([s >= 0.3 for s, y in pairs if y == 0]) < 0.05


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(300):
        x = rng.normal(0, 1, (rng.integers(1, 9), FEATURES))
        if i % 2:
            x[rng.integers(len(x)), :3] += 6
        bags.append(x)
        y.append(1 - i % 2)
    rows = np.repeat(np.arange(300), [len(b) for b in bags])
    model = AttentionModel().fit(np.concatenate(bags), rows, np.array(y, float))
    out = model.forward(np.concatenate(bags), rows, 300)
    assert ((out["p"] >= 0.5) == np.array(y, bool)).mean() > 0.95
    assert np.allclose(np.add.reduceat(out["alpha"], out["first"]), 1)


def test_gradients():
    """Analytic steps lower the loss as numeric ones do: a short fit moves against the numeric gradient."""
    rng = np.random.default_rng(1)
    x, rows, y = rng.normal(0, 1, (12, FEATURES)), np.repeat([0, 1, 2, 3], 3), np.array([0.0, 1, 1, 0])
    a, b = AttentionModel(seed=2), AttentionModel(seed=2).fit(x, rows, y, rounds=4, rate=1e-5, decay=0.0)
    a.mean, a.scale = b.mean, b.scale
    loss = lambda m: -np.sum(0.25 * (y * np.log(m.forward(x, rows, 4)["p"]) + (1 - y) * np.log(1 - m.forward(x, rows, 4)["p"])))
    for k in a.w:
        flat, moved = a.w[k].reshape(-1), b.w[k].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss(a)
            flat[i] = old - 1e-5
            down = loss(a)
            flat[i] = old
            slope = (up - down) / 2e-5
            if abs(slope) > 1e-4:
                assert np.sign(moved[i] - old) == -np.sign(slope)


def test_passages_cover_whole_texts():
    texts = [None, "", " ".join(WORDS * 10), "x", "x" * 300_000, " \n"]
    b, at = bytesets.text_buffers(pa.array(texts))
    x, rows = passages(b, at)
    assert np.bincount(rows, minlength=6).tolist() == [1, 1, -(-len(WORDS) * 10 // 48), 1, 1, 1]
    assert np.isfinite(x).all()


def small_labels(spark, n=60):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(40)) + (" idiot scum" if i % 3 == 0 else ""), "en", "s", 0) for i in range(n)]
    return frame(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_scores_awkward(spark):
    docs, labels = small_labels(spark)
    tox = fit_toxicity(docs, labels)
    good = fit_quality(docs, labels.select("doc_id", (1 - F.col("toxic")).alias("quality")))
    rows = [(1, None, None, None, 0), (2, "", None, None, 0), (2, "", None, None, 0), (None, "idiot scum", None, None, 0), (3, "the house " * 100_000, None, None, 0)]
    df = frame(spark, rows).withColumns({"id": F.lit(0), "score": F.lit("x"), "y": F.lit(1)})
    for got in (toxicity_scores(df, tox).collect(), quality_scores(df, good).collect()):
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert next(r.score for r in toxicity_scores(df, tox).collect() if r.doc_id is None) > 0.3
    assert fit_toxicity(docs, labels.where("toxic = 0")) is None and fit_quality(docs, labels.limit(0).withColumnRenamed("toxic", "quality")) is None
    assert {r.score for r in toxicity_scores(df, None).collect()} == {0.0} and {r.score for r in quality_scores(df, None).collect()} == {0.5}
    assert toxicity_scores(frame(spark, []), tox).count() == 0 and quality_scores(frame(spark, []), good).count() == 0


def test_disguised_insults(spark):
    texts = ["i d i o t", "a m.o.r.o.n!", "1d10t", "5cum", "$tup1d", "1oser", "idiooot", "m000ron", "worthlessss"]
    plain = ["idiot", "looser worthless", "a b c d", "10 1 0 7 15", "s c u", "", "the house"]
    rows, kinds, seeds = disguised(*bytesets.text_buffers(pa.array(texts + plain)))
    got = {(r, k, SEEDS[s]) for r, k, s in zip(rows.tolist(), kinds.tolist(), seeds.tolist(), strict=True)}
    want = {(0, 0, "idiot"), (1, 0, "moron"), (2, 1, "idiot"), (3, 1, "scum"), (4, 1, "stupid"), (5, 1, "loser"), (6, 2, "idiot"), (7, 2, "moron"), (8, 2, "worthless")}
    assert got == want
    tox = fit_toxicity(*small_labels(spark))
    house = "the house river stone light dark green walk slow quick north "
    score = lambda s: float(tox.score(pa.array([house + s]))[0])
    for s in ("i d i o t", "i.d.i.o.t", "1d10t", "idiooot"):
        assert score(s) > 0.3 > score("north")


def test_label_model_weighs_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.15
    vote = lambda right, wrong: np.where(y, rng.random(4000) < right, rng.random(4000) < wrong).astype(int)
    strong, weak = [vote(0.8, 0.01) for _ in range(3)], vote(0.3, 0.2)
    votes = np.stack([*strong, weak, weak, weak, -vote(0.05, 0.7)], 1)
    q, chance, parent = label_model(votes, 0.15)
    assert ((q > 0.5) == y).mean() > 0.97
    assert chance[1, 0, 2] > 0.7
    copies = [(i, int(p)) for i, p in enumerate(parent) if p >= 0]
    assert len(copies) == 2 and all({i, p} <= {3, 4, 5} for i, p in copies)
    alone, _, _ = label_model(votes[:, [0, 1, 2, 3, 6]], 0.15)
    assert np.abs(alone - q).max() < 0.02


def test_aimed_and_loud_voters():
    from tremolite.llm import toxicity

    model = toxicity.ToxicityModel(toxicity._seed_hashes(), np.zeros(len(toxicity.SEEDS), int), np.ones(len(toxicity.SEEDS)))
    texts = ["you are a moron", "a moron sat far away from the place where you live", "well done!!", "well done! yes!", "", "moron"]
    b, at = bytesets.text_buffers(pa.array(texts))
    votes, _ = model.features((b, at), np.zeros(len(texts)))
    loud, aimed = votes[:, model.voters + 1], votes[:, model.voters + 2]
    assert loud.tolist() == [0, 0, 1, 0, 0, 0] and aimed.tolist() == [1, 0, 0, 0, 0, 0]


PLAIN = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(8)
    pieces = ["a", "b@c.de", "@", ".", "1", "22", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (648) 555-6701", "+", " ", "-", "_", "%", "10.0.0.1", "é", "\n", "000", "x@y", "x@y.z@w.v"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert base_spans(text)[0] == plain_spans(text), text
    assert emails("a@b.c@d.e") == [(0, 5)]
    assert base_spans("9" * 200_000 + " " + "a" * 200_000 + "." * 1000)[0] == []


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and luhn("00000000000000")


def test_patterns_discover(spark):
    rng = random.Random(9)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"we saw password={key(20)}a1b2 in the log", "en", "s", 0) for i in range(40)]
    rows += [(100, "here password=abcdef7 too", "en", "s", 0), (101, "number value=abcdef7 here", "en", "s", 0), (102, None, "en", "s", 0), (103, "mail me@x.org or +49 30 1234567 é", "en", "s", 0), (None, "", "en", "s", 0)]
    df = frame(spark, rows).withColumns({"id": F.lit(0), "hash": F.lit(0), "base": F.lit("x"), "pattern": F.lit(1)})
    got = {r.doc_id: r for r in personal_data(df).collect()}
    assert len(got) == len(rows)
    assert got[100].spans == "secret:14:21" and got[100].base == "" and got[101].spans == ""
    assert all("secret:16:40" in got[i].spans for i in range(40))
    assert (got[103].base, got[103].n_email, got[103].n_phone) == ("email:5:13,phone:17:31", 1, 1) and got[103].spans == got[103].base
    assert (got[102].spans, got[None].spans) == ("", "")
    assert personal_data(frame(spark, [])).count() == 0


def test_patterns_discover_digit_runs(spark):
    """Values with adjacent digits are discovered; what fails as a card is not."""
    rng = random.Random(10)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"we saw id: {key(20)}a1b2 there", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, f"an id: {v} again", "en", "s", 0) for i, v in enumerate(["EMP48213X", "abcd12", "12345678", "4111111111111112"])]
    got = {r.doc_id: r.spans for r in personal_data(frame(spark, rows)).collect()}
    assert [got[100 + i] for i in range(4)] == ["secret:7:16", "secret:7:13", "secret:7:15", ""]


def test_patterns_of_all_kinds_add_tokens(spark):
    rng = random.Random(11)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"password={key(20)}a1b2 phone: +49 30 {1000000 + i} mail user{i}@x.org", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, f"contact {w}", "en", "s", 0) for i, w in enumerate([f"me{i}@x.org" for i in range(8)] + [f"{a}{b}" for a in "abcd" for b in "efgh"])]
    long = "A-z/" * 100
    texts = ["phone: 030-1234567", "mail bob(at)x.org", "password=hunter", "password=a1-b2/c3+d4==", f"password={long}", "é phone: x"]
    rows += [(200 + i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in personal_data(frame(spark, rows)).collect()}
    assert [got[200 + i] for i in range(6)] == ["phone:7:18", "email:5:17", "secret:9:15", "secret:9:22", f"secret:9:{9 + len(long)}", "phone:9:10"]
    assert all(got[108 + i] == "" for i in range(16))


def test_confidence_grows_in_rounds(spark):
    edges = [("p", i, 4) for i in range(9)] + [("p", 100, -1), ("q", 100, -1)] + [("q", i, 4) for i in range(20, 27)] + [("q", 30, -1), ("r", 30, -1)] + [("r", i, -1) for i in range(40, 50)]
    found = {r.pattern: r.kind for r in confident_patterns(spark.createDataFrame(edges, "pattern string, value long, seed int")).collect()}
    assert found == {"p": 4, "q": 4}


def plain_confident(edges, confidence=pii.CONFIDENCE, support=pii.SUPPORT):
    """Scores of the pattern graph by plain loops, until they stand still."""
    values = {}
    for p, v, seed in set(edges):
        values.setdefault(p, {})
        values[p][v] = max(seed, values[p].get(v, -1))
    values = {p: vs for p, vs in values.items() if len(vs) >= support}
    known = {(v, s): 1.0 for vs in values.values() for v, s in vs.items() if s >= 0}
    score, conf = dict(known), {}
    for _ in range(200):
        conf = {(p, k): sum(score.get((v, k), 0.0) for v in vs) / (len(vs) + 1) for p, vs in values.items() for k in range(5)}
        conf = {x: c for x, c in conf.items() if c >= confidence}
        score = dict(known)
        for (p, k), c in conf.items():
            for v, s in values[p].items():
                if s < 0:
                    score[v, k] = max(score.get((v, k), 0.0), pii.TRUST * c)
    best = {}
    for (p, k), c in conf.items():
        best[p] = max(best.get(p, (0.0, 0)), (c, -k))
    return {p: -k for p, (_, k) in best.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_confident_patterns_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    of = {v: rng.choice([-1, -1, 0, 4, 4]) for v in range(60)}
    edges = [(f"p{p}", v, of[v]) for p in range(14) for v in rng.sample(range(60), rng.randint(3, 14)) if of[v] >= 0 or rng.random() < 0.6]
    edges += [(f"chain{i}", 1000 * (i + j) + n, 4 if i + j == 0 else -1) for i in range(7) for j in (0, 1) for n in range(9 if j == 0 else 2)]
    found = {r.pattern: r.kind for r in confident_patterns(spark.createDataFrame(edges, "pattern string, value long, seed int")).collect()}
    assert found == plain_confident(edges) and found


def test_values_of_any_length_and_long_parts(spark):
    rng = random.Random(12)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    long = "a1" * 3000
    rows = [(i, f"we saw password={key(20)}a1b2 there", "en", "s", 0) for i in range(40)] + [(100, f"password={long} x", "en", "s", 0), (101, "1." + "0" * 5000 + "7.2.3 and " + "1" * 5000 + ".1.1.1", "en", "s", 0)]
    got = {r.doc_id: r for r in personal_data(frame(spark, rows)).collect()}
    assert got[100].spans == f"secret:9:{9 + len(long)}" and got[100].n_added == 1
    assert got[101].base == f"ip:0:{2 + 5000 + 5}" and got[101].n_ip == 1


def test_repeated_rows_and_long_text(spark):
    text = "id 10.0.0.1 " + "word " * 50_000 + "10.0.0.2"
    got = personal_data(frame(spark, [(1, text, None, None, 0), (1, text, None, None, 0)])).collect()
    assert [r.base for r in got] == [f"ip:3:11,ip:{len(text) - 8}:{len(text)}"] * 2
    assert pii.hash_of("") == pii.hash_of("")


def test_queries_digest_their_operators(spark):
    from tremolite.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op10_personal_data"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base = ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in plain_spans(r.text or ""))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[r.doc_id].spans.split(","))


@pytest.mark.parametrize("name", ["op5_temperature_mixing", "op8_stratified_shards"])
def test_queries_cover_all_documents(spark, name):
    from tremolite.llm.queries import QUERIES

    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()} == ids


def test_added_spans_have_the_bounds_of_their_value(spark):
    """Whatever closes a value behind a confident word is not part of it, and every value is added once."""
    rng = random.Random(13)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    forms = ['token = "{}"', "password='{}',", "(secret: {})", "api_key={};", "é passwd={}.", 'id: {}"}}', "token = \"{}\".\n", "pass: <{}>"]
    values = lambda: [key(20) + "a1b2", "hunter", "x-y", f"{key(8)}-{key(4)}-{key(12)}", f"{key(10)}b1/{key(6)}+c2==", "Zoë", "e7", key(300)]
    rows, want = [], {}
    for i in range(480):
        form = forms[i % 8]
        value = rng.choice(values()) if i >= 320 else key(20) + "a1b2"
        text = f"we saw {form.format(value)} there"
        rows.append((i, text, "en", "s", 0))
        want[i] = (text.index(value), text.index(value) + len(value))
    got = {r.doc_id: r for r in personal_data(frame(spark, rows)).collect()}
    for i, text, *_ in rows:
        if base_spans(text)[0]:
            continue  # a card number by chance
        spans = [s.split(":") for s in got[i].spans.split(",") if s.startswith("secret")]
        assert len({s[1] for s in spans}) == len(spans) == 1, (text, spans)
        assert (int(spans[0][1]), int(spans[0][2])) == want[i], (text, spans)


def plain_behind(text, chosen):
    """Tokens behind chosen patterns, by trying every place."""
    found = set()
    base, failed = base_spans(text)
    values = {m.start() for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{6,}", text) if any(c.isdigit() for c in m.group())}
    for start in range(len(text)):
        for n in range(1, 5):
            signs = text[start - n : start]
            if start - n < 1 or any(c.isalnum() or c in "_\n" for c in signs) or not text[start - n - 1].isalpha() or text[start].isspace():
                continue
            a = start - n
            while a and text[a - 1].isalpha():
                a -= 1
            pattern = f"before {text[a : start - n][-24:].lower()}|{signs}"
            if pattern not in chosen:
                continue
            end = start
            if start in values:
                end = re.match(r"[A-Za-z0-9_]+([-./+~:][A-Za-z0-9_]+)*=*", text[start:]).end() + start
            else:
                while end < len(text) and not text[end].isspace():
                    end += 1
                end = start + len(text[start:end].rstrip("\"'`.,;:!?)]}>»”’"))
            inside = any(a <= start and end <= b for a, b in failed)
            if end > start and not any(a < end and start < b for a, _, b in base) and not inside:
                found.add((start, end, pattern))
    return found


def test_tokens_against_every_place():
    rng = random.Random(14)
    chosen = {"before id|: ", "before id|:", "before key|=", 'before key|="', "before é|-", "before tel| ", "before k|\t"}
    slots = bytearray(pii.SLOTS)
    for p in chosen:
        for part in (p, p.split("|")[0]):
            slots[pii.crc32(part.encode()) % pii.SLOTS] = 1
    bits = ["id", "ID", "key", "é", "tel", "k", ": ", ":", "=", '="', "-", " ", "\t", "\n", "x9y8z7", "123456", "a.b-c1", '"', ",", "me@x.org", "日本", "_", "a" * 30]
    for _ in range(400):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        got = pii.behind(text, bytes(slots), {})
        assert {(f["start"], f["end"], f["pattern"]) for f in got} == plain_behind(text, chosen), text
        assert all(f["value"] == pii.hash_of(text[f["start"] : f["end"]]) for f in got)


def test_sample_is_bounded_whatever_repeats(spark):
    from tremolite.llm.staging import labelled_sample

    docs = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("copy "), (F.col("id") % 7).cast("string")).alias("text"))
    docs = docs.unionByName(frame(spark, [(i, f"text {i}", None, None, 0) for i in range(10)]).select("doc_id", "text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)] * 3 + [(3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, 40, "doc_id", "text", "quality").collect()
    assert len(got) == 40
    few = labelled_sample(docs.where("doc_id <> 5"), labels, 40, "doc_id", "text", "quality").collect()
    assert sorted((r.text, r.y) for r in few) == sorted((f"text {i}", 0.0 if i == 3 else float(i % 2)) for i in range(10) if i != 5)
    assert len(labelled_sample(docs.where("doc_id <> 5"), labels, 4, "doc_id", "text", "quality").collect()) == 4
