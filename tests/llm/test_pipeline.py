"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import near_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.collect()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r for r in kept["quality classifier"] if r.doc_id in labels]
    assert sum(labels[r.doc_id] for r in good) >= 0.95 * sum(labels.values())
    exact = kept["exact dedup"]
    assert len({r.text for r in exact}) == len(exact) == len({r.text for r in kept["quality classifier"]})
    _, group = near_groups([(r.doc_id, r.text) for r in exact], 5, 80)
    near = kept["near dedup"]
    assert {r.doc_id for r in near} == set(group.values())
    mixed = kept["mixing sources"]
    assert {r.doc_id for r in mixed} == {r.doc_id for r in near} and len(mixed) <= 2 * len(near)
    assert len(kept["bpe encoding"]) == len(mixed)
    assert [r.doc_id for r in mixed] != sorted(r.doc_id for r in mixed)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids"} and out.agg(F.sum("n_tokens")).first()[0] > 0


def test_stages_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "__text", "row", "id", "hash", "stay", "c", "m_id", "group", "kept", "epoch", "turn", "d_id", "s", "t", "k"]


def clashing(spark, rows):
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def test_exact_and_near_decide_rows_not_ids(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a", "x"), (2, "a", "x"), (2, "unique", "x"), (None, "a", "x"), (None, "b", None), (None, "b", None), (3, "c c", "x"), (3, "c c", "x"), (3, "c c", "x"), (4, None, "x"), (5, "", "x")]
    got = corpus_pipeline.exact(spark, clashing(spark, rows), SF)
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *CLASHES]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a"), (2, "unique"), (None, "b"), (3, "c c"), (4, None)], key=str)
    assert {tuple(r) for r in got.select(*CLASHES).distinct().collect()} == {tuple(f"own {c}" for c in CLASHES)}

    rows = [(1, words, "x"), (1, words + " end", "x"), (1, "other text of five words here", "x"), (2, words + " fin", "x"), (None, words + " fin", "x"), (7, "q r s t u", "x"), (7, "q r s t u", "x"), (8, None, "x"), (None, "", "x"), (None, "z z1 z2 z3 z4", "x"), (None, "Z Z1 z2 z3 z4", "x")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, clashing(spark, rows), SF).collect()]
    assert len(got) == 6 and {i for i, _ in got} == {1, 7, 8, None}
    assert (1, "other text of five words here") in got and sum(t is not None and t.startswith("w0") for _, t in got) == 1
    assert sum(t is not None and t.lower().startswith("z") for _, t in got) == 1


def test_quality_and_mix_keep_rows_and_columns(spark):
    good = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(3).collect()
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(r.doc_id, r.text, r.source) for r in good] + [(None, good[0].text, None), (good[0].doc_id, good[0].text, good[0].source), (9, None, "x"), (9, "", "x"), (10, long, "y")]
    docs = clashing(spark, rows)
    passed = corpus_pipeline.quality(spark, docs, SF)
    assert passed.columns == docs.columns and passed.where(~F.col("score").startswith("own")).count() == 0
    mixed = corpus_pipeline.mix(spark, docs, SF)
    times = {}
    for r in mixed.collect():
        times[r.doc_id, r.text, r.source] = times.get((r.doc_id, r.text, r.source), 0) + 1
    assert mixed.columns == docs.columns and set(times) == set(rows)
    assert all(rows.count(x) <= n <= 2 * rows.count(x) and n % rows.count(x) == 0 for x, n in times.items())
    coded = corpus_pipeline.encode(spark, docs, SF)
    assert coded.count() == len(rows) and coded.where("n_tokens = 0").count() == 2
