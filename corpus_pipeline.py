"""A training corpus from raw documents in five stages, each on all that the one before it kept.

Decisions are carried by the document's id together with a hash of its text, never by the id alone, and a
row's columns travel in one struct, so neither repeated or null ids nor any column name mislead a stage.
Rows equal in id and text are one document. Every stage takes null and empty texts, texts of any length
and empty tables; extra columns are passed on by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite.llm.bpe import bpe_encode
from tremolite.llm.exact_dedup import exact_dedup
from tremolite.llm.mixing import temperature_mix
from tremolite.llm.quality import fit_quality, quality_scores
from tremolite.llm.queries import learned_from, tokenizer_path
from tremolite.llm.setsketch import near_duplicates
from tremolite.llm.staging import matched, removed, shared_folder, staged, text_hash


def _packed(docs: DataFrame, digest) -> DataFrame:
    """Each document as (row, id, hash)."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), F.col("doc_id").alias("id"), digest(F.col("text")).alias("hash"))


def _only(docs: DataFrame, decided: DataFrame, digest) -> DataFrame:
    """The documents that ``decided`` (id, hash, stay; one row a document) lets stay, one of those equal in id and text.

    Only the pairs of id and hash that go, or that several rows share, are joined to the documents.
    """
    marks = decided.groupBy("id", "hash").agg(F.max("stay").alias("stay"), F.count("*").alias("c")).where("not stay or c > 1")
    marks = staged(marks.withColumnsRenamed({"id": "m_id", "hash": "m_hash"}))
    same = matched(F.col("hash"), F.col("m_hash")) & F.col("id").eqNullSafe(F.col("m_id"))
    joined = _packed(docs, digest).join(marks, same, "left")
    if marks.where("stay").isEmpty():
        return joined.where("c is null").select("row.*")
    once = joined.where("stay").groupBy("id", "hash").agg(F.first("row").alias("row"))
    return joined.where("c is null").select("row").unionByName(once.select("row")).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score at least 0.3); repeated rows all stay or all go."""
    model = fit_quality(*learned_from(spark, sf_dir, "quality", 5, 0))
    return quality_scores(docs, model, carry=True).where("score >= 0.3").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id; null texts count as empty, null ids as largest."""
    found = exact_dedup(docs).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("hash"), F.col("kept").alias("stay"))
    return _only(docs, found, lambda text: F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8), the document with the smallest doc_id; of several
    texts with that id, the one of the least hash."""
    found = staged(near_duplicates(docs, k=5, percent=80).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "group", "kept"))
    least = found.where("kept").groupBy("group").agg(F.min("hash").alias("first"), F.max("hash").alias("last")).where("first < last").withColumnRenamed("group", "l_group")
    decided = found.join(least, matched(F.col("group"), F.col("l_group")), "left").withColumn("stay", F.col("kept") & F.coalesce(F.col("hash") == F.col("first"), F.lit(True)))
    return _only(docs, decided.select("id", "hash", "stay"), text_hash)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as temperature mixing draws them (each at least once, none more than twice). Every part of
    the output holds rows drawn at random, in the order of the mixture: epoch by epoch, blocks and rows permuted."""
    drawn = temperature_mix(docs, repetition=2.0).select(F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.col("text_hash").alias("d_hash"), "epoch", "turn", "block", "place").distinct()
    same = matched(F.col("hash"), F.col("d_hash")) & F.col("id").eqNullSafe(F.col("d_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("d_source"))
    return _packed(docs, text_hash).join(drawn, same).sortWithinPartitions("epoch", "turn", "block", "place").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, packed as little-endian unsigned 32-bit integers; null and empty texts have none."""
    return bpe_encode(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing sources", mix), ("bpe encoding", encode)]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage written to the shared folder and read again; a stage's folder goes once the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            removed(spark, f"{folder}/{i - 1}")
    return docs
