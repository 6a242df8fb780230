"""The queries opN_<name> over the text tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learned_from(spark: SparkSession, sf_dir: str, label: str, modulus: int, out: int) -> tuple[DataFrame, DataFrame]:
    """The documents, and the labels of those that aren't held out."""
    labels = table(spark, sf_dir, "labels").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) != out)
    return table(spark, sf_dir, "documents"), labels.select("doc_id", label)


def judged(scores: DataFrame, modulus: int, out: int) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.3)."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == out
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, quality_scores

    model = fit_quality(*learned_from(spark, sf_dir, "quality", 5, 0))
    return judged(quality_scores(table(spark, sf_dir, "documents"), model), 5, 0)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op3_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("group", "text_hash")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, toxicity_scores

    model = fit_toxicity(*learned_from(spark, sf_dir, "toxic", 4, 2))
    return judged(toxicity_scores(table(spark, sf_dir, "documents"), model), 4, 2)


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import temperature_mix

    return temperature_mix(table(spark, sf_dir, "documents"), repetition=2.0)


def tokenizer_path() -> str:
    """The byte-level vocabulary that the queries use; a file outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    coded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts before and after two kinds of edits: digit runs masked, line breaks doubled."""
    from .tokencount import edited_token_counts

    return edited_token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), [(r"[0-9]+", "0"), (r"\n", "\n\n")])


def op8_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import stratified_shards

    placed = stratified_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import fit_whitening, identity_error, whiten

    vectors = table(spark, sf_dir, "embeddings")
    model = fit_whitening(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    made = whiten(vectors, model, 8)
    explained = F.array(*(F.lit(float(e / model.trace) if model.trace else 0.0) for e in model.values[:8]))
    each = made.select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, "at").alias("explained"), F.lit(identity_error(made, model)).alias("identity_error"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_pieces, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return pack_pieces(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), 2048)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import filter_interactions

    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = {
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
        c AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
        l AS (SELECT a, b FROM c WHERE isfinite(cosine) AND cosine >= 0.98),
        r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.vec_id)
        SELECT r.vec_id, any_value(coalesce(n.n, 0)) AS n_links, min(root) AS component_id, r.vec_id = min(root) AS kept
        FROM r LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = r.vec_id GROUP BY r.vec_id""",
    "op3_setsketch_near_dedup": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w),
        c AS (SELECT s, min(doc_id) AS c FROM s WHERE len(s) > 0 GROUP BY s),
        e AS (SELECT c, len(s) AS n, unnest(s) AS x FROM c),
        i AS (SELECT a.c AS a, b.c AS b, a.n + b.n - count(*) AS together, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n),
        l AS (SELECT a, b FROM i WHERE 100 * common >= 85 * together),
        r AS (SELECT c, c AS root FROM c UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.c),
        g AS (SELECT c, min(root) AS component FROM r GROUP BY c)
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
        FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN g ON g.c = c.c""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op13_filter_interactions": """
        WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
        m AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
            + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS fails FROM t),
        k AS (SELECT part, fails, doc_id IN (SELECT doc_id FROM good) AS good, doc_id IN (SELECT doc_id FROM toxic) AS toxic, count(*) AS n FROM m GROUP BY ALL),
        f AS (SELECT unnest(range(5)) AS f),
        o AS (SELECT '' AS letters, 0 AS done, 0 AS n, CAST([] AS STRUCT(step INTEGER, applied INTEGER, f BIGINT)[]) AS path
            UNION ALL SELECT letters || chr(CAST(65 + f.f AS INT)), done | CAST(1 << f.f AS INT), n + 1, list_append(path, {'step': n + 1, 'applied': done, 'f': f.f}) FROM o JOIN f ON (done >> f.f) & 1 = 0),
        p AS (SELECT letters AS filter_order, u.step, u.applied, u.f FROM (SELECT letters, unnest(path) AS u FROM o WHERE n = 5)),
        r AS (SELECT part, filter_order, CAST(step AS INT) AS step, p.f AS f,
            CAST(sum(CASE WHEN fails & (applied | (1 << p.f)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
            CAST(sum(CASE WHEN (fails >> p.f) & 1 = 1 AND fails & applied = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN (fails >> p.f) & 1 = 1 AND fails & applied <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
            CAST(sum(CASE WHEN fails = 1 << p.f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN (fails >> p.f) & 1 = 1 AND fails & applied = 0 AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
            CAST(sum(CASE WHEN (fails >> p.f) & 1 = 1 AND fails & applied = 0 AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
            FROM p CROSS JOIN k GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
}

QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_embedding_near_dedup, op3_setsketch_near_dedup, op4_toxicity, op5_temperature_mixing, op6_bpe_round_trip, op7_token_counts, op8_stratified_shards, op9_exact_dedup, op10_personal_data, op11_whitening, op12_best_fit_packing, op13_filter_interactions)
}
