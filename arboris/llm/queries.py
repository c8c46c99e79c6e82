"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arboris.llm import ann, bpe, bpe_rounds, chat, html_wrapper, langid, mixing, neardup, quality, resample, sketch, warc, whiten
from arboris.llm.common import held_out, table

#: Score from which a text is predicted to be of good quality.
GOOD = 0.7


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    out = quality.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), str(path), public_tokenizers.PATTERN)


def op4_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op7_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op9_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.edited_fingerprints(table(spark, sf_dir, "documents"))


def op10_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.main_text(table(spark, sf_dir, "pages"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where a long can't hold it


def op13_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_rounds.round_trip(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_repair, op2_quality_knn, op3_byte_bpe, op4_ivf_pq, op5_warc_round_trip,
        op6_source_mix, op7_minhash_join, op8_language_mixture, op9_threshold_sketch, op10_host_wrappers,
        op11_importance_resample, op12_exact_whitening, op13_merge_rounds,
    )
}

#: SHA-1 in base 32: eight groups of twenty bits, four letters each.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = "||".join(
    f"substr('{_LETTERS}', ((CAST('0x' || substr(h, {1 + 5 * g}, 5) AS BIGINT) >> {shift}) & 31)::INT + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

ORACLE_SQL = {
    "op7_minhash_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM s),
        e AS (SELECT doc_id, unnest(sh) AS g FROM s),
        l AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
            JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
            GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
        r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node),
        m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
        SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept FROM n JOIN m ON m.node = n.doc_id""",
    "op5_warc_round_trip": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
        best AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, octet_length(encode(body)) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN best USING (h)""",
}
