"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the shared folder and rereads for the next one. All but the
last return the columns of ``documents``, whatever these are called.

Defined results: documents without a letter (null and empty texts too) go in the
first stage; null doc_id, lang and source are values like others; of rows that
repeat a document one stays, in the third stage; of equal documents the one of
the smallest doc_id stays; very long texts are read whole; extra columns pass
through the first four stages and a column of any name is kept; an empty table
gives an empty table at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arboris.llm import bpe, langid, mixing, neardup, quality
from arboris.llm.common import fresh, held_out, shared_dir, table

#: A document goes if its foremost language has less than this share of it.
LEAST_SHARE = 0.5
#: A document goes if its score for good quality is below this.
LEAST_QUALITY = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a language of which they hold at least LEAST_SHARE."""
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    pred, score, _ = names = tuple(fresh(docs, x) for x in ("_lang_pred", "_score", "_languages"))
    out = langid.predict(docs, model, names=names).where((F.col(pred) != "und") & (F.col(score) >= LEAST_SHARE))
    return out.select(*docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours take to be good."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    score = fresh(docs, "_score")
    out = quality.predict(docs, quality.fit(docs, labels), name=score)
    return out.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def by_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and pass over its source, with the words taken in that pass."""
    return mixing.Mix(docs).texts()


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of each text of the mix."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, str(path), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", by_language),
    ("quality_classifier", by_quality),
    ("minhash_near_dedup", by_group),
    ("source_mix", mixed),
    ("byte_level_bpe", tokens),
]

#: SQL has neither the mixture inference nor the classifier; ``tests/llm`` hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
