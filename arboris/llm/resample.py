"""Importance resampling towards a target corpus by hashed n-grams.

A text's features are its words and pairs of neighbouring words, each in one of BUCKETS buckets by crc32. What a
bucket gains is the logarithm of its share in the target over its share in the corpus, in thousandths; a text's
weight is the floored mean gain of its features. A draw without replacement takes the documents of highest weight
plus Gumbel noise.

Equal texts are collapsed first: documents are grouped by their full text, which partial counts in every task make
cheap for a text that holds a third of all rows. Features are computed once for each distinct text and staged;
bucket counts are multiplied by the text's copies; the weight is computed from the staged features and joined back
to the documents by the text's digest, before each adds the noise of its own id. The order of the draw is found by
ranges: rows are dealt by ranges of score and id, sorted within, and a range's numbers start after the rows before it.

The driver gets the counts of BUCKETS buckets and of each range, no rows of documents.

Defined results: a null text is the empty text, without features, of weight 0; documents with few words get weight
and score but no rank; a null id is hashed as an empty one and comes last among ties; rows that repeat an id have its
noise; very long texts are read whole; an empty target or corpus only smooths the shares; an empty table gives no
rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arboris.llm.common import small_batches, staged, text_blocks

#: Buckets of features, thousandths of a logarithm, and the range of the hash behind the noise.
BUCKETS, UNIT, HASHES = 10_000, 1000, 4_294_967_296
#: Words are runs of digits, small letters and anything that isn't ASCII, after A-Z are lowered: in UTF-8, of these bytes.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def buckets(text: str) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its words and pairs of words."""
    words = _WORDS.findall(text.encode("utf-8", "replace").lower())  # of bytes: lowers A-Z only
    one = list(map(crc32, words))
    two = map(crc32, [b" " + w for w in words[1:]], one)  # a pair's checksum goes on from its first word's
    return len(words), (np.array([*one, *two], np.uint32) % BUCKETS).astype("<u2")


def distinct_features(df: DataFrame, text: str = "text") -> DataFrame:
    """digest, copies, n_words, n_features and buckets (two bytes each) of each distinct text of ``df``, staged."""
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    rows = texts.select(digest(F.col("text")).alias("digest"), "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end, own in text_blocks(b.column(2)):
                made = [buckets(x) for x in own]
                keep = [b.column(i).slice(start, end - start) for i in range(2)]
                words, n = [w for w, _ in made], [len(x) for _, x in made]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for _, x in made], pa.binary())],
                    ["digest", "copies", "n_words", "n_features", "buckets"],
                )

    return staged(small_batches(rows).mapInArrow(run, "digest binary, copies long, n_words long, n_features long, buckets binary"), "features")


def digest(text: Column) -> Column:
    """What stands for a full text where it is joined back."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _flat(column: pa.Array) -> np.ndarray:
    """The buckets of some texts in one array."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2")


def bucket_counts(features: DataFrame) -> list[int]:
    """How often each bucket occurs in a corpus, copies counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            times = np.repeat(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
            np.add.at(total, _flat(b.column(2)), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = [0] * BUCKETS
    rows = small_batches(features.select("copies", "n_features", "buckets")).mapInArrow(run, "bucket int, n long")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """What each bucket gains by its share in the target over that in the corpus, both smoothed by one."""
    s_all, t_all = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return np.array([math.floor(UNIT * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)], np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """digest, n_words, n_features and weight of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy(zero_copy_only=False)
            upto = np.concatenate(([0], np.cumsum(gain[_flat(b.column(3))])))
            ends = np.cumsum(n)
            mean = (upto[ends] - upto[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(mean, pa.int64())], ["digest", "n_words", "n_features", "weight"])

    return small_batches(features.select("digest", "n_words", "n_features", "buckets")).mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a document, in thousandths, floored, from its id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-UNIT * F.log(-F.log((h + F.lit(0.5)) / F.lit(float(HASHES)))))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 1, in the whole order, which must tell any two rows apart. Staged."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number of a row within its range stands below bit 33, that of the range above
    dealt = staged(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in dealt.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each range
    before, starts = 0, []
    for p, rows in counts:
        starts.append((p, before))
        before += rows
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "p long, _before long"))
    return dealt.join(offsets, part == F.col("p")).select(*df.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key``, n_features, weight, score and rank of every document; rank is null for those that aren't drawn.

    ``percent`` of the documents of ``least_words`` words or more are drawn."""
    features = distinct_features(docs, text)
    gain = gains(bucket_counts(features), bucket_counts(distinct_features(target, target_text)))
    rows = docs.select(F.col(key).alias("key"), digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    scored = rows.join(weights(features, gain), "digest").select("key", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("key"), seed)).alias("score"))
    scored = staged(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    drawn = scored.where(fit).count() * percent // 100
    placed = ranked(scored.where(fit), [F.desc("score"), F.asc_nulls_last("key"), F.asc("_row")], "place")
    out = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True)
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
