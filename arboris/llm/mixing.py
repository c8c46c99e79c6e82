"""Mixing sources to target weights, in blocks of words.

The words of each source are packed, document after document, into blocks of a
fixed length. The mix is a sequence of slots, cut into output shards. Each
shard's source counts are multinomial draws, conditioned on the sources' totals
(so the mix meets its targets exactly): the shards form a binary tree, and each
shard finds its own counts by splitting the totals from the root down with
seeded multivariate hypergeometric draws, without asking any other shard. Slot
j of a source takes block perm(j), where perm runs through pseudorandom
permutations of the source's blocks, one for each pass over it; so no block is
taken an n-th time before all have been taken n - 1 times. Slots and documents
meet by joining on source and block number.

A source's target is its weight's share of all words, but at most ``cap`` times
its size; what is beyond goes to the others by weight. Sizes are numbers of
words; the catalogue of sources (one row each) is held on the driver, as the
weights are.

Defined results: null text and text without words have size 0 and are never
taken; null sources are one source, last in order; repeated rows are documents
of their own; ties within a source go by a hash of id and text; other columns
pass through ``texts`` untouched, whatever their names; an empty table gives an
empty mix; runs agree for a given seed. Draws follow one rule for any total.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arboris.llm.common import WORD, fresh, small_batches, staged

_WORDS = re.compile(WORD)


def _size() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _key(source: str, size: Column) -> Column:
    """Equal for rows of equal doc_id, source and size; never null, so that nulls in it meet."""
    return F.struct("doc_id", F.col(source).alias("source"), size.alias("size"))


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    size: int
    weight: float
    target: float
    blocks: int
    slots: int


def targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of the total size by weight, none above ``cap`` times its own size."""
    out = [0.0] * len(sizes)
    # those that reach the cap first come first
    free = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: (cap * sizes[i] / weights[i], i))
    left, weight = float(sum(sizes)), sum(weights[i] for i in free)
    for n, i in enumerate(free):
        if left * weights[i] <= cap * sizes[i] * weight:
            by = left / weight
            for j in free[n:]:
                out[j] = by * weights[j]
            break
        out[i] = float(cap * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def catalogue(sizes: list[tuple[str | None, int]], block: int, cap: float, weights: tuple[float, ...]) -> list[Source]:
    """Sources by code point, null last, with repeating weights, targets and numbers of slots."""
    rows = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    w = [weights[i % len(weights)] for i in range(len(rows))]
    goal = targets([s for _, s in rows], w, cap)
    out = []
    for i, (name, size) in enumerate(rows):
        blocks = -(-size // block)
        slots = min(round(goal[i] / size * blocks), int(cap * blocks)) if size else 0
        out.append(Source(i, name, size, w[i], goal[i], blocks, slots))
    return out


def _log_rise(x: int, d: int) -> float:
    """log((x + d)! / x!), without the cancellation that two large logarithms of factorials would bring."""
    if min(x, x + d) < 10_000:
        return math.lgamma(x + d + 1) - math.lgamma(x + 1)
    y = x + 1
    return (y + d - 0.5) * math.log1p(d / y) + d * (math.log(y) - 1) + (1 / (y + d) - 1 / y) / 12


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` things drawn from ``good`` and ``bad`` ones without replacement are good.

    By ratio of uniforms (Stadlober's bounds), with integers of any size: the same rule for ten things and for 10**15.
    """
    total = good + bad
    m, few = min(n, total - n), min(good, bad)
    if m == 0 or few == 0:
        k = 0
    else:
        p = few / total
        mean, spread = m * p, math.sqrt(m * p * (1 - p) * ((total - m) / max(total - 1, 1)) + 0.5)
        mode = (m + 1) * (few + 1) // (total + 2)
        rest = total - few - m  # of the many, what would be left if no few were drawn
        width, top = 1.7155277699214135 * spread + 0.8989161620588988, min(m, few)
        while True:
            u, v = rng.random(2)
            if u == 0:
                continue
            x = mean + 0.5 + width * (v - 0.5) / u
            if not 0 <= x < top + 1:
                continue
            k = int(x)
            if rest + k < 0:
                continue
            d = k - mode
            if 2 * math.log(u) <= -_log_rise(mode, d) - _log_rise(few - mode, -d) - _log_rise(m - mode, -d) - _log_rise(rest + mode, d):
                break
    if good > bad:
        k = m - k
    return k if m == n else good - k


def shard_counts(totals: np.ndarray, shards: int, per_shard: int, shard: int, seed: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in all shards before it. ``known`` keeps the splits for the shards that follow."""
    counts, before, low, high = [int(x) for x in totals], [0] * len(totals), 0, shards
    n = sum(counts)
    known = {} if known is None else known
    while high - low > 1:
        mid = (low + high) // 2
        if (low, high) not in known:
            if len(known) >= 256:
                known.clear()
            rng = np.random.default_rng([seed, low, high])
            left, have, part = min(n, mid * per_shard) - min(n, low * per_shard), sum(counts), []
            for c in counts:
                part.append(hypergeometric(rng, c, have - c, left))
                left, have = left - part[-1], have - c
            known[low, high] = part
        part = known[low, high]
        if shard < mid:
            counts, high = part, mid
        else:
            counts, before, low = [c - p for c, p in zip(counts, part)], [b + p for b, p in zip(before, part)], mid
    return np.array(counts, np.int64), np.array(before, np.int64)


def permuted(index: np.ndarray, n: int, seed: int, source: int, turn: np.ndarray) -> np.ndarray:
    """Images of ``index`` under pseudorandom permutations of range(n), one for each turn: a
    Feistel network on the next even number of bits, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    base = (seed * 0x9E3779B97F4A7C15 ^ (source + 1) * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1
    key = np.uint64(base) ^ (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        a, b, k = x[todo] >> np.uint64(half), x[todo] & mask, key[todo]
        for r in range(4):
            h = (b + k + np.uint64(r)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            a, b = b, a ^ ((h >> np.uint64(33)) & mask)
        x[todo] = (a << np.uint64(half)) | b
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


class Mix:
    """A mix of ``docs`` (doc_id, text, source and more): sizes, positions, slots and pieces."""

    def __init__(self, docs: DataFrame, block: int = 64, cap: float = 3, weights: tuple[float, ...] = (1, 2, 3), per_shard: int = 8192, seed: int = 7):
        self.docs, self.block, self.per_shard, self.seed = docs, block, per_shard, seed
        spark = docs.sparkSession
        sizes = docs.select("doc_id", "source", _size().alias("size"), F.xxhash64("doc_id", "text").alias("at"))
        # cells of a source, so that the running sum over a source is a sum over its cells first
        self.sizes = staged(sizes.withColumn("cell", F.pmod("at", F.lit(4096)).cast("int")), "mix-sizes")
        totals = self.sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
        self.sources = catalogue([(r["source"], r["size"]) for r in totals], block, cap, weights)
        schema = "source string, source_no int, source_size long, target double"
        self.catalogue = spark.createDataFrame([(s.name, s.number, s.size, s.target) for s in self.sources], schema)

    def positions(self) -> DataFrame:
        """Each document's first word in its source's sequence: doc_id, source_no, start, size, source_size, target."""
        cat = self.catalogue
        known = self.sizes.join(cat, self.sizes["source"].eqNullSafe(cat["source"])).drop("source")
        cells = known.groupBy("source_no", "cell").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("source_no").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select("source_no", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("source_no", "cell").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        known = known.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
        return known.join(cells, ["source_no", "cell"]).withColumn("start", F.col("base") + F.col("offset")).drop("base", "offset", "cell", "at")

    def slots(self) -> DataFrame:
        """The mix: source_no and block of each slot, in order of shard and slot.

        The optimizer knows only how few shards there are, so joins with the slots ask for a merge:
        it would take them to be small enough to broadcast.
        """
        totals = np.array([s.slots for s in self.sources], np.int64)
        blocks = [s.blocks for s in self.sources]
        n = int(totals.sum())
        shards = max(1, -(-n // self.per_shard))
        per_shard, seed = self.per_shard, self.seed
        spark = self.docs.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict = {}
            for b in batches:
                for shard in b.column(0).to_pylist():
                    counts, before = shard_counts(totals, shards, per_shard, shard, seed, known)
                    no, at = [], []
                    for s in np.flatnonzero(counts):
                        j = np.arange(before[s], before[s] + counts[s])
                        no.append(np.full(len(j), s, np.int32))
                        at.append(permuted(j % blocks[s], blocks[s], seed, int(s), j // blocks[s]))
                    no = np.concatenate(no) if no else np.zeros(0, np.int32)
                    at = np.concatenate(at) if at else np.zeros(0, np.int64)
                    order = np.random.default_rng([seed, shard, -1 % (1 << 32)]).permutation(len(no))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(no[order]), pa.array(at[order]), pa.array(np.full(len(no), shard, np.int64)), pa.array(np.arange(len(no)))],
                        ["source_no", "block", "shard", "slot"],
                    )

        tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism, 1 + n // 100_000))
        return spark.range(0, shards if n else 0, 1, tasks).mapInArrow(run, "source_no int, block long, shard long, slot long")

    def pieces(self, docs: DataFrame) -> DataFrame:
        """Parts of documents by block: source_no, start, block, from_word, words."""
        b = self.block
        first, last = F.floor(F.col("start") / b).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / b).cast("long")
        rows = docs.where("size > 0").select("source_no", "doc_id", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * b)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return rows.select("source_no", "doc_id", "start", "block", (low - F.col("start")).alias("from_word"), (high - low).alias("words"))

    def sequence(self) -> DataFrame:
        """The mix as pieces of documents in order: shard, slot, doc_id, source_no, start, block, from_word, words."""
        return self.slots().hint("merge").join(self.pieces(self.positions()), ["source_no", "block"])

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target and the words that the mix takes of it."""
        docs = self.positions()
        times = self.slots().groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
        words = self.pieces(docs).join(times.hint("merge"), ["source_no", "block"])
        words = words.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("words"))
        # a document with words is known by its source and start; one without takes none
        docs = docs.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
        got = docs.join(words.withColumnRenamed("start", "at"), ["source_no", "at"], "left")
        return got.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))

    def texts(self) -> DataFrame:
        """The mix as documents: for each document and pass over its source, a row with the words
        taken in that pass, in the columns of ``docs``. Spans that touch stay as they stand in the
        text; others are joined by a line end. Documents of which nothing is taken are gone."""
        times = self.slots().groupBy("source_no", "block").agg(F.count(F.lit(1)).cast("int").alias("times"))
        docs = self.positions()
        spans = self.pieces(docs).join(times.hint("merge"), ["source_no", "block"])
        spans = spans.select("source_no", "start", "from_word", "words", F.explode(F.sequence(F.lit(1), "times")).alias("pass"))
        span = F.struct("from_word", "words")
        per = spans.groupBy("source_no", "start", "pass").agg(F.sort_array(F.collect_list(span)).alias("spans"))
        per = per.groupBy("source_no", "start").agg(F.collect_list("spans").alias("passes"))
        # rows of equal doc_id, source and size can be cut alike: the n-th of them takes the n-th place
        cat = F.broadcast(self.catalogue.select("source_no", F.col("source").alias("_s")))
        keyed = docs.where("size > 0").join(cat, "source_no").select("source_no", "start", _key("_s", F.col("size")).alias("_key"))
        key, place, passes = (fresh(self.docs, x) for x in ("_key", "_nth", "_passes"))
        keyed = keyed.withColumnRenamed("_key", key)
        texts, by = self.docs.withColumn(key, _key("source", _size())), [key]
        if not self.sizes.where("size > 0").groupBy("doc_id", "source", "size").count().where("count > 1").isEmpty():
            nth = Window.partitionBy(key)
            keyed = keyed.withColumn(place, F.row_number().over(nth.orderBy("start")))
            texts = texts.where(F.col(key)["size"] > 0).withColumn(place, F.row_number().over(nth.orderBy(F.xxhash64(*self.docs.columns))))
            by = [key, place]
        joined = texts.join(per.join(keyed, ["source_no", "start"]).select(*by, F.col("passes").alias(passes)), by)
        names, schema = self.docs.columns, self.docs.schema

        def cut(text: str, spans: list[dict]) -> str:
            at = [m.span() for m in _WORDS.finditer(text)]
            runs: list[list[int]] = []
            for s in spans:
                a, e = s["from_word"], min(s["from_word"] + s["words"], len(at))
                if runs and runs[-1][1] == a:
                    runs[-1][1] = e
                elif a < e:
                    runs.append([a, e])
            return "\n".join(text[at[a][0] : at[e - 1][1]] for a, e in runs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                take, made = [], []
                for i, (text, turns) in enumerate(zip(b.column("text"), b.column(passes))):
                    whole = text.as_py()
                    for spans in turns.as_py():
                        take.append(i)
                        made.append(cut(whole or "", spans))
                rows = b.take(pa.array(take, pa.int64()))
                new = {"text": pa.array(made, pa.string()), "n_chars": pa.array([len(x) for x in made], pa.int64())}
                yield pa.RecordBatch.from_arrays([new.get(c, rows.column(c)) for c in names], names)

        return small_batches(joined).mapInArrow(run, T.StructType([schema[c] for c in names]))
