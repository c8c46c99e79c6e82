"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Terms are hashed trigrams of lower-cased characters (what is said), trigrams of
character kinds (lower case, upper case, digit, each common mark, ...: how it is
written) and the share of words that repeat the word before them (how much is
said), weighted by log frequency and rarity. A singular value
decomposition of the labelled sample gives the latent space. The labelled
vectors are broadcast; every document's cosine with every one of them is
computed exactly, in blocks, and the nearest vote with their similarity.

The sample holds at most ``per_label`` documents of each label, so what is
broadcast has a fixed bound: ``2 * per_label * dims`` floats and
``FEATURES * dims`` for the projection.

Defined results: null and empty texts share one feature vector (zero); they, and
all rows where nothing could be learnt, get the share of label 1 in the sample
(0.5 without one); ties between neighbours go to the earlier sample row;
repeated rows get equal scores. Of contradicting labels of a document the lower
counts; null labels do not count.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arboris.llm.common import small_batches, text_blocks
from arboris.llm.langid import trigrams

_MARKS = ".,!?#$%&*|'\"-:;@/()"
KINDS = 7 + len(_MARKS)
#: Hashed character trigrams, and levels of repetition.
GRAMS, LEVELS = 4096, 16
FEATURES = KINDS**3 + GRAMS + LEVELS


def _kind_table() -> np.ndarray:
    """Kind of each code point below 65536: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 control, then marks."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        g = unicodedata.category(chr(c))
        out[c] = {"Ll": 1, "Lo": 1, "Lm": 1, "Lu": 2, "Lt": 2, "Nd": 3, "Zs": 4, "Cc": 6}.get(g, 0)
    out[[10, 13, 0x2028, 0x2029]] = 5
    out[9] = 4
    for i, c in enumerate(_MARKS):
        out[ord(c)] = 7 + i
    return out


_kinds: np.ndarray | None = None


def features(texts: list[str]) -> np.ndarray:
    """Counts of terms: texts by FEATURES."""
    return np.concatenate([_written(texts), _said(texts), _repeated(texts)], 1)


def _said(texts: list[str]) -> np.ndarray:
    bucket, owner = trigrams(texts)
    return np.bincount(owner * GRAMS + bucket % GRAMS, minlength=len(texts) * GRAMS).reshape(len(texts), GRAMS).astype(np.float32)


def _repeated(texts: list[str]) -> np.ndarray:
    """A text of four words or more has one term, its level of repetition, as often as it has words."""
    out = np.zeros((len(texts), LEVELS), np.float32)
    for i, text in enumerate(texts):
        w = text.split()
        if len(w) >= 4:
            out[i, min(LEVELS - 1, LEVELS * sum(map(eq, w, w[1:])) // (len(w) - 1))] = len(w)
    return out


def _written(texts: list[str]) -> np.ndarray:
    global _kinds
    if _kinds is None:
        _kinds = _kind_table()
    size = KINDS**3
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    kind = np.where(cps < 1 << 16, _kinds[np.minimum(cps, (1 << 16) - 1)], 0)
    if len(kind) < 3:
        return np.zeros((len(texts), size), np.float32)
    gram = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
    inside = owner[:-2] == owner[2:]
    return np.bincount(owner[:-2][inside] * size + gram[inside], minlength=len(texts) * size).reshape(len(texts), size).astype(np.float32)


class Model:
    """Projection into the latent space, the sample's unit vectors there, and its labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dims: int, used: np.ndarray | None = None):
        """counts: texts by terms; all of them, or those in ``used``, which stand in two texts at least."""
        n = len(labels)
        self.labels = labels.astype(np.float64)
        self.prior = float(self.labels.mean()) if n else 0.5
        if used is None:
            used = np.flatnonzero((counts > 0).sum(0) >= 2) if n else np.zeros(0, int)
            counts = counts[:, used]
        self.used = used
        if n == 0 or not len(self.used):
            self.vectors = np.zeros((0, 1), np.float32)
            return
        x = counts
        self.rarity = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
        x = self._weigh(x)
        w, u = np.linalg.eigh(x @ x.T)
        top = np.argsort(-w)[: min(dims, n)]
        top = top[w[top] > 1e-6 * max(w.max(), 1e-9)]
        self.project = (x.T @ (u[:, top] / np.sqrt(w[top]))).astype(np.float32)
        self.vectors = self._unit(x @ self.project)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(x) * self.rarity)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray, k: int) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(counts), self.prior)
        v = self._weigh(counts[:, self.used]) @ self.project
        cos = self._unit(v) @ self.vectors.T
        k = min(k, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
        weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 4
        total = weight.sum(1)
        vote = (weight * self.labels[near]).sum(1)
        return np.where(total > 0, vote / np.maximum(total, 1e-12), self.prior).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 800, dims: int = 64) -> Model:
    """Learn from the labelled ``docs``: ``labels`` (doc_id, quality) names the rows it may use."""
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picks = [one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for q in (0, 1)]
    chosen = picks[0].unionAll(picks[1])  # at most 2 * per_label rows
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for x in b.column(2).to_pylist():
                c = features([x or ""])[0]
                at.append(np.flatnonzero(c).astype(np.int32))
                n.append(c[at[-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["doc_id", "quality", "at", "n"])

    got = small_batches(rows).mapInArrow(run, "doc_id long, quality int, at array<int>, n array<float>").toPandas()
    every = [(r.doc_id, r.quality, np.asarray(r.at, np.int32), np.asarray(r.n, np.float32)) for r in got.itertuples(index=False)]
    # of an id's rows the one with most terms, then the first by its terms, whatever order they come in
    every.sort(key=lambda r: (r[0], -len(r[2]), r[2].tobytes(), r[3].tobytes()))
    rows = [r for i, r in enumerate(every) if i == 0 or r[0] != every[i - 1][0]]
    found = np.bincount(np.concatenate([np.zeros(0, np.int32), *(at for _, _, at, _ in rows)]), minlength=FEATURES)
    used = np.flatnonzero(found >= 2)
    counts = np.zeros((len(rows), len(used)), np.float32)
    for i, (_, _, at, n) in enumerate(rows):
        held = found[at] >= 2
        counts[i, np.searchsorted(used, at[held])] = n[held]
    return Model(counts, np.array([r[1] for r in rows], np.float64), dims, used)


def predict(docs: DataFrame, model: Model, k: int = 15, name: str = "score") -> DataFrame:
    """``docs`` with score: the share of the vote for label 1. A column of ``docs`` of that ``name`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [np.zeros(0)]
            for _, _, raw in text_blocks(b.column("text")):
                texts = [x or "" for x in raw]
                for a in range(0, len(texts), 128):
                    scores.append(shared.value.score(features(texts[a : a + 128]), k))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(np.concatenate(scores))], [*(f.name for f in keep), name])

    return small_batches(docs).mapInArrow(run, T.StructType([*keep, T.StructField(name, T.DoubleType())]))
