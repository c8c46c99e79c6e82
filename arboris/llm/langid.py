"""Language identification by mixture inference.

A document is a mixture of languages: its character trigrams are drawn from the
trigram distributions of the languages in unknown proportions. Expectation
maximisation finds the proportions; languages are dropped one by one, rarest
first, as long as the likelihood less a charge per language does not fall.

Trigrams are hashed into ``BUCKETS`` and the buckets are grouped into at most
``CLASSES`` classes of like likelihood vectors, so the inference works on a
table of documents by classes, all documents of a block at once.

Learning: a sample of at most ``per_language`` documents per language (smallest
hash first) is scanned on the cluster; the driver gets one count per language
and bucket, whatever the size of the corpus. Prediction reads every whole text.

Defined results: null text or no letter: ``und`` with score 0; no learned
language: ``und``; ties go to the language that sorts first; repeated rows give
equal results (in learning, a repeated row counts each time); an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arboris.llm.common import small_batches, text_blocks

BUCKETS = 1 << 16
CLASSES = 256
_LETTER = regex.compile(r"\p{L}")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of each trigram; each text stands between spaces."""
    joined = [" " + x.lower() + " " for x in texts]
    cps = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in joined])
    cps = np.where((cps <= 32) | ((cps >= 48) & (cps <= 57)), np.uint32(32), cps)
    if len(cps) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    h = cps[:-2] * np.uint32(0x9E3779B1) ^ cps[1:-1] * np.uint32(0x85EBCA77) ^ cps[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    bucket = (h >> np.uint32(16)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    return bucket[inside], owner[:-2][inside]


class Model:
    """Languages, the class of each bucket, and the likelihood of each class in each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: languages by buckets."""
        self.languages = languages
        n_lang = len(languages)
        seen = np.flatnonzero(counts.sum(0) > 0) if n_lang else np.zeros(0, int)
        self.class_of = np.zeros(BUCKETS, np.uint16)  # class 0: never seen
        if not len(seen):
            self.likelihood = np.ones((1, max(n_lang, 1)))
            return
        p = (counts[:, seen] + 0.1) / (counts[:, seen].sum(1, keepdims=True) + 0.1 * len(seen))
        share = (p / p.sum(0)).T
        mass = counts[:, seen].sum(0).astype(float)
        groups = _grouped(share, mass, CLASSES - 1)
        self.class_of[seen] = groups + 1
        k = int(groups.max()) + 1
        like = np.zeros((k + 1, n_lang))
        for j in range(n_lang):
            like[1:, j] = np.bincount(groups, weights=p[j], minlength=k)
        like[0] = 1e-6  # tells nothing
        self.likelihood = like


def _grouped(points: np.ndarray, mass: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means of posterior vectors, weighted by how often each occurs."""
    order = np.lexsort(points.T[::-1])
    cum = np.cumsum(np.sqrt(mass[order]))
    picks = np.unique(order[np.searchsorted(cum, np.linspace(0, cum[-1], min(k, len(points)), endpoint=False))])
    centres = np.unique(points[picks], axis=0)
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
        total = np.bincount(near, weights=mass, minlength=len(centres))
        for j in range(points.shape[1]):
            s = np.bincount(near, weights=mass * points[:, j], minlength=len(centres))
            centres[:, j] = np.where(total > 0, s / np.maximum(total, 1e-9), centres[:, j])
    near = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, 1)
    return np.unique(near, return_inverse=True)[1]


def _em(c: np.ndarray, like: np.ndarray, active: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each row of class counts, within its active languages."""
    pi = active / active.sum(1, keepdims=True)
    n = np.maximum(c.sum(1, keepdims=True), 1)
    for _ in range(rounds):
        pi = pi * ((c / (pi @ like.T)) @ like) / n
        pi /= np.maximum(pi.sum(1, keepdims=True), 1e-300)
    return pi, (c * np.log(pi @ like.T)).sum(1)


def proportions(c: np.ndarray, like: np.ndarray, charge: float) -> np.ndarray:
    """Mixture of each row under penalised selection of its language set."""
    rows, n_lang = len(c), like.shape[1]
    active = np.ones((rows, n_lang))
    pi, ll = _em(c, like, active)
    cost = charge * np.log1p(c.sum(1))
    open_ = np.arange(rows)
    for _ in range(n_lang - 1):
        if not len(open_):
            break
        trial = active[open_].copy()
        trial[np.arange(len(open_)), np.where(trial > 0, pi[open_], np.inf).argmin(1)] = 0
        pi2, ll2 = _em(c[open_], like, trial)
        better = ll2 + cost[open_] >= ll[open_]
        kept = open_[better]
        active[kept], pi[kept], ll[kept] = trial[better], pi2[better], ll2[better]
        open_ = kept
    return pi


def fit(docs: DataFrame, per_language: int = 1500) -> Model:
    """Learn from ``docs`` (text, lang, doc_id): at most ``per_language`` texts of each language,
    those of smallest hash of doc_id, chosen through salted rankings so that a language with
    most of the rows is not ranked by one task."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        "lang", F.xxhash64("doc_id").alias("h"), "doc_id"
    )
    by = [F.col("h"), F.col("doc_id")]
    salted = Window.partitionBy("lang", F.col("h") % 16).orderBy(*by)
    ranked = rows.withColumn("rn", F.row_number().over(salted)).where(F.col("rn") <= per_language)
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(*by)))
    # the hash of the last one taken is all that the scan of the texts needs
    last = {r["lang"]: r["h"] for r in ranked.where(F.col("rn") <= per_language).groupBy("lang").agg(F.max("h").alias("h")).collect()}
    languages = sorted(last)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    limits = F.create_map(*(F.lit(x) for lang in languages for x in (lang, last[lang])))
    sample = docs.where(F.col("text").isNotNull() & (F.xxhash64("doc_id") <= limits[F.col("lang")])).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        for b in batches:
            langs = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            for i, j, texts in text_blocks(b.column(1)):
                bucket, owner = trigrams(texts)
                at, n = np.unique(langs[i:j][owner] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(n)], ["lang_no", "bucket", "n"])

    parts = small_batches(sample).mapInArrow(count, "lang_no int, bucket int, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n"))
    got = parts.toPandas()
    counts = np.zeros((len(languages), BUCKETS))
    counts[got["lang_no"], got["bucket"]] = got["n"]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, charge: float = 2.0, names: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """``docs`` with lang_pred, score (the proportion of that language), and languages: all that
    the selected set holds, with their proportions. Columns of ``docs`` that have one of these
    ``names`` are replaced; other names keep them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType().add(names[0], T.StringType()).add(names[1], T.DoubleType()).add(names[2], T.MapType(T.StringType(), T.DoubleType()))
    keep = [f for f in docs.schema if f.name not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.likelihood)
        for b in batches:
            pred, score, sets = [], [], []
            for i, j, raw in text_blocks(b.column("text")):
                texts = [x or "" for x in raw]
                bucket, owner = trigrams(texts)
                c = np.bincount(owner * k + m.class_of[bucket], minlength=(j - i) * k).reshape(j - i, k).astype(float)
                pi = proportions(c, m.likelihood, charge) if m.languages else None
                for x, text in enumerate(texts):
                    if pi is None or not _LETTER.search(text):
                        pred.append("und"), score.append(0.0), sets.append([])
                        continue
                    best = int(pi[x].argmax())
                    pred.append(m.languages[best]), score.append(min(1.0, float(pi[x, best])))
                    sets.append([(m.languages[q], float(pi[x, q])) for q in np.flatnonzero(pi[x] > 1e-6)])
            out = [*(b.column(f.name) for f in keep), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            out.append(pa.array(sets, pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(out, [*(f.name for f in keep), *added.names])

    return small_batches(docs).mapInArrow(run, T.StructType([*keep, *added]))
