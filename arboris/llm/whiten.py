"""Whitening of embeddings from an exact integer scatter matrix.

Every entry c of a vector becomes the integer x = floor(64 c) + SHIFT. The fit list is each distinct vector of
integers once. Tasks subtract the shift and accumulate sums and cross-products X'X without rounding: entries are
split into limbs of 20 bits, so that a block's products are exact in doubles, and the blocks' products are added
as integers of any size. What leaves a task is those integers in limbs of 32 bits, which Spark adds up as longs.
The driver, who gets (d + 1) (d + 2) / 2 numbers for vectors of d entries, forms n X'X - S S' exactly, divides
by n² only then, and decomposes by ``eigh``. Every row is then projected, n x - S being integers too.

The fit list is staged in the shared folder: it is read once for the scatter and once to measure the covariance
of what comes out.

Defined results: vectors that are null or hold null or non-finite entries take no part; neither do vectors of another
length than most distinct ones have (the longer of two as frequent). Entries beyond a long's range count as its ends.
Repeated vectors count once for the fit and get a row each; null keys are keys. Components whose eigenvalue is within
rounding of zero can't be whitened and don't exist, so equal vectors or a single one give no rows, and an empty table
none. ``deviation`` is null where it has over 38 digits. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arboris.llm.common import small_batches, staged

#: What an entry is multiplied by before it is floored, and what is added.
SCALE, SHIFT = 64, 1_000_000
#: Bits of a limb of an entry, and rows whose products of such limbs are exact in doubles.
BITS, BLOCK = 20, 1 << 12
#: Products of blocks that fit in longs before they are added to larger integers.
BLOCKS = 512
#: Limbs of 32 bits of a sum that leaves a task: squares of longs of 2^63 rows.
LIMBS = 6


def integers(df: DataFrame, vector: str) -> DataFrame:
    """``df`` without the vectors that take no part, and with ``vector`` as longs."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    rows = df.where(F.col(vector).isNotNull() & finite)
    # the sum is by halves, as the ends of long have no room for the shift
    return rows.withColumn(vector, F.transform(vector, lambda c: F.least(F.floor(c.cast("double") * SCALE), F.lit((1 << 63) - 1 - SHIFT)) + F.lit(SHIFT)))


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Columns of longs as doubles of BITS bits each, least first, the last with the sign."""
    out = []
    while x.size and (int(x.max()) >= 1 << BITS or int(x.min()) <= -1 << BITS):
        out.append((x & ((1 << BITS) - 1)).astype(float))
        x = x >> BITS
    return [*out, x.astype(float)]


class Scatter:
    """Exact sums of products of the columns of blocks of longs."""

    def __init__(self, width: int):
        self.total = np.zeros((width, width), object)
        self.held: dict[int, np.ndarray] = {}
        self.blocks = 0

    def add(self, x: np.ndarray) -> None:
        for start in range(0, len(x), BLOCK):
            parts = limbs(x[start : start + BLOCK])
            for a, left in enumerate(parts):
                for b, right in enumerate(parts):
                    product = (left.T @ right).astype(np.int64)
                    held = self.held.setdefault((a + b) * BITS, np.zeros_like(product))
                    held += product
            self.blocks += 1
            if self.blocks == BLOCKS:
                self.flush()

    def flush(self) -> np.ndarray:
        for shift, held in self.held.items():
            self.total = self.total + held.astype(object) * (1 << shift)
        self.held, self.blocks = {}, 0
        return self.total


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scatter(vectors: DataFrame, d: int, shift: int = SHIFT) -> tuple[int, list[int], list[list[int]]]:
    """n, S and X'X, exact, of a table of one column of vectors of d longs, with ``shift`` subtracted."""
    names = ["i", "j", *(f"l{k}" for k in range(LIMBS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Scatter(d + 1), False
        for b in batches:
            x = _matrix(b.column(0), d) - shift
            seen |= len(x) > 0
            own.add(np.hstack([x, np.ones((len(x), 1), np.int64)]))  # the column of ones gives S and n
        if not seen:
            return
        total = own.flush()
        i, j = np.triu_indices(d + 1)
        values, columns = total[i, j], []
        for k in range(LIMBS):
            last = k == LIMBS - 1
            columns.append(pa.array((values if last else values & 0xFFFFFFFF).tolist(), pa.int64()))
            values = values >> 32
        for start in range(0, len(i), 1 << 15):
            rows = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *columns]
            yield pa.RecordBatch.from_arrays([c.slice(start, 1 << 15) for c in rows], names)

    kind = ", ".join(["i int", "j int", *(f"l{k} long" for k in range(LIMBS))])
    parts = small_batches(vectors).mapInArrow(run, kind)
    full = np.zeros((d + 1, d + 1), object)
    for r in parts.groupBy("i", "j").agg(*(F.sum(n).alias(n) for n in names[2:])).collect():  # one row for each two entries of a vector
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = sum(r[n] << 32 * k for k, n in enumerate(names[2:]))
    return int(full[d, d]), full[d, :d].tolist(), full[:d, :d].tolist()


class Model:
    """Mean and components of a fit list: n, S (of what the shift leaves), eigenvalues and eigenvectors by falling eigenvalue."""

    def __init__(self, n: int, sums: list[int], products: list[list[int]], components: int):
        d = len(sums)
        self.n, self.sums = n, sums
        exact = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
        square = max(1, n * n)
        cov = np.array([[c / square for c in row] for row in exact]).reshape(d, d)  # integers divided: rounded once
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        trace = sum(exact[i][i] for i in range(d)) / square
        real = values > d * np.finfo(float).eps * max(values[:1].tolist() + [0.0])
        self.values = values[real][:components]
        self.vectors = vectors[:, real][:, :components]
        self.explained = self.values / trace if len(self.values) else self.values

    def project(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The sum of (n x - S)² of each row, exact, and the row whitened."""
        most = max(abs(int(v)) for v in (x.max(), x.min())) if x.size else 0
        wide = self.n * most + max(map(abs, self.sums), default=0)
        own = x.astype(object) if wide >= 1 << 62 else x
        away = own * self.n - np.array(self.sums, own.dtype)
        squares = away.astype(object) if len(self.sums) * wide * wide >= 1 << 62 else away
        white = (away.astype(float) / self.n) @ self.vectors / np.sqrt(self.values)
        return (squares * squares).sum(axis=1).tolist(), white


def identity_error(vectors: DataFrame, model: Model, shift: int = SHIFT) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, as measured."""
    d, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            y = model.project(_matrix(b.column(0), d) - shift)[1]
            y = np.hstack([y, np.ones((len(y), 1))])
            total += y.T @ y
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    full = np.zeros((k + 1, k + 1))
    for r in small_batches(vectors).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["v"]
    mean = full[k, :k] / model.n
    return float(np.abs(full[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def fit_list(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Each distinct vector of integers once, staged, and how many entries they have."""
    every = staged(integers(df.select(vector), vector).distinct(), "whiten")
    most = every.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = most["d"] if most else 0
    return every.where(F.size(vector) == d), d


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """``key``, component (from 1), n, deviation, whitened, explained and identity_error of every row and component."""
    fit, d = fit_list(df, vector)
    n, sums, products = scatter(fit, d) if d else (0, [], [])
    model = Model(n, sums, products, components)
    k = len(model.values)
    error = identity_error(fit, model) if k else 0.0
    rows = integers(df.select(F.col(key), F.col(vector).alias("_vector")), "_vector").where((F.size("_vector") == d) & F.lit(k > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away, white = model.project(_matrix(b.column(1), d) - SHIFT)
            exact = pa.array([str(a) if a < 10**38 else None for a in away], pa.string())
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1, dtype=np.int32) * k), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), exact, flat], ["key", "deviation", "white"])

    out = small_batches(rows).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, deviation string, white array<double>")
    share = F.array(*(F.lit(float(e)) for e in model.explained)) if k else F.array().cast("array<double>")
    return out.select("key", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
