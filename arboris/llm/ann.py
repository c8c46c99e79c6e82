"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of their residuals are fitted on a sample of
``sample`` vectors, or 16 a list if that is more (smallest hash of vec_id); there
are about sqrt(n) / 8 lists, and every vector is indexed.
Lists are cut into blocks of about ``block_rows`` vectors, so that a list with a
third of all vectors is many tasks' work; so are the queries that come to a
block, in chunks of about ``chunk_rows``. A query goes to the blocks of the
lists nearest to it; there an asymmetric distance table ranks all codes, and the
``shortlist`` best are scored exactly, in double precision, with the original
vectors. Their k-th score is a floor: every other vector of the block is scored
too unless its rough score and the length of what its code lost prove it to be
below, so no vector of a visited block is cut by its code. Of equal vectors in a
block only the k + 1 smallest vec_ids are scored, as others can't be in a result.
The best of all blocks are the result.

The number of lists that a query visits is calibrated, not fixed: on the sample,
as many as it takes to meet ``reach`` of the exact neighbours. Vectors in
clusters need few lists; vectors without any structure need most of them.
``tests/llm`` hold the recall against brute force over all rows above 0.9.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part; rows of equal vec_id are one
candidate (the best counts) and never their own neighbour; ties go to the
smaller vec_id; few candidates are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arboris.llm.common import small_batches, staged

_CODES = 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~odd & F.exists(e, lambda x: x != 0)).select("vec_id", "embedding")
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ c.T).argmin(1)
    return out


class Quantiser:
    """Coarse centroids and, for each slice of the dimensions, a codebook of residuals."""

    def __init__(self, sample: np.ndarray, lists: int, slices: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dims = sample.shape[1]
        self.coarse = _kmeans(sample, lists, rng)
        self.cuts = np.array_split(np.arange(self.dims), min(slices, self.dims))
        residual = sample - self.coarse[_nearest(sample, self.coarse)]
        self.books = [_kmeans(np.ascontiguousarray(residual[:, c]), _CODES, rng) for c in self.cuts]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.coarse)
        residual = x - self.coarse[at]
        return at, np.stack([_nearest(np.ascontiguousarray(residual[:, c]), b) for c, b in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def decode(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        out = self.coarse[at]
        for m, (c, b) in enumerate(zip(self.cuts, self.books)):
            out[:, c] += b[code[:, m]]
        return out

    def lists_for(self, known: np.ndarray, k: int, reach: float, queries: int = 200) -> int:
        """How many lists hold ``reach`` of the ``k`` nearest, over some of the known vectors and all of them."""
        q = known[: min(queries, len(known))]
        score = q @ known.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(known))
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        order = np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        at = _nearest(known, self.coarse)
        return int(np.quantile(np.take_along_axis(place, at[near], 1), reach, method="higher")) + 1

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Inner product of each query's slices with each code of the slice."""
        return [q[:, c] @ b.T for c, b in zip(self.cuts, self.books)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _least_copies(x: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of all vectors but those with ``n`` equal vectors of smaller ids; ``ids`` ascend."""
    group = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))
    g, i = group[order], ids[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])  # rows of equal vector and id count once
    order, g = order[new], g[new]
    return np.sort(order[np.arange(len(g)) - np.searchsorted(g, g) < n])


def search(
    vectors: DataFrame, is_query, k: int = 20, reach: float = 0.97, slices: int = 8, sample: int = 20_000, block_rows: int = 2048, chunk_rows: int = 4096, shortlist: int = 160
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row that ``is_query`` (a condition) holds for."""
    rows = usable(vectors)
    n = rows.count()
    lists = max(1, round(n**0.5 / 8))
    # as the number of lists grows, so does what they are fitted on
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(sample, 16 * lists)).select("embedding").toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(picked):
        return vectors.sparkSession.createDataFrame([], schema)
    known = np.stack(picked["embedding"].to_numpy()).astype(np.float64)
    quantiser = Quantiser(known, lists, slices)
    probes = quantiser.lists_for(known, k, reach)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, code = shared.value.encode(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), b.column(1)], ["vec_id", "list", "code", "embedding"])

    kind = dict(rows.dtypes)["embedding"]
    index = staged(small_batches(rows).mapInArrow(encode, f"vec_id long, list int, code binary, embedding {kind}"), "ivf")
    sizes = np.zeros(len(quantiser.coarse), np.int64)
    for r in index.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // block_rows))
    per_list = F.array(*(F.lit(int(x)) for x in blocks))
    held = index.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(per_list, F.col("list"))).cast("int"))

    def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Queries (by place) and the lists that each visits."""
        order = np.argsort(-(_matrix(column) @ shared.value.coarse.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], 1) - sizes[order]
        wanted = (np.arange(order.shape[1]) < probes) | (before < 8 * k)
        q, p = np.nonzero(wanted & (sizes[order] > 0))
        return q, order[q, p]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sizes), np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(lists_of(b.column(1))[1], minlength=len(sizes))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["list", "n"])

    asking = np.zeros(len(sizes), np.int64)
    for r in small_batches(rows).where(is_query).mapInArrow(tally, "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect():  # one row a list
        asking[r["list"]] = r["n"]
    chunks = np.maximum(1, -(-asking // chunk_rows))
    held = held.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(F.array(*(F.lit(int(x)) for x in chunks)), F.col("list")) - 1)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, at = lists_of(b.column(1))
            times = blocks[at]
            q, at = np.repeat(q, times), np.repeat(at, times)
            block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(q)
            ids = b.column(0).take(take)
            chunk = ((ids.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % chunks[at]
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(chunk.astype(np.int32)), b.column(1).take(take)], ["query_id", "list", "block", "chunk", "embedding"])

    asked = small_batches(rows).where(is_query).mapInArrow(route, f"query_id long, list int, block int, chunk int, embedding {kind}")

    def scan(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The best of one block for each query that comes to it."""
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            x = _matrix(left.column("embedding").combine_chunks())
            some = _least_copies(x, left.column("vec_id").to_numpy(), k + 1)
            left, x = left.take(pa.array(some)), x[some]
            ids, top = left.column("vec_id").to_numpy(), np.linalg.norm(x, axis=1).max()
            code = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
            asking = right.column("query_id").to_numpy()
            every = _matrix(right.column("embedding").combine_chunks())
            repeated = len(np.unique(ids)) < len(ids)
            lost = np.linalg.norm(x - shared.value.decode(left.column("list").to_numpy(), code), axis=1)
            short = min(shortlist, len(ids))
            for i in range(0, len(asking), 256):
                q, no = every[i : i + 256], asking[i : i + 256]
                size = np.linalg.norm(q, axis=1)
                rough = (q @ shared.value.coarse[key[0].as_py()])[:, None] + sum(t[:, code[:, m]] for m, t in enumerate(shared.value.tables(q)))
                least = np.full(len(q), -np.inf)
                if short > k and not repeated:
                    best = np.argpartition(-rough, short - 1, axis=1)[:, :short]
                    exact = np.einsum("qd,qsd->qs", q, x[best])
                    exact[ids[best] == no[:, None]] = -np.inf
                    least = np.partition(exact, short - k, axis=1)[:, short - k]
                # no score is further from its rough one than the parts lost in the codes allow
                near = rough + size[:, None] * (lost + 1e-9 * (1 + top))
                may = (near >= least[:, None]) & (ids != no[:, None])
                # a matrix product narrows them, with room for its rounding; what is left is scored pair by pair
                wide = np.flatnonzero(may.any(0))
                close = np.where(may[:, wide], q @ x[wide].T, -np.inf)
                may = close > -np.inf
                if len(wide) > k and not repeated:
                    may &= close >= np.partition(close, len(wide) - k, axis=1)[:, [len(wide) - k]] - 1e-9 * size[:, None] * (1 + top)
                at, to = np.nonzero(may)
                to = wide[to]
                score = np.empty(len(at))
                for j in range(0, len(at), 16_384):
                    score[j : j + 16_384] = np.einsum("pd,pd->p", q[at[j : j + 16_384]], x[to[j : j + 16_384]])
                order = np.lexsort((ids[to], -score, at))
                at, found, score = at[order], ids[to[order]], score[order]
                if repeated:
                    first = np.sort(np.unique(np.stack([at, found]), axis=1, return_index=True)[1])
                    at, found, score = at[first], found[first], score[first]
                real = np.arange(len(at)) - np.searchsorted(at, at) < k
                for o, v in zip(out, (no[at[real]], found[real], score[real])):
                    o.append(v)
        return pa.table([pa.array(np.concatenate(o)) for o in out], ["query_id", "vec_id", "score"])

    met = held.groupBy("list", "block", "chunk").cogroup(asked.groupBy("list", "block", "chunk")).applyInArrow(scan, "query_id long, vec_id long, score double")
    met = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
