"""Near-duplicate documents by a signature-coordinate inverted join.

Every distinct set of word shingles gets a MinHash signature of ``K`` values. A
set is posted under coordinate-value pairs, and sets that meet under a pair are
candidates; those that agree in at least ``MATCHES`` coordinates are compared
in full, and linked if 100 * intersection >= 75 * union.

* Prefix: two sets that agree in MATCHES coordinates share one of the
  ``K - MATCHES + 1`` rarest pairs of each (in one order for all, by how often
  pairs of a bucket occur), so only those are posted. A passage that many
  documents share is common, and stays out of the prefix.
* Skip: under a pair every set is first joined with one leader only, which is
  linear; each pair has a leader of its own, so a set meets up to a prefix of
  them. Links found so make components, and only sets of different components
  that still meet under a pair are compared further: under a pair with few sets
  by a join, under a crowded one in blocks of sets. Nothing within a component
  needs that, and no group emits all its pairs.
* Blocks: a task gets the whole sets of two blocks, each once, and counts what
  every two of them have in common: hashes that many sets of the blocks hold by a
  product of their 0/1 columns, others by the pairs of their few holders. What
  leaves it is a spanning forest of the links, no more rows than sets. So a family
  of long texts just below the threshold costs the bytes of its sets for each two
  blocks, and no pair of it is sent anywhere.
* Equal sets are one class from the start, whatever their number.

A pair of similarity 0.75 agrees in 48 of 64 coordinates on average, with a
standard deviation of 3.5; MATCHES is more than five of these below.

Defined results: a text without words, or null, has no shingles and is alone;
fewer than five words are one shingle; rows of equal doc_id are one node; a null
doc_id can't represent a group, and its row is kept unless a row with an id has the same set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arboris.llm.common import fresh, give_back, small_batches, staged, text_blocks

K = 64
MATCHES = 30
SHINGLE = 5
_PREFIX = K - MATCHES + 1
#: Sets under a pair from which it is compared in blocks, and how many sets, of how many bytes, a block has.
CROWD = 64
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Sets of two blocks from which a hash that they hold is counted by the product, and columns of one product.
DENSE, COLUMNS = 64, 2048
#: Leaders that a set is compared with in full; what they leave apart is compared across components.
LEADERS = 3

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_STEP = np.uint64(0xF1357AEA2E62A9C5)
_BACK = np.uint64(pow(0xF1357AEA2E62A9C5, -1, 2**64))
_PLACE = _rng.integers(0, 2**64, SHINGLE, np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, K, np.uint64)
_MUL = _rng.integers(0, 2**64, K, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        up, down = np.full(n, _STEP), np.full(n, _BACK)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    b = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    space = _SPACE[b]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(b))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])))
    word = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(x) + 1 for x in raw])
    doc = np.searchsorted(bounds, starts, side="right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = len(word)
    shingle = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        shingle[: max(0, n - SHINGLE + 1)] += word[k : n - SHINGLE + 1 + k] * _PLACE[k] if n >= SHINGLE else np.uint64(0)
    shingle = _mix(shingle)
    out = []
    for a, e in zip(first[:-1], first[1:]):
        if e - a >= SHINGLE:
            out.append(np.unique(shingle[a : e - SHINGLE + 1]))
        elif e > a:
            out.append(_mix(np.sum(word[a:e] * _PLACE[: e - a], keepdims=True) + np.uint64(e - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K values of 32 bits for each non-empty set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    every = np.concatenate(sets)
    out = np.empty((len(sets), K), np.int32)
    for k in range(K):
        least = np.minimum.reduceat((every ^ _XOR[k]) * _MUL[k], starts)
        out[:, k] = (_mix(least + np.uint64(k)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's identity in two numbers, its signature (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sig = [], [], [], []
            for _, _, texts in text_blocks(b.column(1)):
                sets = shingle_sets(texts)
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                for s in sets:
                    n.append(len(s))
                    one.append(int(np.sum(_mix(s + np.uint64(1)), dtype=np.uint64).view(np.int64)))
                    two.append(int(np.sum(_mix(s ^ _XOR[0]), dtype=np.uint64).view(np.int64)))
                    sig.append(next(rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "c1", "c2", "sig"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, c1 long, c2 long, sig array<int>"
    )


def _postings(reps: DataFrame, rank: np.ndarray) -> DataFrame:
    """Each set under its rarest coordinate-value pairs: pair, doc_id, n. ``rank``: of each bucket, by how often its pairs occur."""
    shared = reps.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(K, dtype=np.int64) << 32
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(2).flatten().to_numpy().reshape(-1, K).view(np.uint32).astype(np.int64)
            by_rarity = (shared.value[v & (len(shared.value) - 1)].astype(np.int64) << 40) | coordinate | v
            by_rarity = np.partition(by_rarity, _PREFIX - 1, axis=1)[:, :_PREFIX]
            rows = np.repeat(np.arange(len(v)), _PREFIX)
            yield pa.RecordBatch.from_arrays(
                [pa.array((by_rarity & ((1 << 40) - 1)).ravel()), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], ["pair", "doc_id", "n"]
            )

    return small_batches(reps).select("doc_id", "n", "sig").mapInArrow(run, "pair long, doc_id long, n long")


def _alike(a: str, b: str):
    """Whether two sets of these sizes can have a similarity of 0.75."""
    return (F.col(a) * 4 >= F.col(b) * 3) & (F.col(b) * 4 >= F.col(a) * 3)


def _matching(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose signatures agree often enough, with the number of matches."""
    left = reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b"))
    both = pairs.join(right, "b").join(left, "a").where(_alike("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                same = (x.column(2).flatten().to_numpy().reshape(-1, K) == x.column(3).flatten().to_numpy().reshape(-1, K)).sum(1)
                good = np.flatnonzero(same >= MATCHES)
                yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(good)), x.column(1).take(pa.array(good)), pa.array(same[good].astype(np.int32))], ["a", "b", "matches"])

    return small_batches(both).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, matches int")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and its whole set as bytes, each once, for the ids in ``wanted`` and few others: a bit map, by hash
    of the id, says which texts are shingled again. Its size follows the number of ids, up to 16 MB."""
    n = wanted.count()
    bits_held = 1 << min(max(22, (8 * n).bit_length()), 27)
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(bits_held))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("spot").cast("int").bitwiseAND(63))
    words = wanted.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    bits = np.zeros(bits_held // 64, np.int64)
    got = words.toArrow()  # at most bits_held / 64 rows
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).to_numpy()
            b = b.take(pa.array(np.flatnonzero((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))))
            for i, j, texts in text_blocks(b.column(2)):
                sets = shingle_sets(texts)
                same = [int(np.sum(_mix(s + np.uint64(1)), dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(same, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "same", "items"])

    whole = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = small_batches(whole).select("doc_id", spot.alias("spot"), "text").mapInArrow(run, "doc_id long, same long, items binary")
    # a row that repeats another must not multiply the pairs it is in; the joins that follow are by doc_id too
    return sets.repartition("doc_id").dropDuplicates(["doc_id", "same"]).drop("same")


def similar_enough(common: int, a: int, b: int) -> bool:
    return 100 * common >= 75 * (a + b - common) > 0


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough."""
    ends = pairs.select("a").union(pairs.select("b")).select(F.col("a").alias("doc_id"))
    sets = _sets(docs, ends)
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("items_b")), "b")
    both = both.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("items_a")), "a").select("a", "b", "items_a", "items_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            good = []
            for i, (p, q) in enumerate(zip(x.column(2), x.column(3))):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                if similar_enough(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([x.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], ["a", "b"])
            give_back()

    return small_batches(both).mapInArrow(run, "a long, b long")


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes every two of some sorted sets have in common."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    every = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((starts, [len(every)])))
    # columns that many sets have, some at a time
    dense = np.flatnonzero(size >= DENSE)
    for at in range(0, len(dense), COLUMNS):
        own = dense[at : at + COLUMNS]
        block = np.zeros((m, len(own)), np.float32)
        rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[own], size[own])])
        block[owner[rows], np.repeat(np.arange(len(own)), size[own])] = 1
        out += block @ block.T  # counts of far less than 2^24 are exact
    # the others by pairs of holders, those of one number of holders together
    few, held = (size > 1) & (size < DENSE), []
    for n in np.unique(size[few]).tolist():
        holders = owner[starts[few & (size == n)][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        for part in np.array_split(holders, -(-holders.size * n // (1 << 22))):
            held.append((part[:, i] * m + part[:, j]).ravel())  # a hash's holders ascend
            if sum(map(len, held)) > 1 << 22:
                out += np.bincount(np.concatenate(held), minlength=m * m).reshape(m, m).astype(np.float32)
                held = []
    if held:
        out += np.bincount(np.concatenate(held), minlength=m * m).reshape(m, m).astype(np.float32)
    return np.maximum(out, out.T)


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Which of some links between ``n`` nodes join parts that those before them haven't."""
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
        i, j = top(i), top(j)
        if i != j:
            parent[i] = j
            keep.append(k)
    return np.array(keep, np.int64)


def links_across(comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a spanning forest of the links across components, i before ``start`` and j from it on (all i < j if start is 0)."""
    n = np.array([len(x) for x in sets], np.int64)
    both = in_common(sets).astype(np.int64)
    good = np.triu(100 * both >= 75 * (n[:, None] + n[None, :] - both), 1) & (comp[:, None] != comp[None, :])
    if start:
        good[start:] = False
        good[:, :start] = False
    i, j = np.nonzero(good)
    agree = np.concatenate([(sig[i[k : k + 65_536]] == sig[j[k : k + 65_536]]).sum(1) for k in range(0, len(i), 65_536)]) if len(i) else np.zeros(0, np.int64)
    i, j = i[agree >= MATCHES], j[agree >= MATCHES]
    keep = forest(i, j, len(n))
    return i[keep], j[keep]


def _across_crowds(crowds: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join the components that meet under crowded pairs, as ``links_across`` finds them.
    ``crowds``: pair, doc_id, c. Pairs that share sets make a crowd, which is compared in blocks once."""
    firsts = crowds.groupBy("pair").agg(F.min("doc_id").alias("b"))
    edges = crowds.join(firsts, "pair").select(F.col("doc_id").alias("a"), "b")
    crowd = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("crowd"))
    members = staged(crowds.select("doc_id", "c").distinct().join(crowd, "doc_id").join(reps, "doc_id"), "crowds")
    blocks = members.groupBy("crowd").agg(F.ceil(F.greatest(F.sum(8 * F.col("n")) / BLOCK_BYTES, F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks"))
    full = members.join(blocks, "crowd").join(_sets(docs, members).dropDuplicates(["doc_id"]), "doc_id")
    full = full.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cell = F.transform(others, lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = full.withColumn("cell", F.explode(cell)).select("crowd", "cell.i", "cell.j", "block", "doc_id", "c", "sig", "items")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("doc_id", "ascending")])
        ids, block = group.column("doc_id").to_numpy(), group.column("block").to_numpy()
        first, second = key[1].as_py(), key[2].as_py()
        start = 0 if first == second else int((block == first).sum())
        left = right = np.zeros(0, np.int64)
        if first == second or 0 < start < len(ids):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("items")]
            sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, K)
            left, right = links_across(group.column("c").to_numpy(), sig, sets, start)
            del sets, sig
        give_back()
        return pa.table([pa.array(np.minimum(ids[left], ids[right])), pa.array(np.maximum(ids[left], ids[right]))], ["a", "b"])

    return dealt.groupBy("crowd", "i", "j").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest member) of all ends of ``links`` (a, b), by alternating
    star operations: neighbours larger than a node move to the smallest neighbour, then all
    others do, until nothing moves. Each round is written to the shared folder."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state or not now["n"]:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to) and kept, per document."""
    profiles = staged(_profiles(docs), "profiles")
    full = profiles.where("n_shingles > 0")
    # equal sets have equal signatures: one row of a class stands for all, whatever their number
    classes = staged(full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig")), "classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "n", "sig")
    classes = classes.select("c1", "c2", "rep")

    # buckets follow the number of sets, up to 4 MB of ranks, so that they can tell rare pairs from common ones
    buckets = 1 << min(max(16, reps.count().bit_length()), 20)
    counts = np.zeros(buckets, np.int64)
    seen = reps.select(F.explode("sig").alias("v")).groupBy(F.col("v").bitwiseAND(buckets - 1).alias("bucket")).count()
    got = seen.toArrow()  # at most ``buckets`` rows
    counts[got.column("bucket").to_numpy()] = got.column("count").to_numpy()
    rank = np.empty(buckets, np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(buckets)
    postings = _postings(reps, rank)

    # every set with one leader under each pair
    order = F.xxhash64("pair", "doc_id")
    leaders = postings.groupBy("pair").agg(F.min_by("doc_id", order).alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").select("pair", "a")
    met = postings.join(leaders, "pair").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    stars = staged(_matching(met, reps), "stars")
    # the likeliest LEADERS of each set are compared in full
    nearest = Window.partitionBy("b").orderBy(F.desc("matches"), "a")
    best = stars.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= LEADERS)
    best = staged(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    links = staged(_confirmed(best, docs), "links")
    at = staged(components(links), "components")

    def label(df: DataFrame, column: str, name: str) -> DataFrame:
        named = at.select(F.col("node").alias(column), F.col("component").alias("_c"))
        return df.join(named, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")

    # sets of different components that meet under a pair
    placed = label(postings, "doc_id", "c")
    mixed = placed.groupBy("pair").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high").select("pair", "m")
    rest = staged(placed.join(mixed, "pair"), "rest")
    few = rest.where(F.col("m") <= CROWD)
    one = few.select("pair", F.col("doc_id").alias("x"), F.col("n").alias("n_x"), F.col("c").alias("c_x"))
    two = few.select("pair", F.col("doc_id").alias("y"), F.col("n").alias("n_y"), F.col("c").alias("c_y"))
    across = one.join(two, "pair").where((F.col("c_x") < F.col("c_y")) & _alike("n_x", "n_y"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    across = _matching(across, reps).select("a", "b")
    across = across.join(best, ["a", "b"], "left_anti")
    more = _confirmed(staged(across, "across"), docs)
    crowded = rest.where(F.col("m") > CROWD).select("pair", "doc_id", "c")
    if not crowded.isEmpty():
        more = more.union(_across_crowds(crowded, reps, docs))
    every = components(links.union(more))

    node = every.select(F.col("node").alias("rep"), "component")
    placed = classes.join(node, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    out = profiles.select("doc_id", "n_shingles", "c1", "c2").join(placed, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates. Rows that repeat an id count as one, and
    one of them stays; rows without an id are nodes by their text here, above all ids."""
    own = F.lit(1 << 62) + F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 61) - 1)
    node, rank = fresh(docs, "_node"), fresh(docs, "_rn")
    rows = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), own))
    groups = near_duplicates(rows.select(F.col(node).alias("doc_id"), "text"))
    kept = staged(groups.where("kept").groupBy(F.col("doc_id").alias(node)).agg(F.count(F.lit(1)).alias(rank)), "kept")
    repeated = kept.where(F.col(rank) > 1).select(node)
    if repeated.isEmpty():
        return rows.join(kept.select(node), node, "left_semi").drop(node)
    first = Window.partitionBy(node).orderBy(F.xxhash64(*docs.columns))
    one = rows.join(repeated, node, "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return rows.join(kept.where(F.col(rank) == 1).select(node), node, "left_semi").unionByName(one).drop(node)
