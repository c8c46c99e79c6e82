"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a
vocabulary entry is resolved by one hash, one displacement and one comparison.
Tier two merges the bytes of a miss: a heap holds the ranks of neighbouring
pairs, a doubly linked list holds the parts that are left.

The vocabulary is a fixed file (about 50,000 entries, 1 MB), so it is broadcast.

Defined results: a null text encodes as the empty text (no ids); a null list of
ids decodes to no bytes; an id outside the vocabulary raises ``ValueError``;
repeated rows give repeated results; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arboris.llm.common import small_batches

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
#: Resolved misses that a worker keeps, in two generations of this many entries.
CACHE_ENTRIES = 200_000


def _spot(h: int, shift: int, n: int) -> int:
    x = ((h ^ (shift * _ODD)) * 0xD6E8FEB86659FD93) & _MASK
    return (x ^ (x >> 32)) % n


class PerfectHash:
    """Minimal perfect hash by displacement: ``len(keys)`` keys on as many slots.

    Keys fall into buckets of two on average. Large buckets come first and try
    displacements until all their keys land on free slots; a bucket of one key
    takes any free slot and stores it as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.m = max(1, n // 2)
        buckets: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.m, []).append((h, i))
        self.shift = [0] * self.m
        slots = [-1] * n
        singles = []
        for b, entries in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(entries) == 1:
                singles.append((b, entries[0][1]))
                continue
            d = 0
            while True:
                d += 1
                spots = {_spot(h, d, n) for h, _ in entries}
                if len(spots) == len(entries) and all(slots[s] < 0 for s in spots):
                    break
            self.shift[b] = d
            for h, i in entries:
                slots[_spot(h, d, n)] = i
        free = (s for s in range(n) if slots[s] < 0)
        for b, i in singles:
            slots[s := next(free)] = i
            self.shift[b] = -s - 1
        self.key_at = [keys[i] for i in slots]
        self.index_at = slots

    def get(self, key: bytes) -> int:
        """Position of ``key`` in the list it was built from, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        s = -d - 1 if d < 0 else _spot(h, d, self.n)
        return self.index_at[s] if self.key_at[s] == key else -1


class Vocabulary:
    """Ranks of byte strings, as a file of base64 token and rank per line gives them."""

    def __init__(self, lines: list[bytes], pattern: str):
        pairs = sorted(((int(r), base64.b64decode(t)) for t, r in (x.split() for x in lines if x.strip())))
        self.ids = [r for r, _ in pairs]
        self.tokens = [t for _, t in pairs]
        self.hash = PerfectHash(self.tokens)
        self.pattern = pattern

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read().splitlines(), pattern)

    def rank(self, token: bytes) -> int:
        i = self.hash.get(token)
        return self.ids[i] if i >= 0 else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of ``piece`` by repeated merging of the pair of least rank, leftmost first."""
    rank = ranks.get
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here; 0: merged away
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, e = heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != e:
            continue  # one of the two has changed since
        end[i], end[mid] = e, 0
        if e < n:
            before[e] = i
            if (r := rank(piece[i : end[e]])) is not None:
                heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := rank(piece[p:e])) is not None:
            heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one worker, with a bounded memory of pre-tokens seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.token_of = dict(zip(vocabulary.ids, vocabulary.tokens))
        self.rank_of = dict(zip(vocabulary.tokens, vocabulary.ids))  # of the parts of a miss
        self.text_of = {i: str(i) for i in vocabulary.ids}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _resolve(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.vocabulary.rank(raw)
            ids = (whole,) if whole >= 0 else tuple(merged(raw, self.rank_of))
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        if len(piece) < 32:
            self.young[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        extend = out.extend
        for piece in self.find(text or ""):
            extend(self.young.get(piece) or self._resolve(piece))
        return out

    def decode(self, ids) -> bytes:
        try:
            return b"".join([self.token_of[i] for i in ids or ()])
        except KeyError as e:
            raise ValueError(f"no token has the id {e.args[0]}") from None

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join([self.text_of[i] for i in ids]).encode()).hexdigest()


_codecs: dict[str, Codec] = {}


def _codec(key: str, broadcast) -> Codec:
    """This worker's codec: it outlives the task, as the worker does."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value)
    return _codecs[key]


def _shared(df: DataFrame, path: str, pattern: str):
    vocabulary = Vocabulary.read(path, pattern)
    key = hashlib.sha256(b"\n".join(vocabulary.tokens) + pattern.encode()).hexdigest()
    return key, df.sparkSession.sparkContext.broadcast(vocabulary)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``array<int>``. ``path``: the rank file, on the driver."""
    key, shared = _shared(df, path, pattern)
    schema = T.StructType([*(f for f in df.schema if f.name != ids), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for b in batches:
            made = pa.array([codec.encode(x) for x in b.column(text).to_pylist()], pa.list_(pa.int32()))
            keep = [n for n in b.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), made], [*keep, ids])

    return small_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that each list of ids stands for."""
    key, shared = _shared(df, path, pattern)
    schema = T.StructType([*(f for f in df.schema if f.name != decoded), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for b in batches:
            made = pa.array([codec.decode(x) for x in b.column(ids).to_pylist()], pa.binary())
            keep = [n for n in b.schema.names if n != decoded]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), made], [*keep, decoded])

    return small_batches(df).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each whole text in one pass over it: number of ids, digest of the ids
    in decimal, digest of the decoded bytes. No list of ids leaves the worker."""
    name, shared = _shared(df, path, pattern)
    df = df.select(key_column, text)
    schema = T.StructType([
        df.schema[key_column], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared)
        for b in batches:
            rows = []
            for x in b.column(1):
                ids = codec.encode(x.as_py())
                rows.append((len(ids), codec.digest(ids), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, d = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], schema.names)

    return small_batches(df).mapInArrow(run, schema)
