"""BPE encoding and decoding by batched merge rounds in numpy.

The symbols of many words stand in one flat array. A round looks up every pair of
neighbours by binary search among the sorted keys of the merges, takes each
word's pair of least rank and merges all its places in all words at once; words
without a pair leave the array. The number of rounds is that of the longest
word's merges, not of the words.

A word of more than LONG symbols would keep a round busy for each of its merges,
so such words go through the flat array in order of ranks: the places of a rank
are merged together, those of new pairs join the places of their ranks. As a
merge makes pairs of higher ranks only (checked when a vocabulary is read), both
orders give the same symbols.

The vocabulary is a file of the tokenizers library with a byte-level model: text
is cut at added tokens, then by the byte-level pattern, and words are bytes. It
has a fixed size, so it is broadcast. A file that asks for anything else
(a normalizer, dropout, prefixes, tokens that strip space) raises ``ValueError``.

Defined results: a null text encodes as the empty text (no ids); a null list of
ids decodes to the empty text; ids that the vocabulary doesn't have are skipped
and broken UTF-8 becomes U+FFFD, as in the library; repeated rows give repeated
results; other columns pass through, but one called as the result is replaced;
texts of any length are read whole, in pieces; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arboris.llm.common import small_batches, text_blocks

#: Words of more symbols are merged in order of ranks.
LONG = 256
#: Words that a worker remembers, in two generations of this many, if they are no longer than SHORT.
CACHE_ENTRIES, SHORT = 200_000, 32
#: Texts of more characters are cut into words this many at a time.
AT_ONCE = 1 << 18
_NONE = np.iinfo(np.int32).max
# Ranges of the letters and numbers that came with Unicode 16, the version of the library's tables.
UNICODE_16 = (
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d40-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 "
    "116d0-116e3 11bc0-11be0 11bf0-11bf9 13460-143fa 16100-1611d 16130-16139 16d40-16d6c 16d70-16d79 18cff 1ccf0-1ccf9 1e5d0-1e5ed 1e5f0-1e5fa"
)
# Fixed value: how a byte-level model cuts text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it is visible Latin-1, else the next letter from U+0100."""
    visible = {b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _ranges(points: Iterable[int]) -> str:
    """Inside of a character class that holds ``points``, given in ascending order."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Words:
    """Cuts text into words. Letters and numbers that ``regex`` knows and the library's older tables don't
    (those that neither Python's tables nor UNICODE_16 have) are marks like others."""

    def __init__(self):
        self.plain = regex.compile(PATTERN)
        known = regex.compile(r"[\p{L}\p{N}]")
        old = {c for r in UNICODE_16.split() for c in range(int(r.split("-")[0], 16), int(r.split("-")[-1], 16) + 1)}
        later = _ranges(c for c in range(0x80, 0x110000) if c not in old and unicodedata.category(chr(c)) == "Cn" and known.match(chr(c)))
        self.later = regex.compile(f"[{later}]") if later else None
        if later:
            strict = PATTERN.replace(r"\p{L}+", rf"(?:(?![{later}])\p{{L}})+", 1).replace(r"\p{N}+", rf"(?:(?![{later}])\p{{N}})+", 1)
            self.strict = regex.compile(strict.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[^\s\p{{L}}\p{{N}}]|[{later}])+"))

    def _cut(self, text: str) -> regex.Pattern:
        try:
            text.encode("latin-1")  # quicker than a search, and mostly enough
        except UnicodeEncodeError:
            if self.later is not None and self.later.search(text):
                return self.strict
        return self.plain

    def __call__(self, text: str) -> Iterator[list[str]]:
        cut = self._cut(text)
        if len(text) <= AT_ONCE:
            yield cut.findall(text)
            return
        found = (m.group() for m in cut.finditer(text))
        while some := list(islice(found, AT_ONCE // 4)):
            yield some


class Vocabulary:
    """Tokens, sorted merge keys and added tokens of a file of the tokenizers library."""

    def __init__(self, spec: dict):
        model, cut, out = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        other = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or other or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError(f"only a plain byte-level BPE model can be read ({', '.join(other) or 'model, normalizer or post-processor'})")
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or out.get("type") != "ByteLevel":
            raise ValueError("the pre-tokenizer and the decoder must be byte-level, without a prefix space")
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", []) if a["content"]}
        if any(a.get(k) for a in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip space or stand alone are not read")
        self.bytes_of = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in {**vocab, **self.added}.items()}
        self.first = np.array([vocab.get(c, -1) for c in letters], np.int64)
        if (self.first < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.base = 1 + max(vocab.values())
        rank = np.arange(len(merges))
        last, use = np.full(self.base, -1), np.full(self.base, _NONE)
        np.maximum.at(last, made, rank)
        np.minimum.at(use, left, rank)
        np.minimum.at(use, right, rank)
        if (last >= use).any():
            raise ValueError("a merge uses a token before it is made")
        order = np.argsort(left * self.base + right, kind="stable")
        keys = (left * self.base + right)[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("a pair has two merges")
        self.keys, self.ranks, self.left, self.right, self.made = keys, order.astype(np.int32), left, right, made

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols by binary search, _NONE where there is no merge."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, four bytes each, least first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = [b""] * len(words)
        for group, how in ((np.flatnonzero((size > 0) & (size <= LONG)), self._by_word), (np.flatnonzero(size > LONG), self._by_rank)):
            if len(group):
                sym = self.first[np.frombuffer(b"".join([words[i] for i in group.tolist()]), np.uint8)]
                ids, counts = how(sym, size[group])
                flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                for i, start, end in zip(group.tolist(), [0, *ends], ends):
                    out[i] = flat[start:end]
        return out

    def _by_word(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds in which every word merges all places of its pair of least rank. Flat ids, and how many each word has."""
        words, done = np.arange(len(size)), []
        while len(size):
            ends = np.cumsum(size)
            starts = ends - size
            rank = np.full(len(sym), _NONE, np.int32)
            rank[:-1] = self.rank_of(sym[:-1], sym[1:])
            rank[ends - 1] = _NONE  # the last symbol of a word has no neighbour
            least = np.minimum.reduceat(rank, starts)
            if (over := least == _NONE).any():
                gone = np.repeat(over, size)
                done.append((words[over], size[over], sym[gone]))
                words, size, least, sym, rank = words[~over], size[~over], least[~over], sym[~gone], rank[~gone]
                if not len(size):
                    break
            hits = _alternate(np.flatnonzero(rank == np.repeat(least, size)), 1)
            sym[hits] = self.made[rank[hits]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            sym = sym[keep]
            size = np.add.reduceat(keep, np.cumsum(size) - size, dtype=np.int64)
        counts = np.zeros(1 + max((int(w.max()) for w, _, _ in done), default=-1), np.int64)
        for w, n, _ in done:
            counts[w] = n
        starts = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for w, n, s in done:
            flat[np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(len(s))] = s
        return flat, counts

    def _by_rank(self, sym: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with rounds by rank over all words; neighbours are linked, so a round touches its places only."""
        n = len(sym)
        word = np.repeat(np.arange(len(size)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)
        after[ends - 1], before[ends - size] = n, -1
        alive = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            rank = self.rank_of(sym[at], sym[after[at]])
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for some, r in zip(np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist() if len(rank) else ()):
                if r not in places:
                    places[r] = []
                    heappush(heap, r)
                places[r].append(some)

        add(np.flatnonzero(after < n))
        heapify(heap)
        while heap:
            r = heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (sym[at] == self.left[r]) & (after[at] < n)]
            at = at[sym[after[at]] == self.right[r]]
            if self.left[r] == self.right[r]:
                at = _alternate(at, after)
            if not len(at):
                continue
            gone = after[at]
            sym[at], alive[gone], after[at] = self.made[r], False, after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left = before[at]
            add(np.unique(np.concatenate((at[inner], left[left >= 0]))))
        return sym[alive], np.bincount(word[alive], minlength=len(size))


def _alternate(at: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Of ascending places that follow one another by ``step``, every second of a run, from its first: their pairs don't overlap."""
    nexts = at[:-1] + step if isinstance(step, int) else step[at[:-1]]
    new = np.concatenate(([True], nexts != at[1:])) if len(at) else np.empty(0, bool)
    i = np.arange(len(at))
    return at[(i - np.maximum.accumulate(np.where(new, i, 0))) % 2 == 0]


class Codec:
    """Encoder and decoder of one worker, with a bounded memory of words seen. Ids are bytes, four each, least first."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.words = vocabulary, Words()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    def _learn(self, pieces: set[str]) -> list[str]:
        """Put the ids of words into memory, those that aren't known merged together; the long ones among them, to be forgotten soon."""
        missing = pieces.difference(self.young)
        new = []
        for p in missing:
            if (ids := self.old.get(p)) is None:
                new.append(p)
            else:
                self.young[p] = ids
        self.young.update(zip(new, self.vocabulary.merge([p.encode("utf-8", "replace") for p in new])))
        return [p for p in new if len(p) > SHORT]

    def _forget(self, pieces: list[str]) -> None:
        for p in pieces:
            del self.young[p]
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; the words of all texts are merged together, those of long texts by themselves."""
        out = [b""] * len(texts)
        held: list[tuple[int, list]] = []
        added = self.vocabulary.added
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = self.cut.split(text) if self.cut is not None and self.cut.search(text) else [text]
            if len(text) <= AT_ONCE:
                held.append((i, [added[x] if k % 2 else [p for some in self.words(x) for p in some] for k, x in enumerate(parts)]))
                continue
            ids = bytearray()
            for k, part in enumerate(parts):
                if k % 2:
                    ids += added[part].to_bytes(4, "little")
                    continue
                for pieces in self.words(part):
                    long = self._learn(set(pieces))
                    ids += b"".join(map(self.young.__getitem__, pieces))
                    self._forget(long)
            out[i] = bytes(ids)
        every: set[str] = set()
        every.update(*(x for _, parts in held for x in parts if isinstance(x, list)))
        long = self._learn(every)
        get = self.young.__getitem__
        for i, parts in held:
            out[i] = b"".join([x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in parts])
        self._forget(long)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        get = self.vocabulary.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(key: str, broadcast) -> Codec:
    """This worker's codec: it outlives the task, as the worker does."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value)
    return _codecs[key]


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    return hashlib.sha256(raw).hexdigest(), df.sparkSession.sparkContext.broadcast(Vocabulary(json.loads(raw)))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in df.schema if f.name != name), T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``array<int>``. ``path``: the vocabulary file, on the driver."""
    key, shared = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for b in batches:
            keep = [n for n in b.schema.names if n != ids]
            for start, end, texts in text_blocks(b.column(text)):
                made = codec.encode(texts)
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in made]))).astype(np.int32)
                flat = np.frombuffer(b"".join(made), "<i4")
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(start, end - start) for n in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], [*keep, ids])

    return small_batches(df).mapInArrow(run, _with(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the text that each list of ids stands for, special tokens among it."""
    key, shared = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, shared)
        for b in batches:
            keep = [n for n in b.schema.names if n != decoded]
            made = pa.array([codec.decode(x.as_py() or ()) for x in b.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), made], [*keep, decoded])

    return small_batches(df).mapInArrow(run, _with(df, decoded, T.StringType()))


def round_trip(df: DataFrame, path: str, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each whole text in one pass over it: number of ids, digest of the ids as
    little-endian unsigned 32-bit integers, digest of the decoded text. No list of ids leaves the worker."""
    name, shared = _shared(df, path)
    df = df.select(key_column, text)
    schema = T.StructType([
        df.schema[key_column], T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, shared)
        for b in batches:
            for start, end, texts in text_blocks(b.column(1)):
                n, a, d = [], [], []
                for ids in codec.encode(texts):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    d.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], schema.names)

    return small_batches(df).mapInArrow(run, schema)
