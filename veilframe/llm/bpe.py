"""Byte-level BPE encoding and decoding with a two-tier lookup.

Whole pre-tokens that are vocabulary entries are found by a minimal perfect hash (hash, displace, compare);
the others are merged by a heap over linked bytes. Null text counts as empty and has no ids. Ids are those of the
tiktoken library for encode_ordinary: special strings in a text are ordinary text. Texts of more than LONG characters are encoded
whole, PIECES_AT_ONCE pre-tokens at a time. Repeated rows and ids are encoded each by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, mixed, sliced, table

KNOWN_LIMIT = 1_000_000  # pre-tokens that a worker remembers: about 250 bytes each
LONG = 1 << 20  # characters: longer texts are encoded in parts
PIECES_AT_ONCE = 200_000  # of one long text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys at n places, by a displacement for each of n / 4 buckets."""

    def __init__(self, keys: list[bytes]):
        self.keys, n = keys, len(keys)
        self.size, self.buckets = n, n // 4 + 1
        for seed in range(1, 50):
            self.hash = RangeHash(seed)
            hashed = self._hashes(keys)
            if len(np.unique(hashed)) == n and self._place(hashed):
                break
        else:
            raise ValueError("no perfect hash found: are keys repeated?")

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        ends = np.cumsum(lengths)
        sums = self.hash.sums(np.frombuffer(b"".join(keys), np.uint8))
        return mixed(self.hash.of(sums, ends - lengths, ends) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _bucket(self, hashed: np.ndarray) -> np.ndarray:
        return ((hashed >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)

    def _place(self, hashed: np.ndarray) -> bool:
        """Larger buckets first: all buckets of one size try the same displacement at once and keep it where their
        places are free and nobody else's. Buckets of one key get what is left, told by a negative displacement."""
        n = self.size
        bucket = self._bucket(hashed)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        self.shift, self.at = np.zeros(self.buckets, np.int64), np.full(n, -1, np.int64)
        owner = np.full(n, -1, np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            open_ = np.flatnonzero(sizes == size)
            members = order[edges[open_][:, None] + np.arange(size)]
            for shift in range(1, 1 << 16):
                if not len(open_):
                    break
                places = self._displaced(hashed[members], np.full(len(open_), shift)[:, None])
                ordered = np.sort(places, axis=1)
                fits = (self.at[places] < 0).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                mine = np.flatnonzero(fits)
                owner[places[mine]] = mine[:, None]
                mine = mine[(owner[places[mine]] == mine[:, None]).all(axis=1)]
                self.shift[open_[mine]] = shift
                self.at[places[mine]] = members[mine]
                rest = np.ones(len(open_), bool)
                rest[mine] = False
                open_, members = open_[rest], members[rest]
            if len(open_):
                return False
        single, free = np.flatnonzero(sizes == 1), np.flatnonzero(self.at < 0)
        self.shift[single] = -1 - free
        self.at[free] = order[edges[single]]
        self.marks = hashed[self.at]
        return True

    def _displaced(self, hashed: np.ndarray, shift: np.ndarray) -> np.ndarray:
        moved = mixed(hashed + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)
        return np.where(shift < 0, -1 - shift, moved.astype(np.int64))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The index of each key in the list that was hashed, or -1."""
        if not keys or not self.size:
            return np.full(len(keys), -1, np.int64)
        hashed = self._hashes(keys)
        places = self._displaced(hashed, self.shift[self._bucket(hashed)])
        found = np.where(self.marks[places] == hashed, self.at[places], -1)
        for i in np.flatnonzero(found >= 0):
            if self.keys[found[i]] != keys[i]:
                found[i] = -1
        return found


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked pair of neighbours merges first, the leftmost of equal ones. end[i] links
    the part that starts at byte i to the next; parts that a merge has swallowed have end 0."""
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    get = ranks.get
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, stop = pop(heap)
        middle = end[i]
        if not middle or middle >= stop or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            after = end[stop]
            rank = get(piece[i:after])
            if rank is not None:
                push(heap, (rank, i, after))
        left = before[i]
        if left >= 0:
            rank = get(piece[left:stop])
            if rank is not None:
                push(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = list(ranks)
        self.ids = [ranks[x] for x in self.tokens]
        self.hash = PerfectHash(self.tokens)
        self.text_of = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of all these pre-tokens, with what is remembered."""
        if len(self.known) > KNOWN_LIMIT:
            self.known = {}  # a batch may still hold the old one
        known = self.known
        new = [x for x in set(pieces) if x not in known]
        coded = [x.encode("utf-8") for x in new]
        for piece, raw, at in zip(new, coded, self.hash.find(coded).tolist()):
            known[piece] = (self.ids[at],) if at >= 0 else tuple(heap_merge(raw, self.ranks))
        return known

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, in parts of a bounded number of pre-tokens."""
        found = self.pattern.finditer(text)
        while pieces := [m.group() for m in islice(found, PIECES_AT_ONCE)]:
            yield self.join(pieces, self.learn(pieces))

    def encode_all(self, texts: list[str | None]) -> Iterator[Iterable[np.ndarray]]:
        """Ids of each text, in parts; what the texts up to LONG hold is learned at once."""
        short = [self.pattern.findall(x) if x and len(x) <= LONG else [] for x in texts]
        known = self.learn(chain.from_iterable(short))
        for text, pieces in zip(texts, short):
            yield self.encode(text) if text and not pieces else (self.join(pieces, known),)

    @staticmethod
    def join(pieces: list[str], known: dict[str, tuple[int, ...]]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(known.__getitem__, pieces)), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.text_of.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One for each vocabulary and worker."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        raw = spark.sparkContext.broadcast(file.read())  # as large as the vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value, pattern)
        for batch in sliced(batches, "text", 2 << 20):
            counts, ids_sha, decoded_sha, ids = [], [], [], []
            for parts in own.encode_all(batch.column("text").to_pylist()):
                first, second, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                for part in parts:
                    first.update(part.astype("<u4").tobytes())
                    second.update(own.decode(part))
                    n += len(part)
                    if with_ids:
                        kept.append(part)
                counts.append(n)
                ids_sha.append(first.hexdigest())
                decoded_sha.append(second.hexdigest())
                if with_ids:
                    ids.append(np.concatenate(kept).astype(np.int32) if kept else np.zeros(0, np.int32))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), with_ids=False)
