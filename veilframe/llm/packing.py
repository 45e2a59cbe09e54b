"""Packing by shortest-pack-first over the length histogram.

Documents become token ids and the end id; full pieces of LENGTH ids fill a sequence each, what is left of a document
is one more piece. The histogram of piece lengths (at most LENGTH numbers) is all that the driver sees: lengths go longest
first into the pack with the most room, a whole group of equal packs at a time. The resulting patterns are
joined back by each piece's rank among the pieces of its length.

Null text counts as empty: one piece with the end id. Repeated ids and repeated rows are packed row by row. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sliced, staged, table
from .token_count import byte_alphabet

LENGTH, END_ID = 2048, 1


def shortest_pack_first(histogram: dict[int, int], room: int = LENGTH) -> list[tuple[list[int], int]]:
    """[(lengths of a pack, number of such packs)]. Of packs with equal room the older group is extended first."""
    groups: list[tuple[list[int], int]] = []
    heap: list[tuple[int, int]] = []  # most room first
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not heap or -heap[0][0] < length:
                groups.append(([length], left))
                heapq.heappush(heap, (length - room, len(groups) - 1))
                break
            minus_room, at = heapq.heappop(heap)
            lengths, packs = groups[at]
            used = min(left, packs)
            if used < packs:
                groups[at] = (lengths, packs - used)
                heapq.heappush(heap, (minus_room, at))
                groups.append(([*lengths, length], used))
                at = len(groups) - 1
            else:
                lengths.append(length)
            if minus_room + length < 0:
                heapq.heappush(heap, (minus_room + length, at))
            left -= used
    return groups


def slots(groups: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, offset). Ranks from one row's first to the next row's go to
    sequences one after the other."""
    taken: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for lengths, packs in groups:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            out.setdefault(length, []).append((rank, first, offset))
            taken[length] = rank + packs
            offset += length
        first += packs
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


_encoders: dict[str, tiktoken.Encoding] = {}


def encoder(raw: bytes) -> tiktoken.Encoding:
    """The vocabulary of a byte-level tokenizers file. Ids are those of the tokenizers library; the merges are found by
    tiktoken, which is several times as fast. It takes ids for ranks, so a vocabulary whose merges don't come in the order of its ids is
    refused. Special strings in a text are special ids, as by that library's default."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encoders:
        spec, letters = json.loads(raw), byte_alphabet()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        made = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(b <= a for a, b in zip(made, made[1:])):
            raise ValueError("the merges of this vocabulary are not in the order of its ids")
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _encoders[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[key]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, place long"


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """doc_id, text -> PIECES; place: rank among the pieces of this length and input partition."""
    with open(vocabulary, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())  # as large as the vocabulary file

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(raw.value), TaskContext.get().partitionId()
        seen = [0] * (length + 1)
        for batch in sliced(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = own.encode(text or "", allowed_special="all")
                ids.append(END_ID)
                coded, n = np.array(ids, "<u4"), len(ids)
                for start in range(0, n, length):
                    size = min(length, n - start)
                    rows.append((doc_id, start, size, zlib.crc32(coded[start : start + size].tobytes()), n, part, seen[size]))
                    seen[size] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """doc_id, text -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    cut = staged(pieces(docs, vocabulary, length))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    laid = docs.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, length)))  # bounded by the histogram, not by the rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            order = np.argsort(sizes, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
                rows = laid.value[int(sizes[own[0]])]
                at = np.searchsorted(rows[:, 0], ranks[own], side="right") - 1
                sequence[own], offset[own] = rows[at, 1] + ranks[own] - rows[at, 0], rows[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    # Offsets grow with the number of input partitions, so they are not broadcast.
    ranked = cut.join(offsets.select("part", "length", "before").hint("merge"), ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
