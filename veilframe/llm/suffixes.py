"""Removal of long byte strings that repeat anywhere, by difference-cover suffix sorting to a fixed depth.

Only equality to depth L (LENGTH bytes) matters, so suffixes are sorted to that depth:

1. Suffixes at a difference cover (positions whose residue modulo v is in D, where every residue is a difference of two
   members of D) are sampled. For two equal strings of L bytes some shift below v leads both to sampled positions, and
   the w = L - v + 1 bytes from there are equal. These sampled tuples are named, sorted by name in ranges of names, and
   compared with their neighbours; a tuple that stands alone ends there.
2. The remaining suffixes, sampled or not, from which a repeated tuple is within reach get names of all L bytes; they are merged in
   one order of names and adjacent equal ones mark the repeated strings.

In the classical algorithm tuples have three letters and names are ranks, refined by recursion until all differ; here one
step of w bytes replaces the recursion, and names are hash values of 64 bits in step 1 (only a filter) and 96 bits, from two
independent hashes, in step 2. Sorted names travel as packed arrays, and a string that a slice of text holds several times travels
once. Step 2 runs in PASSES, each over a part of the names, so that only that part is on disk at a time.

A string of LENGTH bytes can only repeat inside of longer repeats of shorter strings, so the same steps first run to the depth of PASSAGE
bytes, and strings of LENGTH bytes are looked for in what they have left.

Texts are UTF-8 bytes; null counts as empty. Strings never cross documents. Repeated rows repeat all their strings. Very long texts
are whole: a slice holds one of them then, and memory grows with the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import RangeHash, WindowHash, dropped, give_back, mixed, packed, sliced, staged, table, text_bytes

LENGTH = 400
PASSAGE, WORDS = 200, 51  # what goes as a repeated passage: so many bytes, or so many words in fewer bytes
NAMES_PER_BUCKET, PASSES = 200_000, 2
SLICE, NAMED_SLICE = 2 << 20, 1 << 20
_first, _second = RangeHash(21), WindowHash(22)
SAMPLE = np.dtype([("name", "<u8"), ("at", "<u4")])
ALREADY = np.uint32(1 << 31)  # in `at` and in check words: this slice has it more than once
NAME = np.dtype([("name", "<u8"), ("check", "<u4")])


def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """(v, D): Singer's perfect difference set for the largest prime q with v = q * q + q + 1 <= 0.77 * length: the exponents of
    the powers of a generator of GF(q ** 3) that lie in a plane."""
    primes = [q for q in range(2, 200) if all(q % p for p in range(2, q)) and q * q + q + 1 <= 0.77 * length]
    if not primes:
        return 1, np.zeros(1, np.int64)
    q = primes[-1]
    v = q * q + q + 1
    for coefficients in ((a, b, c) for a in range(q) for b in range(q) for c in range(1, q)):
        power, found = (1, 0, 0), []
        for i in range(v):
            if not power[2]:
                found.append(i)
            top = power[2]
            power = tuple((low + top * k) % q for low, k in zip((0, power[0], power[1]), coefficients[::-1]))
        if len(found) == q + 1 and len({(x - y) % v for x in found for y in found}) == v:
            return v, np.array(found)
    raise AssertionError("no generator")


def doc_key() -> F.Column:
    """Equal for repeated rows; of different documents that clash each looks at the places of both."""
    return F.xxhash64("doc_id", "text")


def sampled(data: np.ndarray, bounds: np.ndarray, v: int, cover: np.ndarray, w: int) -> np.ndarray:
    """Byte positions in the slice of sampled suffixes with at least w bytes."""
    lengths = np.diff(bounds)
    chosen = np.zeros(v, bool)
    chosen[cover] = True
    out = []
    tile = np.resize(chosen, int(lengths.max(initial=0)))
    for start, n in zip(bounds[:-1].tolist(), lengths.tolist()):
        if n >= w:
            out.append(np.flatnonzero(tile[: n - w + 1]) + start)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def order_of(names: np.ndarray) -> np.ndarray:
    """Their order, as a stable argsort gives it: places are sorted as the low bits of the names, which is several times faster. Names of which
    only those bits differ are rare; if they come the wrong way round, all are sorted as they are."""
    names = np.ascontiguousarray(names)
    low = np.uint64((1 << max(1, len(names) - 1).bit_length()) - 1)
    keys = names & ~low
    keys |= np.arange(len(names), dtype=np.uint64)
    keys.sort()
    keys &= low
    order = keys.view(np.int64)
    found = names[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(names, kind="stable")


def runs(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted names: (first of each run, whether each has an equal neighbour)."""
    if not len(names):
        return np.zeros(0, bool), np.zeros(0, bool)
    new = np.concatenate([[True], names[1:] != names[:-1]])
    return new, ~new | np.concatenate([~new[1:], [False]])


def by_bucket(names: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows in order of names, cut by ranges of names."""
    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    edges = np.concatenate([[0], np.searchsorted(names, cuts), [len(names)]])
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, rows[edges[k] : edges[k + 1]]


def sample_survivors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """key, ranges: places (from, to, ...) of a document where strings of `length` bytes that may repeat begin."""
    v, cover = difference_cover(length)
    w = length - v + 1

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in sliced(batches, "text", SLICE):
            bounds, data = text_bytes(batch.column("text"))
            at = sampled(data, bounds, v, cover, w)
            names = mixed(_first.of(_first.sums(data), at, at + w))
            order = order_of(names)
            names, at = names[order], at[order]
            new, many = runs(names)
            entries = np.empty(int(new.sum()), SAMPLE)
            entries["name"], entries["at"] = names[new], at[new].astype(np.uint32) | np.where(many[new], ALREADY, np.uint32(0))
            uid = part << 32 | number
            number += 1
            keys = batch.column("key").to_numpy()
            rows = [(-1 - uid % buckets, packed(np.concatenate([keys, bounds]))), (-1 - uid % buckets, packed(at[many].astype(np.uint32)))]
            rows += [(k, packed(x)) for k, x in by_bucket(entries["name"], entries, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([uid] * len(rows), pa.int64()), pa.array([0, 1] + [2] * (len(rows) - 2), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "uid", "kind", "packed"])

    def adjacent(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group.select(["uid", "kind", "packed"])
        parts = [np.frombuffer(x, SAMPLE) for x in group.column("packed").to_pylist()]
        owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        entries = np.concatenate(parts)
        order = order_of(entries["name"])
        _, many = runs(entries["name"][order])
        met = order[many]
        met = np.sort(met[entries["at"][met] < ALREADY])  # by owner
        edges = np.searchsorted(owner[met], np.arange(len(parts) + 1))
        full = np.flatnonzero(np.diff(edges))
        return pa.table({"uid": group.column("uid").combine_chunks().take(pa.array(full)), "kind": pa.array(np.ones(len(full), np.int32)), "packed": pa.array([packed(entries["at"][met[edges[k] : edges[k + 1]]]) for k in full], pa.binary())})

    def ranges(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        blobs = group.column("packed")
        head = np.frombuffer(blobs[int(np.flatnonzero(kinds == 0)[0])].as_py(), np.int64)
        keys, bounds = head[: len(head) // 2], head[len(head) // 2 :]
        at = np.sort(np.concatenate([np.frombuffer(blobs[int(k)].as_py(), np.uint32) for k in np.flatnonzero(kinds == 1)]).astype(np.int64))
        doc = np.searchsorted(bounds, at, side="right") - 1
        low = np.maximum(at - v + 1, bounds[doc])
        high = np.minimum(at, bounds[doc + 1] - length)
        fits = low <= high
        doc, low, high = doc[fits], low[fits], high[fits]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(doc)]]) - 1 if len(first) else first
        doc, low, high = doc[first], low[first] - bounds[doc[first]], high[last] - bounds[doc[first]]
        own, begin = np.unique(doc, return_index=True)
        flat = np.stack([low, high], axis=1).astype(np.int32)
        lists = [x.ravel() for x in np.split(flat, begin[1:])] if len(own) else []
        return pa.table({"key": pa.array(keys[own], pa.int64()), "ranges": pa.array(lists, pa.list_(pa.int32()))})

    rows = docs.select(doc_key().alias("key"), "text").mapInArrow(sample, "bucket int, uid long, kind int, packed binary")
    met = rows.groupBy("bucket").applyInArrow(adjacent, "uid long, kind int, packed binary")
    return met.groupBy("uid").applyInArrow(ranges, "key long, ranges array<int>")


def starts_of(ranges: pa.ListArray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Places in the slice of all strings to name."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(ranges), 0)) // 2
    low, high = ranges.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2).T
    at, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    first, stop = at + low - bounds[0], np.minimum(at + high, end - length) + 1 - bounds[0]
    fits = first < stop
    change = np.zeros(int(bounds[-1] - bounds[0]) + 1, np.int32)
    np.add.at(change, first[fits], 1)
    np.subtract.at(change, stop[fits], 1)
    return np.flatnonzero(np.cumsum(change[:-1], dtype=np.int32)) + int(bounds[0])


def ordered_names(group: pa.Table, length: int, low: int = 0, high: int = 1 << 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, bounds, starts in order of names, whether a new name begins, whether names repeat here, names), for names
    from low to below high."""
    bounds, data = text_bytes(group.column("text").combine_chunks())
    starts = starts_of(group.column("ranges").combine_chunks(), bounds, length)
    name = mixed(_first.of(_first.sums(data), starts, starts + length))
    if (low, high) != (0, 1 << 64):
        own = (name >= np.uint64(low)) & (name <= np.uint64(high - 1))
        starts, name = starts[own], name[own]
    order = order_of(name)
    starts = starts[order]
    names = np.empty(len(starts), NAME)
    names["name"] = name[order]
    if len(starts):
        names["check"] = (mixed(_second.of(_second.sums(data), starts, starts + length)) >> np.uint64(33)).astype(np.uint32)
    if ((names["name"][1:] == names["name"][:-1]) & (names["check"][1:] != names["check"][:-1])).any():
        again = np.lexsort((names["check"], names["name"]))
        starts, names = starts[again], names[again]
    new, many = runs(names)
    return data, bounds, starts, new, many, names


def repeats(docs: DataFrame, length: int = PASSAGE) -> DataFrame:
    """doc_id, text, spans (from, to, ... of bytes to remove) for the documents with repeated strings of so many bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    v, cover = difference_cover(length)
    docs = docs.select("doc_id", "text", doc_key().alias("key"))
    survivors = staged(sample_survivors(docs, length, int(size * len(cover) // v // NAMES_PER_BUCKET + 8)))
    wanted = survivors.groupBy("key").agg(F.flatten(F.collect_set("ranges")).alias("ranges"))
    found = marked(docs.join(wanted, "key"), length, length - v + 1)
    dropped(survivors)
    return found


def longer(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """The result of repeats() for a larger length, from that for a smaller one."""
    at = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.array(F.get("spans", i), F.get("spans", i + 1) - length))
    ranges = F.flatten(F.filter(at, lambda x: x[1] >= x[0]))
    return marked(found.select("doc_id", "text", ranges.alias("ranges")).filter(F.size("ranges") > 0), length, length)


def marked(candidates: DataFrame, length: int, w: int) -> DataFrame:
    """doc_id, text, ranges (places where strings to name begin) -> doc_id, text, spans. Documents with an equal tuple of w bytes are
    likely to meet in a slice."""

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE):
            bounds, data = text_bytes(batch.column("text"))
            at = starts_of(batch.column("ranges"), bounds, length)
            names = mixed(_first.of(_first.sums(data), at, at + w))
            least = np.full(batch.num_rows, 2**64 - 1, np.uint64)
            edges = np.searchsorted(at, bounds)
            own = np.flatnonzero(np.diff(edges))
            if len(own):
                least[own] = np.minimum.reduceat(names, edges[own])
            least = (least >> np.uint64(1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "cluster"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in sliced(batches, "text", NAMED_SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part << 32 | number] * batch.num_rows, pa.int64())], names=[*batch.schema.names, "slice"])
            number += 1

    # Likely copies come near each other, so that most repeated strings meet inside a slice and travel once. This is only a
    # matter of cost, so a partition with a large group of copies may be split anywhere.
    held_schema = "doc_id long, text string, ranges array<int>"
    near = candidates.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("ranges").cast("array<int>").alias("ranges")).mapInArrow(cluster, f"{held_schema}, cluster long")
    near = near.hint("rebalance", "cluster").sortWithinPartitions("cluster").select("doc_id", "text", "ranges")
    held = staged(near.mapInArrow(cut, f"{held_schema}, slice long"))
    places = F.aggregate(F.transform("ranges", lambda x, i: F.when(i % 2 == 0, 1 - x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    each = int((held.agg(F.sum(places)).first()[0] or 0) // NAMES_PER_BUCKET // PASSES + 8)
    buckets = each * PASSES

    def merge(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, NAME) for x in group.column("packed").to_pylist()]
        entries = np.concatenate(parts)
        known = entries["check"] >= ALREADY
        check = entries["check"] & ~ALREADY
        order = order_of(entries["name"])
        name, sorted_check = entries["name"][order], check[order]
        if ((name[1:] == name[:-1]) & (sorted_check[1:] != sorted_check[:-1])).any():
            order = np.lexsort((check, entries["name"]))
            name, sorted_check = entries["name"][order], check[order]
        check = sorted_check
        equal = (name[1:] == name[:-1]) & (check[1:] == check[:-1])
        met = known.copy()
        met[order[1:][equal]] = True
        met[order[:-1][equal]] = True
        edges = np.cumsum([0] + [len(x) for x in parts])
        bits = [np.packbits(met[a:b]).tobytes() for a, b in zip(edges, edges[1:])]
        return pa.table({"slice": group.column("slice"), "bucket": group.column("bucket"), "n": pa.array([len(x) for x in parts], pa.int32()), "bits": pa.array(bits, pa.binary())})

    def masks_of(number: int) -> DataFrame:
        low, high = (-(-(k * each << 64) // buckets) for k in (number, number + 1))

        def emit(group: pa.Table) -> pa.Table:
            _, _, _, new, many, names = ordered_names(group, length, low, high)
            entries = names[new]
            entries["check"] |= np.where(many[new], ALREADY, np.uint32(0))
            rows = list(by_bucket(entries["name"], entries, buckets))
            del new, many, names
            give_back()
            return pa.table({"bucket": pa.array([k for k, _ in rows], pa.int32()), "slice": pa.array([group.column("slice")[0].as_py()] * len(rows), pa.int64()), "packed": pa.array([packed(x) for _, x in rows], pa.binary())})

        names = held.groupBy("slice").applyInArrow(emit, "bucket int, slice long, packed binary")
        return staged(names.groupBy("bucket").applyInArrow(merge, "slice long, bucket int, n int, bits binary"))

    def mark(group: pa.Table, masks: pa.Table) -> pa.Table:
        data, bounds, starts, new, _, _ = ordered_names(group, length)
        rows = sorted(zip(masks.column("bucket").to_pylist(), masks.column("n").to_pylist(), masks.column("bits").to_pylist()))
        met = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for _, n, b in rows] or [np.zeros(0, np.uint8)]).astype(bool)
        hit = starts[met[np.cumsum(new) - 1]] if len(starts) else starts
        change = np.zeros(len(data) + 1, np.int8)
        change[hit] += 1  # no place is there twice
        change[hit + length] -= 1
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        rows_, spans = [], []
        for i in np.unique(np.searchsorted(bounds, hit, side="right") - 1).tolist():
            a, b = bounds[i], bounds[i + 1]
            steps = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)))
            if len(steps):
                rows_.append(i)
                spans.append(steps.astype(np.int32))
        at = pa.array(rows_, pa.int64())
        give_back()
        return pa.table({"doc_id": group.column("doc_id").combine_chunks().take(at), "text": group.column("text").combine_chunks().take(at), "spans": pa.array(spans, pa.list_(pa.int32()))})

    masks = [masks_of(k) for k in range(PASSES)]
    together = reduce(DataFrame.unionByName, masks)
    out = staged(held.groupBy("slice").cogroup(together.groupBy("slice")).applyInArrow(mark, "doc_id long, text string, spans array<int>"))
    dropped(held, *masks)
    return out


def kept_bytes(text: bytes, spans: list[int]) -> bytes:
    at, out = 0, []
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def whole() -> F.Column:
    return F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, text, spans -> doc_id, whole (digest of the text), n_removed, n_spans, kept_sha256, once for repeated rows."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            spans = batch.column("spans").to_pylist()
            texts = [t.encode("utf-8") for t in batch.column("text").to_pylist()]
            sha = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sha(texts), pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), sha(map(kept_bytes, texts, spans))], names=["doc_id", "whole", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(digest, "doc_id long, whole string, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "whole"])


def short_passages(docs: DataFrame, length: int, words: int) -> DataFrame:
    """doc_id, whole, spans: passages of so many words that stand at two places or more and have fewer bytes than length. Such words are
    short, so that few places of most texts are looked at."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white = np.isin(np.arange(256), [32, *range(9, 14)])
        for batch in sliced(batches, "text"):
            bounds, data = text_bytes(batch.column("text"))
            inside = np.concatenate([~white[data], [False]])
            begins, stops = inside.copy(), np.zeros(len(inside), bool)
            begins[1:] &= ~inside[:-1]
            begins[bounds[:-1]] |= inside[bounds[:-1]]
            stops[1:] = inside[:-1] & ~inside[1:]
            full = bounds[1:][bounds[1:] > bounds[:-1]]  # ends of documents that hold anything
            stops[full] |= inside[full - 1]
            begin, stop = np.flatnonzero(begins), np.flatnonzero(stops)
            owner = np.searchsorted(bounds, begin, side="right") - 1
            begin, stop = begin[: len(begin) - words + 1], stop[words - 1 :]
            near = (owner[: len(begin)] == owner[words - 1 :]) & (stop - begin < length) if len(begin) else np.zeros(0, bool)
            begin, stop, owner = begin[near], stop[near], owner[: len(near)][near]
            at = bounds[owner]
            # Only documents with such a passage are hashed, one after the other in `some`.
            own, of = np.unique(owner, return_inverse=True)
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, bounds[own], 1)
            np.subtract.at(inside, bounds[own + 1], 1)
            some = data[np.cumsum(inside[:-1]).astype(bool)]
            moved = np.concatenate([[0], np.cumsum(bounds[own + 1] - bounds[own])])[of] - at
            names = [mixed(h.of(h.sums(some), begin + moved, stop + moved)).view(np.int64) if len(begin) else np.zeros(0, np.int64) for h in (_first, _second)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner)), batch.column("whole").take(pa.array(owner)), *map(pa.array, names), pa.array(begin - at, pa.int32()), pa.array(stop - at, pa.int32())], names=["doc_id", "whole", "h1", "h2", "begin", "stop"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("whole"), "text")
    places = staged(rows.mapInArrow(find, "doc_id long, whole string, h1 long, h2 long, begin int, stop int"))
    twice = places.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    out = staged(places.join(twice, ["h1", "h2"]).groupBy("doc_id", "whole").agg(F.flatten(F.collect_set(F.array("begin", "stop"))).alias("spans")))
    dropped(places)
    return out


def merged(spans: list[int]) -> list[int]:
    """Spans (from, to, ...) in order, those that meet as one."""
    out: list[int] = []
    for begin, stop in sorted(zip(spans[::2], spans[1::2])):
        if out and begin <= out[-1]:
            out[-1] = max(out[-1], stop)
        else:
            out += [begin, stop]
    return out


@F.arrow_udf(StringType())
def cut_text(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without these bytes; a character of which only part would stay goes as a whole."""
    return pa.array([None if t is None else kept_bytes(t.encode("utf-8"), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())


def with_kept_text(docs: DataFrame, found: DataFrame, length: int, words: int) -> DataFrame:
    """docs with __kept: the text without the spans found by repeats() for this length and without repeated passages of so many
    words, null where nothing goes; and __whole, the digest of the text."""
    both = found.select("doc_id", whole().alias("whole"), "spans").unionByName(short_passages(docs, length, words))
    changed = both.groupBy(F.col("doc_id").alias("__id"), F.col("whole").alias("__of")).agg(F.flatten(F.collect_set("spans")).alias("__spans"))
    rows = docs.withColumn("__whole", whole())
    joined = rows.join(changed, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__whole") == F.col("__of")), "left")
    kept = cut_text(F.when(F.col("__spans").isNotNull(), F.col("text")), F.col("__spans"))
    return joined.withColumn("__kept", kept).drop("__id", "__of", "__spans")


def without_repeats(docs: DataFrame, length: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """docs with the repeated strings of so many bytes, and the repeated passages of so many words, taken out of text.
    All other columns stay, n_chars follows the text."""
    rows = with_kept_text(docs, repeats(docs.select("doc_id", "text"), length), length, words)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType)))
    return rows.withColumn("text", F.coalesce("__kept", "text")).select(*docs.columns)


def removed(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = WORDS) -> DataFrame:
    """doc_id, text -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 for strings of `length` bytes; and text, what is left when
    repeated passages (`passage` bytes, or so many words in fewer bytes) are taken out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeats(docs, passage)
    long = longer(found, length)
    gone = digests(long).select(F.col("doc_id").alias("__id"), F.col("whole").alias("__of"), "n_removed", "n_spans", "kept_sha256")
    rows = with_kept_text(docs, found, passage, words)
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__whole") == F.col("__of")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("doc_id", count(F.octet_length("text")).alias("n_bytes"), count("n_removed").alias("n_removed"), count("n_spans").alias("n_spans"), F.coalesce("kept_sha256", "__whole").alias("kept_sha256"), F.coalesce("__kept", "text", F.lit("")).alias("text"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
