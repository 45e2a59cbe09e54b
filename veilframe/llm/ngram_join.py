"""An exact Jaccard join of documents on sets of word n-grams.

Documents with equal sets are one class. A partner of a set lacks few of its n-grams, so a set with more n-grams that no other
document has can have none: a fixed share of all n-grams, chosen by hash, is counted over all documents, and sets with too many
lone ones leave. All n-grams of the others are counted, for each set once, and again sets leave, PEELED times. Of those that stay, sets of similar size that reach the threshold differ in at most d n-grams; when the columns of the
incidence matrix are dealt to more than d bundles by a hash, some bundles have the same n-grams in both, and equal bundles
give candidate groups. Sets that share little, such as one common line, often have some small bundle in common, and in large corpora
that joins most candidates to one group. So groups of many blocks are cut again: of two linked sets that list their n-grams from the
rarest in the group on, each has one of the common ones so early that the rest could not reach the threshold; only sets that
share an n-gram up to there stay together. Inside a group blocks of documents are multiplied as sparse document by n-gram matrices,
one block of columns after the other; overlap counts add up, and pairs whose overlap stays below the bound that their
sizes give are discarded. Blocks return spanning forests, so no list of all pairs exists anywhere. In a group of several blocks the
first block is multiplied with all others; what that links is cut into blocks of its own, which need no products with each
other, only with what is left.

A document's words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. With fewer words than n the whole sequence is the only
n-gram; without words (or text) the set is empty and links with nothing. N-grams are compared by 64-bit hashes, sets by
128 bits and their size. Rows with a null id take part; their component is the smallest id of the group, if any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RangeHash, dropped, mixed, packed, sliced, staged, table, text_bytes
from .components import components, forest, joined

ENTRIES_PER_BUCKET = 250_000
PEELED = 1  # rounds in which sets with too many lone n-grams leave
BLOCK_ROWS, BLOCK_NGRAMS, COLUMNS = 512, 1 << 19, 2048
WHOLE_BLOCKS = 8  # groups of more blocks are cut by prefixes before blocks are multiplied; for others that takes longer

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_hash = RangeHash(9)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = _lower[data]
    inside = ~_space[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1]))
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1
    words = mixed(_hash.of(_hash.sums(data), starts, ends) + (ends - starts).astype(np.uint64))
    return np.searchsorted(bounds, starts, side="right") - 1, words


def ngram_sets(data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, n-gram), without repeats, ordered by both."""
    doc, words = word_hashes(data, bounds)
    count = np.bincount(doc, minlength=len(bounds) - 1)
    steps = [np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 2**64)) for i in range(n)]
    whole = len(words) - n + 1
    if whole > 0:
        grams = np.zeros(whole, np.uint64)
        for i in range(n):
            grams += words[i : whole + i] * steps[i]
        inside = doc[:whole] == doc[n - 1 :]
        grams, owner = mixed(grams[inside]), doc[:whole][inside]
    else:
        grams, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.searchsorted(doc, short)
        lone = count[short].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        for i in range(n - 1):
            has = count[short] > i
            lone[has] += words[begin[has] + i] * steps[i]
        grams, owner = np.concatenate([grams, mixed(lone)]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], grams[new]


def marks(owner: np.ndarray, grams: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, first and second 64 bits of the mark) of each set: sums of two mixes, independent of any order."""
    size = np.bincount(owner, minlength=docs).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    out = []
    for salt in (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(grams ^ salt))])
        out.append(mixed(sums[edges[1:]] - sums[edges[:-1]]).view(np.int64))
    return size, *out


def size_classes(most: int, percent: int) -> np.ndarray:
    """Where classes of set sizes begin: sets that can reach the threshold are in the same or in neighbouring classes."""
    begin = [1, 2]
    while begin[-1] <= most:
        begin.append(max(begin[-1] + 1, 100 * (begin[-1] - 1) // percent + 1))
    begin.append(max(begin[-1] + 1, 100 * (begin[-1] - 1) // percent + 1))
    return np.array(begin, np.int64)


def bundle_names(owner: np.ndarray, grams: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, name) of every bundle. A document meets its own size class and the next smaller one in one slot, and its own
    and the next larger one in another; a slot's largest sets tell by how many n-grams d linked sets may differ. Of the K bundles
    K - d are equal. A set with fewer empty bundles than that shares one that is not empty with each partner and needs no
    empty ones; only sets with more name theirs."""
    begin = size_classes(int(size.max(initial=1)), percent)
    own = np.searchsorted(begin, size, side="right") - 1
    docs, names = [], []
    for step in (0, 1):
        slot = own - step
        used = np.flatnonzero((size > 0) & (slot >= 0))
        largest = begin[np.minimum(slot[used] + 2, len(begin) - 1)] - 1
        apart = 2 * largest * (100 - percent) // (100 + percent)
        bundles, spare = np.zeros((2, len(size)), np.int64)
        spare[used] = 1 + (apart + 5) // 6
        bundles[used] = apart + spare[used]
        first = np.concatenate([[0], np.cumsum(bundles)])
        sums, filled = np.zeros(first[-1], np.uint64), np.zeros(first[-1], bool)
        keep = bundles[owner] > 0
        o, g = owner[keep], grams[keep]
        at = first[o] + ((g >> np.uint64(16)) % bundles[o].astype(np.uint64)).astype(np.int64)
        np.add.at(sums, at, g)
        filled[at] = True
        doc = np.repeat(np.arange(len(size)), bundles)
        place = np.arange(first[-1]) - first[doc]
        empty = np.bincount(doc[~filled], minlength=len(size))
        named = filled | (empty >= spare)[doc]
        docs.append(doc[named])
        names.append(mixed(sums + mixed((slot[doc] << 40 | place).astype(np.uint64)))[named])
    return np.concatenate(docs), np.concatenate(names)


ENTRY = np.dtype([("low", "<u4"), ("high", "<u2"), ("doc", "<u2")])  # 48 bits of an n-gram; its bucket has more of it
MOST_ROWS = (1 << 16) - 1  # of a slice
SEVERAL = MOST_ROWS  # in place of a document: several of the slice have it, and know


def by_range(names: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Sorted names cut by ranges."""
    cuts = np.array([(k << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)
    edges = np.concatenate([[0], np.searchsorted(names, cuts), [len(names)]])
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(edges[k], edges[k + 1])


HEAD = {"slot": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "m1": pa.int64(), "m2": pa.int64(), "chosen": pa.int64(), "packed": pa.binary()}
HEAD_SCHEMA = "slot long, doc_id long, n long, m1 long, m2 long, chosen long, packed binary"


def entries_of(owner: np.ndarray, grams: np.ndarray, doc_id: pa.Array, size: np.ndarray, m1: np.ndarray, m2: np.ndarray, share: int, number: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a slice of sets sends: a row for each set, its n-grams by buckets (that share, of 64, which is counted), and how many
    of them others in the slice have."""
    base, rows = number << 16, len(size)
    slots = base + np.arange(rows)
    keep = (grams >> np.uint64(8)) % np.uint64(64) < np.uint64(share)
    owner, grams = owner[keep], grams[keep]
    chosen = np.bincount(owner, minlength=rows)
    yield pa.RecordBatch.from_arrays([pa.array(-1 - slots % buckets, pa.int32()), pa.array(slots), doc_id, pa.array(size), pa.array(m1), pa.array(m2), pa.array(chosen, pa.int64()), pa.nulls(rows, pa.binary())], names=["bucket", *HEAD])
    order = np.argsort(grams, kind="stable")
    owner, grams = owner[order], grams[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    many = ~new
    many[:-1] |= ~new[1:]
    own = owner.copy()
    own[many] = SEVERAL
    own, grams = own[new], grams[new]
    entries = np.empty(len(grams), ENTRY)
    entries["low"], entries["high"], entries["doc"] = grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32) & np.uint64(0xFFFF), own
    cut = [(k, packed(entries[at])) for k, at in by_range(grams, buckets)]
    if many.any():
        cut.append((-1 - number % buckets, packed(tally(owner[many]))))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in cut], pa.int32()), pa.array([base] * len(cut), pa.int64()), *[pa.nulls(len(cut), pa.int64())] * 5, pa.array([x for _, x in cut], pa.binary())], names=["bucket", *HEAD])


def met(rows: DataFrame) -> DataFrame:
    """The rows of entries_of(): those for sets as they are, and rows with slot and packed that tell how many n-grams of the sets of a slice others
    have as well."""

    def meet(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group.drop_columns(["bucket"])
        parts = [np.frombuffer(x.as_py(), ENTRY) for x in group.column("packed")]
        entries = np.concatenate(parts)
        gram = entries["high"].astype(np.uint64) << np.uint64(32) | entries["low"]
        order = np.argsort(gram, kind="stable")
        equal = gram[order][1:] == gram[order][:-1]
        found = np.zeros(len(entries), bool)
        found[order[1:][equal]] = True
        found[order[:-1][equal]] = True
        found &= entries["doc"] != SEVERAL
        edges = np.cumsum([0] + [len(x) for x in parts])
        told = [(k, packed(tally(entries["doc"][a:b][found[a:b]]))) for k, (a, b) in enumerate(zip(edges, edges[1:])) if found[a:b].any()]
        none = pa.nulls(len(told), pa.int64())
        return pa.table({c: none for c in HEAD} | {"slot": group.column("slot").combine_chunks().take(pa.array([k for k, _ in told], pa.int64())), "packed": pa.array([x for _, x in told], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(meet, HEAD_SCHEMA)


def counted(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """A row for each document: slot, doc_id, n (set size), m1, m2 (marks of the set), chosen (how many of its n-grams are
    counted); and rows with slot and packed: how many of these other documents of a slice have as well."""
    share = min(64, 112 * (100 - percent) // 100)  # of 64: over twice as many as a partner may lack, less for small sets

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in sliced(batches, "text"):
            for begin in range(0, whole.num_rows, MOST_ROWS):
                batch = whole.slice(begin, MOST_ROWS)
                bounds, data = text_bytes(batch.column("text"))
                owner, grams = ngram_sets(data, bounds, n)
                yield from entries_of(owner, grams, batch.column("doc_id"), *marks(owner, grams, batch.num_rows), share, number, buckets)
                number += 1

    return met(docs.mapInArrow(emit, f"bucket int, {HEAD_SCHEMA}"))


def lone_share(percent: int) -> F.Column:
    """Whether a set can have a partner, by the number of its n-grams that no other one has."""
    return (F.col("n") > 0) & (F.col("chosen") - F.coalesce("shared", F.lit(0)) <= F.floor(F.col("n") * (100 - percent) / 100))


def with_partners(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """The sets (cid, k, grams) without those of whose n-grams too many are in no other of these sets. Unlike the first count
    this one takes all n-grams, and copies of a set count once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for whole in sliced(batches, "grams"):
            for begin in range(0, whole.num_rows, MOST_ROWS):
                batch = whole.slice(begin, MOST_ROWS)
                each = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("grams")]
                size = np.array([len(x) for x in each], np.int64)
                none = np.zeros(len(each), np.int64)
                yield from entries_of(np.repeat(np.arange(len(each)), size), np.concatenate(each), batch.column("cid"), size, none, none, 64, number, buckets)
                number += 1

    first = staged(met(sets.select("cid", "grams").mapInArrow(emit, f"bucket int, {HEAD_SCHEMA}")))
    rows = first.filter("packed is null").join(shared_counts(first), "slot", "left").filter(lone_share(percent))
    out = staged(sets.join(rows.select(F.col("doc_id").alias("cid")), "cid", "left_semi"))
    dropped(first)
    return out


def tally(docs: np.ndarray) -> np.ndarray:
    ids, n = np.unique(docs, return_counts=True)
    return np.stack([ids, n], axis=1).astype(np.int32)


def shared_counts(first: DataFrame) -> DataFrame:
    """slot, shared."""

    def add(group: pa.Table) -> pa.Table:
        pairs = np.concatenate([np.frombuffer(x.as_py(), np.int32).reshape(-1, 2) for x in group.column("packed")])
        ids, at = np.unique(pairs[:, 0], return_inverse=True)
        return pa.table({"slot": pa.array(ids.astype(np.int64) + group.column("slot")[0].as_py()), "shared": pa.array(np.bincount(at, pairs[:, 1]).astype(np.int64))})

    return first.filter("packed is not null").select("slot", "packed").groupBy("slot").applyInArrow(add, "slot long, shared long")


PAIR = np.dtype([("name", "<u8"), ("cid", "<i8")])


def local_bucket(part: int, number: int, buckets: int) -> int:
    """Where the links go that a batch has inside of itself: one of as many buckets as bundles have, below 0."""
    return -1 - (part * 7919 + number) % buckets


def sent(name: np.ndarray, cid: np.ndarray, local: int, buckets: int) -> list[pa.Array]:
    """bucket, packed: what a slice tells of its (name, set) pairs. The links that it has inside of itself go to the bucket `local`."""
    entries = np.empty(len(name), PAIR)
    entries["name"], entries["cid"] = name, cid
    entries = entries[np.argsort(name, kind="stable")]
    name, cid = entries["name"], entries["cid"]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    u, v = forest(cid[1:][~new[1:]], cid[:-1][~new[1:]])
    entries = entries[new]  # a name that a slice has several times travels once
    cut = [(k, packed(entries[at])) for k, at in by_range(entries["name"], buckets)] + ([(local, packed(np.concatenate([u, v])))] if len(u) else [])
    return [pa.array([k for k, _ in cut], pa.int32()), pa.array([x for _, x in cut], pa.binary())]


def edges_of(rows: DataFrame) -> DataFrame:
    """The rows of sent() -> u, v: edges between sets with an equal name."""

    def meet(group: pa.Table) -> pa.Table:
        blobs = group.column("packed")
        if group.column("bucket")[0].as_py() < 0:
            u, v = np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(2, -1) for x in blobs], axis=1)
        else:
            entries = np.concatenate([np.frombuffer(x.as_py(), PAIR) for x in blobs])
            entries = entries[np.argsort(entries["name"], kind="stable")]
            equal = entries["name"][1:] == entries["name"][:-1]
            u, v = entries["cid"][1:][equal], entries["cid"][:-1][equal]
        u, v = forest(u, v)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.groupBy("bucket").applyInArrow(meet, "u long, v long")


def bundle_edges(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Edges between sets with an equal bundle."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(sliced(batches, "grams")):
            each = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("grams")]
            size = np.array([len(x) for x in each], np.int64)
            doc, name = bundle_names(np.repeat(np.arange(len(each)), size), np.concatenate(each), size, percent)
            yield pa.RecordBatch.from_arrays(sent(name, batch.column("cid").to_numpy()[doc], local_bucket(part, number, buckets), buckets), names=["bucket", "packed"])

    return edges_of(sets.select("cid", "grams").mapInArrow(emit, "bucket int, packed binary"))


COUNT = np.dtype([("name", "<u8"), ("n", "<u4")])


def prefixes(size: np.ndarray, name: np.ndarray, found: np.ndarray, percent: int) -> np.ndarray:
    """Which n-grams of the sets (size of each, names one set after the other, how many sets have the name) are in their set's
    prefix: so many of the rarest that a partner lacking all of them would be below the threshold. Names of one set only link nothing."""
    owner = np.repeat(np.arange(len(size)), size)
    place = np.empty(len(name), np.int64)
    place[np.lexsort((name, found, owner))] = np.arange(len(name)) - np.repeat(np.cumsum(size) - size, size)
    return (place <= size[owner] + (-percent * size // 100)[owner]) & (found > 1)


def prefix_edges(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges between sets of one group (cid, comp, k) that have an n-gram of their prefixes in common. All sets of a group order n-grams
    alike, so the first that two linked sets share is in both prefixes."""
    buckets = int((groups.agg(F.sum("k")).first()[0] or 0) // ENTRIES_PER_BUCKET + 8)
    placed = groups.select("cid", "comp").dropDuplicates(["cid"])
    rows = staged(sets.select("cid", "grams").join(placed, "cid").withColumn("slice", F.pmod(F.xxhash64("cid"), F.lit(buckets)).cast("int")))

    def names(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("grams")]
        size = np.array([len(x) for x in each], np.int64)
        return size, mixed(np.concatenate(each) + np.repeat(mixed(group.column("comp").to_numpy().view(np.uint64)), size))

    def emit(group: pa.Table) -> pa.Table:
        name, n = np.unique(names(group)[1], return_counts=True)
        entries = np.empty(len(name), COUNT)
        entries["name"], entries["n"] = name, n
        cut = [(k, packed(entries[at])) for k, at in by_range(name, buckets)]
        return pa.table({"bucket": pa.array([k for k, _ in cut], pa.int32()), "slice": pa.array([group.column("slice")[0].as_py()] * len(cut), pa.int32()), "packed": pa.array([x for _, x in cut], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), COUNT) for x in group.column("packed")]
        entries = np.concatenate(parts)
        _, at = np.unique(entries["name"], return_inverse=True)
        found = np.bincount(at, entries["n"]).astype(np.uint32)[at]
        edges = np.cumsum([0] + [len(x) for x in parts])
        return group.select(["bucket", "slice"]).append_column("packed", pa.array([packed(found[a:b]) for a, b in zip(edges, edges[1:])], pa.binary()))

    def share(group: pa.Table, counts: pa.Table) -> pa.Table:
        size, name = names(group)
        blobs = counts.column("packed")
        found = np.concatenate([np.frombuffer(blobs[k].as_py(), np.uint32) for k in np.argsort(counts.column("bucket").to_numpy()).tolist()])
        _, at = np.unique(name, return_inverse=True)
        keep = prefixes(size, name, found[at], percent)
        cid = np.repeat(group.column("cid").to_numpy(), size)
        return pa.table(sent(name[keep], cid[keep], -1 - group.column("slice")[0].as_py(), buckets), names=["bucket", "packed"])

    counts = rows.groupBy("slice").applyInArrow(emit, "bucket int, slice int, packed binary").groupBy("bucket").applyInArrow(count, "bucket int, slice int, packed binary")
    out = staged(edges_of(rows.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(share, "bucket int, packed binary")))
    dropped(rows)
    return out


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlap counts of the sets left against the sets right: incidence matrices multiplied by blocks of columns."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    grams, column, shared = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = shared[column] > 1
    owner, column = owner[keep], (np.cumsum(shared > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    counts = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, width, COLUMNS):
        at = slice(*np.searchsorted(column, [start, start + COLUMNS]))
        block = np.zeros((len(sets), min(COLUMNS, width - start)), np.float32)
        block[owner[at], column[at] - start] = 1
        counts += block[left] @ block[right].T
    return counts


def compare(group: pa.Table, percent: int) -> pa.Table:
    """A block pair of a candidate group: the links found, as a forest."""
    _, once = np.unique(group.column("cid").to_numpy(), return_index=True)  # repeated rows
    group = group.take(pa.array(once))
    side = group.column("side").to_numpy()
    cid = group.column("cid").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
    left = np.flatnonzero(side == 0)
    alone = bool(group.column("alone")[0].as_py())
    right = left if alone else np.flatnonzero(side == 1)
    u = v = np.zeros(0, np.int64)
    if len(left) and len(right):
        sizes = np.array([len(x) for x in sets], np.int64)
        bound = percent * (sizes[left][:, None] + sizes[right][None, :])
        i, j = np.nonzero((100 + percent) * overlaps(sets, left, right).astype(np.int64) >= bound)
        u, v = forest(cid[left[i]], cid[right[j]])
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def with_sets(rows: DataFrame, n: int) -> DataFrame:
    """cid, m1, m2, text -> cid, k (size), grams (packed), where the set is the one that is marked."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            bounds, data = text_bytes(batch.column("text"))
            owner, grams = ngram_sets(data, bounds, n)
            size, m1, m2 = marks(owner, grams, batch.num_rows)
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            coded = [packed(grams[a:b]) for a, b in zip(edges, edges[1:])]
            out = pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(size), pa.array(coded, pa.binary())], names=["cid", "k", "grams"])
            yield out.filter(pa.array((m1 == batch.column("m1").to_numpy()) & (m2 == batch.column("m2").to_numpy())))

    return rows.select("cid", "m1", "m2", "text").mapInArrow(build, "cid long, k long, grams binary")


def products(sets: DataFrame, laid: DataFrame, percent: int) -> DataFrame:
    """cid, comp, i, j, side, alone -> u, v: the links of all block pairs."""
    pairs = sets.select("cid", "grams").join(laid, "cid").repartition("comp", "i", "j")  # else the join's partitions stay, and all blocks of a set meet in one task
    return staged(pairs.groupBy("comp", "i", "j").applyInArrow(lambda t: compare(t, percent), "u long, v long"))


def linked_in_groups(sets: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """id, component: sets (by cid) that links connect, inside of candidate groups."""
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("all") / BLOCK_NGRAMS), F.lit(1)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("cid"), n.cast("long")).cast("int")
    pair = lambda i, j, side, alone: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side"), alone.alias("alone"))

    def laid(narrow: DataFrame, total: int) -> DataFrame:
        sizes = narrow.groupBy("comp").agg(F.count("*").alias("rows"), F.sum("k").alias("all"))
        return staged(joined(narrow, sizes, ["comp"], "rows", total).select("cid", "comp", "k", blocks.alias("blocks")).withColumn("b", own(F.col("blocks"))))

    narrow = staged(sets.select("cid", "k").join(candidates.select(F.col("id").alias("cid"), F.col("component").alias("comp")), "cid"))
    total = narrow.count()
    placed = laid(narrow, total)
    dropped(narrow)
    large = placed.filter(F.col("blocks") > WHOLE_BLOCKS)
    if not large.isEmpty():
        edges = prefix_edges(sets, large, percent)
        closer = components(edges).select(F.col("id").alias("cid"), F.col("component").alias("comp"))
        narrow = staged(placed.filter(F.col("blocks") <= WHOLE_BLOCKS).select("cid", "comp", "k").unionByName(large.select("cid", "k").join(closer, "cid").select("cid", "comp", "k")))
        dropped(edges, placed)
        total = narrow.count()
        placed = laid(narrow, total)
        dropped(narrow)
    zero, no = F.lit(0), F.lit(False)
    first = F.when(F.col("b") == 0, F.transform(F.sequence(zero, F.col("blocks") - 1), lambda j: pair(zero, j, 0, j == 0))).otherwise(F.array(pair(zero, F.col("b"), 1, no)))
    links = products(sets, placed.select("cid", "comp", F.explode(first).alias("p")).select("cid", "comp", "p.*"), percent)
    groups = staged(components(links))
    dropped(links)
    open_ = placed.filter("blocks > 1")
    if not open_.isEmpty():
        parts = open_.join(groups.select(F.col("id").alias("cid"), F.col("component").alias("part")), "cid", "left").select("cid", "comp", "k", F.coalesce("part", F.lit(-1)).alias("part"))
        parts = staged(parts)
        # Groups of at least BLOCK_ROWS linked sets keep their number; the others, and sets without links, are -1.
        labelled = staged(joined(parts, parts.groupBy("comp", "part").agg(F.count("*").alias("size")), ["comp", "part"], "size", total).select("cid", "comp", "k", F.when(F.col("size") >= BLOCK_ROWS, F.col("part")).otherwise(-1).alias("part")))
        cut = labelled.groupBy("comp", "part").agg(F.count("*").alias("rows"), F.sum("k").alias("all")).select("comp", "part", "rows", blocks.alias("blocks"))
        of_group = Window.partitionBy("comp").orderBy("part")
        cut = cut.withColumn("from", F.sum("blocks").over(of_group).cast("int") - F.col("blocks")).withColumn("end", F.sum("blocks").over(Window.partitionBy("comp")).cast("int"))
        members = joined(labelled, cut, ["comp", "part"], "rows", total).withColumn("b", F.col("from") + own(F.col("blocks")))
        others = F.filter(F.sequence(zero, F.col("end") - 1), lambda j: (F.col("part") < 0) | (j < F.col("from")) | (j >= F.col("from") + F.col("blocks")))
        rest = F.transform(others, lambda j: F.when(F.col("b") <= j, pair(F.col("b"), j, 0, j == F.col("b"))).otherwise(pair(j, F.col("b"), 1, no)))
        more = products(sets, members.select("cid", "comp", F.explode(rest).alias("p")).select("cid", "comp", "p.*"), percent)
        before = groups
        groups = staged(components(more.unionByName(before.select(F.col("id").alias("u"), F.col("component").alias("v")))))
        dropped(parts, labelled, more, before)
    dropped(placed)
    return groups


def jaccard_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id. A link: 100 * overlap >= percent * union."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6  # roughly: words of six bytes
    first = staged(counted(docs, n, percent, int(grams * 1.75 * (100 - percent) / 100 // ENTRIES_PER_BUCKET + 8)))
    rows = first.filter("packed is null").join(shared_counts(first), "slot", "left")
    rows = staged(rows.select("doc_id", "slot", "n", "m1", "m2", lone_share(percent).alias("hope")))
    dropped(first)
    key = ["n", "m1", "m2"]
    classes = staged(rows.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("least"), F.min("slot").alias("cid"), F.max("hope").alias("hope"), F.count("*").alias("copies")))
    sets = staged(with_sets(docs.join(classes.filter("hope"), F.col("doc_id").eqNullSafe(F.col("least"))), n))
    for _ in range(PEELED):
        before, inside = sets, sets.agg(F.sum("k")).first()[0] or 0
        sets = with_partners(sets, percent, int(inside // ENTRIES_PER_BUCKET + 8))
        dropped(before)
    inside = sets.agg(F.sum("k")).first()[0] or 0
    candidates = staged(components(bundle_edges(sets, percent, int(inside * 6 * (100 - percent) / (100 + percent) // ENTRIES_PER_BUCKET + 8))))
    groups = linked_in_groups(sets, candidates, percent)
    dropped(sets, candidates)
    of_group = groups.withColumnRenamed("id", "cid").join(classes.select("cid", "least"), "cid")
    least = of_group.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    found = joined(of_group.select("cid", "component"), least, ["component"], "size", groups.count()).select("cid", "component_id")
    named = staged(classes.join(found, "cid", "left").select(*key, "copies", F.coalesce("component_id", "least").alias("component_id")))
    dropped(classes, groups)
    out = joined(rows.filter("n > 0"), named, key, "copies", rows.count()).unionByName(rows.filter("n = 0"), allowMissingColumns=True)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), 3, 90)


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: the document with the smallest id of each group stays, with all its columns; one with a
    null id only if no id of its group is known. Rows that repeat both id and text are one row afterwards; different texts with
    one id are documents of their own. If the keys of two different rows clash, a near copy may stay, but no row goes."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text")).withColumn("__check", F.xxhash64(F.lit(1), "doc_id", "text"))  # ids may be null or repeated
    groups = jaccard_groups(keyed.select(F.col("__key").alias("doc_id"), "text"), n, percent).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    rows = keyed.select("__key", F.col("doc_id").cast("long").alias("id")).distinct().join(groups, "__key")
    stay = staged(rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "__key")).alias("least")).select("least.__key").distinct())
    return keyed.join(stay, "__key", "left_semi").dropDuplicates(["__key", "__check"]).select(*docs.columns)
