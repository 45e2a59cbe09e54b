"""A quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over the whole document. Chunks of two BLOCKs that overlap by one are max-pooled, the pooled
responses are rectified, and their mean and their maximum over the chunks feed one logistic unit. A byte's input symbol
also says whether its word repeats one of the two words before it, which no filter of fixed width could see.

The network is trained on the driver from a bounded sample: at most SAMPLE_ROWS labelled rows with texts that aren't empty,
whole, half of each label where there are enough, in the order of a hash of the id. Rows with
crc32(doc_id as text) mod 3 = 1 are held out and never trained on. Scores see nothing but the text. Null and empty texts
are scored as a document of one padding symbol. With no usable labels, or with one class only, every score is the constant
1.0 or 0.0 of the class that there is (1.0 if there is none). Very long texts are scored whole, repeated rows each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, sliced, table, text_bytes

WIDTH, FILTERS, BLOCK = 5, 12, 256
SYMBOLS = 512  # a byte, and whether its word is a repeated one
SAMPLE_ROWS = 2400
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.01, 1e-4
_words = RangeHash(2)
_is_space = np.zeros(256, bool)
_is_space[[9, 10, 11, 12, 13, 32]] = True


def repeated(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word that equals one of the two before it in the same document."""
    out = np.zeros(len(data), bool)
    if not len(data):
        return out
    inside = ~_is_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[(bounds > 0) & (bounds < len(data))]] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | np.r_[edge[1:-1], True])) + 1
    if not len(starts):
        return out
    marks = _words.of(_words.sums(data), starts, ends) + (ends - starts).astype(np.uint64)
    owner = np.searchsorted(bounds, starts, side="right")
    same = np.zeros(len(starts), bool)
    for back in (1, 2):
        same[back:] |= (marks[back:] == marks[:-back]) & (owner[back:] == owner[:-back])
    change = np.zeros(len(data) + 1, np.int8)
    change[starts[same]] += 1
    np.subtract.at(change, ends[same], 1)
    return np.cumsum(change[:-1]).astype(bool)


def laid_out(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first): symbols in whole blocks; first block of each document. A document has WIDTH - 1 zeros before it, so that no window
    sees two documents, and at least one behind it."""
    symbols = data.astype(np.int16) + 256 * repeated(data, bounds)
    lengths = np.diff(bounds)
    blocks = (lengths + WIDTH - 1) // BLOCK + 1
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.int16)
    out[np.arange(len(data)) + np.repeat(first[:-1] * BLOCK + WIDTH - 1 - bounds[:-1], lengths)] = symbols
    return out, first


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.filters = rng.normal(0, 0.3, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.constant: float | None = None

    def responses(self, symbols: np.ndarray, blocks: int) -> np.ndarray:
        n = blocks * BLOCK
        out = self.filters[0][symbols[:n]]
        for j in range(1, WIDTH):
            out += self.filters[j][symbols[j : n + j]]
        return out.reshape(blocks, BLOCK, FILTERS)

    def pooled(self, symbols: np.ndarray, blocks: int, at_once: int = 256) -> np.ndarray:
        """Largest response of each filter in each block."""
        out = np.empty((blocks, FILTERS), np.float32)
        for b in range(0, blocks, at_once):
            stop = min(b + at_once, blocks)
            out[b:stop] = self.responses(symbols[b * BLOCK : stop * BLOCK + WIDTH], stop - b).max(axis=1)
        return out

    @staticmethod
    def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left block, right block, first chunk of each document); a document of one block is one chunk."""
        blocks = np.diff(first)
        n = np.maximum(blocks - 1, 1)
        begin = np.concatenate([[0], np.cumsum(n)])
        left = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
        return left, np.where(np.repeat(blocks > 1, n), left + 1, left), begin

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bounds) - 1, self.constant)
        symbols, first = laid_out(data, bounds)
        peaks = self.pooled(symbols, int(first[-1]))
        left, right, begin = self.chunks(first)
        active = np.maximum(np.maximum(peaks[left], peaks[right]) + self.bias, 0)
        mean = np.add.reduceat(active, begin[:-1], axis=0) / np.diff(begin)[:, None]
        most = np.maximum.reduceat(active, begin[:-1], axis=0)
        raw = np.concatenate([mean, most], axis=1).astype(np.float64) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

    def gradients(self, data: np.ndarray, bounds: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        symbols, first = laid_out(data, bounds)
        blocks = int(first[-1])
        place, peaks = np.empty((blocks, FILTERS), np.int64), np.empty((blocks, FILTERS), np.float32)
        for b in range(0, blocks, 256):
            stop = min(b + 256, blocks)
            response = self.responses(symbols[b * BLOCK : stop * BLOCK + WIDTH], stop - b)
            place[b:stop] = response.argmax(axis=1)
            peaks[b:stop] = np.take_along_axis(response, place[b:stop, None], axis=1)[:, 0]
        place += np.arange(blocks)[:, None] * BLOCK
        left, right, begin = self.chunks(first)
        from_right = peaks[right] > peaks[left]
        active = np.maximum(np.where(from_right, peaks[right], peaks[left]) + self.bias, 0)
        chunk_of = np.where(from_right, place[right], place[left])
        n = np.diff(begin)
        doc = np.repeat(np.arange(len(n)), n)
        mean = np.add.reduceat(active, begin[:-1], axis=0) / n[:, None]
        most = np.maximum.reduceat(active, begin[:-1], axis=0)
        features = np.concatenate([mean, most], axis=1)
        error = ((1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset, -40, 40)))) - labels).astype(np.float32) / len(labels)
        by_mean = (error / n)[doc, None] * self.weights[:FILTERS]
        top = (active == most[doc]) & (active > 0)
        ties = np.maximum(np.add.reduceat(top.astype(np.float32), begin[:-1], axis=0), 1)
        back = np.where(active > 0, by_mean + top * (error[:, None] * self.weights[FILTERS:] / ties)[doc], 0)
        flat = np.zeros_like(self.filters)
        for j in range(WIDTH):
            where = symbols[chunk_of + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
            flat[j] = np.bincount(where.ravel(), back.ravel(), SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS)
        return [flat, back.sum(axis=0), features.T @ error, error.sum(keepdims=True)]

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Network:
        """Adam over shuffled batches; the same texts give the same network."""
        if len(texts) == 0 or labels.min() == labels.max():
            self.constant = float(labels[0]) if len(texts) else 1.0
            return self
        rng = np.random.Generator(np.random.PCG64(11))
        parameters = [self.filters, self.bias, self.weights, self.offset]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                bounds = np.concatenate([[0], np.cumsum([len(texts[i]) for i in own])])
                found = self.gradients(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), bounds, labels[own])
                step += 1
                for p, g, (m, v) in zip(parameters, found, moments):
                    g = g + DECAY * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """The network for documents and labels, from the bounded sample told above."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
    spark, order = docs.sparkSession, F.xxhash64("id")
    chosen = [r for q in (0, 1) for r in known.filter(F.col("quality") == q).orderBy(order, "id").limit(rows).collect()]
    if not chosen:
        return Network().fit([], np.zeros(0))
    few = F.broadcast(spark.createDataFrame([(r["id"], r["quality"]) for r in chosen], "id long, quality int"))  # at most 2 * rows
    usable = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(F.octet_length("text") > 0).join(few, "id").dropDuplicates(["id"])
    sample = []
    per_class = [usable.filter(F.col("quality") == q).orderBy(order, "id").limit(rows // 2) for q in (0, 1)]
    for r in per_class[0].unionByName(per_class[1]).collect():
        sample.append((r["id"], r["text"].encode("utf-8"), r["quality"]))
    sample.sort()
    return Network().fit([x[1] for x in sample], np.array([x[2] for x in sample], np.float32))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, text -> doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            found = shared.value.scores(*reversed(text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array(found >= 0.5).cast(pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return source.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, network: Network) -> DataFrame:
    """The documents that the network does not reject, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            yield batch.filter(pa.array(shared.value.scores(*reversed(text_bytes(batch.column("text")))) >= 0.5))

    return docs.mapInArrow(choose, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
