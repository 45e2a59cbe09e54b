"""Pieces that several operators share: tables, the shared folder, Arrow text buffers and hashes of byte ranges."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 2 << 20  # text handled at once in a worker


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, where all is one machine, may
    leave it unset; it gets a folder made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            found = tempfile.mkdtemp(prefix="veilframe-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here and survives lost executors. dropped() takes it back."""
    path = staged_path(df)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def staged_path(df: DataFrame) -> str:
    """Writes df to a new place in the shared folder. The shuffles of the write go as soon as it is done: nothing reads them again."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/veilframe-{uuid.uuid4().hex}", spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return path


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables that nothing reads any more."""
    for x in tables:
        drop_path(x.sparkSession, x.staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a staged table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each slice stays near the limit; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Workers live on between tasks: what allocators hold but don't use goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, data): UTF-8 bytes of the rows one after the other; row i is data[bounds[i]:bounds[i + 1]]. Null counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    bounds = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    buffer = filled.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    data = data[bounds[0] : bounds[-1]] if len(bounds) else data
    return bounds - (bounds[0] if len(bounds) else 0), data


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (the splitmix64 constants)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """Polynomial hashes of byte ranges modulo 2**64 from prefix sums, with a random odd value for each byte value. Hashes of one
    base share the tables of its powers."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int, base: int = 0x5851F42D4C957F2D):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = base

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse, n of each at least."""
        known = self._tables.get(self.base)
        if known is None or len(known[0]) < n:
            n = -(-n // 65536) * 65536
            known = []
            for by in (self.base, pow(self.base, -1, 2**64)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                known.append(np.multiply.accumulate(steps))
            self._tables[self.base] = tuple(known)
        return self._tables[self.base]

    def symbols(self, data: np.ndarray) -> np.ndarray:
        return self.values[data]

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.symbols(data) * self._powers(len(data) + 1)[0][: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Raw hashes; use mixed() before taking bits of them. Ranges of other lengths should be told apart by the caller."""
        return (sums[ends] - sums[starts]) * self._powers(len(sums))[1][starts]


class WindowHash(RangeHash):
    """The same over mixed windows of eight bytes, with another base: independent of RangeHash, and strings of few letters
    that clash there by their structure don't here. Ranges have eight bytes or more."""

    def __init__(self, seed: int):
        super().__init__(seed, 0xDA942042E4DD58B5)

    def symbols(self, data: np.ndarray) -> np.ndarray:
        window = data.astype(np.uint64)
        for width in (1, 2, 4):  # bytes beyond the end count as zeros; of() uses no such window
            window[:-width] |= window[width:] << np.uint64(8 * width)
        return mixed(window ^ self.values[0])

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return super().of(sums, starts, ends - 7)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
