"""Lines of text files, read by byte ranges.

A Python data source whose partitions are ranges of files, so that one file is read by many tasks and its size has no limit. A line belongs
to the range in which it begins: a range passes over what comes before its first line end, and reads on behind its own end to the
end of its last line. The encoding is told once for each file, from its first 64 KiB, as everywhere; ranges keep to whole units of two
bytes in UTF-16. Numbers of lines are sums over the ranges before: ranges are counted first, without decoding, and the counts joined.

Paths are local or URIs that pyarrow's file systems know. A task holds a block and one line at a time. A file that is no text gives
one row with an error and no line, and so does a range from the block on whose bytes its encoding doesn't allow; an empty file has no lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.encoding import LINE, SAMPLE, detect
from .shared import written

RANGE_BYTES = 64 << 20
TASK_BYTES = 16 << 20  # small ranges are read by one task up to so many bytes
BLOCK = 1 << 20
BATCH_LINES, BATCH_BYTES = 10_000, 4 << 20
LINES = "file string, range int, place long, line string, error string"
COUNTS = "file string, range int, lines long"
NOT_TEXT = "Unsupported text encoding or binary content"
_line = re.compile(LINE)


@dataclass
class Range(InputPartition):
    path: str
    file: str
    number: int
    start: int
    stop: int
    size: int
    codec: str | None
    mark: int


@dataclass
class Ranges(InputPartition):
    """Several ranges, one after the other."""

    ranges: list[Range]


def together(ranges: list[Range], size: int) -> Iterator[Ranges]:
    """Ranges in order, as many in a partition as have so many bytes; one that is larger stays alone."""
    held, total = [], 0
    for each in ranges:
        if held and total + each.stop - each.start > size:
            yield Ranges(held)
            held, total = [], 0
        held.append(each)
        total += each.stop - each.start
    if held:
        yield Ranges(held)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/|/", path):
        return fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.range_bytes = max(2, int(options.get("rangebytes", RANGE_BYTES)))
        self.counting = options.get("counting", "false").lower() == "true"
        self.whole = options.get("wholecharacters", "false").lower() == "true"
        self.task_bytes = int(options.get("taskbytes", 0))

    def partitions(self) -> list[Range] | list[Ranges]:
        """The ranges of all files below the path: names and lengths, and the encoding told from a sample of each file. A partition is one of
        them, or as many as have taskBytes, if that is given."""
        system, root = opened(self.path)
        at = system.get_file_info(root)
        found = [at] if at.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda name: any(p[:1] in ("_", ".") for p in name.split("/"))
        name = lambda f: f.path[len(root) :].lstrip("/") or f.base_name
        files = sorted((f for f in found if f.is_file and not hidden(name(f))), key=lambda f: f.path)

        def told(file: fs.FileInfo) -> list[Range]:
            with system.open_input_file(file.path) as stream:
                kind = detect(stream.read(SAMPLE), self.whole)
            codec, mark = (kind[0], len(kind[1])) if kind else (None, 0)
            step = self.range_bytes - self.range_bytes % 2
            cuts = [0, *range(mark + step, file.size, step), file.size] if codec else [0, file.size]
            return [Range(file.path, name(file), k, a, b, file.size, codec, mark) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]

        with ThreadPoolExecutor(16) as pool:
            ranges = [r for own in pool.map(told, files) for r in own]
        return list(together(ranges, self.task_bytes)) if self.task_bytes else ranges

    def read(self, partition: Range | Ranges) -> Iterator[pa.RecordBatch]:
        system = opened(self.path)[0]
        for part in partition.ranges if isinstance(partition, Ranges) else [partition]:
            with system.open_input_file(part.path) as stream:
                yield from (counted if self.counting else decoded)(part, stream)


def raw_lines(part: Range, stream) -> Iterator[bytes]:
    """The bytes of the lines that begin in a range, with their ends: many lines at once inside of the range, single ones at its borders."""
    unit = 2 if part.codec.startswith("utf-16") else 1
    feed, back = "\n".encode(part.codec), "\r".encode(part.codec)
    # Behind the last line end before the range or across its border: its last unit lies one before the range.
    at = part.start - unit if part.number else part.mark
    stream.seek(at)
    held, begun, done = b"", at, False  # begun: where in the file held begins
    block = min(BLOCK, max(4096, (part.stop - at) // 2 * 2 + 4096))  # of a small range no more than it and the rest of its last line
    skipping = part.number > 0
    while True:
        more = stream.read(block) if not done else b""
        done, block = len(more) < block, min(BLOCK, 2 * block)
        held += more
        place, found = 0, {feed: -1, back: -1}  # the next of either, looked for once
        if not skipping and (end := _last(held, feed, part.stop - begun, unit)):
            yield held[:end]
            place = end
        while True:
            for what, known in found.items():
                if known < place:
                    found[what] = _find(held, what, place, unit)
            first = min(found.values())
            end = first + unit
            if first == len(held):  # no end is left
                if skipping and begun + len(held) >= part.stop:  # the range lies inside of a line
                    return
                break
            if first == found[back]:
                if end >= len(held) and not done:  # a last \r waits for what follows
                    break
                end += unit * held.startswith(feed, end)
            if skipping:
                skipping = False
            elif begun + place < part.stop:
                yield held[place:end]
            place = end
            if begun + place >= part.stop:
                return
        held, begun = held[place:], begun + place
        if done:
            if held and not skipping and begun < part.stop:
                yield held
            return


def _last(held: bytes, what: bytes, stop: int, unit: int) -> int:
    """Where the last one before stop ends, at a border of units; 0 if nowhere."""
    at = held.rfind(what, 0, max(0, stop))
    while at >= 0 and at % unit:
        at = held.rfind(what, 0, at + unit - 1)
    return at + unit if at >= 0 else 0


def _find(held: bytes, what: bytes, start: int, unit: int) -> int:
    """Where it is next, at a border of units; the end if nowhere."""
    at = held.find(what, start)
    while at >= 0 and (at - start) % unit:
        at = held.find(what, at + 1)
    return at if at >= 0 else len(held)


def decoded(part: Range, stream) -> Iterator[pa.RecordBatch]:
    def batch(lines: list[str | None], first: int, error: str | None = None) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([part.file] * n, pa.string()), pa.array([part.number] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(lines, pa.string()), pa.array([error] * n, pa.string())], names=["file", "range", "place", "line", "error"])

    if part.codec is None:
        yield batch([None], 0, f"{NOT_TEXT}: {part.file}")
        return
    lines, size, first = [], 0, 0
    try:
        for raw in raw_lines(part, stream):
            lines += _line.findall(raw.decode(part.codec))
            size += len(raw)
            if len(lines) >= BATCH_LINES or size > BATCH_BYTES:
                yield batch(lines, first)
                first, lines, size = first + len(lines), [], 0
    except UnicodeDecodeError:
        yield batch(lines, first)
        yield batch([None], first + len(lines), f"not {part.codec} throughout: {part.file}")
        return
    if lines:
        yield batch(lines, first)


def counted(part: Range, stream) -> Iterator[pa.RecordBatch]:
    ends = [x.encode(part.codec) for x in ("\n", "\r", "\r\n")] if part.codec else []
    n = 0
    for raw in raw_lines(part, stream) if part.codec else ():
        if len(ends[0]) == 1:
            feeds, backs, both = map(raw.count, ends)
            n += max(1, feeds + backs - both)
        else:
            n += sum(1 for _ in _line.finditer(raw.decode(part.codec, "replace")))
    yield pa.RecordBatch.from_arrays([pa.array([part.file]), pa.array([part.number], pa.int32()), pa.array([n], pa.int64())], names=["file", "range", "lines"])


class TextRanges(DataSource):
    """Format text_ranges. Options: path, rangeBytes, taskBytes, counting (a row with the number of lines for each range, in place of the lines),
    wholeCharacters (a character that the end of the sample cuts doesn't speak against UTF-8)."""

    @classmethod
    def name(cls) -> str:
        return "text_ranges"

    def schema(self) -> str:
        return COUNTS if self.options.get("counting", "false").lower() == "true" else LINES

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def scan_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, whole_characters: bool = False) -> DataFrame:
    """file (relative to the path), line_no (from 1), line (with its end), error."""
    spark.dataSource.register(TextRanges)
    read = spark.read.format("text_ranges").option("path", path).option("rangeBytes", range_bytes).option("taskBytes", TASK_BYTES).option("wholeCharacters", str(whole_characters))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # A row for each range; Spark broadcasts the written table where its size allows.
    firsts = written(read.option("counting", "true").load().select("file", "range", F.coalesce(before, F.lit(0)).alias("before")))
    lines = read.option("counting", "false").load()
    numbered = lines.join(firsts, ["file", "range"]).withColumn("line_no", F.when(F.col("error").isNull(), F.col("before") + F.col("place") + 1))
    return numbered.select("file", "line_no", "line", "error")


def checked_lines(lines: DataFrame) -> DataFrame:
    """Fails if a file could not be read as text."""
    return lines.withColumn("line", F.when(F.col("error").isNull(), F.col("line")).otherwise(F.raise_error(F.col("error")).cast("string")))


def line_units(lines: DataFrame) -> DataFrame:
    """file, ordinal, location, text: lines as units of an audit."""
    return checked_lines(lines).select("file", F.col("line_no").alias("ordinal"), F.concat(F.lit("Line "), F.col("line_no").cast("string")).alias("location"), F.col("line").alias("text"))
