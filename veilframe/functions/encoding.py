"""Text encodings: detection on the first 64 KiB, strict decoding and encoding, lines with their ends."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 64 * 1024
MARKS = [("utf-8", codecs.BOM_UTF8), ("utf-16-le", codecs.BOM_UTF16_LE), ("utf-16-be", codecs.BOM_UTF16_BE)]
#: A line with its end (\r\n, \r or \n), or a last line without one.
LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$"


def printable_share(text: str) -> float:
    if not text:
        return 1.0
    odd = [c for c in set(text) if not (c.isprintable() or c in "\r\n\t")]
    return (len(text) - sum(map(text.count, odd))) / len(text)


def utf16_without_mark(sample: bytes) -> str | None:
    """Told by where the zero bytes are."""
    if len(sample) < 8:
        return None
    even, odd = sample[::2], sample[1::2]
    shares = even.count(0) / len(even), odd.count(0) / len(odd)
    if shares[1] >= 0.30 and shares[0] <= 0.05:
        return "utf-16-le"
    return "utf-16-be" if shares[0] >= 0.30 and shares[1] <= 0.05 else None


def _reads(sample: bytes, codec: str, share: float) -> bool:
    try:
        return printable_share(sample.decode(codec)) >= share
    except UnicodeDecodeError:
        return False


def whole_characters(sample: bytes) -> bytes:
    """Without a UTF-8 character at its end that is cut off."""
    for k in range(1, min(3, len(sample)) + 1):
        lead = sample[-k]
        if lead >= 0xC0:
            return sample[:-k] if k < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4) else sample
        if lead < 0x80:
            break
    return sample


def detect(content: bytes, whole: bool = False) -> tuple[str, bytes] | None:
    """(codec, byte order mark) of text, None if it does not look like text. A character that the end of the sample cuts makes
    UTF-8 fail, and the content may then count as cp1252, unless only whole characters of the sample are asked for."""
    sample = content[:SAMPLE]
    if whole and len(sample) == SAMPLE:
        sample = whole_characters(sample)
    for codec, mark in MARKS:
        if sample.startswith(mark):
            return codec, mark
    if b"\0" in sample:
        codec = utf16_without_mark(sample)
        return (codec, b"") if codec and _reads(sample, codec, 0.90) else None
    for codec, share in (("utf-8", 0.90), ("cp1252", 0.95)):
        if _reads(sample, codec, share):
            return codec, b""
    return None


def with_encoding(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds codec and mark (null where the content is not text)."""
    schema = T.StructType([*files.schema.fields, T.StructField("codec", T.StringType()), T.StructField("mark", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(x) if x is not None else None for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.binary())], names=[*batch.schema.names, "codec", "mark"])

    return files.mapInArrow(run, schema)


def lines(text):
    """array<string> of lines with their ends."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def with_lines(df: DataFrame, text: str) -> DataFrame:
    """A row for each line: line_no (from 1) and line. Null and empty texts have none."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
