"""Length-preserving masking: every match becomes as many X as it has characters.

Step 0 masks every character outside of printable ASCII, line feed and carriage return. Then the rules run in order, each on
what the one before has left, without regard to case. Counts are by character in step 0 and by match for rules; a match of
no characters counts and changes nothing. Null text stays null with null counts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import NON_ASCII, category, compiled, fixed_width, required_text, translated

OUTSIDE = r"[^\x20-\x7E\n\r]"


def mask_text(text: str, rules: list[str]) -> tuple[str, int, dict[str, int]]:
    """(masked text, total, counts by kind) of one string."""
    masked, total, counts, _ = _fold(text, [_compiled(r) for r in rules])
    by_kind: dict[str, int] = {}
    for index, n in enumerate(counts):
        if n:
            kind = NON_ASCII if not index else category(rules[index - 1], index)
            by_kind[kind] = by_kind.get(kind, 0) + n
    return masked, total, by_kind


_outside = re.compile(OUTSIDE)


@lru_cache(4096)
def _compiled(rule: str) -> tuple[re.Pattern, str]:
    return compiled(rule), required_text(rule)


def _crosses(match: re.Match) -> str:
    return "X" * (match.end() - match.start())


def _fold(text: str, rules: list[tuple[re.Pattern, str]], ranges: array | None = None) -> tuple[str, int, list[int], array | None]:
    """Counts are by place: 0 is step 0, k the k-th rule. Start, end and place of every match go to ranges, one after the other."""
    def replace(pattern: re.Pattern, text: str, index: int) -> tuple[str, int]:
        if ranges is not None:
            for m in pattern.finditer(text):
                ranges.extend((*m.span(), index))
        return pattern.subn(_crosses, text)

    text, n = (text, 0) if text.isascii() and text.isprintable() else replace(_outside, text, 0)
    counts = [n]
    low = None
    for index, (pattern, needed) in enumerate(rules, 1):
        if needed:
            low = text.lower() if low is None else low
            if needed not in low:
                counts.append(0)
                continue
        text, n = replace(pattern, text, index)
        counts.append(n)
        if n:
            low = None
    return text, sum(counts), counts, ranges


def mask_ranges(text: str, rules: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
    """(masked text, [(start, end, kind)]): masking keeps lengths, so ranges fit the original text as well."""
    masked, _, _, found = _fold(text, [_compiled(r) for r in rules], array("i"))
    names = kinds(rules)
    return masked, [(a, b, names[k]) for a, b, k in zip(found[::3], found[1::3], found[2::3])]


SLICE_BYTES, SLICE_MATCHES = 2 << 20, 100_000  # of text, and of ranges, that a worker holds as Python objects


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the text of each slice stays near SLICE_BYTES: a batch may hold ten thousand texts. One row is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if row > start and held + size > SLICE_BYTES:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def is_native(rules: list[str]) -> bool:
    """Can all rules run in the JVM? They build on each other, so one that can't moves all of them."""
    return all(translated(r) is not None for r in rules)


def masked(df: DataFrame, column: str, rules: list[str], native: bool | None = None) -> DataFrame:
    """df with `masked` (string), `hits` (array<long>: step 0, then each rule) and `total`."""
    if native is None:
        native = is_native(rules)
    out = _native(df, column, rules) if native else _in_python(df, column, rules)
    return out.withColumn("total", F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x))


def _native(df: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """One projection for each rule: a check for the text that a match needs, a count, and a replacement where it is not 0.
    Masking only writes X, so needed text without an x that is not there at first is never there."""
    text, low, counts = "__text", "__low", ["__n0"]
    df = df.withColumn(counts[0], F.regexp_count(F.col(column), F.lit(OUTSIDE)).cast("long"))
    df = df.withColumn(text, F.when(F.col(counts[0]) > 0, F.regexp_replace(F.col(column), OUTSIDE, "X")).otherwise(F.col(column)))
    df = df.withColumn(low, F.lower(text))
    for index, rule in enumerate(rules, 1):
        pattern, width, needed, n = translated(rule), fixed_width(rule), required_text(rule), f"__n{index}"
        now = F.col(text)
        possible = F.contains(F.lower(now) if "x" in needed else F.col(low), F.lit(needed)) if needed else now.isNotNull()
        if width:
            df = df.withColumn(n, F.when(possible, F.regexp_count(now, F.lit(pattern)).cast("long")).when(now.isNotNull(), F.lit(0).cast("long")))
            changed = F.regexp_replace(now, pattern, "X" * width)
        else:
            matches = f"__m{index}"
            df = df.withColumn(matches, F.when(possible, F.regexp_extract_all(now, F.lit(pattern), F.lit(0))).when(now.isNotNull(), F.array().cast("array<string>")))
            df = df.withColumn(n, F.when(now.isNotNull(), F.size(matches).cast("long")))
            crosses = F.transform(matches, lambda m: F.repeat(F.lit("X"), F.length(m)))
            changed = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(F.split(now, pattern, -1).alias("a"), F.concat(crosses, F.array(F.lit(""))).alias("b")), lambda x: F.array(x["a"], x["b"]))))
        df = df.withColumn(text, F.when(F.col(n) > 0, changed).otherwise(now)).drop(*([] if width else [matches]))
        counts.append(n)
    # The results pass through a generator of one row: filters on other columns go below it, to the scan, but one on the
    # results does not. It would be rewritten in terms of the column, and the expression doubles with every rule.
    hits = F.when(F.col(column).isNotNull(), F.array(*counts))
    done = F.struct(F.col(text).alias("masked"), hits.alias("hits"))
    own = [c for c in df.columns if c not in (text, low, *counts)]
    return df.select(*own, F.explode(F.array(done)).alias("__done")).select(*own, "__done.masked", "__done.hits")


def _in_python(df: DataFrame, column: str, rules: list[str]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("masked", T.StringType()), T.StructField("hits", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_compiled(r) for r in rules]
        for batch in sliced(batches, column):
            done = [(None, None) if x is None else _fold(x, own)[0:3:2] for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.int64()))], names=[*batch.schema.names, "masked", "hits"])

    return df.mapInArrow(run, schema)


def kinds(rules: list[str]) -> list[str]:
    """The kind of each place in hits."""
    return [NON_ASCII, *(category(r, i) for i, r in enumerate(rules, 1))]


def hits_by_kind(hits, rules: list[str]):
    """map<kind, count> of the kinds that occur."""
    names = kinds(rules)
    order = list(dict.fromkeys(names))
    sums = [sum((F.element_at(hits, i + 1) for i, k in enumerate(names) if k == kind), F.lit(0).cast("long")) for kind in order]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*sums)), lambda _, n: n > 0)


def with_ranges(df: DataFrame, column: str, rules: list[str]) -> DataFrame:
    """Adds masked and ranges: every match with its place in the text and its kind. Null text stays null."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*df.schema.fields, T.StructField("masked", T.StringType()), T.StructField("ranges", kind)])
    names = kinds(rules)

    def listed(found: list[array | None]) -> pa.Array:
        """The ranges of several texts, each as numbers one after the other: start, end and place of the rule."""
        flat = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in found if x)]).reshape(-1, 3)
        sizes = np.array([len(x) // 3 if x else 0 for x in found])
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.array([*(x is None for x in found), False]))
        told = pa.DictionaryArray.from_arrays(pa.array(flat[:, 2]), pa.array(names, pa.string())).cast(pa.string())
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), told], names=["start", "end", "kind"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_compiled(r) for r in rules]
        for batch in sliced(batches, column):
            texts, found, first, n = [], [], 0, 0
            for row, value in enumerate(batch.column(column), 1):
                text = value.as_py()
                places = None if text is None else array("i")
                texts.append(None if text is None else _fold(text, own, places)[0])
                found.append(places)
                n += len(places or ()) // 3
                if n >= SLICE_MATCHES or row == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, row - first).columns, pa.array(texts, pa.string()), listed(found)], names=[*batch.schema.names, "masked", "ranges"])
                    texts, found, first, n = [], [], row, 0

    return df.mapInArrow(run, schema)
