"""From matches to boxes on a page: which rectangles cover the characters of a match.

A page is a map of its characters: for each its place in the text, its line and its box; line ends have no box. Matches are ranges of places.
The join of ranges with characters is an equi-join by bins of BIN places: a row holds the characters of a bin, a range goes to the
bins that it touches, and what lies outside of it is cut off inside of the row. A match gets a box for each line that it touches; one
without any box (only line ends) has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import box_around

BIN = 64
CELLS = "array<struct<pos:int,line:int,box:array<double>>>"


def binned(characters: DataFrame, key: str) -> DataFrame:
    """key, pos, line, box (a row for each character) -> key, bin, cells: a row for each bin."""
    cell = F.struct(F.col("pos").cast("int").alias("pos"), F.col("line").cast("int").alias("line"), "box")
    return characters.groupBy(key, F.floor(F.col("pos") / BIN).cast("int").alias("bin")).agg(F.collect_list(cell).alias("cells"))


def fixed_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, bin, line, first, begin, last of texts laid out in cells of one size, a line of text below the other: in a bin, a line that begins at
    `first` has the characters from begin to last. Null and empty texts have none."""
    rows = F.transform(F.split(text, "\n"), F.length)
    texts = df.select(F.col(key).alias("__key"), F.monotonically_increasing_id().alias("__text"), rows.alias("rows"))
    lines = texts.select("__key", "__text", F.posexplode("rows").alias("line", "size"))
    # Where a line begins: behind all lines of its text before it and their ends. Narrow rows, as many as one text has lines in a group.
    before = F.sum(F.col("size") + 1).over(Window.partitionBy("__text").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    placed = lines.withColumn("first", F.coalesce(before, F.lit(0)).cast("int")).filter("size > 0")
    last = F.col("first") + F.col("size") - 1
    cut = placed.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / BIN).cast("int"), F.floor(last / BIN).cast("int"))))
    return cut.select(F.col("__key").alias(key), "bin", "line", "first", F.greatest(F.col("first"), F.col("bin") * BIN).alias("begin"), F.least(last, F.col("bin") * BIN + BIN - 1).alias("last"))


def fixed_cells(width: float, height: float) -> Column:
    """The cells of a row of fixed_rows()."""
    left, top = lambda p: (p - F.col("first")) * F.lit(width), F.col("line") * F.lit(height)
    return F.transform(F.sequence("begin", "last"), lambda p: F.struct(p.cast("int").alias("pos"), F.col("line").cast("int").alias("line"), F.array(left(p), top, left(p + 1), top + F.lit(height)).alias("box"))).cast(CELLS)


def range_boxes(ranges: DataFrame, pages: DataFrame, key: str, cells: Column | None = None) -> DataFrame:
    """key, start, end, kind with pages (key, bin and what the cells are made of: by default a column of that name) -> key, start, end, kind, line, box.
    Cells are made behind the join, of the bins that ranges touch. Empty ranges have no box; equal ranges are one."""
    touched = F.sequence(F.floor(F.col("start") / BIN).cast("int"), F.floor((F.col("end") - 1) / BIN).cast("int"))
    dealt = ranges.filter("end > start").select(key, "start", "end", "kind", F.explode(touched).alias("bin"))
    of_bin = dealt.groupBy(key, "bin").agg(F.collect_set(F.struct("start", "end", "kind")).alias("ranges"))  # as many as touch a bin of a page
    met = of_bin.join(pages, [key, "bin"]).withColumn("cells", F.col("cells") if cells is None else cells)
    inside = lambda r, c: (c["pos"] >= r["start"]) & (c["pos"] < r["end"]) & c["box"].isNotNull()
    cut = met.select(key, F.explode("ranges").alias("r"), "cells").select(key, "r.*", F.explode(F.filter("cells", lambda c: inside(F.col("r"), c))).alias("c"))
    return cut.groupBy(key, "start", "end", "kind", F.col("c.line").alias("line")).agg(box_around(F.col("c.box")).alias("box"))
