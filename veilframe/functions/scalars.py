"""Small expressions of the job history and its displays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = 50_000  # of a text, in one batch


def clamp(value, low: int, high: int):
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def human_bytes(value):
    """1536 -> '1.5 KB'; negative and null count as 0. Ties round to even."""
    size = F.greatest(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    out = F.when(size < 1024, F.concat(F.floor(size).cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(size < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(size / 1024.0**power, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(size / 1024.0**4, 1)))


def upload_label(megabytes: int) -> str:
    return f"{megabytes // 1024} GB" if megabytes >= 1024 and megabytes % 1024 == 0 else f"{megabytes} MB"


def progress(done, files):
    """Percent after `done` of `files` files."""
    return 10 + F.floor(done / files * 70).cast("int")


def user_name(value):
    """Lower-cased and trimmed, null if it is empty, too long or has characters that names may not have."""
    name = F.lower(F.trim(value))
    return F.when(F.length(name).between(1, 64) & name.rlike(r"^[\p{L}\p{N}._\-@]+$"), name)


def local_target(value):
    """A local path to go to, '/' for everything else."""
    path = F.trim(F.coalesce(value, F.lit("")))
    return F.when(path.startswith("/") & ~path.startswith("//"), path).otherwise("/")


def example(value, most: int = 260):
    """A text on one line, cut."""
    return F.substring(F.trim(F.regexp_replace(value, r"\s+", " ")), 1, most)


def file_names(value):
    """A JSON array of strings; anything else is an empty one."""
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def iso_seconds(value):
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")


def before_days(now, days: int):
    return now - F.make_dt_interval(F.lit(days))


def spread(df, key: str, masked: str, parts: str):
    """key, place, part: a masked text cut into pieces as long as the given parts. Every row is cut where it is: its text is neither
    copied for each part nor shuffled."""
    given = df.select(key, masked, F.transform(parts, F.length).alias("sizes"))
    schema = T.StructType([given.schema[key], T.StructField("place", T.IntegerType()), T.StructField("part", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, sizes = batch.column(masked)[i].as_py(), np.asarray(batch.column("sizes")[i].values if batch.column("sizes")[i].is_valid else [], dtype=float)
                known = np.isfinite(sizes)
                ends = np.cumsum(np.where(known, sizes, 0)).astype(np.int64)
                for first in range(0, len(sizes), PARTS):
                    rows = range(first, min(first + PARTS, len(sizes)))
                    pieces = [None if text is None or not known[k] else text[ends[k] - int(sizes[k]) : ends[k]] for k in rows]
                    own = batch.column(key).take(pa.array([i] * len(rows)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(rows, pa.int32()), pa.array(pieces, pa.string())], names=[key, "place", "part"])

    return given.mapInArrow(cut, schema)


def union_box(boxes):
    """The smallest box (x0, y0, x1, y1) around boxes; null boxes are left out."""
    there = F.filter(boxes, lambda b: b.isNotNull())
    side = lambda i, pick: pick(F.transform(there, lambda b: b[i]))
    return F.when(F.size(there) > 0, F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max)))


def box_around(box):
    """union_box() as an aggregate over the boxes of a group."""
    side = lambda i, pick: pick(box[i])
    return F.when(F.count(box) > 0, F.array(side(0, F.min), side(1, F.min), side(2, F.max), side(3, F.max)))


def paired_paths(names, relative):
    """array<struct<name, path>> by position; the names stand for the paths if their numbers differ."""
    own = F.when(F.size(names) == F.size(relative), relative).otherwise(names)
    return F.zip_with(names, own, lambda n, p: F.struct(n.alias("name"), p.alias("path")))
