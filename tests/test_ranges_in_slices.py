"""Ranges of matches: a worker holds those of a slice of text, not those of a whole batch."""

import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from veilframe.functions import masking

RULES = [r"token", r"\bthe\s+\w+"]
TEXTS = ["é the cat token", None, "", "ünö " * 9, "Token" * 5, "plain", "the\ndog " * 7, None]


def runner():
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    return masking.with_ranges(SimpleNamespace(schema=schema, mapInArrow=lambda run, schema: run), "text", RULES)


@pytest.mark.parametrize("size,matches", [(1, 1), (20, 5), (1 << 20, 2), (1 << 20, 100_000)])
def test_slices_change_nothing(monkeypatch, size, matches):
    monkeypatch.setattr(masking, "SLICE_BYTES", size, raising=False)
    monkeypatch.setattr(masking, "SLICE_MATCHES", matches, raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], names=["id", "text"])
    rows = [r for out in runner()(iter([batch.slice(1, 0), batch.slice(2), batch])) for r in out.to_pylist()]
    want = []
    for k in [*range(2, len(TEXTS)), *range(len(TEXTS))]:
        text, found = (None, None) if TEXTS[k] is None else masking.mask_ranges(TEXTS[k], RULES)
        want.append({"id": k, "text": TEXTS[k], "masked": text, "ranges": None if found is None else [dict(zip(("start", "end", "kind"), x)) for x in found]})
    assert rows == want


def test_memory_is_that_of_a_slice():
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(["é" * 2_000] * 300)], names=["id", "text"])
    run = runner()
    tracemalloc.start()
    n = sum(len(out.column("ranges").flatten()) for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_000 and peak < 30_000_000
