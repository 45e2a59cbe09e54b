"""Boxes of matches against a loop over characters."""

import random

from pyspark.sql import functions as F

from veilframe.operators.boxes import binned, fixed_cells, fixed_rows, range_boxes


def plain(ranges, characters):
    out = {}
    for key, start, end, kind in ranges:
        for k, pos, line, box in characters:
            if k == key and start <= pos < end and box is not None:
                old = out.get((key, start, end, kind, line), box)
                out[key, start, end, kind, line] = [min(old[0], box[0]), min(old[1], box[1]), max(old[2], box[2]), max(old[3], box[3])]
    return out


def boxes(df):
    return {(r["k"], r["start"], r["end"], r["kind"], r["line"]): list(r["box"]) for r in df.collect()}


def test_any_layout(spark):
    rng = random.Random(1)
    characters = [(k, pos, pos // rng.randrange(20, 40), None if rng.random() < 0.1 else [rng.random(), rng.random(), 1 + rng.random(), 1 + rng.random()]) for k in range(4) for pos in range(300)]
    ranges = [(rng.randrange(5), a := rng.randrange(310), a + rng.choice([0, 1, 5, 64, 200]), rng.choice("xy")) for _ in range(80)]
    cells = binned(spark.createDataFrame(characters, "k int, pos int, line int, box array<double>").repartition(3), "k")
    found = range_boxes(spark.createDataFrame(ranges + ranges[:5], "k int, start int, end int, kind string"), cells, "k")
    assert boxes(found) == plain(ranges, characters)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fixed_cells(spark):
    texts = ["one\ntwo\n\nthree " * 30, "", None, "\n\n", "é𝄞x", "line " * 100, "\nlast"]
    characters = []
    for k, text in enumerate(texts):
        line = column = 0
        for pos, c in enumerate(text or ""):
            if c == "\n":
                line, column = line + 1, 0
            else:
                characters.append((k, pos, line, [column * 2.0, line * 3.0, column * 2.0 + 2.0, line * 3.0 + 3.0]))
                column += 1
    rows = fixed_rows(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t")
    got = sorted((r["k"], c["pos"], c["line"], list(c["box"])) for r in rows.select("k", F.explode(fixed_cells(2.0, 3.0)).alias("c")).collect() for c in [r["c"]])
    assert got == sorted(characters)
    ranges = [(k, a, a + n, "x") for k in range(7) for a in (0, 2, 60, 127) for n in (1, 3, 70)]
    assert boxes(range_boxes(spark.createDataFrame(ranges, "k int, start int, end int, kind string"), rows, "k", fixed_cells(2.0, 3.0))) == plain(ranges, characters)
