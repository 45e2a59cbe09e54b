"""Masked texts cut into the parts that they came from."""

from pyspark.sql import functions as F

from veilframe.functions import scalars


def test_parts_take_their_places_from_the_masked_text(spark, monkeypatch):
    monkeypatch.setattr(scalars, "PARTS", 3)
    texts = {1: ("XX é𝄞 XXX end", ["ab ", "é𝄞 ", "", "cde ", "end"]), 2: ("", []), 3: (None, ["a"]), 4: ("abc", None), 5: ("abcd", ["x", None, "yz"]), 6: ("ab", ["abc", "d"])}
    rows = spark.createDataFrame([(k, t, p) for k, (t, p) in texts.items()], "k long, masked string, parts array<string>")
    cut = scalars.spread(rows, "k", "masked", "parts")
    want = set()
    for k, (text, parts) in texts.items():
        at = 0
        for place, part in enumerate(parts or []):
            size = len(part or "")
            want.add((k, place, None if text is None or part is None else text[at : at + size]))
            at += size
    assert {tuple(r) for r in cut.select("k", "place", "part").collect()} == want and cut.count() == len(want)


def test_texts_are_not_copied_for_their_parts(spark, tmp_path):
    """A text of 30,000 words went into the shuffle 30,000 times."""
    long = spark.range(1).select("id", F.repeat(F.lit("word "), 30_000).alias("masked"))
    cut = scalars.spread(long.withColumn("parts", F.split("masked", " ")), "id", "masked", "parts")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert cut.count() == 30_001
