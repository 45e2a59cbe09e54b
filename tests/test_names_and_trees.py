"""Unique names and renamed trees against the plain loops over lists."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.ordering import running
from veilframe.functions.paths import components, unique_names, with_unique_names
from veilframe.functions.rules import DEFAULT_RULES
from veilframe.operators.sanitize import _renamed
from veilframe.operators.tree import name_hits, with_renamed_paths

POOL = ["a.txt", "a_1.txt", "a_2.txt", "a_1_1.txt", "a_1_2.txt", "a_3.txt", "a_01.txt", "b", "b_1", "b_2", ".x", ".x_1", "_1.txt", ".txt", "a_1_1_1.txt", "a.tar.gz", "a.tar_1.gz", "a_99999999999999999999.txt"]


def by_lists(rows):
    want = {}
    for folder in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == folder]
        want |= dict(zip([r[0] for r in own], unique_names([r[2] for r in own])))
    return want


@pytest.mark.parametrize("seed", range(6))
def test_unique_names(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["f", None, "g"]), rng.choice(POOL[: rng.randrange(2, len(POOL) + 1)])) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, folder string, name string").repartition(3)
    assert {r["i"]: r["unique_name"] for r in with_unique_names(df, "folder", "name", "i").collect()} == by_lists(rows)


def test_many_blocked_numbers_in_a_fixed_number_of_jobs(spark):
    def jobs_of(n):
        rows = [(i, "f", f"a_{i + 1}.txt") for i in range(n)] + [(n + i, "f", "a.txt") for i in range(30)] + [(2 * n + i, "f", f"a_{n + 10 + 2 * i}.txt") for i in range(10)]
        spark.sparkContext.setJobGroup(f"names {n}", "")
        got = {r["i"]: r["unique_name"] for r in with_unique_names(spark.createDataFrame(rows, "i int, folder string, name string"), "folder", "name", "i").collect()}
        spark.sparkContext.setJobGroup("", "")
        assert got == by_lists(rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"names {n}"))

    few, many = jobs_of(30), jobs_of(10_000)
    assert many <= few + 6


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", None, "b"]), rng.randrange(40), i, rng.choice([0, 1, 5, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, i int, n int").repartition(5).withColumn("n", F.coalesce("n", F.lit(0)))
    for amount in ("n", None):
        got = {r["i"]: r["before"] for r in running(df, ["g"], ["o", "i"], amount).collect()}
        for g, o, i, _ in rows:
            assert got[i] == sum((r[3] or 0) if amount else 1 for r in rows if r[0] == g and (r[1], r[2]) < (o, i))
    assert running(df.limit(0), ["g"], ["o"]).count() == 0


def made_paths(seed):
    rng = random.Random(seed)
    names = ["2023", "csv", "a.txt", "csvx.txt", "andy", "XXX", "XXX_1", "b.tar.gz", "é", "x?", "t1", "t2", "..", " ", "2023.log", "XXXX_1.log"]
    return [rng.choice(["/", "\\"]).join(rng.choice(names) for _ in range(rng.randrange(1, 6))) for _ in range(160)]


@pytest.mark.parametrize("seed", range(3))
def test_trees(spark, seed):
    paths = made_paths(seed)
    whole = sorted({"/".join(components(p)) for p in paths + [""]})
    hits = []
    new = dict(zip(whole, _renamed(whole, DEFAULT_RULES, "", hits)))
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate([*paths, *paths[:9], None, "", "/", "."])], "i int, p string, node int")
    got = with_renamed_paths(df, "p", DEFAULT_RULES).collect()
    assert len(got) == len(paths) + 13
    assert all(r["new_path"] == new["/".join(components(r["p"]))] for r in got)
    assert len(set(new.values())) == len(new)
    told = sorted((r["file"], r["match_type"], r["n"]) for r in name_hits(df, "p", DEFAULT_RULES).collect())
    assert told == sorted((h[0][1:], h[1], h[2]) for h in hits)


def test_a_hot_folder(spark):
    df = spark.range(3000).select(F.concat(F.lit("top/andy/"), (F.col("id") % 7).cast("string"), F.lit("/csv"), F.col("id").cast("string")).alias("p"))
    got = {r["p"]: r["new_path"] for r in with_renamed_paths(df, "p", DEFAULT_RULES).collect()}
    whole = sorted(got)
    assert got == dict(zip(whole, _renamed(whole, DEFAULT_RULES, "", [])))
