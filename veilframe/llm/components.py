"""Connected components of an edge table by alternating large-star and small-star steps.

Edges are contracted inside each partition first. Every step groups with partial aggregation and joins; nothing is gathered
on the driver but a count. Steps are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, staged_path

ROUNDS = 60
HOT = 1000  # a key with more than one in so many rows, and more rows than that, is hot


def joined(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined with facts, which have one row for each key and tell in `size` how many of the `total` rows have it. The facts on hot
    keys, fewer than HOT, are broadcast, so that no key's rows have to meet in one task."""
    limit = max(HOT, total // HOT)
    hot = F.broadcast(facts.filter(F.col(size) > limit))
    others = rows.join(F.broadcast(facts.filter(F.col(size) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(others.join(facts.filter(F.col(size) <= limit), keys))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest id of its component), without the smallest themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:  # hook larger roots to smaller ones, then jump pointers
        x, y = root[left], root[right]
        if (x == y).all():
            break
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            a, b = forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
            if len(a) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return edges.filter("u <> v and u is not null and v is not null").mapInArrow(contract, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """u, v (long) -> id, component: the smallest id reachable, for every id on an edge. Loops and nulls are left out."""
    spark = edges.sparkSession

    def read(path: str) -> DataFrame:
        return spark.read.schema("u long, v long").parquet(path)

    path = staged_path(contracted(edges.select(F.col(edges.columns[0]).cast("long").alias("u"), F.col(edges.columns[1]).cast("long").alias("v"))))
    for _ in range(ROUNDS):
        now = read(path)
        seen = now.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(now.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        ups = seen.groupBy("id").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ups.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty():
            break
        n = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = joined(both, least, ["u"], "degree", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        starred = staged_path(contracted(large))
        drop_path(spark, path)
        large = read(starred)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = joined(large, least, ["u"], "degree", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        path = staged_path(contracted(small))
        drop_path(spark, starred)
    else:
        raise RuntimeError("components did not settle")
    done = read(path)
    return done.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(done.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
