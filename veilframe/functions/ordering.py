"""Running sums in groups of any size: no group has to meet in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(df: DataFrame, group: list[str], order: list[str], amount: str | None = None, name: str = "before") -> DataFrame:
    """Adds `name`, the sum of `amount` (a column; 1 if none is given) over the rows before in the group, and __id, a number for each row. A range
    sort deals rows out by group and order; sums inside of a partition's part of a group follow what lies in the partitions before it.
    Rows that tie in everything come in any order; groups may be null. The table is written to the shared folder."""
    by = [*group, *order]
    salted = df.withColumn("__salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(*by, "__salt").sortWithinPartitions(*by, "__salt").drop("__salt")
    rows = written(ranged.withColumn("__id", F.monotonically_increasing_id()))
    value = F.lit(1) if amount is None else F.col(amount)
    part = F.shiftright("__id", 33).alias("__part")
    whole = rows.select("*", part, value.cast("long").alias("__amount"))
    # A row for each group in each partition.
    parts = whole.groupBy(*group, "__part").agg(F.sum("__amount").alias("__here"))
    above = F.sum("__here").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(group)), F.col("__part").alias("__of"), F.coalesce(above, F.lit(0)).alias("__above"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(group)), F.col("__part") == F.col("__of"))
    inside = F.sum("__amount").over(Window.partitionBy(*group, "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1))
    out = whole.withColumn("__inside", F.coalesce(inside, F.lit(0))).join(parts, same)
    out = out.withColumn(name, F.col("__above") + F.col("__inside")).select(*df.columns, "__id", name)
    out.written_at = rows.written_at
    return out


def joined_by_size(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, most: int = 1000) -> DataFrame:
    """rows joined with facts, which have one row for each key and tell in `size` how many of the `total` rows have it. Keys with more than one in
    `most` rows, and more than `most` of them, are hot: there are fewer than `most` of those, so their facts are broadcast and their rows stay where they are."""
    limit = max(most, total // most)
    hot = F.col(size) > limit
    others = rows.join(F.broadcast(facts.filter(hot).select(key)), key, "left_anti")
    return rows.join(F.broadcast(facts.filter(hot)), key).unionByName(others.join(facts.filter(~hot), key))
