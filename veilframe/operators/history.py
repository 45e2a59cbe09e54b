"""The job history as a table with its access paths.

Two indexes become the table's layout: it is partitioned by the day of creation, so that the latest jobs are in its last
partitions and expired ones in its first, and bucketed and sorted by job, so that one job is in one bucket and joins by job need no
exchange. Days are as many as the retention has; they and their row counts (of Parquet footers) are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, written
from ..sources.text_ranges import opened
from . import jobs

BUCKETS = 16
DAY = "created_day"
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _dealt(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """A task for each bucket, so that a day has one file for each."""
    return rows.repartition(buckets, key).sortWithinPartitions(DAY, key)


def create(history: DataFrame, name: str, key: str = "job_id", at: str = "created_at", buckets: int = BUCKETS) -> DataFrame:
    """Writes a history as the table `name` of the warehouse. Rows without a time of creation are in a partition of their own."""
    rows = history.withColumn(DAY, F.to_date(at))
    _dealt(rows, key, buckets).write.partitionBy(DAY).bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(name)
    return history.sparkSession.table(name)


def latest(history: DataFrame, limit: int | str | None = 100, at: str = "created_at", key: str = "job_id") -> DataFrame:
    """jobs.latest() from the last days that have enough rows; the others are not read."""
    days = history.filter(F.col(DAY).isNotNull()).groupBy(DAY).count().orderBy(F.col(DAY).desc()).collect()
    wanted, seen, first = jobs.latest_limit(limit), 0, None
    for row in days:
        seen, first = seen + row["count"], row[DAY]
        if seen >= wanted:
            return jobs.latest(history.filter(F.col(DAY) >= F.lit(first)), limit, at, key)
    return jobs.latest(history, limit, at, key)


def purge(spark: SparkSession, name: str, now: Column, days: int = 90, active: DataFrame | None = None, key: str = "job_id", at: str = "created_at", buckets: int = BUCKETS) -> list[str]:
    """Removes jobs that were created over `days` days ago, but for those whose key is in `active`. Whole days go as partitions; of the
    days up to the cutoff only those that keep rows are written again, each as a whole. Returns the days that were touched."""
    table = spark.table(name)
    cutoff = now - F.make_dt_interval(F.lit(days))
    old = table.filter(F.col(DAY) <= F.to_date(cutoff))
    keeps = F.col(at) >= cutoff
    stays = old.filter(keeps)
    if active is not None:
        stays = stays.unionByName(old.filter(~keeps).join(active.select(key).distinct(), key, "left_semi").select(old.columns))
    touched = sorted(str(r[DAY]) for r in old.select(DAY).distinct().collect())
    kept = written(_dealt(stays.select(*[c for c in table.columns if c != DAY], DAY), key, buckets))  # the table can't be written while it is read
    again = {str(r[DAY]) for r in kept.select(DAY).distinct().collect()}
    if again:
        before = spark.conf.get(OVERWRITE)
        spark.conf.set(OVERWRITE, "dynamic")  # only partitions that get rows are replaced
        try:
            _dealt(kept, key, buckets).write.mode("overwrite").insertInto(name)
        finally:
            spark.conf.set(OVERWRITE, before)
    for day in touched:
        if day not in again:
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({DAY} = DATE'{day}')")
    remove(kept)
    spark.catalog.refreshTable(name)
    return touched


def purge_files(spark: SparkSession, folder: str, now: Column, days: int = 1) -> int:
    """Removes the files below a folder that have not changed for `days` days; the number of them. Tasks remove what they are dealt; a
    file that is gone already counts, so a task can run twice."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, own = opened(path)
                if system.get_file_info(own).is_file:
                    system.delete_file(own)
            yield batch.select(["path"])

    return jobs.expired_files(files, now, days).select("path").mapInArrow(take, "path string").count()
