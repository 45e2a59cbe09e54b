"""The history table: what is read, what is exchanged and what a purge touches."""

import datetime
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from veilframe.operators import history, jobs

NOW = datetime.datetime(2024, 4, 30, 12)


@pytest.fixture
def table(spark):
    rows = [(f"j{i}", ["Done", "Processing", "Failed"][i % 3], NOW - datetime.timedelta(hours=7 * i), i) for i in range(600)] + [("none", "Queued", None, -1)]
    df = spark.createDataFrame(rows, "job_id string, status string, created_at timestamp_ntz, n int").repartition(5)
    name = f"history_{uuid.uuid4().hex}"
    history.create(df, name, buckets=8)
    yield name, {r[0]: r for r in rows}
    spark.sql(f"DROP TABLE {name}")


AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # files of other buckets are left out in any case; without it the plan tells


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def one_bucket(spark, name):
    spark.conf.set(AUTO, "false")
    try:
        return "SelectedBucketsCount: 1 out of 8" in plan(jobs.job(spark.table(name), "job_id", "j77"))
    finally:
        spark.conf.unset(AUTO)


def files(spark, name):
    where = re.sub("^file:/*", "/", spark.conf.get("spark.sql.warehouse.dir")) + "/" + name
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(where) for f in names if f.endswith(".parquet")}


def test_one_bucket_for_one_job(spark, table):
    name, rows = table
    assert [r["n"] for r in jobs.job(spark.table(name), "job_id", "j77").collect()] == [77] and one_bucket(spark, name)


def test_joins_by_job_have_no_exchange(spark, table):
    name, _ = table
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = spark.table(name).select("job_id", "n").join(spark.table(name).select("job_id", "status"), "job_id")
        assert "Exchange" not in plan(both) and both.count() == 601
        assert "Exchange" not in plan(spark.table(name).groupBy("job_id").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("limit", [1, 5, 100, 9999, None, "x"])
def test_latest_reads_the_last_days(spark, table, limit):
    name, rows = table
    found = history.latest(spark.table(name), limit)
    told = plan(found)
    want = sorted((r for r in rows.values() if r[2]), key=lambda r: r[2], reverse=True)[: jobs.latest_limit(limit)]
    assert [r["job_id"] for r in found.collect()] == [r[0] for r in want]
    if limit == 5:
        assert re.search(r"PartitionFilters: \[isnotnull\(created_day.*created_day.* >= 2024-04-29", told)
        assert len(found.select(F.input_file_name()).distinct().collect()) <= 16 < len(files(spark, name)) // 10


def test_a_purge_touches_expired_days_only(spark, table):
    name, rows = table
    before = files(spark, name)
    active = spark.table(name).filter("status = 'Processing' and n > 500").select("job_id")
    keep = {r["job_id"] for r in active.collect()}
    touched = history.purge(spark, name, F.lit(NOW), 90, active, buckets=8)
    cutoff = NOW - datetime.timedelta(days=90)
    assert sorted(r["job_id"] for r in spark.table(name).collect()) == sorted(k for k, r in rows.items() if r[2] is None or r[2] >= cutoff or k in keep)
    after = files(spark, name)
    day = lambda f: re.search("created_day=([^/]*)", f)[1]
    assert touched and max(touched) == str(cutoff.date())
    untouched = {f: t for f, t in before.items() if day(f) not in touched}
    assert untouched and untouched == {f: t for f, t in after.items() if day(f) not in touched}
    assert {day(f) for f in after if day(f) in touched} == {str(rows[k][2].date()) for k in keep} | {str(cutoff.date())}
    assert history.purge(spark, name, F.lit(NOW), 90, active, buckets=8) == sorted({day(f) for f in after if day(f) in touched})
    assert jobs.job(spark.table(name), "job_id", "j0").count() == 1 and one_bucket(spark, name)


def test_purge_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for k in range(6):
        path = tmp_path / ("sub" if k % 2 else ".") / f"{k}.bin"
        path.write_bytes(b"x")
        at = (NOW - datetime.timedelta(days=k)).replace(tzinfo=datetime.timezone.utc).timestamp()
        os.utime(path, (at, at))
    now = F.lit("2024-04-30 12:00:01").cast("timestamp")
    assert history.purge_files(spark, str(tmp_path), now, 3) == 3 and history.purge_files(spark, str(tmp_path), now, 3) == 0
    assert sorted(p.name for p in tmp_path.rglob("*.bin")) == ["0.bin", "1.bin", "2.bin"]
