"""Streams give what the batch gives, over restarts and repeated batches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import jobs
from veilframe.streaming.drop_folder import mask_dropped
from veilframe.streaming.job_states import REQUESTS, TIMEOUT, follow, followed, last_states
from veilframe.streaming.upserts import History

BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def requests(seed, n=300):
    rng = random.Random(seed)
    hours = sorted(rng.uniform(0, 400) for _ in range(n))
    out = []
    for turn, h in enumerate(hours):
        at = BEGIN + datetime.timedelta(hours=round(h, 3))
        out.append((f"j{rng.randrange(12)}", at, int(at.timestamp() * 1_000_000), turn, rng.choice(["Queued", "Processing", "Done", "Failed", "nonsense"])))
    return out


def test_states_over_a_restart(spark, tmp_path):
    rows = requests(1)
    want, ends = [], {}
    for job in {r[0] for r in rows}:
        status, since, changes = followed(job, None, 0, [r[2:] for r in rows if r[0] == job], TIMEOUT)
        end = since + TIMEOUT
        if status in ("Queued", "Processing") and end <= rows[-1][2]:
            changes.append((job, end, -1, "timeout", status, "Failed", True))
            status = "Failed"
        want += changes
        ends[job] = status
    for begin, end in ((0, 100), (100, 101), (101, 300)):
        spark.createDataFrame(rows[begin:end], REQUESTS).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, ((r["job_id"], r["micros"], r["turn"], r["wanted"], r["before"], r["status"], r["accepted"]) for r in got.collect()))) == sorted(map(str, want))
    assert any(c[3] == "timeout" for c in want) and any(not c[6] for c in want)
    assert {r["job_id"]: r["status"] for r in last_states(got).collect()} == ends


def test_a_timer_needs_no_request():
    status, since, changes = followed("j", "Processing", 0, [(TIMEOUT, 1, "Done")], TIMEOUT)
    assert changes == [("j", TIMEOUT, -1, "timeout", "Processing", "Failed", True), ("j", TIMEOUT, 1, "Done", "Failed", "Failed", False)] and (status, since) == ("Failed", TIMEOUT)
    assert followed("j", "Processing", 0, [(TIMEOUT - 1, 1, "Done")], TIMEOUT)[0] == "Done"


SCHEMA = "job_id string, status string, total_replacements long, turn long"


def batches():
    rng = random.Random(2)
    return [[(f"j{rng.randrange(40)}", rng.choice(["Queued", "Done"]), None if b == 1 else rng.randrange(9), 100 * b + i) for i in range(30)] for b in range(4)]


def table_of(df):
    return sorted(map(str, df.select("job_id", "status", "total_replacements", "turn").collect()))


def by_batch(spark, schema, given):
    now = {}
    for batch in given:
        now |= {r[0]: r for r in batch}
    return table_of(spark.createDataFrame(list(now.values()), schema))


def test_batches_count_once(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    history = History(spark, f"{tmp_path}/history", schema, order="turn", buckets=4)
    assert history.table().count() == 0
    given = batches()
    frames = [spark.createDataFrame(b, SCHEMA) for b in given]
    history.upsert(frames[0], 0)
    history.upsert(frames[0], 0)
    history.upsert(frames[1], 1)
    assert table_of(history.table()) == by_batch(spark, schema, given[:2])
    commit = history.commit
    history.commit = lambda manifest: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError, match="killed"):
        history.upsert(frames[2].limit(5), 2)
    assert table_of(history.table()) == by_batch(spark, schema, given[:2])
    history.commit = commit
    history.upsert(frames[2], 2)
    history.upsert(frames[1], 1)  # an old one again
    assert table_of(history.table()) == by_batch(spark, schema, given[:3])
    one = spark.createDataFrame([("j1", "Failed", 1, 999)], SCHEMA)
    history.upsert(one, 3)
    versions = history.manifest()["versions"]
    assert sorted(versions.values()).count(3) == 1 and len(versions) == 4  # the other buckets stay as they are


def test_a_stream_that_is_stopped_between_write_and_commit(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    given = batches()
    history = History(spark, f"{tmp_path}/history", schema, order="turn")

    def feed(batch):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        query = history.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
        query.awaitTermination()

    feed(given[0])
    commit, history.commit = history.commit, lambda manifest: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(Exception, match="killed"):
        feed(given[1])
    history.commit = commit
    feed(given[2])
    assert table_of(history.table()) == by_batch(spark, schema, given[:3])
    assert history.manifest()["batch"] == 2


def test_columns_that_changes_lack_have_defaults(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    history = History(spark, f"{tmp_path}/h", schema, order="turn")
    history.upsert(spark.createDataFrame([("a", "Done", 5, 1)], SCHEMA), 0)
    history.upsert(spark.createDataFrame([("a", "Queued", 2)], "job_id string, status string, turn long"), 1)
    assert [tuple(r) for r in history.table().collect()] == [("a", "Queued", jobs.DEFAULTS["total_replacements"], 2)]
    assert history.table().filter(F.col("status") == "Done").count() == 0


def test_rules_are_read_anew_for_every_batch(spark, tmp_path):
    rules = tmp_path / "rules.txt"

    def drop(name, text):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("andy and bob")
        rules.write_text(text)
        mask_dropped(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), str(rules)).awaitTermination()

    drop("1.txt", "andy")
    drop("2.txt", "bob # andy no more")
    got = {r["path"]: (bytes(r["content"]), r["batch"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"1.txt": (b"XXXX and bob", 0), "2.txt": (b"andy and XXX", 1)}
