"""Job states as a stream: Queued, Processing, Done or Failed.

Requests (job_id, micros, turn, wanted) come in the order of their times; those of a job that arrive together are ordered by (micros, turn). A
request that the job's state doesn't allow is refused, and told as such. A job that stays Queued or Processing for TIMEOUT without an
accepted change fails at that time: by a timer, or when its next request comes, whichever is first, so that the result
doesn't depend on how requests fall into batches. State is a status and a time for each job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.jobs import UNFINISHED

TIMEOUT = 12 * 3600 * 1_000_000  # microseconds
#: From which states a state can be reached; None is a job that is not known. A finished job can be queued anew.
ALLOWED = {"Queued": (None, "Done", "Failed"), "Processing": ("Queued",), "Done": ("Processing",), "Failed": ("Queued", "Processing")}
REQUESTS = "job_id string, at timestamp, micros long, turn long, wanted string"
CHANGES = "job_id string, micros long, turn long, wanted string, before string, status string, accepted boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Change = tuple[str, int, int, str, str | None, str | None, bool]
BY_ITSELF = -1  # the turn of a timeout: before all requests of its time


def stands_until(status: str | None, since: int, timeout: int) -> int | None:
    """When a job in this state fails by itself."""
    return since + timeout if status in UNFINISHED else None


def followed(job: str, status: str | None, since: int, requests: list[tuple[int, int, str]], timeout: int) -> tuple[str | None, int, list[Change]]:
    """(status, since when, changes) behind a job's requests (micros, turn, wanted)."""
    out: list[Change] = []
    for micros, turn, wanted in sorted(requests):
        end = stands_until(status, since, timeout)
        if end is not None and micros >= end:
            out.append((job, end, BY_ITSELF, "timeout", status, "Failed", True))
            status, since = "Failed", end
        accepted = status in ALLOWED.get(wanted, ())
        out.append((job, micros, turn, wanted, status, wanted if accepted else status, accepted))
        if accepted:
            status, since = wanted, micros
    return status, since, out


class JobStates(StatefulProcessor):
    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, since long")

    def known(self) -> tuple[str | None, int]:
        return self.job.get() if self.job.exists() else (None, 0)

    def keep(self, status: str | None, since: int) -> None:
        if status is not None:
            self.job.update((status, since))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = stands_until(status, since, self.timeout)
        if end is not None:
            self.handle.registerTimer(-(-end // 1000))

    def told(self, changes: list[Change]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame(changes, columns=["job_id", "micros", "turn", "wanted", "before", "status", "accepted"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        requests = [r for frame in rows for r in zip(frame["micros"].tolist(), frame["turn"].tolist(), frame["wanted"].tolist())]
        status, since, changes = followed(key[0], *self.known(), requests, self.timeout)
        self.keep(status, since)
        yield from self.told(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, since = self.known()
        end = stands_until(status, since, self.timeout)
        if end is not None and end <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.job.update(("Failed", end))
            yield from self.told([(key[0], end, BY_ITSELF, "timeout", status, "Failed", True)])

    def close(self) -> None:
        pass


def states(requests: DataFrame, timeout: int = TIMEOUT) -> DataFrame:
    """A stream of REQUESTS -> CHANGES."""
    grouped = requests.withWatermark("at", "0 seconds").groupBy("job_id")
    return grouped.transformWithStateInPandas(statefulProcessor=JobStates(timeout), outputStructType=CHANGES, outputMode="Append", timeMode="eventTime")


def follow(spark: SparkSession, folder: str, output: str, checkpoint: str, timeout: int = TIMEOUT) -> StreamingQuery:
    """Follows Parquet files of REQUESTS that arrive in a folder, and writes CHANGES as Parquet; ends when all that is there is read. Started
    again with the same checkpoint it goes on where it stopped."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        changes = states(spark.readStream.schema(REQUESTS).parquet(folder), timeout)
        return changes.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def last_states(changes: DataFrame) -> DataFrame:
    """job_id, status, accepted, refused, timeouts of every job."""
    own = F.col("turn") != BY_ITSELF
    last = F.max_by("status", F.struct("micros", "turn"))
    return changes.groupBy("job_id").agg(last.alias("status"), F.count_if(own & F.col("accepted")).alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"), F.count_if(~own).alias("timeouts"))
