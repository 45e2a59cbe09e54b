"""A history that a stream upserts into, batch by batch and each batch once.

The table is cut into buckets by a hash of its key. A batch writes new versions of the buckets that it touches, in a folder named by its
number, and then a manifest that tells for every bucket which version counts. The manifest appears by a rename, as a whole or not at
all: a batch whose manifest is there is passed over, one that was stopped before that is written again over what it left, and
readers see the table before the batch or after it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs

BUCKETS = 16


class History:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str = "job_id", order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.key, self.order, self.buckets = spark, folder.rstrip("/"), schema, key, order, buckets

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @property
    def store(self):
        return self.path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last one: the number of its batch, and the version of each bucket."""
        if not self.store.exists(self.path("manifests")):
            return {"batch": -1, "versions": {}}
        numbers = [int(f.getPath().getName()) for f in self.store.listStatus(self.path("manifests")) if f.getPath().getName().isdigit()]
        if not numbers:
            return {"batch": -1, "versions": {}}
        lines = self.spark.read.text(f"{self.folder}/manifests/{max(numbers)}").collect()  # a line of JSON
        return json.loads(lines[0][0])

    def commit(self, manifest: dict) -> None:
        number = manifest["batch"]
        out = self.store.create(self.path(f"manifests/.{number}"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self.store.rename(self.path(f"manifests/.{number}"), self.path(f"manifests/{number}")):
            raise RuntimeError(f"batch {number} was committed by another writer")

    def _read(self, versions: dict[str, int]) -> DataFrame:
        """The given buckets, of the versions that count."""
        paths = [f"{self.folder}/version={v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        return self._read(self.manifest()["versions"])

    def bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def upsert(self, changes: DataFrame, number: int) -> None:
        """For foreachBatch."""
        before = self.manifest()
        if number <= before["batch"]:
            return
        changes = changes.persist()
        try:
            touched = [str(r["bucket"]) for r in self.bucket(changes).select("bucket").distinct().collect()]
            old = self._read({b: before["versions"][b] for b in touched if b in before["versions"]})
            new = self.bucket(jobs.upsert(old, changes, self.key, self.order))
            new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/version={number}")
        finally:
            changes.unpersist()
        self.commit({"batch": number, "versions": before["versions"] | dict.fromkeys(touched, number)})

    def follow(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Upserts a stream of changes; ends when all that is there is read."""
        return changes.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
