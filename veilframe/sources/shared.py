"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Only a local session, where all is one machine, may leave the folder unset; it gets one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found and context._jsc.sc().getCheckpointDir().isDefined():
        found = context._jsc.sc().getCheckpointDir().get()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veilframe-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and outlives lost executors, and Spark knows its size. remove() takes
    it back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
