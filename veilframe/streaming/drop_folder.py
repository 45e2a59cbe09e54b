"""A folder that files are dropped into, masked as a stream. Masking keeps no state, so there is no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.rules import read_rules
from ..operators.sanitize import sanitized
from ..sources.files import BINARY_FILES, relative


def mask_dropped(spark: SparkSession, folder: str, output: str, checkpoint: str, rules: list[str] | str, once: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Writes masked files as Parquet rows. Files that can't be masked are rows with an error and no content. Rules are a list, or the path of
    a rule file that is read anew for every batch: each batch then has a folder of its own below the output, which a repeated batch
    replaces."""
    dropped = spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    dropped = dropped.withColumn("path", relative(F.col("path"), folder))

    def mask_batch(files: DataFrame, number: int) -> None:
        sanitized(files, read_rules(rules)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    if isinstance(rules, str):
        writer = dropped.writeStream.foreachBatch(mask_batch)
    else:
        writer = sanitized(dropped, rules).writeStream.format("parquet").option("path", output)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
