"""Files as tables: binary scans with relative paths, and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .office import write_xlsx

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative to the folder), modificationTime, length, content of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("path", relative(F.col("path"), folder))


def relative(path, folder: str):
    clean = F.regexp_replace(F.lit(folder), r"^\w+:/*", "/")
    own = F.regexp_replace(path, r"^\w+:/*", "/")
    return F.regexp_replace(F.substring(own, F.length(clean) + 1, F.length(own)), "^/+", "")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (growing, not dense), value."""
    return spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())


def report_workbook(job_id: str, totals: DataFrame, audit_rows: DataFrame, generated: str, duration: float, status: str = "Done", error: str | None = None) -> bytes:
    """The audit workbook. Its sheets are reports for people, so their rows (files, and kinds in files) come to the driver."""
    files = [[r["file"], r["replacements"], None] for r in totals.orderBy("file").collect()]
    rows = [[r["file"], r["match_type"], r["occurrences"], r["location"], r["keywords"]] for r in audit_rows.collect()]
    summary: list[list[object]] = [["Data Sanitization Report"], ["Job ID", job_id], ["Status", status], ["Generated", generated], ["Total Replacements", sum(f[1] for f in files)], ["Duration (seconds)", round(duration, 3)], *([["Error", error]] if error else []), [], ["File Name", "Replacements", "Duration (seconds)"], *files]
    return write_xlsx([("Summary", summary), ("Audit", [["File Name", "Match Type", "Occurrences", "Location", "Keywords"], *(rows or [["", "No sensitive matches detected", 0, "", ""]])])])
