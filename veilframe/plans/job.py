"""One masking job from a folder of files to its outputs, and its command line."""

from __future__ import annotations

import argparse
import os
import sys
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import download_name, is_single_file, with_unique_names
from ..functions.rules import DEFAULT_RULES, active_rules, read_rules
from ..operators.audit import audit, report
from ..operators.sanitize import checked, hit_rows, sanitized
from ..sources.file_sink import write_files
from ..sources.files import report_workbook, scan
from ..sources.shared import remove, written


def unique_paths(done: DataFrame) -> DataFrame:
    """Outputs that would have the same path get _1, _2, ... in the order of their original paths. Contents move only if there are any."""
    if done.groupBy("safe_path").count().filter("count > 1").limit(1).isEmpty():
        return done
    folder = F.regexp_extract("safe_path", "^(.*/)?", 0)
    split = done.select("path", folder.alias("folder"), F.expr("substr(safe_path, length(regexp_extract(safe_path, '^(.*/)?', 0)) + 1)").alias("name"))
    named = with_unique_names(split, "folder", "name", "path").select("path", F.concat("folder", "unique_name").alias("__unique"))
    return done.join(named, "path").withColumn("safe_path", F.col("__unique")).drop("__unique")


def masked_files(files: DataFrame, rules: list[str]) -> tuple[DataFrame, dict]:
    """sanitized() in the shared folder, and what is told of it in the same pass: files, total, failed, and problem and path of the first
    by path that failed (any path if none did)."""
    seen = Observation()
    failed = F.col("error").isNotNull()
    problem = F.min_by(F.when(failed, F.concat("path", F.lit(": "), "error")), F.when(failed, F.col("path")))
    done = written(sanitized(files, rules).observe(seen, F.count("*").alias("files"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count_if(failed).alias("failed"), problem.alias("problem"), F.min("path").alias("path")))
    return done, seen.get


def run_job(spark: SparkSession, source: str, output: str, rules: list[str] | None = None) -> dict:
    """Masks a file or folder. One file by itself goes to <output>/<name>_SANITIZED.<suffix>, several into one archive; a report
    lies beside them. Any file that can't be masked fails the job, and nothing is written. Every file is masked once, into the shared
    folder, in a pass that counts as well; outputs come whole or not at all (sources/file_sink.py)."""
    rules = list(DEFAULT_RULES if rules is None else rules)
    job_id, begun = uuid.uuid4().hex, time.time()
    folder = source if os.path.isdir(source) else os.path.dirname(os.path.abspath(source))
    files = scan(spark, folder)
    if folder != source:
        files = files.filter(F.col("path") == os.path.basename(source))
    masked, told = masked_files(files, rules)
    try:
        if told["failed"]:
            return {"job_id": job_id, "status": "Failed", "error": told["problem"], "total_replacements": 0}
        done = unique_paths(masked)
        totals = done.select(F.col("safe_path").alias("file"), F.col("total").alias("replacements"))
        report_name = f"Sanitization_Report_{job_id}.xlsx"
        book = report_workbook(job_id, totals, report(audit(hit_rows(done)), rules), datetime.now().strftime("%Y-%m-%d %H:%M:%S"), time.time() - begun)
        report_row = spark.createDataFrame([(report_name, bytearray(book))], "path string, content binary")
        os.makedirs(output, exist_ok=True)
        if told["files"] == 1 and is_single_file([told["path"]]):
            out = download_name(os.path.basename(done.select("safe_path").first()[0]))
            write_files(checked(done).select(F.lit(out).alias("path"), "content"), output)
        else:
            out = f"Sanitized_{job_id}.zip"
            rows = checked(done).select(F.concat(F.lit("Sanitized_Files/"), "safe_path").alias("path"), "content")
            write_files(rows.unionByName(report_row), output, package=out)
        write_files(report_row, output)
    finally:
        remove(masked)
    return {"job_id": job_id, "status": "Done", "error": None, "total_replacements": told["total"], "output_path": os.path.join(output, out), "report_path": os.path.join(output, report_name), "duration": time.time() - begun}


def main(arguments: list[str] | None = None) -> int:
    options = argparse.ArgumentParser(description="Mask sensitive content of a file or folder.")
    options.add_argument("source")
    options.add_argument("output")
    options.add_argument("--rules", nargs="*", help="rules as they are, without comments")
    options.add_argument("--rules-file")
    given = options.parse_args(arguments)
    if not os.path.exists(given.source):
        print(f"not found: {given.source}", file=sys.stderr)
        return 1
    rules = active_rules(read_rules(given.rules_file)) if given.rules_file else given.rules
    spark = SparkSession.builder.appName("veilframe").getOrCreate()
    result = run_job(spark, given.source, given.output, rules)
    print(result)
    return 0 if result["status"] == "Done" else 2


if __name__ == "__main__":
    sys.exit(main())
