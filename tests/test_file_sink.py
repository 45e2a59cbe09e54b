"""Outputs come whole or not at all, and a masking job counts in the pass that masks."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.functions.rules import DEFAULT_RULES
from veilframe.operators.audit import job_total
from veilframe.operators.sanitize import hit_rows
from veilframe.plans.job import masked_files, run_job
from veilframe.sources.file_sink import write_files
from veilframe.sources.files import scan


def tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(folder) for f in names}


def rows(spark, n=40):
    return spark.range(n).repartition(7).select(F.concat(F.lit("a/"), (F.col("id") % 3).cast("string"), F.lit("/"), "id", F.lit(".bin")).alias("path"), F.when(F.col("id") != 5, F.repeat(F.col("id").cast("string"), 1000)).cast("binary").alias("content"))


WANT = {f"a/{i % 3}/{i}.bin": str(i).encode() * 1000 if i != 5 else b"" for i in range(40)}


def test_files_and_packages(spark, tmp_path):
    write_files(rows(spark), f"{tmp_path}/files")
    assert tree(tmp_path / "files") == WANT
    write_files(rows(spark), f"file://{tmp_path}/packages", package="all.zip", level=9)
    assert list(tree(tmp_path / "packages")) == ["all.zip"]
    with zipfile.ZipFile(tmp_path / "packages/all.zip") as archive:
        assert archive.testzip() is None and {i: archive.read(i) for i in archive.namelist()} == WANT
    write_files(rows(spark, 0), f"{tmp_path}/packages", package="none.zip")
    assert zipfile.ZipFile(tmp_path / "packages/none.zip").namelist() == []


@pytest.mark.parametrize("package", ["", "all.zip"])
def test_failures_leave_nothing(spark, tmp_path, package):
    bad = rows(spark).withColumn("content", F.when(~F.col("path").endswith("/33.bin"), F.col("content")).otherwise(F.raise_error(F.lit("broken")).cast("binary")))
    twice = rows(spark).unionByName(rows(spark, 2))
    outside = rows(spark).withColumn("path", F.regexp_replace("path", "^a/2/32", "../32"))
    for df, message in ((bad, "broken"), (twice, "one path"), (outside, "unsafe")):
        with pytest.raises(Exception, match=message):
            write_files(df, f"{tmp_path}/out", package)
        assert tree(tmp_path) == {}


def test_totals_come_with_the_pass_that_masks(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"{k}.txt").write_text("10.20.30.40 é andy\n" * (k + 1) + "2023")
    context = spark.sparkContext
    context.setJobGroup("masking", "")
    done, told = masked_files(scan(spark, str(tmp_path)), DEFAULT_RULES)
    context.setJobGroup("", "")
    assert len(context.statusTracker().getJobIdsForGroup("masking")) == 1
    assert told["total"] == job_total(hit_rows(done)).first()[0] == 3 * 78 + 12 and told["files"] == 12 and told["failed"] == 0 and told["path"] == "0.txt"
    (tmp_path / "x.exe").write_bytes(b"x")
    (tmp_path / "c.exe").write_bytes(b"x")
    assert run_job(spark, str(tmp_path), str(tmp_path / "out"))["error"].startswith("c.exe: Unsupported") and not (tmp_path / "out").exists()


def test_a_job_with_equal_names(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for name in ("csv.txt", "XXX.txt", "andy1.log"):
        (source / name).write_text(f"{name} andy")
    result = run_job(spark, str(source), str(tmp_path / "out"), ["csv", "andy"])
    with zipfile.ZipFile(result["output_path"]) as archive:
        assert {n: archive.read(n) for n in archive.namelist() if n.startswith("Sanitized_Files/")} == {"Sanitized_Files/XXX.txt": b"XXX.txt XXXX", "Sanitized_Files/XXX_1.txt": b"XXX.txt XXXX", "Sanitized_Files/XXXX1.log": b"XXXX1.log XXXX"}
        assert os.path.basename(result["report_path"]) in archive.namelist() and os.path.exists(result["report_path"])
    assert result["total_replacements"] == 7
