"""The job history as tables: latest jobs, search, figures, upserts, retention and the fix-up after a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import file_names

JOBS = T.StructType([
    T.StructField("job_id", T.StringType(), False), T.StructField("status", T.StringType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()), T.StructField("completed_at", T.TimestampType()), T.StructField("filenames", T.StringType()),
    T.StructField("source_ip", T.StringType()), T.StructField("token", T.StringType()), T.StructField("total_replacements", T.LongType()),
    T.StructField("duration", T.DoubleType()), T.StructField("output_path", T.StringType()), T.StructField("report_path", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("created_by", T.StringType()),
])
USERS = T.StructType([T.StructField(c, T.StringType()) for c in ("username", "role")] + [T.StructField("enabled", T.IntegerType())] + [T.StructField(c, T.TimestampType()) for c in ("created_at", "updated_at", "last_login")])
#: Fields that an update may set.
UPDATABLE = ["status", "completed_at", "filenames", "total_replacements", "duration", "output_path", "report_path", "error", "source_ip", "token", "created_by"]
ROLES = ["analyst", "admin"]
UNFINISHED = ["Queued", "Processing"]
#: Values of columns that a new row doesn't name; all others are null.
DEFAULTS = {"filenames": "[]", "total_replacements": 0, "duration": 0.0, "created_by": ""}


def latest_limit(limit: int | str | None) -> int:
    """1 to 500; 100 if it is missing, zero or no number."""
    try:
        return max(1, min(int(limit or 100), 500))
    except ValueError:
        return 100


def latest(jobs: DataFrame, limit: int | str | None = 100, at: str = "created_at", key: str = "job_id") -> DataFrame:
    """The latest jobs, as many as latest_limit() says."""
    return jobs.orderBy(F.col(at).desc(), key).limit(latest_limit(limit))


def job(jobs: DataFrame, key: str, value: object) -> DataFrame:
    return jobs.filter(F.col(key) == F.lit(value))


def search(jobs: DataFrame, words: str) -> DataFrame:
    """Jobs with the words anywhere in any column, without regard to case."""
    line = F.lower(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in jobs.columns)))
    return jobs.filter(F.contains(line, F.lit(words.lower())))


def figures(jobs: DataFrame, status: str = "status", amount: str = "total_replacements") -> DataFrame:
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col(status) == "Done").alias("done"), F.count_if(F.col(status) == "Failed").alias("failed"), F.coalesce(F.sum(amount), F.lit(0)).alias("replacements"))


def after_restart(jobs: DataFrame, now, status: str = "status", unfinished: list[str] | None = None) -> DataFrame:
    """Unfinished jobs have failed; an error that is told already stays."""
    stopped = F.col(status).isin(*(unfinished or UNFINISHED))
    changes = {status: F.when(stopped, "Failed").otherwise(F.col(status))}
    for column, value in (("updated_at", now), ("error", F.coalesce("error", F.lit("Interrupted by application restart")) if "error" in jobs.columns else None), ("completed_at", now)):
        if column in jobs.columns:
            changes[column] = F.when(stopped, value).otherwise(F.col(column))
    return jobs.withColumns(changes)


def upsert(jobs: DataFrame, changes: DataFrame, key: str = "job_id", order: str | None = None, defaults: dict[str, object] = DEFAULTS) -> DataFrame:
    """Rows of changes in place of those with the same key. Columns that changes lack get their default, or null. Of changes with one key
    the last counts, by the column `order` or else by their place in changes."""
    ordered = changes.withColumn("__order", F.col(order) if order else F.monotonically_increasing_id())
    changes = ordered.groupBy(key).agg(F.max_by(F.struct(*changes.columns), "__order").alias("c")).select("c.*")
    for field in jobs.schema.fields:
        if field.name not in changes.columns:
            changes = changes.withColumn(field.name, F.lit(defaults.get(field.name)).cast(field.dataType))
    return jobs.join(changes.select(key), key, "left_anti").select(*jobs.columns).unionByName(changes.select(*jobs.columns))


def update(jobs: DataFrame, key, now, fields: dict[str, object]) -> DataFrame:
    """Sets the fields that may be set on the rows where key holds."""
    own = {k: v for k, v in fields.items() if k in UPDATABLE} | {"updated_at": now}
    return jobs.withColumns({k: F.when(key, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v)).otherwise(F.col(k)) for k, v in own.items() if k in jobs.columns})


def retained(jobs: DataFrame, now, days: int = 90, at: str = "created_at") -> DataFrame:
    return jobs.filter(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def expired_files(files: DataFrame, now, days: int = 1) -> DataFrame:
    return files.filter(F.col("modificationTime") < now - F.make_dt_interval(F.lit(days)))


def public(jobs: DataFrame, links: bool = True, more: list = ()) -> DataFrame:
    """What a history shows of jobs: no tokens or paths, but whether there is something to load, and where."""
    there = {"download": F.coalesce(F.col("output_path") != "", F.lit(False)), "report": F.coalesce(F.col("report_path") != "", F.lit(False))}
    columns = ["job_id", "status", "created_at", "completed_at", F.coalesce("created_by", F.lit("")).alias("created_by"), file_names(F.col("filenames")).alias("filenames"), F.coalesce("total_replacements", F.lit(0)).cast("long").alias("total_replacements"), F.coalesce("duration", F.lit(0.0)).alias("duration"), "error", there["download"].alias("download_available"), there["report"].alias("report_available")]
    if links:
        given = F.coalesce(F.col("token"), F.lit("")) != ""
        columns += [F.when(given & there["download"], F.concat(F.lit("/download/"), "job_id", F.lit("?token="), "token")).alias("download"), F.when(given & there["report"], F.concat(F.lit("/download/report/"), "job_id", F.lit("?token="), "token")).alias("report_download")]
    return jobs.select(*columns, *more)


def may_download(jobs: DataFrame, job_id: str, token: str) -> DataFrame:
    return jobs.filter((F.col("job_id") == job_id) & (F.col("token") == token) & (F.col("status") == "Done"))


def status(jobs: DataFrame) -> DataFrame:
    """What a status page tells of jobs that are no longer in memory: finished ones are at 100 percent."""
    kind = F.when(F.regexp_extract(F.coalesce("output_path", F.lit("")), r"([^/\\]*)$", 1).startswith("Sanitized_Package_"), "package").otherwise("file")
    done = F.when(F.col("status").isin("Done", "Failed"), 100)
    return public(jobs, more=[done.alias("progress"), kind.alias("output_type")]).drop("created_at", "completed_at", "filenames", "download_available", "report_available")


def with_user(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with rows added or replaced: enabled unless it is told otherwise. A role that is none fails the query."""
    known = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("no such role: "), F.coalesce("role", F.lit("null")))).cast("string"))
    return upsert(table, changes.withColumn("role", known), "username", defaults={"enabled": 1})


def with_columns_of(table: DataFrame, schema: T.StructType, defaults: dict[str, object] = DEFAULTS) -> DataFrame:
    """An older table in the present schema: columns that it lacks have their default, or null."""
    return table.select(*(F.col(f.name) if f.name in table.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))


def users(table: DataFrame) -> DataFrame:
    return table.orderBy("username")


def has_admin(table: DataFrame) -> bool:
    return not table.filter("role = 'admin' and enabled = 1").limit(1).isEmpty()


def admins(table: DataFrame) -> DataFrame:
    return table.filter("role = 'admin' and enabled = 1").agg(F.count("*").alias("admins"))


def log_tail(log: DataFrame, count: int = 200) -> DataFrame:
    """The last lines of a log (20 to 500) in their order, from rows (line_no, value)."""
    return log.orderBy(F.col("line_no").desc()).limit(max(20, min(count, 500))).orderBy("line_no")


def job_log(jobs: DataFrame) -> DataFrame:
    """A JSON line for each job."""
    return jobs.select(F.to_json(F.struct(*jobs.columns)).alias("value"))


def distinct_uploads(files: DataFrame) -> DataFrame:
    """The same file chosen twice counts once."""
    return files.dropDuplicates(["name", "size", "path"])


def read_job_log(lines: DataFrame, schema) -> DataFrame:
    """Jobs from JSON lines; a line that is missing or broken is a row of nulls."""
    return lines.select(F.from_json("value", schema).alias("j")).select("j.*")


def export(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)


def within_limits(files: DataFrame, size: str, most_files: int = 10_000, most_megabytes: int = 4096) -> DataFrame:
    """Number and bytes of files, and whether they keep the limits of an archive."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")).withColumn("within", (F.col("files") <= most_files) & (F.col("bytes") <= most_megabytes * 1024 * 1024))
