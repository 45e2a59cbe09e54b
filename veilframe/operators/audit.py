"""The audit of what was masked: by file and kind the number of hits, where the first was, and the rules of that kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import hits_by_kind, masked
from ..functions.rules import FILENAME_FORMAT, NON_ASCII, keyword_table


def unit_hits(units: DataFrame, rules: list[str], native: bool | None = None) -> DataFrame:
    """file, ordinal, location, text -> file, ordinal, location, masked, match_type, n: a row for each kind that a unit hits."""
    done = masked(units, "text", rules, native)
    return done.filter("total > 0").select("file", "ordinal", "location", "masked", F.explode(hits_by_kind(F.col("hits"), rules)).alias("match_type", "n"))


def audit(hits: DataFrame) -> DataFrame:
    """file, match_type, occurrences, location of the first hit. A hit whose masked text is blank leaves the place open for
    a later one, as long as there is one."""
    blank = F.trim(F.regexp_replace("masked", r"\s+", " ")) == "" if "masked" in hits.columns else F.lit(False)
    first = F.min_by("location", F.struct(blank.cast("int"), F.col("ordinal")))
    return hits.filter("n > 0").groupBy("file", "match_type").agg(F.sum("n").alias("occurrences"), first.alias("location"))


def with_keywords(found: DataFrame, rules: list[str]) -> DataFrame:
    """Adds keywords: all rules of the kind, whether they hit or not. A prefix like 'Path: ' is not part of the kind."""
    known = F.broadcast(keyword_table(found.sparkSession, rules))  # as many rows as rules at most
    base = F.regexp_replace("match_type", r"^(?s).*?: ", "")
    special = F.when(F.col("base") == NON_ASCII, NON_ASCII).when(F.col("base") == FILENAME_FORMAT, "Invalid filename character")
    return found.withColumn("base", base).join(known, F.col("base") == F.col("kind"), "left").withColumn("keywords", F.coalesce(special, "keywords", "base")).drop("base", "kind")


def file_totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file").agg(F.sum("n").alias("replacements"))


def job_total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_replacements"))


def report(found: DataFrame, rules: list[str]) -> DataFrame:
    """The report's audit sheet, in its order."""
    return with_keywords(found, rules).select("file", "match_type", "occurrences", "location", "keywords").orderBy("file", "match_type")
