"""Renaming of whole folder trees: every file and folder gets a masked name, unique in its folder.

Nodes of the tree are rows: each different path and each of its folders once, with its name, its folder and whether it is a file. Names are masked
where they are, made unique in their folder (files before folders, by path), and the paths rebuilt by joining each path's
nodes and putting the names in order again. No step walks the tree, so the number of jobs doesn't depend on its depth; a folder
above very many paths is broadcast, one of fewer than a thousand such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.masking import hits_by_kind, masked
from ..functions.ordering import joined_by_size
from ..functions.paths import components_column, safe_name_column, tail_column, with_unique_names
from ..functions.rules import FILENAME_FORMAT
from ..sources.shared import written


def steps(paths: DataFrame, path: str) -> DataFrame:
    """__path (as given; null is empty), place, size, node (the path down to this place), folder, name: a row for each component of each different path."""
    given = F.coalesce(F.col(path), F.lit(""))
    parts = paths.select(given.alias("__path")).distinct().withColumn("parts", components_column(F.col("__path"))).withColumn("size", F.size("parts"))
    each = parts.select("__path", "parts", "size", F.explode(F.sequence(F.lit(1), "size")).alias("place"))
    down = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    return each.select("__path", "place", "size", down(F.col("place")).alias("node"), down(F.col("place") - 1).alias("folder"), F.element_at("parts", F.col("place")).alias("name"))


def named_nodes(each: DataFrame, rules: list[str]) -> DataFrame:
    """node, folder, name, is_file, paths (below or at it), new_name, hits (map<kind, count>) of every node of steps()."""
    nodes = each.groupBy("node", "folder", "name").agg(F.max(F.col("place") == F.col("size")).alias("is_file"), F.count("*").alias("paths"))
    safe = nodes.withColumn("__safe", safe_name_column(F.col("name")))
    tail = F.when(F.col("is_file"), tail_column(F.col("__safe.name"))).otherwise("")
    cut = safe.withColumn("__tail", tail).withColumn("__stem", F.expr("left(__safe.name, length(__safe.name) - length(__tail))"))
    done = masked(cut, "__stem", rules) if rules else cut.withColumns({"masked": F.col("__stem"), "hits": F.array(F.lit(0).cast("long"))})
    bad = F.map_filter(F.create_map(F.lit(FILENAME_FORMAT), F.col("__safe.n")), lambda _, n: n > 0)
    rows = done.select("node", "folder", "name", "is_file", "paths", F.concat("masked", "__tail").alias("__masked"), F.map_concat(bad, hits_by_kind(F.col("hits"), rules)).alias("hits"))
    turn = F.concat(F.when(F.col("is_file"), "0").otherwise("1"), "node")
    return with_unique_names(rows.withColumn("__turn", turn), "folder", "__masked", "__turn").withColumnRenamed("unique_name", "new_name").drop("__turn", "__masked")


def with_renamed_paths(df: DataFrame, path: str, rules: list[str]) -> DataFrame:
    """Adds new_path. Equal paths are one file; a path that is a file and a folder as well has one name. Null is the path "file", as
    every path without names is."""
    each = written(steps(df, path))
    nodes = written(named_nodes(each, rules).select("node", "paths", "new_name"))
    rows = joined_by_size(each.select("__path", "place", "node"), nodes, "node", "paths", each.count())
    ordered = F.array_sort(F.collect_list(F.struct("place", "new_name")))  # as many as a path has components
    whole = rows.groupBy("__path").agg(F.array_join(F.transform(ordered, lambda x: x["new_name"]), "/").alias("new_path"), F.count("*").alias("__parts"))
    copies = df.select(F.coalesce(F.col(path), F.lit("")).alias("__path")).groupBy("__path").agg(F.count("*").alias("__copies"))
    facts = written(whole.join(copies, "__path").select("__path", "new_path", "__copies"))
    keyed = df.withColumn("__path", F.coalesce(F.col(path), F.lit("")))
    return joined_by_size(keyed, facts, "__path", "__copies", df.count()).select(*df.columns, "new_path")


def name_hits(df: DataFrame, path: str, rules: list[str]) -> DataFrame:
    """file, match_type ("Filename: kind" or "Directory: kind"), n: what was masked in names, each node counted once."""
    nodes = named_nodes(steps(df, path), rules)
    where = F.when(F.col("is_file"), "Filename").otherwise("Directory")
    return nodes.select(F.col("node").alias("file"), where.alias("where"), F.explode("hits").alias("kind", "n")).select("file", F.concat("where", F.lit(": "), "kind").alias("match_type"), "n")
