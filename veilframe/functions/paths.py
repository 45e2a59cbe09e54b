"""File names and relative paths: masking, archive suffixes, unique names. Each function has a plain form for file trees that are
being unpacked, and an expression for columns."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .masking import hits_by_kind, mask_text, masked
from .ordering import running
from .rules import FILENAME_FORMAT

# Suffixes of archives, the compound ones in the order in which they are tried.
ARCHIVES = [".zip", ".rar", ".7z", ".tar", ".tgz", ".tar.gz", ".bz2", ".tar.bz2", ".tbz2", ".gz", ".xz", ".tar.xz", ".lz", ".zst"]
COMPOUND = [".tar.gz", ".tar.bz2", ".tar.xz", ".tbz2", ".tgz"]
# Suffixes that are always text, text when it decodes, or never text.
TEXT = [".txt", ".log", ".csv"]
TEXT_LIKE = ".txt .log .csv .tsv .json .jsonl .ndjson .xml .yaml .yml .ini .cfg .conf .config .properties .env .md .rst .html .htm .css .js .ts .py .ps1 .psm1 .psd1 .sh .bash .zsh .bat .cmd .vbs .sql .reg .inf .service .socket .timer .rules .list .hosts".split()
BINARY = ".pdf .doc .docx .ppt .pptx .odt .ods .odp .png .jpg .jpeg .gif .bmp .tif .tiff .webp .exe .dll .sys .bin .dat .evtx .evt .pcap .pcapng .db .sqlite .sqlite3 .mdb .accdb".split()
BAD_CHARACTER = r'[<>:"/\\|?*\x00-\x1F]|[^\x20-\x7E]'

_bad = re.compile(BAD_CHARACTER)


def suffix(name: str) -> str:
    """The last suffix, dot included: none for names that begin or end with their only dot."""
    dot = name.rfind(".")
    return name[dot:] if 0 < dot < len(name) - 1 and name[:dot].strip(".") else ""


def archive_suffix(name: str) -> str:
    low = name.lower()
    return next((x for x in COMPOUND if low.endswith(x)), suffix(low))


def is_archive(name: str) -> bool:
    return archive_suffix(name) in ARCHIVES


def archive_stem(name: str) -> str:
    found = archive_suffix(name)
    return name[: len(name) - len(found)] if found else name


def safe_name(name: str) -> tuple[str, int]:
    """(name without characters that file systems refuse, number of them)."""
    clean, n = _bad.subn("X", name)
    return clean.rstrip(" .") or "file", n


def tail(name: str) -> str:
    """What rules never see of the last name of a path: its suffix, of archives the compound one."""
    return name[len(name) - len(archive_suffix(name)) :] if is_archive(name) else suffix(name)


class Piece(NamedTuple):
    """A safe name of a path, cut in two; bad counts the characters that became X."""

    stem: str
    tail: str
    bad: int


def piece(component: str, keep_suffix: bool) -> Piece:
    name, bad = safe_name(component)
    end = tail(name) if keep_suffix else ""
    return Piece(name[: len(name) - len(end)], end, bad)


def components(path: str | None) -> list[str]:
    return [p for p in (path or "").replace("\\", "/").split("/") if p not in ("", ".", "..")] or ["file"]


def _masked(pieces: list[Piece], rules: list[str]) -> tuple[str, int, dict[str, int]]:
    """(path, total, counts by kind). Masking keeps lengths and writes X, so a stem stays a safe one."""
    stems = [mask_text(p.stem, rules) if rules else (p.stem, 0, {}) for p in pieces]
    kinds = Counter({FILENAME_FORMAT: sum(p.bad for p in pieces)})
    for _, _, found in stems:
        kinds.update(found)
    return "/".join(stem[0] + p.tail for stem, p in zip(stems, pieces)), kinds.total(), dict(+kinds)


def masked_component(name: str, rules: list[str], keep_suffix: bool = True) -> tuple[str, int, dict[str, int]]:
    return _masked([piece(name, keep_suffix)], rules)


def masked_path(path: str | None, rules: list[str]) -> tuple[str, int, dict[str, int]]:
    """The plain form of with_masked_paths(), for paths inside of files that are being unpacked."""
    *above, last = components(path)
    return _masked([*(piece(p, False) for p in above), piece(last, True)], rules)


def is_mac_junk(path: str) -> bool:
    path = "/" + path.replace("\\", "/")
    return "/__MACOSX" in path or path.endswith("/.DS_Store")


def member_path(name: str) -> str:
    """A member's path inside of an archive; raises if it would leave the archive's folder."""
    clean = name.replace("\\", "/")
    if clean.startswith("/") or ".." in clean.split("/"):
        raise ValueError(f"unsafe archive member path: {name}")
    return "/".join(p for p in clean.split("/") if p not in ("", "."))


def download_name(name: str) -> str:
    end = tail(name)
    return name.removesuffix(end) + "_SANITIZED" + end


def is_single_file(paths: list[str]) -> bool:
    """One file that was chosen by itself, not as part of a folder."""
    return [len(components(p)) for p in paths] == [1]


def unique_names(names: list[str]) -> list[str]:
    """Names with _1, _2, ... before the suffix where one is taken already."""
    used: set[str] = set()
    out = []
    for name in names:
        dot = len(name) - len(suffix(name))
        now, n = name, 0
        while now in used:
            n += 1
            now = f"{name[:dot]}_{n}{name[dot:]}"
        used.add(now)
        out.append(now)
    return out


# The same for columns.


def suffix_column(name):
    return F.regexp_extract(name, r"^(?=.*[^.].*\.[^.]*$).+(\.[^.]+)$", 1)


def archive_suffix_column(name):
    low = F.lower(name)
    out = F.when(low.endswith(COMPOUND[0]), COMPOUND[0])
    for x in COMPOUND[1:]:
        out = out.when(low.endswith(x), x)
    return out.otherwise(suffix_column(low))


def format_column(path):
    """What a file is by its name: pdf, docx, xlsx, xls, archive, binary (refused), text or unknown (its bytes decide)."""
    name = F.lower(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1))
    end = suffix_column(name)
    own = F.when(end.isin(".pdf", ".docx", ".xlsx", ".xls"), F.substring(end, 2, 10))
    return own.when(archive_suffix_column(name).isin(ARCHIVES), "archive").when(end.isin(BINARY), "binary").when(end.isin(TEXT + TEXT_LIKE), "text").otherwise("unknown")


def safe_name_column(name):
    """struct<name, n>"""
    cleaned = F.regexp_replace(F.regexp_replace(name, BAD_CHARACTER, "X"), r"[ .]+$", "")
    return F.struct(F.when(cleaned == "", "file").otherwise(cleaned).alias("name"), F.regexp_count(name, F.lit(BAD_CHARACTER)).cast("long").alias("n"))


def components_column(path):
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) == 0, F.array(F.lit("file"))).otherwise(parts)


def safe_path_column(path):
    """A relative path in which every component has a safe name."""
    return F.array_join(F.transform(components_column(path), lambda p: safe_name_column(p)["name"]), "/")


def tail_column(name):
    end = archive_suffix_column(name)
    return F.when(end.isin(ARCHIVES), F.right(name, F.length(end))).otherwise(suffix_column(name))


def download_name_column(name):
    end = tail_column(name)
    return F.concat(F.left(name, F.length(name) - F.length(end)), F.lit("_SANITIZED"), end)


def with_masked_paths(df: DataFrame, path: str, rules: list[str]) -> DataFrame:
    """Adds masked_path and path_hits (map<kind, count>). Every name becomes a safe one, then the rules mask it, in the last one without its suffix;
    a path without names, or null, is "file". Each different path is masked once, its names as rows, so rules run where masked() runs
    them; grouping brings together the names of one path, never more."""
    given = F.coalesce(F.col(path), F.lit(""))
    names = df.select(given.alias("__path")).distinct().withColumn("__names", components_column(F.col("__path")))
    names = names.select("__path", F.size("__names").alias("__size"), F.posexplode("__names").alias("__at", "__name")).withColumn("__safe", safe_name_column(F.col("__name")))
    end = F.when(F.col("__at") == F.col("__size") - 1, tail_column(F.col("__safe.name"))).otherwise("")
    names = names.select("__path", "__at", F.col("__safe.n").alias("__bad"), F.col("__safe.name").alias("__whole"), end.alias("__tail"))
    names = names.withColumn("__stem", F.expr("left(__whole, length(__whole) - length(__tail))")).drop("__whole")
    done = masked(names, "__stem", rules) if rules else names.withColumns({"masked": F.col("__stem"), "hits": F.array(F.lit(0).cast("long"))})
    inside = F.array_sort(F.collect_list(F.struct("__at", F.concat("masked", "__tail").alias("name"))))
    hits = F.array(*(F.sum(F.col("hits")[k]) for k in range(len(rules) + 1)))
    whole = done.groupBy("__path").agg(F.array_join(F.transform(inside, lambda x: x["name"]), "/").alias("masked_path"), F.sum("__bad").alias("__bad"), hits.alias("__hits"))
    kinds = F.map_concat(F.map_filter(F.create_map(F.lit(FILENAME_FORMAT), F.col("__bad")), lambda _, n: n > 0), hits_by_kind(F.col("__hits"), rules))
    return df.join(whole.select("__path", "masked_path", kinds.alias("path_hits")), given == F.col("__path")).drop("__path")


def numbered_column(name, number):
    """A name with _1, _2, ... before its suffix."""
    end = suffix_column(name)
    return F.concat(F.left(name, F.length(name) - F.length(end)), F.lit("_"), number.cast("string"), end)


NUMBERED = r"^(.*)_([1-9][0-9]{0,17})$"


def _with_parent(names: DataFrame) -> DataFrame:
    """Adds parent and slot: the name whose slot-th numbered form this one is, or null; and depth, how many numbers it ends in."""
    end = suffix_column(F.col("name"))
    body = F.left("name", F.length("name") - F.length(end))
    above = F.concat(F.regexp_extract(body, NUMBERED, 1), end)
    names = names.withColumn("depth", F.length(F.regexp_replace(F.regexp_extract(body, r"((?:_[1-9][0-9]*)*)$", 1), "[^_]", "")))
    names = names.withColumn("parent", F.when(body.rlike(NUMBERED), above)).withColumn("slot", F.when(body.rlike(NUMBERED), F.regexp_extract(body, NUMBERED, 2).cast("long")))
    real = suffix_column(F.col("parent")) == end
    return names.withColumns({"slot": F.when(real, F.col("slot")), "parent": F.when(real, F.col("parent"))})


def _passed(blocks: DataFrame) -> DataFrame:
    """folder, name, slot, limit -> the same with skipped: how many blocked numbers of its name were passed before each, null where
    the number itself is given away. A number is passed if no more were passed before it than `limit`. One pass over sorted rows
    that remembers one count."""

    def walk(batches):
        now, n = None, 0
        for batch in batches:
            out = []
            for folder, name, limit in zip(batch.column("folder").to_pylist(), batch.column("name").to_pylist(), batch.column("limit").to_pylist()):
                if (folder, name) != now:
                    now, n = (folder, name), 0
                out.append(n if n <= limit else None)
                n += n <= limit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "skipped"])

    rows = blocks.select("folder", "name", "slot", "limit", "child")
    return rows.repartition("folder", "name").sortWithinPartitions("folder", "name", "slot").mapInArrow(walk, "folder string, name string, slot long, limit long, child string, skipped long")


def with_unique_names(df: DataFrame, folder: str, name: str, order: str) -> DataFrame:
    """Adds unique_name: names of a folder that are taken already get _1, _2, ... in the given order, as unique_names() does it. Names are
    safe ones, which have no dot at their end.

    The first row of a name takes it, the k-th one after it the k-th number that is free. A number is not free if a row has asked for just that
    numbered name before. Such numbers are sorted by name and number; one pass tells which of them are passed, and a running sum
    moves the rows behind them. A number that is given away first leaves the row that asks for it with a number of its own, so
    names that end in more numbers come later: as many turns as numbers follow each other in a name, whatever their values. Ranks
    and sums are those of running(), so that no name has to meet in one task; only blocked numbers of one name pass through one, in order."""
    base = running(df, [folder, name], [order], name="__rank")
    rows = base.select("__id", F.col(folder).cast("string").alias("folder"), F.col(name).alias("name"), F.col("__rank").alias("rank"), F.struct(order, name, "__rank").alias("time"))
    names = _with_parent(rows.groupBy("folder", "name").agg(F.count("*").alias("rows"), F.min("time").alias("time")))
    known = names.select(F.col("folder").alias("f"), F.col("name").alias("n"), F.col("rows").alias("of"), F.col("depth").alias("above"))
    same = F.col("folder").eqNullSafe(F.col("f"))
    # Numbered names whose plain form is there as well.
    children = names.filter("parent is not null").join(known, same & (F.col("parent") == F.col("n"))).select("folder", F.col("parent").alias("name"), "slot", F.col("name").alias("child"), "time", "of", "above")
    many = children.groupBy("folder", "name").agg(F.count("*").alias("blocked")).withColumnsRenamed({"folder": "f", "name": "n"})
    reached = F.col("slot") <= F.col("of") + F.col("blocked")
    children = written(children.join(many, same & (F.col("name") == F.col("n"))).filter(reached).drop("f", "n", "blocked"))
    robbed = passed = None
    depths = [r["above"] for r in children.select("above").distinct().orderBy("above").collect()]  # as many as numbers follow each other in a name
    if depths:
        families = children.select(F.col("folder").alias("f"), F.col("name").alias("n")).distinct()
        asked = rows.join(families, same & (F.col("name") == F.col("n")), "left_semi").select("folder", "name", "time", F.lit(1).alias("one"), F.lit(None).cast("string").alias("child"))
        events = asked.unionByName(children.select("folder", "name", "time", F.lit(0).alias("one"), "child"))
        earlier = running(events, ["folder", "name"], ["time"], "one", "earlier").filter("child is not null").select(F.col("folder").alias("f"), F.col("child").alias("c"), "earlier")
        blocks = written(children.join(earlier, same & (F.col("child") == F.col("c"))).select("folder", "name", "slot", "child", "above", "earlier"))
        schema = "folder string, name string"
        robbed = df.sparkSession.createDataFrame([], schema)
        for depth in depths:
            own = blocks.filter(F.col("above") == depth)
            taken = robbed.select(F.col("folder").alias("f"), F.col("name").alias("n"), F.lit(0).alias("first"))
            own = own.join(taken, same & (F.col("name") == F.col("n")), "left")
            before = F.greatest(F.col("earlier") - F.coalesce("first", F.lit(1)), F.lit(0))
            done = written(_passed(own.withColumn("limit", F.col("slot") - 1 - before)))
            robbed = robbed.unionByName(done.filter("skipped is null").select("folder", F.col("child").alias("name")))
            passed = done if passed is None else passed.unionByName(done)
        taken = robbed.select(F.col("folder").alias("f"), F.col("name").alias("n"), F.lit(1).alias("more"))
        rows = rows.join(taken, same & (F.col("name") == F.col("n")), "left").withColumn("j", F.col("rank") + F.coalesce("more", F.lit(0))).drop("f", "n", "more")
        # The j-th number that is not passed lies behind all passed ones with fewer than j free numbers before them.
        jumps = passed.filter("skipped is not null").select("folder", "name", (F.col("slot") - 1 - F.col("skipped")).alias("at"), F.lit(1).alias("turn"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("row"))
        inside = rows.join(families, same & (F.col("name") == F.col("n")), "left_semi").filter("j > 0").select("folder", "name", F.col("j").alias("at"), F.lit(0).alias("turn"), F.lit(0).alias("one"), F.col("__id").alias("row"))
        moved = running(inside.unionByName(jumps), ["folder", "name"], ["at", "turn"], "one", "jumped").filter("row is not null").select(F.col("row").alias("__id"), "jumped")
        numbers = rows.select("__id", "j").join(moved, "__id", "left").select("__id", (F.col("j") + F.coalesce("jumped", F.lit(0))).alias("__number"))
        base = base.join(numbers, "__id")
    else:
        base = base.withColumn("__number", F.col("__rank"))
    unique = F.when(F.col("__number") == 0, F.col(name)).otherwise(numbered_column(F.col(name), F.col("__number")))
    return base.withColumn("unique_name", unique).select(*df.columns, "unique_name")
