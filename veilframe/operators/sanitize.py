"""Masking of whole files: the bytes of a file by its format, of folders and archives by their members.

A file that can't be masked safely has an error and no content, never its original content; checked() then fails the
query as a whole.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoding import LINE, detect
from ..functions.masking import mask_text
from ..functions.paths import BINARY, archive_stem, archive_suffix, is_archive, is_mac_junk, masked_component, masked_path, suffix, unique_names
from ..sources.archives import Limits, pack, unpack
from ..sources.office import mask_docx, mask_xlsx

#: (audited file, kind, count, location, whether the masked unit is blank)
Hit = tuple[str, str, int, str, bool]
MOST_COMPONENTS = 50  # of a path; beyond it the file has an error, as limits on archives give one
BATCH_BYTES = 4 << 20  # masked files leave a task in batches of so many bytes, or one file
_line = re.compile(LINE)


def mask_plain(content: bytes, rules: list[str], file: str) -> tuple[bytes, list[Hit]]:
    found = detect(content)
    if found is None:
        raise ValueError(f"Unsupported text encoding or binary content: {file}")
    codec, mark = found
    try:
        text = content[len(mark) :].decode(codec)
    except UnicodeDecodeError as error:
        raise ValueError(f"not {codec} throughout: {file}") from error
    out, hits = [], []
    for number, line in enumerate(_line.findall(text), 1):
        masked, total, counts = mask_text(line, rules)
        out.append(masked)
        hits += [(file, kind, n, f"Line {number}", not masked.strip()) for kind, n in counts.items()] if total else []
    return mark + "".join(out).encode(codec), hits


def mask_file(name: str, content: bytes, rules: list[str], file: str) -> tuple[bytes, list[Hit]]:
    """One file that is no archive; raises ValueError for what is not supported."""
    end = suffix(name).lower()
    if end in (".docx", ".xlsx"):
        masked, hits = (mask_docx if end == ".docx" else mask_xlsx)(content, rules)
        return masked, [(file, kind, n, location, end == ".docx") for location, kind, n in hits]
    if end in (".pdf", ".xls"):
        raise ValueError(f"{end[1:].upper()} needs a library that is not installed: {name}")
    if end in BINARY:
        raise ValueError(f"Unsupported binary/document file type {end}: {name}")
    return mask_plain(content, rules, file)


def mask_archive(name: str, content: bytes, rules: list[str], file: str, limits: Limits = Limits(), depth: int = 0) -> tuple[bytes, str, list[Hit]]:
    """(archive, its suffix, hits). Members are audited under their original paths below the archive's; files and then folders get
    masked names, made unique inside of their folder in the order of their paths."""
    end = archive_suffix(name)
    hits: list[Hit] = []
    done: list[tuple[str, bytes]] = []
    for path, data in unpack(name, content, limits, depth):
        if is_mac_junk(path):
            continue
        own, base = f"{file}/{path}", posixpath.basename(path)
        if is_archive(base):
            data, new_end, found = mask_archive(base, data, rules, own, limits, depth + 1)
            base = archive_stem(base) + new_end if new_end != archive_suffix(base) else base
        else:
            data, found = mask_file(base, data, rules, own)
        hits += found
        done.append((posixpath.join(posixpath.dirname(path), base), data))
    renamed = _renamed([p for p, _ in done], rules, file, hits)
    archive, new_end = pack([(p, data) for p, (_, data) in zip(renamed, done)], end)
    return archive, new_end, hits


def _renamed(paths: list[str], rules: list[str], file: str, hits: list[Hit]) -> list[str]:
    """Masked paths of all members; folders that hold them are renamed once each."""
    folders: dict[str, list[str]] = {}
    leaves = set(paths)
    for path in paths:
        at = path
        while at:
            above = posixpath.dirname(at)
            if at not in folders.setdefault(above, []):
                folders[above].append(at)
            at = above
    names: dict[str, str] = {"": ""}
    for folder in sorted(folders, key=lambda f: (f.count("/") if f else -1, f)):
        inside = sorted(folders[folder], key=lambda p: (p not in leaves, p))
        masked = [masked_component(posixpath.basename(p), rules, p in leaves) for p in inside]
        for path, name, (_, n, counts) in zip(inside, unique_names([m[0] for m in masked]), masked):
            names[path] = posixpath.join(names[folder], name)
            where = "Filename" if path in leaves else "Directory"
            hits += [(f"{file}/{path}", f"{where}: {kind}", k, where, False) for kind, k in counts.items()] if n else []
    return [names[p] for p in paths]


def mask_upload(path: str, content: bytes, rules: list[str], limits: Limits = Limits(), most_components: int = MOST_COMPONENTS) -> tuple[str, bytes, list[Hit]]:
    """(masked relative path, masked bytes, hits) of one input file."""
    safe, _, counts = masked_path(path, rules)
    if safe.count("/") >= most_components:
        raise ValueError(f"a path has over {most_components} components")
    hits: list[Hit] = [(safe, f"Path: {kind}", n, "Path", False) for kind, n in counts.items()]
    name = posixpath.basename(path.replace("\\", "/"))
    if is_archive(name):
        content, end, found = mask_archive(name, content, rules, safe, limits)
        if end != archive_suffix(safe):
            safe = archive_stem(safe) + end
    else:
        content, found = mask_file(name, content, rules, safe)
    return safe, content, hits + found


SANITIZED = "path string, safe_path string, content binary, total long, error string, hits array<struct<file string, match_type string, n long, location string, blank boolean, ordinal long>>"
_HIT = pa.struct([("file", pa.string()), ("match_type", pa.string()), ("n", pa.int64()), ("location", pa.string()), ("blank", pa.bool_()), ("ordinal", pa.int64())])
_SANITIZED = pa.schema([("path", pa.string()), ("safe_path", pa.string()), ("content", pa.binary()), ("total", pa.int64()), ("error", pa.string()), ("hits", pa.list_(_HIT))])


def sanitized(files: DataFrame, rules: list[str], limits: Limits = Limits(), most_components: int = MOST_COMPONENTS) -> DataFrame:
    """path, content -> SANITIZED: a row for each file, with an error in place of content where masking isn't safe."""

    def one(path: str | None, content: bytes | None) -> dict:
        try:
            safe, out, hits = mask_upload(path or "", content or b"", rules, limits, most_components)
            error = None
        except ValueError as problem:
            safe, out, hits, error = masked_path(path, rules)[0], None, [], str(problem)
        rows = [dict(zip(("file", "match_type", "n", "location", "blank"), h), ordinal=i) for i, h in enumerate(hits)]
        return {"path": path, "safe_path": safe, "content": out, "total": sum(h[2] for h in hits), "error": error, "hits": rows}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size = [], 0
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                done.append(one(path, content.as_py()))
                size += len(done[-1]["content"] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(done, _SANITIZED)
                    done, size = [], 0
            if done:
                yield pa.RecordBatch.from_pylist(done, _SANITIZED)

    return files.select("path", "content").mapInArrow(run, SANITIZED)


def checked(done: DataFrame) -> DataFrame:
    """Fails if any file could not be masked."""
    return done.withColumn("content", F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error"))).cast("binary")))


def hit_rows(done: DataFrame) -> DataFrame:
    """file, ordinal, location, match_type, n, masked (blank or not) for audit()."""
    return done.select(F.explode("hits").alias("h")).select("h.file", "h.ordinal", "h.location", F.when(F.col("h.blank"), "").otherwise("x").alias("masked"), "h.match_type", "h.n")
