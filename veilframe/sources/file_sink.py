"""Masked files as outputs that are there as a whole or not at all.

A Python data source for writing rows (path, content). Tasks write below a hidden folder of the write; only when all of them are done does the commit
move their files to their places, and an abort removes the folder. A package is one ZIP archive: tasks write archives of their
own, and the commit puts their members one after the other, byte for byte, behind one directory. The driver handles names, lengths
and offsets, and copies blocks; contents are never in its memory.

A path that leaves the folder fails the write. Attempts that fail, or run twice, leave nothing behind. Null contents are empty files.
"""

from __future__ import annotations

import posixpath
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.paths import member_path
from .text_ranges import opened

BLOCK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    part: str  # a hidden file or, for a package, a hidden archive
    files: list[tuple[str, str]]  # (hidden name, path)
    size: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.package = options.get("package", "")
        self.level = max(0, min(int(options.get("level", 1)), 9))
        system, root = opened(self.path)
        self.hidden = posixpath.join(root, f".writing-{uuid.uuid4().hex}")
        system.create_dir(self.hidden, recursive=True)  # here, not in tasks: one that outlives an abort finds no folder to write to

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system = opened(self.path)[0]
        own = posixpath.join(self.hidden, uuid.uuid4().hex)
        done = Written(own, [], 0)
        archive = None
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                path, data = member_path(path), content.as_py() or b""
                if self.package:
                    if archive is None:
                        raw = system.open_output_stream(own)
                        archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=self.level)
                    archive.writestr(path, data)
                else:
                    name = f"{own}-{len(done.files)}"
                    with system.open_output_stream(name) as file:
                        file.write(data)
                    done.files.append((name, path))
                done.size += len(data)
        if archive is not None:
            archive.close()
            raw.close()
            done.files.append((own, ""))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        done = [m for m in messages if m is not None and m.files]
        try:
            if self.package:
                joined = f"{self.hidden}-package"
                _join(system, [m.part for m in done], joined, self.level)
                system.move(joined, posixpath.join(root, self.package))
            else:
                paths = [path for m in done for _, path in m.files]
                if len(set(paths)) < len(paths):
                    raise ValueError("two rows have one path")
                for folder in sorted({posixpath.dirname(p) for p in paths}):
                    system.create_dir(posixpath.join(root, folder), recursive=True)
                for m in done:
                    for name, path in m.files:
                        system.move(name, posixpath.join(root, path))
        finally:
            self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(opened(self.path)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        for path in (self.hidden, f"{self.hidden}-package"):
            for wait in (0.1, 0.3, 1.0, 3.0):
                found = system.get_file_info(path)
                if found.type == fs.FileType.NotFound:
                    break
                try:
                    system.delete_file(path) if found.is_file else system.delete_dir(path)
                except OSError:  # a task that is being stopped still writes
                    time.sleep(wait)


def _join(system: fs.FileSystem, parts: list[str], target: str, level: int) -> None:
    """One archive of the members of several, which are copied as they are."""
    with system.open_output_stream(target) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as archive:
        names = set()
        for part in parts:
            with system.open_input_file(part) as own, zipfile.ZipFile(own) as members:
                infos = sorted(members.infolist(), key=lambda i: i.header_offset)
                base = archive.fp.tell()
                own.seek(0)
                left = members.start_dir
                while left:
                    block = own.read(min(BLOCK, left))
                    archive.fp.write(block)
                    left -= len(block)
                for info in infos:
                    if info.filename in names:
                        raise ValueError(f"two rows have one path: {info.filename}")
                    names.add(info.filename)
                    info.header_offset += base
                    archive.filelist.append(info)
                    archive.NameToInfo[info.filename] = info
                archive.start_dir = archive.fp.tell()
                archive._didModify = True


class FileSink(DataSource):
    """Format file_sink, for rows with path and content. Options: path, package (the name of one archive for all), level (of its compression)."""

    @classmethod
    def name(cls) -> str:
        return "file_sink"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()})


def write_files(rows: DataFrame, folder: str, package: str = "", level: int = 1) -> None:
    """Writes rows (path, content) as files below a folder, or as one archive in it."""
    rows.sparkSession.dataSource.register(FileSink)
    writer = rows.select("path", "content").write.format("file_sink").mode("append").option("path", folder).option("level", level)
    (writer.option("package", package) if package else writer).save()


