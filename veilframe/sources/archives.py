"""Archives as lists of (path, bytes): unpacking within limits, and packing again in the same container where that exists.

Links, devices and paths that leave the archive are refused, as are archives over the limits, before or while they are unpacked.
rar, 7z, lz and zst need programs that are not here and are refused.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import stat
import tarfile
import zipfile
from dataclasses import dataclass

from ..functions.paths import archive_stem, archive_suffix, member_path

Member = tuple[str, bytes]


@dataclass(frozen=True)
class Limits:
    depth: int = 5
    files: int = 10_000
    megabytes: int = 4096

    @property
    def size(self) -> int:
        return self.megabytes << 20


_STREAMS = {".gz": gzip, ".bz2": bz2, ".xz": lzma}
_TARS = {".tar": "", ".tar.gz": "gz", ".tgz": "gz", ".tar.bz2": "bz2", ".tbz2": "bz2", ".tar.xz": "xz"}


def _within(count: int, size: int, limits: Limits) -> None:
    if count > limits.files:
        raise ValueError(f"the archive holds over {limits.files} files")
    if size > limits.size:
        raise ValueError(f"the archive holds over {limits.megabytes} MB")


def _read(stream, left: int, limits: Limits) -> bytes:
    parts, size = [], 0
    while part := stream.read(1 << 20):
        size += len(part)
        if size > left:
            _within(0, limits.size + 1, limits)
        parts.append(part)
    return b"".join(parts)


def unpack(name: str, content: bytes, limits: Limits = Limits(), depth: int = 0) -> list[Member]:
    """Members of an archive in the order of their paths."""
    if depth > limits.depth:
        raise ValueError(f"archives are nested deeper than {limits.depth}")
    end = archive_suffix(name)
    try:
        if end == ".zip":
            found = _unzip(content, limits)
        elif end in _TARS:
            found = _untar(content, _TARS[end], limits)
        elif end in _STREAMS:
            with _STREAMS[end].open(io.BytesIO(content)) as stream:
                found = [(archive_stem(posixpath.basename(name)) or "file", _read(stream, limits.size, limits))]
        else:
            raise ValueError(f"archives of this kind can't be unpacked here: {end}")
    except (zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, EOFError, OSError, NotImplementedError, RuntimeError) as error:
        raise ValueError(f"the archive can't be read: {error}") from error
    return sorted(found)


def _unzip(content: bytes, limits: Limits) -> list[Member]:
    with zipfile.ZipFile(io.BytesIO(content)) as source:
        infos = [i for i in source.infolist() if not i.is_dir()]
        _within(len(infos), sum(i.file_size for i in infos), limits)
        out, size = [], 0
        for info in infos:
            if stat.S_ISLNK(info.external_attr >> 16):
                raise ValueError(f"links are not allowed in archives: {info.filename}")
            path = member_path(info.filename)
            with source.open(info) as stream:
                out.append((path, _read(stream, limits.size - size, limits)))
            size += len(out[-1][1])
        return out


def _untar(content: bytes, kind: str, limits: Limits) -> list[Member]:
    with tarfile.open(fileobj=io.BytesIO(content), mode=f"r:{kind}") as source:
        out, size, count = [], 0, 0
        for info in source:
            path = member_path(info.name)
            if info.isdir():
                continue
            if not info.isreg():
                raise ValueError(f"links and devices are not allowed in archives: {info.name}")
            count, size = count + 1, size + info.size
            _within(count, size, limits)
            out.append((path, _read(source.extractfile(info), limits.size, limits)))
        return out


def pack(members: list[Member], end: str) -> tuple[bytes, str]:
    """(archive, its suffix): the container of the suffix, or zip where there is none here."""
    end = {".tgz": ".tar.gz", ".tbz2": ".tar.bz2"}.get(end, end)
    out = io.BytesIO()
    if end in _TARS:
        with tarfile.open(fileobj=out, mode=f"w:{_TARS[end]}") as target:
            for path, data in members:
                info = tarfile.TarInfo(path)
                info.size = len(data)
                target.addfile(info, io.BytesIO(data))
    elif end in _STREAMS and len(members) == 1:
        out.write(_STREAMS[end].compress(members[0][1]))
    else:
        end = ".zip"
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for path, data in members:
                target.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)
    return out.getvalue(), end
