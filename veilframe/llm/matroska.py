"""Media columns: Matroska containers as binary columns, read into packet tables.

The reader handles variable-length ids and sizes (unknown sizes too), SimpleBlock and BlockGroup, the lacing
kinds none, Xiph, fixed and EBML, and cues. The writer stores 8-bit mono PCM without loss.
Null text counts as empty; an empty text becomes 64 zero bytes. Very long texts are stored whole, in as many clusters as they need.
Repeated rows and ids are media of their own, with equal values. Broken media raise ValueError in the plain
functions; packets() then gives no packets and puts the reason into the column error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}

SAMPLE_RATE, FRAME, LACE, BLOCKS_PER_CLUSTER = 8000, 1024, 8, 16
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3


def vint(value: int, width: int = 0) -> bytes:
    """A data size; all ones is reserved for 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(value, next position); None is the unknown size."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return raw, at + width
    value = raw & (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, stops: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body start, body end) of the elements in a range. An element of unknown size reaches to the next
    top-level element, or to the end of the range."""
    while at < end:
        start = at
        ident, at = read_vint(data, at, end, True)
        if ident in stops:
            return
        size, at = read_vint(data, at, end)
        if size is None:
            stop = end if ident == SEGMENT else _unknown_end(data, at, end)
        else:
            stop = at + size
            if stop > end:
                raise ValueError(f"element {ident:X} at byte {start} is cut off")
        yield ident, start, at, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        start = at
        ident, at = read_vint(data, at, end, True)
        if ident in TOP_LEVEL:
            return start
        size, at = read_vint(data, at, end)
        at = end if size is None else at + size
    return end


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    scale: int = 1_000_000
    clusters: list[int] = field(default_factory=list)  # start bytes
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte of the cluster
    packets: list[tuple[int, int, int, int, int, int, bool]] = field(default_factory=list)
    """(track, timestamp ns, byte offset, length, cluster, place in the lace, key frame)"""


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, length) of the frames of a block's body."""
    if kind == NO_LACING:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    if kind == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("frames of fixed lacing differ")
        return [(at + i * ((end - at) // n), (end - at) // n) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if kind == XIPH_LACING:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, after = read_vint(data, at, end)
            if value is None:
                raise ValueError("unknown size in a lace")
            size = value if not i else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """Reads a whole container."""
    media = Media()
    top = elements(data, 0, len(data))
    head = next(top, None)
    if head is None or head[0] != EBML:
        raise ValueError("no EBML header")
    for ident, _, start, end in top:
        if ident == SEGMENT:
            for inner, at, body, stop in elements(data, start, end):
                if inner == INFO:
                    media.scale = next((int.from_bytes(data[b:e], "big") for i, _, b, e in elements(data, body, stop) if i == TIMESTAMP_SCALE), media.scale)
                elif inner == TRACKS:
                    _read_tracks(data, body, stop, media)
                elif inner == CLUSTER:
                    media.clusters.append(at)
                    _read_cluster(data, body, stop, media)
                elif inner == CUES:
                    _read_cues(data, body, stop, start, media)
    return media


def _read_tracks(data: bytes, at: int, end: int, media: Media) -> None:
    for ident, _, body, stop in elements(data, at, end):
        if ident == TRACK_ENTRY:
            track: dict = {}
            for i, _, b, e in elements(data, body, stop):
                if i in (TRACK_NUMBER, TRACK_TYPE):
                    track["number" if i == TRACK_NUMBER else "type"] = int.from_bytes(data[b:e], "big")
                elif i == CODEC_ID:
                    track["codec"] = data[b:e].decode("ascii", "replace")
                elif i == AUDIO:
                    for j, _, c, f in elements(data, b, e):
                        if j == RATE:
                            track["rate"] = struct.unpack(">d" if f - c == 8 else ">f", data[c:f])[0]
                        elif j in (CHANNELS, BIT_DEPTH):
                            track["channels" if j == CHANNELS else "bits"] = int.from_bytes(data[c:f], "big")
            media.tracks[track.get("number", 0)] = track


def _read_cluster(data: bytes, at: int, end: int, media: Media) -> None:
    base, cluster = 0, len(media.clusters) - 1
    for ident, _, body, stop in elements(data, at, end):
        if ident == TIMESTAMP:
            base = int.from_bytes(data[body:stop], "big")
        elif ident == SIMPLE_BLOCK:
            _read_block(data, body, stop, base, cluster, None, media)
        elif ident == BLOCK_GROUP:
            inner = list(elements(data, body, stop))
            for i, _, b, e in inner:
                if i == BLOCK:
                    lasts = next((int.from_bytes(data[c:f], "big") for j, _, c, f in inner if j == BLOCK_DURATION), None)
                    _read_block(data, b, e, base, cluster, lasts, media)


def _read_block(data: bytes, at: int, end: int, base: int, cluster: int, lasts: int | None, media: Media) -> None:
    track, at = read_vint(data, at, end)
    if track is None or at + 3 > end:
        raise ValueError("broken block header")
    moved, flags = struct.unpack_from(">hB", data, at)
    begun = (base + moved) * media.scale
    frames = laced(data, at + 3, end, flags >> 1 & 3)
    rate = media.tracks.get(track, {}).get("rate") if media.tracks.get(track, {}).get("bits") == 8 else None
    done = 0
    for place, (offset, length) in enumerate(frames):
        later = round(done / rate * 1e9) if rate else (lasts or 0) * media.scale * place // len(frames)
        media.packets.append((track, begun + later, offset, length, cluster, place, bool(flags & 0x80)))
        done += length


def _read_cues(data: bytes, at: int, end: int, segment: int, media: Media) -> None:
    for ident, _, body, stop in elements(data, at, end):
        if ident == CUE_POINT:
            time = 0
            for i, _, b, e in elements(data, body, stop):
                if i == CUE_TIME:
                    time = int.from_bytes(data[b:e], "big")
                elif i == CUE_TRACK_POSITIONS:
                    found = {j: int.from_bytes(data[c:f], "big") for j, _, c, f in elements(data, b, e)}
                    media.cues.append((time, found.get(CUE_TRACK, 0), segment + found.get(CUE_CLUSTER_POSITION, 0)))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """(kind, body) of several frames in one block."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    if len({len(x) for x in frames}) == 1:
        return FIXED_LACING, bytes([len(frames) - 1]) + b"".join(frames)
    sizes = vint(len(frames[0]))
    for before, now in zip(frames, frames[1:-1]):
        change = len(now) - len(before)
        width = next(w for w in range(1, 9) if abs(change) < (1 << 7 * w - 1) - 1)
        sizes += vint(change + (1 << 7 * width - 1) - 1, width)
    return EBML_LACING, bytes([len(frames) - 1]) + sizes + b"".join(frames)


HEADER = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
PCM_TRACK = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """8-bit mono samples as a Matroska file: laced blocks in clusters, and a cue for every cluster."""
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"veilframe") + element(WRITING_APP, b"veilframe") + element(DURATION, struct.pack(">d", 1000 * len(samples) / SAMPLE_RATE)))
    parts, at, cues = [info, PCM_TRACK], len(info) + len(PCM_TRACK), []
    per_block, per_cluster = FRAME * LACE, FRAME * LACE * BLOCKS_PER_CLUSTER
    for start in range(0, len(samples), per_cluster):
        base = 1000 * start // SAMPLE_RATE
        body = [number(TIMESTAMP, base)]
        for block in range(start, min(start + per_cluster, len(samples)), per_block):
            stop = min(block + per_block, start + per_cluster, len(samples))
            kind, laid = lace([samples[i : min(i + FRAME, stop)] for i in range(block, stop, FRAME)])
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", 1000 * block // SAMPLE_RATE - base, 0x80 | kind << 1) + laid))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, number(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(parts))


def read_samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[offset : offset + length] for t, _, offset, length, *_ in media.packets if t == track)


def feature(media: Media, samples: bytes) -> str:
    """What the packet table and the samples tell, in a fixed form."""
    wave = np.frombuffer(samples, np.uint8)
    starts = set(media.clusters)
    cued = sum(at in starts for _, _, at in media.cues)
    crossings = int(np.count_nonzero((wave[1:] >= 128) != (wave[:-1] >= 128)))
    last = max((ts for _, ts, *_ in media.packets), default=0)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={cued};last_ns={last};peak={int(wave.max(initial=0))};sum={int(wave.sum(dtype=np.int64))};crossings={crossings}"


def store_text(text: bytes) -> bytes:
    """A text's payload (zeros up to a positive multiple of 64) as media."""
    return mux(text + bytes(-len(text) % 64 if text else 64))


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text -> id, n_bytes, media: the stored form as a binary column."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = [(x or "").encode("utf-8") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(store_text, texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> what is read back from the media."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media"):
            rows = []
            for doc_id, n, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                parsed = parse(blob)
                samples = read_samples(blob, parsed)
                rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(parsed, samples)))
            names = [x.split()[0] for x in MEDIA_SCHEMA.split(", ")]
            kinds = [pa.int64() if x.endswith("long") else pa.string() for x in MEDIA_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return media.mapInArrow(read, MEDIA_SCHEMA)


PACKET_SCHEMA = "id long, packet long, track long, timestamp_ns long, byte_offset long, byte_length long, cluster long, lace_place long, key_frame boolean, error string"


def packets(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row for each packet of a binary column; a row with error and nulls where media can't be read. Null media give no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKET_SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[x.split()[1]] for x in PACKET_SCHEMA.split(", ")]
        for batch in sliced(batches, "media"):
            for ident, blob in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist()):
                if blob is None:
                    continue
                try:
                    rows = [(ident, i, *p, None) for i, p in enumerate(parse(blob).packets)]
                except (ValueError, IndexError, struct.error) as broken:
                    rows = [(ident, *[None] * 8, str(broken))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).alias("media")).mapInArrow(read, PACKET_SCHEMA)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media_rows(table(spark, sf_dir, "documents")))
