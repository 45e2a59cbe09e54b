"""A content-addressed WARC archive.

Payload bytes are stored once for each SHA-256 digest; the exact record headers are kept apart, and a record is
header + payload + two line ends, joined again by digest. Of equal payloads of at least MIN_REVISIT bytes the row with the
smallest page_id is the response and the others are revisits of it; shorter ones are all responses. Null html counts as
empty. Rows that repeat the smallest page_id are all responses; a null page_id is never the smallest.
A null url gives a record without target URI. Very long pages are stored whole, as one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, sliced, staged, table

MIN_REVISIT = 100
# Fixed value: the profile of the WARC 1.1 specification for records that repeat a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id) -> F.Column:
    """A name-based id, so that a rerun writes the same bytes."""
    hexed = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(hexed, i, n), F.lit("-" if i < 21 else ">"))))


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to: narrow rows, without payloads."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    first = rows.filter(F.col("payload_bytes") >= MIN_REVISIT).groupBy(F.col("payload_digest").alias("digest")).agg(F.min("page_id").alias("first_id"))
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, F.col("payload_digest") == F.col("digest"), "left").select("page_id", "url", "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("first_id")).alias("refers_to"))


def with_heads(records: DataFrame) -> DataFrame:
    """Adds head: the exact bytes of a record before its payload (WARC header and HTTP header)."""
    eol = "\r\n"
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(eol + eol))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), F.col("record_type"), F.lit(f"{eol}WARC-Record-ID: "), record_id(page),
        F.coalesce(F.concat(F.lit(f"{eol}WARC-Target-URI: "), url), F.lit("")), F.lit(f"{eol}WARC-Date: {DATE}{eol}WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{eol}WARC-Profile: {PROFILE}{eol}WARC-Refers-To: "), record_id(F.col("refers_to")), F.lit(f"{eol}X-Refers-To-Page: "), F.col("refers_to").cast("string"))).otherwise(F.lit("")),
        F.lit(f"{eol}X-Page: "), page, F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}Content-Length: "),
        (F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string"), F.lit(eol + eol), http,
    )
    return records.withColumn("head", F.encode(head, "UTF-8"))


def write_archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, store), both written to the shared folder: a head for each page, a payload for each digest."""
    heads = staged(with_heads(plan_records(pages)).select("payload_digest", "head"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    store = staged(pages.select(payload.alias("payload")).groupBy(F.sha2("payload", 256).alias("payload_digest")).agg(F.first("payload").alias("payload")))
    return heads, store


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a record's header by lower-case name; the length of the HTTP header under 'http'. Raises ValueError if malformed."""
    block, cut, http = head.partition(b"\r\n\r\n")
    lines = block.decode("utf-8").split("\r\n")
    if not cut or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no field: {line!r}")
        fields[name.strip().lower()] = value.strip()
    if not http.endswith(b"\r\n\r\n"):
        raise ValueError("no HTTP header")
    fields["http"] = str(len(http))
    for line in http.decode("utf-8").split("\r\n")[1:]:
        if line.lower().startswith("content-length:"):
            fields["http-length"] = line.partition(":")[2].strip()
    return fields


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, payload) of the records of a plain WARC file."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at) + 4
        told = [x.partition(b":")[2] for x in raw[at:stop].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not told:
            raise ValueError("a record without its length")
        length = int(told[0])
        block = raw[stop : stop + length]
        if len(block) < length or raw[stop + length : stop + length + 4] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        http = block.index(b"\r\n\r\n") + 4
        yield parse_head(raw[at:stop] + block[:http]), block[http:]
        at = stop + length + 4


def reconstruct(heads: DataFrame, store: DataFrame) -> DataFrame:
    """page_id, record, payload: every record's exact bytes and its full payload, through the join by digest."""
    eol = F.lit(b"\r\n\r\n")
    joined = heads.join(store, "payload_digest", "left")
    revisit = F.contains(F.col("head"), F.lit(b"WARC-Type: revisit\r\n"))
    return joined.select("payload_digest", F.concat("head", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), eol).alias("record"), "payload")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(heads: DataFrame, store: DataFrame) -> DataFrame:
    """A row for each record as it is reconstructed and parsed, with the length and digest of its payload; fails if a record is
    malformed or its payload missing or damaged."""

    def checked(record: bytes | None, payload: bytes | None) -> tuple:
        try:
            ((fields, held),) = parse_records(record or b"")
        except ValueError as e:
            raise ValueError(f"record malformed, its payload missing or damaged: {e}") from e
        revisit = fields["warc-type"] == "revisit"
        full = payload if revisit else held
        digest = hashlib.sha256(full or b"").hexdigest()
        told = fields["warc-payload-digest"].partition(":")[2]
        if full is None or revisit and held or digest != told or len(full) != int(fields["http-length"]):
            raise ValueError(f"payload missing or damaged: {told}")
        number = lambda name: int(fields[name]) if fields.get(name, "null") != "null" else None
        return number("x-page"), len(full), digest, fields["warc-type"], number("x-refers-to-page")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "record"):
            rows = [checked(r.as_py(), p.as_py()) for r, p in zip(batch.column("record"), batch.column("payload"))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    # A response holds its payload itself.
    own = F.when(F.contains(F.col("record"), F.lit(b"WARC-Type: revisit\r\n")), F.col("payload")).alias("payload")
    return reconstruct(heads, store).select("record", own).mapInArrow(read, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return read_archive(*write_archive(table(spark, sf_dir, "pages")))


ORACLE_OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
