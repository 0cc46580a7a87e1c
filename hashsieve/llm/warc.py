"""WARC archives compressed with Zstandard: writer and reader.

An archive is a ``.warc.zst`` stream: a leading skippable frame holds the
dictionary, then every record is one Zstandard frame of its own.  The writer
learns each archive's dictionary from the first records of its partition and
leaves the files to Spark's text sink, whose line separator is set to an empty
skippable frame: the bytes are a valid archive, and Spark's commit protocol
covers failed and repeated tasks on any file system it can write to.  (The
sink names the files ``part-*.txt``.)  The reader takes whole archives from the
``binaryFile`` source, loads the dictionary, decodes one frame per record and
checks the frame, the WARC version line, the required headers, the block's
length and end, the length in the HTTP header and the payload digest.

Equal payloads are found before writing: the row with the smallest page_id
becomes a ``response``, the others ``revisit`` records that carry the HTTP header but
no payload.  The search moves ids and digests only; a digest shared by a third
of all pages is pre-aggregated, and joined as a skew join can split it.

Archives are as large as the partitions they come from and must stay below the
2 GB of a ``binaryFile`` row; ``archives`` sets their number where needed.

Defined cases: null html is the empty payload; a null url leaves the target out;
a row with a null page_id is always a response; rows that repeat the smallest
page_id of equal payloads are all responses; payloads below ``min_revisit_bytes``
are never revisits; extra columns are ignored; an empty table gives an empty
folder that reads as no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import MAX_BROADCAST_DECISIONS, batches, map_rows, ship, strings, table, written

# Fixed values of the formats.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame 0x184D2A50 of length 0, as the sink's line separator
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

DICTIONARY_BYTES = 16 << 10
DICTIONARY_RECORDS = 128  # records of a partition, at most, that its dictionary is learned from
FEED = 64 << 10


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str | None) -> int | None:
    tail = (identifier or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail.lstrip("-").isdigit() else None


def _header_value(value: str) -> str:
    """Header lines end at CR or LF, so these are percent-encoded, and with them the sign itself."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record: a response, or a revisit when ``refers_to`` is given."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of one record; ValueError says what is wrong with it."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC version line or end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"malformed header line {line!r}")
        headers[name.strip().lower()] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ValueError(f"missing headers: {', '.join(missing)}")
    if not headers["content-length"].isdigit():
        raise ValueError(f"malformed length {headers['content-length']!r}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes where {length} are announced")
    block, kind = rest[:length], headers["warc-type"]
    out = {"warc_type": kind, "record_id": headers["warc-record-id"], "target_uri": headers.get("warc-target-uri"),
           "refers_to": headers.get("warc-refers-to"), "payload": block, "payload_bytes": length, "payload_digest": None}
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("no end of the HTTP header")
        sizes = [v.strip() for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if n.strip().lower() == b"content-length"]
        size = int(sizes[0]) if sizes and sizes[0].isdigit() else len(payload)
        if kind == "response" and size != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes where {size} are announced")
        if kind == "revisit" and payload:
            raise ValueError("a revisit record with a payload")
        out |= {"payload": payload if kind == "response" else None, "payload_bytes": size}
    announced = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    out["payload_digest"] = announced if out["payload"] is None else digest_of(out["payload"])
    if announced and announced != out["payload_digest"]:
        raise ValueError("payload digest differs")
    return out


def dictionary_for(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A trained dictionary, or None where the samples are too few or too small to train on."""
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def archive_frames(records: Iterable[bytes], level: int = 3) -> Iterator[bytes]:
    """Frames of one archive: the dictionary's skippable frame, then a frame for each record."""
    records, first = iter(records), []
    for record in records:
        first.append(record)
        if len(first) >= DICTIONARY_RECORDS:
            break
    learned = dictionary_for([r[:8192] for r in first])
    if learned is not None:
        yield struct.pack("<II", DICTIONARY_FRAME, len(learned.as_bytes())) + learned.as_bytes()
    packer = zstandard.ZstdCompressor(level=level, dict_data=learned, write_content_size=True, write_checksum=True)
    for part in (first, records):
        for record in part:
            yield packer.compress(record)


def read_frames(data: bytes) -> Iterator[tuple[int, bytes | ValueError]]:
    """(offset, record) of each frame, or (offset, error); after an error it goes on at the next frame's magic number."""
    at, view, unpacker, begun = 0, memoryview(data), None, False
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(data[at + 4:at + 8], "little")
            body = data[at + 8:at + 8 + size]
            if len(body) < size or at + 8 > len(data):
                yield at, ValueError("a skippable frame is cut short")
                return
            if magic == DICTIONARY_FRAME and not begun:
                if body[:4] == ZSTD_MAGIC:  # the dictionary may itself be compressed
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=16 << 20)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            begun, at = True, at + 8 + size
            continue
        begun, start = True, at
        try:
            frame, parts = (unpacker or zstandard.ZstdDecompressor()).decompressobj(), []
            while not frame.eof:
                if at >= len(data):
                    raise ValueError("a frame is cut short")
                step = view[at:at + FEED]
                parts.append(frame.decompress(step))
                at += len(step) - (len(frame.unused_data) if frame.eof else 0)
            yield start, b"".join(parts)
        except (zstandard.ZstdError, ValueError) as e:
            yield start, ValueError(str(e))
            at = data.find(ZSTD_MAGIC, start + 4)
            at = len(data) if at < 0 else at


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``__page, __sha, __first``: rows whose payload the page ``__first`` already has."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = (pages.select(F.col("page_id").alias("__page"), F.sha1(body).alias("__sha"), F.octet_length(body).alias("__bytes"))
               .filter(F.col("__page").isNotNull() & (F.col("__bytes") >= min_revisit_bytes)).drop("__bytes"))
    firsts = (digests.groupBy("__sha").agg(F.min("__page").alias("__first"), F.count("*").alias("__n"))
              .filter("__n > 1").select(F.col("__sha").alias("__key"), "__first"))
    firsts = written(firsts, "warc-firsts")  # its layout forgotten, the join below has two plain exchanges and can split a hot digest
    return (digests.join(firsts, F.col("__sha") == F.col("__key")).filter(F.col("__page") > F.col("__first"))
            .select("__page", "__sha", "__first").distinct())


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", archives: int | None = None,
                   min_revisit_bytes: int = 0) -> None:
    """Write a record for every row of ``page_id, url, html`` into archives in the folder ``path``."""
    found = written(revisits(pages, min_revisit_bytes), "warc-revisits")
    if found.count() <= MAX_BROADCAST_DECISIONS:
        found = F.broadcast(found)
    rows = pages.select("page_id", "url", "html")
    rows = rows.repartition(archives) if archives else rows
    sha = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = (rows.withColumn("__mine", sha).join(found, (F.col("page_id") == F.col("__page")) & (F.col("__mine") == F.col("__sha")), "left")
            .select("page_id", "url", "html", "__first"))
    schema = pa.schema([("frame", pa.binary())])

    def run(incoming: Iterator[pa.RecordBatch]):
        records = (build_record(i, u, h or b"", r, date) for b in incoming
                   for i, u, h, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strings(b.column(2)), b.column(3).to_pylist()))
        yield from batches(((f,) for f in archive_frames(records)), schema, weigh=lambda r: len(r[0]))

    ship(pages.sparkSession)
    frames = rows.mapInArrow(run, "frame binary") if archives else map_rows(rows, run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


RECORDS = ("archive string, offset long, warc_type string, record_id string, target_uri string, refers_to string, payload binary, "
           "payload_bytes long, payload_digest string, error string")


def read_archives(spark: SparkSession, path: str, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row per record.  ``strict`` raises on a broken record; otherwise it is a row with ``error``.

    Without ``payloads`` they are decoded and checked as well, but not returned.
    """
    ship(spark)
    names = ["warc_type", "record_id", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest"]
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()),
                        ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("error", pa.string())])

    def run(incoming: Iterator[pa.RecordBatch]):
        def rows():
            for batch in incoming:
                for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for offset, record in read_frames(content.as_buffer().to_pybytes()):
                        try:
                            if isinstance(record, ValueError):
                                raise record
                            fields = parse_record(record)
                        except ValueError as e:
                            if strict:
                                raise ValueError(f"{archive} at {offset}: {e}") from e
                            yield (archive, offset, *[None] * len(names), str(e))
                            continue
                        if not payloads:
                            fields["payload"] = None
                        yield (archive, offset, *(fields[n] for n in names), None)

        yield from batches(rows(), schema, weigh=lambda r: len(r[6] or b""))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


#: SHA-1 in base32 cannot be written in DuckDB's SQL without a function for it, so hexadecimal digits are regrouped by five bits.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (
  SELECT page_id, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY h) AS first,
    array_to_string(list_transform(string_split(sha1(h), ''), lambda c: right(to_binary(strpos('0123456789abcdef', c) + 15), 4)), '') AS bits
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_reduce(list_transform(string_split(substr(bits, CAST(k * 5 + 1 AS INTEGER), 5), ''), lambda b: CAST(b AS INTEGER)),
      lambda a, b: a * 2 + b) AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(table(spark, sf_dir, "pages"), path)
    page = F.when(F.col("record_id") != record_id(None), F.regexp_extract("record_id", r"(-?\d+)>$", 1).cast("long"))
    return read_archives(spark, path, payloads=False).select(
        page.alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        F.regexp_extract("refers_to", r"(-?\d+)>$", 1).cast("long").alias("refers_to"))
