"""WARC archives with one Zstandard frame for each record.

An archive begins with a skippable frame that holds the dictionary of all its
frames (raw, or itself a Zstandard frame), trained on its first records; then
follows one frame for each record. Pages with equal payloads are stored once:
the smallest page id is the response, the others are revisit records that keep
the HTTP header and name the response.

Spark writes an archive from each partition of the pages, and reads archives
one in a task, frame by frame, checking every length and digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import parallel_range, scratch, table
from waymark.llm.files import reading, writing

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A dictionary is trained on so many bytes of an archive's first records, each cut to so many.
SAMPLE_BYTES, SAMPLE_EACH, DICTIONARY_BYTES = 1 << 20, 8192, 32768
READ_BYTES = 1 << 18
LEVEL = 3


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank"),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; raises ValueError where the record isn't as WARC 1.1 and its own lengths say."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("a record doesn't begin with a WARC 1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"not a header field: {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"a record has no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"{fields['warc-record-id']}: the length is not as stated")
    return fields | {"block": rest[:-4]}


def page_of(fields: dict) -> dict:
    http, mark, payload = fields["block"].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http + b"\r\n")
    if not mark or not http.startswith(b"HTTP/") or not size:
        raise ValueError(f"{fields['warc-record-id']}: no HTTP header")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != int(size[1]) or digest_of(payload) != digest):
        raise ValueError(f"{fields['warc-record-id']}: the payload is not as stated")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError(f"{fields['warc-record-id']}: not a revisit record")
    ident = lambda x: None if x == "<urn:x-page:null>" else int(re.fullmatch(r"<urn:x-page:(-?\d+)>", x)[1])
    return {
        "page_id": ident(fields["warc-record-id"]), "payload_bytes": int(size[1]), "payload_digest": digest, "record_type": kind,
        "refers_to": ident(fields["warc-refers-to"]) if kind == "revisit" else None,
    }


def write_archive(out, records: Iterator[bytes]) -> int:
    """Write the records to the stream ``out``; returns their number."""
    first, size = [], 0
    for x in records:
        first.append(x)
        size += min(len(x), SAMPLE_EACH)
        if size >= SAMPLE_BYTES:
            break
    how = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [x[:SAMPLE_EACH] for x in first], k=256, d=8)
        data = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
        how["dict_data"] = trained
    except zstandard.ZstdError:  # too few or too short records to learn from
        pass
    press, n = zstandard.ZstdCompressor(**how), 0
    for some in (first, records):
        for x in some:
            out.write(press.compress(x))
            n += 1
    return n


def read_archive(stream) -> Iterator[bytes]:
    """The records, a frame at a time."""
    held = stream.read(8)
    how = {}
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
        n = struct.unpack("<I", held[4:])[0]
        data = stream.read(n)
        if len(data) != n:
            raise ValueError("the archive ends within its dictionary")
        if data.startswith(FRAME_MAGIC):
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 26)
        how["dict_data"], held = zstandard.ZstdCompressionDict(data), b""
    press = zstandard.ZstdDecompressor(**how)
    while True:
        held = held or stream.read(READ_BYTES)
        if not held:
            return
        frame, parts = press.decompressobj(), []
        while not frame.eof:
            if not held and not (held := stream.read(READ_BYTES)):
                raise ValueError("the archive ends within a frame")
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise ValueError(f"not a Zstandard frame: {e}") from e
            held = frame.unused_data
        yield b"".join(parts)


def with_duplicates(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html (never null), first_id: the smallest page id with this payload, if others have it too."""
    html = F.coalesce("html", F.lit("")).alias("html")
    wide = pages.select("page_id", "url", html).withColumns({"sha_": F.sha1(F.col("html").cast("binary")), "size_": F.octet_length("html")})
    first = wide.where(F.col("size_") >= min_bytes).groupBy("sha_", "size_").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    return wide.join(first.where("copies > 1").drop("copies"), ["sha_", "size_"], "left").select("page_id", "url", "html", "first_id")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> list[tuple[int, int]]:
    """One archive ``part-00000.warc.zst`` from each partition that has rows; (part, records) of each.

    ``pages``: page_id, url, html. A null html is an empty payload, a null url
    about:blank. Of payloads of at least ``min_bytes`` that are equal, the
    record with the smallest page_id is the response (all rows with it, if
    page ids repeat) and the others are revisits; null page ids are never the
    smallest, and if all are null, all are responses.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def records() -> Iterator[bytes]:
            for batch in rows:
                for at in range(0, batch.num_rows, 256):
                    for page_id, url, html, first in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns)):
                        yield record(page_id, url, html.encode(), first, first is not None and first != page_id, date)

        source = records()
        one = next(source, None)
        if one is None:
            return

        def all_of() -> Iterator[bytes]:
            yield one
            yield from source

        with writing(f"{folder}/part-{part:05d}.warc.zst") as out:
            n = write_archive(out, all_of())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64())], ["part", "n"])

    got = with_duplicates(pages, min_bytes).mapInArrow(run, "part long, n long").collect()
    return sorted((r["part"], r["n"]) for r in got)


def read_archives(spark: SparkSession, folder: str, parts: list[tuple[int, int]]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record."""
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (x for batch in rows for x in batch.column(0).to_pylist()):
            part, want = parts[i]
            out, n = [], 0
            with reading(f"{folder}/part-{part:05d}.warc.zst") as stream:
                for data in read_archive(stream):
                    out.append(page_of(parse(data)))
                    n += 1
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_pylist(out, kinds)
                        out = []
            if n != want:
                raise ValueError(f"archive {part} has {n} records, not {want}")
            yield pa.RecordBatch.from_pylist(out, kinds)

    return parallel_range(spark, len(parts)).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    return read_archives(spark, folder, write_archives(table(spark, sf_dir, "pages"), folder))


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
