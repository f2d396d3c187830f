"""WARC archives of pages, compressed record by record with a dictionary that each archive carries.

An archive begins with a skippable Zstandard frame that holds its dictionary, built from its own first
records. Every record is then a frame of its own, so that one record can be read without the others.
Archives are written to a folder that executors and driver share, under a temporary name until complete;
a task that runs again writes the same archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainsight.llm.common import join_hot, save
from plainsight.session import scratch_path

#: Fixed values of the format: magic number of the leading frame, and the profile of a revisit.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records before an archive is closed, and of those from which its dictionary is built.
ARCHIVE = 64 << 20
SAMPLE = 1 << 20
DICTIONARY = 32 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _uri(url: str | None, page_id) -> str:
    """White space and control characters cannot stand in a header."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One record; a revisit (``refers_to`` given) has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {_uri(url, page_id)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}",
                 f"WARC-X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY]


def archive_bytes(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive. Records until ``SAMPLE`` are held to build the dictionary."""
    held, total = [], 0
    for r in records:
        held.append(r)
        total += len(r)
        if total >= SAMPLE:
            break
    data = dictionary(held)
    yield struct.pack("<II", MAGIC, len(data)) + data
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    for r in held:
        yield packer.compress(r)
    for r in records:
        yield packer.compress(r)


def read_archive(stream, step: int = 1 << 18) -> Iterator[tuple[dict, bytes]]:
    """(headers, payload) of every record; the archive streams through."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    data = stream.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    frame, parts, rest = reader.decompressobj(), [], b""
    while True:
        chunk = rest or stream.read(step)
        if not chunk:
            break
        parts.append(frame.decompress(chunk))
        rest = b""
        if frame.eof:
            rest = frame.unused_data
            yield _parse(b"".join(parts))
            frame, parts = reader.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def _parse(raw: bytes) -> tuple[dict, bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers |= {f"http:{k}": v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return headers, payload


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; returns (archive, records, bytes).

    Payload is the whole html in UTF-8 (null: empty). Of equal payloads the one with the smallest page_id is
    stored, the others are revisits of it; rows that repeat its id are stored as well; a null id comes last,
    and payloads with null ids only are all stored. A null url is replaced by the page's number. An empty
    table gives no archive. ``folder`` is a path or address that pyarrow can write from every executor."""
    payload = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("digest"))
    least = save(marked.groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")), "digests")
    joined = join_hot(marked, least, ["digest"], pages.count(), "n").select("page_id", "url", "html", "digest", "least")

    def write(batches):
        task = TaskContext.get()
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)

        def rows():
            for batch in batches:
                for part in range(0, batch.num_rows, 200):
                    for r in batch.slice(part, 200).to_pylist():
                        data = r["html"].encode()
                        digest = base64.b32encode(bytes.fromhex(r["digest"])).decode()
                        own = r["least"] is None or r["page_id"] == r["least"]
                        yield record(r["page_id"], r["url"], data, len(data), digest, None if own else r["least"])

        source, number = rows(), 0
        ahead = next(source, None)
        while ahead is not None:
            taken = [0, 0]

            def one_archive():
                nonlocal ahead
                while ahead is not None and taken[1] < ARCHIVE:
                    taken[0] += 1
                    taken[1] += len(ahead)
                    now = ahead
                    ahead = next(source, None)
                    yield now

            name = f"part-{task.partitionId():05d}-{number:05d}.warc.zst"
            temporary = f"{base}/_{name}.{task.attemptNumber()}"
            with files.open_output_stream(temporary, compression=None) as out:
                for piece in archive_bytes(one_archive()):
                    out.write(piece)
            files.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"archive": [name], "records": [taken[0]], "bytes": [taken[1]]})
            number += 1

    return save(joined.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A revisit has no payload of its own (null). The digest of each stored payload is computed anew; one that
    differs from the header is an error."""

    def read(batches):
        files, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for h, payload in read_archive(stream):
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        stored = h["WARC-Type"] == "response"
                        if stored and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page, refers = h.get("WARC-X-Page-ID"), h.get("WARC-X-Refers-To-Page")
                        rows.append((page and int(page), h["WARC-Target-URI"], int(h["http:Content-Length"]), digest,
                                     h["WARC-Type"], refers and int(refers), payload if stored else None))
                        if len(rows) == 200:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    wide = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(wide).mapInArrow(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, payload binary")


def _batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


#: What the archives hold, over the view ``pages``. The base32 text is made from the digest's bits.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
least AS (SELECT hex, min(page_id) AS least FROM p GROUP BY hex),
text32 AS (
  SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER), 1),
           '' ORDER BY i) AS digest
  FROM least, range(0, 32) AS r(i) GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN least IS NULL OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least IS NULL OR page_id = least THEN NULL ELSE least END AS refers_to
FROM p JOIN least USING (hex) JOIN text32 USING (hex)"""
