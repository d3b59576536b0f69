"""WARC archives: one gzip member per record, written in parallel and read back sequentially.

An archive is a table of numbered byte chunks, so that writing and reading need
nothing but Spark's own readers and writers, on any store. A task writes as many
archives of bounded size as its pages need. A reader gets an archive's chunks in
order and holds one record at a time: it feeds zlib as bytes come, starts anew at
each member's end, frames records by their content length and verifies their
digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.store import bounded_batches, save, small

#: Bytes in one chunk of an archive; records run over chunk ends.
CHUNK = 1 << 20
#: Bytes of an archive after which the next record begins another.
ARCHIVE = 64 << 20
#: Bytes that zlib is fed with at once; no more is copied when a member ends.
FED = 1 << 14
#: Duplicate payloads whose digests may be broadcast, and rows of a payload that make its digest be broadcast whatever their number.
BROADCAST_DIGESTS, HOT_ROWS = 1 << 18, 100_000
_DATE = "2000-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit has the payload's digest and length but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a byte stream, each decompressed as its bytes come; a stream cut short is an error."""
    unpack, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        view, at = memoryview(chunk), 0
        while at < len(view):
            begun = True
            fed = view[at : at + FED]
            at += len(fed)
            while len(fed):
                parts.append(unpack.decompress(fed, CHUNK))
                fed = unpack.unconsumed_tail
            if unpack.eof:
                at -= len(unpack.unused_data)
                yield b"".join(parts)
                unpack, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a member")


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP headers, payload) of a record, framed by its content length and verified by its digests."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("content length and record differ")
    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError("payload digest differs")
    return headers, http, payload


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(archive, chunk, data): archives of some ``ARCHIVE`` bytes, saved in the shared folder.

    Of records with equal payloads of at least ``least_bytes``, those with the
    largest page id are responses and the others revisit them. A null html is an
    empty payload; a null page id is smaller than all others; rows that repeat the
    largest id are all responses. No rows give no archive; other columns take no
    part. A payload is compressed and written in one piece, so a very long one has to
    fit in a task several times.
    """
    bounded_batches(pages.sparkSession)
    base = pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"), F.encode(F.coalesce(html, F.lit("")), "utf-8").alias("b"))
    digest = F.unhex(F.sha1("b"))
    known = base.select("p", digest.alias("d"), F.octet_length("b").alias("l")).where(F.col("l") >= least_bytes)
    twice = known.groupBy("d").agg(F.max("p").alias("m"), F.count("*").alias("n")).where("n > 1 and m is not null")
    twice = save(twice, "digests")
    rows = base.withColumn("d", digest)
    if small(twice, BROADCAST_DIGESTS):
        rows = rows.join(F.broadcast(twice), "d", "left")
    else:  # many payloads repeat: those of many rows are still broadcast (their number is bounded), so no task gets all rows of one
        hot = twice.where(F.col("n") >= HOT_ROWS).select("d", F.col("m").alias("hot"))
        rows = rows.join(F.broadcast(hot), "d", "left")
        light = twice.where(F.col("n") < HOT_ROWS).select("d", "m")
        rows = rows.where("hot is null").join(light, "d", "left").drop("hot").unionByName(rows.where("hot is not null").withColumnRenamed("hot", "m"))
    rows = rows.select("p", "u", "b", "m")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, number, written, held, size = TaskContext.get().partitionId() << 32, 0, 0, [], 0

        def flush(whole: bytes):
            nonlocal number
            batch = pa.record_batch([pa.array([archive], pa.int64()), pa.array([number], pa.int64()), pa.array([whole], pa.binary())], ["archive", "chunk", "data"])
            number += 1
            return batch

        for batch in batches:
            for p, u, b, m in zip(*(batch.column(i) for i in range(4))):
                p, m = p.as_py(), m.as_py()
                one = record(p, u.as_py(), b.as_py(), m, m is not None and p != m)
                held.append(one)
                size += len(one)
                written += len(one)
                if size >= CHUNK or written >= ARCHIVE:
                    whole, at = b"".join(held), 0
                    while at + CHUNK <= len(whole):
                        yield flush(whole[at : at + CHUNK])
                        at += CHUNK
                    held = [whole[at:]]
                    size = len(held[0])
                if written >= ARCHIVE:
                    if size:
                        yield flush(held[0])
                    archive, number, written, held, size = archive + 1, 0, 0, [], 0
        if size:
            yield flush(b"".join(held))

    return save(rows.mapInArrow(write, "archive long, chunk long, data binary"), "warc")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of all records.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, also
    where a revisit leaves it out (its ``payload`` is then null). ``url`` is as it
    stands in the record: percent-encoded, and empty for a null one. A missing chunk, a
    member cut short, a wrong length or a wrong digest is an error.
    """
    bounded_batches(archives.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ((a, c, d) for batch in batches for a, c, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
        out: list[list] = [[] for _ in range(7)]
        size = 0
        held = next(chunks, None)
        while held:
            archive = held[0]

            def own():
                nonlocal held
                number = 0
                while held and held[0] == archive:
                    if held[1] != number:
                        raise ValueError(f"chunk {number} of archive {archive} is missing")
                    yield held[2].as_py()
                    number += 1
                    held = next(chunks, None)

            for member in members(own()):
                headers, http, payload = parse(member)
                revisit = headers["WARC-Type"] == "revisit"
                page = headers["WARC-Record-ID"][10:-1]
                length = int(http.decode().rsplit("Content-Length: ", 1)[1])
                row = (int(page) if page else None, headers["WARC-Target-URI"], headers["WARC-Type"], int(headers["WARC-Refers-To"][10:-1]) if revisit else None, length, headers["WARC-Payload-Digest"][5:], None if revisit else payload)
                for column, value in zip(out, row):
                    column.append(value)
                size += len(payload)
                if size > CHUNK or len(out[0]) >= 1000:
                    yield table(out)
                    size = 0
        yield table(out)

    def table(out):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        batch = pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names)
        for c in out:
            c.clear()
        return batch

    rows = archives.select("archive", "chunk", "data").repartition("archive").sortWithinPartitions("archive", "chunk")
    return rows.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")
