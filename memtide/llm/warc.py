"""WARC archives compressed with a dictionary of their own, written and read back.

An archive starts with a skippable Zstandard frame that holds a dictionary
built from the records that follow; every record is a frame of its own, so one
record can be read without the others.  Equal payloads of at least
``MIN_REVISIT`` bytes are written once; the others become revisit records.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 100
#: Payload bytes gathered for one archive, the size of its dictionary, and what it is trained on: evenly spaced records of
#: the archive up to so many bytes, of each so many bytes at most.  Records themselves are always written whole.
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES, SAMPLE_RECORD = 12 << 20, 32 << 10, 4 << 20, 128 << 10
LEVEL = 3
#: Archives that a reading task takes.
READ_ARCHIVES = 16


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}')}>"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page, url, payload: bytes, digest: str, refers, date: str) -> bytes:
    """The bytes of one response or (``refers`` given) revisit record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, digest)),
        ("WARC-Date", date),
        *([("WARC-Target-URI", _clean(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers, digest)), ("X-Refers-To-Page", str(refers))] if refers is not None else []),
        *([("X-Page", str(page))] if page is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in head), b"", block]) + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on a bounded sample of the records; of too few, their raw bytes."""
    weight = sum(min(len(r), SAMPLE_RECORD) for r in records)
    sample = [r[:SAMPLE_RECORD] for r in records[:: -(-weight // SAMPLE_BYTES) or 1]]
    size = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(256, size // 8)), sample, k=256, d=8, f=20)
    except zstandard.ZstdError:
        raw = b"".join(sample)[-DICT_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


def encode_archive(records: list[bytes]) -> bytes:
    d = build_dictionary(records)
    out = io.BytesIO()
    if d is not None:
        raw = d.as_bytes()
        out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)))
        out.write(raw)
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d) if d is not None else zstandard.ZstdCompressor(level=LEVEL)
    for r in records:
        out.write(c.compress(r))
    return out.getvalue()


def decode_archive(stream):
    """(headers, block) of every record of an archive opened as a binary file object."""
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, size = struct.unpack("<II", head)
    if magic == SKIPPABLE_MAGIC:
        raw = stream.read(size)
        kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    else:
        stream.seek(0)
        d = zstandard.ZstdDecompressor()
    with d.stream_reader(stream, read_across_frames=True) as frames:
        f = io.BufferedReader(frames, 1 << 16)
        while line := f.readline():
            if line.rstrip() != VERSION:
                raise ValueError("not a WARC record")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(": ")
                headers[k] = v
            block = f.read(int(headers["Content-Length"]))
            f.read(4)
            yield headers, block


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, key: str = "page_id", url: str | None = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row to archives in the shared folder; return their list (path, records, bytes).

    A null payload is empty, a very long one is one record of its archive, a null id or URL leaves its header out.  Of rows with equal payloads of
    at least MIN_REVISIT bytes the smallest id is the response; rows that repeat that id as well are responses too.
    The list names only files of tasks that ended well, so files of lost executors' attempts are never read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).alias("k"), (F.col(url) if url else F.lit(None).cast("string")).alias("u"), F.coalesce(F.col(payload), F.lit("")).alias("p")).withColumn("digest", F.sha2(F.col("p"), 256))
    keys = base.stash(rows.where(F.octet_length("p") >= MIN_REVISIT).select("k", "digest"), "digests")
    firsts = base.stash(keys.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    # ids, not bodies, meet the hot digests, from written tables, so a hot one's rows can be split; a body is joined by its own id
    revisit = keys.join(firsts, "digest").where(~F.col("k").eqNullSafe(F.col("first")) & F.col("first").isNotNull()).select(F.col("k").alias("rk"), F.col("digest").alias("rd"), "first").distinct()
    joined = rows.join(revisit, rows["k"].eqNullSafe(revisit["rk"]) & (rows["digest"] == revisit["rd"]), "left").select("k", "u", "p", "digest", "first")
    folder = base.fresh_path(spark, "warc")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        held, size, part = [], 0, 0

        def flush():
            nonlocal held, size, part
            data = encode_archive(held)
            name = f"part-{task.partitionId():05d}-{part:04d}-{task.taskAttemptId()}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}.tmp") as f:
                f.write(data)
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "records", "bytes"])
            held, size, part = [], 0, part + 1
            return row

        for b in base.chunks(batches, "p"):
            for k, u, p, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(k, u, p.encode("utf-8", "surrogatepass"), digest, first, date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return base.stash(joined.mapInArrow(write, "path string, records long, bytes long"), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page, payload_bytes, payload_digest, record_type, refers_to, and the header's stated digest.

    Digest and size of a response are computed from the bytes read; a revisit states those of its payload.
    """

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = _open(path)
                rows = []
                with fs.open_input_file(name) as f:
                    for h, block in decode_archive(f):
                        cut = block.index(b"\r\n\r\n") + 4
                        revisit = h["WARC-Type"] == "revisit"
                        body = memoryview(block)[cut:]
                        stated = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        size = int(block[:cut].rpartition(b"Content-Length: ")[2].strip()) if revisit else len(body)
                        rows.append((h.get("X-Page"), size, stated if revisit else hashlib.sha256(body).hexdigest(), h["WARC-Type"], h.get("X-Refers-To-Page"), stated))
                yield pa.RecordBatch.from_pylist([dict(zip(_COLS, r, strict=True)) for r in rows], schema=_SCHEMA)

    n = archives.count()
    n = max(1, min(n, max(base.partitions_for(archives), n // READ_ARCHIVES)))
    return archives.select("path").repartition(n).mapInArrow(read, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, stated_digest string")


def broken_revisits(records: DataFrame) -> DataFrame:
    """Of what was read the revisits whose response, by page and digest and size, is not there."""
    there = records.where("record_type = 'response'").select(F.col("page").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    return records.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest", "payload_bytes"], "left_anti")


_COLS = ("page", "payload_bytes", "payload_digest", "record_type", "refers_to", "stated_digest")
_SCHEMA = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.string()) for c in _COLS])

SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
