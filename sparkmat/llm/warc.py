"""WARC archives of web pages, and their records as a chunked table.

``write_archives`` writes one gzip archive (a member per record) per task to a folder that all machines
share, and returns a manifest of the files that committed tasks wrote; a retried task writes another file.
Of the records with equal payloads of ``LEAST_REVISIT`` bytes or more, the one with the smallest page_id
is a response and the others are revisits, which carry the HTTP head but no payload. Which digests repeat is
found on (page_id, digest) alone; payloads stay where they are read as long as those digests are few enough
to broadcast (their number is checked), else they are dealt by digest and ``SALTS`` so no digest fills a task.

``read_archives`` streams archives: payloads come as rows of record identifier and chunk number, of
``chunk_bytes`` at most, each with the running byte count and SHA-256 so far; the last row of a record has
the digest of the whole payload. No payload is held whole while reading.

A null html is an empty payload; a null url is left out of the record; rows that repeat a page_id are each
written, as the same kind of record. Pages without a page_id are written too: as revisits where a page with an
id has their payload, else as responses; they read back with a null page_id. Extra columns are ignored, whatever
their names. A record's head may be of any length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmat.llm._spark import new_path, stage

LEAST_REVISIT, CHUNK_BYTES, READ_BYTES = 100, 1 << 20, 1 << 16
#: Repeated digests that are broadcast at most (about 100 bytes each), and ways each is dealt beyond that.
BROADCAST_DIGESTS, SALTS = 200_000, 32
CHUNKS = "page_id long, chunk_number long, chunk_bytes long, payload_bytes long, payload_digest string, is_last boolean, record_type string, refers_to long, content binary"


def record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= LEAST_REVISIT
    groups = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = stage(groups.where("n > 1 and first_id is not null").select(F.col("payload_digest").alias("_digest"), "first_id"), "digests")
    same = F.when(large, F.col("payload_digest")) == F.col("_digest")
    if firsts.count() <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(firsts), same, "left")
    else:
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        joined = dealt.join(firsts.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), same & (F.col("_salt") == F.col("_of")), "left")
    other = F.col("page_id").isNull() | (F.col("first_id") < F.col("page_id"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(other, F.col("first_id")).alias("refers_to"))


def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def write_record(out, page_id: int | None, url: str | None, payload, digest: str, refers_to: int | None, date: str) -> int:
    """Write one record as a gzip member; the payload goes through the compressor in slices."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    body = len(payload) if refers_to is None else 0
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        lines += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + body))]
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    n = out.write(gz.compress(_head(lines, "WARC/1.1") + http))
    for i in range(0, body, READ_BYTES):
        n += out.write(gz.compress(payload[i : i + READ_BYTES]))
    return n + out.write(gz.compress(b"\r\n\r\n") + gz.flush())


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """The manifest (file, n_records, n_bytes) of the archives written under ``folder`` (default: the shared folder)."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")

    def run(batches):
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, records, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0, 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                payloads = batch.column("payload")
                for i, (page, url, digest, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "refers_to")))):
                    size += write_record(out, page, url, memoryview(payloads[i].as_buffer()), digest, refers, date)
                    records += 1
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([size])], ["file", "n_records", "n_bytes"])

    return stage(record_types(pages).mapInArrow(run, "file string, n_records long, n_bytes long"), "manifest")


class _Member:
    """Reads one gzip member after another from a stream, a bounded buffer at a time."""

    def __init__(self, source):
        self.source, self.raw, self.gz, self.plain = source, b"", None, b""

    def next_record(self) -> bool:
        while self.gz is not None and not self.gz.eof:
            self.plain = b""
            self._fill()
        self.raw = self.gz.unused_data if self.gz is not None else self.raw
        self.raw = self.raw or self.source.read(READ_BYTES)
        self.gz, self.plain = zlib.decompressobj(31), b""
        return bool(self.raw)

    def _fill(self) -> bool:
        if self.gz.eof:
            return False
        data = self.gz.unconsumed_tail or self.raw or self.source.read(READ_BYTES)
        self.raw = b""
        if not data:
            raise EOFError("an archive ends inside a record")
        self.plain += self.gz.decompress(data, READ_BYTES)
        return True

    def until(self, mark: bytes) -> bytes:
        parts = []
        while (at := self.plain.find(mark)) < 0:
            keep = max(len(self.plain) - len(mark) + 1, 0)  # the mark may begin at the end of what is here
            parts.append(self.plain[:keep])
            self.plain = self.plain[keep:]
            if not self._fill():
                raise ValueError("a record's head does not end")
        parts.append(self.plain[:at])
        self.plain = self.plain[at + len(mark) :]
        return b"".join(parts)

    def some(self, most: int) -> bytes:
        while not self.plain:
            if not self._fill():
                raise EOFError("a record is shorter than its Content-Length")
        out, self.plain = self.plain[:most], self.plain[most:]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").removesuffix(">")) if urn and urn.startswith("<urn:page:") else None


def record_chunks(source, chunk_bytes: int = CHUNK_BYTES, content: bool = True):
    """Rows of ``CHUNKS`` of an archive stream, in order."""
    reader = _Member(source)
    while reader.next_record():
        warc = _fields(reader.until(b"\r\n\r\n"))
        if warc.get("warc-type") not in ("response", "revisit"):
            continue
        left = int(warc["content-length"])
        head = reader.until(b"\r\n\r\n")
        left -= len(head) + 4
        page, kind, refers, said = _page(warc["warc-record-id"]), warc["warc-type"], _page(warc.get("warc-refers-to")), warc["warc-payload-digest"].removeprefix("sha256:")
        if kind == "revisit":
            yield page, 0, 0, int(_fields(head)["content-length"]), said, True, kind, refers, None
            continue
        digest, done, number = hashlib.sha256(), 0, 0
        while True:
            want, parts, size = min(chunk_bytes, left), [], 0
            while size < want:
                part = reader.some(want - size)
                digest.update(part)
                size += len(part)
                if content:
                    parts.append(part)
            left, done = left - size, done + size
            now = digest.hexdigest()
            if not left and now != said:
                raise ValueError(f"payload digest of page {page} differs")
            yield page, number, size, done, now, not left, kind, None, b"".join(parts) if content else None
            number += 1
            if not left:
                break


def read_archives(spark: SparkSession, files: DataFrame, chunk_bytes: int = CHUNK_BYTES, content: bool = True) -> DataFrame:
    """``CHUNKS`` of all records of the archives in column ``file``; one file is one task's work."""
    types = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as source:
                    rows, held = [], 0
                    for row in record_chunks(source, chunk_bytes, content):
                        rows.append(row)
                        held += row[2] if content else 0
                        if len(rows) >= 10_000 or held >= 8 * CHUNK_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    n = max(1, files.count())
    return files.select("file").repartition(min(n, 100_000)).mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, as read back from its archive."""
    read = read_archives(pages.sparkSession, write_archives(pages), content=False)
    return read.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
