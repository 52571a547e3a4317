"""WARC archives: a writer, a normaliser of monolithic gzip, a sidecar offset index, and a reader by index.

Archives are files below a URI that every executor can reach (pyarrow opens file:, hdfs:, s3: and gs:). A task writes to a
name of its own and renames it when complete, so a lost or repeated task leaves no half file under a final name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._work import Workspace

#: Payload bytes after which a writer begins another archive.
ARCHIVE_BYTES = 32 << 20
BROADCAST_ROWS = 200_000
CHUNK = 1 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit without the payload. Line ends in a url are dropped."""
    fields = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", "".join((url or "").split("\n")).replace("\r", "")), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is None:
        return record("response", [*fields, ("Content-Type", "text/html; charset=utf-8")], payload)
    return record("revisit", [*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")], b"")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


class _File:
    """An output file that takes its name when it is complete."""

    def __init__(self, uri: str, name: str):
        self.fs, base = open_fs(uri)
        self.fs.create_dir(base, recursive=True)
        self.final, self.temp = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return self.final.rpartition("/")[2]


def write_monolithic(pages: DataFrame, uri: str) -> DataFrame:
    """(name) of archives that hold a record for each row of pages (page_id, url, html, refers_to), each one gzip member as a whole."""

    def run(batches):
        out = packer = name = None
        size = 0
        for batch in batches:
            for page, url, html, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, packer, size = _File(uri, name), zlib.compressobj(1, wbits=31), 0
                payload = (html or "").encode()
                out.out.write(packer.compress(page_record(page, url, payload, to)))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    out.out.write(packer.flush())
                    yield pa.RecordBatch.from_arrays([pa.array([out.close()])], ["name"])
                    out = None
        if out is not None:
            out.out.write(packer.flush())
            yield pa.RecordBatch.from_arrays([pa.array([out.close()])], ["name"])

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "name string")


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or many members, piece by piece."""
    unzip = zlib.decompressobj(31)
    while piece := stream.read(CHUNK):
        while piece:
            yield unzip.decompress(piece)
            piece = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
    if tail := unzip.flush():
        yield tail


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC byte stream; memory holds one record and a piece."""
    buffer = bytearray()
    more = True
    while True:
        end = buffer.find(b"\r\n\r\n")
        if end >= 0:
            length = next(int(x.split(b":", 1)[1]) for x in bytes(buffer[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            whole = end + 4 + length + 4
            if len(buffer) >= whole:
                yield bytes(buffer[:whole])
                del buffer[:whole]
                continue
        if not more:
            if buffer.strip():
                raise ValueError("the archive ends within a record")
            return
        while more:  # gather a fair piece, so that the buffer is cut seldom
            piece = next(pieces, None)
            more = piece is not None
            buffer += piece or b""
            if len(buffer) >= 4 * CHUNK or end >= 0 and len(buffer) >= whole:
                break


def normalise_file(uri: str, name: str, to: str) -> tuple[str, int]:
    """Inflate one archive once, write every record as a member of its own, and an index of offset, length and id beside it."""
    fs, base = open_fs(uri)
    out, index, at, n = _File(to, name), _File(to, name + ".idx"), 0, 0
    with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
        for raw in records(inflate(stream)):
            packer = zlib.compressobj(1, wbits=31)
            member = packer.compress(raw) + packer.flush()
            out.out.write(member)
            index.out.write((json.dumps([at, len(member), parse(raw[: raw.find(b"\r\n\r\n") + 4])[0]["WARC-Record-ID"]]) + "\n").encode())
            at, n = at + len(member), n + 1
    index.close()
    return out.close(), n


def normalise(names: DataFrame, uri: str, to: str) -> DataFrame:
    """(name, n_records) of the normalised archives, one task's file at a time."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                got, n = normalise_file(uri, name, to)
                yield pa.RecordBatch.from_arrays([pa.array([got]), pa.array([n])], ["name", "n_records"])

    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.select("name").repartition(parts).mapInArrow(run, "name string, n_records long")


def index_rows(uri: str, name: str) -> list[list]:
    fs, base = open_fs(uri)
    with fs.open_input_stream(f"{base}/{name}.idx") as f:
        return [json.loads(x) for x in f.read().splitlines()]


def read_pages(names: DataFrame, uri: str) -> DataFrame:
    """Every record of normalised archives, each member read at its offset: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Raises if a payload doesn't match its digest or a record stands elsewhere than its index says.
    """
    own = lambda x: None if x == "None" else int(x)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, base = open_fs(uri)
                rows = []
                with fs.open_input_file(f"{base}/{name}") as f:
                    for at, length, rid in index_rows(uri, name):
                        f.seek(at)
                        head, payload = parse(zlib.decompress(f.read(length), 31))
                        if head["WARC-Record-ID"] != rid or head["WARC-Type"] == "response" and "sha1:" + digest(payload) != head["WARC-Payload-Digest"]:
                            raise ValueError(f"{name}: bad record {rid} at {at}")
                        to = head.get("WARC-Refers-To")
                        rows.append((own(rid[10:-1]), int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"], own(to[10:-1]) if to else None))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return names.select("name").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def mark_revisits(pages: DataFrame, ws: Workspace, min_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """pages with refers_to: of rows with equal payloads of min_bytes at least, the others name the smallest page_id.

    A null html is an empty payload. Rows that repeat the smallest page_id, and all where no copy has an id, are responses.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("d", F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256)))
    first = ws.table("first", keyed.where("d is not null").groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("d", "first"))
    if first.count() <= broadcast_rows:
        first = F.broadcast(first)
    return keyed.join(first, "d", "left").select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def archive(pages: DataFrame, min_bytes: int = 0) -> tuple[str, DataFrame]:
    """(uri, names) of normalised archives of pages in the session's shared folder."""
    ws = Workspace(pages.sparkSession, "warc")
    raw, done = f"{ws.path}/raw", f"{ws.path}/warc"
    names = ws.table("names", write_monolithic(mark_revisits(pages, ws, min_bytes), raw))
    ready = ws.table("ready", normalise(names, raw, done))
    ws.drop("raw", "names", "first")
    return done, ready


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, names = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_pages(names.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), uri)
