"""WARC archives: writing with revisit records, and a splittable reader.

Writing. Each record is a gzip member of its own. Spark's text writer puts the
members into files, with an empty gzip member as its line separator, so the
archives go to any file system that Spark writes to, under its commit protocol,
and each file is a valid multi-member gzip file.

Reading. Files are cut into byte ranges. A task scans its range for the gzip
magic, takes an offset for the start of a member only if the bytes there
decode to a WARC header, and owns the records that start inside its range; the
last of them is read beyond the end of the range.

Of records with equal payloads, that of the largest page_id is written as
``response`` and the others as ``revisit``, which hold the HTTP header with the
payload's length, its digest and the response's id, but no payload.

Defined results: a null html is an empty payload; a null url is written as an
empty target; payloads shorter than ``revisit_from`` bytes are always responses;
repeated rows of the same page_id and payload are written alike, each time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arboris.llm.common import shared_dir, small_batches

MAGIC = b"\x1f\x8b\x08"
#: A gzip member without content; stands between two records.
_EMPTY = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
_DATE = "2000-01-01T00:00:00Z"
_CHUNK = 1 << 20


def _member(record: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(record: str) -> int | None:
    value = record.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "null" else int(value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a revisit if it refers to another page, else a response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join((url or "").split())
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record, with the payload itself for a response."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    kind = fields["warc-type"]
    return {
        "page_id": _page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
        "payload_bytes": len(payload) if kind == "response" else int(lengths[0]),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else fields["warc-payload-digest"].removeprefix("sha1:"),
        "refers_to": _page_of(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, path: str, revisit_from: int = 0, level: int = 6) -> None:
    """Write ``pages`` (page_id, url, html) as archives in the folder ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    firsts = rows.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("sha1", "first")  # a payload that stands alone needs no partner
    rows = rows.join(firsts, "sha1", "left")
    again = (F.octet_length("payload") >= revisit_from) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "payload", "sha1", F.when(again, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, payload, sha1, refers_to in zip(*(b.column(i) for i in range(5))):
                digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                out.append(_member(build_record(page_id.as_py(), url.as_py(), payload.as_py(), digest, refers_to.as_py()), level))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    members = small_batches(rows).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY.decode("latin-1")).text(path)


class _Window:
    """Bytes of a file from an offset on, read a chunk at a time as they are asked for."""

    def __init__(self, stream, size: int, start: int):
        self.stream, self.size, self.start, self.data = stream, size, start, bytearray()

    @property
    def end(self) -> int:
        return self.start + len(self.data)

    def more(self) -> bool:
        """Read another chunk; False at the end of the file."""
        n = min(_CHUNK, self.size - self.end)
        if n <= 0:
            return False
        self.stream.seek(self.end)
        self.data += self.stream.read(n)
        return True

    def drop(self, upto: int) -> None:
        del self.data[: upto - self.start]
        self.start = upto


def _decoded(w: _Window, at: int) -> tuple[bytes, int] | None:
    """Content of the member at ``at`` and the offset behind it; None if it isn't one."""
    inflate, out, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            if pos >= w.end and not w.more():
                return None
            piece = w.data[pos - w.start :][:65536] if not out else w.data[pos - w.start :]
            out.append(inflate.decompress(piece))
            pos += len(piece)
            if len(out) == 1 and out[0] and not (out[0].startswith(b"WARC/") or b"WARC/".startswith(out[0][:5])):
                return None
    except zlib.error:
        return None
    return b"".join(out), pos - len(inflate.unused_data)


def records_in(stream, size: int, start: int, end: int) -> Iterator[bytes]:
    """Records of a file that start in [start, end)."""
    w = _Window(stream, size, start)
    pos = start
    while pos < end:
        at = w.data.find(MAGIC, pos - w.start)
        if at < 0:
            pos = max(pos, w.end - len(MAGIC) + 1)
            w.drop(min(pos, w.end))
            if not w.more():
                return
            continue
        at += w.start
        if at >= end:
            return
        w.drop(at)
        got = _decoded(w, at)
        if got is None:
            pos = at + 1
            continue
        content, pos = got
        w.drop(min(pos, w.end))
        if content.startswith(b"WARC/"):
            yield content


def _open(path: str):
    """A file as a byte stream that can seek, through the file system that its URI names."""
    if "://" not in path and path.startswith("file:"):
        path = "file://" + path.removeprefix("file:")
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def read(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Records of the archives in ``path``: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the contents are not read here
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.where("length > 0").select("path", "length", starts.alias("start"))
    n = ranges.count()
    ranges = ranges.repartition(max(1, n), "path", "start")
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

        for b in batches:
            for file, length, start in zip(*(b.column(i).to_pylist() for i in range(3))):
                rows, held = [], 0
                with _open(file) as stream:
                    for raw in records_in(stream, length, start, min(length, start + split_bytes)):
                        rows.append(parse_record(raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return small_batches(ranges).mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, revisit_from: int = 0, split_bytes: int = 32 << 20) -> DataFrame:
    """Write the pages into the shared folder, then read the records back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, revisit_from)
    return read(spark, path, split_bytes)
