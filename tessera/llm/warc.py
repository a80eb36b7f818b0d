"""From legacy ARC archives to WARC.

An ARC file begins with a version block whose second line gives the version and whose third names the fields of every
header line: version 1 has five, version 2 ten.  Each record is a header line, whose last field declares the length, and
that many bytes.  The converter reads them one after the other and writes for each an equivalent WARC record: an id made
from address, date and digest, the 14-digit date as a WARC date, a type from the content (HTTP message: response, or
revisit of a payload seen before; other content: resource), and SHA-256 digests of block and payload.  Each record is a
gzip member of its own.

Defined results: a null html is an empty payload; payloads below `least` bytes are never revisits; rows that share
page_id and payload are all responses if that page_id is the smallest of its payload; a row without page_id is a revisit
if its payload has a row with one; an empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns_for, fresh_path, materialise, maybe_broadcast

# The fields of header lines by version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Bytes from which a task begins another archive.
FILE_BYTES = 256 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes

    @property
    def payload_at(self) -> int:
        """Where the payload begins in the block: after the head of an HTTP message, else at once."""
        if not self.block.startswith(b"HTTP/"):
            return 0
        at = self.block.find(b"\r\n\r\n")
        return at + 4 if at >= 0 else len(self.block)


def arc_header(version: int, values: dict[str, str]) -> bytes:
    return " ".join(values[k] for k in ARC_FIELDS[version]).encode() + b"\n"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 tessera\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_header(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}) + body


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    url = url.replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") or "-"
    return b"\n" + arc_header(version, {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}) + block


def read_arc(stream: io.BufferedIOBase) -> Iterator[ArcRecord]:
    """The records after the version block.  A header line is split from the right, as an address may hold spaces."""
    version = None
    while line := stream.readline():
        if not line.strip():
            continue
        if version is None:
            length = int(line.split()[-1])
            block = stream.read(length)
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
            continue
        names = ARC_FIELDS[version]
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"ARC header of {len(values)} fields in version {version}")
        block = stream.read(int(values[-1]))
        if len(block) != int(values[-1]):
            raise ValueError("ARC record ends early")
        yield ArcRecord(dict(zip(names, values, strict=True)), block)


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    http: dict[str, str] = field(default_factory=dict)


def warc_date(fourteen: str) -> str:
    d = (fourteen + "00000101000000"[len(fourteen) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {page}')}>"


def _http_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def to_warc(record: ArcRecord, first_page: str | None = None) -> WarcRecord:
    """The equivalent WARC record.  first_page: the page whose response has this payload, if this is a revisit."""
    at = record.payload_at
    payload, url, date = record.block[at:], record.fields["URL"], record.fields["Archive-date"]
    digest = hashlib.sha256(payload).hexdigest()
    http = _http_headers(record.block[:at]) if at else {}
    kind = "resource" if not at else "response" if first_page is None else "revisit"
    block = record.block[:at] if kind == "revisit" else record.block
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(url, date, digest, http.get("x-page-id", "")),
        "WARC-Date": warc_date(date),
        "WARC-Target-URI": url,
        "WARC-IP-Address": record.fields["IP-address"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response" if at else record.fields["Content-type"],
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To-Page": first_page}
    return WarcRecord(headers, block, http)


def warc_bytes(record: WarcRecord, level: int = 4) -> bytes:
    """A gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + record.block + b"\r\n\r\n") + packer.flush()


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    held, opened, parts = b"", zlib.decompressobj(31), []
    while True:
        if not held and not (held := stream.read(size)):
            if parts:
                raise ValueError("archive ends early")
            return
        parts.append(opened.decompress(held))
        held = b""
        if opened.eof:
            held = opened.unused_data
            yield b"".join(parts)
            opened, parts = zlib.decompressobj(31), []


def read_warc(stream) -> Iterator[WarcRecord]:
    for raw in _members(stream):
        at = raw.index(b"\r\n\r\n") + 4
        lines = raw[:at].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = {k: v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}
        block = raw[at : at + int(headers["Content-Length"])]
        if hashlib.sha256(block).hexdigest() != headers["WARC-Block-Digest"].removeprefix("sha256:"):
            raise ValueError("block digest differs")
        end = block.find(b"\r\n\r\n")
        yield WarcRecord(headers, block, _http_headers(block[:end]) if end >= 0 and block.startswith(b"HTTP/") else {})


def _http_message(page: str, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def write(pages: DataFrame, least: int = 100, date: str = "20240101000000", place: str | None = None) -> DataFrame:
    """Writes pages as ARC records, odd partitions as version 1 and even ones as version 2, converts them, and writes
    the WARC files; a table (path, n_records) of these."""
    place = place or fresh_path(pages.sparkSession, "warc")
    rows = columns_for(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # the payloads of several pages only, as digests: broadcast if that is small, so that no page is moved
    rows = rows.join(maybe_broadcast(materialise(firsts, "payloads")), "digest", "left")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        version = 1 + (TaskContext.get().partitionId() + 1) % 2
        n, held, out, path, local, system = 0, 0, None, "", "", None

        def done() -> pa.RecordBatch:
            out.close()
            system.move(f"{local}.tmp", local)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                if out is not None and held > FILE_BYTES:
                    yield done()
                    n, held, out = 0, 0, None
                if out is None and part:
                    path = f"{place}/{uuid.uuid4().hex}.warc.gz"
                    system, local = pafs.FileSystem.from_uri(path)
                    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(f"{local}.tmp", compression=None)
                arc = io.BytesIO()
                arc.write(arc_version_block(version, "pages.arc", date))
                for r in part:
                    page = "" if r["page_id"] is None else str(r["page_id"])
                    arc.write(arc_record(version, r["url"] or "", date, "text/html", _http_message(page, r["html"].encode()), arc.tell()))
                arc.seek(0)
                for r, record in zip(part, read_arc(arc), strict=True):
                    again = r["first"] is not None and r["first"] != r["page_id"]
                    data = warc_bytes(to_warc(record, str(r["first"]) if again else None))
                    out.write(data)
                    held += len(data)
                    n += 1
        if out is not None:
            yield done()

    return materialise(rows.mapInArrow(written, "path string, n_records long"), "warc-files")


def read(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, local = pafs.FileSystem.from_uri(path)
                found: list[tuple] = []
                with system.open_input_stream(local, compression=None) as stream:
                    for r in read_warc(stream):
                        page, first = r.http.get("x-page-id"), r.headers.get("WARC-Refers-To-Page")
                        found.append((int(page) if page else None, int(r.http["content-length"]), r.headers["WARC-Payload-Digest"].removeprefix("sha256:"), r.headers["WARC-Type"], int(first) if first else None))
                        if len(found) == 2000:
                            yield made(found)
                            found = []
                if found:
                    yield made(found)

    spread = files.repartition(max(1, min(files.count(), 4096)))  # a task for each file, which no setting folds into one
    return spread.mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def write_and_read(pages: DataFrame, least: int = 100) -> DataFrame:
    return read(write(pages, least))
