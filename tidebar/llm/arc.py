"""ARC archives, versions 1 and 2: written from a table, parsed by their declared lengths.

A file begins with a version block, whose first line names the file and whose second holds
the version; the third names the fields of all header lines. A record is a header line with
the length of the document behind it, and the document. Nothing in a document, header lines
of other records included, ends it before that length.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark import TaskContext

from tidebar.llm import streams

#: Second and third line of a version block (fixed values).
VERSIONS = {
    1: ("1 0 {origin}", "URL IP-address Archive-date Content-type Archive-length"),
    2: ("2 0 {origin}", "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
        "Archive-length"),
}

#: Header lines of each version. URLs and (version 1) media types may hold blanks.
HEADERS = {
    1: re.compile(rb"(?P<uri>.*) (?P<ip>\S+) (?P<stamp>\d{4,14}) (?P<mime>.*) (?P<length>\d+)"),
    2: re.compile(rb"(?P<uri>.*) (?P<ip>\S+) (?P<stamp>\d{4,14}) (?P<mime>\S+) (?P<status>\S+) \S+ \S+ \S+ \S+ "
                  rb"(?P<length>\d+)"),
}

RECORD = ("file long, offset long, record_id string, version int, kind string, uri string, ip string, "
          "stamp string, mime string, head binary, payload binary, size long, payload_sha1 string, "
          "payload_sha256 binary, block_sha1 string, head_sha1 string, truncated boolean, error string")

_SCHEMA = pa.schema([
    ("file", pa.int64()), ("offset", pa.int64()), ("record_id", pa.string()), ("version", pa.int32()),
    *[(name, pa.string()) for name in ("kind", "uri", "ip", "stamp", "mime")],
    ("head", pa.binary()), ("payload", pa.binary()), ("size", pa.int64()), ("payload_sha1", pa.string()),
    ("payload_sha256", pa.binary()), ("block_sha1", pa.string()), ("head_sha1", pa.string()),
    ("truncated", pa.bool_()), ("error", pa.string())])

_BLANKS = re.compile(rb"[\x00-\x20\x7f]")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def sha1(data: bytes) -> str:
    """Digest as archives state it: base32 in upper case."""
    return b32encode(hashlib.sha1(data).digest()).decode()


def write(rows: DataFrame, path: str, versions: Sequence[int] = (1, 2), origin: str = "tidebar") -> None:
    """Write ``rows`` (uri, ip, stamp of 14 digits, mime, document) as compressed ARC files.

    One file per task; tasks take turns with the ``versions``. White space and control characters in addresses and media
    types are escaped; a null address becomes ``about:blank``, other nulls ``0.0.0.0``, the
    epoch, ``no-type`` and an empty document.
    """

    def escaped(value: str | None, other: bytes) -> bytes:
        data = value.encode("utf-8", "replace") if value else other
        return _BLANKS.sub(lambda m: b"%%%02X" % m[0][0], data)

    def run(batches):
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]
        fixed = b" 200 - - 0 -" if version == 2 else b""
        block = "\n".join(VERSIONS[version]).format(origin=origin).encode() + b"\n"
        first = b"filedesc://part-%05d.arc 0.0.0.0 19700101000000 text/plain%s %d\n%s" % (
            part, fixed, len(block), block)
        started = False
        for batch in batches:
            out = [] if started else [first]
            started = True
            for uri, ip, stamp, mime, document in zip(*(c.to_pylist() for c in batch.columns)):
                document = document or b""
                out.append(b"%s %s %s %s%s %d\n%s" % (
                    escaped(uri, b"about:blank"), escaped(ip, b"0.0.0.0"), escaped(stamp, b"19700101000000"),
                    escaped(mime, b"no-type"), fixed, len(document), document))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    made = rows.select("uri", "ip", "stamp", "mime", "document").mapInArrow(run, "value binary")
    made.selectExpr("cast(value as string) value").write.options(**streams.GZIP).option("lineSep", "\n").text(path)


def _record(file: int, offset: int, version: int, fields: dict, block: bytes) -> dict:
    uri = fields["uri"].decode("utf-8", "replace")
    stamp = fields["stamp"].decode()
    head, payload, kind = b"", block, "resource"
    if uri.startswith("filedesc:"):
        kind = "warcinfo"
    elif block.startswith(b"HTTP/"):
        end = _HEAD_END.search(block)
        cut = end.end() if end else len(block)
        head, payload, kind = block[:cut], block[cut:], "response"
    return {
        "file": file, "offset": offset, "version": version, "kind": kind, "uri": uri,
        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{file}:{offset}:{stamp}:{uri}")),
        "ip": fields["ip"].decode("utf-8", "replace"), "stamp": stamp, "mime": fields["mime"].decode("utf-8", "replace"),
        "head": head, "payload": payload, "size": len(payload), "payload_sha1": sha1(payload),
        "payload_sha256": hashlib.sha256(payload).digest(), "block_sha1": sha1(block) if head else sha1(payload),
        "head_sha1": sha1(head), "truncated": len(block) < int(fields["length"]), "error": None}


def parse(file: int, stream: streams.Stream) -> Iterator[dict]:
    """The records of one file.

    The version block sets which header lines are valid; without one it is version 1. A line
    that is no header gives a row with ``error`` and kind ``error``, and the search goes on behind it. A document
    that ends with the file is ``truncated``.
    """
    version = 1
    while True:
        offset = stream.offset
        line = stream.line()
        if line is None:
            return
        line = line.rstrip(b"\r")
        if not line:
            continue
        header = HEADERS[version].fullmatch(line)
        if line.startswith(b"filedesc:"):  # its fields are those of the version that its block states
            header = HEADERS[2].fullmatch(line) or HEADERS[1].fullmatch(line)
        if header is None:
            yield dict.fromkeys(_SCHEMA.names) | {
                "file": file, "offset": offset, "version": version, "kind": "error", "size": 0,
                "error": f"not a header line of version {version}: {line[:200].decode('utf-8', 'replace')}"}
            continue
        block = stream.take(int(header["length"]))
        if line.startswith(b"filedesc:"):
            stated = block.split(b"\n")[0].split(b" ")[0]
            version = int(stated) if stated in (b"1", b"2") else version
        yield _record(file, offset, version, header.groupdict(), block)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all ARC files below ``path``; without ``payload`` only their digests and sizes."""
    run = streams.parsed(parse, _SCHEMA, b"\n", payload)
    return streams.pieces(spark, path, "\n").mapInArrow(run, RECORD)
