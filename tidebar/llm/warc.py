"""Legacy archives converted to WARC, and WARC files read back.

Each ARC record becomes a WARC record with an identifier made from its place, address and
date, its date in ISO form, the type that its content shows (``response`` for HTTP messages,
``resource`` for others, ``warcinfo`` for version blocks) and digests of block and payload.
Of records with equal payloads the first stays, the others become ``revisit`` records, which
hold the HTTP header, the payload's digest and length, and refer to it.

Payloads are read twice, once for the digests and once for the records that keep them; which
records are revisits is worked out from rows without payload. Where the list of revisits is too
large to broadcast, a shuffle on the identifiers moves each payload once; no key of it is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import arc, streams
from tidebar.llm.hot import lookup
from tidebar.session import durable

#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("type string, record_id string, uri string, date string, head binary, payload binary, size long, "
          "digest string, refers_to string, error string")

_SCHEMA = pa.schema([
    *[(name, pa.string()) for name in ("type", "record_id", "uri", "date")], ("head", pa.binary()),
    ("payload", pa.binary()), ("size", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()),
    ("error", pa.string())])

_HEAD_END = re.compile(rb"\r?\n\r?\n")


def iso(stamp: Column) -> Column:
    """A date of up to 14 digits in ISO form; missing parts are the least, what is no date is the epoch."""
    whole = F.concat(stamp, F.substring(F.lit("00000101000000"), F.length(stamp) + 1, F.lit(14)))
    found = F.coalesce(F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")), F.timestamp_seconds(F.lit(0)))
    return F.date_format(found, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _field(name: str, value: Column) -> Column:
    """A header line, null (and so left out) without a value."""
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _text(rows: DataFrame, type_: Column, block: Column, digest: Column, more: Sequence[Column] = ()) -> DataFrame:
    """One string of header and block per record."""
    http = F.col("kind") == "response"
    mime = F.when(http, F.lit("application/http; msgtype=response")).when(
        F.col("kind") == "warcinfo", F.lit("text/plain")).otherwise(F.col("mime"))
    about = F.col("kind") != "warcinfo"
    block = F.coalesce(block, F.lit(b""))
    lines = [
        F.lit(VERSION), _field("WARC-Type", type_),
        _field("WARC-Record-ID", F.format_string("<urn:uuid:%s>", "record_id")),
        _field("WARC-Date", iso(F.col("stamp"))),
        _field("WARC-Target-URI", F.when(about, F.col("uri"))),
        _field("WARC-IP-Address", F.when(about & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        _field("WARC-Payload-Digest", F.when(about, F.concat(F.lit("sha1:"), "payload_sha1"))),
        _field("WARC-Block-Digest", F.concat(F.lit("sha1:"), digest)),
        _field("WARC-Truncated", F.when(F.col("truncated"), F.lit("unspecified"))),
        *more,
        _field("Payload-Length", F.when(about, F.col("size"))),
        _field("Content-Type", mime), _field("Content-Length", F.octet_length(block))]
    header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    return rows.select(F.concat(header.cast("binary"), block).cast("string").alias("value"))


def from_arc(spark: SparkSession, source: str, target: str, first_by: Sequence[Column] = (),
             least_bytes: int = 0) -> DataFrame:
    """Convert the ARC files below ``source`` to compressed WARC files below ``target``.

    Of records with equal payloads of at least ``least_bytes`` bytes, the first by ``first_by`` (columns over
    ``arc.RECORD``, nulls last; then date and place) keeps its payload. Returns the lines that
    could not be converted (file, offset, error).
    """
    found = durable(arc.read(spark, source, payload=False))
    order = [c for key in (*first_by, F.col("stamp")) for c in (key.isNull(), key)]
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], "file", "offset", "record_id", "uri", "stamp")
    sized = found.filter(F.col("kind").isin("response", "resource") & (F.col("size") >= least_bytes))
    firsts = sized.groupBy("payload_sha256").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    firsts = durable(firsts.filter("n > 1").select(
        "payload_sha256", "n", F.col("first.record_id").alias("first_id"),
        F.col("first.uri").alias("first_uri"), F.col("first.stamp").alias("first_stamp")))
    again = durable(lookup(sized, firsts, "payload_sha256", found.count()).filter("record_id <> first_id"))

    whole = arc.read(spark, source).filter("kind <> 'error'")
    full = whole.join(again.select("record_id"), "record_id", "left_anti")
    block = F.concat(F.coalesce("head", F.lit(b"")), "payload")
    responses = _text(full, F.col("kind"), block, F.col("block_sha1"))
    revisits = _text(again, F.lit("revisit"), F.col("head"), F.col("head_sha1"), [
        F.lit(f"WARC-Profile: {SAME_PAYLOAD}"),
        _field("WARC-Refers-To", F.format_string("<urn:uuid:%s>", "first_id")),
        _field("WARC-Refers-To-Target-URI", F.col("first_uri")),
        _field("WARC-Refers-To-Date", iso(F.col("first_stamp")))])
    responses.unionByName(revisits).write.options(**streams.GZIP).option("lineSep", "\r\n\r\n").text(target)
    return found.filter("kind = 'error'").select("file", "offset", "error")


def parse(file: int, stream: streams.Stream) -> Iterator[dict]:
    """The records of one file, by their declared lengths.

    ``size`` and ``digest`` are of the payload: counted here where the record has one, as
    stated in a revisit. Where the two differ, or a record ends with the file, ``error`` says so; lines outside of records give rows
    of type ``error``.
    """
    while True:
        line = stream.line()
        if line is None:
            return
        line = line.rstrip(b"\r")
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            yield dict.fromkeys(_SCHEMA.names) | {
                "type": "error", "size": 0, "error": f"outside of a record: {line[:200].decode('utf-8', 'replace')}"}
            continue
        fields = {}
        while line := (stream.line() or b"").rstrip(b"\r"):
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
        length = fields.get(b"content-length", "0")
        block = stream.take(int(length) if length.isdigit() else 0)
        kind = fields.get(b"warc-type")
        head, payload = b"", block
        if block.startswith(b"HTTP/"):
            end = _HEAD_END.search(block)
            cut = end.end() if end else len(block)
            head, payload = block[:cut], block[cut:]
        stated = fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
        digest, size, error = arc.sha1(payload), len(payload), None
        if kind == "revisit":
            told = fields.get(b"payload-length", "")
            digest, size, payload = stated, int(told) if told.isdigit() else None, None
        elif stated and stated != digest:
            error = "the payload has another digest"
        if length != str(len(block)):
            error = "the block is shorter than stated"
        yield {
            "type": kind, "record_id": fields.get(b"warc-record-id"), "uri": fields.get(b"warc-target-uri"),
            "date": fields.get(b"warc-date"), "head": head, "payload": payload, "size": size, "digest": digest,
            "refers_to": fields.get(b"warc-refers-to"), "error": error}


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all WARC files below ``path``, with or without their payloads."""
    run = streams.parsed(parse, _SCHEMA, b"\r\n", payload)
    return streams.pieces(spark, path, "\r\n").mapInArrow(run, RECORD)
