"""ARC files converted to WARC and read back, against what went in."""

import gzip
import hashlib
import random
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from tidebar.llm import arc, hot, queries, streams, warc

DOCUMENTS = "uri string, ip string, stamp string, mime string, document binary"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def sha1(data):
    return b32encode(hashlib.sha1(data).digest()).decode()


def tricky():
    """Documents that hold what looks like the ends and starts of records."""
    r = random.Random(3)
    return [
        b"", b"\n", b"\r\n\r\n", b"a\n\nhttp://x/ 1.2.3.4 20010101000000 text/html 3\nabc\n",
        b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", b"\xff\xfe\x00 bytes",
        "ä日本\x85".encode(), r.randbytes(3_000_000), b"x" * 100, b"x" * 100, b"filedesc://x 0 1 2 3\n", b"last"]


def test_round_trip_keeps_every_byte(spark, tmp_path):
    documents = [HTTP + d for d in tricky()] + tricky()
    rows = [(f"http://h/{i} ä", "1.2.3.4", "20240102030405", "text/html", d) for i, d in enumerate(documents)]
    rows += [(None, None, None, None, None), ("dns:h", "1.2.3.4", "2024", "text/dns; x", b"1.2.3.4")]
    arc.write(spark.createDataFrame(rows, DOCUMENTS).repartition(3), str(tmp_path / "arc"))
    found = arc.read(spark, str(tmp_path / "arc")).filter("kind <> 'warcinfo'").collect()
    assert {r.version for r in found} == {1, 2}
    assert not any(r.error or r.truncated for r in found)
    expected = [(r[0] or "about:blank").replace(" ", "%20") for r in rows]
    got = {(r.uri, bytes(r.head) + bytes(r.payload)) for r in found}
    assert len(found) == len(rows) and got == {(u, r[4] or b"") for u, r in zip(expected, rows)}
    assert warc.from_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), least_bytes=1).count() == 0
    back = warc.read(spark, str(tmp_path / "warc")).filter("type <> 'warcinfo'").collect()
    assert len(back) == len(rows) and not any(r.error for r in back)
    whole = {r.record_id: r for r in back if r.type != "revisit"}
    payloads = [d.removeprefix(HTTP) for d in documents] + [b"", b"1.2.3.4"]
    restored = []
    for r in back:
        kept = whole[r.refers_to] if r.type == "revisit" else r
        assert (r.digest, r.size) == (sha1(bytes(kept.payload)), len(kept.payload))
        restored.append(bytes(kept.payload))
    assert sorted(restored) == sorted(payloads)
    # payloads of at least one byte are kept once, empty ones each time
    assert len(whole) == len({p for p in payloads if p}) + payloads.count(b"")
    assert {r.date for r in back if r.uri == "dns:h"} == {"2024-01-01T00:00:00Z"}


@pytest.mark.parametrize("ending", ["", ".gz"])
def test_files_of_others(spark, tmp_path, ending):
    """Uncompressed and compressed files, version 1 without a block, lines between records, a cut end."""
    import gzip

    data = (b"http://a b/ 1.1.1.1 19970101 text/html; charset=x 5\nhello\n\n\ngarbage line\n"
            b"filedesc://f 0.0.0.0 1998 text/plain 200 - - 0 f 6\n2 0 x\n\n"
            b"http://c/ 1.1.1.1 19980101000000 text/html 200 sum - 12 f 9\nHTTP/1.0 \nhttp://d/ 1.1.1.1 1998 t 3\nabc\n"
            b"http://e/ 1.1.1.1 19980101000000 text/html 200 - - 0 f 90\ncut")
    target = tmp_path / f"x.arc{ending}"
    target.write_bytes(gzip.compress(data) if ending else data)
    (tmp_path / "note.txt").write_text("left alone")
    found = sorted(arc.read(spark, str(tmp_path)).collect(), key=lambda r: r.offset)
    kinds = [(r.kind, r.uri, r.version) for r in found]
    assert kinds == [
        ("resource", "http://a b/", 1), ("error", None, 1), ("warcinfo", "filedesc://f", 2),
        ("response", "http://c/", 2), ("error", None, 2), ("error", None, 2), ("resource", "http://e/", 2)]
    assert bytes(found[0].payload) == b"hello" and found[-1].truncated and bytes(found[-1].payload).rstrip(b"\n") == b"cut"
    rejects = warc.from_arc(spark, str(tmp_path), str(tmp_path / "out")).collect()
    assert len(rejects) == 3 and all("not a header line" in r.error for r in rejects)
    assert warc.read(spark, str(tmp_path / "out")).filter("error IS NULL AND type <> 'warcinfo'").count() == 3


def test_damaged_warc(spark, tmp_path):
    good = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(
        b"noise\r\n" + good % sha1(b"ab").encode() + good % b"WRONG"
        + b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\nshort")
    found = [(r.type, r.error) for r in warc.read(spark, str(tmp_path)).collect()]
    assert found[0][0] == "error" and found[1] == ("resource", None)
    assert [e for _, e in found[2:]] == ["the payload has another digest", "the block is shorter than stated"]


def test_archives_are_compressed_at_the_fastest_level(spark, tmp_path):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.hex(F.xxhash64("id", i) % 997)), " <p> ")
    rows = spark.range(400).select(
        F.lit("u").alias("uri"), F.lit("0.0.0.0").alias("ip"), F.lit("20000101000000").alias("stamp"),
        F.lit("text/html").alias("mime"), text.cast("binary").alias("document")).coalesce(1)
    arc.write(rows, str(tmp_path / "arc"))
    warc.from_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    for name in ("arc", "warc"):
        stored = max((p.read_bytes() for p in (tmp_path / name).glob("*.gz")), key=len)
        sizes = {level: abs(len(stored) - len(gzip.compress(gzip.decompress(stored), level))) for level in (1, 6)}
        assert sizes[1] < sizes[6]


def test_first_of_equal_payloads(spark, tmp_path):
    """The query on pages with nulls, repeated rows, ties, a hot payload and no rows, against plain Python."""
    pages = [(i, f"http://h/{i}", "hot page", 1) for i in range(900, 0, -1)]
    pages += [(None, None, None, 1), (None, "u", "", 1), (5000, "u u", "", 1), (4000, "u\n", "ä" * 70_000, 1)]
    pages += [(4000, "u", "same id", 1), (4000, "u", "same id", 1), (4001, "u", "same id", 1), (-3, "v", "hot page", 1)]
    pages += [(7000, "w", "x\r\n\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\n", 1), (None, "n", "alone", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_id int").repartition(5)
    for name, given in (("full", df), ("empty", df.filter("false"))):
        given.write.parquet(f"{tmp_path}/{name}/pages.parquet")
        found = queries.op11_arc_conversion(spark, f"{tmp_path}/{name}").collect()
        if name == "empty":
            assert not found
            continue
        groups = {}
        for page_id, _, html, _ in pages:
            groups.setdefault((html or "").encode(), []).append(page_id)
        expected = []
        for payload, ids in groups.items():
            ids.sort(key=lambda x: (x is None, x or 0))
            for i, page_id in enumerate(ids):
                expected.append((page_id, len(payload), sha1(payload), "revisit" if i else "response", ids[0] if i else None))
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_stream_over_any_chunks():
    data = b"one\ntwo\r\n\nlonger line" + bytes(range(256)) + b"\nend"
    for size in (1, 2, 3, 7, 1000):
        stream = streams.Stream(iter([data[i : i + size] for i in range(0, len(data), size)]))
        assert [stream.line(), stream.line(), stream.line()] == [b"one", b"two\r", b""]
        assert stream.take(6) == b"longer" and stream.offset == 16
        assert stream.take(1000) == data[16:] and stream.line() is None


def test_lookup_of_hot_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("key"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, 9)], "key long, id long"))
    table = rows.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    found = {(r.key, r.id, r.least) for r in hot.lookup(rows, table, "key", 3000).collect()}
    assert found == {(7 if i % 3 else i, i, 1 if i % 3 else (i if i != 7 else 1)) for i in range(3000)}
