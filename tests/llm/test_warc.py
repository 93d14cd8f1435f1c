"""WARC archives: round trips, and an outside reading of the files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from prismspark.llm import warc
from prismspark.llm.storage import scratch

SCHEMA = "page_id long, url string, html string, archive string, `a.b` int, position int"


@pytest.fixture(scope="module")
def pages(spark):
    html = ["<p>a</p>", "", None, "é😀 WARC/1.1\r\nWARC-Type: response\r\n\r\n", "x" * 300_000, "line\r\n\r\n", "<p>b</p>"]
    rows = [(i, f"http://h/{i}\r\nWARC-Type: xé y" if i % 3 else None, html[i % 7], "z", 1, 2) for i in range(60)]
    rows += [(None, "u", "<p>a</p>", "z", 1, 2), (None, "u", "alone", "z", 1, 2), (7, "u", "<p>a</p>", "z", 1, 2), (0, "u", "<p>a</p>", "z", 1, 2), (0, "v", "<p>a</p>", "z", 1, 2), (None, None, "nobody", "z", 1, 2), (None, None, "nobody", "z", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages, least=0):
    by: dict = {}
    known = [(r["page_id"], r["html"] or "") for r in pages.collect()]
    order = sorted(known, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for page, html in order:
        size = len(html.encode())
        first = size >= least and html in by
        out.append((page, size, digest(html), "revisit" if first else "response", by[html] if first else None))
        by.setdefault(html, page)
    return sorted(out, key=repr)


@pytest.mark.parametrize(("size", "least", "share"), [(warc.ARCHIVE_BYTES, 0, 1e-3), (2_000, 0, 1e-3), (2_000, 9, 0.5)])
def test_records_come_back(pages, size, least, share, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", share)
    archives = warc.archive_pages(pages, least, size).cache()
    assert archives.agg(F.sum("records")).first()[0] == pages.count()
    assert archives.count() > 10 or size > 2_000
    found = warc.read(warc.index(archives), payloads=True, span_bytes=1_000).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_page"]) for r in found), key=repr) == expected(pages, least)
    ids = {r["record_id"]: r for r in found}
    assert len(ids) == len(found)
    for r in found:
        if r["record_type"] == "revisit":
            target = ids[r["refers_id"]]
            assert target["record_type"] == "response" and target["payload_digest"] == r["payload_digest"] and r["payload"] is None
        else:
            assert digest(bytes(r["payload"]).decode()) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]


def test_files_are_members_and_sidecars(pages, spark):
    records = warc.write(pages, 2_000)
    archives = [r["archive"] for r in warc.normalise(records, warc.revisits(records)).collect()]
    before = {r["archive"] for r in records.select("archive").distinct().collect()}
    for name in before:  # one stream over all records
        data = open(name.removeprefix("file://"), "rb").read()
        stream = zlib.decompressobj(31)
        stream.decompress(data)
        assert stream.eof and not stream.unused_data
    for name in archives:
        path = name.removeprefix("file://")
        data, at = open(path, "rb").read(), 0
        for k, line in enumerate(open(f"{path}.idx").read().splitlines()):
            position, start, size = map(int, line.split("\t"))
            assert (position, start) == (k, at)
            stream = zlib.decompressobj(31)
            record = stream.decompress(data[start : start + size])
            assert stream.eof and not stream.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            head, _, block = record.partition(b"\r\n\r\n")
            fields = [x.split(b": ", 1) for x in head.split(b"\r\n")[1:]]
            assert int(dict(fields)[b"Content-Length"]) == len(block) - 4
            assert len({k for k, _ in fields}) == len(fields)  # no url wrote a header of its own
            at = start + size
        assert at == len(data)


def test_streams_of_other_makers(spark, tmp_path):
    """Folded headers, several members, lone line ends, no digest."""
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nX-Long: a\r\n b\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(body), body)
    other = b"WARC/1.0\nwarc-type: resource\ncontent-length: 0\n\n\r\n\r\n"
    path = f"{scratch(spark)}/foreign.warc.gz"
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(gzip.compress(one + other) + gzip.compress(one))
    made = warc.normalise(spark.createDataFrame([(path, 0)], "archive string, position long"))
    rows = sorted(warc.read(warc.index(made)).collect(), key=lambda r: r["position"])
    assert [(r["record_id"], r["record_type"], r["payload_bytes"]) for r in rows] == [("<urn:x:1>", "response", 5), (None, "resource", 0), ("<urn:x:1>", "response", 5)]
    assert rows[0]["payload_digest"] == digest("hello")


def test_damage_is_an_error(spark):
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    path = f"{scratch(spark)}/damaged.warc.gz"
    frame = spark.createDataFrame([(path, 0)], "archive string, position long")
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(gzip.compress(bad))
    with pytest.raises(Exception, match="not AAAA"):
        warc.read(warc.index(warc.normalise(frame))).collect()
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(gzip.compress(bad[:-6]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise(frame)


def test_no_pages(pages):
    assert warc.read(warc.index(warc.archive_pages(pages.limit(0)))).count() == 0
