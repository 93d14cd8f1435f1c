"""WARC archives: whole-file gzip streams rewritten record by record.

``write`` turns pages into archives, each one gzip stream over all its records,
as crawlers that compress whole files leave them.  ``normalise`` inflates every
such stream once, from front to end, and writes each record as a gzip member of
its own into a new archive; a sidecar beside it lists every member's offset and
length, so that any record can be read alone.  Records whose payloads are equal
become revisits of the one with the smallest page_id while they are rewritten.
``read`` takes ranges of members by that index, checks every payload's digest
and returns the records.

Payloads are never shuffled: only a row of numbers and digests a record is, to
find equal ones.  Classes that hold a thousandth of all records or more are at
most a thousand, so they are joined by broadcast and no task gets a class
whole.  Streams are read and written in pieces of 64 KB, whatever a record's
size.  Tasks write to the folder in ``spark.checkpoint.dir`` under names of
their own and return those names; only names that a finished task returned are
read, so a lost executor or a second attempt leaves files that nobody reads.

Defined results: a null html is an empty payload; a null page_id comes after all
others and is returned as null (a revisit of such a page refers to null); rows
that repeat a page_id are records of their own, the first written of the
smallest being the response; a null url leaves its header out, and bytes that
do not belong in a header are percent-encoded; other columns are ignored; an
empty table makes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismspark.llm.storage import map_rows, scratch, small_batches, written

#: Uncompressed bytes after which an archive ends, compressed bytes of one
#: reading task, and bytes held at a time.
ARCHIVE_BYTES, SPAN_BYTES, PIECE = 256 << 20, 16 << 20, 64 << 10
LEVEL = 4
#: Least payload that is written as a revisit when it repeats.
MIN_REVISIT = 0
#: Share of all records from which a class is joined by broadcast.
HOT_SHARE = 1e-3
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, position long, record_id string, page_id long, payload_bytes long, payload_digest string, class binary"
INDEX = "archive string, position long, start long, length long"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(archive: str, position: int) -> str:
    """A record's id, the same in every attempt that reads the archive."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{position}')}>"


def header_value(text: str) -> str:
    """``text`` as one line of visible ASCII."""
    return quote(text, safe="".join(map(chr, range(0x21, 0x7F))), encoding="utf-8", errors="replace")


def _head(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def _digest(sha: hashlib._Hash) -> str:
    return base64.b32encode(sha.digest()).decode()


class _Member:
    """One gzip member, deflated piece by piece."""

    def __init__(self, sink: pa.NativeFile, level: int):
        self.sink, self.deflate, self.size = sink, zlib.compressobj(level, zlib.DEFLATED, 31), 0

    def write(self, data: bytes) -> None:
        self._put(self.deflate.compress(data))

    def close(self) -> None:
        self._put(self.deflate.flush())

    def _put(self, data: bytes) -> None:
        if data:
            self.sink.write(data)
            self.size += len(data)


def _write(folder: str, archive_bytes: int, level: int) -> Callable:
    """Rows (page_id, url, html) to archives; a row of ``RECORD`` a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _place(folder)
        sink = member = None
        for batch in batches:
            out = []
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if member is None:
                    archive = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{base}/{archive.rsplit('/', 1)[1]}", compression=None)
                    member, position, filled = _Member(sink, level), 0, 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest, http, name = _digest(hashlib.sha1(payload)), _http(len(payload)), record_id(archive, position)
                fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
                if url is not None:
                    fields.append(("WARC-Target-URI", header_value(url)))
                if page is not None:
                    fields.append(("WARC-Page-ID", str(page)))
                fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
                for part in (_head(fields), http, payload, b"\r\n\r\n"):
                    member.write(part)
                    filled += len(part)
                out.append((archive, position, name, page, len(payload), digest, hashlib.sha256(payload).digest()))
                position += 1
                if filled >= archive_bytes:
                    member.close()
                    sink.close()
                    member = None
            # An archive's rows may leave before it is closed: they count only
            # once the task has ended.
            yield _rows(out, RECORD)
        if member is not None:
            member.close()
            sink.close()

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def write(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """(archive, position, record_id, page_id, payload_bytes, payload_digest,
    class) of the records written, one for each row of ``pages`` (page_id, url,
    html)."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    store, base = _place(folder)
    store.create_dir(base)
    url = F.col("url") if "url" in pages.columns else F.lit(None)
    rows = pages.select(F.col("page_id").cast("long"), url.cast("string"), F.col("html").cast("string"))
    fields = spark.createDataFrame([], RECORD).schema.fields
    return written(map_rows(rows, _write(folder, archive_bytes, level), fields), "warc-records")


def revisits(records: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(archive, position, refers_id, refers_page) of the records that repeat
    the payload of another one with a smaller page_id."""
    records = records.filter(F.col("payload_bytes") >= least)
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "archive", "position", "record_id")).alias("first")
    classes = written(records.groupBy("class").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-classes")
    hot = classes.filter(F.col("n") >= max(2, int(HOT_SHARE * records.count())))
    hot, keys = hot.select("class", "first"), F.broadcast(hot.select("class"))
    rows = records.select("archive", "position", "class")
    rest = rows.join(keys, "class", "left_anti").join(classes.join(keys, "class", "left_anti").select("class", "first"), "class")
    found = rows.join(F.broadcast(hot), "class").unionByName(rest)
    found = found.filter((F.col("archive") != F.col("first.archive")) | (F.col("position") != F.col("first.position")))
    return found.select("archive", "position", F.col("first.record_id").alias("refers_id"), F.col("first.page_id").alias("refers_page"))


def _headers(stream: gzip.GzipFile) -> list[tuple[str, str]] | None:
    """A record's header fields, or None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
    fields: list[tuple[str, str]] = []
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError("the stream ends within a header")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            fields.append((name.strip(), value.strip()))
    return fields


def _field(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def _pieces(stream: gzip.GzipFile, size: int) -> Iterator[bytes]:
    while size:
        piece = stream.read(min(size, PIECE))
        if not piece:
            raise ValueError("the stream ends within a record")
        size -= len(piece)
        yield piece


def _http_head(stream: gzip.GzipFile, size: int) -> bytes:
    """The lines up to the empty one that ends an HTTP header, at most ``size``
    bytes."""
    head = b""
    while len(head) < size and not head.endswith(b"\r\n\r\n"):
        head += stream.readline(size - len(head))
    return head


def _normalise(folder: str, level: int) -> Callable:
    """All rows of one archive (its records' places, and what they refer to) to
    a new archive and its sidecar."""

    def run(group: pa.Table) -> pa.Table:
        source = group["archive"][0].as_py()
        repeats = {p: (i, page) for p, i, page in zip(*(group[c].to_pylist() for c in ("position", "refers_id", "refers_page")), strict=True) if i is not None}
        store, base = _place(folder)
        name = f"{source.rsplit('/', 1)[1].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:12]}.warc.gz"
        origin, path = _place(source)
        start, position = 0, 0
        with origin.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream, store.open_output_stream(f"{base}/{name}", compression=None) as sink, store.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
            while (fields := _headers(stream)) is not None:
                size, member = int(_field(fields, "Content-Length") or 0), _Member(sink, level)
                if position in repeats:
                    refers, page = repeats[position]
                    head = _http_head(stream, size)
                    for _ in _pieces(stream, size - len(head)):
                        pass
                    fields = [(k, "revisit" if k.lower() == "warc-type" else str(len(head)) if k.lower() == "content-length" else v) for k, v in fields]
                    fields[-1:-1] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers)] + [("WARC-Refers-To-Page-ID", str(page))] * (page is not None)
                    member.write(_head(fields) + head)
                else:
                    member.write(_head(fields))
                    for piece in _pieces(stream, size):
                        member.write(piece)
                member.write(b"\r\n\r\n")
                member.close()
                index.write(f"{position}\t{start}\t{member.size}\n".encode())
                start, position = start + member.size, position + 1
        return pa.table({"archive": [f"{folder}/{name}"], "records": pa.array([position], pa.int64()), "bytes": pa.array([start], pa.int64())})

    return run


def normalise(records: DataFrame, repeated: DataFrame | None = None, level: int = LEVEL) -> DataFrame:
    """(archive, records, bytes) of the new archives, one for each archive that
    ``records`` (archive, position) names; the records in ``repeated`` become
    revisits."""
    spark = records.sparkSession
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    store, base = _place(folder)
    store.create_dir(base)
    rows = records.select("archive", "position", F.lit(None).cast("string").alias("refers_id"), F.lit(None).cast("long").alias("refers_page"))
    # Of records that stay, one a file is enough to name it.
    rows = rows.groupBy("archive").agg(F.min("position").alias("position"), F.first("refers_id").alias("refers_id"), F.first("refers_page").alias("refers_page"))
    n = rows.count()
    if repeated is not None:
        rows = rows.unionByName(repeated)
    # A number of partitions of its own: by bytes these rows would all go to one task.
    tasks = max(1, min(n, max(4 * spark.sparkContext.defaultParallelism, n // 8)))
    made = rows.repartition(tasks, "archive").groupBy("archive").applyInArrow(_normalise(folder, level), "archive string, records long, bytes long")
    return written(made, "warc-archives")


def _sidecars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            store, path = _place(archive)
            out = []
            with store.open_input_stream(f"{path}.idx", compression=None) as raw:
                rest = b""
                while piece := raw.read(PIECE):
                    *lines, rest = (rest + piece).split(b"\n")
                    out += [(archive, *map(int, line.split(b"\t"))) for line in lines]
                    if len(out) > 10_000:
                        yield _rows(out, INDEX)
                        out = []
            yield _rows(out, INDEX)


def index(archives: DataFrame) -> DataFrame:
    """(archive, position, start, length) of every record, from the sidecars of
    ``archives`` (archive)."""
    spark = archives.sparkSession
    names = archives.select("archive")
    tasks = max(1, min(names.count(), 4 * spark.sparkContext.defaultParallelism))
    return map_rows(names.repartition(tasks), _sidecars, spark.createDataFrame([], INDEX).schema.fields)


def _read(payloads: bool) -> Callable:
    """Members of one archive by their index rows; adjoining ones in one stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw = None, None
        for batch in batches:
            out = []
            for archive, position, start, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != held:
                    if raw is not None:
                        raw.close()
                    store, path = _place(archive)
                    held, raw = archive, store.open_input_file(path)
                raw.seek(start)
                with gzip.GzipFile(fileobj=raw) as stream:
                    out.append((archive, position, *_record(stream, payloads)))
            yield _rows(out, f"archive string, position long, {CONTENT}")
        if raw is not None:
            raw.close()

    return run


CONTENT = "record_id string, record_type string, url string, page_id long, refers_id string, refers_page long, payload_bytes long, payload_digest string, payload binary"


def _record(stream: gzip.GzipFile, payloads: bool) -> tuple:
    fields = _headers(stream)
    if fields is None:
        raise ValueError("no record where the index names one")
    number = lambda name: None if (v := _field(fields, name)) is None else int(v)
    kind, size = _field(fields, "WARC-Type"), number("Content-Length")
    head = _http_head(stream, size)
    stated = (_field(fields, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    if kind == "revisit":  # its header still says how long the payload is
        inner = dict(line.lower().split(": ", 1) for line in head.decode().split("\r\n") if ": " in line)
        length, digest, kept = int(inner["content-length"]), stated, None
    else:
        sha, length, kept = hashlib.sha1(), 0, []
        for piece in _pieces(stream, size - len(head)):
            sha.update(piece)
            length += len(piece)
            if payloads:
                kept.append(piece)
        digest, kept = _digest(sha), b"".join(kept) if payloads else None
        if stated and stated != digest:
            raise ValueError(f"payload of {_field(fields, 'WARC-Record-ID')} has digest {digest}, not {stated}")
    return _field(fields, "WARC-Record-ID"), kind, _field(fields, "WARC-Target-URI"), number("WARC-Page-ID"), _field(fields, "WARC-Refers-To"), number("WARC-Refers-To-Page-ID"), length, digest, kept


def read(members: DataFrame, payloads: bool = False, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The records that ``members`` (archive, position, start, length) names:
    ids, type, url, what they refer to, length and digest of the full payload,
    and the payload itself (null in revisits) if ``payloads``.

    A payload that does not have the stated digest is an error.  Spans of
    ``span_bytes`` of an archive are the units that tasks take."""
    spark = members.sparkSession
    small_batches(spark)
    members = written(members.select("archive", "position", "start", "length"), "warc-index")
    total = members.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(total // span_bytes + 1, 10_000), min(total >> 20, 2 * spark.sparkContext.defaultParallelism))
    dealt = members.repartition(int(tasks), "archive", F.expr(f"start div {span_bytes}")).sortWithinPartitions("archive", "start")
    fields = spark.createDataFrame([], f"archive string, position long, {CONTENT}").schema.fields
    out = map_rows(dealt, _read(payloads), fields)
    return out if payloads else out.drop("payload")


def archive_pages(pages: DataFrame, least: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The normalised archives of ``pages``: (archive, records, bytes)."""
    records = write(pages, archive_bytes)
    return normalise(records, revisits(records, least))
