"""A chunked array store as a Spark source and sink.

A store is a folder in the layout of the public Zarr format, version 2: groups
and arrays are folders with JSON beside them, an array's chunks are files named
by their place.  Images are groups, nested under ``images`` or at the top, with
an array ``data`` (rows, columns, channels; px counts along rows) or ``X``
(spectra, channels).  Chunks may be plain, zlib, gzip or zstd; a chunk that is
not there holds the array's fill value.

Partitions are runs of chunks of about ``PARTITION_BYTES``.  Filters on ``image``
and ``px`` are pushed: chunks without a pixel that they allow are not opened.
Files are reached by ``pyarrow.fs``, so any of its stores will do.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "image string, px long, x array<double>"
#: Uncompressed bytes of one partition, and spectra of one Arrow batch.
PARTITION_BYTES, ROWS = 64 << 20, 2_048
#: Pixels of a chunk that ``write_store`` makes.
CHUNK = 1_024


def _place(path: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, base.rstrip("/")


def _json(store: fs.FileSystem, path: str) -> dict | None:
    try:
        with store.open_input_stream(path) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return None


def _folders(store: fs.FileSystem, path: str) -> list[str]:
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


def attributes(path: str, image: str | None = None) -> dict:
    """Attributes of the store (axis, classes) or of an image (label, patient)."""
    store, base = _place(path)
    if image is None:
        return _json(store, f"{base}/.zattrs") or {}
    for folder in (f"{base}/images/{image}", f"{base}/{image}"):
        if (found := _json(store, f"{folder}/.zattrs")) is not None:
            return found
    return {}


def arrays(path: str) -> list[dict]:
    """Image, folder and JSON description of every array of spectra, by image;
    a nested image hides one of the same name at the top."""
    store, base = _place(path)
    nested = [(n, f"{base}/images/{n}") for n in _folders(store, f"{base}/images")]
    taken = {n for n, _ in nested}
    out = []
    for image, folder in nested + [(n, f"{base}/{n}") for n in _folders(store, base) if n != "images" and n not in taken]:
        for name in ("data", "X"):
            if (meta := _json(store, f"{folder}/{name}/.zarray")) is not None:
                out.append({"image": image, "folder": f"{folder}/{name}", "meta": meta})
                break
    return sorted(out, key=lambda a: a["image"])


class Chunks(InputPartition):
    """Blocks of chunks: (image, folder, description, place of the block)."""

    def __init__(self, blocks: list[tuple]):
        self.blocks = blocks


def _pixels(meta: dict, place: tuple[int, ...]) -> np.ndarray:
    """Numbers of the pixels of a block of chunks, those beyond the array -1."""
    if len(meta["shape"]) == 2:
        px = place[0] * meta["chunks"][0] + np.arange(meta["chunks"][0])
        return np.where(px < meta["shape"][0], px, -1)
    (height, width, _), (h, w, _) = meta["shape"], meta["chunks"]
    row, col = place[0] * h + np.arange(h)[:, None], place[1] * w + np.arange(w)
    return np.where((row < height) & (col < width), row * width + col, -1).ravel()


def _decoded(data: bytes, meta: dict) -> bytes:
    kind = (meta.get("compressor") or {"id": None})["id"]
    if kind is None:
        return data
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"chunks are compressed by {kind!r}; known: None, zlib, gzip, zstd")


def _block(store: fs.FileSystem, folder: str, meta: dict, place: tuple[int, ...]) -> np.ndarray:
    """Spectra (pixels, channels) of all channel chunks at one place."""
    if meta.get("filters"):
        raise ValueError("arrays with filters are not read")
    kind, chunks, shape = np.dtype(meta["dtype"]), meta["chunks"], meta["shape"]
    parts = []
    for band in range(math.ceil(shape[-1] / chunks[-1])):
        name = meta.get("dimension_separator", ".").join(map(str, (*place, band)))
        try:
            with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                part = np.frombuffer(_decoded(f.read(), meta), kind).reshape(chunks, order=meta.get("order", "C"))
        except FileNotFoundError:
            fill = meta.get("fill_value")
            part = np.full(chunks, float("nan" if fill is None else fill), kind)
        parts.append(part.reshape(-1, chunks[-1]))
    return np.concatenate(parts, axis=1)[:, : shape[-1]].astype(float)


class ArrayStoreReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.images, self.low, self.high, self.names = path, None, 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "px" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            elif column == "image" and isinstance(f, (EqualTo, In)):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.names = wanted if self.names is None else self.names & wanted
            else:
                yield f

    def _allowed(self, px: np.ndarray) -> np.ndarray:
        return (px >= max(0, self.low)) & (px < self.high) if self.high is not None else px >= max(0, self.low)

    def partitions(self) -> list[Chunks]:
        out, blocks, size = [], [], 0
        for a in arrays(self.path):
            meta = a["meta"]
            if self.names is not None and a["image"] not in self.names:
                continue
            own = 8 * math.prod(meta["chunks"][:-1]) * meta["shape"][-1]
            for place in itertools.product(*[range(math.ceil(s / c)) for s, c in zip(meta["shape"][:-1], meta["chunks"][:-1], strict=True)]):
                if not self._allowed(_pixels(meta, place)).any():
                    continue
                if blocks and size + own > PARTITION_BYTES:
                    out, blocks, size = [*out, Chunks(blocks)], [], 0
                blocks, size = [*blocks, (a["image"], a["folder"], meta, place)], size + own
        return [*out, Chunks(blocks)] if blocks else out or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.path)
        for image, folder, meta, place in partition.blocks:
            px, x = _pixels(meta, place), _block(store, folder, meta, place)
            kept = np.flatnonzero(self._allowed(px))
            for k in range(0, len(kept), ROWS):
                some = kept[k : k + ROWS]
                yield pa.RecordBatch.from_pydict({"image": pa.array([image] * len(some)), "px": pa.array(px[some], pa.int64()), "x": pa.array(list(x[some]), pa.list_(pa.float64()))})


class ArrayStore(DataSource):
    """``spark.read.format("arraystore").load(path)``: (image, px, x)."""

    @classmethod
    def name(cls) -> str:
        return "arraystore"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayStoreReader:
        return ArrayStoreReader(self.options["path"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(image, px, x) of all images; turns the session's pushing of filters into
    Python sources on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayStore)
    return spark.read.format("arraystore").load(path)


def write_store(rows: DataFrame, path: str, attrs: dict | None = None, chunk: int = CHUNK, level: int = 1) -> None:
    """Write spectra (image, px, x) as arrays ``X`` under ``images``; the pixels
    of an image are numbered from 0 without gaps, and its spectra have one
    length, which are checked.  Each chunk is written by the task that has its
    pixels; a second attempt writes the same bytes."""
    store, base = _place(path)
    counts = rows.groupBy(F.col("image").cast("string").alias("image")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("px").alias("different"), F.min("px").alias("low"), F.max("px").alias("high"), F.min(F.size("x")).alias("k"), F.max(F.size("x")).alias("most"))
    odd = counts.filter("low != 0 or high != n - 1 or different != n or k != most or k <= 0").limit(10).collect()
    if odd:
        raise ValueError(f"images {[r['image'] for r in odd]} have gaps, repeated pixels or spectra of several lengths")
    store.create_dir(f"{base}/images")
    for folder, found in ((base, attrs or {}), (f"{base}/images", {})):
        for name, content in ((".zgroup", {"zarr_format": 2}), (".zattrs", found)):
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(json.dumps(content).encode())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _place(path)
        for batch in batches:
            for image, n, k in zip(*(batch.column(c).to_pylist() for c in ("image", "n", "k")), strict=True):
                files.create_dir(f"{base}/images/{image}/X")
                meta = {"zarr_format": 2, "shape": [n, k], "chunks": [chunk, k], "dtype": "<f8", "order": "C", "fill_value": 0.0, "filters": None, "compressor": {"id": "zlib", "level": level}}
                for name, content in ((".zgroup", {"zarr_format": 2}), ("X/.zarray", meta)):
                    with files.open_output_stream(f"{base}/images/{image}/{name}") as f:
                        f.write(json.dumps(content).encode())
            yield batch.select(["image"])

    def put(group: pa.Table) -> pa.Table:
        files, _ = _place(path)
        group = group.sort_by("px")
        image, place = group["image"][0].as_py(), group["c"][0].as_py()
        x = group["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(group), -1)
        whole = np.zeros((chunk, x.shape[1]), "<f8")
        whole[: len(x)] = x
        with files.open_output_stream(f"{base}/images/{image}/X/{place}.0", compression=None) as f:
            f.write(zlib.compress(whole.tobytes(), level))
        return group.select(["image"]).slice(0, 1)

    counts.select("image", "n", "k").mapInArrow(describe, "image string").count()
    dealt = rows.select(F.col("image").cast("string").alias("image"), F.expr(f"px div {chunk}").alias("c"), "px", F.col("x").cast("array<double>").alias("x"))
    dealt.groupBy("image", "c").applyInArrow(put, "image string").count()
