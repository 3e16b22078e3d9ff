"""Rasters as a data source: ``spark.read.format("raster")``, ``readStream`` and ``write``.

Call ``register(spark)`` once. A row is a pixel: path, format, width, height, y, x,
r, g, b, a. Files are uncompressed BMP, TGA and TIFF, the same as ``files.read_*``
reads; what can't be read is left out, or is an error with ``mode`` FAILFAST.

Reading: the driver lists names and lengths only. Small files share a partition,
large ones are cut into ranges of ``splitBytes``; the task of a range reads the
header and then just the lines that begin in its range. Filters on path, format,
width, height and y are pushed down (``spark.sql.python.filterPushdown.enabled``):
on path before a partition is made, on the header before pixels are read, on y
before a line is read.

Writing: rows (image_id, content) become a file each in a folder of the task's own;
the names of those folders are what a task hands to the driver, which writes one
manifest. A reader that finds manifests reads only folders that they name, so files
of failed or repeated attempts are never seen. ``kind`` gives the ending.

Streams: the offset is the time of change up to which files were seen; files younger
than ``settleMs`` wait, so that none with the same time comes later.
"""

from __future__ import annotations

import json
import operator
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from tessella.sources.shared import file_system

#: What opening a file costs, in bytes that could be read instead.
OPEN = 256 << 10
SCHEMA = "path string, format string, width int, height int, y int, x int, r int, g int, b int, a int"
ARROW = pa.schema([("path", pa.string()), ("format", pa.string())] + [(c, pa.int32()) for c in ("width", "height", "y", "x", *"rgba")])
#: Bytes of a header that are read first; pixels of a batch; columns whose filters are pushed.
HEAD, BATCH_PIXELS = 4096, 1 << 18
PUSHED = ("path", "format", "width", "height", "y")
MANIFEST = "_committed_"
# fixed values: channel masks of the 32-bit bitmaps that are read
MASKS = bytes.fromhex("0000FF0000FF0000FF000000000000FF")
COMPARED = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


class Unreadable(ValueError):
    """Why a file gives no pixels."""


@dataclass
class Layout:
    """Where the lines of a file lie: the line y begins at ``at + stride * row`` for its row in the file."""

    format: str
    width: int
    height: int
    at: int
    stride: int
    order: str
    size: int
    bottom_up: bool = False
    mirrored: bool = False

    def row(self, y: int) -> int:
        return self.height - 1 - y if self.bottom_up else y


def _bmp(data: bytes) -> Layout:
    at, _, w, h, _, bits, coding = struct.unpack_from("<IIiiHHI", data, 10)
    if not (bits == 24 and coding == 0 or bits == 32 and (coding == 0 or coding == 3 and data[54:70] == MASKS)):
        raise Unreadable("no reader for this bmp")
    return Layout("bmp", w, abs(h), at, (w * bits // 8 + 3) // 4 * 4, "bgra", bits // 8, bottom_up=h > 0)


def _tga(data: bytes) -> Layout:
    w, h, depth, flags = struct.unpack_from("<HHBB", data, 12)
    if (data[2], depth) not in ((2, 24), (2, 32), (3, 8)):
        raise Unreadable("no reader for this tga")
    return Layout("tga", w, h, 18 + data[0], w * depth // 8, "bgra", depth // 8, bottom_up=not flags & 32, mirrored=bool(flags & 16))


def _tiff(data: bytes, read) -> Layout:
    if data[:4] != b"II*\0":
        raise Unreadable("no reader for this tiff")
    at = struct.unpack_from("<I", data, 4)[0]
    n = struct.unpack("<H", read(at, 2))[0]
    entries = {}
    for tag, kind, count, value in struct.iter_unpack("<HHII", read(at + 2, 12 * n)):
        entries[tag] = count, value & 0xFFFF if kind == 3 and count <= 2 else value
    one = lambda tag, default=(1, None): entries.get(tag, default)[1]
    count, depth = entries.get(258, (1, 1))
    if count > 2:
        depth = struct.unpack("<H", read(depth, 2))[0]
    if (one(259, (1, 1)), one(277), depth, one(262), entries.get(273, (0, 0))[0]) != (1, 4, 8, 2, 1) or not one(256) or not one(257):
        raise Unreadable("no reader for this tiff")
    return Layout("tiff", one(256), one(257), one(273), one(256) * 4, "rgba", 4)


def layout(data: bytes, length: int, read, max_pixels: int) -> Layout:
    """The layout of a file by its first bytes; ``read(at, n)`` gives others."""
    try:
        if data[:2] == b"BM":
            found = _bmp(data)
        elif data[:2] in (b"II", b"MM"):
            found = _tiff(data, read)
        elif len(data) >= 18 and data[2] in (1, 2, 3, 9, 10, 11):
            found = _tga(data)
        else:
            raise Unreadable("unknown format")
    except (struct.error, IndexError):
        raise Unreadable("truncated header") from None
    if found.width <= 0 or found.height <= 0:
        raise Unreadable("empty image")
    if found.width * found.height > max_pixels:
        raise Unreadable("over budget")
    if found.at + found.stride * found.height > length:
        raise Unreadable("truncated pixels")
    return found


def passes(tests: list[tuple[str, type, object]], values: dict) -> bool:
    """Do known values pass the filters on them?"""
    return all(name not in values or (values[name] in value if kind is ds.In else COMPARED[kind](values[name], value)) for name, kind, value in tests)


class Options:
    def __init__(self, given):
        self.path = given.get("path")
        if not self.path:
            raise ValueError("a raster source needs a path")
        self.split = int(given.get("splitBytes", 64 << 20))
        self.max_pixels = int(given.get("maxPixels", 100_000_000))
        self.strict = given.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.kind = given.get("kind", "bmp")
        self.settle = int(given.get("settleMs", 1000))

    def listed(self) -> list[tuple[str, int, float]]:
        """(path, bytes, time of change) of all files; of committed ones only where there are manifests."""
        files, where = file_system(self.path)
        found = [f for f in files.get_file_info(pafs.FileSelector(where, recursive=True, allow_not_found=True)) if f.type == pafs.FileType.File]
        folders = set()
        for f in found:
            if f.base_name.startswith(MANIFEST):
                with files.open_input_stream(f.path) as one:
                    folders |= set(json.loads(one.read())["folders"])
        seen = [f for f in found if not f.base_name.startswith(("_", ".")) and (not folders or f.path.rsplit("/", 2)[-2] in folders)]
        return sorted((f.path, f.size, f.mtime.timestamp() if f.mtime else 0.0) for f in seen)


@dataclass
class Ranges(ds.InputPartition):
    """Byte ranges of files: (path, begin, end, length)."""

    ranges: list[tuple[str, int, int, int]]


def ranges(found: list[tuple[str, int, float]], split: int) -> list[Ranges]:
    """Partitions of about ``split`` bytes; a file counts for OPEN bytes more, as many small ones take their time."""
    out, held, size = [], [], 0
    for path, length, _ in found:
        for begin in range(0, max(length, 1), split):
            end = min(length, begin + split)
            held.append((path, begin, end, length))
            size += end - begin + OPEN
            if size >= split:
                out.append(Ranges(held))
                held, size = [], 0
    return [*out, Ranges(held)] if held else out


class _Pixels:
    """Reads partitions, in batches and in streams."""

    def __init__(self, options: Options):
        self.options, self.tests = options, []

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """Small files leave together."""
        held, n = [], 0
        for batch in self._batches(partition):
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH_PIXELS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def _batches(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.options.path)
        for path, begin, end, length in partition.ranges:
            with files.open_input_file(path) as f:

                def at(place: int, n: int, f=f, length=length) -> bytes:
                    if place > length:
                        return b""
                    f.seek(place)
                    return f.read(n)

                try:
                    shape = layout(at(0, HEAD), length, at, self.options.max_pixels)
                except Unreadable as e:
                    if self.options.strict:
                        raise ValueError(f"{path}: {e}") from None
                    continue
                if passes(self.tests, {"path": path, "format": shape.format, "width": shape.width, "height": shape.height}):
                    yield from self._lines(path, shape, begin, end, at)

    def _lines(self, path: str, shape: Layout, begin: int, end: int, at) -> Iterator[pa.RecordBatch]:
        # the first range also has lines that begin before it, as pixels may not
        first = max(0, -(-(begin - shape.at) // shape.stride)) if begin else 0
        last = min(shape.height, max(0, -(-(end - shape.at) // shape.stride)))
        rows = [row for row in range(first, last) if passes(self.tests, {"y": shape.row(row)})]
        many = max(1, BATCH_PIXELS // shape.width)
        for k in range(0, len(rows), many):
            part = rows[k : k + many]
            # wanted lines that stand together are read together
            runs = np.split(part, np.flatnonzero(np.diff(part) != 1) + 1)
            raw = b"".join(at(shape.at + int(r[0]) * shape.stride, len(r) * shape.stride) for r in runs)
            grid = np.frombuffer(raw, np.uint8).reshape(len(part), shape.stride)[:, : shape.width * shape.size].reshape(len(part), shape.width, shape.size)
            grid = grid[:, ::-1] if shape.mirrored else grid
            n, size = len(part) * shape.width, shape.size
            channel = {c: grid[:, :, shape.order.index(c) if size > 1 else 0].ravel() if size == 4 or c != "a" else np.full(n, 255) for c in "rgba"}
            y = np.repeat([shape.row(row) for row in part], shape.width)
            values = {"width": np.full(n, shape.width), "height": np.full(n, shape.height), "y": y, "x": np.tile(np.arange(shape.width), len(part))} | channel
            constant = [pa.array([v], pa.string()).take(pa.array(np.zeros(n, np.int64))) for v in (path, shape.format)]
            yield pa.RecordBatch.from_arrays([*constant, *(pa.array(v.astype(np.int32)) for v in values.values())], schema=ARROW)


class RasterReader(_Pixels, ds.DataSourceReader):
    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in PUSHED and (type(f) in COMPARED or isinstance(f, ds.In)):
                self.tests.append((name, type(f), f.value))
            elif not (name in PUSHED and isinstance(f, ds.IsNotNull)):
                yield f

    def partitions(self):
        found = [f for f in self.options.listed() if passes(self.tests, {"path": f[0]})]
        return ranges(found, self.options.split)


class RasterStream(_Pixels, ds.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        before = time.time() - self.options.settle / 1000
        return {"until": max((t for _, _, t in self.options.listed() if t <= before), default=0.0)}

    def partitions(self, start: dict, end: dict):
        return ranges([f for f in self.options.listed() if start["until"] < f[2] <= end["until"]], self.options.split)


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str
    files: int


class RasterWriter(ds.DataSourceWriter):
    def __init__(self, options: Options, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def write(self, rows) -> Written:
        files, where = file_system(self.options.path)
        folder, n = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0
        for row in rows:
            if not n:
                files.create_dir(f"{where}/{folder}", recursive=True)
            # repeated ids don't replace each other
            with files.open_output_stream(f"{where}/{folder}/{row['image_id']}-{n}.{self.options.kind}", compression=None) as out:
                out.write(row["content"] or b"")
            n += 1
        return Written(folder, n)

    def commit(self, messages) -> None:
        files, where = file_system(self.options.path)
        old = [f.path for f in files.get_file_info(pafs.FileSelector(where, allow_not_found=True))] if self.overwrite else []
        files.create_dir(where, recursive=True)
        made = [m for m in messages if m is not None and m.files]
        with files.open_output_stream(f"{where}/{MANIFEST}{self.job}.json") as out:
            out.write(json.dumps({"folders": [m.folder for m in made], "files": sum(m.files for m in made)}).encode())
        kept = {f"{where}/{m.folder}" for m in made}
        for path in old:
            if path in kept:
                continue
            if files.get_file_info(path).type == pafs.FileType.Directory:
                files.delete_dir(path)
            else:
                files.delete_file(path)

    def abort(self, messages) -> None:
        files, where = file_system(self.options.path)
        for m in messages:
            if m is not None and m.files:
                files.delete_dir(f"{where}/{m.folder}")


class RasterSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(Options(self.options))

    def streamReader(self, schema) -> RasterStream:
        return RasterStream(Options(self.options))

    def writer(self, schema, overwrite: bool) -> RasterWriter:
        return RasterWriter(Options(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format ``raster`` known and lets filters be pushed into it."""
    spark.dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
