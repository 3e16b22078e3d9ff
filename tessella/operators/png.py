"""PNG files with the chosen filter of each row, compressed by bands that know one row above.

Filters need the row above, which neighbours bring along, so bands are filtered and
compressed apart: each is a raw deflate stream that ends on a byte boundary, in a chunk
with a check sum of its own. The check sum over all rows is put together from those of
the bands. Only compressed bands meet in one row, the file. Bands have a fixed number of
rows, so a file doesn't depend on how its pixels were spread over tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.tables import PNG
from tessella.operators.lines import png_residuals, png_restored
from tessella.operators.pixels import RGBA

#: Rows of a band; modulus of the check sum over all rows, a fixed value.
BAND, ADLER = 64, 65_521
BANDS = "image_id long, band int, width int, rows int, chunk binary, adler long, size long"


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def joined_adler(first: int, second: int, size: int) -> int:
    """The check sum of two parts, the second of ``size`` bytes, from those of the parts."""
    a, b = first & 0xFFFF, first >> 16
    c, d = second & 0xFFFF, second >> 16
    return (b + d + size % ADLER * (a - 1)) % ADLER << 16 | (a + c - 1) % ADLER


def compressed_bands(pixels: DataFrame, level: int = 6, band: int = BAND) -> DataFrame:
    """A row for each band of each image (columns BANDS): its chunk, the check sum and the size of its filtered rows."""
    if not 0 <= level <= 9:
        raise ValueError("a level is 0 to 9")

    def run(key, table):
        image, number = (k.as_py() for k in key)
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        order = np.lexsort((x, y))
        width = int(x.max()) + 1
        rows = len(order) // width
        body = np.stack([table.column(c).to_numpy()[order] for c in RGBA], axis=1).astype(np.uint8).reshape(rows, width * 4)
        kinds = table.column("filter").to_numpy()[order][::width].astype(np.uint8)
        raw = np.concatenate([kinds[:, None], body], axis=1).tobytes()
        pack = zlib.compressobj(level, zlib.DEFLATED, -15)
        data = (b"\x78\x9c" if number == 0 else b"") + pack.compress(raw) + pack.flush(zlib.Z_SYNC_FLUSH)
        values = [(image, pa.int64()), (number, pa.int32()), (width, pa.int32()), (rows, pa.int32()), (chunk(b"IDAT", data), pa.binary()), (zlib.adler32(raw), pa.int64()), (len(raw), pa.int64())]
        return pa.table({c: pa.array([v], t) for c, (v, t) in zip((f.split(" ")[0] for f in BANDS.split(", ")), values)})

    seen = png_residuals(pixels).select(F.col("image_id").cast("long").alias("image_id"), F.expr(f"y div {band}").cast("int").alias("band"), "y", "x", "filter", *RGBA)
    return seen.groupBy("image_id", "band").applyInArrow(run, BANDS)


def write_png_filtered(pixels: DataFrame, level: int = 6, band: int = BAND) -> DataFrame:
    """image_id, width, height, content: an 8-bit RGBA file of each image."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("band")
        total, width, height = 1, int(frame["width"].iloc[0]), int(frame["rows"].sum())
        for adler, size in zip(frame["adler"].tolist(), frame["size"].tolist()):
            total = joined_adler(total, adler, size)
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))
        # an empty last block ends the stream
        tail = chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total)) + chunk(b"IEND", b"")
        content = b"".join([PNG, head, *map(bytes, frame["chunk"]), tail])
        return pd.DataFrame({"image_id": [frame["image_id"].iloc[0]], "width": [width], "height": [height], "content": [content]})

    return compressed_bands(pixels, level, band).groupBy("image_id").applyInPandas(join, "image_id long, width int, height int, content binary")


def _inflated(content: bytes) -> tuple[int, int, bytes] | None:
    """(width, height, filtered rows) of an 8-bit RGBA file without interlacing, checked by its sums; None for others."""
    data, at, size, parts = content, len(PNG), None, []
    try:
        while at < len(data):
            n, name = struct.unpack_from(">I4s", data, at)
            body = data[at + 8 : at + 8 + n]
            if zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
                return None
            if name == b"IHDR":
                size = struct.unpack(">IIBBBBB", body)
            elif name == b"IDAT":
                parts.append(body)
            at += 12 + n
        if size is None or size[2:] != (8, 6, 0, 0, 0):
            return None
        raw = zlib.decompress(b"".join(parts))
    except (struct.error, zlib.error):
        return None
    return (*size[:2], raw) if len(raw) == size[1] * (size[0] * 4 + 1) else None


def read_png_filtered(files: DataFrame) -> DataFrame:
    """Pixels of 8-bit RGBA PNG files without interlacing (image_id, content); other files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, content in zip(batch.column("image_id").to_pylist(), batch.column("content").to_pylist()):
                found = _inflated(bytes(content)) if content and content.startswith(PNG) else None
                if found is None:
                    continue
                width, height, raw = found
                grid = np.frombuffer(raw, np.uint8).reshape(height, width * 4 + 1)
                many = max(1, (1 << 18) // width)
                for y in range(0, height, many):
                    part = grid[y : y + many]
                    rows = len(part)
                    body = part[:, 1:].reshape(-1, 4).astype(np.int32)
                    columns = [pa.array(np.full(rows * width, image)), np.repeat(np.arange(y, y + rows, dtype=np.int32), width), np.tile(np.arange(width, dtype=np.int32), rows), np.repeat(part[:, 0].astype(np.int32), width), *body.T]
                    yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["image_id", "y", "x", "filter", *RGBA])

    seen = files.select(F.col("image_id").cast("long").alias("image_id"), "content")
    return png_restored(seen.mapInArrow(run, "image_id long, y int, x int, filter int, " + ", ".join(f"{c} int" for c in RGBA)))
