"""Table functions for SQL: chunks and pixels of files.

    SELECT * FROM image_chunks(TABLE(files) PARTITION BY image_id)
    SELECT * FROM image_pixels(TABLE(files) PARTITION BY (image_id), 1000000)

``files`` has image_id and content, and may have more columns. Each file is one call, so
rows of one image_id are separate files and nothing is held between them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from tessella.sources import datasource

PNG = b"\x89PNG\r\n\x1a\n"
# schemas of types, as no session is at hand where a function is analysed
CHUNKS = StructType().add("image_id", LongType()).add("n", IntegerType()).add("name", StringType()).add("size", LongType()).add("ok", BooleanType())
PIXELS = StructType().add("image_id", LongType()).add("format", StringType())
for _c in ("y", "x", *"rgba"):
    PIXELS = PIXELS.add(_c, IntegerType())


def _checked(table: AnalyzeArgument, schema: StructType) -> AnalyzeResult:
    """The schema of the result, if the table has what is needed."""
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    types = {f.name: f.dataType.simpleString() for f in table.dataType.fields}
    missing = [c for c, t in (("image_id", ("bigint", "int")), ("content", ("binary",))) if types.get(c) not in t]
    if missing:
        raise ValueError(f"the table needs image_id and content; wrong or missing: {', '.join(missing)}")
    return AnalyzeResult(schema=schema)


def png_chunks(data: bytes) -> Iterator[tuple[int, str, int, bool]]:
    """(number, name, size, whether the check sum holds) of the chunks of a PNG file, up to its end or the first one that is cut; other files have none."""
    at, n = len(PNG), 0
    while data.startswith(PNG) and at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        end = at + 8 + size
        if end + 4 > len(data):
            break
        yield n, name.decode("latin-1"), size, zlib.crc32(data[at + 4 : end]) == struct.unpack_from(">I", data, end)[0]
        at, n = end + 4, n + 1
        if name == b"IEND":
            break


class ImageChunks:
    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return _checked(table, CHUNKS)

    def eval(self, table) -> Iterator[tuple]:
        for chunk in png_chunks(bytes(table["content"] or b"")):
            yield table["image_id"], *chunk


class ImagePixels:
    @staticmethod
    def analyze(table: AnalyzeArgument, budget: AnalyzeArgument | None = None) -> AnalyzeResult:
        if budget is not None and not budget.isConstantExpression:
            raise ValueError("the budget of pixels must be a constant")
        return _checked(table, PIXELS)

    def eval(self, table, budget: int = 100_000_000) -> Iterator[tuple]:
        """The pixels of a raw bitmap, TGA or TIFF; other files have none."""
        data = bytes(table["content"] or b"")
        try:
            shape = datasource.layout(data[: datasource.HEAD], len(data), lambda at, n: data[at : at + n], int(budget))
        except datasource.Unreadable:
            return
        order = shape.order if shape.size == 4 else shape.order[: shape.size]
        for y in range(shape.height):
            start = shape.at + shape.row(y) * shape.stride
            for i in range(shape.width):
                pixel = data[start + i * shape.size : start + (i + 1) * shape.size]
                value = dict(zip(order, pixel)) if shape.size > 1 else dict.fromkeys("rgb", pixel[0])
                yield table["image_id"], shape.format, y, shape.width - 1 - i if shape.mirrored else i, *(value[c] for c in "rgb"), value.get("a", 255)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL."""
    for name, of in (("image_chunks", ImageChunks), ("image_pixels", ImagePixels)):
        spark.udtf.register(name, udtf(of, useArrow=True))
