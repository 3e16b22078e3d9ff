"""Banded PNG files: one file whatever the tasks, readable by plain inflation, and back to pixels."""

import random
import struct
import zlib

import pytest

from tessella.operators import files, png

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"


@pytest.fixture(scope="module")
def images(spark):
    r = random.Random(4)
    sizes = {1: (1, 1), 2: (7, 130), 3: (40, 64), 4: (3, 65)}
    data = {i: {(y, x): tuple(r.choice((0, 255, x * 5 % 256, r.randrange(256))) for _ in range(4)) for y in range(h) for x in range(w)} for i, (w, h) in sizes.items()}
    return data, [(i, y, x, *v) for i, p in data.items() for (y, x), v in p.items()]


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = (r.r, r.g, r.b, r.a)
    return out


@pytest.mark.parametrize("level", [0, 6, 9])
def test_files_are_the_same_for_any_number_of_tasks(spark, images, level):
    data, rows = images
    made = []
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, PIXELS).repartition(parts)
        made.append({r.image_id: bytes(r.content) for r in png.write_png_filtered(df, level).collect()})
    assert made[0] == made[1] == made[2] and made[0].keys() == data.keys()
    for i, content in made[0].items():
        at, body, names = 8, b"", []
        while at < len(content):
            n, name = struct.unpack_from(">I4s", content, at)
            assert struct.unpack_from(">I", content, at + 8 + n)[0] == zlib.crc32(content[at + 4 : at + 8 + n])
            body += content[at + 8 : at + 8 + n] if name == b"IDAT" else b""
            names.append(name)
            at += 12 + n
        height = max(y for y, _ in data[i]) + 1
        # inflation checks the sum over all rows
        assert len(zlib.decompress(body)) == len(data[i]) * 4 + height
        assert names == [b"IHDR"] + [b"IDAT"] * (-(-height // 64) + 1) + [b"IEND"]


def test_pixels_come_back(spark, images):
    data, rows = images
    made = png.write_png_filtered(spark.createDataFrame(rows, PIXELS).repartition(3))
    assert back(png.read_png_filtered(made)) == data
    # stored files of the other writer, and damaged ones
    stored = files.write_png(spark.createDataFrame(rows, PIXELS)).select("image_id", "content")
    assert back(png.read_png_filtered(stored)) == data
    good = bytes(made.where("image_id = 3").first().content)
    bad = [(1, bytearray(good[:-30])), (2, bytearray(good[:60] + b"\1" + good[61:])), (3, bytearray(b"GIF89a")), (4, None), (5, bytearray(good[:8]))]
    assert png.read_png_filtered(spark.createDataFrame(bad, "image_id long, content binary")).count() == 0


def test_sums_of_parts():
    r = random.Random(1)
    for _ in range(200):
        a, b = (bytes(r.choices(range(256), k=r.choice((0, 1, 5000, 70000)))) for _ in range(2))
        assert png.joined_adler(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
    with pytest.raises(ValueError, match="level"):
        png.compressed_bands(None, 10)
