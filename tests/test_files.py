"""Readers, writers, signatures and budgets."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.functions.binary import image_format, uint
from tessella.operators import files, pixels
from tessella.sources import rasters


@pytest.fixture
def small(spark):
    return spark.createDataFrame([(1, y, x, 10 * x, 20 * y, x ^ y, 255 - x) for y in range(3) for x in range(5)], "image_id long, y int, x int, r int, g int, b int, a int")


@pytest.mark.parametrize("kind", ["bmp", "tga", "tiff"])
def test_roundtrip_does_not_depend_on_partitions(small, kind):
    write, read = getattr(files, f"write_{kind}"), getattr(files, f"read_{kind}")
    want = sorted(map(tuple, small.collect()))
    for n in (1, 7):
        got = read(write(small.repartition(n)).select("image_id", "content"))
        assert sorted(map(tuple, got.select(*small.columns).collect())) == want


def test_png_is_valid(small):
    data = bytes(files.write_png(small).first()["content"])
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        assert struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] == zlib.crc32(data[at + 4 : at + 8 + size])
        body += data[at + 8 : at + 8 + size] if name == b"IDAT" else b""
        at += 12 + size
    raw = zlib.decompress(body)
    assert len(raw) == 3 * 21 and raw[0] == 0 and raw[1:5] == bytes([0, 0, 0, 255])


def test_png_of_many_stored_blocks(spark):
    n = 3 * 65535 // 1204 + 1
    tall = spark.range(n * 300).selectExpr("1L as image_id", "cast(id div 300 as int) as y", "cast(id % 300 as int) as x", "cast(id % 251 as int) as r", "cast(id % 13 as int) as g", "cast(id div 300 % 256 as int) as b", "255 as a")
    data = bytes(files.write_png(tall).first()["content"])
    rows = files.chunks(files.write_png(tall).select("image_id", "content")).orderBy("n").collect()
    assert [(r["name"], r["ok"]) for r in rows] == [("IHDR", True), ("IDAT", True), ("IEND", True)]
    size = rows[1]["size"]
    raw = zlib.decompress(data[41 : 41 + size])
    want = b"".join(b"\0" + b"".join(bytes([(y * 300 + x) % 251, (y * 300 + x) % 13, y % 256, 255]) for x in range(300)) for y in range(n))
    assert raw == want and size == 6 + 4 * 5 + len(want)


def test_chunk_walk_reaches_the_end(spark):
    piece = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    data = b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", bytes(13)) + b"".join(piece(b"IDAT", bytes(k % 3)) for k in range(300)) + piece(b"IEND", b"")
    rows = files.chunks(spark.createDataFrame([(1, data)], "image_id long, content binary")).orderBy("n").collect()
    assert [r["name"] for r in rows] == ["IHDR"] + ["IDAT"] * 300 + ["IEND"] and all(r["ok"] for r in rows)


def test_png_chunks_notice_damage(spark, small):
    data = bytearray(files.write_png(small).first()["content"])
    data[20] ^= 1
    rows = files.chunks(spark.createDataFrame([(1, bytes(data))], "image_id long, content binary")).orderBy("n").collect()
    assert [r["ok"] for r in rows] == [False, True, True]


def test_signatures_and_integers(spark):
    df = spark.createDataFrame([(b"BM\x01\x02\x03\x04",), (b"",), (b"RIFF0000WEBP",), (b"RIFF0000WAVE",)], "content binary")
    got = df.select(image_format("content").alias("f"), uint("content", 2, 4).alias("le"), uint("content", 2, 2, little=False).alias("be")).collect()
    assert [r["f"] for r in got] == ["bmp", None, "webp", None]
    assert got[0]["le"] == 0x04030201 and got[0]["be"] == 0x0102 and got[1]["le"] is None


def test_budget_is_below_the_reader(small):
    seen = files.inspect(files.write_bmp(small).select("image_id", "content"))
    assert files.within_budget(seen, max_pixels=14).count() == 0
    assert files.within_budget(seen, max_pixels=15).count() == 1


def test_nearest_palette_prefers_the_lowest_index(spark):
    p = spark.createDataFrame([(1, 0, 0, 8, 8, 8, 255)], "image_id long, y int, x int, r int, g int, b int, a int")
    assert pixels.nearest_palette(p, [(0, 0, 0), (16, 16, 16)]).first()["entry"] == 0


def test_filters_reach_the_scan(spark, sf_dir):
    plan = rasters.table(spark, sf_dir, "lineitem").where(F.col("l_suppkey") == 3).select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in plan


def test_files_stream_once(spark, tmp_path):
    from tessella.streaming.ingest import file_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bmp").write_bytes(b"BM" + bytes(60))
    q = file_stream(spark, str(tmp_path / "in")).select("length", image_format("content").alias("f")).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("arrived").collect()] == [(62, "bmp")]


def test_text_bytes_are_of_whole_texts(spark, tmp_path):
    from tessella.plans.queries import QUERIES

    texts = {1: "ab", 2: "", 3: None, 4: "é" * 200, 5: "é" * 200 + "x", 6: "".join(chr(33 + k * k % 90) for k in range(33047))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    raw = {k: t.encode() for k, t in texts.items() if t}
    got = {tuple(r) for r in QUERIES["raster_r4"](spark, str(tmp_path)).collect()}
    assert got == {(k, x, v) for k, b in raw.items() for x, v in enumerate(b)}
    got = {tuple(r) for r in QUERIES["byte_delta"](spark, str(tmp_path)).collect()}
    dealt = {k: b[::2] + b[1::2] for k, b in raw.items()}
    assert got == {(k, x, (v - b[x - 1] + 128) % 256 if x else v) for k, b in dealt.items() for x, v in enumerate(b)}


def test_metadata_walks_and_damage(spark):
    from tessella.operators.metadata import inspect_metadata

    piece = lambda name, data: struct.pack(">I", len(data)) + name + data + bytes(4)
    ihdr = piece(b"IHDR", struct.pack(">IIBBBBB", 70, 30, 16, 6, 0, 0, 0))
    phys, xmp = piece(b"pHYs", struct.pack(">IIB", 2835, 5669, 1)), piece(b"iTXt", b"XML:com.adobe.xmp\0\0\0en\0\0<x/>")
    png = b"\x89PNG\r\n\x1a\n" + ihdr + phys + xmp + piece(b"eXIf", b"II*\0") + piece(b"IDAT", b"x" * 99_999) + piece(b"IEND", b"")
    entry = lambda tag, kind, n, value: struct.pack(">HHII", tag, kind, n, value)
    tiff = b"MM\0*" + struct.pack(">IH", 8, 5) + entry(256, 3, 1, 9 << 16) + entry(257, 4, 1, 5) + entry(262, 3, 1, 8 << 16) + entry(282, 5, 1, 74) + entry(296, 3, 1, 3 << 16) + bytes(4) + struct.pack(">II", 100, 1)
    vp8l = b"RIFF" + struct.pack("<I", 18) + b"WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 299 | 199 << 14) + b"\0"
    jpeg = b"\xff\xd8\xff\xff\xe2" + struct.pack(">H", 2 + 14 + 3) + b"ICC_PROFILE\0\1\1abc" + b"\xff\xc2" + struct.pack(">HBHHB", 8 + 12, 12, 40, 50, 4) + bytes(12) + b"\xff\xda"
    rows = [(1, png), (2, tiff), (3, vp8l), (4, jpeg), (5, png[:60]), (6, jpeg[:12]), (7, b""), (8, vp8l[:-2]), (9, None), (10, tiff[:30])]
    got = {r["image_id"]: r for r in inspect_metadata(spark.createDataFrame(rows, "image_id long, content binary")).collect()}
    assert (got[1]["width"], got[1]["height"], got[1]["bits"], got[1]["exif_bytes"], got[1]["xmp_bytes"]) == (70, 30, 16, 4, 4)
    assert abs(got[1]["ppi_x"] - 72.009) < 1e-3 and abs(got[1]["ppi_y"] - 143.9926) < 1e-3
    assert (got[2]["width"], got[2]["height"], got[2]["bits"], got[2]["model"], got[2]["ppi_x"], got[2]["orientation"]) == (9, 5, 1, "lab", 254.0, 1)
    assert (got[3]["width"], got[3]["height"]) == (300, 200)
    assert (got[4]["width"], got[4]["height"], got[4]["bits"], got[4]["model"], got[4]["icc_bytes"]) == (50, 40, 12, "cmyk", 3)
    assert all(got[k]["error"] and got[k]["width"] is None for k in range(5, 11)) and not any(got[k]["error"] for k in range(1, 5))


def test_tga_is_told_by_its_lengths(spark):
    foot = bytes(8) + b"TRUEVISION-XFILE.\0"
    head = lambda kind, w, h, depth, has_map=0, n=0, entry=0: struct.pack("<BBBHHBHHHHBB", 0, has_map, kind, 0, n, entry, 0, 0, w, h, depth, 0)
    cases = [(foot[8:], None), (foot, "tga"), (head(10, 4, 4, 32), None), (head(10, 4, 4, 32) + b"x", "tga"), (head(2, 2, 1, 24) + bytes(5), None), (head(2, 2, 1, 24) + bytes(6), "tga"), (head(1, 2, 2, 8, 1, 3, 24) + bytes(12), None), (head(1, 2, 2, 8, 1, 3, 24) + bytes(13), "tga"), (head(3, 2, 2, 9) + bytes(99), None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, content binary").select("i", image_format("content").alias("f")).orderBy("i").collect()
    assert [r["f"] for r in rows] == [f for _, f in cases]


def test_bitmaps_and_tga_of_other_depths(spark):
    rgb = [[(1, 2, 3), (4, 5, 6), (7, 8, 9)], [(10, 11, 12), (13, 14, 15), (16, 17, 18)]]
    info = lambda h, bits, comp=0: struct.pack("<IiiHHIIiiII", 40, 3, h, 1, bits, comp, 0, 0, 0, 0, 0)
    bmp = lambda h, bits, body, comp=0: b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + info(h, bits, comp) + body
    line24 = lambda row: b"".join(bytes(p[::-1]) for p in row) + bytes(3)
    line32 = lambda row: b"".join(bytes((*p[::-1], 200)) for p in row)
    tga = lambda kind, depth, flags, body: struct.pack("<BBBHHBHHHHBB", 2, 0, kind, 0, 0, 0, 0, 0, 3, 2, depth, flags) + b"id" + body
    raw = lambda rows: b"".join(bytes(p[::-1]) for row in rows for p in row)
    gray = [[(v[0],) * 3 for v in row] for row in rgb]
    cases = [
        ("bmp", bmp(2, 24, line24(rgb[1]) + line24(rgb[0])), rgb, 255),
        ("bmp", bmp(-2, 24, line24(rgb[0]) + line24(rgb[1])), rgb, 255),
        ("bmp", bmp(-2, 32, line32(rgb[0]) + line32(rgb[1])), rgb, 200),
        ("tga", tga(2, 24, 32, raw(rgb)), rgb, 255),
        ("tga", tga(2, 24, 0, raw(rgb[::-1])), rgb, 255),
        ("tga", tga(2, 24, 48, raw([row[::-1] for row in rgb])), rgb, 255),
        ("tga", tga(3, 8, 32, bytes(p[0] for row in rgb for p in row)), gray, 255),
    ]
    for kind, data, want, alpha in cases:
        got = getattr(files, f"read_{kind}")(spark.createDataFrame([(1, data)], "image_id long, content binary")).collect()
        assert {(r["y"], r["x"]): (r["r"], r["g"], r["b"], r["a"]) for r in got} == {(y, x): (*want[y][x], alpha) for y in range(2) for x in range(3)}
    odd = [(1, bmp(2, 16, bytes(16))), (2, bmp(2, 32, bytes(24), 3)), (3, cases[0][1]), (4, cases[6][1]), (5, b"II*\0\x08\0\0\0\0\0")]
    df = spark.createDataFrame(odd, "image_id long, content binary")
    seen = {r["image_id"]: (r["status"], r["error"]) for r in files.outcomes(df).collect()}
    assert seen[1] == seen[2] == ("skipped", "no reader for this bmp") and seen[3] == seen[4] == ("decoded", None)
    assert {r["image_id"] for r in files.read_bmp(df).select("image_id").distinct().collect()} == {3} and files.read_tiff(df).count() == 0


def test_runs_go_on_over_the_ends_of_rows(spark):
    import random

    r = random.Random(4)
    grids = {k: [[r.choice([0, 0, 0, 1]) if k % 2 else 0 if r.random() < 0.9 else 1 for _ in range(4)] for _ in range(6)] for k in range(12)}
    rows = [(k, y, x, v, 0, 0, 255) for k, g in grids.items() for y, line in enumerate(g) for x, v in enumerate(line)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, r int, g int, b int, a int").repartition(5)
    got = {(t["image_id"], t["y"], t["x"]): t["length"] for t in pixels.runs(df, False, 62).collect()}
    want = {}
    for k, g in grids.items():
        flat = [v for line in g for v in line]
        start = 0
        for i in range(1, len(flat) + 1):
            if i == len(flat) or flat[i] != flat[start]:
                want[k, start // 4, start % 4] = i - start
                start = i
    assert got == want
