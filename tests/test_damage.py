"""Damaged and foreign files: every walk ends, and every file has one outcome that the readers share."""

import random
import signal
import struct

import pytest

from tessella.operators import files, metadata

FILES = "image_id long, content binary"


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments):
    frame = segment(0xC0, struct.pack(">BHHB", 8, 5, 7, 3) + bytes.fromhex("011100021101031101"))
    return b"\xff\xd8" + b"".join(segments) + frame + segment(0xDA, bytes(10)) + b"\xff\xd9"


def icc(number, total, size):
    return segment(0xE2, b"ICC_PROFILE\0" + bytes([number, total]) + b"p" * size)


def xmp(name, whole, place, size):
    return segment(0xE1, b"http://ns.adobe.com/xmp/extension/\0" + name + struct.pack(">II", whole, place) + b"x" * size)


def tiff(entries, tail=b"", order="<", first=8):
    """A TIFF of entries (tag, kind, count, value as four bytes or a number)."""
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", first) + bytes(first - 8) + struct.pack(order + "H", len(entries))
    for tag, kind, count, value in entries:
        value = value if isinstance(value, bytes) else struct.pack(order + ("HH" if kind == 3 else "I"), *([value, 0] if kind == 3 else [value]))
        out += struct.pack(order + "HHI", tag, kind, count) + value
    return out + bytes(4) + tail


def rgba(strip, **changed):
    tags = {256: (4, 1, 3), 257: (4, 1, 2), 258: (3, 4, struct.pack("<I", strip + 24)), 259: (3, 1, 1), 262: (3, 1, 2), 273: (4, 1, strip), 277: (3, 1, 4), 278: (4, 1, 2), 279: (4, 1, 24)}
    tags |= {int(k[1:]): v for k, v in changed.items()}
    return tiff([(t, *v) for t, v in tags.items()], bytes(range(24)) + struct.pack("<4H", 8, 8, 8, 8))


STRIP = 8 + 2 + 9 * 12 + 4


def test_tiff_outcomes_and_pixels_agree(spark):
    made = {
        1: rgba(STRIP),
        2: rgba(STRIP, t277=(3, 1, 1)),  # gray
        3: rgba(STRIP, t259=(3, 1, 32773)),
        4: tiff([(256, 4, 1, 3), (257, 4, 1, 2)], order=">"),
        5: b"II*\0",
        6: rgba(STRIP)[:-20],
        7: rgba(STRIP, t273=(4, 2, STRIP)),
        8: rgba(STRIP, t256=(3, 1, 0)),
        9: rgba(STRIP, t256=(4, 1, 1 << 30)),
        10: rgba(STRIP)[: 8 + 2 + 50],
        11: rgba(STRIP, t262=(3, 1, 0)),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], FILES)
    got = {r.image_id: r.error for r in files.outcomes(df).collect()}
    other, short = "no reader for this tiff", "truncated header"
    assert got == {1: None, 2: other, 3: other, 4: short, 5: short, 6: other, 7: other, 8: "empty image", 9: "over budget", 10: short, 11: other}
    # a file that lacks pixels but not its depths
    cut = bytearray(rgba(STRIP, t258=(3, 1, 8), t273=(4, 1, STRIP + 20)))
    assert files.outcomes(spark.createDataFrame([(1, cut)], FILES)).first().error == "truncated pixels"
    pixels = files.read_tiff(df.union(spark.createDataFrame([(12, cut)], FILES))).orderBy("y", "x").collect()
    assert [(r.image_id, r.y, r.x, r.r, r.g, r.b, r.a) for r in pixels] == [(1, k // 3, k % 3, 4 * k, 4 * k + 1, 4 * k + 2, 4 * k + 3) for k in range(6)]


def test_packets_of_jpeg():
    name, other = b"0123456789ABCDEF0123456789ABCDEF", b"F" * 32
    standard = segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + b"<x note='" + name + b"'/>")
    iptc = segment(0xED, b"Photoshop 3.0\0" + b"8BIM\x03\xed\0\0" + struct.pack(">I", 3) + b"abc\0" + b"8BIM\x04\x04\x03one" + struct.pack(">I", 5) + b"words\0")
    whole = metadata.jpeg(jpeg(icc(2, 2, 7), icc(1, 2, 60000), standard, xmp(name, 90000, 60000, 30000), xmp(other, 9, 0, 9), xmp(name, 90000, 0, 60000), iptc))
    assert (whole["icc_bytes"], whole["extended_xmp_bytes"], whole["iptc_bytes"], whole["width"], whole["height"]) == (60007, 90000, 5, 7, 5)
    plain = metadata.jpeg(jpeg())
    assert plain["icc_bytes"] is None and plain["extended_xmp_bytes"] is None and "iptc_bytes" not in plain
    for parts in ([icc(1, 2, 5)], [icc(1, 1, 5), icc(1, 1, 5)], [icc(1, 2, 5), icc(2, 3, 5)], [icc(0, 1, 5)], [standard, xmp(name, 9, 1, 8)], [standard, xmp(name, 9, 0, 4), xmp(name, 9, 5, 4)], [standard, xmp(name, 9, 0, 8)]):
        with pytest.raises(metadata.Damaged, match="incomplete"):
            metadata.jpeg(jpeg(*parts))


def test_senseless_values_of_tiff():
    good = [(256, 4, 1, 3), (257, 4, 1, 2), (262, 3, 1, 2)]
    assert metadata.tiff(tiff(good)) | {} == {"width": 3, "height": 2, "bits": 1, "model": "rgb", "icc_bytes": None, "xmp_bytes": None, "orientation": 1}
    for bad, words in (
        ([(274, 3, 1, 9)], "orientation 9"),
        ([(274, 3, 1, 0)], "orientation 0"),
        ([(258, 3, 2, struct.pack("<HH", 8, 16))], "different depths"),
        ([(282, 5, 1, 8 + 2 + 4 * 12 + 4)], "zero denominator"),
    ):
        with pytest.raises(metadata.Damaged, match=words):
            metadata.tiff(tiff(good + bad, struct.pack("<II", 5, 0)))


def exr(channels):
    head = b"\x76\x2f\x31\x01\2\0\0\0"
    return head + b"channels\0chlist\0" + struct.pack("<i", len(channels)) + channels + b"dataWindow\0box2i\0" + struct.pack("<5i", 16, 0, 0, 3, 1) + b"\0"


def test_every_walk_ends():
    """Cut, changed and made-up files under a time limit."""
    one = b"A\0" + struct.pack("<i", 1) + bytes(12)
    seeds = [exr(one + b"\0"), exr(one), exr(b"A" * 20), exr(b"\0A"), jpeg(icc(1, 1, 9)), rgba(STRIP), b"RIFF\x16\0\0\0WEBPVP8X\x0a\0\0\0" + bytes(10)]
    seeds += [b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0) + bytes(4)]
    r = random.Random(11)
    signal.alarm(60)
    try:
        n = 0
        for seed in seeds:
            for read in metadata.READERS.values():
                for k in range(250):
                    data = bytearray(seed[: r.randint(0, len(seed))] if k % 2 else seed)
                    for _ in range(r.randint(0, 4)):
                        if data:
                            data[r.randrange(len(data))] = r.choice((0, 1, 255, r.randrange(256)))
                    try:
                        read(bytes(data))
                    except metadata.Damaged:
                        pass
                    n += 1
        assert n == 10_000
    finally:
        signal.alarm(0)
