"""Metadata of JPEG, WebP, TIFF, PNG and OpenEXR files without their pixels.

The formats are walks over segments whose next place depends on the last one's
size, so each file is walked once by a small helper over Arrow batches: markers
up to the scan in JPEG, RIFF chunks, PNG chunks, directory entries in TIFF and
in EXIF packets, attributes in OpenEXR. Nothing of the pixels is touched.

A damaged or foreign file gives nulls and an ``error``; so do an ICC profile or an
extended XMP packet of JPEG with missing parts, and senseless values in TIFF. Packets are reported by
their sizes in bytes, null if absent.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.binary import image_format

PACKETS = ("icc_bytes", "exif_bytes", "xmp_bytes", "extended_xmp_bytes", "iptc_bytes")
FIELDS = ("width", "height", "bits", "model", "orientation", "ppi_x", "ppi_y", *PACKETS, "error")
SCHEMA = (
    "image_id long, format string, width long, height long, bits int, model string, orientation int, ppi_x double, ppi_y double, "
    + ", ".join(f"{c} long" for c in PACKETS)
    + ", error string"
)
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), *[pa.int64()] * len(PACKETS), pa.string()]
#: Pixels per metre of one pixel per inch, and bytes of TIFF value types 1 to 12, fixed values.
INCH = 39.37007874015748
TIFF_SIZES = (1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)
XMP_IN_JPEG, XMP_IN_PNG = b"http://ns.adobe.com/xap/1.0/\0", b"XML:com.adobe.xmp\0"
MORE_XMP, IPTC_IN_JPEG, IPTC = b"http://ns.adobe.com/xmp/extension/\0", b"Photoshop 3.0\0", 0x0404


class Damaged(ValueError):
    """What a file lacks."""


def _at(layout: str, data: bytes, at: int, what: str) -> tuple:
    if at < 0 or at + struct.calcsize(layout) > len(data):
        raise Damaged(f"truncated {what}")
    return struct.unpack_from(layout, data, at)


def directory(data: bytes, base: int = 0) -> dict[int, tuple[int, int, int, str]]:
    """Entries of the first TIFF directory after ``base``: tag to (type, count, place of the value, byte order)."""
    order = {b"II": "<", b"MM": ">"}.get(data[base : base + 2])
    if order is None or _at(f"{order}H", data, base + 2, "header")[0] != 42:
        raise Damaged("no TIFF header")
    at = base + _at(f"{order}I", data, base + 4, "header")[0]
    (n,) = _at(f"{order}H", data, at, "directory")
    out = {}
    for i in range(n):
        entry = at + 2 + 12 * i
        tag, kind, count = _at(f"{order}HHI", data, entry, "directory")
        if not 1 <= kind <= len(TIFF_SIZES):
            continue
        size = count * TIFF_SIZES[kind - 1]
        place = entry + 8 if size <= 4 else base + _at(f"{order}I", data, entry + 8, "directory")[0]
        if place + size <= len(data):
            out[tag] = (kind, count, place, order)
    return out


def _number(data: bytes, entry, kinds: str = "BHI") -> int | None:
    """The first value of an entry of bytes, shorts or longs."""
    layout = {1: "B", 3: "H", 4: "I"}.get(entry[0]) if entry and entry[1] else None
    return _at(entry[3] + layout, data, entry[2], "value")[0] if layout in tuple(kinds) else None


def _densities(data: bytes, entries: dict, strict: bool) -> dict:
    """Orientation and pixels per inch from directory entries; strict: senseless values are errors."""
    scale = 2.54 if _number(data, entries.get(296), "H") == 3 else 1.0
    turn = _number(data, entries.get(274), "H")
    out = {"orientation": 1 if turn is None else turn}
    if not 1 <= out["orientation"] <= 8:
        if strict:
            raise Damaged(f"unsupported orientation {turn}")
        out["orientation"] = 1
    for name, tag in (("ppi_x", 282), ("ppi_y", 283)):
        kind, count, place, order = entries.get(tag, (0, 0, 0, ""))
        if kind == 5 and count:
            top, bottom = _at(f"{order}II", data, place, "value")
            if strict and not bottom:
                raise Damaged("a rational with a zero denominator")
            if top and bottom:
                out[name] = top / bottom * scale
    return out


def exif(packet: bytes) -> dict:
    """Orientation (1 if it has none) and densities of an EXIF packet; a damaged packet says nothing."""
    try:
        base = 6 if packet[:6] == b"Exif\0\0" else 0
        return _densities(packet, directory(packet, base), strict=False)
    except Damaged:
        return {"orientation": 1}


def _profile(parts: list[tuple[int, int, int]]) -> int | None:
    """Bytes of an ICC profile of (number, parts in all, bytes), which must be complete and agree."""
    if not parts:
        return None
    numbers = [n for n, _, _ in parts]
    if len({total for _, total, _ in parts}) > 1 or sorted(numbers) != list(range(1, parts[0][1] + 1)):
        raise Damaged("incomplete ICC profile")
    return sum(size for _, _, size in parts)


def _extended_xmp(parts: dict[bytes, list[tuple[int, int, int]]], standard: bytes) -> int | None:
    """Bytes of the extended packet that the standard one names: (whole size, place, bytes) in any order, without a gap."""
    of = next((v for name, v in parts.items() if name in standard), [])
    if not of:
        return None
    end = 0
    for whole, place, size in sorted(of, key=lambda x: x[1]):
        if place != end or whole != of[0][0]:
            raise Damaged("incomplete extended XMP")
        end += size
    if end != of[0][0]:
        raise Damaged("incomplete extended XMP")
    return end


def _iptc(body: bytes) -> int | None:
    """Bytes of the IPTC resource among the image resources of a segment."""
    at = len(IPTC_IN_JPEG)
    while body[at : at + 4] == b"8BIM" and at + 7 <= len(body):
        number, name = struct.unpack_from(">HB", body, at + 4)
        at += 6 + name + 1 + (name + 1) % 2
        if at + 4 > len(body):
            return None
        (size,) = struct.unpack_from(">I", body, at)
        at += 4
        if size > len(body) - at:
            return None
        if number == IPTC:
            return size
        at += size + size % 2
    return None


def jpeg(data: bytes) -> dict:
    out, icc, more, standard, at, own, density = {"orientation": 1}, [], {}, b"", 2, {}, {}
    while True:
        at = data.find(b"\xff", at)
        while 0 <= at < len(data) and data[at] == 0xFF:
            at += 1
        if at < 0 or at >= len(data) or data[at] in (0xD9, 0xDA):
            break
        marker, at = data[at], at + 1
        if marker == 1 or 0xD0 <= marker <= 0xD7:
            continue
        (size,) = _at(">H", data, at, "segment")
        if size < 2 or at + size > len(data):
            raise Damaged("truncated segment")
        body = data[at + 2 : at + size]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out["bits"], out["height"], out["width"], parts = _at(">BHHB", body, 0, "frame header")
            out["model"] = "cmyk" if parts == 4 else "rgb"
        elif marker == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            unit, x, y = _at(">BHH", body, 7, "segment")
            if unit in (1, 2) and x and y:
                scale = 2.54 if unit == 2 else 1.0
                density = {"ppi_x": x * scale, "ppi_y": y * scale}
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            own, out["exif_bytes"] = exif(body), len(body)
        elif marker == 0xE1 and body.startswith(XMP_IN_JPEG):
            standard, out["xmp_bytes"] = body, len(body) - len(XMP_IN_JPEG)
        elif marker == 0xE1 and body.startswith(MORE_XMP) and len(body) >= len(MORE_XMP) + 40:
            name, whole, place = _at(">32sII", body, len(MORE_XMP), "segment")
            more.setdefault(name, []).append((whole, place, len(body) - len(MORE_XMP) - 40))
        elif marker == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) >= 14:
            icc.append((body[12], body[13], len(body) - 14))
        elif marker == 0xED and body.startswith(IPTC_IN_JPEG) and "iptc_bytes" not in out:
            found = _iptc(body)
            out |= {} if found is None else {"iptc_bytes": found}
        at += size
    if "width" not in out:
        raise Damaged("no frame header")
    return out | {"icc_bytes": _profile(icc), "extended_xmp_bytes": _extended_xmp(more, standard)} | density | own


def webp(data: bytes) -> dict:
    end = _at("<I", data, 4, "header")[0] + 8
    if not 20 <= end <= len(data):
        raise Damaged("truncated RIFF payload")
    out, plain, own, at = {"bits": 8, "model": "rgb"}, None, {}, 12
    while at < end:
        kind, size = _at("<4sI", data, at, "chunk header")
        at += 8
        if at + size + size % 2 > end:
            raise Damaged("truncated chunk")
        body = data[at : at + size]
        if kind == b"VP8X" and size == 10:
            out["width"], out["height"] = (int.from_bytes(body[i : i + 3], "little") + 1 for i in (4, 7))
        elif kind == b"VP8L" and size >= 5:
            (word,) = _at("<I", body, 1, "chunk")
            plain = plain or ((word & 0x3FFF) + 1, (word >> 14 & 0x3FFF) + 1)
        elif kind == b"VP8 " and size >= 10:
            plain = plain or tuple(v & 0x3FFF for v in _at("<HH", body, 6, "chunk"))
        elif kind == b"ICCP":
            out["icc_bytes"] = size
        elif kind == b"EXIF":
            own, out["exif_bytes"] = exif(body), size
            own.pop("orientation")
        elif kind == b"XMP ":
            out["xmp_bytes"] = size
        at += size + size % 2
    if "width" not in out:
        if plain is None:
            raise Damaged("no dimensions")
        out["width"], out["height"] = plain
    return out | own | {"orientation": 1}


def png(data: bytes) -> dict:
    out, at = {"model": "rgb", "orientation": 1}, 8
    while at < len(data):
        size, kind = _at(">I4s", data, at, "chunk header")
        at += 8
        if at + size + 4 > len(data):
            raise Damaged("truncated chunk")
        body = data[at : at + size]
        if kind == b"IHDR" and size == 13:
            out["width"], out["height"], out["bits"] = _at(">IIB", body, 0, "header")
        elif kind == b"pHYs" and size == 9 and body[8] == 1:
            for name, v in zip(("ppi_x", "ppi_y"), _at(">II", body, 0, "chunk")):
                if v:
                    out[name] = v / INCH
        elif kind == b"iCCP":
            # as compressed; the profile itself is not opened
            out["icc_bytes"] = size - body.find(b"\0") - 2
        elif kind == b"eXIf":
            out["exif_bytes"] = size
        elif kind == b"iTXt" and body.startswith(XMP_IN_PNG):
            rest = body[len(XMP_IN_PNG) + 2 :].split(b"\0", 2)
            out["xmp_bytes"] = len(rest[2]) if len(rest) == 3 else None
        elif kind == b"IEND":
            break
        at += size + 4
    if "width" not in out:
        raise Damaged("no image header")
    return out


def _depth(data: bytes, entry) -> int:
    """Bits of a sample, which all channels must share."""
    if entry is None or entry[0] != 3 or not entry[1]:
        return 1
    depths = set(_at(f"{entry[3]}{entry[1]}H", data, entry[2], "value"))
    if len(depths) > 1:
        raise Damaged("channels of different depths")
    return depths.pop()


def tiff(data: bytes) -> dict:
    e = directory(data)
    size = [_number(data, e.get(tag), "HI") for tag in (256, 257)]
    if None in size or 262 not in e:
        raise Damaged("no dimensions")
    bits, photometric = _depth(data, e.get(258)), _number(data, e[262], "H")
    length = lambda tag: e[tag][1] * TIFF_SIZES[e[tag][0] - 1] if tag in e else None
    return {"width": size[0], "height": size[1], "bits": bits, "model": {5: "cmyk", 8: "lab", 9: "lab"}.get(photometric, "rgb"), "icc_bytes": length(34675), "xmp_bytes": length(700)} | _densities(data, e, strict=True)


def open_exr(data: bytes) -> dict:
    """The data window and the widest channel; one part, attributes up to the empty name."""
    out, at = {"model": "rgb", "orientation": 1}, 8
    while at < len(data) and data[at]:
        name_end = data.find(b"\0", at)
        kind_end = data.find(b"\0", name_end + 1)
        if name_end < 0 or kind_end < 0:
            break
        name, (size,) = data[at:name_end], _at("<i", data, kind_end + 1, "attribute")
        at = kind_end + 5
        if size < 0 or at + size > len(data):
            raise Damaged("truncated attribute")
        if name == b"dataWindow" and size == 16:
            x0, y0, x1, y1 = _at("<iiii", data, at, "attribute")
            out["width"], out["height"] = x1 - x0 + 1, y1 - y0 + 1
        elif name == b"channels":
            place, widest = at, 0
            while place < at + size and data[place]:
                ends = data.find(b"\0", place, at + size)
                if ends < 0:
                    raise Damaged("truncated channel list")
                (kind,) = _at("<i", data, ends + 1, "channel")
                widest, place = max(widest, 16 if kind == 1 else 32), ends + 17
            out["bits"] = widest
        at += size
    if "width" not in out:
        raise Damaged("no data window")
    return out


READERS = {"jpeg": jpeg, "webp": webp, "png": png, "tiff": tiff, "open_exr": open_exr}


def inspect_metadata(files: DataFrame) -> DataFrame:
    """image_id, format and the FIELDS of every file (image_id, content)."""

    def run(batches):
        for batch in batches:
            columns = {f: [] for f in FIELDS}
            for form, data in zip(batch.column("format").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found = READERS[form](data) if form in READERS else {"error": "no reader of metadata for this format" if form else "unknown format"}
                except Damaged as e:
                    found = {"error": str(e)}
                for f in FIELDS:
                    columns[f].append(found.get(f))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("format"), *(pa.array(columns[f], t) for f, t in zip(FIELDS, TYPES))], names=["image_id", "format", *FIELDS])

    return files.select(F.col("image_id").cast("long").alias("image_id"), image_format("content").alias("format"), "content").mapInArrow(run, SCHEMA)
