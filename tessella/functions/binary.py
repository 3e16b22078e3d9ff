"""Column expressions over BINARY: bytes, integers, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_at(content, position) -> Column:
    """The byte at a 0-based position as INT; null beyond the end."""
    p = position if isinstance(position, Column) else F.lit(position)
    h = F.hex(F.substring(_col(content), p + 1, F.lit(1)))
    return F.when(h != "", F.conv(h, 16, 10).cast("int"))


def uint(content, position, size: int, little: bool = True) -> Column:
    """An unsigned integer of 1 to 4 bytes as BIGINT."""
    p = position if isinstance(position, Column) else F.lit(position)
    h = F.hex(F.substring(_col(content), p + 1, F.lit(size)))
    parts = [F.substring(h, 2 * i + 1, 2) for i in range(size)]
    ordered = F.concat(*(reversed(parts) if little else parts))
    return F.when(F.length(h) == 2 * size, F.conv(ordered, 16, 10).cast("long"))


def hex_uint(value: Column, size: int, little: bool = True) -> Column:
    """The hex digits of an integer written in ``size`` bytes."""
    h = F.lpad(F.hex(value.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(h, 2 * i + 1, 2) for i in (range(size - 1, -1, -1) if little else range(size))))


#: File signatures, in the order in which they are tried.
SIGNATURES = (
    ("bmp", ("424D",)),
    ("gif", ("474946383761", "474946383961")),
    ("png", ("89504E470D0A1A0A",)),
    ("jbig2", ("974A42320D0A1A0A",)),
    ("jpeg", ("FFD8FF",)),
    ("jpeg_xl", ("FF0A", "0000000C4A584C200D0A870A")),
    ("open_exr", ("762F3101",)),
    ("webp", ("52494646",)),
    ("qoi", ("716F6966",)),
    ("tiff", ("49492A00", "4D4D002A")),
)


def image_format(content) -> Column:
    """The format of encoded bytes by signature, TGA by footer or header; null if none fits."""
    c = _col(content)
    out = None
    for name, starts in SIGNATURES:
        test = None
        for s in starts:
            one = F.startswith(c, F.unhex(F.lit(s)))
            test = one if test is None else test | one
        if name == "webp":
            test = test & (F.hex(F.substring(c, 9, 4)) == "57454250")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(looks_like_tga(c), "tga")


def looks_like_tga(content) -> Column:
    """A TGA footer, or a header whose fields agree with each other and with the length."""
    c = _col(content)
    size = F.octet_length(c)
    footer = (size >= 26) & F.endswith(c, F.unhex(F.lit("54525545564953494F4E2D5846494C452E00")))
    kind, has_map, depth = byte_at(c, 2), byte_at(c, 1), byte_at(c, 16)
    width, height = uint(c, 12, 2), uint(c, 14, 2)
    mapped = kind.isin(1, 9)
    whole_bytes = lambda bits: F.floor((bits + 7) / 8)
    data = 18 + byte_at(c, 0) + F.when(mapped, uint(c, 5, 2) * whole_bytes(byte_at(c, 7))).otherwise(0)
    fits = (data < size) & (~kind.isin(1, 2, 3) | (width * height * whole_bytes(depth) <= size - data))
    header = (size >= 18) & kind.isin(1, 2, 3, 9, 10, 11) & (has_map == mapped.cast("int")) & (width > 0) & (height > 0) & depth.isin(8, 15, 16, 24, 32) & fits
    return F.coalesce(footer, F.lit(False)) | F.coalesce(header, F.lit(False))
