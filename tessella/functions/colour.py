"""Sample arithmetic as column expressions: exact integers unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return c.cast("int")


def quotient(a: Column, b: int) -> Column:
    """Integer division that truncates towards zero."""
    return _int(F.when(a >= 0, F.floor(a / b)).otherwise(-F.floor(-a / b)))


def clamp8(c: Column) -> Column:
    return _int(F.least(F.greatest(c, F.lit(0)), F.lit(255)))


def over_white(c: Column, a: Column) -> Column:
    """A sample over white, rounded."""
    return quotient(c * a + (255 - a) * 255 + 127, 255)


def over_matte(c: Column, a: Column, matte: int) -> Column:
    """A sample over a matte; opaque samples stay as they are."""
    return _int(F.when(a == 255, c).otherwise(quotient(c * a + (255 - a) * matte + 127, 255)))


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Fixed-point forward transform with 16 fraction bits."""
    y = F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)
    cb = F.shiftright(r * -11059 + g * -21709 + b * 32768 + 8421375, 16)
    cr = F.shiftright(r * 32768 + g * -27439 + b * -5329 + 8421375, 16)
    return _int(y), _int(cb), _int(cr)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Fixed-point inverse with 8 fraction bits, clipped."""
    u, v, base = cb - 128, cr - 128, F.shiftleft(y, 8)
    return clamp8(F.shiftright(base + v * 359 + 128, 8)), clamp8(F.shiftright(base - u * 88 - v * 183 + 128, 8)), clamp8(F.shiftright(base + u * 454 + 128, 8))


def limited_yuv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Limited-range luma and chroma with 8 fraction bits."""
    y = F.shiftright(r * 66 + g * 129 + b * 25 + 128, 8) + 16
    u = F.shiftright(r * -38 - g * 74 + b * 112 + 128, 8) + 128
    v = F.shiftright(r * 112 - g * 94 - b * 18 + 128, 8) + 128
    return _int(y), _int(u), _int(v)


def cmyk_to_rgb(c: Column, k: Column) -> Column:
    """One channel of inverted CMYK samples."""
    return quotient(c * k + 127, 255)


def cmyk_unit_to_byte(c: Column, k: Column) -> Column:
    """One channel of CMYK in 0..1 as a byte (double arithmetic, rounded half away from zero)."""
    return _int(F.round((1 - c) * (1 - k) * 255))


def luma_threshold(r: Column, g: Column, b: Column, a: Column, limit: int) -> Column:
    """1 for black: luma over white under the limit."""
    w = [over_white(c, a) for c in (r, g, b)]
    return _int((quotient(w[0] * 299 + w[1] * 587 + w[2] * 114 + 500, 1000) < limit).cast("int"))


def rct(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Reversible colour transform by lifting: luma, orange, green."""
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return _int(t + F.shiftright(cg, 1)), _int(co), _int(cg)


def rct_inverse(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    t = y - F.shiftright(cg, 1)
    g = cg + t
    b = t - F.shiftright(co, 1)
    return _int(b + co), _int(g), _int(b)


def subtract_green(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return _int((r - g).bitwiseAND(255)), _int(g), _int((b - g).bitwiseAND(255))


def unpremultiply(c: Column, a: Column) -> Column:
    """A sample of associated alpha as straight alpha, rounded half away from zero; alpha 0 and 255 leave it."""
    return _int(F.when(a.isin(0, 255), c).otherwise(F.least(F.lit(255), F.round(c * 255 / a))))


def scale_truncated(v: Column, largest: int) -> Column:
    return quotient(v * 255, largest)


def scale_rounded(v: Column, largest: int) -> Column:
    return _int(F.round(v * 255 / largest))


def srgb_encode(v: Column) -> Column:
    """Signed extended sRGB of linear light (double)."""
    m = F.abs(v)
    return F.signum(v) * F.when(m <= 0.0031308, m * 12.92).otherwise(F.pow(m, F.lit(1 / 2.4)) * 1.055 - 0.055)


def unit_to_byte(v: Column) -> Column:
    """0..1 to a byte: clamped, rounded half up, not-a-number as 0."""
    return _int(F.when(F.isnan(v), 0).otherwise(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)))


def orient(orientation: int, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Where a pixel goes under an EXIF orientation."""
    right, down = width - 1 - x, height - 1 - y
    return {1: (x, y), 2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}[orientation]


def channel_order(order: str, s: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Samples in one of eight layouts as (r, g, b, a)."""
    opaque = F.lit(255)
    if order == "red":
        return s[0], s[0], s[0], opaque
    if order == "gray_alpha":
        return s[0], s[0], s[0], s[1]
    at = {c: s[i] for i, c in enumerate(order)}
    return at["r"], at["g"], at["b"], at.get("a", opaque)


def lab_to_srgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lab under D50 in the 0..1 encoding to sRGB in 0..1 (double)."""
    fy = (lightness * 100 + 16) / 116
    fx, fz = fy + (a * 255 - 128) / 500, fy - (b * 255 - 128) / 200
    open_ = lambda f: F.when(f > 6 / 29, f * f * f).otherwise((f - 4 / 29) * (3 * (6 / 29) * (6 / 29)))
    # fixed values: the D50 white and the matrix from D50 XYZ to linear sRGB
    white = (0.96422, 1.0, 0.82521)
    matrix = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
    xyz = [open_(f) * w for f, w in zip((fx, fy, fz), white)]
    return tuple(srgb_encode(F.least(F.greatest(sum((v * m for v, m in zip(xyz[1:], row[1:])), xyz[0] * row[0]), F.lit(0.0)), F.lit(1.0))) for row in matrix)


def rct_inverse_type(kind: Column, a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Inverse of the reversible transforms 0 to 6: additions of the first channel or a half sum, or the lifting of ``rct``."""
    third = F.when(kind.isin(1, 3, 5), c + a).otherwise(c)
    second = F.when(kind.isin(2, 3), b + a).when(kind.isin(4, 5), b + F.shiftright(a + third, 1)).otherwise(b)
    r, g, blue = rct_inverse(a, b, c)
    pick = lambda lifted, plain: _int(F.when(kind == 6, lifted).otherwise(plain))
    return pick(r, a), pick(g, second), pick(blue, third)


def signed8(v: Column) -> Column:
    return F.when(v > 127, v - 256).otherwise(v)


def cross_colour(r: Column, g: Column, b: Column, green_red: int, green_blue: int, red_blue: int) -> tuple[Column, Column, Column]:
    """Adds to red a share of green and to blue shares of green and of the new red, modulo 256; shares are signed, in 32nds."""
    red = (r + F.shiftright(signed8(g) * green_red, 5)).bitwiseAND(255)
    blue = (b + F.shiftright(signed8(g) * green_blue, 5) + F.shiftright(signed8(red) * red_blue, 5)).bitwiseAND(255)
    return _int(red), _int(g), _int(blue)


def colour_key(r: Column, g: Column, b: Column, key: tuple[int, int, int]) -> Column:
    """Alpha 0 where all samples equal the key."""
    return F.when((r == key[0]) & (g == key[1]) & (b == key[2]), 0).otherwise(255).cast("int")


def blend(mode: str, new: Column, old: Column, alpha: Column) -> Column:
    """A sample of a frame on a canvas, samples and alpha in 0..1 (double)."""
    return {"replace": new, "add": new + old, "blend": new * alpha + old * (1 - alpha), "multiply_add": old + new * alpha, "multiply": new * old}[mode]


def blend_alpha(new: Column, old: Column, new_alpha: Column, old_alpha: Column, premultiplied: bool = False, clamp: bool = False, below: bool = False) -> tuple[Column, Column]:
    """A sample with alpha over one with alpha, and the alpha of both (doubles in 0..1); nothing over nothing is 0.

    premultiplied: samples are already weighted. clamp: the alpha of what lies on
    top is held to 0..1. below: the new one lies under the old one.
    """
    top, bottom, cover, under = (old, new, old_alpha, new_alpha) if below else (new, old, new_alpha, old_alpha)
    if clamp:
        cover = F.least(F.greatest(cover, F.lit(0.0)), F.lit(1.0))
    both = under + cover * (1 - under)
    if premultiplied:
        return top + bottom * (1 - cover), both
    return F.when(both > 0, (top * cover + bottom * under * (1 - cover)) / F.when(both > 0, both)).otherwise(0.0), both


def microseconds(ticks: Column, per_second: Column, scale: Column) -> Column:
    """Length of a frame; 0 if the image has no tick rate."""
    return F.when(per_second == 0, F.lit(0)).otherwise(F.floor(ticks * scale * 1_000_000 / per_second)).cast("long")
