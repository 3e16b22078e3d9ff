"""Light and sample encodings as column expressions (double arithmetic unless said otherwise)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the transfer functions: thresholds, slopes and exponents.
SRGB = {"low": 0.0404482362771082, "slope": 0.07739938080495357, "scale": 0.9478672985781991, "linear": 0.00313066844250063, "power": 0.4166666666666667}
BT709 = {"low": 0.081242858298635133011, "offset": 0.0992968268094429403, "scale": 0.90967241568627260377, "linear": 0.018053968510807807336}
PQ = {"m1": 0.159423828125, "m2": 78.84375, "c1": 0.8359375, "c2": 18.8515625, "c3": 18.6875}
DCI_GAMMA = 0.3846154


def to_linear(kind: str, v: Column, gamma: float = DCI_GAMMA) -> Column:
    """Encoded samples as linear light: linear, srgb, bt709, pq, or gamma."""
    if kind == "srgb":
        return F.when(v < SRGB["low"], v * SRGB["slope"]).otherwise(F.pow((v + 0.055) * SRGB["scale"], F.lit(2.4)))
    if kind == "bt709":
        return F.when(v < BT709["low"], v / 4.5).otherwise(F.pow((v + BT709["offset"]) * BT709["scale"], F.lit(1 / 0.45)))
    if kind == "pq":
        p = F.pow(v, F.lit(1 / PQ["m2"]))
        return F.pow(F.greatest(p - PQ["c1"], F.lit(0.0)) / (PQ["c2"] - p * PQ["c3"]), F.lit(1 / PQ["m1"]))
    return v if kind == "linear" else F.when(v <= 0, 0.0).otherwise(F.pow(v, F.lit(1 / gamma)))


def from_linear(kind: str, v: Column, gamma: float = DCI_GAMMA) -> Column:
    """Linear light as encoded samples."""
    if kind == "srgb":
        return F.when(v < SRGB["linear"], v * 12.92).otherwise(F.pow(v, F.lit(SRGB["power"])) * 1.055 - 0.055)
    if kind == "bt709":
        return F.when(v < BT709["linear"], v * 4.5).otherwise(F.pow(v, F.lit(0.45)) * (1 + BT709["offset"]) - BT709["offset"])
    if kind == "pq":
        p = F.pow(v, F.lit(PQ["m1"]))
        return F.pow((p * PQ["c2"] + PQ["c1"]) / (p * PQ["c3"] + 1), F.lit(PQ["m2"]))
    return v if kind == "linear" else F.when(v <= 0, 0.0).otherwise(F.pow(v, F.lit(gamma)))


def srgb_decode(v: Column) -> Column:
    """Linear light of signed extended sRGB."""
    m = F.abs(v)
    return F.signum(v) * F.when(m <= 0.04045, m / 12.92).otherwise(F.pow((m + 0.055) / 1.055, F.lit(2.4)))


def half(v: Column) -> Column:
    """The nearest 16-bit float, ties to even; what is too large becomes infinite."""
    m = F.abs(v)
    # the exponent is -14 at least, where numbers are spaced evenly down to zero
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.when(m > 0, m))), F.lit(-14)) - 10)
    near = F.when(m == 0, 0.0).otherwise(F.rint(m / step) * step)
    return F.signum(v) * F.when(near >= 65520, float("inf")).otherwise(near)


#: Rows of the matrix from linear sRGB to mixed cone responses, and their bias.
OPSIN = ((0.3, 0.622, 0.078), (0.23, 0.692, 0.078), (0.24342268924547819, 0.20476744424496821, 0.5518098665095536))
OPSIN_BIAS = 0.0037930732552754493


def xyb(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Linear sRGB as opponent colours under cube roots."""
    root = [F.cbrt(F.greatest(r * k[0] + g * k[1] + b * k[2] + OPSIN_BIAS, F.lit(0.0))) - float(np.cbrt(OPSIN_BIAS)) for k in OPSIN]
    return (root[0] - root[1]) / 2, (root[0] + root[1]) / 2, root[2]


def xyb_inverse(x: Column, y: Column, b: Column) -> tuple[Column, Column, Column]:
    """Undoes ``xyb``."""
    mixed = [F.pow(c + float(np.cbrt(OPSIN_BIAS)), F.lit(3.0)) - OPSIN_BIAS for c in (y + x, y - x, b)]
    return tuple(sum((m * float(k) for m, k in zip(mixed[1:], row[1:])), mixed[0] * float(row[0])) for row in np.linalg.inv(np.array(OPSIN)))


def limited_yuv_to_rgb(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    """Limited-range luma and chroma to RGB, fixed point with 14 fraction bits, clipped."""
    luma = (y - 16) * 19077 + 8192
    u, v = u - 128, v - 128
    clip = lambda c: F.least(F.greatest(F.shiftright(c, 14), F.lit(0)), F.lit(255)).cast("int")
    return clip(luma + v * 26149), clip(luma - u * 6419 - v * 13320), clip(luma + u * 33050)


def lab_unit(stored: Column, bits: int, signed: bool) -> Column:
    """A stored a* or b* as 0..1: two's complement, or with an offset of 128; 16-bit samples in 256ths, or 257ths."""
    half_, whole = 1 << (bits - 1), 1 << bits
    number = F.when(stored >= half_, stored - whole).otherwise(stored) if signed else stored
    scale = 1 if bits == 8 else 256 if signed else 257
    value = number / scale - (0 if signed else 128)
    return F.least(F.greatest((value + 128) / 255, F.lit(0.0)), F.lit(1.0))


# The Bradford matrix and linear sRGB's primaries and white.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
SRGB_PRIMARIES, D65 = ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)), (0.3127, 0.3290)


def _xyz(xy) -> np.ndarray:
    return np.array([xy[0] / xy[1], 1.0, (1 - xy[0] - xy[1]) / xy[1]])


def _to_xyz(primaries, white) -> np.ndarray:
    m = np.stack([_xyz(p) for p in primaries], axis=1)
    return m * np.linalg.solve(m, _xyz(white))


def primaries_matrix(primaries, white=D65) -> np.ndarray:
    """Linear light of the given primaries and white to linear sRGB, adapted to its white."""
    scale = (BRADFORD @ _xyz(D65)) / (BRADFORD @ _xyz(white))
    adapt = np.linalg.inv(BRADFORD) @ np.diag(scale) @ BRADFORD
    return np.linalg.inv(_to_xyz(SRGB_PRIMARIES, D65)) @ adapt @ _to_xyz(primaries, white)


def mixed(matrix: np.ndarray, *c: Column) -> tuple[Column, ...]:
    """A matrix applied to samples."""
    return tuple(sum((x * float(k) for x, k in zip(c[1:], row[1:])), c[0] * float(row[0])) for row in matrix)
