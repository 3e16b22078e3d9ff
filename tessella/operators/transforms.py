"""Block transforms of sample planes (image_id, y, x, v) as separable products and array algebra.

Cosine transforms of any block size multiply by a basis along x, then along y: each
step is an aggregate over the samples of one line of a block, so a block is never one
row and a large image spreads over tasks. Integer transforms of 4 by 4 gather their
sixteen samples in one aggregate and are column expressions from there on. No Python.

Planes must be filled up to whole blocks (samples.edge_replicated); a missing sample
counts as 0. Places in a block: y of the result is by * n + vertical frequency, x the
same with the horizontal one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The luminance table of the published JPEG standard, row by row.
LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
#: Digits to which a coefficient is rounded before a decision, so that sums in another order decide alike.
DIGITS = 6


def cosine_basis(n: int) -> list[list[float]]:
    """Rows: frequencies; columns: places. Orthonormal, so the transpose is the inverse."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(n)]


def _along(samples: DataFrame, axis: str, matrix: list[list[float]]) -> DataFrame:
    """Multiplies each line of a block along an axis by a matrix."""
    n, other = len(matrix), "y" if axis == "x" else "x"
    place = (F.col(axis) % n).cast("int")
    sums = [F.sum(F.col("v") * F.get(F.array(*map(F.lit, row)), place)) for row in matrix]
    lines = samples.groupBy("image_id", other, F.expr(f"{axis} div {n}").alias("block")).agg(F.array(*sums).alias("c"))
    each = lines.select("image_id", other, "block", F.posexplode("c").alias("k", "v"))
    return each.select("image_id", F.col(other).cast("int").alias(other), (F.col("block") * n + F.col("k")).cast("int").alias(axis), "v").select("image_id", "y", "x", "v")


def cosine(samples: DataFrame, n: int = 8) -> DataFrame:
    """Coefficients of the two-dimensional cosine transform of n by n blocks (double)."""
    basis = cosine_basis(n)
    return _along(_along(samples.select("image_id", "y", "x", F.col("v").cast("double").alias("v")), "x", basis), "y", basis)


def cosine_inverse(coefficients: DataFrame, n: int = 8) -> DataFrame:
    """Samples (double) from coefficients."""
    back = [list(c) for c in zip(*cosine_basis(n))]
    return _along(_along(coefficients, "y", back), "x", back)


def zigzag(n: int) -> list[list[int]]:
    """The place of each coefficient (vertical, horizontal) on the way through a block by diagonals that turn."""
    # odd diagonals run down, even ones up
    order = sorted(((v, h) for v in range(n) for h in range(n)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    out = [[0] * n for _ in range(n)]
    for i, (v, h) in enumerate(order):
        out[v][h] = i
    return out


def quality_table(quality: int, table=LUMINANCE) -> list[list[int]]:
    """A table scaled by a quality of 1 to 100, entries 1 to 255."""
    if not 1 <= quality <= 100:
        raise ValueError("a quality is 1 to 100")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [[min(255, max(1, (e * scale + 50) // 100)) for e in row] for row in table]


def _entry(table, n: int) -> Column:
    """The entry of a table for a row's place in its block."""
    return F.get(F.array(*(F.lit(v) for row in table for v in row)), ((F.col("y") % n) * n + F.col("x") % n).cast("int"))


def quantised(coefficients: DataFrame, table: list[list[int]]) -> DataFrame:
    """image_id, block_y, block_x, place (on the zigzag way), q: coefficients over the table's entries, halves away from zero; zeros are left out."""
    n = len(table)
    exact = F.round("v", DIGITS) / _entry(table, n)
    q = (F.signum(exact) * F.floor(F.abs(exact) + 0.5)).cast("int")
    out = coefficients.select("image_id", F.expr(f"y div {n}").cast("int").alias("block_y"), F.expr(f"x div {n}").cast("int").alias("block_x"), _entry(zigzag(n), n).alias("place"), q.alias("q"))
    return out.where("q <> 0")


def dequantised(q: DataFrame, table: list[list[int]]) -> DataFrame:
    """Coefficients (image_id, y, x, v) again; a block of zeros only has no rows."""
    n = len(table)
    way = sorted((at, v, h) for v, row in enumerate(zigzag(n)) for h, at in enumerate(row))
    v, h, e = (F.get(F.array(*map(F.lit, c)), F.col("place")) for c in ([w[1] for w in way], [w[2] for w in way], [table[w[1]][w[2]] for w in way]))
    return q.select("image_id", (F.col("block_y") * n + v).cast("int").alias("y"), (F.col("block_x") * n + h).cast("int").alias("x"), (F.col("q") * e).cast("double").alias("v"))


# --- integer transforms of 4 by 4 ---------------------------------------------------


def gathered4(samples: DataFrame) -> DataFrame:
    """image_id, by, bx, c0 to c15: the samples of each block of 4 by 4."""
    place = F.col("y") % 4 * 4 + F.col("x") % 4
    cells = [F.coalesce(F.max(F.when(place == k, F.col("v"))), F.lit(0)).cast("int").alias(f"c{k}") for k in range(16)]
    return samples.groupBy("image_id", F.expr("y div 4").cast("int").alias("by"), F.expr("x div 4").cast("int").alias("bx")).agg(*cells)


def spread4(blocks: DataFrame) -> DataFrame:
    """Undoes gathered4."""
    each = blocks.select("image_id", "by", "bx", F.posexplode(F.array(*(f"c{k}" for k in range(16)))).alias("k", "v"))
    return each.select("image_id", (F.col("by") * 4 + F.shiftright("k", 2)).cast("int").alias("y"), (F.col("bx") * 4 + F.col("k") % 4).cast("int").alias("x"), "v")


def _passes(blocks: DataFrame, *steps) -> DataFrame:
    """Applies (step, along rows?) one after the other; a step takes four columns and gives four."""
    kept = [c for c in blocks.columns if c not in {f"c{k}" for k in range(16)}]
    for step, rows in steps:
        new = {}
        for i in range(4):
            at = [4 * i + j if rows else 4 * j + i for j in range(4)]
            new |= dict(zip(at, step(*(F.col(f"c{k}") for k in at))))
        blocks = blocks.select(*kept, *(new[k].cast("int").alias(f"c{k}") for k in range(16)))
    return blocks


# fixed values: rotations in parts of 4,096 (forward) and 65,536 (inverse), and what is added before each shift
_FORWARD, _ROTATE_A, _ROTATE_B = (2217, 5352), 20091, 35468


def residual_forward(blocks: DataFrame) -> DataFrame:
    """Coefficients of residuals c0 to c15, row by row."""
    low, high = _FORWARD

    def turned(a, b, c, d, even, odd):
        """Sums and differences of the outer and the inner pair, through ``even`` and ``odd``."""
        return even(a + d + b + c), odd(0, b - c, a - d), even(a + d - b - c), odd(1, b - c, a - d)

    def first(a, b, c, d):
        add = (1812, 937)
        return turned(a, b, c, d, lambda s: s * 8, lambda k, i, o: F.shiftright((o * high + i * low if k == 0 else o * low - i * high) + add[k], 9))

    def second(a, b, c, d):
        def odd(k, i, o):
            if k == 0:
                return F.shiftright(o * high + i * low + 12000, 16) + F.when(o != 0, 1).otherwise(0)
            return F.shiftright(o * low - i * high + 51000, 16)

        return turned(a, b, c, d, lambda s: F.shiftright(s + 7, 4), odd)

    return _passes(blocks, (first, True), (second, False))


def residual_inverse(blocks: DataFrame) -> DataFrame:
    """Residuals from coefficients, as every decoder must give them."""
    more = lambda v: v + F.shiftright(v * _ROTATE_A, 16)
    less = lambda v: F.shiftright(v * _ROTATE_B, 16)

    def step(add, shift):
        def run(a, b, c, d):
            even, odd = (a + add + c, a + add - c), (more(b) + less(d), less(b) - more(d))
            out = even[0] + odd[0], even[1] + odd[1], even[1] - odd[1], even[0] - odd[0]
            return tuple(F.shiftright(v, shift) for v in out) if shift else out

        return run

    return _passes(blocks, (step(0, 0), False), (step(4, 3), True))


def hadamard_forward(blocks: DataFrame) -> DataFrame:
    """Walsh-Hadamard transform of the sixteen means of a macroblock."""

    def step(shift):
        def run(a, b, c, d):
            out = a + b + c + d, a - c + b - d, a - c - b + d, a + c - b - d
            return tuple(F.shiftright(v, shift) for v in out) if shift else out

        return run

    return _passes(blocks, (step(0), True), (step(1), False))


def hadamard_inverse(blocks: DataFrame) -> DataFrame:
    """Undoes hadamard_forward."""

    def step(add, shift):
        def run(a, b, c, d):
            out = a + d + b + c, a - d + b - c, a + d - b - c, a - d - b + c
            return tuple(F.shiftright(v + add, shift) for v in out) if shift else out

        return run

    return _passes(blocks, (step(0, 0), False), (step(3, 3), True))
