"""Inverse predictors: rows of an image in order, each from the one above.

A pixel that is predicted from its left neighbour and from the row above needs both
restored first, so an image's rows pass through one task in order. They come as one
row of samples at a time (`gathered`), sorted by image and row, and `folded` keeps
the row above only. Images spread over tasks. What has no such order, the residuals
themselves, are column expressions over neighbours.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.pixels import RGBA, block_mode_guess, neighbours, paeth, png_filters

#: Samples are bytes.
BYTE = 256
#: Pixels that leave a task in one batch: a batch for each row of an image takes longer than its pixels.
TOGETHER = 1 << 16


def gathered(samples: DataFrame, *columns: str) -> DataFrame:
    """image_id, y and p, the samples of the row in order of x."""
    return samples.groupBy(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y")).agg(F.sort_array(F.collect_list(F.struct("x", *columns))).alias("p"))


def together(offsets: np.ndarray, pixels: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``pixels`` pixels, at least a row each, from the offsets of their lists."""
    start, last = 0, len(offsets) - 1
    while start < last:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + pixels, "right")) - 1)
        yield start, end
        start = end


def folded(rows: DataFrame, restore: Callable[[np.ndarray, np.ndarray | None], np.ndarray], names: tuple[str, ...]) -> DataFrame:
    """image_id, y, x and ``names`` of gathered rows; restore(values of a row, restored row above or None) gives (pixels, names)."""
    columns = [f for f in rows.schema["p"].dataType.elementType.names if f != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, above = None, None
        for batch in batches:
            images, p = batch.column("image_id").to_pylist(), batch.column("p")
            offsets = p.offsets.to_numpy()
            for start, end in together(offsets):
                flat = p.values.slice(offsets[start], offsets[end] - offsets[start])
                values = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)
                out, at = [], offsets[start : end + 1] - offsets[start]
                for i in range(start, end):
                    if images[i] != image:
                        image, above = images[i], None
                    above = restore(values[at[i - start] : at[i - start + 1]], above)
                    out.append(above)
                done, of = np.concatenate(out).astype(np.int32), pa.array(np.repeat(np.arange(start, end), np.diff(at)))
                yield pa.RecordBatch.from_arrays([batch.column("image_id").take(of), batch.column("y").take(of), flat.field("x").cast(pa.int32()), *(pa.array(done[:, k]) for k in range(len(names)))], names=["image_id", "y", "x", *names])

    schema = "image_id long, y int, x int, " + ", ".join(f"{n} int" for n in names)
    return rows.repartition("image_id").sortWithinPartitions("image_id", "y").mapInArrow(run, schema)


# --- filters of rows ------------------------------------------------------------


def _png_guess(kind: Column, left: Column, up: Column, corner: Column) -> Column:
    return F.when(kind == 1, left).when(kind == 2, up).when(kind == 3, F.shiftright(left + up, 1)).when(kind == 4, paeth(left, up, corner)).otherwise(0)


def png_residuals(pixels: DataFrame) -> DataFrame:
    """Residuals modulo 256 under the filter that png_filters chooses for the row: image_id, y, x, filter, r, g, b, a."""
    near = neighbours(pixels, RGBA).join(png_filters(pixels).select("image_id", "y", "filter"), ["image_id", "y"])
    off = lambda c: (F.col(c) - _png_guess(F.col("filter"), *(F.col(f"{c}_{k}") for k in ("l", "u", "ul")))).bitwiseAND(255)
    return near.select("image_id", "y", "x", "filter", *(off(c).cast("int").alias(c) for c in RGBA))


def _nearest_of(a: int, b: int, c: int) -> int:
    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c


def png_row(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A restored row (pixels, channels)."""
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row, axis=0) % BYTE
    if kind == 2:
        return (row + above) % BYTE
    guess = (lambda a, b, c: (a + b) >> 1) if kind == 3 else _nearest_of
    out, up = [], above.tolist()
    left = corner = [0] * row.shape[1]
    for values, over in zip(row.tolist(), up):
        left = [(v + guess(a, b, c)) % BYTE for v, a, b, c in zip(values, left, over, corner)]
        corner = over
        out.append(left)
    return np.array(out, np.int64)


def png_restored(residuals: DataFrame) -> DataFrame:
    """Undoes png_residuals."""

    def restore(values: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        row = values[:, 1:]
        return png_row(int(values[0, 0]), row, np.zeros_like(row) if above is None else above)

    return folded(gathered(residuals, "filter", *RGBA), restore, RGBA)


ALPHA_FILTERS = ("horizontal", "vertical", "gradient")


def alpha_residuals(samples: DataFrame, kind: str, channel: str = "a") -> DataFrame:
    """Residuals of a plane: the first row is predicted from the left, the first column from above, the rest by ``kind``."""
    near = neighbours(samples, (channel,))
    left, up, corner = (F.col(f"{channel}_{k}") for k in ("l", "u", "ul"))
    inner = {"horizontal": left, "vertical": up, "gradient": F.least(F.greatest(left + up - corner, F.lit(0)), F.lit(255))}[kind]
    guess = F.when(F.col("y") == 0, left).when(F.col("x") == 0, up).otherwise(inner)
    return near.select("image_id", "y", "x", (F.col(channel) - guess).bitwiseAND(255).cast("int").alias(channel))


def alpha_restored(residuals: DataFrame, kind: str, channel: str = "a") -> DataFrame:
    """Undoes alpha_residuals."""

    def restore(values: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        row = values.copy()
        if above is None:
            return np.cumsum(row, axis=0) % BYTE
        if kind == "vertical":
            return (row + above) % BYTE
        row[0] += above[0]
        if kind == "horizontal":
            return np.cumsum(row, axis=0) % BYTE
        out, up = [int(row[0, 0]) % BYTE], above[:, 0].tolist()
        for v, corner, over in zip(row[1:, 0].tolist(), up, up[1:]):
            out.append((v + min(255, max(0, out[-1] + over - corner))) % BYTE)
        return np.array(out, np.int64)[:, None]

    return folded(gathered(residuals, channel), restore, (channel,))


# --- predictors of blocks -------------------------------------------------------


def block_residuals(pixels: DataFrame, modes: DataFrame, size: int = 32) -> DataFrame:
    """Residuals modulo 256 under the mode of each block (image_id, block_y, block_x, mode; 1, 2, 7 or 11): image_id, y, x, mode, r, g, b, a."""
    at = {"block_y": F.expr(f"y div {size}").cast("int"), "block_x": F.expr(f"x div {size}").cast("int")}
    near = neighbours(pixels, RGBA).withColumns(at).join(modes.select("image_id", "block_y", "block_x", "mode"), ["image_id", "block_y", "block_x"])

    def off(c: str) -> Column:
        guess = None
        for mode in (1, 2, 7, 11):
            one = block_mode_guess(mode, c)
            guess = F.when(F.col("mode") == mode, one) if guess is None else guess.when(F.col("mode") == mode, one)
        return (F.col(c) - guess).bitwiseAND(255).cast("int").alias(c)

    return near.select("image_id", "y", "x", "mode", *(off(c) for c in RGBA))


def _half(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b)]


def block_guess(mode: int, left: list[int], up: list[int], corner: list[int], right: list[int]) -> list[int]:
    """The guess of a mode from the pixels on the left, above, above on the left and above on the right (r, g, b, a)."""
    clip = lambda v: min(255, max(0, v))
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, up, right, corner)[mode - 1]
    if mode == 11:
        to_left = sum(abs(u - c) for u, c in zip(up, corner))
        to_up = sum(abs(v - c) for v, c in zip(left, corner))
        return left if to_left < to_up else up
    if mode == 12:
        return [clip(a + b - c) for a, b, c in zip(left, up, corner)]
    if mode == 13:
        mean = _half(left, up)
        return [clip(m + (m - c) // 2 if m >= c else m - (c - m) // 2) for m, c in zip(mean, corner)]
    return {5: lambda: _half(_half(left, right), up), 6: lambda: _half(left, corner), 7: lambda: _half(left, up), 8: lambda: _half(corner, up), 9: lambda: _half(up, right), 10: lambda: _half(_half(left, corner), _half(up, right))}[mode]()


def block_restored(residuals: DataFrame) -> DataFrame:
    """Undoes predictions by blocks (image_id, y, x, mode, r, g, b, a) of all fourteen modes.

    The first pixel is predicted from opaque black, the first row from the left, the
    first column from above; what is above and right of the last column is the first
    pixel of the row itself.
    """

    def restore(values: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        rows, out = values.tolist(), []
        over = above.tolist() if above is not None else None
        for x, (mode, *v) in enumerate(rows):
            if over is None:
                guess = out[-1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = over[0]
            else:
                guess = block_guess(mode, out[-1], over[x], over[x - 1], over[x + 1] if x + 1 < len(rows) else out[0])
            out.append([(a + b) % BYTE for a, b in zip(v, guess)])
        return np.array(out, np.int64)

    return folded(gathered(residuals, "mode", *RGBA), restore, RGBA)
