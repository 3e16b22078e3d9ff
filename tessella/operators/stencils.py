"""Filters that look at a pixel's neighbourhood, by tiles that exchange their edges.

An image is cut into square tiles. A pixel goes to its own tile and, if it lies near an
edge, also to the tiles beside it, so that each tile has all it needs: no window over a row
or an image, and a large image spreads over tasks. Pixels of a tile that come together
travel as one row, and tiles of one shape go through a kernel together.
Beyond the image its pixels are mirrored.

Planes are image_id, y, x and double columns; ``sizes`` has image_id, width, height.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.bundles import bundled, flat, whole
from tessella.operators.pixels import with_sizes

#: Pixels a side of a tile.
TILE = 256
# fixed values: weights of the smoothing filter, scales and steps of the edge-preserving one
SMOOTH = (0.115169525, 0.061248592)
CHANNEL_SCALES, BORDER, STEP, PASS_SCALES = (40.0, 5.0, 3.5), 2 / 3, 1.65 * 4 * (1 - 0.5**0.5), (0.9, 1.0, 6.5)
#: Fixed value: above this inverse strength a pixel stays as it is.
NO_FILTER = 1 / 0.3
CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
DOUBLE_CROSS = (*CROSS, (1, -1), (1, 1), (-1, 1), (-1, -1), (-2, 0), (2, 0), (0, 2), (0, -2))


def mirrored(at: np.ndarray, size: int) -> np.ndarray:
    """Places of an image for places around it; the edge itself comes twice."""
    at = np.mod(at, 2 * size)
    return np.where(at < size, at, 2 * size - 1 - at)


def tile_pieces(planes: DataFrame, columns: tuple[str, ...], halo: int, tile: int) -> DataFrame:
    """image_id, ty, tx and lists of y, x and columns: bundles of the pixels that a tile needs.

    A tile beyond the image gets rows too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c).to_numpy() for c in ("y", "x")}
            of = np.arange(batch.num_rows)
            tiles = {}
            for t, c in (("ty", "y"), ("tx", "x")):
                first, last = (at[c][of] - halo) // tile, (at[c][of] + halo) // tile
                n = last - first + 1
                # a pixel once for each of its tiles along this axis
                each = np.repeat(np.arange(len(of)), n)
                tiles = {k: v[each] for k, v in tiles.items()} | {t: first[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)}
                of = of[each]
            keep = (tiles["ty"] >= 0) & (tiles["tx"] >= 0)
            of, ty, tx = of[keep], tiles["ty"][keep], tiles["tx"][keep]
            taken = pa.array(of)
            keys = {"image_id": batch.column("image_id").take(taken), "ty": pa.array(ty.astype(np.int32)), "tx": pa.array(tx.astype(np.int32))}
            yield bundled(keys, {c: batch.column(c).take(taken) for c in ("y", "x", *columns)})

    rows = planes.where("image_id is not null").select(F.col("image_id").cast("long").alias("image_id"), *(F.col(c).cast("int").alias(c) for c in ("y", "x")), *(F.col(c).cast("double").alias(c) for c in columns))
    return rows.mapInArrow(run, "image_id long, ty int, tx int, y array<int>, x array<int>, " + ", ".join(f"{c} array<double>" for c in columns))


def stencil(planes: DataFrame, sizes: DataFrame, columns: tuple[str, ...], halo: int, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], tile: int = TILE) -> DataFrame:
    """image_id, y, x, columns after kernel(values, y, x).

    values: (channels, tiles, rows + 2 halo, columns + 2 halo) of tiles with their surroundings;
    y, x: places of each tile's own rows and columns. The kernel gives (channels, tiles, rows, columns).
    """
    each = with_sizes(tile_pieces(planes, columns, halo, tile), sizes.select("image_id", "width", "height")).where(f"ty * {tile} < height and tx * {tile} < width")

    def filtered(table: pa.Table, starts: np.ndarray, pixels: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole tiles, from the rows where each starts."""
        value = {c: flat(table, c) for c in ("y", "x", *columns)}
        of = np.repeat(np.arange(len(starts)), np.add.reduceat(pixels, starts))
        key = {c: table.column(c).to_numpy()[starts].astype(np.int64) for c in ("image_id", "ty", "tx", "width", "height")}
        shape, low = [], {}
        for c, t, size in (("y", "ty", "height"), ("x", "tx", "width")):
            begin = key[t] * tile
            end = np.minimum(begin + tile, key[size])
            before = np.minimum(begin, halo)
            low[c] = begin - before
            # what lies before, own and behind says where pixels are mirrored
            shape += [before, end - begin, np.minimum(key[size] - end, halo)]
        kinds, kind = np.unique(np.stack(shape, axis=1), axis=0, return_inverse=True)
        kind, number = kind.ravel(), np.zeros(len(starts), np.int64)
        for k, (above, rows, below, left, cols, right) in enumerate(kinds.tolist()):
            mine = np.flatnonzero(kind == k)
            number[mine] = np.arange(len(mine))
            grid = np.zeros((len(columns), len(mine), above + rows + below, left + cols + right))
            here = kind[of] == k
            y, x = (value[c][here] - low[c][of[here]] for c in ("y", "x"))
            inside = (y >= 0) & (y < grid.shape[2]) & (x >= 0) & (x < grid.shape[3])
            at = number[of[here]][inside], y[inside], x[inside]
            for i, c in enumerate(columns):
                grid[i][at] = value[c][here][inside]
            around = [mirrored(np.arange(before - halo, before + own + halo), before + own + behind) for before, own, behind in ((above, rows, below), (left, cols, right))]
            values = grid[:, :, around[0][:, None], around[1][None, :]]
            own = [(key[t][mine] * tile)[:, None] + np.arange(n) for t, n in (("ty", rows), ("tx", cols))]
            out = kernel(values, *own)
            size = (len(mine), rows, cols)
            names = {"image_id": np.broadcast_to(key["image_id"][mine][:, None, None], size), "y": np.broadcast_to(own[0][:, :, None], size).astype(np.int32), "x": np.broadcast_to(own[1][:, None, :], size).astype(np.int32)}
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (*names.values(), *out)], names=[*names, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles in whole(batches, ("image_id", "ty", "tx"), "y"):
            yield from filtered(*tiles)

    dealt = each.repartition("image_id", "ty", "tx").sortWithinPartitions("image_id", "ty", "tx")
    return dealt.mapInArrow(run, "image_id long, y int, x int, " + ", ".join(f"{c} double" for c in columns))


def _shifted(values: np.ndarray, halo: int, dy: int, dx: int, more: int = 0) -> np.ndarray:
    """The tiles and ``more`` pixels around them, moved by (dy, dx)."""
    rows, cols = values.shape[2] - 2 * halo, values.shape[3] - 2 * halo
    return values[:, :, halo + dy - more : halo + dy + rows + more, halo + dx - more : halo + dx + cols + more]


def smoothed(planes: DataFrame, sizes: DataFrame, columns: tuple[str, ...], weights: tuple[float, float] = SMOOTH, tile: int = TILE) -> DataFrame:
    """A weighted mean of three by three: weights of those beside and of those across, the middle has 1."""
    beside, across = weights
    whole = 1 / (1 + 4 * (beside + across))

    def kernel(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = lambda dy, dx: _shifted(v, 1, dy, dx)
        plus, times = sum(at(*d) for d in CROSS[1:]), sum(at(*d) for d in DOUBLE_CROSS[5:9])
        return whole * (at(0, 0) + beside * plus + across * times)

    return stencil(planes, sizes, columns, 1, kernel, tile)


def edge_preserving_pass(planes: DataFrame, sizes: DataFrame, columns: tuple[str, ...], step: int, sigma: float = 1.0, tile: int = TILE) -> DataFrame:
    """One pass of means that weigh less what differs more.

    step: 0 looks at twelve neighbours, 1 and 2 at four; 0 and 1 compare crosses around both
    pixels, 2 the pixels. At edges of blocks of 8 differences count less.
    """
    taps, compared = (DOUBLE_CROSS if step == 0 else CROSS)[1:], ((0, 0),) if step == 2 else CROSS
    halo = (3, 2, 1)[step]
    # a single channel stands for all of them
    scales = np.array(CHANNEL_SCALES if len(columns) == 3 else [sum(CHANNEL_SCALES)] * len(columns))[:, None, None, None]
    strength = STEP * PASS_SCALES[step] / sigma

    def kernel(v: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        middle = _shifted(v, halo, 0, 0)
        if 1 / sigma > NO_FILTER:
            return middle
        edge = np.isin(y % 8, (0, 7))[:, :, None] | np.isin(x % 8, (0, 7))[:, None, :]
        factor = strength * np.where(edge, BORDER, 1.0)
        total, weight = middle.copy(), np.ones(middle.shape[1:])
        for dy, dx in taps:
            apart = sum((scales * np.abs(_shifted(v, halo, cy, cx) - _shifted(v, halo, dy + cy, dx + cx))).sum(0) for cy, cx in compared)
            w = np.maximum(0.0, 1 - apart * factor)
            weight += w
            total += w * _shifted(v, halo, dy, dx)
        return total / weight

    return stencil(planes, sizes, columns, halo, kernel, tile)


def edge_preserved(planes: DataFrame, sizes: DataFrame, columns: tuple[str, ...], iterations: int = 1, sigma: float = 1.0, tile: int = TILE) -> DataFrame:
    """One to three passes: the second one alone, with the third, or with the first too."""
    for step in {1: (1,), 2: (1, 2), 3: (0, 1, 2)}[iterations]:
        planes = edge_preserving_pass(planes, sizes, columns, step, sigma, tile)
    return planes
