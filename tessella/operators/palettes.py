"""Palettes of images by median cut, and pixels as palette indices with error diffusion.

The histogram of 15-bit cells is an aggregate over all images at once; what is left of an
image is 32,768 cells at most, a bounded group in which boxes are split one by one. Indices
without diffusion are joins by cell. Error diffusion carries an error along each row and into
the next one, so rows of an image pass through one task in order, a row at a time; only two
rows of errors and the palette are kept, and images spread over tasks.

Pixels with alpha under the threshold are entry 0, transparent, if transparency is wanted;
others are put over the matte. Cells of equal value in the channel of a split are ordered by
their number. Null samples count as 0. Images without rows don't occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import colour
from tessella.operators.lines import together

PALETTE = "image_id long, entry int, r int, g int, b int, a int"
INDICES = "image_id long, y int, x int, entry int"
#: Weights of the channels in spans and distances, a fixed value.
WEIGHTS = (3, 4, 2)
TRANSPARENT = -1


def _prepared(pixels: DataFrame, matte: int, threshold: int) -> DataFrame:
    """Pixels over the matte with their 15-bit cell, -1 for transparent ones. threshold 0: nothing is transparent."""
    v = {c: F.coalesce(F.col(c), F.lit(0)) for c in "rgba"}
    clear = v["a"] < threshold
    over = pixels.select(F.col("image_id").cast("long"), "y", "x", *(colour.over_matte(v[c], v["a"], matte).cast("int").alias(c) for c in "rgb"), clear.alias("clear"))
    cell = F.shiftleft(F.shiftright("r", 3), 10) + F.shiftleft(F.shiftright("g", 3), 5) + F.shiftright("b", 3)
    return over.withColumn("cell", F.when(F.col("clear"), TRANSPARENT).otherwise(cell).cast("int")).drop("clear")


def cell_histogram(pixels: DataFrame, matte: int = 255, threshold: int = 128) -> DataFrame:
    """image_id, cell, n and the rounded mean r, g, b of each occupied cell."""
    mean = lambda c: F.round(F.sum(c) / F.count("*")).cast("int").alias(c)
    return _prepared(pixels, matte, threshold).groupBy("image_id", "cell").agg(F.count("*").alias("n"), *(mean(c) for c in "rgb"))


class _Box:
    """Some cells of a histogram: rows of ``colours`` with their counts and cell numbers."""

    def __init__(self, colours: np.ndarray, n: np.ndarray, cell: np.ndarray):
        self.colours, self.n, self.cell = colours, n, cell
        self.spans = (colours.max(0) - colours.min(0)) * WEIGHTS
        self.score = int(n.sum()) * int(self.spans.sum()) if len(n) > 1 else -1

    def split(self) -> tuple[_Box, _Box]:
        """Both sides of the median of the pixels along the widest channel; green before red before blue."""
        channel = max((1, 0, 2), key=lambda c: self.spans[c])
        order = np.lexsort((self.cell, self.colours[:, channel]))
        reached = np.flatnonzero(np.cumsum(self.n[order])[:-1] >= self.n.sum() // 2)
        at = int(reached[0]) + 1 if len(reached) else 1
        return tuple(_Box(self.colours[o], self.n[o], self.cell[o]) for o in (order[:at], order[at:]))

    def mean(self) -> list[int]:
        # halves away from zero
        return np.floor((self.colours * self.n[:, None]).sum(0) / self.n.sum() + 0.5).astype(int).tolist()


def median_cut(colours: np.ndarray, n: np.ndarray, cell: np.ndarray, limit: int) -> list[list[int]]:
    """Mean colours of at most ``limit`` boxes; the box with the most pixels times span is split next, the first one on a tie."""
    boxes = [_Box(colours, n, cell)]
    while len(boxes) < limit:
        best = max(range(len(boxes)), key=lambda i: boxes[i].score)
        if boxes[best].score < 0:
            break
        boxes[best], other = boxes[best].split()
        boxes.append(other)
    return [b.mean() for b in boxes]


def palettes(pixels: DataFrame, colours: int = 256, matte: int = 255, threshold: int = 128) -> DataFrame:
    """Palette entries of every image: image_id, entry, r, g, b, a."""
    if not 2 <= colours <= 256:
        raise ValueError("a palette has 2 to 256 colours")

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cell")
        image, seen = frame["image_id"].iloc[0], frame[frame["cell"] != TRANSPARENT]
        out = [[0, 0, 0, 0]] if len(seen) < len(frame) else []
        if len(seen):
            out += [[*c, 255] for c in median_cut(seen[["r", "g", "b"]].to_numpy(np.int64), seen["n"].to_numpy(np.int64), seen["cell"].to_numpy(), colours - len(out))]
        return pd.DataFrame([(image, i, *c) for i, c in enumerate(out)], columns=["image_id", "entry", "r", "g", "b", "a"])

    return cell_histogram(pixels, matte, threshold).groupBy("image_id").applyInPandas(reduce, PALETTE)


def _entries(palette: DataFrame) -> DataFrame:
    """image_id and its entries as an array in order, of 256 at most."""
    return palette.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("entry", "r", "g", "b", "a"))).alias("palette"))


def _nearest(palette: Column, r: Column, g: Column, b: Column) -> Column:
    """The opaque entry nearest to a colour, the lowest on a tie."""

    def distance(e):
        total = sum((v - e[c]) * (v - e[c]) * w for v, c, w in zip((r, g, b), "rgb", WEIGHTS))
        return F.struct(total.alias("d"), e["entry"].alias("entry"))

    return F.array_min(F.transform(F.filter(palette, lambda e: e["a"] > 0), distance))["entry"]


def indexed(pixels: DataFrame, palette: DataFrame, matte: int = 255, threshold: int = 128) -> DataFrame:
    """image_id, y, x, entry: the entry nearest to the first colour of each cell, for all pixels of the cell."""
    seen = _prepared(pixels, matte, threshold)
    first = seen.where(F.col("cell") != TRANSPARENT).groupBy("image_id", "cell").agg(F.min_by(F.struct("r", "g", "b"), F.struct("y", "x")).alias("c"))
    cells = first.join(_entries(palette), "image_id").select("image_id", "cell", _nearest(F.col("palette"), F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("found"))
    return seen.join(cells, ["image_id", "cell"], "left").select("image_id", "y", "x", F.coalesce("found", F.lit(0)).cast("int").alias("entry"))


class _Diffusion:
    """The errors of an image on their way down its rows."""

    def __init__(self, palette: list[dict], amount: int):
        self.entries = [(e["entry"], e["r"], e["g"], e["b"]) for e in palette if e["a"]]
        self.colours = {e[0]: e[1:] for e in self.entries}
        self.known: dict[int, int] = {}
        self.amount, self.below, self.row = amount, None, None

    def _find(self, r: int, g: int, b: int) -> int:
        cell = r >> 3 << 10 | g >> 3 << 5 | b >> 3
        if cell not in self.known:
            # the first colour of a cell decides for all of it
            self.known[cell] = min([(3 * (r - x) * (r - x) + 4 * (g - y) * (g - y) + 2 * (b - z) * (b - z), i) for i, x, y, z in self.entries])[1]
        return self.known[cell]

    def line(self, y: int, cells: list[int], colours: list[tuple[int, int, int]]) -> list[int]:
        """Indices of the next row. A row that is missing passes no errors on."""
        n, amount = len(cells), self.amount
        above = self.below if self.below is not None and self.row == y - 1 and len(self.below) == n + 2 else [[0, 0, 0] for _ in range(n + 2)]
        below = [[0, 0, 0] for _ in range(n + 2)]
        out = []
        for x in range(n):
            if cells[x] == TRANSPARENT:
                out.append(0)
                continue
            now = []
            for v, e in zip(colours[x], above[x + 1]):
                v += (e + 8) >> 4 if e >= 0 else -((8 - e) >> 4)  # a sixteenth, rounded half away from zero
                now.append(0 if v < 0 else 255 if v > 255 else v)
            found = self._find(*now)
            out.append(found)
            right, left_below, under, right_below = above[x + 2], below[x], below[x + 1], below[x + 2]
            to = self.colours[found]
            for c in (0, 1, 2):
                part = (now[c] - to[c]) * amount
                error = part // 100 if part >= 0 else -(-part // 100)
                if error:
                    right[c] += error * 7
                    left_below[c] += error * 3
                    under[c] += error * 5
                    right_below[c] += error
        self.below, self.row = below, y
        return out


def dithered(pixels: DataFrame, palette: DataFrame, amount: int = 100, matte: int = 255, threshold: int = 128) -> DataFrame:
    """image_id, y, x, entry with ``amount`` percent of each error diffused to the right and the next row."""
    if not 0 <= amount <= 100:
        raise ValueError("an amount is 0 to 100 percent")
    if amount == 0:
        return indexed(pixels, palette, matte, threshold)
    seen = _prepared(pixels, matte, threshold)
    point = F.sort_array(F.collect_list(F.struct("x", "cell", "r", "g", "b")))
    lines = seen.groupBy("image_id", "y").agg(point.alias("p"))
    nothing = F.lit(None)
    heads = _entries(palette).select("image_id", F.lit(-1).alias("y"), "palette", nothing.cast(lines.schema["p"].dataType).alias("p"))
    both = heads.unionByName(lines.select("image_id", F.col("y").cast("int"), nothing.cast(heads.schema["palette"].dataType).alias("palette"), "p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            y, entries, p = batch.column("y").to_pylist(), batch.column("palette").to_pylist(), batch.column("p")
            offsets = p.offsets.to_numpy()
            for start, end in together(offsets):
                flat = p.values.slice(offsets[start], offsets[end] - offsets[start])
                cells, colours = flat.field("cell").to_pylist(), list(zip(*(flat.field(c).to_pylist() for c in "rgb")))
                got, at = [], (offsets[start : end + 1] - offsets[start]).tolist()
                for i in range(start, end):
                    if entries[i] is not None:
                        work = _Diffusion(entries[i], amount)
                        continue
                    mine = slice(at[i - start], at[i - start + 1])
                    got += work.line(y[i], cells[mine], colours[mine])
                of = pa.array(np.repeat(np.arange(start, end), np.diff(at)))
                yield pa.RecordBatch.from_arrays([batch.column("image_id").take(of), batch.column("y").take(of), flat.field("x").cast(pa.int32()), pa.array(got, pa.int32())], names=["image_id", "y", "x", "entry"])

    return both.repartition("image_id").sortWithinPartitions("image_id", "y").mapInArrow(run, INDICES)
