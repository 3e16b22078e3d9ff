"""Sample operators on pixel relations: predictors, packets, resampling, indices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import colour
from tessella.operators.pixels import RGBA, block_mode_guess, neighbours, raster_runs, runs, with_sizes


def predictions(pixels: DataFrame, channel: str) -> DataFrame:
    """The guesses of the predictors 0 to 13 (without the weighted one, 6), as p0, p1, ...

    Neighbours beyond the border are replaced by nearer ones, in the end by 0.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    v = F.col(channel).cast("int")
    near = pixels.select("image_id", "y", "x", v.alias("v"), F.lag(v, 1).over(column).alias("n"), F.lag(v, 2).over(column).alias("nn"))
    near = near.select("*", *(F.lag(c, k).over(row).alias(a) for a, c, k in (("w", "v", 1), ("ww", "v", 2), ("nw", "n", 1))), *(F.lead("n", k).over(row).alias(a) for a, k in (("ne", 1), ("nee", 2))))
    zero = F.lit(0)
    near = near.select("image_id", "y", "x", F.coalesce("w", "n", zero).alias("w"), F.coalesce("n", "w", zero).alias("n"), F.coalesce("nw", "w", "n", zero).alias("nw"), *("nn", "ww", "ne", "nee"))
    near = near.select("image_id", "y", "x", "w", "n", "nw", F.coalesce("nn", "n").alias("nn"), F.coalesce("ww", "w").alias("ww"), F.coalesce("ne", "n").alias("ne"), F.coalesce("nee", "ne", "n").alias("nee"))
    w, n, nw = F.col("w"), F.col("n"), F.col("nw")
    guess = {
        0: zero, 1: w, 2: n, 3: F.expr("(w + n) div 2"), 4: F.when(F.abs(n - nw) < F.abs(w - nw), w).otherwise(n),
        5: F.least(F.greatest(w + n - nw, F.least(w, n)), F.greatest(w, n)), 7: F.col("ne"), 8: nw, 9: F.col("ww"),
        10: F.expr("(w + nw) div 2"), 11: F.expr("(n + nw) div 2"), 12: F.expr("(n + ne) div 2"), 13: F.expr("(6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) div 16"),
    }
    return near.select("image_id", "y", "x", *(g.cast("int").alias(f"p{k}") for k, g in guess.items()))


def packets(pixels: DataFrame, least: int, longest: int = 128) -> DataFrame:
    """Run and literal packets of each row, greedy from the left: image_id, y, x, n, literal.

    A run of ``least`` equal pixels or more becomes packets of at most ``longest``;
    what lies between becomes literals of at most ``longest`` pixels, shorter runs
    in them are not split.
    """
    long = runs(pixels, True, longest)
    whole = F.transform(F.expr(f"sequence(0, (length - 1) div {longest})"), lambda i: F.struct((F.col("x") + i * longest).alias("x"), F.least(F.lit(longest), F.col("length") - i * longest).alias("n")))
    rows = long.select("image_id", "y", F.explode(whole).alias("p")).groupBy("image_id", "y").agg(F.sort_array(F.collect_list("p")).alias("p"))
    out_type = "array<struct<x:int,n:int,literal:boolean>>"

    def step(done, p):
        last = F.element_at(done, -1)
        joins = (p["n"] < least) & (F.size(done) > 0) & last["literal"] & (last["n"] + p["n"] <= longest)
        one = lambda x, n, literal: F.array(F.struct(x.cast("int").alias("x"), n.cast("int").alias("n"), literal.alias("literal")))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(done, 1, F.size(done) - 1), one(last["x"], last["n"] + p["n"], F.lit(True)))).otherwise(F.concat(done, one(p["x"], p["n"], p["n"] < least)))

    made = F.aggregate("p", F.array().cast(out_type), lambda done, p: step(done, p))
    return rows.select("image_id", "y", F.explode(made).alias("k")).select("image_id", "y", "k.x", "k.n", "k.literal")


def byte_packets(pixels: DataFrame, least: int = 3, longest: int = 128) -> DataFrame:
    """Packets of the interleaved bytes of each row: image_id, y, place (byte), n, literal.

    A run is cut into parts of ``longest`` bytes. Parts of ``least`` bytes or more repeat a
    byte; shorter ones are put together to literals of at most ``longest`` bytes, no part
    divided. Rows are packed on their own, so they are walked a row at a time.
    """

    def walk(data: np.ndarray):
        turns = np.flatnonzero(np.diff(data)) + 1
        starts = np.concatenate([[0], turns])
        literal = None
        for start, size in zip(starts.tolist(), np.diff(np.append(starts, len(data))).tolist()):
            for at in range(start, start + size, longest):
                n = min(longest, start + size - at)
                if n < least and literal is not None and literal[1] + n <= longest:
                    literal = (literal[0], literal[1] + n)
                    continue
                if literal is not None:
                    yield *literal, True
                    literal = None
                if n < least:
                    literal = (at, n)
                else:
                    yield at, n, False
        if literal is not None:
            yield *literal, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                p = batch.column("p")[i].values
                data = np.stack([p.field(c).to_numpy(zero_copy_only=False) for c in RGBA], axis=1).ravel()
                image, y = batch.column("image_id")[i].as_py(), batch.column("y")[i].as_py()
                rows += [(image, y, *packet) for packet in walk(data)]
            types = {"image_id": pa.int64(), "y": pa.int32(), "place": pa.int32(), "n": pa.int32(), "literal": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))

    lines = pixels.groupBy(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y")).agg(F.sort_array(F.collect_list(F.struct("x", *RGBA))).alias("p"))
    return lines.mapInArrow(run, "image_id long, y int, place int, n int, literal boolean")


def runs_from_opaque_black(pixels: DataFrame, longest: int = 62) -> DataFrame:
    """Repeats of the pixel before, in raster order, the first one compared with opaque black: image_id, y, x, length, packets."""
    widths = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"))
    found = with_sizes(raster_runs(pixels), widths)
    black = F.struct(*(F.lit(k).cast("int").alias(c) for c, k in zip("rgba", (0, 0, 0, 255))))
    whole = (F.col("y") == 0) & (F.col("x") == 0) & (F.col("value") == black)
    # but for that one, a run repeats from its second pixel on
    at = F.col("y") * F.col("width") + F.col("x") + F.when(whole, 0).otherwise(1)
    found = found.select("image_id", "width", at.alias("at"), F.when(whole, F.col("length")).otherwise(F.col("length") - 1).cast("int").alias("length")).where("length > 0")
    return found.select("image_id", F.expr("at div width").cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "length", F.ceil(F.col("length") / longest).cast("int").alias("packets"))


def upsample_triangle(plane: DataFrame, channel: str, width: Column, height: Column) -> DataFrame:
    """A plane doubled in both directions, three parts of the nearer sample and one of the other: image_id, y, x, channel.

    width, height: size of the result, by which it is cut.
    """
    column, row = Window.partitionBy("image_id", "x").orderBy("y"), Window.partitionBy("image_id", "dy", "y").orderBy("x")
    v, s = F.col(channel), F.col("s")
    tall = plane.select("image_id", "y", "x", *((v * 3 + F.coalesce(f(channel).over(column), v)).alias(f"s{k}") for k, f in ((0, F.lag), (1, F.lead))))
    tall = tall.select("image_id", "y", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("dy"), F.col(f"s{k}").alias("s")) for k in (0, 1)))).alias("e")).select("image_id", "y", "x", "e.dy", "e.s")
    wide = tall.select("image_id", (F.col("y") * 2 + F.col("dy")).alias("yy"), "x", *(F.shiftright(s * 3 + F.coalesce(f("s").over(row), s) + add, 4).alias(f"v{k}") for k, f, add in ((0, F.lag, 8), (1, F.lead, 7))))
    wide = wide.select("image_id", "yy", "x", F.explode(F.array(*(F.struct(F.lit(k).alias("dx"), F.col(f"v{k}").alias("v")) for k in (0, 1)))).alias("e"))
    out = wide.select("image_id", F.col("yy").alias("y"), (F.col("x") * 2 + F.col("e.dx")).alias("x"), F.col("e.v").cast("int").alias(channel))
    return out.where((F.col("y") < height) & (F.col("x") < width))


def upsample_replicated(plane: DataFrame, channel: str, width: Column, height: Column) -> DataFrame:
    """A plane doubled in both directions, each sample four times: image_id, y, x, channel.

    width, height: size of the result, by which it is cut.
    """
    doubled = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1))
    out = plane.select("image_id", doubled("y").alias("y"), "x", channel).select("image_id", "y", doubled("x").alias("x"), channel)
    return out.where((F.col("y") < height) & (F.col("x") < width))


def chroma_mean(pixels: DataFrame) -> DataFrame:
    """Full-range chroma over white, the mean of two by two pixels, around 0 (double)."""
    white = [colour.over_white(F.col(c), F.col("a")) for c in "rgb"]
    _, cb, cr = colour.rgb_to_ycbcr(*white)
    halves = pixels.select("image_id", F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"), (cb - 128).alias("cb"), (cr - 128).alias("cr"))
    return halves.groupBy("image_id", "y", "x").agg(*(F.avg(c).alias(c) for c in ("cb", "cr")))


def edge_replicated(pixels: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Images filled up to whole blocks with their last column and row."""
    both = with_sizes(pixels, sizes)
    along = lambda at, size: F.when(F.col(at) == F.col(size) - 1, F.sequence(F.col(at), F.expr(f"(({size} + {block - 1}) div {block}) * {block} - 1").cast("int"))).otherwise(F.array(at))
    grown = both.withColumn("y", F.explode(along("y", "height"))).withColumn("x", F.explode(along("x", "width")))
    return grown.select("image_id", "y", "x", "r", "g", "b", "a")


def unpacked_indices(packed: DataFrame, bits: int, width: Column) -> DataFrame:
    """Indices of 1, 2 or 4 bits from bytes (image_id, y, x, v), the lowest bits first, cut to the row's width."""
    per = 8 // bits
    each = packed.select("image_id", "y", "x", "v", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"))
    at = F.col("x") * per + F.col("k")
    return each.where(at < width).select("image_id", "y", at.cast("int").alias("x"), F.expr(f"(v >> (k * {bits})) & {(1 << bits) - 1}").cast("int").alias("entry"))


def packed_row(content: Column, stride: Column, y: Column, width: Column) -> Column:
    """The bytes of a row of RGBA samples whose rows start every ``stride`` bytes; the last row may be short of its stride."""
    return F.substring(content, (stride * y + 1).cast("int"), (width * 4).cast("int"))


def block_predictors(pixels: DataFrame, size: int = 32) -> DataFrame:
    """For each block the predictor with the least sum of residuals: image_id, block_y, block_x, mode, cost.

    Modes: 1 left, 2 up, 7 their mean, 11 the one that the corner speaks for; the
    first of them on a tie. The first row is predicted from the left, the first
    column from above, the first pixel is opaque black.
    """
    near = neighbours(pixels, RGBA)

    def cost(mode: int) -> Column:
        total = F.lit(0)
        for c in RGBA:
            off = (F.col(c) - block_mode_guess(mode, c)).bitwiseAND(255)
            total = total + F.least(off, 256 - off)
        return total

    costs = near.select("image_id", F.expr(f"y div {size}").cast("int").alias("block_y"), F.expr(f"x div {size}").cast("int").alias("block_x"), *(cost(m).alias(f"m{m}") for m in (1, 2, 7, 11)))
    sums = costs.groupBy("image_id", "block_y", "block_x").agg(*(F.sum(f"m{m}").alias(f"m{m}") for m in (1, 2, 7, 11)))
    least = F.array_min(F.array(*(F.struct(F.col(f"m{m}").alias("cost"), F.lit(m).alias("mode")) for m in (1, 2, 7, 11))))
    return sums.select("image_id", "block_y", "block_x", least.alias("b")).select("image_id", "block_y", "block_x", "b.mode", "b.cost")
