"""Operators on pixel relations: joins, aggregates and windows per image.

Every window and aggregate is keyed by image and, where the operator allows,
by row or block, so one large image spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import colour

RGBA = ("r", "g", "b", "a")


def with_sizes(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels with what is known of their image, one row an image.

    By a hash table of each partition: pixels that are exploded out of a few keys look small
    to the optimizer, which would send them, or all sizes, to every task through the driver.
    """
    return pixels.join(sizes.hint("shuffle_hash"), "image_id")


def oriented(pixels: DataFrame, sizes: DataFrame, orientation: int) -> DataFrame:
    both = with_sizes(pixels, sizes)
    x, y = colour.orient(orientation, F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return both.select("image_id", y.cast("int").alias("y"), x.cast("int").alias("x"), *RGBA)


def neighbours(pixels: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """Adds for each channel c its left c_l, upper c_u and upper-left c_ul neighbour, 0 outside."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    column = Window.partitionBy("image_id", "x").orderBy("y")
    out = pixels.withColumns({f"{c}_u": F.coalesce(F.lag(c).over(column), F.lit(0)) for c in channels})
    return out.withColumns({f"{c}_l": F.coalesce(F.lag(c).over(row), F.lit(0)) for c in channels} | {f"{c}_ul": F.coalesce(F.lag(f"{c}_u").over(row), F.lit(0)) for c in channels})


def paeth(a: Column, b: Column, c: Column) -> Column:
    """Of left, up and upper left the one nearest to a + b - c, in that order of preference."""
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - c - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def block_mode_guess(mode: int, c: str) -> Column:
    """The guess of a block's mode (1 left, 2 up, 7 their mean, 11 the one that the corner speaks for) for channel c among ``neighbours``.

    The first row is predicted from the left, the first column from above, the first pixel from opaque black.
    """
    first_row, first_column = F.col("y") == 0, F.col("x") == 0
    left, up = F.col(f"{c}_l"), F.col(f"{c}_u")
    left_far = sum((F.abs(F.col(f"{k}_l") - F.col(f"{k}_ul")) for k in RGBA), F.lit(0))
    up_far = sum((F.abs(F.col(f"{k}_u") - F.col(f"{k}_ul")) for k in RGBA), F.lit(0))
    inner = {1: left, 2: up, 7: F.shiftright(left + up, 1), 11: F.when(left_far <= up_far, up).otherwise(left)}[mode]
    return F.when(first_row & first_column, 255 if c == "a" else 0).when(first_row, left).when(first_column, up).otherwise(inner)


def png_filters(pixels: DataFrame) -> DataFrame:
    """The filter of each row with the least sum of absolute residuals, the lowest number on a tie; up and Paeth not on the first row."""
    near = neighbours(pixels, RGBA)

    def cost(kind: int) -> Column:
        total = F.lit(0)
        for c in RGBA:
            v, left, up, corner = (F.col(x) for x in (c, f"{c}_l", f"{c}_u", f"{c}_ul"))
            guess = (F.lit(0), left, up, F.shiftright(left + up, 1), paeth(left, up, corner))[kind]
            m = (v - guess).bitwiseAND(255)
            total = total + F.least(m, 256 - m)
        return total

    costs = near.select("image_id", "y", *(cost(k).alias(f"f{k}") for k in range(5)))
    rows = costs.groupBy("image_id", "y").agg(*(F.sum(f"f{k}").alias(f"f{k}") for k in range(5)))
    best = F.least(F.col("f0"), F.col("f1"), F.col("f3"), F.when(F.col("y") > 0, F.col("f2")), F.when(F.col("y") > 0, F.col("f4")))
    rows = rows.withColumn("score", best)
    pick = F.when(F.col("f0") == best, 0).when(F.col("f1") == best, 1).when((F.col("y") > 0) & (F.col("f2") == best), 2).when(F.col("f3") == best, 3).otherwise(4)
    return rows.select("image_id", "y", pick.cast("int").alias("filter"), F.col("score").cast("long").alias("score"))


def gradient_residuals(pixels: DataFrame, channel: str) -> DataFrame:
    """Residuals of the clamped gradient predictor."""
    near = neighbours(pixels, (channel,))
    left, up, corner = (F.col(f"{channel}_{k}") for k in ("l", "u", "ul"))
    row0, col0 = F.col("y") == 0, F.col("x") == 0
    left = F.when(col0, F.when(row0, F.lit(0)).otherwise(up)).otherwise(left)
    up = F.when(row0, left).otherwise(up)
    corner = F.when(row0 | col0, left).otherwise(corner)
    guess = F.least(F.greatest(left + up - corner, F.least(left, up)), F.greatest(left, up))
    return near.select("image_id", "y", "x", (F.col(channel) - guess).cast("int").alias("residual"))


def horizontal_differences(pixels: DataFrame) -> DataFrame:
    """Each sample less its left neighbour, modulo 256."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    return pixels.select("image_id", "y", "x", *((F.col(c) - F.coalesce(F.lag(c).over(row), F.lit(0))).bitwiseAND(255).cast("int").alias(c) for c in RGBA))


def horizontal_sums(differences: DataFrame) -> DataFrame:
    """Undoes horizontal_differences by a running sum modulo 256."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    return differences.select("image_id", "y", "x", *(F.sum(c).over(row).bitwiseAND(255).cast("int").alias(c) for c in RGBA))


def row_runs(pixels: DataFrame) -> DataFrame:
    """Maximal runs of equal pixels within rows: image_id, y, x of the first pixel, length, value."""
    order = Window.partitionBy("image_id", "y").orderBy("x")
    value = F.struct(*RGBA)
    marked = pixels.select("image_id", "y", "x", value.alias("value"), F.coalesce(F.lag(value).over(order) != value, F.lit(True)).cast("int").alias("turn"))
    marked = marked.withColumn("run", F.sum("turn").over(order))
    out = marked.groupBy("image_id", "y", "run").agg(F.min("x").alias("x"), F.count("*").cast("int").alias("length"), F.first("value").alias("value"))
    return out.drop("run")


def raster_runs(pixels: DataFrame) -> DataFrame:
    """Maximal runs in raster order: image_id, y and x of the first pixel, length, value.

    Runs are found row by row and joined over the ends of rows: only one row a line
    of the image goes through a window of the whole image.
    """
    rows = row_runs(pixels)
    ends = Window.partitionBy("image_id").orderBy("y")
    lines = rows.groupBy("image_id", "y").agg(F.min_by("value", "x").alias("first"), F.max_by("value", "x").alias("last"), F.max("x").alias("last_x"), F.count("*").alias("n"))
    lines = lines.withColumn("linked", F.coalesce(F.lag("last").over(ends) == F.col("first"), F.lit(False)))
    # the place of the run that is open at the end of each line
    lines = lines.withColumn("open", F.last(F.when((F.col("n") > 1) | ~F.col("linked"), F.struct("y", F.col("last_x").alias("x"))), ignorenulls=True).over(ends))
    lines = lines.select("image_id", "y", F.when(F.col("linked"), F.lag("open").over(ends)).alias("joins"))
    # lines of images that were exploded out of keys look small, see with_sizes
    keyed = rows.join(lines.hint("merge"), ["image_id", "y"]).withColumn("head", F.when((F.col("x") == 0) & F.col("joins").isNotNull(), F.col("joins")).otherwise(F.struct("y", "x")))
    out = keyed.groupBy("image_id", "head").agg(F.sum("length").cast("int").alias("length"), F.first("value").alias("value"))
    return out.select("image_id", "head.y", "head.x", "length", "value")


def runs(pixels: DataFrame, by_row: bool, longest: int) -> DataFrame:
    """Maximal runs of equal pixels, in raster order or within rows: image_id, y, x of the first pixel, length, packets of at most ``longest``."""
    found = row_runs(pixels) if by_row else raster_runs(pixels)
    return found.select("image_id", "y", "x", "length", F.ceil(F.col("length") / longest).cast("int").alias("packets"))


def cell555(pixels: DataFrame, matte: int = 255, threshold: int = 128) -> DataFrame:
    """Pixels over a matte with the 15-bit cell of their colour; transparent ones are left out."""
    seen = pixels.where(F.col("a") >= threshold).select("image_id", "y", "x", *(colour.over_matte(F.col(c), F.col("a"), matte).alias(c) for c in "rgb"))
    cell = F.shiftleft(F.shiftright("r", 3), 10) + F.shiftleft(F.shiftright("g", 3), 5) + F.shiftright("b", 3)
    return seen.withColumn("cell", cell.cast("int"))


def histogram555(pixels: DataFrame) -> DataFrame:
    """Count and rounded mean colour of each cell."""
    mean = lambda c: F.round(F.sum(c) / F.count("*")).cast("int").alias(c)
    return cell555(pixels).groupBy("image_id", "cell").agg(F.count("*").alias("n"), mean("r"), mean("g"), mean("b"))


def first_colours(pixels: DataFrame) -> DataFrame:
    """The first colour of each cell in raster order."""
    first = F.min_by(F.struct("r", "g", "b"), F.struct("y", "x"))
    return cell555(pixels).groupBy("image_id", "cell").agg(first.alias("c")).select("image_id", "cell", "c.r", "c.g", "c.b")


def nearest_palette(pixels: DataFrame, palette: list[tuple[int, int, int]]) -> DataFrame:
    """For each cell the palette entry nearest to its first colour, weights 3, 4, 2, the lowest index on a tie.

    The palette is a literal of at most 256 entries, so the search is an
    expression on each row and needs no join.
    """
    first = first_colours(pixels)
    squared = lambda c, v: (F.col(c) - v) * (F.col(c) - v)
    entries = [F.struct((squared("r", r) * 3 + squared("g", g) * 4 + squared("b", b) * 2).cast("int").alias("d"), F.lit(i).alias("i")) for i, (r, g, b) in enumerate(palette)]
    return first.select("image_id", "cell", F.array_min(F.array(*entries)).alias("m")).select("image_id", "cell", F.col("m.i").alias("entry"), F.col("m.d").alias("distance"))


def distinct_colours(pixels: DataFrame) -> DataFrame:
    """Distinct colours of each image with their number of pixels."""
    return pixels.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))


def gray_palette(pixels: DataFrame, channel: str = "g") -> DataFrame:
    """Distinct values, span, and whether a palette is worth it (fewer than four fifths of the span)."""
    out = pixels.groupBy("image_id").agg(F.count_distinct(channel).alias("n"), (F.max(channel) - F.min(channel) + 1).cast("long").alias("span"))
    return out.withColumn("worth", F.col("n") * 5 < F.col("span") * 4)


def entropy(pixels: DataFrame, channel: str) -> DataFrame:
    """Zero-order entropy of a channel in bits, from a histogram aggregated first."""
    counts = pixels.groupBy("image_id", channel).agg(F.count("*").alias("c"))
    h = counts.groupBy("image_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return h.select("image_id", F.round(F.log2("n") - F.col("s") / F.col("n"), 6).alias("bits"))


def box_downsample(pixels: DataFrame, sizes: DataFrame, width: int, height: int) -> DataFrame:
    """Mean over the boxes of a smaller grid; boxes overlap where the ratio is fractional.

    A pixel lies in one or two boxes along each axis; they are listed by
    arithmetic, so there is no range join.
    """
    both = with_sizes(pixels, sizes)

    def boxes(at: str, size: str, n: int) -> Column:
        low = F.expr(f"greatest(0, ({at} * {n}) div {size} - 1)")
        grid = F.sequence(low.cast("int"), F.least(F.expr(f"({at} * {n}) div {size} + 1").cast("int"), F.lit(n - 1)))
        return F.filter(grid, lambda i: (F.col(at) >= F.floor(i * F.col(size) / n)) & (F.col(at) < F.ceil((i + 1) * F.col(size) / n)))

    spread = both.withColumn("by", F.explode(boxes("y", "height", height))).withColumn("bx", F.explode(boxes("x", "width", width)))
    mean = lambda c: F.round(F.avg(c)).cast("int").alias(c)
    return spread.groupBy("image_id", F.col("by").alias("y"), F.col("bx").alias("x")).agg(*(mean(c) for c in RGBA), F.count("*").alias("n"))


def chroma_420(pixels: DataFrame) -> DataFrame:
    """Limited-range chroma of two by two pixels, summed and rounded."""
    _, u, v = colour.limited_yuv(F.col("r"), F.col("g"), F.col("b"))
    halves = pixels.select("image_id", F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"), u.alias("u"), v.alias("v"))
    mean = lambda c: F.floor((F.sum(c) * 2 + F.count("*")) / (F.count("*") * 2)).cast("int").alias(c)
    return halves.groupBy("image_id", "y", "x").agg(mean("u"), mean("v"))


def opaque_if_empty(pixels: DataFrame) -> DataFrame:
    """Alpha 255 everywhere in images that are transparent everywhere."""
    most = pixels.groupBy("image_id").agg(F.max("a").alias("most"))
    return with_sizes(pixels, most).withColumn("a", F.when(F.col("most") == 0, 255).otherwise(F.col("a")).cast("int")).drop("most")


def mean_absolute_error(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean absolute difference of the colour samples of two versions of the images."""
    b = right.select("image_id", "y", "x", *(F.col(c).alias(f"{c}2") for c in "rgb"))
    off = sum((F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"), F.lit(0))
    return left.join(b, ["image_id", "y", "x"]).groupBy("image_id").agg(F.round(F.sum(off) / (F.count("*") * 3), 9).alias("error"))
