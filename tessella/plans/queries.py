"""Registered queries over rasters built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import colour
from tessella.functions.binary import image_format
from tessella.operators import files, metadata, pieces, pixels, samples
from tessella.sources import rasters
from tessella.streaming import ingest

RGBA = ("r", "g", "b", "a")
QUERIES: dict = {}


def red():
    return F.col("r")


def green():
    return F.col("g")


def blue():
    return F.col("b")


def alpha():
    return F.col("a")



def query(f):
    QUERIES[f.__name__] = f
    return f


def _r2(spark, sf_dir):
    return rasters.lineitem_pixels(spark, sf_dir)


def _r3(spark, sf_dir):
    return rasters.formula_pixels(spark, sf_dir)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, sniff, inspect, gate, decode and aggregate: mean colour and distinct colours of each image."""
    written = files.write_bmp(_r2(spark, sf_dir)).select("image_id", "content")
    decoded = files.read_bmp(written)
    return decoded.groupBy("image_id").agg(F.count("*").alias("n_pixels"), F.round(F.avg("r"), 4).alias("mean_r"), F.round(F.avg("g"), 4).alias("mean_g"), F.round(F.avg("b"), 4).alias("mean_b"), F.count_distinct("r", "g", "b").alias("n_colours"))


QUERIES["flagship"] = entry


# sources
@query
def raster_r1(s, d):
    return rasters.float_pixels(s, d).select("image_id", "y", "x", *(F.round(c, 6).alias(c) for c in RGBA))


@query
def raster_r2(s, d):
    return _r2(s, d)


@query
def raster_r3(s, d):
    return _r3(s, d)


@query
def raster_r4(s, d):
    return rasters.text_bytes(s, d)


def _order(order):
    def run(s, d):
        p = _r2(s, d)
        n = {"red": 1, "gray_alpha": 2}.get(order, len(order))
        out = colour.channel_order(order, [red(), green(), blue(), alpha()][:n])
        return p.select("image_id", "y", "x", *(c.cast("int").alias(k) for c, k in zip(out, RGBA)))

    return run


for _o in ("red", "gray_alpha", "rgb", "bgr", "rgba", "bgra", "argb", "abgr"):
    QUERIES[f"channel_order_{_o}"] = _order(_o)


def _orient(k):
    return lambda s, d: pixels.oriented(_r3(s, d), rasters.image_sizes(_r3(s, d)), k)


for _k in range(1, 9):
    QUERIES[f"orient_{_k}"] = _orient(_k)


@query
def oriented_dims(s, d):
    rows = rasters.image_sizes(_r2(s, d)).withColumn("orientation", (F.col("image_id") % 8 + 1).cast("int"))
    turned = F.col("orientation") >= 5
    return rows.select("image_id", "orientation", F.when(turned, F.col("height")).otherwise(F.col("width")).alias("oriented_width"), F.when(turned, F.col("width")).otherwise(F.col("height")).alias("oriented_height"))


# colour
def _rgb(p, cols):
    return p.select("image_id", "y", "x", *(c.alias(k) for c, k in zip(cols, ("c0", "c1", "c2"))))


@query
def white_composite(s, d):
    return _rgb(_r2(s, d), [colour.over_white(c, alpha()) for c in (red(), green(), blue())])


@query
def matte_composite(s, d):
    return _rgb(_r2(s, d), [colour.over_matte(c, alpha(), 64) for c in (red(), green(), blue())])


@query
def rgb_to_ycbcr(s, d):
    return _rgb(_r2(s, d), colour.rgb_to_ycbcr(red(), green(), blue()))


@query
def ycbcr_to_rgb(s, d):
    return _rgb(_r2(s, d), colour.ycbcr_to_rgb(red(), green(), blue()))


@query
def yuv_limited(s, d):
    return _rgb(_r2(s, d), colour.limited_yuv(red(), green(), blue()))


@query
def chroma_420(s, d):
    return pixels.chroma_420(_r3(s, d))


@query
def cmyk_to_rgb(s, d):
    return _rgb(_r2(s, d), [colour.cmyk_to_rgb(c, alpha()) for c in (red(), green(), blue())])


@query
def rct_forward(s, d):
    return _rgb(_r2(s, d), colour.rct(red(), green(), blue()))


@query
def rct_roundtrip(s, d):
    p = _r2(s, d)
    y, co, cg = colour.rct(red(), green(), blue())
    p = p.withColumns({"k0": y, "k1": co, "k2": cg})
    r, g, b = colour.rct_inverse(F.col("k0"), F.col("k1"), F.col("k2"))
    return p.select("image_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"), "a")


@query
def subtract_green(s, d):
    return _rgb(_r2(s, d), colour.subtract_green(red(), green(), blue()))


@query
def unpremultiply(s, d):
    return _rgb(_r2(s, d), [colour.unpremultiply(c, alpha()) for c in (red(), green(), blue())])


@query
def scale_bits(s, d):
    five = F.shiftright("r", 3)
    return _r2(s, d).select("image_id", "y", "x", colour.scale_truncated(five, 31).alias("c0"), colour.scale_rounded(five, 31).alias("c1"), colour.scale_rounded(F.shiftright("g", 4), 15).alias("c2"))


@query
def unpack_bits(s, d):
    p = _r2(s, d).select("image_id", "y", "x", "r", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    return p.select("image_id", "y", (F.col("x") * 8 + F.col("bit")).alias("x"), F.expr("(r >> (7 - bit)) & 1").alias("v"))


@query
def float_to_byte(s, d):
    return _rgb(rasters.float_pixels(s, d), [colour.unit_to_byte(c) for c in (red(), green(), blue())])


@query
def extended_srgb(s, d):
    return _rgb(rasters.float_pixels(s, d), [F.round(colour.srgb_encode(c), 6) for c in (red(), green(), blue())])


@query
def spot_composite(s, d):
    mixed = lambda c: F.round(alpha() / 255 * 200 + (1 - alpha() / 255) * c, 6)
    return _rgb(_r2(s, d), [mixed(c) for c in (red(), green(), blue())])


# bilevel
@query
def bilevel_threshold(s, d):
    black = colour.luma_threshold(red(), green(), blue(), alpha(), 128)
    return _r2(s, d).groupBy("image_id").agg(F.sum(black.cast("long")).alias("n_black"), F.count("*").alias("n"))


def _bitop(op):
    def run(s, d):
        f = {"or": lambda: red().bitwiseOR(green()), "and": lambda: red().bitwiseAND(green()), "xor": lambda: red().bitwiseXOR(green()), "xnor": lambda: F.bitwise_not(red().bitwiseXOR(green())).bitwiseAND(255), "replace": lambda: green()}[op]()
        return _r2(s, d).select("image_id", "y", "x", f.cast("int").alias("v"))

    return run


for _o in ("or", "and", "xor", "xnor", "replace"):
    QUERIES[f"combine_{_o}"] = _bitop(_o)


@query
def polarity(s, d):
    return _r2(s, d).select("image_id", "y", "x", F.bitwise_not(red()).bitwiseAND(F.when(F.col("x") == 15, 240).otherwise(255)).cast("int").alias("v"))


@query
def is_bilevel(s, d):
    pure = (alpha() == 255) & (red() == green()) & (green() == blue()) & red().isin(0, 255)
    return _r2(s, d).groupBy("image_id").agg(F.bool_and(pure).alias("bilevel"), F.bool_and(alpha() == 255).alias("opaque"), F.bool_or(alpha() != 255).alias("alpha_used"))


# neighbours and runs
@query
def png_filter_choice(s, d):
    return pixels.png_filters(_r2(s, d))


@query
def gradient_residual(s, d):
    return pixels.gradient_residuals(_r2(s, d), "g")


@query
def horizontal_predictor(s, d):
    return pixels.horizontal_differences(_r2(s, d))


@query
def horizontal_predictor_undo(s, d):
    return pixels.horizontal_sums(pixels.horizontal_differences(_r2(s, d)))


def delta_pieces(s, d):
    return pieces.differences(rasters.text_pieces(s, d, before=2))


@query
def byte_delta(s, d):
    """Even bytes of each text, then odd ones, each less the one before it and 128, modulo 256; the first one as it is."""
    return pieces.single_bytes(delta_pieces(s, d))


@query
def runs_raster(s, d):
    return pixels.runs(rasters.block_pixels(s, d), False, 62)


@query
def runs_rows(s, d):
    return pixels.runs(rasters.block_pixels(s, d), True, 128)


@query
def run_expansion(s, d):
    p = pixels.runs(rasters.block_pixels(s, d), True, 128)
    return p.select("image_id", "y", "x", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("k")).select("image_id", "y", (F.col("x") + F.col("k")).cast("int").alias("x")).groupBy("image_id", "y").agg(F.count("*").alias("n"), F.max("x").alias("last"))


@query
def interlace_rows(s, d):
    p = _r3(s, d).select("image_id", "y").distinct()
    passes = F.when(F.col("y") % 8 == 0, 0).when(F.col("y") % 8 == 4, 1).when(F.col("y") % 4 == 2, 2).otherwise(3)
    return p.select("image_id", "y", passes.cast("int").alias("pass"))


@query
def adam7_passes(s, d):
    x, y = F.col("x"), F.col("y")
    p = F.when((x % 8 == 0) & (y % 8 == 0), 1).when((x % 8 == 4) & (y % 8 == 0), 2).when((x % 4 == 0) & (y % 8 == 4), 3).when((x % 4 == 2) & (y % 4 == 0), 4).when((x % 2 == 0) & (y % 4 == 2), 5).when((x % 2 == 1) & (y % 2 == 0), 6).otherwise(7)
    return _r3(s, d).groupBy("image_id", p.cast("int").alias("pass")).agg(F.count("*").alias("n"), F.sum("r").alias("sum_r"))


# aggregates
@query
def hist555(s, d):
    return pixels.histogram555(_r2(s, d))


@query
def first_colour_cell(s, d):
    return pixels.first_colours(_r2(s, d))


@query
def nearest_palette(s, d):
    cube = [(r, g, b) for r in (0, 85, 170, 255) for g in (0, 85, 170, 255) for b in (0, 85, 170, 255)]
    return pixels.nearest_palette(_r2(s, d), cube)


@query
def palette_distinct(s, d):
    return pixels.distinct_colours(rasters.block_pixels(s, d))


@query
def gray_palette_worth(s, d):
    return pixels.gray_palette(_r2(s, d))


@query
def channel_entropy(s, d):
    return pixels.entropy(_r2(s, d), "b")


@query
def box_downsample(s, d):
    return pixels.box_downsample(_r3(s, d), rasters.image_sizes(_r3(s, d)), 8, 5)


@query
def opaque_fix(s, d):
    p = _r2(s, d).withColumn("a", F.when(F.col("image_id") % 2 == 0, 0).otherwise(alpha()).cast("int"))
    return pixels.opaque_if_empty(p)


@query
def mean_error(s, d):
    p = _r2(s, d)
    return pixels.mean_absolute_error(p, p.withColumn("r", F.shiftright("r", 2) * 4))


@query
def line_cover(s, d):
    return _r2(s, d).groupBy("image_id").agg(F.count_distinct("y").alias("lines"), (F.max("y") + 1 == F.count_distinct("y")).alias("covered"))


@query
def palette_lookup(s, d):
    """Nation number as an index into the regions: indices out of range give no colour."""
    n = rasters.table(s, d, "nation").select(F.col("n_nationkey").alias("entry"))
    p = _r3(s, d).select("image_id", "y", "x", (red() % 32).alias("entry"))
    return p.join(n.withColumn("colour", F.col("entry") * 10), "entry", "left").groupBy("image_id").agg(F.count("*").alias("n"), F.count("colour").alias("found"), F.sum("colour").cast("long").alias("total"))


# files
def _written(fmt):
    def run(s, d):
        f = getattr(files, f"write_{fmt}")(_r2(s, d))
        return f.select("image_id", F.octet_length("content").cast("long").alias("length"), F.md5(F.hex("content")).alias("digest"))

    return run


def _back(fmt):
    def run(s, d):
        return getattr(files, f"read_{fmt}")(getattr(files, f"write_{fmt}")(_r2(s, d)).select("image_id", "content"))

    return run


for _o in ("bmp", "tga", "tiff"):
    QUERIES[f"encode_{_o}"] = _written(_o)
    QUERIES[f"roundtrip_{_o}"] = _back(_o)


def _all_files(s, d):
    """One file of each writable format for each image, and texts that are none."""
    number = F.when(F.col("format") == "bmp", 0).when(F.col("format") == "tga", 1).when(F.col("format") == "tiff", 2).otherwise(3)
    out = files.write_all(_r2(s, d)).select((F.col("image_id") * 8 + number).alias("image_id"), "content")
    none = rasters.table(s, d, "region").select((F.col("r_regionkey").cast("long") * 8 + 7).alias("image_id"), F.encode("r_name", "UTF-8").alias("content"))
    return out.unionByName(none)


@query
def sniff_formats(s, d):
    return _all_files(s, d).select("image_id", image_format("content").alias("format"))


@query
def sniff_signatures(s, d):
    from tessella.functions.binary import SIGNATURES

    made = [(i * 10 + j, h) for i, (_, starts) in enumerate(SIGNATURES) for j, h in enumerate(starts)]
    n = rasters.table(s, d, "region").select("r_regionkey").where("r_regionkey = 0")
    rows = n.select(F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(h).alias("h")) for i, h in made))).alias("e")).select("e.*")
    return rows.select("k", image_format(F.unhex(F.concat("h", F.lit("0000000057454250")))).alias("format"))


@query
def inspect_headers(s, d):
    return files.inspect(_all_files(s, d)).where("width is not null").select("image_id", "format", "width", "height", "bits", F.round("ppi_x", 6).alias("ppi_x"))


@query
def budget_filter(s, d):
    return files.within_budget(files.inspect(_all_files(s, d)), max_pixels=600).select("image_id", "width", "height")


@query
def file_outcomes(s, d):
    """What becomes of every file; every third one is cut in the middle, and the budget is small."""
    f = _all_files(s, d).withColumn("content", F.when(F.col("image_id") % 3 == 0, F.expr("substring(content, 1, octet_length(content) div 2)")).otherwise(F.col("content")))
    return files.outcomes(f, max_pixels=640)


@query
def metadata_headers(s, d):
    """Headers of JPEG, WebP and OpenEXR files."""
    return metadata.inspect_metadata(rasters.header_files(s, d)).select("image_id", "format", "width", "height", "bits", "model", "orientation", F.round("ppi_x", 6).alias("ppi_x"), F.round("ppi_y", 6).alias("ppi_y"), "exif_bytes", "error")


@query
def metadata_written(s, d):
    """Headers of the written files, those in formats with a walk."""
    return metadata.inspect_metadata(_all_files(s, d)).select("image_id", "format", "width", "height", "bits", "error")


@query
def png_chunks(s, d):
    return files.chunks(files.write_png(_r2(s, d)).select("image_id", "content"))


@query
def encode_limits(s, d):
    """Which formats may hold each size (limits are fixed values)."""
    rows = rasters.image_sizes(_r2(s, d)).withColumn("height", F.col("height") * 700)
    return rows.select("image_id", (F.col("height") <= 65535).alias("gif"), (F.col("height") <= 16384).alias("webp_lossless"), (F.col("height") <= 16383).alias("webp_lossy"))


@query
def joined_segments(s, d):
    seg = rasters.table(s, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("chunk"))
    from pyspark.sql import Window

    return files.joined_segments(seg.withColumn("total", F.max("seq").over(Window.partitionBy("image_id"))))


# image analytics
def _meta(s, d):
    return files.inspect(_all_files(s, d)).withColumn("length", F.octet_length("content").cast("long"))


@query
def format_inventory(s, d):
    m = _meta(s, d).withColumn("format", F.coalesce("format", F.lit("none")))
    return m.groupBy("format").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.coalesce(F.max("height"), F.lit(0)).alias("tallest"))


@query
def format_cube(s, d):
    m = _meta(s, d).withColumn("format", F.coalesce("format", F.lit("none"))).withColumn("tall", F.coalesce(F.col("height") > 38, F.lit(False)).cast("int"))
    cube = m.cube("format", "tall").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
    return cube.select(F.coalesce("format", F.lit("all")).alias("format"), F.coalesce("tall", F.lit(-1)).alias("tall"), "n", "level")


@query
def top_k_largest(s, d):
    return _meta(s, d).orderBy(F.desc("length"), "image_id").limit(10).select("image_id", "format", "length")


@query
def duplicates_by_hash(s, d):
    p = rasters.block_pixels(s, d).withColumn("r", F.shiftright("r", 7))
    return files.write_bmp(p).groupBy(F.md5(F.hex("content")).alias("digest")).agg(F.count("*").alias("n"), F.min("image_id").alias("first"))


@query
def missing_profile(s, d):
    named = rasters.table(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("image_id"))
    return rasters.image_sizes(_r2(s, d)).join(named, "image_id", "left_anti")


@query
def rank_by_height(s, d):
    from pyspark.sql import Window

    m = _meta(s, d).where("format is not null")
    return m.select("image_id", "format", F.rank().over(Window.partitionBy("format").orderBy(F.desc("height"))).alias("rank"))


@query
def colour_totals(s, d):
    return _r2(s, d).groupBy("image_id").agg(*(F.sum(c).alias(f"sum_{c}") for c in RGBA), F.min("r").alias("low"), F.max("r").alias("high"))


@query
def stream_states(s, d):
    c = rasters.table(s, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.length("props").alias("size"))
    return ingest.stream_progress(c, 400)


@query
def arriving_totals(s, d):
    out = ingest.arriving_totals(rasters.table(s, d, "events"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "bytes")


# more colour
@query
def lab_to_srgb(s, d):
    return _rgb(_r2(s, d), [F.round(c, 6) for c in colour.lab_to_srgb(red() / 255, green() / 255, blue() / 255)])


@query
def rct_inverse_types(s, d):
    p = _r2(s, d).withColumn("kind", (F.col("image_id") % 7).cast("int"))
    out = colour.rct_inverse_type(F.col("kind"), red(), green() - 128, blue() - 128)
    return p.select("image_id", "y", "x", "kind", *(c.alias(k) for c, k in zip(out, ("c0", "c1", "c2"))))


@query
def cross_colour(s, d):
    return _rgb(_r2(s, d), colour.cross_colour(red(), green(), blue(), -20, 13, 7))


@query
def colour_key(s, d):
    return rasters.block_pixels(s, d).select("image_id", "y", "x", colour.colour_key(red(), green(), blue(), (0, 0, 0)).alias("a"))


@query
def invert_gray(s, d):
    return _r2(s, d).select("image_id", "y", "x", (255 - red()).cast("int").alias("v"))


@query
def upsample_replicate(s, d):
    return samples.upsample_replicated(pixels.chroma_420(_r3(s, d)), "u", F.lit(35), F.lit(22))


def _blend(mode):
    return lambda s, d: _r2(s, d).select("image_id", "y", "x", F.round(colour.blend(mode, red() / 255, green() / 255, alpha() / 255), 9).alias("v"))


for _o in ("replace", "add", "blend", "multiply_add", "multiply"):
    QUERIES[f"frame_{_o}"] = _blend(_o)


@query
def frame_durations(s, d):
    e = rasters.table(s, d, "events")
    return e.select("event_id", colour.microseconds(F.col("user_id"), F.col("event_id") % 90, F.lit(7)).alias("us"))
