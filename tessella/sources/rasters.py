"""Raster sources: pixel relations and encoded files.

A pixel relation has a row for each pixel: image_id, y, x and one integer
column per channel. It is the form in which relational operators apply; a file
relation (path, content) is the form in which rasters are stored and moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.binary import hex_uint
from tessella.operators import pieces

CHANNELS = ("r", "g", "b", "a")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Encoded files (path, modificationTime, length, content); filters on the first three skip reading content."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


#: Order keys of a range within which line items are numbered; an order has 7 items at most.
KEYS = 8192


def lineitem_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An RGBA image 16 pixels wide for each supplier, from its line items in a total order; empty pixels fill up the last row.

    Items are numbered within ranges of order keys; what comes before a range is a sum over
    the counts of ranges. So no task sorts all items of a supplier.
    """
    items = table(spark, sf_dir, "lineitem").withColumn("range", F.expr(f"l_orderkey div {KEYS}"))
    counts = items.groupBy(F.col("l_suppkey").alias("image_id"), "range").agg(F.count("*").alias("n"))
    of, up_to = Window.partitionBy("image_id"), Window.partitionBy("image_id").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select("image_id", "range", (F.sum("n").over(up_to) - F.col("n")).alias("before"), F.sum("n").over(of).alias("total"), F.max("range").over(of).alias("last"))
    order = Window.partitionBy("image_id", "range").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    rows = items.select(
        F.col("l_suppkey").alias("image_id"),
        *("range", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate"),
        (F.col("l_orderkey") % 256).cast("int").alias("r"),
        (F.col("l_partkey") % 256).cast("int").alias("g"),
        (F.col("l_quantity").cast("int") * 5 % 256).cast("int").alias("b"),
        F.when(F.col("l_returnflag") == "R", F.col("l_linenumber").cast("int") * 36 % 256).otherwise(255).cast("int").alias("a"),
    )
    numbered = rows.withColumn("k", F.row_number().over(order) - 1).join(counts.select("image_id", "range", "before").hint("merge"), ["image_id", "range"])
    numbered = numbered.select("image_id", (F.col("before") + F.col("k")).alias("i"), *CHANNELS)
    fill = counts.where("range = last and total % 16 > 0").select("image_id", F.explode(F.expr("sequence(total, total + 15 - total % 16)")).alias("i"), *(F.lit(0).alias(c) for c in CHANNELS))
    return numbered.unionByName(fill).select("image_id", F.shiftright("i", 4).cast("int").alias("y"), (F.col("i") % 16).cast("int").alias("x"), *CHANNELS)


def image_sizes(pixels: DataFrame) -> DataFrame:
    """image_id, width, height."""
    return pixels.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def float_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 4 x 4 RGBA image of floats for each embedding."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))).alias("i", "p"))
    at = lambda k: F.col("p")[k].cast("double")
    return rows.select(F.col("vec_id").alias("image_id"), F.shiftright("i", 2).alias("y"), (F.col("i") % 4).alias("x"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), at(3).alias("a"))


#: Images from formulas that one task makes.
IMAGES = 512


def supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id and n of each supplier, IMAGES to a partition.

    A small file of keys is one partition, and so would be all pixels made from it.
    Their number is given, as a partition is judged by the bytes of its keys otherwise.
    """
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("image_id"), (F.col("s_suppkey") + F.col("s_nationkey") * 31).cast("int").alias("n"))
    return keys.repartition(keys.count() // IMAGES + 1, "image_id")


def formula_pixels(spark: SparkSession, sf_dir: str, width: int = 35, height: int = 22) -> DataFrame:
    """An image from closed formulas over the keys of each supplier."""
    keys = supplier_keys(spark, sf_dir)
    grid = keys.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    x, y, n = F.col("x"), F.col("y"), F.col("n")
    return grid.select("image_id", "y", "x", (x * 17 + y * 3 + n).bitwiseAND(255).alias("r"), (x * 5 + y * 11).bitwiseAND(255).alias("g"), (x * 7).bitwiseXOR(y * 13).bitwiseAND(255).alias("b"), F.when((x + y) % 19 == 0, 96).otherwise(255).alias("a"))


def block_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with runs: blocks of 5 by 3 equal pixels, for each supplier."""
    keys = supplier_keys(spark, sf_dir)
    p = keys.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(21)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(34))))
    bx, by = F.expr("x div 5").cast("int"), F.expr("y div 3").cast("int")
    return p.select("image_id", "y", "x", (bx * 51 + F.col("n")).bitwiseAND(255).alias("r"), (by * 29).bitwiseAND(255).alias("g"), ((bx + by) * 13).bitwiseAND(255).alias("b"), F.lit(255).alias("a"))


#: Bytes of a text that are taken apart at once.
PIECE = 1024


def text_pieces(spark: SparkSession, sf_dir: str, before: int = 0) -> DataFrame:
    """image_id, n (bytes of the text), last_even (its last byte at an even place), at, piece: texts in pieces, each with ``before`` bytes ahead of it.

    Pieces are made inside the row of the text, so that no later row carries the whole text, and
    dealt to tasks: a file of texts may be one row group, and so one task.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.encode("text", "UTF-8").alias("raw")).where(F.octet_length("raw") > 0)
    piece = lambda i: F.struct((i * PIECE).alias("at"), F.substring("raw", F.greatest(i * PIECE - before, F.lit(0)) + 1, F.least(i * PIECE, F.lit(before)) + PIECE).alias("piece"))
    made = docs.select("image_id", F.octet_length("raw").alias("n"), F.expr("substring(raw, (octet_length(raw) - 1) div 2 * 2 + 1, 1)").alias("last_even"), F.transform(F.expr(f"sequence(0, (octet_length(raw) - 1) div {PIECE})"), piece).alias("p"))
    return made.select("image_id", "n", "last_even", F.explode("p").alias("p")).select("image_id", "n", "last_even", "p.at", "p.piece").repartition("image_id", "at")


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of gray bytes: image_id, x, v."""
    return pieces.single_bytes(text_pieces(spark, sf_dir))


def header_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JPEG, a WebP and an OpenEXR header without pixels for each supplier: image_id, content."""
    key = F.col("s_suppkey")
    w, h, dense, turn = key % 4000 + 1, F.col("s_nationkey") * 9 + 7, key % 300 + 1, key % 8 + 1
    text = lambda t: t.encode("latin-1").hex().upper()
    exif = F.concat(F.lit("FFE10022" + text("Exif\0\0II*\0") + "08000000" + "0100" + "1201" + "0300" + "01000000"), hex_uint(turn, 2), F.lit("0000" + "00000000"))
    frame = F.concat(F.lit("FFC0001108"), hex_uint(h, 2, little=False), hex_uint(w, 2, little=False), F.lit("03" + "011100" + "021101" + "031101"))
    jpeg = F.concat(F.lit("FFD8FFE00010" + text("JFIF\0") + "010101"), hex_uint(dense, 2, little=False), hex_uint(dense + 1, 2, little=False), F.lit("0000"), exif, frame, F.lit("FFDA000C03010002110311003F00FFD9"))
    webp = F.concat(F.lit(text("RIFF") + "16000000" + text("WEBPVP8X") + "0A00000000000000"), hex_uint(w - 1, 3), hex_uint(h - 1, 3))
    exr = F.concat(F.lit("762F310102000000" + text("channels\0chlist\0") + "25000000" + text("A\0") + "01000000" + "00" * 12 + text("R\0") + "02000000" + "00" * 12 + "00" + text("dataWindow\0box2i\0") + "10000000" + "FFFFFFFF" + "00000000"), hex_uint(w - 2, 4), hex_uint(h - 1, 4), F.lit("00"))
    rows = table(spark, sf_dir, "supplier").select(key.cast("long").alias("image_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("h")) for k, c in enumerate((jpeg, webp, exr))))).alias("f"))
    return rows.select((F.col("image_id") * 3 + F.col("f.k")).alias("image_id"), F.unhex("f.h").alias("content"))
