"""Encoded files as expressions: uncompressed writers and readers, headers, budgets.

Writers work by lines: the pixels of a line are gathered first, and the check sums
that a format needs come from sums over pixels; then the lines of an image make a
file. Readers go the other way, lines first, and a scan reads the headers before
that, so only images within the budget are exploded. Compressed formats need
sequential entropy decoders; they are not built here (see README): ``outcomes``
says of every file what becomes of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.binary import byte_at, hex_uint, image_format, uint
from tessella.functions.tables import png_chunks

#: Default limits of every reader.
MAX_PIXELS, MAX_BYTES = 100_000_000, 400_000_000
#: Pixels per metre of one pixel per inch, a fixed value.
INCH = 39.37007874015748
#: Bytes of a stored block at most.
STORED = 65_535


ADLER = 65_521


def _gathered(pixels: DataFrame) -> DataFrame:
    """image_id, width, height, the hex digits of all lines in both channel orders, and sums over the bytes of PNG rows."""
    word = lambda *c: F.lpad(F.hex(sum(F.col(k).cast("long") * (1 << s) for k, s in zip(c, (24, 16, 8, 0)))), 8, "0")
    v = [F.col(c).cast("long") for c in "rgba"]
    weighted = sum((F.col("x").cast("long") * 4 + 1 + i) * c for i, c in enumerate(v))
    joined = lambda at: F.concat_ws("", F.transform("p", lambda p: p[at]))
    p = F.sort_array(F.collect_list(F.struct("x", word(*"rgba").alias("rgba"), word(*"bgra").alias("bgra"))))
    lines = pixels.groupBy("image_id", "y").agg((F.max("x") + 1).alias("width"), p.alias("p"), F.sum(v[0] + v[1] + v[2] + v[3]).alias("s"), F.sum(weighted).alias("t"))
    lines = lines.select("image_id", "y", "width", joined("rgba").alias("rgba"), joined("bgra").alias("bgra"), "s", F.col("t") % ADLER, (F.col("y") * F.col("s") % ADLER).alias("ys"))
    lines = lines.withColumnRenamed(f"(t % {ADLER})", "t")
    lists = [F.sort_array(F.collect_list(F.struct("y", F.col(c).alias("line")))).alias(c) for c in ("rgba", "bgra")]
    rows = lines.groupBy("image_id").agg(F.max("width").alias("width"), (F.max("y") + 1).alias("height"), *lists, *(F.sum(c).alias(c) for c in ("s", "t", "ys")))
    return rows.withColumns({c: F.transform(c, lambda line: line["line"]) for c in ("rgba", "bgra")})


def once(value: Column) -> Column:
    """A value worked out once per row: it passes through a generator, into which later projections are not merged."""
    return F.explode(F.array(value))


def bmp_bytes(ppi: float = 72.0) -> Column:
    """A 32-bit bitmap with channel masks, bottom-up, from a gathered image."""
    w, h, zero = F.col("width").cast("long"), F.col("height").cast("long"), F.lit(0)
    area = w * h * 4
    per_metre = F.round(F.lit(ppi * INCH)).cast("long")
    fields = [(area + 122, 4), (zero, 4), (F.lit(122), 4), (F.lit(108), 4), (w, 4), (h, 4), (F.lit(1), 2), (F.lit(32), 2), (F.lit(3), 4), (area, 4), (per_metre, 4), (per_metre, 4), (zero, 4), (zero, 4)]
    masks = "0000FF00" + "00FF0000" + "FF000000" + "000000FF" + "42475273" + "00" * 48
    return F.unhex(F.concat(F.lit("424D"), *(hex_uint(v, n) for v, n in fields), F.lit(masks), F.concat_ws("", F.reverse("bgra"))))


def tga_bytes() -> Column:
    """An uncompressed 32-bit TGA, top-left origin, with footer."""
    head = F.concat(F.lit("000002" + "00" * 9), hex_uint(F.col("width"), 2), hex_uint(F.col("height"), 2), F.lit("2028"))
    foot = "00" * 8 + "TRUEVISION-XFILE.".encode().hex().upper() + "00"
    return F.unhex(F.concat(head, F.concat_ws("", "bgra"), F.lit(foot)))


def tiff_bytes() -> Column:
    """A little-endian TIFF, RGBA with straight alpha, one uncompressed strip before the directory."""
    area = F.col("width").cast("long") * F.col("height") * 4
    short, long = "0300", "0400"
    one = lambda tag, kind, value: F.concat(hex_uint(F.lit(tag), 2), F.lit(kind + "01000000"), hex_uint(value, 4))
    entries = [one(256, long, F.col("width")), one(257, long, F.col("height")), F.concat(F.lit("0201" + short + "04000000"), hex_uint(area + 8, 4)), one(259, short, F.lit(1)), one(262, short, F.lit(2)), one(273, long, F.lit(8)), one(277, short, F.lit(4)), one(278, long, F.col("height")), one(279, long, area), one(338, short, F.lit(2))]
    head = F.concat(F.lit("49492A00"), hex_uint(area + 16, 4))
    return F.unhex(F.concat(head, F.concat_ws("", "rgba"), F.lit("0800" * 4), F.lit("0A00"), *entries, F.lit("00000000")))


def png_bytes() -> Column:
    """An 8-bit RGBA PNG with unfiltered rows in as many stored blocks as they need."""
    row = F.col("width").cast("long") * 4 + 1
    size = row * F.col("height")
    # each byte v at place i of n adds v to the first sum and (n - i) v to the second
    first = (F.col("s") + 1) % ADLER
    second = (size % ADLER + (size % ADLER) * (F.col("s") % ADLER) - F.col("t") - (row % ADLER) * (F.col("ys") % ADLER)) % ADLER
    adler = F.pmod(second, F.lit(ADLER)) * 65536 + first
    raw = F.unhex(F.concat_ws("", F.transform("rgba", lambda line: F.concat(F.lit("00"), line))))
    last = F.floor((size - 1) / STORED).cast("int")

    def block(i, raw):
        n = F.least(F.lit(STORED), size - i * STORED).cast("int")
        return F.concat(F.when(i == last, "01").otherwise("00"), hex_uint(n, 2), hex_uint(STORED - n, 2), F.hex(F.substring(raw, i * STORED + 1, n)))

    # through a lambda the rows are put together once
    blocks = F.transform(F.array(raw), lambda raw: F.concat_ws("", F.transform(F.sequence(F.lit(0), last), lambda i: block(i, raw))))[0]

    def chunk(name: str, size: Column, data: Column) -> Column:
        typed = F.concat(F.lit(name.encode().hex().upper()), data)
        return F.transform(F.array(typed), lambda t: F.concat(hex_uint(size, 4, little=False), t, hex_uint(F.crc32(F.unhex(t)), 4, little=False)))[0]

    head = F.concat(hex_uint(F.col("width"), 4, little=False), hex_uint(F.col("height"), 4, little=False), F.lit("0806000000"))
    data = F.concat(F.lit("7801"), blocks, hex_uint(adler, 4, little=False))
    return F.unhex(F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", F.lit(13), head), chunk("IDAT", size + 6 + (last + 1) * 5, data), chunk("IEND", F.lit(0), F.lit(""))))


def written(pixels: DataFrame, content: Column) -> DataFrame:
    """image_id, width, height and the file of each image."""
    return _gathered(pixels).select("image_id", "width", "height", once(content).alias("content"))


def write_bmp(pixels: DataFrame, ppi: float = 72.0) -> DataFrame:
    return written(pixels, bmp_bytes(ppi))


def write_tga(pixels: DataFrame) -> DataFrame:
    return written(pixels, tga_bytes())


def write_tiff(pixels: DataFrame) -> DataFrame:
    return written(pixels, tiff_bytes())


def write_png(pixels: DataFrame) -> DataFrame:
    return written(pixels, png_bytes())


def write_all(pixels: DataFrame) -> DataFrame:
    """image_id, format, content: each image in every writable format, from one pass over the pixels."""
    made = (("bmp", bmp_bytes()), ("tga", tga_bytes()), ("tiff", tiff_bytes()), ("png", png_bytes()))
    return _gathered(pixels).select("image_id", F.explode(F.array(*(F.struct(F.lit(n).alias("format"), c.alias("content")) for n, c in made))).alias("f")).select("image_id", "f.*")


# --- headers ---------------------------------------------------------------------


def inspect(files: DataFrame) -> DataFrame:
    """Adds format, width, height, bits, ppi_x and ppi_y from headers, without reading pixels; columns of those names are replaced."""
    files = files.drop("format", "width", "height", "bits", "ppi_x", "ppi_y", "tiff").select("*", once(image_format("content")).alias("format"))
    c, form = F.col("content"), F.col("format")
    be = lambda at, n: uint(c, at, n, little=False)
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)
    bmp = (uint(c, 14, 4) >= 40) & (form == "bmp")
    bits = F.when(bmp, F.when(uint(c, 28, 2) >= 24, 8).otherwise(uint(c, 28, 2))).when(form.isin("qoi", "tga"), 8).when(form == "png", byte_at(c, 24))
    width = F.when(bmp, signed(uint(c, 18, 4))).when(form == "png", be(16, 4)).when(form == "qoi", be(4, 4)).when(form == "tga", uint(c, 12, 2))
    height = F.when(bmp, F.abs(signed(uint(c, 22, 4)))).when(form == "png", be(20, 4)).when(form == "qoi", be(8, 4)).when(form == "tga", uint(c, 14, 2))
    ppi = lambda at: F.when(bmp & (signed(uint(c, at, 4)) > 0), signed(uint(c, at, 4)) / INCH)
    return files.withColumns({"width": width.cast("long"), "height": height.cast("long"), "bits": bits.cast("int"), "ppi_x": ppi(38), "ppi_y": ppi(42)})


def within_budget(inspected: DataFrame, max_pixels: int = MAX_PIXELS, max_bytes: int = MAX_BYTES, channels: int = 4) -> DataFrame:
    """Files whose header promises no more pixels and decoded bytes than allowed; placed below every reader."""
    area = F.col("width") * F.col("height")
    return inspected.where((F.col("width") > 0) & (F.col("height") > 0) & (area <= max_pixels) & (area * channels * F.ceil(F.col("bits") / 8) <= max_bytes))


# --- readers ---------------------------------------------------------------------


def _exploded(files: DataFrame, offset: Column, order: str, bottom_up: Column, size: Column | int = 4, padded: bool = False, mirrored: Column | bool = False) -> DataFrame:
    """Pixels from the bytes at ``offset``: first lines, then samples, so that no row carries a whole file.

    order: channels of a four-byte pixel; three bytes have them without alpha, one
    byte is gray, both opaque. size: bytes of a pixel. padded: lines begin at
    multiples of four bytes. The header fields pass through a generator, which
    keeps the optimizer from working them out again for every line.
    """
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    fields = {"w": F.col("width").cast("int"), "h": F.col("height").cast("int"), "at": offset.cast("int"), "up": bottom_up, "n": as_column(size).cast("int"), "mirror": as_column(mirrored)}
    one = files.select("image_id", once(F.struct(*(c.alias(k) for k, c in fields.items()), "content")).alias("f")).select("image_id", "f.*")
    line, stride = F.expr("if(up, h - 1 - y, y)"), F.expr("(w * n + 3) div 4 * 4" if padded else "w * n").cast("int")
    lines = one.select("*", F.explode(F.expr("sequence(0, h - 1)")).alias("y")).select("image_id", "y", "w", "n", "mirror", F.substring(F.col("content"), F.col("at") + line * stride + 1, F.col("w") * F.col("n")).alias("line"))
    samples = lines.select("*", F.explode(F.expr("sequence(0, w - 1)")).alias("i"))
    samples = samples.select("image_id", "y", F.expr("if(mirror, w - 1 - i, i)").alias("x"), "n", F.conv(F.hex(F.expr("substring(line, n * i + 1, n)")), 16, 10).cast("long").alias("s"))
    byte = lambda k: F.shiftright("s", 8 * k).bitwiseAND(255).cast("int")
    value = {c: F.when(F.col("n") == 4, byte(3 - i)).when(F.col("n") == 3, byte(2 - i) if i < 3 else F.lit(255)).otherwise(byte(0) if c != "a" else F.lit(255)) for i, c in enumerate(order)}
    return samples.select("image_id", "y", "x", *(value[c].alias(c) for c in "rgba"))


def _with_directory(files: DataFrame) -> DataFrame:
    """inspect() with sizes of little-endian TIFF and ``tiff``, what its first directory says, which is walked as an array."""
    seen = inspect(files)
    c = F.col("content")
    here = (F.col("format") == "tiff") & (F.hex(F.substring(c, 1, 2)) == "4949")
    seen = seen.select("*", once(F.when(here, uint(c, 4, 4))).alias("_dir"))
    many = uint(c, F.col("_dir"), 2)
    # a directory that the file doesn't hold says nothing
    whole = here & (F.col("_dir") + 2 + many * 12 <= F.octet_length(c))
    field = lambda i: F.struct(*(uint(c, F.col("_dir") + at + i * 12, n).alias(k) for k, at, n in (("tag", 2, 2), ("kind", 4, 2), ("count", 6, 4), ("value", 10, 4))))
    entries = F.when(whole & (many > 0), F.transform(F.sequence(F.lit(0), many.cast("int") - 1), field))
    seen = seen.select("*", once(entries).alias("_entries"))
    entry = lambda tag: F.get(F.filter("_entries", lambda e: e["tag"] == tag), 0)
    # shorts fill the lower half of a little-endian value
    number = lambda tag: F.when(entry(tag)["kind"] == 3, entry(tag)["value"].bitwiseAND(0xFFFF)).otherwise(entry(tag)["value"])
    depth = F.when(entry(258)["count"] <= 2, number(258)).otherwise(uint(c, entry(258)["value"], 2))
    fields = {"width": number(256), "height": number(257), "strip": number(273), "strips": entry(273)["count"], "coding": F.coalesce(number(259), F.lit(1)), "samples": number(277), "depth": depth, "model": number(262)}
    seen = seen.select("*", once(F.when(F.col("_entries").isNotNull(), F.struct(*(v.alias(k) for k, v in fields.items())))).alias("tiff")).drop("_dir", "_entries")
    own = lambda name, like: F.when(F.col("format") == "tiff", F.col(f"tiff.{name}").cast("long")).otherwise(F.col(like)).alias(like)
    kept = [c for c in seen.columns if c not in ("width", "height", "bits")]
    return seen.select(*kept, own("width", "width"), own("height", "height"), own("depth", "bits"))


def _readable() -> Column:
    """Bitmaps of 24 bits, or of 32 without compression or with the masks of the writer; raw true-colour or gray TGA; TIFF of one raw RGBA strip."""
    c, form = F.col("content"), F.col("format")
    masks = F.hex(F.substring(c, 55, 16)) == "0000FF0000FF0000FF000000000000FF"
    depth, coding = uint(c, 28, 2), uint(c, 30, 4)
    bmp = ((depth == 24) & (coding == 0)) | ((depth == 32) & ((coding == 0) | ((coding == 3) & masks)))
    kind, tga_depth = byte_at(c, 2), byte_at(c, 16)
    tga = ((kind == 2) & tga_depth.isin(24, 32)) | ((kind == 3) & (tga_depth == 8))
    tiff = F.expr("tiff.coding = 1 and tiff.samples = 4 and tiff.depth = 8 and tiff.model = 2 and tiff.strips = 1")
    return F.coalesce(F.when(form == "bmp", bmp).when(form == "tga", tga).when(form == "tiff", tiff), F.lit(False))


def _pixels_end() -> Column:
    """Where the pixels of a readable file end."""
    c, form, w, h = F.col("content"), F.col("format"), F.col("width"), F.col("height")
    lines = F.floor((w * F.floor(uint(c, 28, 2) / 8) + 3) / 4) * 4 * h
    return F.when(form == "bmp", uint(c, 10, 4) + lines).when(form == "tga", 18 + byte_at(c, 0) + w * h * F.floor(byte_at(c, 16) / 8)).otherwise(F.col("tiff.strip") + w * h * 4)


def _error(max_pixels: int, max_bytes: int) -> Column:
    """Why a file gives no pixels; null if a reader gives them. The one rule of ``outcomes`` and of the readers."""
    form, area = F.col("format"), F.col("width") * F.col("height")
    sized = form.isin("bmp", "tga", "png", "qoi", "tiff")
    return (
        F.when(form.isNull(), "unknown format")
        .when(sized & (F.col("width").isNull() | F.col("height").isNull()), "truncated header")
        .when((F.col("width") <= 0) | (F.col("height") <= 0), "empty image")
        .when((area > max_pixels) | (area * 4 * F.ceil(F.col("bits") / 8) > max_bytes), "over budget")
        .when(~_readable(), F.concat(F.lit("no reader for this "), form))
        .when(_pixels_end() > F.octet_length("content"), "truncated pixels")
    )


def _decodable(files: DataFrame, form: str) -> DataFrame:
    return _with_directory(files).where((F.col("format") == form) & _error(MAX_PIXELS, MAX_BYTES).isNull())


def read_bmp(files: DataFrame) -> DataFrame:
    """Pixels of 24- and 32-bit bitmaps (image_id, content), bottom-up or top-down."""
    seen = _decodable(files, "bmp")
    return _exploded(seen, uint("content", 10, 4), "bgra", uint("content", 22, 4) < 1 << 31, uint("content", 28, 2) / 8, padded=True)


def read_tga(files: DataFrame) -> DataFrame:
    """Pixels of uncompressed true-colour and gray TGA (image_id, content) with any origin."""
    seen = _decodable(files, "tga")
    flags = byte_at("content", 17)
    return _exploded(seen, F.lit(18) + byte_at("content", 0), "bgra", flags.bitwiseAND(32) == 0, byte_at("content", 16) / 8, mirrored=flags.bitwiseAND(16) != 0)


def read_tiff(files: DataFrame) -> DataFrame:
    """Pixels of little-endian RGBA TIFF of one uncompressed strip (image_id, content)."""
    return _exploded(_decodable(files, "tiff"), F.col("tiff.strip"), "rgba", F.lit(False))


def outcomes(files: DataFrame, max_pixels: int = MAX_PIXELS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """image_id, format, status, error: whether a reader gives pixels for each file and, if not, why."""
    seen = _with_directory(files).withColumn("error", _error(max_pixels, max_bytes))
    return seen.select("image_id", "format", F.when(F.col("error").isNull(), "decoded").otherwise("skipped").alias("status"), "error")


def chunks(files: DataFrame) -> DataFrame:
    """The chunks of PNG files: image_id, n, name, size, whether the check sum holds. Each place depends on the size before, so a file is walked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(image, *c) for image, data in zip(*(c.to_pylist() for c in batch.columns)) for c in png_chunks(data)]
            types = {"image_id": pa.int64(), "n": pa.int32(), "name": pa.string(), "size": pa.int64(), "ok": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))

    seen = files.where(image_format("content") == "png").select(F.col("image_id").cast("long").alias("image_id"), "content")
    return seen.mapInArrow(run, "image_id long, n int, name string, size long, ok boolean")


def joined_segments(segments: DataFrame) -> DataFrame:
    """Ordered concatenation of (image_id, seq, total, chunk); null unless complete and without repeats."""
    g = segments.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("s"), F.max("total").alias("total"), F.count_distinct("seq").alias("n"), F.count("*").alias("c"))
    whole = F.aggregate(F.transform("s", lambda x: x["chunk"]), F.lit(""), lambda a, x: F.concat(a, x))
    return g.select("image_id", F.when((F.col("n") == F.col("total")) & (F.col("c") == F.col("total")), whole).alias("joined"))
