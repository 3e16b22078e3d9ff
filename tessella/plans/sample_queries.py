"""Registered queries of light encodings and sample operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import colour, light, tables
from tessella.functions.binary import SIGNATURES, hex_uint, image_format
from tessella.functions.light import BT709, DCI_GAMMA, OPSIN, OPSIN_BIAS, PQ, SRGB
from tessella.operators import codes, files, lines, metadata, palettes, pieces, pixels, png, pyramid, samples, stencils, transforms
from tessella.plans.oracle import ORACLE as CORE_ORACLE
from tessella.plans.oracle import BLOCKS, R1, R3, _clip, _r2
from tessella.sources import datasource, rasters
from tessella.sources.shared import shared_folder
from tessella.streaming import containers, ingest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Primaries of BT.2020.
BT2020 = ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _r2p(s, d):
    return rasters.lineitem_pixels(s, d)


def _columns(p, **cols):
    return p.select("image_id", "y", "x", *(c.alias(k) for k, c in cols.items()))


def _unit(c):
    return F.col(c).cast("double") / 255


# light
@query(_r2("SELECT image_id, y, x, " + ", ".join(f"CAST({_clip(f'((y_ * 19077 + 8192 + {e}) >> 14)')} AS INTEGER) AS c{i}" for i, e in enumerate(("v_ * 26149", "-u_ * 6419 - v_ * 13320", "u_ * 33050"))) + " FROM (SELECT *, r - 16 AS y_, g - 128 AS u_, b - 128 AS v_ FROM r2)"))
def yuv_limited_inverse(s, d):
    out = light.limited_yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return _columns(_r2p(s, d), c0=out[0], c1=out[1], c2=out[2])


_V = "(r::DOUBLE / 255)"
_PQ_IN = f"pow({_V}, {1 / PQ['m2']!r})"


@query(_r2(f"""SELECT image_id, y, x, round(CASE WHEN {_V} < {SRGB['low']!r} THEN {_V} * {SRGB['slope']!r} ELSE pow(({_V} + 0.055) * {SRGB['scale']!r}, 2.4) END, 6) AS srgb,
 round(CASE WHEN {_V} < {BT709['low']!r} THEN {_V} / 4.5 ELSE pow(({_V} + {BT709['offset']!r}) * {BT709['scale']!r}, {1 / 0.45!r}) END, 6) AS bt709,
 round(pow(greatest({_PQ_IN} - {PQ['c1']!r}, 0) / ({PQ['c2']!r} - {_PQ_IN} * {PQ['c3']!r}), {1 / PQ['m1']!r}), 6) AS pq, round(CASE WHEN r = 0 THEN 0 ELSE pow({_V}, {1 / DCI_GAMMA!r}) END, 6) AS dci FROM r2"""))
def transfer_to_linear(s, d):
    return _columns(_r2p(s, d), **{k: F.round(light.to_linear(k, _unit("r")), 6) for k in ("srgb", "bt709", "pq", "dci")})


_PQ_OUT = f"pow({_V}, {PQ['m1']!r})"


@query(_r2(f"""SELECT image_id, y, x, round(CASE WHEN {_V} < {SRGB['linear']!r} THEN {_V} * 12.92 ELSE pow({_V}, {SRGB['power']!r}) * 1.055 - 0.055 END, 6) AS srgb,
 round(CASE WHEN {_V} < {BT709['linear']!r} THEN {_V} * 4.5 ELSE pow({_V}, 0.45) * {1 + BT709['offset']!r} - {BT709['offset']!r} END, 6) AS bt709,
 round(pow(({_PQ_OUT} * {PQ['c2']!r} + {PQ['c1']!r}) / ({_PQ_OUT} * {PQ['c3']!r} + 1), {PQ['m2']!r}), 6) AS pq, round(CASE WHEN r = 0 THEN 0 ELSE pow({_V}, {DCI_GAMMA!r}) END, 6) AS dci FROM r2"""))
def transfer_from_linear(s, d):
    return _columns(_r2p(s, d), **{k: F.round(light.from_linear(k, _unit("r")), 6) for k in ("srgb", "bt709", "pq", "dci")})


@query(f"WITH {R1} SELECT image_id, y, x, " + ", ".join(f"round(sign({c}) * CASE WHEN abs({c}) <= 0.04045 THEN abs({c}) / 12.92 ELSE pow((abs({c}) + 0.055) / 1.055, 2.4) END, 6) + 0.0::DOUBLE AS c{i}" for i, c in enumerate("rgb")) + " FROM r1")
def extended_srgb_inverse(s, d):
    return _columns(rasters.float_pixels(s, d), **{f"c{i}": F.round(light.srgb_decode(F.col(c)), 6) for i, c in enumerate("rgb")})


@query(f"WITH {R1}, s AS (SELECT *, pow(2.0, greatest(floor(log2(CASE WHEN r <> 0 THEN abs(r) END)), -14) - 10) AS q FROM r1) SELECT image_id, y, x, CASE WHEN r = 0 THEN 0.0 ELSE sign(r) * round_even(abs(r) / q, 0) * q END AS v FROM s")
def half_floats(s, d):
    return _columns(rasters.float_pixels(s, d), v=light.half(F.col("r")))


_MIXED = ", ".join(f"cbrt(greatest({a!r}::DOUBLE * r / 255 + {b!r}::DOUBLE * g / 255 + {c!r}::DOUBLE * b / 255 + {OPSIN_BIAS!r}::DOUBLE, 0)) - cbrt({OPSIN_BIAS!r}::DOUBLE) AS m{i}" for i, (a, b, c) in enumerate(OPSIN))


@query(_r2(f"SELECT image_id, y, x, round((m0 - m1) / 2, 6) + 0.0::DOUBLE AS c0, round((m0 + m1) / 2, 6) AS c1, round(m2, 6) AS c2 FROM (SELECT image_id, y, x, {_MIXED} FROM r2)"))
def xyb_forward(s, d):
    return _columns(_r2p(s, d), **{f"c{i}": F.round(c, 6) for i, c in enumerate(light.xyb(_unit("r"), _unit("g"), _unit("b")))})


@query(_r2("SELECT image_id, y, x, round(r::DOUBLE / 255, 6) AS c0, round(g::DOUBLE / 255, 6) AS c1, round(b::DOUBLE / 255, 6) AS c2 FROM r2"))
def xyb_roundtrip(s, d):
    x, y, b = light.xyb(_unit("r"), _unit("g"), _unit("b"))
    p = _r2p(s, d).withColumns({"k0": x, "k1": y, "k2": b})
    return _columns(p, **{f"c{i}": F.round(c, 6) for i, c in enumerate(light.xyb_inverse(F.col("k0"), F.col("k1"), F.col("k2")))})


@query(_r2("SELECT image_id, y, x, round(((CASE WHEN r >= 128 THEN r - 256 ELSE r END) + 128)::DOUBLE / 255, 9) AS signed8, round(r::DOUBLE / 255, 9) AS offset8, round(least(greatest(((CASE WHEN w >= 32768 THEN w - 65536 ELSE w END) / 256.0::DOUBLE + 128) / 255, 0), 1), 9) AS signed16, round(least(w / 257.0::DOUBLE / 255, 1), 9) AS offset16 FROM (SELECT *, r * 256 + g AS w FROM r2)"))
def lab_stored(s, d):
    w = F.col("r") * 256 + F.col("g")
    return _columns(_r2p(s, d), **{k: F.round(light.lab_unit(v, bits, signed), 9) for k, v, bits, signed in (("signed8", F.col("r"), 8, True), ("offset8", F.col("r"), 8, False), ("signed16", w, 16, True), ("offset16", w, 16, False))})


def primaries_bt2020(s, d):
    """Linear BT.2020 to linear sRGB."""
    out = light.mixed(light.primaries_matrix(BT2020), _unit("r"), _unit("g"), _unit("b"))
    return _columns(_r2p(s, d), **{f"c{i}": F.round(c, 6) for i, c in enumerate(out)})


# a test holds the matrix against the published one
QUERIES["primaries_bt2020"] = primaries_bt2020
ORACLE["primaries_bt2020"] = _r2("SELECT image_id, y, x, " + ", ".join(f"round({' + '.join(f'{v} / 255.0::DOUBLE * ({float(k)!r})' for v, k in zip('rgb', row))}, 6) AS c{i}" for i, row in enumerate(light.primaries_matrix(BT2020))) + " FROM r2")


# predictors and packets
_NEAR = """, a AS (SELECT image_id, y, x, g AS v, lag(g) OVER c AS n0, lag(g, 2) OVER c AS nn0 FROM r2 WINDOW c AS (PARTITION BY image_id, x ORDER BY y)),
 b AS (SELECT *, lag(v) OVER w AS w0, lag(v, 2) OVER w AS ww0, lag(n0) OVER w AS nw0, lead(n0) OVER w AS ne0, lead(n0, 2) OVER w AS nee0 FROM a WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
 k AS (SELECT image_id, y, x, coalesce(w0, n0, 0) AS w, coalesce(n0, w0, 0) AS n, coalesce(nw0, w0, n0, 0) AS nw, nn0, ww0, ne0, nee0 FROM b),
 f AS (SELECT image_id, y, x, w, n, nw, coalesce(nn0, n) AS nn, coalesce(ww0, w) AS ww, coalesce(ne0, n) AS ne, coalesce(nee0, ne0, n) AS nee FROM k)
 SELECT image_id, y, x, 0 AS p0, w AS p1, n AS p2, (w + n) // 2 AS p3, CASE WHEN abs(n - nw) < abs(w - nw) THEN w ELSE n END AS p4, least(greatest(w + n - nw, least(w, n)), greatest(w, n)) AS p5,
  ne AS p7, nw AS p8, ww AS p9, (w + nw) // 2 AS p10, (n + nw) // 2 AS p11, (n + ne) // 2 AS p12, CAST(trunc((6 * n - 2 * nn + 7 * w + ww + nee + 3 * ne + 8) / 16) AS INTEGER) AS p13 FROM f"""


@query("SELECT image_id, y, x, " + ", ".join(f"CAST(p{k} AS INTEGER) AS p{k}" for k in range(14) if k != 6) + f" FROM ({_r2(_NEAR)})")
def predictor_guesses(s, d):
    return samples.predictions(_r2p(s, d), "g")


_FOUR = "rgba"
_BLOCK_COSTS = ", ".join("CAST(sum(" + " + ".join(f"least(({c} - p + 256) % 256, 256 - ({c} - p + 256) % 256)".replace("- p", f"- (CASE WHEN y = 0 AND x = 0 THEN {255 if c == 'a' else 0} WHEN y = 0 THEN {c}l WHEN x = 0 THEN {c}u ELSE {inner.format(c=c)} END)") for c in _FOUR) + f") AS BIGINT) AS m{m}" for m, inner in ((1, "{c}l"), (2, "{c}u"), (7, "({c}l + {c}u) // 2"), (11, "CASE WHEN lf <= uf THEN {c}u ELSE {c}l END")))


@query(_r2(f""", u AS (SELECT *, {", ".join(f"coalesce(lag({c}) OVER w, 0) AS {c}u" for c in _FOUR)} FROM r2 WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
 n AS (SELECT *, {", ".join(f"coalesce(lag({c}) OVER w, 0) AS {c}l, coalesce(lag({c}u) OVER w, 0) AS {c}c" for c in _FOUR)} FROM u WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
 f AS (SELECT *, {" + ".join(f"abs({c}l - {c}c)" for c in _FOUR)} AS lf, {" + ".join(f"abs({c}u - {c}c)" for c in _FOUR)} AS uf FROM n),
 k AS (SELECT image_id, CAST(y // 8 AS INTEGER) AS block_y, CAST(x // 8 AS INTEGER) AS block_x, {_BLOCK_COSTS} FROM f GROUP BY image_id, y // 8, x // 8)
 SELECT image_id, block_y, block_x, CAST(CASE least(m1, m2, m7, m11) WHEN m1 THEN 1 WHEN m2 THEN 2 WHEN m7 THEN 7 ELSE 11 END AS INTEGER) AS mode, least(m1, m2, m7, m11) AS cost FROM k"""))
def block_predictors(s, d):
    return samples.block_predictors(_r2p(s, d), 8)


def _spotted(s, d):
    """Runs of five with single pixels among them."""
    return rasters.block_pixels(s, d).withColumn("r", F.when(F.col("x") % 7 < 2, F.col("x") * 3).otherwise(F.col("r")).cast("int"))


_SPOTTED = BLOCKS + ", sp AS (SELECT image_id, y, x, CASE WHEN x % 7 < 2 THEN x * 3 ELSE r END AS r, g, b FROM bl)"
_PACKETS = """, t AS (SELECT *, CASE WHEN lag((r, g, b)) OVER w = (r, g, b) THEN 0 ELSE 1 END AS turn FROM sp WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
 u AS (SELECT *, sum(turn) OVER (PARTITION BY image_id, y ORDER BY x) AS run FROM t), v AS (SELECT image_id, y, min(x) AS x, count(*) AS n, count(*) < {0} AS literal FROM u GROUP BY image_id, y, run),
 q AS (SELECT *, sum(CASE WHEN literal AND before THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM (SELECT *, coalesce(lag(literal) OVER (PARTITION BY image_id, y ORDER BY x), false) AS before FROM v))
 SELECT image_id, y, CAST(min(x) AS INTEGER) AS x, CAST(sum(n) AS INTEGER) AS n, bool_or(literal) AS literal FROM q GROUP BY image_id, y, k"""


@query(f"WITH {_SPOTTED} {_PACKETS.format(2)}")
def tga_packets(s, d):
    return samples.packets(_spotted(s, d), 2)


@query(f"WITH {_SPOTTED} {_PACKETS.format(3)}")
def packbits_packets(s, d):
    return samples.packets(_spotted(s, d), 3)


@query(_r2(""", each AS (SELECT image_id, y, CAST(x * 4 + k AS INTEGER) AS i, [r // 64, g // 64, b // 64, a // 64][k + 1] AS v FROM r2, range(4) AS kk(k)),
 t AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS turn FROM each WINDOW w AS (PARTITION BY image_id, y ORDER BY i)), u AS (SELECT *, sum(turn) OVER (PARTITION BY image_id, y ORDER BY i) AS run FROM t),
 q AS (SELECT image_id, y, run, min(i) AS i, count(*) AS n FROM u GROUP BY ALL), s AS (SELECT *, CASE WHEN n < 3 AND lag(n) OVER w < 3 THEN 0 ELSE 1 END AS fresh FROM q WINDOW w AS (PARTITION BY image_id, y ORDER BY run)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id, y ORDER BY run) AS packet FROM s)
 SELECT image_id, y, CAST(min(i) AS INTEGER) AS place, CAST(sum(n) AS INTEGER) AS n, min(n) < 3 AS literal FROM g GROUP BY image_id, y, packet"""))
def packbits_bytes(s, d):
    """Run and literal packets over the interleaved bytes of rows, of two bits each."""
    p = _r2p(s, d)
    return samples.byte_packets(p.select("image_id", "y", "x", *(F.shiftright(c, 6).alias(c) for c in "rgba")))


@query(_r2(""", z AS (SELECT image_id, y, x, (r // 128, g // 128) AS k, r // 128 = 0 AND g // 128 = 0 AS black FROM r2),
 t AS (SELECT *, CASE WHEN coalesce(lag(k) OVER w = k, black) THEN 1 ELSE 0 END AS same FROM z WINDOW w AS (PARTITION BY image_id ORDER BY y, x)),
 u AS (SELECT *, sum(1 - same) OVER (PARTITION BY image_id ORDER BY y, x) AS run FROM t)
 SELECT image_id, CAST(min(y * 16 + x) // 16 AS INTEGER) AS y, CAST(min(y * 16 + x) % 16 AS INTEGER) AS x, CAST(count(*) AS INTEGER) AS length, CAST((count(*) + 61) // 62 AS INTEGER) AS packets FROM u WHERE same = 1 GROUP BY image_id, run"""))
def qoi_runs(s, d):
    dark = _r2p(s, d).select("image_id", "y", "x", *((F.shiftright(c, 7)).cast("int").alias(c) for c in "rg"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    return samples.runs_from_opaque_black(dark)


_OVER = "(n * na + o * oa * (1 - na)) / nullif(oa + na * (1 - oa), 0)"


@query(_r2(f"""SELECT image_id, y, x, round(coalesce({_OVER}, 0), 9) AS above, round(coalesce((o * oa + n * na * (1 - oa)) / nullif(na + oa * (1 - na), 0), 0), 9) AS below, round(n + o * (1 - na), 9) AS premultiplied,
 round(coalesce((n * c + o * oa * (1 - c)) / nullif(oa + c * (1 - oa), 0), 0), 9) AS clamped, round(oa + na * (1 - oa), 9) AS alpha
 FROM (SELECT *, r::DOUBLE / 255 AS n, g::DOUBLE / 255 AS o, a::DOUBLE / 255 AS na, b::DOUBLE / 255 AS oa, least(a::DOUBLE / 128, 1) AS c FROM r2)"""))
def alpha_blends(s, d):
    """A frame with alpha on a canvas with alpha: over, under, weighted samples, alpha beyond 1 held."""
    n, o, na, oa = _unit("r"), _unit("g"), _unit("a"), _unit("b")
    above, alpha = colour.blend_alpha(n, o, na, oa)
    out = {"above": above, "below": colour.blend_alpha(n, o, na, oa, below=True)[0], "premultiplied": colour.blend_alpha(n, o, na, oa, premultiplied=True)[0], "clamped": colour.blend_alpha(n, o, F.col("a").cast("double") / 128, oa, clamp=True)[0], "alpha": alpha}
    return _columns(_r2p(s, d), **{k: F.round(c, 9) for k, c in out.items()})


# resampling
_HALF = f"""WITH {R3}, c AS (SELECT image_id, y, x, ((-38 * r - 74 * g + 112 * b + 128) >> 8) + 128 AS u FROM r3),
 h AS (SELECT image_id, y >> 1 AS y, x >> 1 AS x, (2 * sum(u) + count(*)) // (2 * count(*)) AS u FROM c GROUP BY ALL),
 f AS (SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, y >> 1 AS ny, CASE WHEN y % 2 = 0 THEN greatest((y >> 1) - 1, 0) ELSE least((y >> 1) + 1, 10) END AS oy,
   x >> 1 AS nx, CASE WHEN x % 2 = 0 THEN greatest((x >> 1) - 1, 0) ELSE least((x >> 1) + 1, 17) END AS ox, CASE WHEN x % 2 = 0 THEN 8 ELSE 7 END AS add FROM r3)
 SELECT f.image_id, f.y, f.x, CAST((3 * (3 * a.u + b.u) + 3 * c.u + d.u + add)::BIGINT >> 4 AS INTEGER) AS u FROM f JOIN h a ON a.image_id = f.image_id AND a.y = ny AND a.x = nx JOIN h b ON b.image_id = f.image_id AND b.y = oy AND b.x = nx
  JOIN h c ON c.image_id = f.image_id AND c.y = ny AND c.x = ox JOIN h d ON d.image_id = f.image_id AND d.y = oy AND d.x = ox"""


@query(_HALF)
def upsample_triangle(s, d):
    return samples.upsample_triangle(pixels.chroma_420(rasters.formula_pixels(s, d)).drop("v"), "u", F.lit(35), F.lit(22))


_W = {c: f"(({c} * a + 255 * (255 - a) + 127) // 255)" for c in "rgb"}


@query(f"""WITH {R3}, w AS (SELECT image_id, y, x, {', '.join(f'{e} AS {c}' for c, e in _W.items())} FROM r3)
 SELECT image_id, y >> 1 AS y, x >> 1 AS x, avg(((-11059 * r - 21709 * g + 32768 * b + 8421375) >> 16) - 128) AS cb, avg(((32768 * r - 27439 * g - 5329 * b + 8421375) >> 16) - 128) AS cr FROM w GROUP BY image_id, y >> 1, x >> 1""")
def chroma_mean(s, d):
    return samples.chroma_mean(rasters.formula_pixels(s, d))


@query(f"WITH {R3} SELECT image_id, CAST(py AS INTEGER) AS y, CAST(px AS INTEGER) AS x, r, g, b, a FROM r3 JOIN range(32) AS ty(py) ON least(py, 21) = y JOIN range(48) AS tx(px) ON least(px, 34) = x")
def edge_replicated(s, d):
    p = rasters.formula_pixels(s, d)
    return samples.edge_replicated(p, rasters.image_sizes(p), 16)


# palettes, indices and colour models
@query(_r2("""SELECT image_id, box, count(*) AS population, CAST(round(sum(r)::DOUBLE / count(*)) AS INTEGER) AS r, CAST(round(sum(g)::DOUBLE / count(*)) AS INTEGER) AS g, CAST(round(sum(b)::DOUBLE / count(*)) AS INTEGER) AS b
 FROM (SELECT image_id, CAST((r >> 6) * 16 + (g >> 6) * 4 + (b >> 6) AS INTEGER) AS box, r, g, b FROM r2) GROUP BY image_id, box"""))
def box_means(s, d):
    colours = pixels.distinct_colours(_r2p(s, d))
    box = F.shiftright("r", 6) * 16 + F.shiftright("g", 6) * 4 + F.shiftright("b", 6)
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c)
    return colours.groupBy("image_id", box.cast("int").alias("box")).agg(F.sum("n").alias("population"), *(mean(c) for c in "rgb"))


@query(_r2(""", i AS (SELECT image_id, y, CAST(x * 4 + k AS INTEGER) AS x, (r >> CAST(2 * k AS INTEGER)) & 3 AS entry FROM r2, range(4) AS t(k) WHERE x * 4 + k < 61),
 p AS (SELECT image_id, x AS entry, r, g, b FROM r2 WHERE y = 0 AND x < 3)
 SELECT i.image_id, i.y, i.x, p.r, p.g, p.b, p.r IS NOT NULL AS found FROM i LEFT JOIN p USING (image_id, entry)"""))
def palette_indices(s, d):
    """Two-bit indices into each image's own palette of three colours: an index beyond it finds nothing."""
    p = _r2p(s, d)
    index = samples.unpacked_indices(p.withColumnRenamed("r", "v"), 2, F.lit(61))
    palette = p.where("y = 0 and x < 3").select("image_id", F.col("x").alias("entry"), "r", "g", "b")
    return index.join(palette, ["image_id", "entry"], "left").select("image_id", "y", "x", "r", "g", "b", F.col("r").isNotNull().alias("found"))


@query(_r2("SELECT q.image_id, q.y, q.x, CAST(coalesce(p.a, 255) AS INTEGER) AS a FROM r2 q LEFT JOIN (SELECT image_id, x AS entry, a FROM r2 WHERE y = 0 AND x < 10) p ON p.image_id = q.image_id AND p.entry = q.g % 16"))
def palette_alpha(s, d):
    """Alpha of palette entries; those without one are opaque."""
    p = _r2p(s, d)
    alphas = p.where("y = 0 and x < 10").select("image_id", F.col("x").alias("entry"), F.col("a").alias("alpha"))
    return p.withColumn("entry", F.col("g") % 16).join(alphas, ["image_id", "entry"], "left").select("image_id", "y", "x", F.coalesce("alpha", F.lit(255)).alias("a"))


#: Where the channels go under each permutation.
PERMUTATIONS = ((0, 1, 2), (1, 2, 0), (2, 0, 1), (0, 2, 1), (1, 0, 2), (2, 1, 0))


@query(_r2("SELECT image_id, y, x, k, " + ", ".join(f"CASE k {' '.join(f'WHEN {k} THEN {chr(114) if p.index(j) == 0 else chr(103) if p.index(j) == 1 else chr(98)}' for k, p in enumerate(PERMUTATIONS))} END AS c{j}" for j in range(3)) + " FROM (SELECT *, CAST(image_id % 6 AS INTEGER) AS k FROM r2)"))
def rct_permutations(s, d):
    p = _r2p(s, d).withColumn("k", (F.col("image_id") % 6).cast("int"))
    v = [F.col(c) for c in "rgb"]
    out = {}
    for j in range(3):
        one = None
        for k, places in enumerate(PERMUTATIONS):
            c = v[places.index(j)]
            one = F.when(F.col("k") == k, c) if one is None else one.when(F.col("k") == k, c)
        out[f"c{j}"] = one
    return _columns(p, k=F.col("k"), **out)


# bytes, limits and predicates
@query(_r2("SELECT image_id, w, h, CAST(max(CASE WHEN y = h // 2 AND x = 3 THEN CAST(r AS BIGINT) * 16777216 + g * 65536 + b * 256 + a END) AS BIGINT) AS pixel, max(w) * 4 AS row_bytes FROM (SELECT r2.*, w, h FROM r2 JOIN (SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS w, CAST(max(y) + 1 AS INTEGER) AS h FROM r2 GROUP BY image_id) USING (image_id)) GROUP BY image_id, w, h"))
def pixel_access(s, d):
    """One pixel of each image out of its packed bytes, read from a row that is cut out by its stride."""
    g = files._gathered(_r2p(s, d)).select("image_id", F.col("width").alias("w"), F.col("height").alias("h"), F.unhex(F.concat_ws("", "rgba")).alias("content"))
    row = samples.packed_row(F.col("content"), F.col("w") * 4, F.expr("h div 2"), F.col("w"))
    pixel = F.conv(F.hex(F.substring(row, 13, 4)), 16, 10).cast("long")
    return g.select("image_id", "w", "h", pixel.alias("pixel"), F.octet_length(row).alias("row_bytes"))


#: The largest width and height that each format holds.
LIMITS = {"gif": 65_535, "jpeg": 65_535, "tga": 65_535, "webp_lossless": 16_384, "webp_lossy": 16_383, "png": 2**31 - 1, "jbig2": 2**31 - 1, "bmp": 2**31 - 1, "qoi": 2**32 - 1}


@query("SELECT o_orderkey AS image_id, format FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS w, CAST(o_orderkey AS BIGINT) * 7 AS h FROM orders), (VALUES " + ", ".join(f"('{k}', {v})" for k, v in LIMITS.items()) + ") AS t(format, most) WHERE w <= most AND h <= most AND w > 0 AND h > 0")
def formats_that_hold(s, d):
    """The formats that hold an image of each order's size."""
    o = rasters.table(s, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").cast("long").alias("w"), (F.col("o_orderkey").cast("long") * 7).alias("h"))
    most = F.explode(F.array(*(F.struct(F.lit(k).alias("format"), F.lit(v).cast("long").alias("most")) for k, v in LIMITS.items())))
    return o.where("w > 0 and h > 0").select("*", most.alias("l")).where("w <= l.most and h <= l.most").select("image_id", "l.format")


@query("SELECT CAST(s_suppkey * 3 + k AS BIGINT) AS image_id, k = 2 AS exact, s_suppkey % 3 <> 0 AS model_fits FROM supplier, range(3) AS t(k)")
def exact_decoding(s, d):
    """Whether eight bits of RGB would lose something, and whether the model is the one that was expected."""
    m = metadata.inspect_metadata(rasters.header_files(s, d))
    exact = (F.col("bits") > 8) | (F.col("model") != "rgb") | F.col("icc_bytes").isNotNull()
    expected = F.when(F.expr("image_id div 3") % 3 == 0, "cmyk").otherwise("rgb")
    return m.select("image_id", exact.alias("exact"), (F.col("model") == expected).alias("model_fits"))


@query("SELECT doc_id AS image_id, CAST(i AS INTEGER) AS x, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS v FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents WHERE octet_length(encode(text)) > 0)")
def byte_delta_undo(s, d):
    """The bytes of texts again from their differences: running sums, then even and odd places woven together."""
    from tessella.plans.queries import delta_pieces

    return pieces.undone(delta_pieces(s, d))


# relations in time
@query("SELECT e.event_id, p.event_id AS before_id FROM events e ASOF LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)) p ON e.user_id = p.user_id AND e.event_id > p.event_id")
def events_as_of(s, d):
    """For each event the last earlier event of its user of the first type: an as-of join as a window, without a pair join."""
    e = rasters.table(s, d, "events")
    first = e.agg(F.min("event_type").alias("first"))
    marked = e.join(F.broadcast(first)).select("event_id", "user_id", F.when(F.col("event_type") == F.col("first"), F.col("event_id")).alias("mark"))
    before = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return marked.select("event_id", F.last("mark", ignorenulls=True).over(before).alias("before_id"))


# inverse predictors: what was predicted comes back
@query(_r2("SELECT image_id, y, x, r, g, b, a FROM r2"))
def png_unfilter(s, d):
    """Residuals under the chosen filter of each row, restored row by row."""
    return lines.png_restored(lines.png_residuals(_r2p(s, d)))


@query(_r2("SELECT image_id, y, x, r, g, b, a FROM r2"))
def block_predictors_undo(s, d):
    """Residuals under the chosen mode of each block of 8, restored row by row."""
    p = _r2p(s, d)
    return lines.block_restored(lines.block_residuals(p, samples.block_predictors(p, 8), 8))


@query(_r2("SELECT kind, image_id, y, x, a FROM r2, (VALUES ('horizontal'), ('vertical'), ('gradient')) AS t(kind)"))
def alpha_filters_undo(s, d):
    """Residuals of the alpha plane under each filter, restored row by row."""
    p = _r2p(s, d).select("image_id", "y", "x", "a")
    out = None
    for kind in lines.ALPHA_FILTERS:
        one = lines.alpha_restored(lines.alpha_residuals(p, kind), kind).select(F.lit(kind).alias("kind"), "image_id", "y", "x", "a")
        out = one if out is None else out.unionByName(one)
    return out


# block transforms and pyramids
def _red_plane(s, d):
    """The red plane of the line-item images, filled up to whole blocks of 8."""
    p = _r2p(s, d)
    return samples.edge_replicated(p, rasters.image_sizes(p), 8).select("image_id", "y", "x", F.col("r").alias("v"))


_GROWN = """, z AS (SELECT image_id, max(y) + 1 AS h FROM r2 GROUP BY image_id),
 gr AS (SELECT z.image_id, CAST(py AS INTEGER) AS y, x, r AS v FROM z, range(1, 8) AS e(k), LATERAL (SELECT h - 1 + k AS py) JOIN r2 ON r2.image_id = z.image_id AND r2.y = h - 1 WHERE py < (h + 7) // 8 * 8
   UNION ALL SELECT image_id, y, x, r FROM r2)"""
_QUALITY = 75
_TABLE = transforms.quality_table(_QUALITY)
_STEPS = ", ".join(f"({v}, {h}, {e}, {transforms.zigzag(8)[v][h]})" for v, row in enumerate(_TABLE) for h, e in enumerate(row))


@query(_r2(_GROWN + f""", st(u, w, e, place) AS (VALUES {_STEPS}), basis AS (SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, sqrt(CASE WHEN k = 0 THEN 0.125 ELSE 0.25 END) * cos(pi() * (2 * i + 1) * k / 16) AS c FROM range(8) AS a(k), range(8) AS b(i)),
 across AS (SELECT image_id, y, x // 8 AS bx, k AS w, sum(v * c) AS s FROM gr JOIN basis ON i = x % 8 GROUP BY ALL),
 down AS (SELECT image_id, y // 8 AS by_, bx, k AS u, w, round(sum(s * c), 6) AS s FROM across JOIN basis ON i = y % 8 GROUP BY ALL),
 q AS (SELECT image_id, CAST(by_ AS INTEGER) AS block_y, CAST(bx AS INTEGER) AS block_x, place, CAST(sign(s) * floor(abs(s / e) + 0.5) AS INTEGER) AS q FROM down JOIN st ON st.u = down.u AND st.w = down.w)
 SELECT image_id, block_y, block_x, place, q FROM q WHERE q <> 0"""))
def dct8_quantised(s, d):
    """Cosine coefficients of 8 by 8 blocks over a table of quality 75, by their place on the zigzag way."""
    return transforms.quantised(transforms.cosine(_red_plane(s, d)), _TABLE)


@query(_r2(_GROWN + " SELECT image_id, y, x, v FROM gr"))
def dct8_roundtrip(s, d):
    """Cosine coefficients and back, rounded."""
    return transforms.cosine_inverse(transforms.cosine(_red_plane(s, d))).select("image_id", "y", "x", F.round("v").cast("int").alias("v"))


@query(_r2(_GROWN + " SELECT image_id, y, x, v FROM gr"))
def dct4_roundtrip(s, d):
    """The same with blocks of 4."""
    return transforms.cosine_inverse(transforms.cosine(_red_plane(s, d), 4), 4).select("image_id", "y", "x", F.round("v").cast("int").alias("v"))


def _cells(pick: str = "v") -> str:
    return ", ".join(f"max(CASE WHEN y % 4 = {k // 4} AND x % 4 = {k % 4} THEN {pick} END) AS c{k}" for k in range(16))


def _four(table: str, step, rows: bool) -> str:
    """One pass over the four rows or columns of blocks c0 to c15; ``step`` gives the SQL of four results."""
    out = {}
    for i in range(4):
        at = [4 * i + j if rows else 4 * j + i for j in range(4)]
        out |= dict(zip(at, step(*(f"c{k}" for k in at))))
    return f"(SELECT image_id, by_, bx, {', '.join(f'({v}) AS c{k}' for k, v in sorted(out.items()))} FROM {table})"


def _spread(table: str) -> str:
    return f"SELECT image_id, CAST(by_ * 4 + k // 4 AS INTEGER) AS y, CAST(bx * 4 + k % 4 AS INTEGER) AS x, CAST([{', '.join(f'c{k}' for k in range(16))}][k + 1] AS INTEGER) AS v FROM {table}, range(16) AS kk(k)"


_FOURS = _GROWN + f", b4 AS (SELECT image_id, y // 4 AS by_, x // 4 AS bx, {_cells('CAST(v AS BIGINT) - 128')} FROM gr GROUP BY ALL)"
_FORWARD4 = _four(
    _four("b4", lambda a, b, c, d: (f"8 * ({a} + {b} + {c} + {d})", f"(({b} - {c}) * 2217 + ({a} - {d}) * 5352 + 1812) >> 9", f"8 * ({a} - {b} - {c} + {d})", f"(({a} - {d}) * 2217 - ({b} - {c}) * 5352 + 937) >> 9"), True),
    lambda a, b, c, d: (f"({a} + {b} + {c} + {d} + 7) >> 4", f"((({b} - {c}) * 2217 + ({a} - {d}) * 5352 + 12000) >> 16) + CASE WHEN {a} <> {d} THEN 1 ELSE 0 END", f"({a} - {b} - {c} + {d} + 7) >> 4", f"(({a} - {d}) * 2217 - ({b} - {c}) * 5352 + 51000) >> 16"),
    False,
)


def _inverse4_sql(add: int, shift: int):
    def step(a, b, c, d):
        up, down = f"({b} + ({b} * 20091 >> 16) + ({d} * 35468 >> 16))", f"(({b} * 35468 >> 16) - {d} - ({d} * 20091 >> 16))"
        return [f"({v}) >> {shift}" for v in (f"{a} + {c} + {add} + {up}", f"{a} - {c} + {add} + {down}", f"{a} - {c} + {add} - {down}", f"{a} + {c} + {add} - {up}")]

    return step


def _centred(s, d):
    return transforms.gathered4(_red_plane(s, d).withColumn("v", F.col("v") - 128))


@query(_r2(_FOURS + " " + _spread(_FORWARD4)))
def residual_dct4(s, d):
    """Integer coefficients of 4 by 4 blocks of residuals."""
    return transforms.spread4(transforms.residual_forward(_centred(s, d)))


@query(_r2(_FOURS + " " + _spread(_four(_four(_FORWARD4, _inverse4_sql(0, 0), False), _inverse4_sql(4, 3), True))))
def residual_dct4_inverse(s, d):
    """Residuals from those coefficients."""
    return transforms.spread4(transforms.residual_inverse(transforms.residual_forward(_centred(s, d))))


_WHT = _four(
    _four("b4", lambda a, b, c, d: (f"{a} + {b} + {c} + {d}", f"{a} + {b} - {c} - {d}", f"{a} - {b} - {c} + {d}", f"{a} - {b} + {c} - {d}"), True),
    lambda a, b, c, d: [f"({v}) >> 1" for v in (f"{a} + {b} + {c} + {d}", f"{a} + {b} - {c} - {d}", f"{a} - {b} - {c} + {d}", f"{a} - {b} + {c} - {d}")],
    False,
)


@query(_r2(_FOURS + " " + _spread(_WHT)))
def hadamard4(s, d):
    """Walsh-Hadamard coefficients of 4 by 4 blocks."""
    return transforms.spread4(transforms.hadamard_forward(_centred(s, d)))


@query(_r2("SELECT image_id, y, x, r AS v FROM r2"))
def squeeze_roundtrip(s, d):
    """The red plane through a pyramid of six steps and back."""
    plane = _r2p(s, d).select("image_id", "y", "x", F.col("r").alias("v"))
    return pyramid.unsqueezed(pyramid.squeezed(plane, 6), 6)


# neighbourhoods
_AROUND = """, z AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM r2 GROUP BY image_id),
 nb AS (SELECT p.image_id, p.y, p.x, dy, dx, p.r / 255.0 AS pr, p.g / 255.0 AS pg, p.b / 255.0 AS pb, q.r / 255.0 AS r, q.g / 255.0 AS g, q.b / 255.0 AS b FROM r2 p JOIN z USING (image_id), range(-1, 2) AS a(dy), range(-1, 2) AS c(dx), r2 q
   WHERE q.image_id = p.image_id AND q.y = least(greatest(p.y + dy, 0), h - 1) AND q.x = least(greatest(p.x + dx, 0), w - 1))"""
_SMOOTH_W = f"CASE abs(dy) + abs(dx) WHEN 0 THEN 1 WHEN 1 THEN {stencils.SMOOTH[0]} ELSE {stencils.SMOOTH[1]} END"
_EDGE_W = f"greatest(0, 1 - (40 * abs(r - pr) + 5 * abs(g - pg) + 3.5 * abs(b - pb)) * {stencils.STEP * 6.5!r} / 30 * CASE WHEN y % 8 IN (0, 7) OR x % 8 IN (0, 7) THEN {2 / 3!r} ELSE 1 END)"


def _unit_planes(s, d):
    p = _r2p(s, d)
    return p.select("image_id", "y", "x", *(_unit(c).alias(c) for c in "rgb")), rasters.image_sizes(p)


def _rounded(p):
    return p.select("image_id", "y", "x", *(F.round(c, 6).alias(c) for c in "rgb"))


@query(_r2(_AROUND + " SELECT image_id, y, x, " + ", ".join(f"round(sum({c} * {_SMOOTH_W}) / {1 + 4 * sum(stencils.SMOOTH)!r}, 6) AS {c}" for c in "rgb") + " FROM nb GROUP BY image_id, y, x"))
def smoothed_planes(s, d):
    """Weighted means of three by three, by tiles of 8 that exchange their edges."""
    return _rounded(stencils.smoothed(*_unit_planes(s, d), ("r", "g", "b"), tile=8))


@query(_r2(_AROUND + " SELECT image_id, y, x, " + ", ".join(f"round(sum({c} * w) / sum(w), 6) AS {c}" for c in "rgb") + f" FROM (SELECT *, {_EDGE_W} AS w FROM nb WHERE abs(dy) + abs(dx) < 2) GROUP BY image_id, y, x"))
def edge_preserving_planes(s, d):
    """Means that weigh less what differs more, by tiles of 8."""
    return _rounded(stencils.edge_preserving_pass(*_unit_planes(s, d), ("r", "g", "b"), 2, 30.0, tile=8))


# what entropy coders need
_SYMBOLS = ", s AS (SELECT image_id, channel, symbol, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT image_id, '{c}' AS channel, {c} AS symbol FROM r2" for c in "rgba") + ") GROUP BY ALL)"


@query(_r2(_SYMBOLS + """, t AS (SELECT *, sum(n) OVER w AS total, count(*) OVER w AS used, least(greatest(n * 4096 // sum(n) OVER w, 1), 4095) AS f FROM s WINDOW w AS (PARTITION BY image_id, channel)),
 u AS (SELECT *, 4096 - sum(f) OVER w AS rest, row_number() OVER (PARTITION BY image_id, channel ORDER BY f DESC, symbol) AS k FROM t WINDOW w AS (PARTITION BY image_id, channel))
 SELECT image_id, channel, symbol, n, CAST(CASE WHEN used = 1 THEN 4096 ELSE f + CASE WHEN k = 1 THEN rest ELSE 0 END END AS INTEGER) AS frequency FROM u"""))
def normalised_counts(s, d):
    """Counts of the samples of each channel, scaled to 4,096."""
    return codes.normalised(codes.symbol_counts(_r2p(s, d)), ["image_id", "channel"])


@query(_r2(_SYMBOLS + " SELECT image_id, channel, count(*) AS symbols, CASE WHEN count(*) = 1 THEN 0.5 ELSE 1.0::DOUBLE END AS kraft, CAST(sum(n) AS BIGINT) AS n, true AS near_entropy FROM s GROUP BY image_id, channel"))
def prefix_codes(s, d):
    """Optimal code lengths of each channel's samples: their Kraft sum, and whether they cost less than a bit a sample over the entropy."""
    made = codes.with_lengths(codes.symbol_counts(_r2p(s, d)), ["image_id", "channel"])
    g = made.groupBy("image_id", "channel").agg(F.count("*").alias("symbols"), F.sum(F.pow(F.lit(2.0), -F.col("length"))).alias("kraft"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("bits"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    entropy = F.col("n") * F.log2("n") - F.col("own")
    near = F.when(F.col("symbols") == 1, F.col("bits") == F.col("n")).otherwise((F.col("bits") >= entropy - 1e-6) & (F.col("bits") < entropy + F.col("n")))
    return g.select("image_id", "channel", "symbols", "kraft", "n", near.alias("near_entropy"))


def context_trees(s, d):
    """A tree of cuts for each channel over all images: tokens are sizes of left differences, properties the samples above and on the left and their difference."""
    near = pixels.neighbours(_r2p(s, d), tuple("rgb"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("channel"), F.col(c).alias("v"), F.col(f"{c}_l").alias("left"), F.col(f"{c}_u").alias("up")) for k, c in enumerate("rgb"))))
    e = near.select(each.alias("e")).select("e.*")
    token = F.length(F.bin(F.abs(F.col("v") - F.col("left"))))
    samples_ = e.select("channel", "left", "up", (F.col("left") - F.col("up")).alias("turn"), token.alias("token"))
    return codes.context_tree(samples_, "channel", ["left", "up", "turn"], "token", contexts=16).withColumnRenamed("grp", "channel")


QUERIES["context_trees"] = context_trees


# compressed files by bands
@query(_r2("SELECT image_id, y, x, r, g, b, a FROM r2"))
def png_filtered_roundtrip(s, d):
    """Files with the chosen filters, compressed by bands of 16 rows, and their pixels again."""
    return png.read_png_filtered(png.write_png_filtered(_r2p(s, d), band=16))


@query(_r2("SELECT image_id, CAST(y // 16 AS INTEGER) AS band, CAST(max(x) + 1 AS INTEGER) AS width, CAST(count(DISTINCT y) AS INTEGER) AS n_rows, CAST(count(DISTINCT y) * (4 * (max(x) + 1) + 1) AS BIGINT) AS size FROM r2 GROUP BY image_id, y // 16"))
def png_bands(s, d):
    """The bands of each image that are compressed apart."""
    return png.compressed_bands(_r2p(s, d), band=16).select("image_id", "band", "width", F.col("rows").alias("n_rows"), "size")


# streams of bitmaps, signatures of all formats
@query(_r2(""", z AS (SELECT image_id, CAST(max(y) + 1 AS BIGINT) AS h FROM r2 GROUP BY image_id), c AS (SELECT image_id, h, 122 + 64 * h AS whole, image_id % 3 AS k FROM z),
 e AS (SELECT *, CASE k WHEN 0 THEN whole WHEN 1 THEN least(whole, (whole // 2 + 999) // 1000 * 1000) ELSE least(whole, 20) END AS got FROM c)
 SELECT CAST(image_id AS BIGINT) AS stream_id, CAST(got AS BIGINT) AS bytes_received, CAST(CASE WHEN got >= 30 THEN 16 END AS BIGINT) AS width, CASE WHEN got >= 30 THEN h END AS height,
   CAST(CASE WHEN got >= 30 THEN least(h, greatest(got - 122, 0) // 64) END AS BIGINT) AS rows_ready, CASE WHEN got < 30 THEN 'needs_bytes' WHEN least(h, greatest(got - 122, 0) // 64) = h THEN 'complete' WHEN got >= 186 THEN 'rows_ready' ELSE 'needs_bytes' END AS state FROM e"""))
def bitmap_states(s, d):
    """A stream run over what is there: how far bitmaps are that have come in chunks of 1,000 bytes: every third one whole, one by half, one with its first 20 bytes."""
    f = files.write_bmp(_r2p(s, d)).select("image_id", "content").withColumn("size", F.octet_length("content"))
    come = F.when(F.col("image_id") % 3 == 0, F.col("size")).when(F.col("image_id") % 3 == 1, F.least(F.col("size"), F.expr("(size div 2 + 999) div 1000 * 1000"))).otherwise(F.least(F.col("size"), F.lit(20))).cast("int")
    parts = F.expr("transform(sequence(0, (octet_length(content) - 1) div 1000), i -> named_struct('seq', cast(i as bigint), 'chunk', substring(content, i * 1000 + 1, 1000)))")
    cut = f.withColumn("content", F.substring(F.col("content"), F.lit(1), come))
    chunks = cut.select(F.col("image_id").cast("long").alias("stream_id"), F.explode(parts).alias("p")).select("stream_id", "p.seq", "p.chunk")
    come_in, out, log = (shared_folder(s, f"bitmaps-{k}") for k in ("in", "out", "log"))
    chunks.write.parquet(come_in)
    stream = ingest.bitmap_progress(s.readStream.schema(chunks.schema).parquet(come_in))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/trigger={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("bytes_received", "width", "height", "rows_ready", "state"), "trigger").alias("l")
    return s.read.parquet(out).groupBy("stream_id").agg(last).select("stream_id", "l.*")


_STARTS = [(i * 10 + j, name, h) for i, (name, starts) in enumerate(SIGNATURES) for j, h in enumerate(starts)]


@query("SELECT CAST(s_suppkey AS BIGINT) * 1000 + k AS image_id, name AS format FROM supplier, (VALUES " + ", ".join(f"({k}, '{name}')" for k, name, _ in _STARTS) + ") AS t(k, name)")
def sniff_all_signatures(s, d):
    """For each supplier a file of every signature, with the supplier's key behind it."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(h).alias("h")) for k, _, h in _STARTS)))
    rows = rasters.table(s, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), each.alias("e"))
    content = F.unhex(F.concat("e.h", F.when(F.col("e.h") == "52494646", F.lit("0000000057454250")).otherwise(""), hex_uint(F.col("key"), 4)))
    return rows.select((F.col("key") * 1000 + F.col("e.k")).alias("image_id"), image_format(content).alias("format"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS image_id, 'qoi' AS format, CAST(s_suppkey % 5000 + 1 AS BIGINT) AS width, CAST(s_nationkey * 3 + 2 AS BIGINT) AS height, CAST(8 AS INTEGER) AS bits FROM supplier")
def qoi_headers(s, d):
    """Headers of QOI files, one for each supplier."""
    rows = rasters.table(s, d, "supplier")
    head = F.unhex(F.concat(F.lit(b"qoif".hex()), hex_uint(F.col("s_suppkey") % 5000 + 1, 4, little=False), hex_uint(F.col("s_nationkey") * 3 + 2, 4, little=False), F.lit("0400" + "00" * 7 + "01")))
    return files.inspect(rows.select(F.col("s_suppkey").cast("long").alias("image_id"), head.alias("content"))).select("image_id", "format", "width", "height", "bits")


# containers and table functions
def _container_files(s, d):
    """For each document a container of a type box, an EXIF box and two parts of a codestream, the second open-ended for every third one."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    of = lambda tag, size: F.concat(hex_uint(size, 4, little=False), F.lit(tag.encode().hex()))
    n = F.octet_length("raw")
    half = F.expr("octet_length(raw) div 2")
    docs = rasters.table(s, d, "documents").select(F.col("doc_id").alias("image_id"), text.alias("raw"))
    first = F.concat(of("jxlp", half + 12), F.lit("00000000"), F.hex(F.expr("substring(raw, 1, octet_length(raw) div 2)")))
    last = F.concat(of("jxlp", F.when(F.col("image_id") % 3 == 0, 0).otherwise(n - half + 12)), F.lit("80000001"), F.hex(F.expr("substring(raw, octet_length(raw) div 2 + 1)")))
    head = containers.SIGNATURE.hex() + "00000014" + b"ftypjxl ".hex() + "00" * 8 + "00000001" + b"Exif".hex() + "0000000000000015" + "00" * 5
    return docs.select("image_id", F.unhex(F.concat(F.lit(head), first, last)).alias("content"))


@query("""WITH t AS (SELECT doc_id AS image_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
 SELECT image_id, CAST(k AS INTEGER) AS n, ['ftyp', 'Exif', 'jxlp', 'jxlp'][k + 1] AS tag, CAST([12, 32, 53, 65 + t.n // 2][k + 1] AS BIGINT) AS place,
   CAST(CASE k WHEN 0 THEN 20 WHEN 1 THEN 21 WHEN 2 THEN t.n // 2 + 12 ELSE CASE WHEN image_id % 3 = 0 THEN NULL ELSE t.n - t.n // 2 + 12 END END AS BIGINT) AS size FROM t, range(4) AS kk(k)""")
def container_boxes(s, d):
    """The boxes of containers, without their payloads."""
    return containers.boxes(_container_files(s, d)).withColumnRenamed("at", "place")


@query(CORE_ORACLE["png_chunks"])
def chunk_table_function(s, d):
    """PNG chunks by a table function called from SQL, a partition an image."""
    tables.register(s)
    files.write_png(_r2p(s, d)).createOrReplaceTempView("tessella_chunk_files")
    return s.sql("SELECT image_id, n, name, size, ok FROM image_chunks(TABLE(tessella_chunk_files) PARTITION BY image_id)")


# palettes; no SQL, as boxes are split and errors diffused one after the other
def median_cut_palettes(s, d):
    """Sixteen colours for each image."""
    return palettes.palettes(_r2p(s, d), 16)


def dithered_indices(s, d):
    """Pixels as entries of sixteen colours, errors diffused."""
    p = _r2p(s, d)
    return palettes.dithered(p, palettes.palettes(p, 16))


QUERIES |= {"median_cut_palettes": median_cut_palettes, "dithered_indices": dithered_indices}


# the data source
@query(_r2("""SELECT image_id, CAST(max(x) + 1 AS INTEGER) AS width, count(*) AS n, CAST(sum(r) AS BIGINT) AS r, CAST(sum(g * (x + 1)) AS BIGINT) AS g, CAST(sum(b * (y + 1)) AS BIGINT) AS b, CAST(sum(a) AS BIGINT) AS a
 FROM r2 WHERE y BETWEEN 1 AND 30 GROUP BY image_id"""))
def raster_source(s, d):
    """Images written as files by the data source and read back by it, with the wanted lines pushed down."""
    datasource.register(s)
    folder = shared_folder(s, "rasters")
    files.write_tga(_r2p(s, d)).select("image_id", "content").write.format("raster").option("kind", "tga").mode("append").save(folder)
    p = s.read.format("raster").load(folder).where("y >= 1 and y <= 30")
    image = F.regexp_extract("path", r"([0-9]+)-[0-9]+\.tga$", 1).cast("long").alias("image_id")
    total = lambda c, alias: F.sum(c).cast("long").alias(alias)
    return p.groupBy(image).agg(F.max("width").alias("width"), F.count("*").alias("n"), total(F.col("r"), "r"), total(F.col("g") * (F.col("x") + 1), "g"), total(F.col("b") * (F.col("y") + 1), "b"), total(F.col("a"), "a"))


# sets, approximate aggregates
@query(_r2("SELECT r, g, b FROM r2 WHERE a = 255 INTERSECT SELECT r, g, b FROM r2 WHERE a < 255"))
def colours_with_and_without_alpha(s, d):
    """Colours that occur both opaque and not."""
    p = _r2p(s, d)
    return p.where("a = 255").select("r", "g", "b").intersect(p.where("a < 255").select("r", "g", "b"))


@query(_r2("SELECT r, g, b FROM r2 WHERE a = 255 EXCEPT SELECT r, g, b FROM r2 WHERE a < 255"))
def colours_only_opaque(s, d):
    p = _r2p(s, d)
    return p.where("a = 255").select("r", "g", "b").subtract(p.where("a < 255").select("r", "g", "b"))


@query(_r2("SELECT x, count(*) AS n, true AS distinct_close, true AS median_close FROM r2 GROUP BY x"))
def approximate_colours(s, d):
    """Sketches of each column of pixels: distinct colours within a tenth, the median of red within two hundredths of the ranks."""
    p = _r2p(s, d)
    # apart from the sketches: beside an exact distinct count there would be a sketch for each colour
    exact = p.select("x", "r", "g", "b").dropna().distinct().groupBy("x").agg(F.count("*").alias("exact"))
    near = p.groupBy("x").agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct("r", "g", "b"), 0.02).alias("sketch"), F.percentile_approx("r", 0.5, 1000).alias("median"))
    # a row for each column of 16, then one for each of its 256 values
    near = near.join(F.broadcast(exact), "x")
    counts = p.groupBy("x", "r").agg(F.count("*").alias("k"))
    share = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0)) / F.sum("k")
    ranks = counts.join(F.broadcast(near.select("x", "median")), "x").groupBy("x").agg(share(F.col("r") < F.col("median")).alias("below"), share(F.col("r") <= F.col("median")).alias("up_to"))
    close = F.abs(F.col("sketch") - F.col("exact")) <= F.col("exact") * 0.1
    return near.join(ranks, "x").select("x", "n", close.alias("distinct_close"), ((F.col("below") <= 0.52) & (F.col("up_to") >= 0.48)).alias("median_close"))


@query("SELECT event_type, k, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, 'k' AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v FROM events WHERE props IS NOT NULL) WHERE v IS NOT NULL GROUP BY event_type, k")
def event_properties(s, d):
    """JSON properties of events as a map, one row for each key."""
    e = rasters.table(s, d, "events").select("event_type", F.explode(F.from_json("props", "map<string, bigint>")).alias("k", "v"))
    return e.where("v is not null").groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
