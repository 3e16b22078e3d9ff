"""DuckDB SQL for the queries of queries.py."""

R2 = """r2 AS MATERIALIZED (SELECT image_id, CAST(i >> 4 AS INTEGER) AS y, CAST(i % 16 AS INTEGER) AS x, r, g, b, a FROM (
  SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS i,
    CAST(l_orderkey % 256 AS INTEGER) AS r, CAST(l_partkey % 256 AS INTEGER) AS g,
    CAST(CAST(l_quantity AS INTEGER) * 5 % 256 AS INTEGER) AS b, CAST(CASE WHEN l_returnflag = 'R' THEN l_linenumber * 36 % 256 ELSE 255 END AS INTEGER) AS a
  FROM lineitem UNION ALL SELECT l_suppkey, n + k, 0, 0, 0, 0 FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey), range(16) AS t(k) WHERE (n + k) // 16 = n // 16 AND n % 16 > 0))"""
_SEED = "(s_suppkey + s_nationkey * 31)"
R3 = f"""r3 AS MATERIALIZED (SELECT CAST(s_suppkey AS INTEGER) AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((x * 17 + y * 3 + {_SEED}) & 255 AS INTEGER) AS r,
  CAST((x * 5 + y * 11) & 255 AS INTEGER) AS g, CAST(xor(x * 7, y * 13) & 255 AS INTEGER) AS b, CAST(CASE WHEN (x + y) % 19 = 0 THEN 96 ELSE 255 END AS INTEGER) AS a
  FROM supplier, range(22) AS ry(y), range(35) AS rx(x))"""
BLOCKS = f"""bl AS MATERIALIZED (SELECT CAST(s_suppkey AS INTEGER) AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((x // 5 * 51 + {_SEED}) & 255 AS INTEGER) AS r,
  CAST((y // 3 * 29) & 255 AS INTEGER) AS g, CAST(((x // 5 + y // 3) * 13) & 255 AS INTEGER) AS b, 255 AS a
  FROM supplier, range(22) AS ry(y), range(35) AS rx(x))"""
R1 = """r1 AS (SELECT vec_id AS image_id, CAST(i // 4 AS INTEGER) AS y, CAST(i % 4 AS INTEGER) AS x, CAST(embedding[4 * i + 1] AS DOUBLE) AS r, CAST(embedding[4 * i + 2] AS DOUBLE) AS g,
  CAST(embedding[4 * i + 3] AS DOUBLE) AS b, CAST(embedding[4 * i + 4] AS DOUBLE) AS a FROM embeddings, range(16) AS t(i) WHERE len(embedding) = 64)"""
TEXT = """tb AS (SELECT doc_id AS image_id, CAST(i AS INTEGER) AS x, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) AS v FROM
  (SELECT doc_id, hex(encode(text)) AS h, unnest(range(octet_length(encode(text)))) AS i FROM documents WHERE octet_length(encode(text)) > 0))"""


def _r2(select: str) -> str:
    return f"WITH {R2} {select}"


def _three(table: str, *cols: str) -> str:
    return "SELECT image_id, y, x, " + ", ".join(f"CAST({c} AS INTEGER) AS c{i}" for i, c in enumerate(cols)) + f" FROM {table}"


def _clip(v: str) -> str:
    return f"least(greatest({v}, 0), 255)"


_WHITE = "(({0} * a + 255 * (255 - a) + 127) // 255)"
ORACLE: dict[str, str] = {
    "flagship": _r2("SELECT image_id, count(*) AS n_pixels, round(avg(r), 4) AS mean_r, round(avg(g), 4) AS mean_g, round(avg(b), 4) AS mean_b, count(DISTINCT (r, g, b)) AS n_colours FROM r2 GROUP BY image_id"),
    "raster_r1": f"WITH {R1} SELECT image_id, y, x, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM r1",
    "raster_r2": _r2("SELECT * FROM r2"),
    "raster_r3": f"WITH {R3} SELECT * FROM r3",
    "raster_r4": f"WITH {TEXT} SELECT * FROM tb",
    "oriented_dims": _r2("SELECT image_id, CAST(image_id % 8 + 1 AS INTEGER) AS orientation, CASE WHEN image_id % 8 >= 4 THEN h ELSE w END AS oriented_width, CASE WHEN image_id % 8 >= 4 THEN w ELSE h END AS oriented_height FROM (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM r2 GROUP BY image_id)"),
    "white_composite": _r2(_three("r2", *(_WHITE.format(c) for c in "rgb"))),
    "matte_composite": _r2(_three("r2", *(f"CASE WHEN a = 255 THEN {c} ELSE ({c} * a + 64 * (255 - a) + 127) // 255 END" for c in "rgb"))),
    "rgb_to_ycbcr": _r2(_three("r2", "(19595 * r + 38470 * g + 7471 * b + 32768) >> 16", "(-11059 * r - 21709 * g + 32768 * b + 8421375) >> 16", "(32768 * r - 27439 * g - 5329 * b + 8421375) >> 16")),
    "ycbcr_to_rgb": _r2(_three("r2", _clip("(r * 256 + 359 * (b - 128) + 128) >> 8"), _clip("(r * 256 - 88 * (g - 128) - 183 * (b - 128) + 128) >> 8"), _clip("(r * 256 + 454 * (g - 128) + 128) >> 8"))),
    "yuv_limited": _r2(_three("r2", "((66 * r + 129 * g + 25 * b + 128) >> 8) + 16", "((-38 * r - 74 * g + 112 * b + 128) >> 8) + 128", "((112 * r - 94 * g - 18 * b + 128) >> 8) + 128")),
    "chroma_420": f"""WITH {R3}, c AS (SELECT image_id, y >> 1 AS y, x >> 1 AS x, ((-38 * r - 74 * g + 112 * b + 128) >> 8) + 128 AS u, ((112 * r - 94 * g - 18 * b + 128) >> 8) + 128 AS v FROM r3)
      SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((2 * sum(u) + count(*)) // (2 * count(*)) AS INTEGER) AS u, CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS INTEGER) AS v FROM c GROUP BY ALL""",
    "cmyk_to_rgb": _r2(_three("r2", *(f"({c} * a + 127) // 255" for c in "rgb"))),
    "rct_forward": _r2(_three("(SELECT *, g - t AS cg FROM (SELECT *, r - b AS co, b + ((r - b) >> 1) AS t FROM r2))", "t + (cg >> 1)", "co", "cg")),
    "rct_roundtrip": _r2("SELECT * FROM r2"),
    "subtract_green": _r2(_three("r2", "(r - g + 256) % 256", "g", "(b - g + 256) % 256")),
    "unpremultiply": _r2(_three("r2", *(f"CASE WHEN a IN (0, 255) THEN {c} ELSE least(255, round({c} * 255 / a)) END" for c in "rgb"))),
    "scale_bits": _r2(_three("r2", "(r // 8) * 255 // 31", "round((r // 8) * 255 / 31)", "(g // 16) * 17")),
    "unpack_bits": _r2("SELECT image_id, y, CAST(x * 8 + k AS INTEGER) AS x, CAST(r // pow(2, 7 - k)::INTEGER % 2 AS INTEGER) AS v FROM r2, range(8) AS t(k)"),
    "float_to_byte": f"WITH {R1} " + _three("r1", *(f"floor(least(greatest({c}, 0), 1) * 255 + 0.5)" for c in "rgb")),
    "extended_srgb": f"WITH {R1} SELECT image_id, y, x, " + ", ".join(f"round(sign({c}) * CASE WHEN abs({c}) <= 0.0031308 THEN 12.92 * abs({c}) ELSE 1.055 * pow(abs({c}), 1 / 2.4) - 0.055 END, 6) AS c{i}" for i, c in enumerate("rgb")) + " FROM r1",
    "spot_composite": _r2("SELECT image_id, y, x, " + ", ".join(f"round(a / 255 * 200 + (1 - a / 255) * {c}, 6) AS c{i}" for i, c in enumerate("rgb")) + " FROM r2"),
    "bilevel_threshold": _r2("SELECT image_id, CAST(count(*) FILTER ((299 * {} + 587 * {} + 114 * {} + 500) // 1000 < 128) AS BIGINT) AS n_black, count(*) AS n FROM r2 GROUP BY image_id".format(*(_WHITE.format(c) for c in "rgb"))),
    "polarity": _r2("SELECT image_id, y, x, CAST((255 - r) & CASE WHEN x = 15 THEN 240 ELSE 255 END AS INTEGER) AS v FROM r2"),
    "is_bilevel": _r2("SELECT image_id, bool_and(a = 255 AND r = g AND g = b AND r IN (0, 255)) AS bilevel, min(a) = 255 AS opaque, min(a) < 255 AS alpha_used FROM r2 GROUP BY image_id"),
    "horizontal_predictor": _r2("SELECT image_id, y, x, " + ", ".join(f"CAST(({c} - coalesce(lag({c}) OVER w, 0) + 256) % 256 AS INTEGER) AS {c}" for c in "rgba") + " FROM r2 WINDOW w AS (PARTITION BY image_id, y ORDER BY x)"),
    "horizontal_predictor_undo": _r2("SELECT * FROM r2"),
    "byte_delta": f"""WITH {TEXT}, o AS (SELECT image_id, CAST(CASE WHEN x % 2 = 0 THEN x // 2 ELSE (count(*) OVER (PARTITION BY image_id) + 1) // 2 + x // 2 END AS INTEGER) AS x, v FROM tb),
      l AS (SELECT *, lag(v) OVER (PARTITION BY image_id ORDER BY x) AS p FROM o) SELECT image_id, x, CAST(CASE WHEN p IS NULL THEN v ELSE (v - p + 384) % 256 END AS INTEGER) AS v FROM l""",
    "interlace_rows": f"WITH {R3} SELECT DISTINCT image_id, y, CAST(CASE WHEN y % 8 = 0 THEN 0 WHEN y % 8 = 4 THEN 1 WHEN y % 2 = 0 THEN 2 ELSE 3 END AS INTEGER) AS pass FROM r3",
    "adam7_passes": f"""WITH {R3}, p AS (SELECT *, CASE WHEN y % 2 = 1 THEN 7 WHEN x % 2 = 1 THEN 6 WHEN y % 4 = 2 THEN 5 WHEN x % 4 = 2 THEN 4 WHEN y % 8 = 4 THEN 3 WHEN x % 8 = 4 THEN 2 ELSE 1 END AS pass FROM r3)
      SELECT image_id, CAST(pass AS INTEGER) AS pass, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_r FROM p GROUP BY ALL""",
    "palette_distinct": f"WITH {BLOCKS} SELECT image_id, r, g, b, count(*) AS n FROM bl GROUP BY ALL",
    "gray_palette_worth": _r2("SELECT image_id, count(DISTINCT g) AS n, CAST(max(g) - min(g) + 1 AS BIGINT) AS span, count(DISTINCT g) < 0.8 * (max(g) - min(g) + 1) AS worth FROM r2 GROUP BY image_id"),
    "channel_entropy": _r2("SELECT image_id, round(-sum(c / n * log2(c / n)), 6) AS bits FROM (SELECT image_id, b, count(*) AS c, sum(count(*)) OVER (PARTITION BY image_id) AS n FROM r2 GROUP BY image_id, b) GROUP BY image_id"),
    "box_downsample": f"""WITH {R3} SELECT image_id, CAST(b_y AS INTEGER) AS y, CAST(bx AS INTEGER) AS x, {', '.join(f'CAST(round(avg({c})) AS INTEGER) AS {c}' for c in 'rgba')}, count(*) AS n
      FROM r3, range(5) AS p(b_y), range(8) AS q(bx) WHERE y >= b_y * 22 // 5 AND y < ceil((b_y + 1) * 22 / 5) AND x >= bx * 35 // 8 AND x < ceil((bx + 1) * 35 / 8) GROUP BY ALL""",
    "opaque_fix": _r2("SELECT image_id, y, x, r, g, b, CAST(CASE WHEN image_id % 2 = 0 OR max(a) OVER (PARTITION BY image_id) = 0 THEN 255 ELSE a END AS INTEGER) AS a FROM r2"),
    "mean_error": _r2("SELECT image_id, round(sum(r % 4) / (3 * count(*)), 9) AS error FROM r2 GROUP BY image_id"),
    "line_cover": _r2("SELECT image_id, count(DISTINCT y) AS lines, true AS covered FROM r2 GROUP BY image_id"),
    "palette_lookup": f"WITH {R3} SELECT image_id, count(*) AS n, count(n_nationkey) AS found, CAST(sum(n_nationkey * 10) AS BIGINT) AS total FROM r3 LEFT JOIN nation ON n_nationkey = r % 32 GROUP BY image_id",
    "encode_limits": _r2("SELECT image_id, h * 700 <= 65535 AS gif, h * 700 <= 16384 AS webp_lossless, h * 700 <= 16383 AS webp_lossy FROM (SELECT image_id, max(y) + 1 AS h FROM r2 GROUP BY image_id)"),
    "joined_segments": "SELECT l_orderkey AS image_id, CASE WHEN count(DISTINCT l_linenumber) = max(l_linenumber) AND count(*) = max(l_linenumber) THEN string_agg(l_returnflag, '' ORDER BY l_linenumber) END AS joined FROM lineitem GROUP BY l_orderkey",
    "missing_profile": _r2("SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height FROM r2 WHERE image_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY image_id"),
    "colour_totals": _r2("SELECT image_id, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS sum_{c}" for c in "rgba") + ", min(r) AS low, max(r) AS high FROM r2 GROUP BY image_id"),
    "stream_states": """WITH c AS (SELECT user_id AS stream_id, event_id AS seq, CAST(sum(length(props)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n FROM events)
      SELECT stream_id, seq, n AS bytes_received, CASE WHEN n < 16 THEN 'needs_bytes' WHEN n < 50 THEN 'headers_ready' WHEN n < 400 THEN 'dc_ready' ELSE 'complete' END AS state, CAST(least(1.0, round(n / 400, 6)) AS DOUBLE) AS progress FROM c""",
    "arriving_totals": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL",
}
_ORDERS = {"red": ("r", "r", "r", "255"), "gray_alpha": ("r", "r", "r", "g"), "rgb": ("r", "g", "b", "255"), "bgr": ("b", "g", "r", "255"), "rgba": ("r", "g", "b", "a"), "bgra": ("b", "g", "r", "a"), "argb": ("g", "b", "a", "r"), "abgr": ("a", "b", "g", "r")}
for _k, _v in _ORDERS.items():
    _abgr = ("a", "b", "g", "r")
    ORACLE[f"channel_order_{_k}"] = _r2("SELECT image_id, y, x, " + ", ".join(f"CAST({v} AS INTEGER) AS {c}" for v, c in zip(_v, "rgba")) + " FROM r2")
_TURNS = {1: ("x", "y"), 2: ("34 - x", "y"), 3: ("34 - x", "21 - y"), 4: ("x", "21 - y"), 5: ("y", "x"), 6: ("21 - y", "x"), 7: ("21 - y", "34 - x"), 8: ("y", "34 - x")}
for _k, (_x, _y) in _TURNS.items():
    ORACLE[f"orient_{_k}"] = f"WITH {R3} SELECT image_id, CAST({_y} AS INTEGER) AS y, CAST({_x} AS INTEGER) AS x, r, g, b, a FROM r3"
for _k, _v in {"or": "r | g", "and": "r & g", "xor": "xor(r, g)", "xnor": "255 - xor(r, g)", "replace": "g"}.items():
    ORACLE[f"combine_{_k}"] = _r2(f"SELECT image_id, y, x, CAST({_v} AS INTEGER) AS v FROM r2")

_NEAR = ", ".join(f"coalesce(lag({c}) OVER up, 0) AS {c}u, coalesce(lag({c}) OVER le, 0) AS {c}l" for c in "rgba")
_NEAR2 = ", ".join(f"coalesce(lag({c}u) OVER le, 0) AS {c}c" for c in "rgba")


def _residual(kind: int, c: str) -> str:
    pa, pb, pc = f"abs({c}u - {c}c)", f"abs({c}l - {c}c)", f"abs({c}l + {c}u - 2 * {c}c)"
    guess = ("0", f"{c}l", f"{c}u", f"(({c}l + {c}u) // 2)", f"(CASE WHEN {pa} <= {pb} AND {pa} <= {pc} THEN {c}l WHEN {pb} <= {pc} THEN {c}u ELSE {c}c END)")[kind]
    m = f"(({c} - {guess} + 256) % 256)"
    return f"least({m}, 256 - {m})"


ORACLE["png_filter_choice"] = _r2(f"""
 , n1 AS (SELECT *, {_NEAR} FROM r2 WINDOW up AS (PARTITION BY image_id, x ORDER BY y), le AS (PARTITION BY image_id, y ORDER BY x)),
 n2 AS (SELECT *, {_NEAR2} FROM n1 WINDOW le AS (PARTITION BY image_id, y ORDER BY x)),
 s AS (SELECT image_id, y, {', '.join(f"CAST(sum({' + '.join(_residual(k, c) for c in 'rgba')}) AS BIGINT) AS f{k}" for k in range(5))} FROM n2 GROUP BY image_id, y),
 u AS (SELECT image_id, y, unnest([0, 1, 2, 3, 4]) AS k, unnest([f0, f1, f2, f3, f4]) AS v FROM s)
 SELECT image_id, y, CAST(arg_min(k, v * 8 + k) AS INTEGER) AS filter, min(v) AS score FROM u WHERE y > 0 OR k NOT IN (2, 4) GROUP BY image_id, y""")
ORACLE["gradient_residual"] = _r2("""
 , n1 AS (SELECT *, lag(g) OVER (PARTITION BY image_id, x ORDER BY y) AS u, lag(g) OVER (PARTITION BY image_id, y ORDER BY x) AS l FROM r2),
 n2 AS (SELECT *, lag(u) OVER (PARTITION BY image_id, y ORDER BY x) AS c FROM n1),
 n3 AS (SELECT image_id, y, x, g, coalesce(l, u, 0) AS l, coalesce(u, l, 0) AS u, coalesce(c, l, u, 0) AS c FROM n2)
 SELECT image_id, y, x, CAST(g - CASE WHEN x = 0 OR y = 0 THEN l ELSE least(greatest(l + u - c, least(l, u)), greatest(l, u)) END AS INTEGER) AS residual FROM n3""")


def _runs(keys: str, order: str, longest: int, select: str | None = None) -> str:
    part = f"PARTITION BY {keys} ORDER BY {order}"
    return f"""WITH {BLOCKS}, t AS (SELECT *, CASE WHEN lag((r, g, b, a)) OVER ({part}) = (r, g, b, a) THEN 0 ELSE 1 END AS turn FROM bl),
      k AS (SELECT *, sum(turn) OVER ({part}) AS run FROM t),
      o AS (SELECT image_id, arg_min(y, y * 35 + x) AS y, arg_min(x, y * 35 + x) AS x, count(*) AS n FROM k GROUP BY {keys}, run)
      {select or f'SELECT image_id, y, x, CAST(n AS INTEGER) AS length, CAST(ceil(n / {longest}) AS INTEGER) AS packets FROM o'}"""


ORACLE["runs_raster"] = _runs("image_id", "y, x", 62)
ORACLE["runs_rows"] = _runs("image_id, y", "x", 128)
ORACLE["run_expansion"] = f"WITH {BLOCKS} SELECT image_id, y, count(*) AS n, max(x) AS last FROM bl GROUP BY image_id, y"
_CELLS = R2 + ", c AS (SELECT *, CAST((r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) AS INTEGER) AS cell FROM (SELECT image_id, y, x, " + ", ".join(f"CASE WHEN a = 255 THEN {c} ELSE ({c} * a + 255 * (255 - a) + 127) // 255 END AS {c}" for c in "rgb") + " FROM r2 WHERE a >= 128))"
ORACLE["hist555"] = f"WITH {_CELLS} SELECT image_id, cell, count(*) AS n, " + ", ".join(f"CAST(round(sum({c}) / count(*)) AS INTEGER) AS {c}" for c in "rgb") + " FROM c GROUP BY image_id, cell"
_FIRST = f"WITH {_CELLS}, f AS (SELECT image_id, cell, " + ", ".join(f"CAST(arg_min({c}, y * 16 + x) AS INTEGER) AS {c}" for c in "rgb") + " FROM c GROUP BY image_id, cell)"
ORACLE["first_colour_cell"] = f"{_FIRST} SELECT * FROM f"
ORACLE["nearest_palette"] = f"""{_FIRST}, p AS (SELECT CAST(i AS INTEGER) AS i, i // 16 * 85 AS pr, i // 4 % 4 * 85 AS pg, i % 4 * 85 AS pb FROM range(64) AS t(i)),
 d AS (SELECT image_id, cell, i, CAST(3 * (r - pr) * (r - pr) + 4 * (g - pg) * (g - pg) + 2 * (b - pb) * (b - pb) AS INTEGER) AS d FROM f, p)
 SELECT image_id, cell, arg_min(i, d * 64 + i) AS entry, min(d) AS distance FROM d GROUP BY image_id, cell"""

_BODY = "string_agg(printf('%02X%02X%02X%02X', {order}), '' ORDER BY {by})"
_LE4 = "(printf('%02X', ({0}) % 256) || printf('%02X', ({0}) // 256 % 256) || printf('%02X', ({0}) // 65536 % 256) || printf('%02X', ({0}) // 16777216))"
_LE2 = "(printf('%02X', ({0}) % 256) || printf('%02X', ({0}) // 256 % 256))"


def _encoded(order: str, by: str, head: str, tail: str) -> str:
    body = _BODY.format(order=order, by=by)
    return _r2(f", i AS (SELECT image_id, CAST(max(x) + 1 AS BIGINT) AS w, CAST(max(y) + 1 AS BIGINT) AS h, {body} AS body FROM r2 GROUP BY image_id), e AS (SELECT image_id, {head} || body || {tail} AS c FROM i) SELECT image_id, CAST(length(c) // 2 AS BIGINT) AS length, md5(c) AS digest FROM e")


_BMP = " || ".join(["'424D'", _LE4.format("122 + 4 * w * h"), "'000000007A0000006C000000'", _LE4.format("w"), _LE4.format("h"), "'0100200003000000'", _LE4.format("4 * w * h"), "'130B0000130B00000000000000000000'", "'0000FF0000FF0000FF000000000000FF42475273'", "repeat('00', 48)"])
ORACLE["encode_bmp"] = _encoded("b, g, r, a", "-y, x", _BMP, "''")
ORACLE["encode_tga"] = _encoded("b, g, r, a", "y, x", "'000002000000000000000000' || " + _LE2.format("w") + " || " + _LE2.format("h") + " || '2028'", "'000000000000000054525545564953494F4E2D5846494C452E00'")
_TIFF = " || ".join(["'08000800080008000A00'", "'000104000100" + "0000' || " + _LE4.format("w"), "'0101040001000000' || " + _LE4.format("h"), "'0201030004000000' || " + _LE4.format("4 * w * h + 8"), "'030103000100000001000000'", "'060103000100000002000000'", "'110104000100000008000000'", "'150103000100000004000000'", "'1601040001000000' || " + _LE4.format("h"), "'1701040001000000' || " + _LE4.format("4 * w * h"), "'520103000100000002000000'", "'00000000'"])
ORACLE["encode_tiff"] = _encoded("r, g, b, a", "y, x", "'49492A00' || " + _LE4.format("4 * w * h + 16"), _TIFF)
for _k in ("bmp", "tga", "tiff"):
    ORACLE[f"roundtrip_{_k}"] = _r2("SELECT * FROM r2")

_SIZES = R2 + ", z AS (SELECT image_id, CAST(max(x) + 1 AS BIGINT) AS w, CAST(max(y) + 1 AS BIGINT) AS h FROM r2 GROUP BY image_id)"
_META = f"""WITH {_SIZES}, m AS (SELECT image_id * 8 + k AS image_id, ['bmp', 'tga', 'tiff', 'png'][k + 1] AS format, w, h,
   CASE k WHEN 0 THEN 122 + 4 * w * h WHEN 1 THEN 44 + 4 * w * h WHEN 2 THEN 8 + 4 * w * h + 8 + 2 + 120 + 4 ELSE 8 + 25 + 12 + 6 + 5 * ((h * (4 * w + 1) + 65534) // 65535) + h * (4 * w + 1) + 12 END AS length
   FROM z, range(4) AS t(k)
   UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 8 + 7, NULL, NULL, NULL, octet_length(encode(r_name)) FROM region)"""
_SEEN = "CASE WHEN format <> 'tiff' THEN {0} END"
ORACLE["sniff_formats"] = f"{_META} SELECT image_id, format FROM m"
ORACLE["inspect_headers"] = f"{_META} SELECT image_id, format, {_SEEN.format('w')} AS width, {_SEEN.format('h')} AS height, CAST({_SEEN.format('8')} AS INTEGER) AS bits, CASE WHEN format = 'bmp' THEN round(2835 / 39.37007874015748, 6) END AS ppi_x FROM m WHERE format <> 'tiff'"
ORACLE["budget_filter"] = f"{_META} SELECT image_id, w AS width, h AS height FROM m WHERE format <> 'tiff' AND w * h <= 600"
ORACLE["file_outcomes"] = f"""{_META}, c AS (SELECT *, CASE WHEN image_id % 3 = 0 THEN length // 2 ELSE length END AS kept FROM m),
 e AS (SELECT *, CASE WHEN format = 'tga' AND image_id % 3 = 0 THEN NULL ELSE format END AS seen FROM c),
 o AS (SELECT image_id, seen, CASE WHEN seen IS NULL THEN 'unknown format' WHEN seen = 'tiff' AND kept < length THEN 'truncated header' WHEN w * h > 640 THEN 'over budget'
   WHEN seen = 'png' THEN 'no reader for this png' WHEN 4 * w * h + CASE seen WHEN 'bmp' THEN 122 WHEN 'tga' THEN 18 ELSE 8 END > kept THEN 'truncated pixels' END AS error FROM e)
 SELECT image_id, seen AS format, CASE WHEN error IS NULL THEN 'decoded' ELSE 'skipped' END AS status, error FROM o"""
ORACLE["metadata_headers"] = """SELECT CAST(s_suppkey * 3 + k AS BIGINT) AS image_id, ['jpeg', 'webp', 'open_exr'][k + 1] AS format, CAST(s_suppkey % 4000 + 1 AS BIGINT) AS width, CAST(s_nationkey * 9 + 7 AS BIGINT) AS height,
  CAST([8, 8, 32][k + 1] AS INTEGER) AS bits, 'rgb' AS model, CAST(CASE WHEN k = 0 THEN s_suppkey % 8 + 1 ELSE 1 END AS INTEGER) AS orientation,
  CASE WHEN k = 0 THEN round(CAST(s_suppkey % 300 + 1 AS DOUBLE), 6) END AS ppi_x, CASE WHEN k = 0 THEN round(CAST(s_suppkey % 300 + 2 AS DOUBLE), 6) END AS ppi_y,
  CAST(CASE WHEN k = 0 THEN 32 END AS BIGINT) AS exif_bytes, CAST(NULL AS VARCHAR) AS error FROM supplier, range(3) AS t(k)"""
ORACLE["metadata_written"] = f"""{_META} SELECT image_id, format, CASE WHEN format IN ('tiff', 'png') THEN w END AS width, CASE WHEN format IN ('tiff', 'png') THEN h END AS height, CAST(CASE WHEN format IN ('tiff', 'png') THEN 8 END AS INTEGER) AS bits,
  CASE WHEN format IS NULL THEN 'unknown format' WHEN format NOT IN ('tiff', 'png') THEN 'no reader of metadata for this format' END AS error FROM m"""
ORACLE["png_chunks"] = f"""WITH {_SIZES} SELECT image_id, CAST(k AS INTEGER) AS n, ['IHDR', 'IDAT', 'IEND'][k + 1] AS name, CAST([13, 6 + 5 * ((h * (4 * w + 1) + 65534) // 65535) + h * (4 * w + 1), 0][k + 1] AS BIGINT) AS size, true AS ok FROM z, range(3) AS t(k)"""
ORACLE["format_inventory"] = f"{_META} SELECT coalesce(format, 'none') AS format, count(*) AS n, CAST(sum(length) AS BIGINT) AS bytes, coalesce(CASE WHEN format <> 'tiff' THEN max(h) END, 0) AS tallest FROM m GROUP BY m.format"
ORACLE["format_cube"] = f"{_META}, t AS (SELECT coalesce(format, 'none') AS f, CAST(coalesce({_SEEN.format('h')} > 38, false) AS INTEGER) AS t FROM m) SELECT coalesce(f, 'all') AS format, coalesce(t, -1) AS tall, count(*) AS n, CAST(grouping(f) * 2 + grouping(t) AS BIGINT) AS level FROM t GROUP BY CUBE (f, t)"
ORACLE["top_k_largest"] = f"{_META} SELECT image_id, format, CAST(length AS BIGINT) AS length FROM m ORDER BY length DESC, image_id LIMIT 10"
ORACLE["rank_by_height"] = f"{_META} SELECT image_id, format, CAST(rank() OVER (PARTITION BY format ORDER BY {_SEEN.format('h')} DESC NULLS LAST) AS INTEGER) AS rank FROM m WHERE format IS NOT NULL"
ORACLE["sniff_signatures"] = "SELECT CAST(k AS INTEGER) AS k, f AS format FROM (VALUES (0, 'bmp'), (10, 'gif'), (11, 'gif'), (20, 'png'), (30, 'jbig2'), (40, 'jpeg'), (50, 'jpeg_xl'), (51, 'jpeg_xl'), (60, 'open_exr'), (70, 'webp'), (80, 'qoi'), (90, 'tiff'), (91, 'tiff')) AS t(k, f)"
_BLOCK_BMP = _BMP
ORACLE["duplicates_by_hash"] = f"WITH {BLOCKS}, i AS (SELECT image_id, CAST(35 AS BIGINT) AS w, CAST(22 AS BIGINT) AS h, " + _BODY.format(order="b, g, r >> 7, a", by="-y, x") + f" AS body FROM bl GROUP BY image_id), e AS (SELECT image_id, md5({_BMP} || body) AS digest FROM i) SELECT digest, count(*) AS n, min(image_id) AS first FROM e GROUP BY digest"

_LAB = """, f AS (SELECT image_id, y, x, (100.0::DOUBLE * r / 255 + 16) / 116 AS fy, g::DOUBLE AS ga, b::DOUBLE AS bb FROM r2),
 h AS (SELECT *, fy + (ga / 255 * 255 - 128) / 500 AS fx, fy - (bb / 255 * 255 - 128) / 200 AS fz FROM f),
 v AS (SELECT image_id, y, x, 0.96422::DOUBLE * {0} AS px, {1} AS py, 0.82521::DOUBLE * {2} AS pz FROM h),
 q AS (SELECT image_id, y, x, {3} AS l0, {4} AS l1, {5} AS l2 FROM v)
 SELECT image_id, y, x, {6} FROM q""".format(
    *(f"(CASE WHEN {c} > 6::DOUBLE / 29 THEN {c} * {c} * {c} ELSE 3 * (6::DOUBLE / 29) * (6::DOUBLE / 29) * ({c} - 4::DOUBLE / 29) END)" for c in ("fx", "fy", "fz")),
    *(f"least(greatest({a}::DOUBLE * px + {b}::DOUBLE * py + {c}::DOUBLE * pz, 0), 1)" for a, b, c in (("3.1338561", "-1.6168667", "-0.4906146"), ("-0.9787684", "1.9161415", "0.0334540"), ("0.0719453", "-0.2289914", "1.4052427"))),
    ", ".join(f"round(CASE WHEN l{i} <= 0.0031308 THEN 12.92 * l{i} ELSE 1.055 * pow(l{i}, 1 / 2.4) - 0.055 END, 6) AS c{i}" for i in range(3)),
)
ORACLE["lab_to_srgb"] = _r2(_LAB)
ORACLE["rct_inverse_types"] = _r2(""", k AS (SELECT image_id, y, x, CAST(image_id % 7 AS INTEGER) AS kind, r AS a, g - 128 AS b, b - 128 AS c FROM r2),
 t AS (SELECT *, a - (c >> 1) AS tmp, CASE WHEN kind IN (1, 3, 5) THEN a + c ELSE c END AS c2 FROM k)
 SELECT image_id, y, x, kind, CAST(CASE WHEN kind = 6 THEN tmp - (b >> 1) + b ELSE a END AS INTEGER) AS c0,
  CAST(CASE kind WHEN 6 THEN c + tmp WHEN 2 THEN b + a WHEN 3 THEN b + a WHEN 4 THEN b + ((a + c2) >> 1) WHEN 5 THEN b + ((a + c2) >> 1) ELSE b END AS INTEGER) AS c1,
  CAST(CASE WHEN kind = 6 THEN tmp - (b >> 1) ELSE c2 END AS INTEGER) AS c2 FROM t""")
ORACLE["cross_colour"] = _r2(""", s AS (SELECT *, CASE WHEN g > 127 THEN g - 256 ELSE g END AS sg FROM r2), n AS (SELECT *, (r + ((sg * -20) >> 5) + 256) % 256 AS nr FROM s)
 SELECT image_id, y, x, CAST(nr AS INTEGER) AS c0, g AS c1, CAST((b + ((sg * 13) >> 5) + ((CASE WHEN nr > 127 THEN nr - 256 ELSE nr END * 7) >> 5) + 512) % 256 AS INTEGER) AS c2 FROM n""")
ORACLE["colour_key"] = f"WITH {BLOCKS} SELECT image_id, y, x, CAST(CASE WHEN r = 0 AND g = 0 AND b = 0 THEN 0 ELSE 255 END AS INTEGER) AS a FROM bl"
ORACLE["invert_gray"] = _r2("SELECT image_id, y, x, CAST(255 - r AS INTEGER) AS v FROM r2")
ORACLE["upsample_replicate"] = f"""WITH {R3}, c AS (SELECT image_id, y, x, ((-38 * r - 74 * g + 112 * b + 128) >> 8) + 128 AS u FROM r3)
 SELECT image_id, y, x, CAST((2 * sum(u) OVER w + count(*) OVER w) // (2 * count(*) OVER w) AS INTEGER) AS u FROM c WINDOW w AS (PARTITION BY image_id, y // 2, x // 2)"""
for _k, _v in {"replace": "n", "add": "n + o", "blend": "n * a + o * (1 - a)", "multiply_add": "o + n * a", "multiply": "n * o"}.items():
    ORACLE[f"frame_{_k}"] = _r2(f", s AS (SELECT image_id, y, x, r::DOUBLE / 255 AS n, g::DOUBLE / 255 AS o, a::DOUBLE / 255 AS a FROM r2) SELECT image_id, y, x, round({_v}, 9) AS v FROM s")
ORACLE["frame_durations"] = "SELECT event_id, CAST(CASE WHEN event_id % 90 = 0 THEN 0 ELSE user_id * 7 * 1000000 // (event_id % 90) END AS BIGINT) AS us FROM events"
