"""Tiled filters against loops over whole images, at every edge of a tile."""

import random

import pytest

from tessella.operators import stencils

SIZES = {1: (1, 1), 2: (9, 2), 3: (16, 11), 4: (5, 23), 5: (8, 8)}


@pytest.fixture(scope="module")
def images(spark):
    r = random.Random(6)
    data = {i: [[tuple(r.choice((0.0, 1.0, r.random(), 0.5 + r.random() / 500)) for _ in range(3)) for _ in range(w)] for _ in range(h)] for i, (w, h) in SIZES.items()}
    df = spark.createDataFrame([(i, y, x, *v) for i, img in data.items() for y, row in enumerate(img) for x, v in enumerate(row)], "image_id long, y int, x int, r double, g double, b double").repartition(4)
    return data, df, spark.createDataFrame([(i, w, h) for i, (w, h) in SIZES.items()], "image_id long, width int, height int")


def mirror(i, n):
    while not 0 <= i < n:
        i = -i - 1 if i < 0 else 2 * n - 1 - i
    return i


def at(img, y, x):
    return img[mirror(y, len(img))][mirror(x, len(img[0]))]


def found(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = tuple(r[c] for c in columns)
    return out


def near(got, want):
    assert got.keys() == want.keys()
    for i, img in want.items():
        assert got[i].keys() == {(y, x) for y, row in enumerate(img) for x in range(len(row))}
        for (y, x), v in got[i].items():
            assert max(abs(a - b) for a, b in zip(v, img[y][x])) < 1e-9, (i, y, x)


@pytest.mark.parametrize("tile", [3, 8, 256])
def test_smoothing(images, tile):
    data, df, sizes = images
    a, b = stencils.SMOOTH
    want = {}
    for i, img in data.items():
        want[i] = [[[(at(img, y, x)[c] + a * sum(at(img, y + p, x + q)[c] for p, q in ((0, 1), (1, 0), (0, -1), (-1, 0))) + b * sum(at(img, y + p, x + q)[c] for p in (-1, 1) for q in (-1, 1))) / (1 + 4 * (a + b)) for c in range(3)] for x in range(len(img[0]))] for y in range(len(img))]
    near(found(stencils.smoothed(df, sizes, ("r", "g", "b"), tile=tile), *"rgb"), want)


def one_pass(img, step, sigma, scales):
    channels = range(len(scales))
    cross = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    taps = [(p, q) for p in range(-2, 3) for q in range(-2, 3) if 0 < abs(p) + abs(q) <= (2 if step == 0 else 1)]
    compared = [(0, 0)] if step == 2 else cross
    out = []
    for y in range(len(img)):
        out.append([])
        for x in range(len(img[0])):
            factor = 1.65 * 4 * (1 - 0.5**0.5) * (0.9, 1, 6.5)[step] / sigma * (2 / 3 if y % 8 in (0, 7) or x % 8 in (0, 7) else 1)
            weight, total = 1.0, list(img[y][x])
            for p, q in taps:
                apart = sum(scales[c] * abs(at(img, y + m, x + n)[c] - at(img, y + p + m, x + q + n)[c]) for m, n in compared for c in channels)
                w = max(0.0, 1 - apart * factor)
                weight += w
                total = [t + w * at(img, y + p, x + q)[c] for c, t in enumerate(total)]
            out[-1].append([t / weight for t in total])
    return out


@pytest.mark.parametrize("step, tile", [(0, 4), (0, 256), (1, 3), (1, 8), (2, 2), (2, 5)])
def test_passes(images, step, tile):
    data, df, sizes = images
    got = stencils.edge_preserving_pass(df, sizes, ("r", "g", "b"), step, 9.0, tile)
    near(found(got, *"rgb"), {i: one_pass(img, step, 9.0, (40, 5, 3.5)) for i, img in data.items()})


def test_all_passes_and_one_channel(images):
    data, df, sizes = images
    got = stencils.edge_preserved(df, sizes, ("g",), 3, 20.0, 8)
    want = {i: [[(v[1],) for v in row] for row in img] for i, img in data.items()}
    for step in range(3):
        want = {i: one_pass(img, step, 20.0, (48.5,)) for i, img in want.items()}
    near(found(got, "g"), want)
    same = stencils.edge_preserved(df, sizes, ("g",), 1, 0.2)
    near(found(same, "g"), {i: [[(v[1],) for v in row] for row in img] for i, img in data.items()})


@pytest.mark.parametrize("batch", [7, 10_000])
def test_tiles_go_on_over_batches_and_pieces(spark, batch):
    df = spark.range(2 * 70 * 45).selectExpr("id % 2 image_id", "cast(id div 2 div 70 as int) y", "cast(id div 2 % 70 as int) x", "rand(3) g").unionByName(spark.sql("SELECT CAST(NULL AS LONG) image_id, 0 y, 0 x, 1d g"))
    data = {i: [[None] * 70 for _ in range(45)] for i in range(2)}
    for r in df.where("image_id is not null").collect():
        data[r.image_id][r.y][r.x] = (r.g,)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = stencils.edge_preserving_pass(df, spark.createDataFrame([(i, 70, 45) for i in range(2)], "image_id long, width int, height int"), ("g",), 1, 9.0, 64)
        near(found(got, "g"), {i: one_pass(img, 1, 9.0, (48.5,)) for i, img in data.items()})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pixels_of_a_tile_travel_as_one_row(images):
    _, df, _ = images
    made = stencils.tile_pieces(df.coalesce(1), ("r", "g", "b"), 1, 8)
    # one batch: a row for each tile, those beyond an edge too
    assert made.count() == made.select("image_id", "ty", "tx").distinct().count() < df.count() // 8
