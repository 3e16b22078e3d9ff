"""Block transforms and squeeze pyramids against plain loops."""

import math
import random

import pytest

from tessella.operators import pyramid, transforms

PLANE = "image_id long, y int, x int, v int"


def planes(seed, sizes, low=0, high=255):
    r = random.Random(seed)
    return {i: [[r.choice((low, high, r.randint(low, high), (3 * x + 2 * y) % 256 + low)) for x in range(w)] for y in range(h)] for i, (w, h) in enumerate(sizes)}


def frame(spark, images):
    return spark.createDataFrame([(i, y, x, v) for i, img in images.items() for y, row in enumerate(img) for x, v in enumerate(row)], PLANE).repartition(4)


def back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.y, r.x] = r.v
    return out


def flat(images):
    return {i: {(y, x): v for y, row in enumerate(img) for x, v in enumerate(row)} for i, img in images.items()}


@pytest.mark.parametrize("n", [2, 4, 8, 16])
def test_cosine_transform_and_back(spark, n):
    images = planes(n, [(n, n), (2 * n, n)])
    df = frame(spark, images)
    got = transforms.cosine(df, n)
    for i, found in back(got).items():
        for (y, x), v in found.items():
            by, u, bx, w = y // n * n, y % n, x // n * n, x % n
            norm = math.sqrt((1 if u == 0 else 2) * (1 if w == 0 else 2)) / n
            want = norm * sum(images[i][by + p][bx + q] * math.cos(math.pi * (2 * p + 1) * u / (2 * n)) * math.cos(math.pi * (2 * q + 1) * w / (2 * n)) for p in range(n) for q in range(n))
            assert abs(v - want) < 1e-8
    again = back(transforms.cosine_inverse(got, n))
    assert {i: {k: round(v) for k, v in p.items()} for i, p in again.items()} == flat(images)


def test_zigzag_turns_at_the_edges():
    assert transforms.zigzag(3) == [[0, 1, 5], [2, 4, 6], [3, 7, 8]]
    # fixed values: the first row and column of the published order for 8 by 8
    eight = transforms.zigzag(8)
    assert eight[0] == [0, 1, 5, 6, 14, 15, 27, 28] and [row[0] for row in eight] == [0, 2, 3, 9, 10, 20, 21, 35]


def test_quality_tables():
    assert transforms.quality_table(50) == [list(r) for r in transforms.LUMINANCE]
    assert transforms.quality_table(100) == [[1] * 8] * 8 and transforms.quality_table(1)[0][0] == 255
    with pytest.raises(ValueError, match="quality"):
        transforms.quality_table(0)


def test_quantised_and_back(spark):
    images = planes(4, [(8, 8), (16, 8)])
    df, table = frame(spark, images), transforms.quality_table(100)
    q = transforms.quantised(transforms.cosine(df), table)
    assert q.where("q = 0 or place < 0 or place > 63").count() == 0
    near = back(transforms.cosine_inverse(transforms.dequantised(q, table)))
    assert max(abs(near[i][k] - v) for i, p in flat(images).items() for k, v in p.items()) < 4.01


def mul(v, c):
    return (v * c) >> 16


def test_integer_transforms_by_loops(spark):
    images = planes(6, [(4, 4), (8, 8), (12, 4)], -255, 255)
    df = transforms.gathered4(frame(spark, images))
    assert back(transforms.spread4(df)) == flat(images)
    forward, inverse = back(transforms.spread4(transforms.residual_forward(df))), {}
    hadamard = back(transforms.spread4(transforms.hadamard_forward(df)))
    again = back(transforms.spread4(transforms.hadamard_inverse(transforms.hadamard_forward(df))))
    assert again.keys() == flat(images).keys()
    for i, img in images.items():
        for by in range(0, len(img), 4):
            for bx in range(0, len(img[0]), 4):
                s = [[img[by + y][bx + x] for x in range(4)] for y in range(4)]
                mid = []
                for a, b, c, d in s:
                    mid.append([8 * (a + b + c + d), ((b - c) * 2217 + (a - d) * 5352 + 1812) >> 9, 8 * (a + d - b - c), ((a - d) * 2217 - (b - c) * 5352 + 937) >> 9])
                for x in range(4):
                    a, b, c, d = (mid[y][x] for y in range(4))
                    want = [(a + b + c + d + 7) >> 4, (((b - c) * 2217 + (a - d) * 5352 + 12000) >> 16) + (a != d), (a + d - b - c + 7) >> 4, ((a - d) * 2217 - (b - c) * 5352 + 51000) >> 16]
                    assert [forward[i][by + y, bx + x] for y in range(4)] == want
                wht = [[a + c + b + d, a - c + b - d, a - c - b + d, a + c - b - d] for a, b, c, d in s]
                for x in range(4):
                    a, b, c, d = (wht[y][x] for y in range(4))
                    assert [hadamard[i][by + y, bx + x] for y in range(4)] == [(a + c + b + d) >> 1, (a - c + b - d) >> 1, (a - c - b + d) >> 1, (a + c - b - d) >> 1]
    inverse = back(transforms.spread4(transforms.residual_inverse(transforms.residual_forward(df))))
    assert max(abs(inverse[i][k] - v) for i, p in flat(images).items() for k, v in p.items()) <= 1
    # a block that holds one mean only comes back flat
    one = transforms.gathered4(spark.createDataFrame([(1, 0, 0, 80)], PLANE))
    assert set(back(transforms.spread4(transforms.residual_inverse(one)))[1].values()) == {10}


def plain_tendency(a, b, c):
    cut = lambda v: int(v / 12)
    if a >= b >= c:
        x = cut(4 * a - 3 * c - b + 6)
        x = 2 * (a - b) + 1 if x - x % 2 > 2 * (a - b) else x
        return 2 * (b - c) if x + x % 2 > 2 * (b - c) else x
    if a <= b <= c:
        x = cut(4 * a - 3 * c - b - 6)
        x = 2 * (a - b) - 1 if x + x % 2 < 2 * (a - b) else x
        return 2 * (b - c) if x - x % 2 < 2 * (b - c) else x
    return 0


def plain_step(line):
    """Means and rests of a line."""
    pairs = [line[i : i + 2] for i in range(0, len(line), 2)]
    means = [p[0] if len(p) == 1 else p[0] - int((p[0] - p[1]) / 2) for p in pairs]
    rests = []
    for i, p in enumerate(pairs):
        if len(p) == 2:
            before = line[2 * i - 1] if i else means[i]
            after = means[i + 1] if i + 1 < len(means) else means[i]
            rests.append(p[0] - p[1] - plain_tendency(before, means[i], after))
    return means, rests


def test_halves_by_loops(spark):
    images = planes(8, [(1, 1), (2, 3), (7, 4), (16, 5), (33, 2)], -40, 300)
    means, rests = (back(d) for d in pyramid.halved(frame(spark, images), "x"))
    for i, img in images.items():
        for y, line in enumerate(img):
            m, r = plain_step(line)
            assert [means[i][y, x] for x in range(len(m))] == m and [rests[i][y, x] for x in range(len(r))] == r


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_pyramids_are_lossless(spark, levels):
    images = planes(9, [(1, 1), (1, 9), (6, 1), (16, 16), (13, 7)], -300, 300)
    df = frame(spark, images)
    made = pyramid.squeezed(df, levels)
    assert back(pyramid.unsqueezed(made, levels)) == flat(images)
    if levels == 5:
        small, _ = pyramid.halved(df, "x")
        assert back(pyramid.unsqueezed(made, levels, down_to=1)) == back(small)


@pytest.mark.parametrize("batch", [5, 10_000])
def test_bands_go_on_over_batches_and_pieces(spark, batch):
    images = planes(10, [(2500, 2), (3, 40), (11, 11)], -300, 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert back(pyramid.unsqueezed(pyramid.squeezed(frame(spark, images), 6), 6)) == flat(images)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_samples_of_lines_travel_as_one_row(spark):
    images = planes(11, [(16, 38), (5, 9)], 0, 255)
    made = pyramid.bundles(frame(spark, images).coalesce(1), "x")
    assert made.count() == 5 + 2 and {(r.image_id, y // 8) for r in made.collect() for y in r.y} == {(r.image_id, r.band) for r in made.collect()}
    made = pyramid.squeezed(frame(spark, images), 3)
    assert pyramid.samples(made).count() == sum(len(p) for p in flat(images).values())
