"""Inverse predictors on random images: residuals are made here, pixel by pixel."""

import random

import pytest

from tessella.operators import lines, samples


def picture(r, w, h, channels):
    return [[tuple(r.choice((0, 255, r.randrange(256))) for _ in range(channels)) for _ in range(w)] for _ in range(h)]


def at(img, y, x, nothing):
    return img[y][x] if 0 <= y < len(img) and 0 <= x < len(img[0]) else nothing


def rows_of(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], {})[r[1], r[2]] = tuple(r)[3 : 3 + n]
    return out


def flat(images):
    return {i: {(y, x): v for y, row in enumerate(img) for x, v in enumerate(row)} for i, img in images.items()}


def test_png_filters_of_all_kinds(spark):
    r = random.Random(1)
    images = {i: picture(r, w, h, 4) for i, (w, h) in enumerate([(1, 1), (5, 7), (1, 9), (9, 2), (16, 12)])}
    rows = []
    for i, img in images.items():
        for y, row in enumerate(img):
            kind = (y + i) % 5
            for x, v in enumerate(row):
                a, b, c = (at(img, y + dy, x + dx, (0,) * 4) for dy, dx in ((0, -1), (-1, 0), (-1, -1)))
                guess = []
                for p, q, s in zip(a, b, c):
                    t = p + q - s
                    near = min((abs(t - p), 0, p), (abs(t - q), 1, q), (abs(t - s), 2, s))[2]
                    guess.append((0, p, q, (p + q) // 2, near)[kind])
                rows.append((i, y, x, kind, *((k - g) % 256 for k, g in zip(v, guess))))
    df = spark.createDataFrame(rows, "image_id int, y int, x int, filter int, r int, g int, b int, a int").repartition(4)
    assert rows_of(lines.png_restored(df), 4) == flat(images)


def test_predictors_of_all_modes(spark):
    r = random.Random(2)
    images = {i: picture(r, w, h, 4) for i, (w, h) in enumerate([(1, 1), (1, 6), (7, 1), (6, 5), (17, 16)])}
    clip = lambda v: min(255, max(0, v))
    each = lambda f, *v: tuple(f(*c) for c in zip(*v))
    half = lambda a, b: (a + b) // 2
    rows = []
    for i, img in images.items():
        w = len(img[0])
        for y, row in enumerate(img):
            for x, v in enumerate(row):
                mode = (3 * y + x // 4 + i) % 14
                left, up, corner = (at(img, y + dy, x + dx, None) for dy, dx in ((0, -1), (-1, 0), (-1, -1)))
                right = None if y == 0 else img[y - 1][x + 1] if x + 1 < w else row[0]
                if y == 0:
                    guess = left if x else (0, 0, 0, 255)
                elif x == 0:
                    guess = up
                else:
                    gap = lambda p, q: sum(abs(m - n) for m, n in zip(p, q))
                    mean = each(half, left, up)
                    guess = [
                        (0, 0, 0, 255), left, up, right, corner, each(half, each(half, left, right), up), each(half, left, corner), mean, each(half, corner, up), each(half, up, right),
                        each(half, each(half, left, corner), each(half, up, right)), left if gap(up, corner) < gap(left, corner) else up, each(lambda p, q, s: clip(p + q - s), left, up, corner),
                        each(lambda m, s: clip(m + int((m - s) / 2)), mean, corner),
                    ][mode]
                rows.append((i, y, x, mode, *((k - g) % 256 for k, g in zip(v, guess))))
    df = spark.createDataFrame(rows, "image_id int, y int, x int, mode int, r int, g int, b int, a int").repartition(4)
    assert rows_of(lines.block_restored(df), 4) == flat(images)


@pytest.mark.parametrize("kind", lines.ALPHA_FILTERS)
def test_alpha_planes(spark, kind):
    r = random.Random(3)
    images = {i: picture(r, w, h, 1) for i, (w, h) in enumerate([(1, 1), (6, 1), (1, 6), (8, 9)])}
    df = spark.createDataFrame([(i, y, x, v[0]) for i, img in images.items() for y, row in enumerate(img) for x, v in enumerate(row)], "image_id int, y int, x int, a int").repartition(3)
    residuals = lines.alpha_residuals(df, kind)
    got = rows_of(residuals, 1)
    for i, img in images.items():
        for y, row in enumerate(img):
            for x, (v,) in enumerate(row):
                left, up, corner = (at(img, y + dy, x + dx, (0,))[0] for dy, dx in ((0, -1), (-1, 0), (-1, -1)))
                guess = left if y == 0 else up if x == 0 else {"horizontal": left, "vertical": up, "gradient": min(255, max(0, left + up - corner))}[kind]
                assert got[i][y, x] == ((v - guess) % 256,)
    assert rows_of(lines.alpha_restored(residuals, kind), 1) == flat(images)


def plain_packets(data, longest=128):
    """Greedy from the left: repeats of three bytes or more, literals up to the next one."""

    def run(at):
        n = 1
        while n < longest and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        return n

    out, at = [], 0
    while at < len(data):
        n = run(at)
        if n >= 3:
            out.append((at, n, False))
            at += n
            continue
        start = at
        at += n
        while at < len(data) and run(at) < 3 and at - start + run(at) <= longest:
            at += run(at)
        out.append((start, at - start, True))
    return out


def test_byte_packets_of_wide_rows(spark):
    """Rows of up to 3,600 bytes, so that both limits are met."""
    r = random.Random(9)
    images = {}
    for i in range(6):
        w = r.choice((1, 40, 300, 900))
        images[i] = [[tuple(r.choice(((7,), range(256), (1, 2))[(i + y) % 3]) for _ in range(4)) for _ in range(w)] for y in range(3)]
    df = spark.createDataFrame([(i, y, x, *v) for i, img in images.items() for y, row in enumerate(img) for x, v in enumerate(row)], "image_id int, y int, x int, r int, g int, b int, a int").repartition(4)
    got = {}
    for k in samples.byte_packets(df).collect():
        got.setdefault((k.image_id, k.y), []).append((k.place, k.n, k.literal))
    want = {(i, y): plain_packets([c for v in row for c in v]) for i, img in images.items() for y, row in enumerate(img)}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert any(n == 128 and literal for v in want.values() for _, n, literal in v) and any(n == 128 and not literal for v in want.values() for _, n, literal in v)
