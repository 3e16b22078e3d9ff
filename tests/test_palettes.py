"""Median cut and error diffusion against plain versions that work on lists."""

import random

import pytest

from tessella.operators import palettes
from tessella.sources import rasters

PIXELS = "image_id long, y int, x int, r int, g int, b int, a int"


def over(v, a, matte=255):
    return v if a == 255 else (v * a + matte * (255 - a) + 127) // 255


def half_up(total, n):
    return (2 * total + n) // (2 * n)


def brute_palette(image, colours, threshold):
    """image: {(y, x): (r, g, b, a)}."""
    cells, clear = {}, False
    for r, g, b, a in image.values():
        if a < threshold:
            clear = True
            continue
        c = tuple(over(v, a) for v in (r, g, b))
        cells.setdefault(tuple(v >> 3 for v in c), []).append(c)
    boxes = [[(k, len(v), *(half_up(sum(c[i] for c in v), len(v)) for i in range(3))) for k, v in sorted(cells.items())]] if cells else []

    def spans(box):
        return [w * (max(c[i] for c in box) - min(c[i] for c in box)) for i, w in ((2, 3), (3, 4), (4, 2))]

    while boxes and len(boxes) < colours - clear:
        scores = [sum(c[1] for c in b) * sum(spans(b)) if len(b) > 1 else -1 for b in boxes]
        k = scores.index(max(scores))
        if scores[k] < 0:
            break
        red, green, blue = spans(boxes[k])
        by = 3 if green >= red and green >= blue else 2 if red >= blue else 4
        order = sorted(boxes[k], key=lambda c: (c[by], c[0]))
        half, so_far, at = sum(c[1] for c in order) // 2, 0, 1
        for i, c in enumerate(order[:-1]):
            so_far += c[1]
            if so_far >= half:
                at = i + 1
                break
        boxes[k] = order[:at]
        boxes.append(order[at:])
    means = [tuple(half_up(sum(c[i] * c[1] for c in b), sum(c[1] for c in b)) for i in (2, 3, 4)) + (255,) for b in boxes]
    return [(0, 0, 0, 0)] * clear + means


def brute_indices(image, palette, amount, threshold):
    known, errors, out = {}, {}, {}
    for (y, x), (r, g, b, a) in sorted(image.items()):
        if a < threshold:
            out[y, x] = 0
            continue
        e = errors.get((y, x), [0, 0, 0])
        now = [max(0, min(255, over(v, a) + (1 if d >= 0 else -1) * ((abs(d) + 8) // 16))) for v, d in zip((r, g, b), e)]
        cell = tuple(v >> 3 for v in now)
        if cell not in known:
            known[cell] = min((sum(w * (v - p) ** 2 for v, p, w in zip(now, c, (3, 4, 2))), i) for i, c in enumerate(palette) if c[3])[1]
        out[y, x] = known[cell]
        for c in range(3):
            d = now[c] - palette[known[cell]][c]
            d = (1 if d >= 0 else -1) * (abs(d) * amount // 100)
            for dy, dx, w in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                errors.setdefault((y + dy, x + dx), [0, 0, 0])[c] += d * w
    return out


def images(spark, sf_dir):
    r = random.Random(5)
    found = {}
    for row in rasters.lineitem_pixels(spark, sf_dir).where("image_id <= 3 and y < 24").collect():
        found.setdefault(row.image_id, {})[row.y, row.x] = (row.r, row.g, row.b, row.a)
    found[100] = {(y, x): (20 * x, 9 * y, 200 - 6 * x, 255) for y in range(20) for x in range(12)}
    found[101] = {(y, x): (7, 7, 7, 0) for y in range(3) for x in range(3)}
    found[102] = {(y, x): (r.randrange(256), 5, 5, r.choice((0, 127, 128, 200, 255))) for y in range(9) for x in range(7)}
    found[103] = {(0, 0): (1, 2, 3, 255)}
    return found


@pytest.fixture(scope="module")
def both(spark, sf_dir):
    found = images(spark, sf_dir)
    rows = [(i, y, x, *c) for i, image in found.items() for (y, x), c in image.items()]
    return found, spark.createDataFrame(rows, PIXELS).repartition(5)


def of(palette):
    out = {}
    for r in sorted(palette.collect()):
        out.setdefault(r.image_id, []).append((r.r, r.g, r.b, r.a))
    return out


@pytest.mark.parametrize("colours", [2, 7, 16, 256])
def test_palettes_match_a_plain_splitter(both, colours):
    found, df = both
    assert of(palettes.palettes(df, colours)) == {i: brute_palette(image, colours, 128) for i, image in found.items()}


def test_without_transparency_all_pixels_count(both):
    found, df = both
    assert of(palettes.palettes(df, 9, threshold=0)) == {i: brute_palette(image, 9, 0) for i, image in found.items()}


@pytest.mark.parametrize("amount", [0, 60, 100])
def test_indices_match_the_serial_rule(both, amount):
    found, df = both
    palette = palettes.palettes(df, 6)
    entries = of(palette)
    got = {}
    for r in palettes.dithered(df, palette, amount).collect():
        got.setdefault(r.image_id, {})[r.y, r.x] = r.entry
    assert got == {i: brute_indices(image, entries[i], amount, 128) for i, image in found.items()}


def test_limits_are_checked(both):
    for bad in (1, 257):
        with pytest.raises(ValueError, match="colours"):
            palettes.palettes(both[1], bad)
    with pytest.raises(ValueError, match="percent"):
        palettes.dithered(both[1], both[1], 101)
    empty = both[1].limit(0)
    assert palettes.dithered(empty, palettes.palettes(empty)).count() == 0
