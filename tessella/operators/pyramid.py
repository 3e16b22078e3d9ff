"""Squeeze pyramids: a plane halved along one axis after the other, with what is needed to go back.

A step along an axis turns pairs of samples into their mean and what their difference
exceeds the tendency of the means around by. Forward, a line is known at once; back, each
pair needs the sample restored before it, so a line is a fold. Lines of equal length go
through a step side by side, as numpy vectors, and lines of an image spread over tasks: a
step is one shuffle of bundles that hold the samples of a few lines (see bundles).

Planes are image_id, y, x, v. Levels count from the first step; a pyramid has image_id,
level, part ("mean" for the last level only, "rest" for each), band and lists of y, x, v;
``samples`` gives them a row each. Bands are of lines along the axis of the level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.bundles import bundled, changes, flat, whole

PLANE = "image_id long, y int, x int, v int"
BUNDLE = "image_id long, part int, band int, y array<int>, x array<int>, v array<int>"
AXES = ("x", "y")
#: Lines of a band: they are one group, so few.
BAND = 8
MEAN, REST = 0, 1


def _across(axis: str) -> str:
    return "y" if axis == "x" else "x"


def _tendency(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """How much a pair with mean b between a and c is expected to fall, 0 unless the three are in order."""
    to_zero = lambda top: np.where(top >= 0, top // 12, -(-top // 12))
    first, second = (a - b) * 2, (b - c) * 2
    fall = to_zero(a * 4 - c * 3 - b + 6)
    fall = np.where(fall - (fall & 1) > first, first + 1, fall)
    fall = np.where(fall + (fall & 1) > second, second, fall)
    rise = to_zero(a * 4 - c * 3 - b - 6)
    rise = np.where(rise + (rise & 1) < first, first - 1, rise)
    rise = np.where(rise - (rise & 1) < second, second, rise)
    return np.where((a >= b) & (b >= c), fall, np.where((a <= b) & (b <= c), rise, 0))


def _restored(means: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """Lines (rows) from their means and rests, place by place for all lines at once."""
    n = rests.shape[1]
    out = np.zeros((len(means), means.shape[1] + n), np.int64)
    before = None
    for i in range(n):
        mean = means[:, i]
        after = means[:, i + 1] if i + 1 < means.shape[1] else mean
        diff = rests[:, i] + _tendency(mean if before is None else before, mean, after)
        half = np.where(diff >= 0, diff >> 1, -(-diff >> 1))
        out[:, 2 * i], out[:, 2 * i + 1] = mean + half, mean + half - diff
        before = out[:, 2 * i + 1]
    if means.shape[1] > n:
        out[:, -1] = means[:, -1]
    return out


def _halves(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and rests of lines (rows). A last sample without a partner is its own mean and has no rest."""
    n = lines.shape[1] // 2
    a, b = lines[:, 0::2], lines[:, 1::2]
    diff = a[:, :n] - b
    means = a.copy()
    means[:, :n] -= np.where(diff >= 0, diff >> 1, -(-diff >> 1))
    before, after = means[:, :n].copy(), means[:, :n].copy()
    before[:, 1:] = b[:, : max(0, n - 1)]
    after[:, : means.shape[1] - 1] = means[:, 1 : n + 1]
    return means, diff - _tendency(before, means[:, :n], after)


def _bundles(axis: str, part: int, image: np.ndarray, places: dict[str, np.ndarray], v: np.ndarray) -> pa.RecordBatch:
    """Bundles of lines along an axis."""
    keys = {"image_id": pa.array(image), "part": pa.array(np.full(len(v), part, np.int32)), "band": pa.array((places[_across(axis)] // BAND).astype(np.int32))}
    return bundled(keys, {c: pa.array(places[c].astype(np.int32)) for c in "yx"} | {"v": pa.array(v.astype(np.int32))})


def bundles(plane: DataFrame, axis: str) -> DataFrame:
    """A plane as bundles of lines along an axis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image, y, x, v = (batch.column(c).to_numpy() for c in ("image_id", "y", "x", "v"))
            yield _bundles(axis, MEAN, image, {"y": y, "x": x}, v)

    rows = plane.where("image_id is not null").select(F.col("image_id").cast("long").alias("image_id"), *(F.col(c).cast("int").alias(c) for c in ("y", "x", "v")))
    return rows.mapInArrow(run, BUNDLE)


def stepped(parts: DataFrame, axis: str, step: Callable[[np.ndarray, np.ndarray], dict[int, np.ndarray]], then: dict[int, str | None]) -> DataFrame:
    """Bundles after a step over their lines along an axis; step(means, rests) of lines (rows) of equal length gives the lines of each part.

    then: the axis along which the lines of a part go on; None for rows of a plane.
    """
    across = _across(axis)

    def lines(table: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray], np.ndarray]]:
        image, part = table.column("image_id").to_numpy(), np.repeat(table.column("part").to_numpy(), sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        of = np.searchsorted(starts, row, "right")
        line, v = flat(table, across), flat(table, "v").astype(np.int64)
        order = np.lexsort((flat(table, axis), part, line, of))
        line, part, v, row = line[order], part[order], v[order], row[order]
        first = changes(of[order], line)
        # of a line, its means come first
        rests = np.add.reduceat(part, first)
        means = np.diff(np.append(first, len(line))) - rests
        for n, m in np.unique(np.stack([means, rests], axis=1), axis=0).tolist():
            at = first[(means == n) & (rests == m)]
            block = v[at[:, None] + np.arange(n + m)]
            for k, out in step(block[:, :n], block[:, n:]).items():
                size = out.shape[1]
                yield k, np.repeat(image[row[at]], size), {across: np.repeat(line[at], size), axis: np.tile(np.arange(size, dtype=np.int32), len(at))}, out.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bands in whole(batches, ("image_id", "band"), "v"):
            made: dict[int, list] = {}
            for k, *columns in lines(*bands):
                made.setdefault(k, []).append(columns)
            for k, all_ in made.items():
                image, v = (np.concatenate([c[i] for c in all_]) for i in (0, 2))
                places = {c: np.concatenate([o[1][c] for o in all_]) for c in "yx"}
                if then[k]:
                    yield _bundles(then[k], k, image, places, v)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(image), *(pa.array(c.astype(np.int32)) for c in (places["y"], places["x"], v))], names=["image_id", "y", "x", "v"])

    dealt = parts.repartition("image_id", "band").sortWithinPartitions("image_id", "band")
    return dealt.mapInArrow(run, PLANE if None in then.values() else BUNDLE)


def _halving(means: DataFrame, axis: str, then: str) -> DataFrame:
    """Both parts after a step; lines of the means go on along ``then``."""
    return stepped(means, axis, lambda v, _: dict(zip((MEAN, REST), _halves(v))), {MEAN: then, REST: axis})


def samples(pyramid: DataFrame) -> DataFrame:
    """A row for each sample, without lists."""
    return pyramid.selectExpr(*(c for c in pyramid.columns if c not in ("band", "y", "x", "v")), "inline(arrays_zip(y, x, v))")


def halved(plane: DataFrame, axis: str) -> tuple[DataFrame, DataFrame]:
    """Planes of means and rests along an axis."""
    both = samples(_halving(bundles(plane, axis), axis, axis))
    return tuple(both.where(F.col("part") == k).drop("part") for k in (MEAN, REST))


def squeezed(plane: DataFrame, levels: int) -> DataFrame:
    """The pyramid of a plane: halved along x, then y, and so on, ``levels`` times."""
    means, out = bundles(plane, AXES[0]), None
    named = lambda df, level, part: df.select("image_id", F.lit(level).alias("level"), F.lit(part).alias("part"), "band", "y", "x", "v")
    for level in range(levels):
        both = _halving(means, AXES[level % 2], AXES[min(level + 1, levels - 1) % 2])
        means, rest = both.where(F.col("part") == MEAN), named(both.where(F.col("part") == REST), level, "rest")
        out = rest if out is None else out.unionByName(rest)
    last = named(means, levels - 1, "mean")
    return last if out is None else out.unionByName(last)


def unsqueezed(pyramid: DataFrame, levels: int, down_to: int = 0) -> DataFrame:
    """The plane again, or the smaller one after ``down_to`` steps."""
    part = lambda name, k: pyramid.where(F.col("part") == name).select("image_id", F.lit(k).alias("part"), "band", "y", "x", "v", "level")
    means, rests = part("mean", MEAN).drop("level"), part("rest", REST)
    for level in reversed(range(down_to, levels)):
        both = means.unionByName(rests.where(F.col("level") == level).drop("level"))
        means = stepped(both, AXES[level % 2], lambda m, r: {MEAN: _restored(m, r)}, {MEAN: AXES[(level - 1) % 2] if level > down_to else None})
    return means if down_to < levels else samples(means).drop("part")
