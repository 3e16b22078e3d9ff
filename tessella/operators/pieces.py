"""Bytes of texts in pieces: single bytes, differences by even and odd places, and the way back.

A piece is a row (image_id, n, at, piece): bytes from place ``at`` on of a text of ``n`` bytes.
Work is done on pieces, of a kilobyte at most, and only a result has a row for each byte; a
large text spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pieces whose bytes go out together.
TOGETHER = 256


def _id_type(pieces: DataFrame) -> str:
    return pieces.schema["image_id"].dataType.simpleString()


def _rows(pieces: DataFrame, place: Callable[[dict], np.ndarray], value: Callable[[dict], np.ndarray]) -> DataFrame:
    """image_id, x, v with a row for each byte; place and value give the bytes' places and values from a piece's columns."""
    names = [c for c in pieces.columns if c != "image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                rows = [dict(zip(names, values)) for values in zip(*(part.column(c).to_pylist() for c in names))]
                x, v = [place(r) for r in rows], [value(r) for r in rows]
                image = part.column("image_id").take(pa.array(np.repeat(np.arange(len(rows)), [len(one) for one in v])))
                yield pa.RecordBatch.from_arrays([image, pa.array(np.concatenate(x).astype(np.int32)), pa.array(np.concatenate(v).astype(np.int32))], names=["image_id", "x", "v"])

    return pieces.mapInArrow(run, f"image_id {_id_type(pieces)}, x int, v int")


def _bytes(r: dict) -> np.ndarray:
    return np.frombuffer(r["piece"], np.uint8)


def single_bytes(pieces: DataFrame) -> DataFrame:
    """image_id, x, v: the bytes of pieces and their places."""
    return _rows(pieces.select("image_id", "at", "piece"), lambda r: np.arange(r["at"], r["at"] + len(r["piece"])), _bytes)


def differences(pieces: DataFrame) -> DataFrame:
    """Even bytes of each text, then odd ones, each less the one before it and 128, modulo 256; the first one as it is.

    Takes pieces with two bytes ahead of them but for the first, which start at even places, and
    ``last_even``, the text's last byte at an even place. Gives pieces in the new order: all of it
    is arithmetic on places, as the byte before is two back in the text.
    """

    def halves(r: dict) -> Iterator[tuple[int, bytes]]:
        v = _bytes(r)
        off = v[2:] - v[:-2] + np.uint8(128)
        if r["at"] == 0:
            off = np.concatenate([v[:1], v[1:2] - _bytes({"piece": r["last_even"]}) + np.uint8(128), off])
        yield r["at"] // 2, off[::2].tobytes()
        if len(off) > 1:
            yield (r["n"] + 1) // 2 + r["at"] // 2, off[1::2].tobytes()

    names = ["n", "at", "last_even", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(names, values)) for values in zip(*(batch.column(c).to_pylist() for c in names))]
            made = [(i, r["n"], *half) for i, r in enumerate(rows) for half in halves(r)]
            i, n, at, piece = zip(*made) if made else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("image_id").take(pa.array(i, pa.int64())), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(piece, pa.binary())], names=["image_id", "n", "at", "piece"])

    return pieces.select("image_id", *names).mapInArrow(run, f"image_id {_id_type(pieces)}, n int, at int, piece binary")


def _steps(r: dict) -> np.ndarray:
    """What each byte adds to the one before it, modulo 256."""
    steps = _bytes(r) - np.uint8(128)
    if r["at"] == 0:
        steps[0] += np.uint8(128)
    return steps


def undone(pieces: DataFrame) -> DataFrame:
    """image_id, x, v: the bytes of texts again from pieces of ``differences``.

    Running sums within pieces, and sums of the pieces before: a window sees one number a
    piece. Then even and odd places are woven together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [int(_steps({"at": at, "piece": piece}).sum()) % 256 for at, piece in zip(batch.column("at").to_pylist(), batch.column("piece").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("at"), pa.array(totals, pa.int32())], names=["image_id", "at", "sum"])

    sums = pieces.select("image_id", "at", "piece").mapInArrow(run, f"image_id {_id_type(pieces)}, at int, sum int")
    up_to = Window.partitionBy("image_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("image_id", "at", ((F.sum("sum").over(up_to) - F.col("sum")) % 256).cast("int").alias("before"))
    both = pieces.join(sums.hint("merge"), (pieces["image_id"].eqNullSafe(sums["image_id"])) & (pieces["at"] == sums["at"])).select(pieces["image_id"], "n", pieces["at"], "piece", "before")

    def place(r: dict) -> np.ndarray:
        half = (r["n"] + 1) // 2
        at = np.arange(r["at"], r["at"] + len(r["piece"]))
        return at * 2 if r["at"] < half else (at - half) * 2 + 1

    return _rows(both, place, lambda r: np.cumsum(_steps(r), dtype=np.uint8) + np.uint8(r["before"]))
