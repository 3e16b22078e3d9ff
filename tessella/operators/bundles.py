"""Pixels that travel in bundles: one row for those of a key that come together.

A row for each pixel costs a shuffle and a sort ten times what the pixel holds. A bundle has
the key and lists of places and values; any pixels of the key may be in it, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.operators.lines import TOGETHER, together

#: Pixels of a bundle, at most.
PIECE = 1024


def changes(*keys: np.ndarray) -> np.ndarray:
    """The places where a key differs from the one before it, the first one included."""
    differs = np.zeros(len(keys[0]), bool)
    differs[:1] = True
    for k in keys:
        differs[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(differs)


def bundled(keys: dict[str, pa.Array], columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Bundles of pixels by their keys, from a value a pixel each."""
    values = [k.to_numpy() for k in keys.values()]
    order = np.lexsort(values[::-1])
    starts = changes(*(v[order] for v in values))
    sizes = np.diff(np.append(starts, len(order)))
    if len(order) and sizes.max() > PIECE:
        starts = np.concatenate([np.arange(s, s + n, PIECE) for s, n in zip(starts.tolist(), sizes.tolist())])
    offsets, taken, first = pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(order), pa.array(order[starts])
    return pa.RecordBatch.from_arrays([*(k.take(first) for k in keys.values()), *(pa.ListArray.from_arrays(offsets, c.take(taken)) for c in columns.values())], names=[*keys, *columns])


def flat(table: pa.Table, column: str) -> np.ndarray:
    """The values of a column of lists."""
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def whole(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], column: str, pixels: int = TOGETHER) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Bundles of whole keys out of batches sorted by key, those of about ``pixels`` pixels or of one key together.

    With them the rows where each key starts, and the pixels of each row, told by ``column``.
    """
    kept = None
    for batch in chain(batches, (None,)):
        # the last key of a batch may go on in the next one
        table = kept if batch is None else pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
        if table is None or not len(table):
            continue
        starts = changes(*(table.column(c).to_numpy() for c in keys))
        bounds = np.append(starts, len(table))
        done = len(starts) if batch is None else len(starts) - 1
        sizes = pc.list_value_length(table.column(column)).to_numpy()
        for first, last in together(np.append(0, np.cumsum(sizes))[bounds[: done + 1]], pixels):
            begin, end = bounds[first], bounds[last]
            yield table.slice(begin, end - begin), starts[first:last] - begin, sizes[begin:end]
        kept = table.slice(starts[done]) if done < len(starts) else None
