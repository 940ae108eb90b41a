"""Helpers for operators that stream Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables in which no group of ``key`` is cut, from batches sorted by ``key``.

    Batches are joined until they hold ``least_rows`` rows and the key changes;
    only the last, unfinished group is carried over.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key)
        last = keys[len(keys) - 1]
        cut = pc.index(keys, last).as_py()  # sorted: its first row
        if cut > 0:
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
            least = least_rows
        else:
            least = 2 * rows
        if rows >= least_rows:
            least_rows = max(least_rows, least)
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal neighbours."""
    if not len(keys):
        return
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(keys)]
    yield from zip(bounds, bounds[1:])


def flat_floats(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column; a null list has no values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
