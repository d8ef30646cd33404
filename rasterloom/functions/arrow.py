"""Runs of equal keys in sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def key_columns(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(keys)], 1)


def grouped(batches, keys: int):
    """(batch, keys, starts) of whole runs of rows that share their first `keys` columns (integers, sorted, not null); starts ends with the number of rows.

    Of what has come only the last run is held back, so memory follows the largest run and the size of a batch.
    """
    held: list[pa.RecordBatch] = []
    last = None

    def ready(parts):
        one = pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]
        k = key_columns(one, keys)
        return one, k, np.r_[np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)]), len(k)]

    for b in batches:
        if not b.num_rows:
            continue
        k = key_columns(b, keys)
        other = np.flatnonzero((k != k[-1]).any(1))
        at = int(other[-1]) + 1 if len(other) else 0
        if at:
            yield ready([*held, b.slice(0, at)])
            held = []
        elif held and (last != k[-1]).any():
            yield ready(held)
            held = []
        held.append(b.slice(at))
        last = k[-1]
    if held:
        yield ready(held)
