"""Vectors from an array column: which take part, and how they travel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: str) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An array column of vectors of one length as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def whole_keys(batches, most: int = 8 << 20):
    """Tables of whole values of the column ``key``, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            held.append(batch.slice(i, 2048))
            if sum(b.nbytes for b in held) < most:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield rows.slice(0, cut).combine_chunks()
            held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(key: np.ndarray):
    """(start, stop) of each run of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(0, int)
    return zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)
