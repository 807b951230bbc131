"""What the operators of this subpackage share: document keys, scratch tables, Arrow text access, hashing."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.scratch import materialise

LAST_ID = 2**63 - 1


# ---------------------------------------------------------------- tables

def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Most bytes of an Arrow batch between Spark and its Python workers, unless the session sets another than Spark's default.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def release() -> None:
    """Return what this process has freed to the system, as far as its allocators can (Arrow's, and the C library's on Linux)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def giving_back(run):
    """``run``, and ``release`` after it: a worker goes on to tasks of other steps, whose memory would come on top of what it holds unused."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with small batches: a worker and its executor each hold a batch or two at a time. The batch size is read when the query runs, and
    so it is set for the session and stays, unless the session has one of its own."""
    if df.sparkSession.conf.get(_BATCH, None) in (None, "67108864b", "64m", "64MB"):
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(giving_back(run), schema)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, texts)``: every row as ``(doc_id, k, text)`` (and ``rest`` if given), and of these one for each key.

    ``k`` orders documents. Where ids are unique and not null, ``k`` is the id. Otherwise ``k`` numbers, in order, the distinct
    ``(id, text)`` pairs by id (nulls last), ties by a hash of the text: rows that repeat both are the same
    document listed twice, rows that repeat only the id are two documents.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([] if rest is None else [rest.alias("rest")]))
    rows, repeats = with_key(base, "doc_id", ["text"])
    rows = rows.select("doc_id", "k", "text", *([] if rest is None else ["rest"]))
    return rows, rows.dropDuplicates(["k"]) if repeats else rows


def with_key(base: DataFrame, id_col: str, others: list[str]) -> tuple[DataFrame, bool]:
    """``base`` with the key ``k`` of ``keyed``, and whether keys may repeat: they do only where ids repeat."""
    n, known, distinct = base.agg(F.count(F.lit(1)), F.count(id_col), F.countDistinct(id_col)).first()
    if n == known == distinct:
        return base.withColumn("k", F.coalesce(id_col, F.lit(LAST_ID))), False
    hashed = base.withColumn("h", F.xxhash64(*others))
    ids = hashed.select(id_col, "h").distinct()
    # a range sort: numbers grow with the partition, and within it with the row
    ranked = ids.orderBy(F.col(id_col).asc_nulls_last(), "h").select(F.col(id_col).alias("id_"), F.col("h").alias("h_"), F.monotonically_increasing_id().alias("k"))
    ranked = materialise(ranked, "keys")
    return hashed.join(ranked, hashed[id_col].eqNullSafe(ranked.id_) & (hashed.h == ranked.h_)).drop("h", "id_", "h_"), True


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """``(row, k)``: every row whole as a struct, so that no column can clash, with the key that ``keyed`` gives it,
    and whether keys may repeat."""
    base = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, repeats = with_key(base, "doc_id", ["text"])
    return rows.select("row", "k"), repeats


# ---------------------------------------------------------------- Arrow

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column, and the n + 1 offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


# ---------------------------------------------------------------- hashing

_RNG = np.random.default_rng(20240101)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R and its inverse to the powers below n, modulo 2^64; kept for the next call up to a bounded length."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for r in (_R, _R_INV):
        p = np.full(n, r, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= 1 << 20:
        _POWERS[:] = made
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[t] * R^t over i <= t < j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(len(values) + 1)[0][:-1], out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    """64-bit hash of each span [start, stop) of the sequence whose prefix sums are ``p``."""
    return mix((p[stop] - p[start]) * _powers(len(p))[1][start])


def gram_hash(p: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k symbols."""
    n = len(p) - k
    return span_hash(p, slice(0, n), slice(k, n + k)) if n > 0 else np.zeros(0, np.uint64)


def sliding(op, h: np.ndarray, w: int) -> np.ndarray:
    """op (np.minimum or np.maximum) over every window of w values, by doubling."""
    have, m = 1, h
    while have * 2 <= w:
        m = op(m[:-have], m[have:])
        have *= 2
    return op(m[: len(m) - (w - have)], m[w - have :]) if have < w else m


def winnow(h: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Positions i whose value is the least of some window of w values that starts at s with valid[s].

    Which positions are taken within such a window depends on that window's values alone, so two equal stretches
    of text have equal anchors.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = np.where(valid[: len(h) - w + 1], sliding(np.minimum, h, w), np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero((sliding(np.maximum, padded, w) == h) & (h != 0))


# ---------------------------------------------------------------- words

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word [^\\x20\\x09-\\x0D]+, and the n + 1 offsets of each document's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    starts_here, ends_here = word.copy(), word.copy()
    starts_here[1:] &= ~word[:-1]
    ends_here[:-1] &= ~word[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts_here[edge] = word[edge]
    ends_here[edge - 1] = word[edge - 1]
    starts = np.flatnonzero(starts_here)
    return starts, np.flatnonzero(ends_here) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(BYTE[data]), starts, ends)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal runs (touching runs join)."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[new], hi[np.concatenate([new[1:] - 1, [len(hi) - 1]])]


def merged_by(group: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``merged`` within each group; groups come out in order."""
    if not len(lo):
        return group, lo, hi
    order = np.lexsort((lo, group))
    group, lo, hi = group[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    first = np.concatenate([[True], group[1:] != group[:-1]])
    shift = (np.cumsum(first) - 1) * (int(hi.max()) + 2)
    a, b = lo + shift, np.maximum.accumulate(hi + shift)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(b) - 1]])
    return group[new], lo[new], b[last] - shift[new]
