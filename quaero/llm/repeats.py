"""Repeated windows of a sequence of symbols (bytes or words): the stages that two operators share.

A window is ``window`` consecutive symbols of one document. Its *anchor* is the seed of ``seed`` symbols whose hash is
least within it; equal windows have equal anchors at equal places. So only stretches around an anchor that occurs
more than once can hold a repeated window. Hashes only choose the stretches to look at; each operator settles what
repeats from the symbols themselves.

1. ``aligned``: the anchors of every document; those that occur more than once get the place of their first occurrence,
   the *reference*, from a window over the anchor's hash.
2. ``align``: anchors of a document that stand at one distance from their references form one *row*, laid out in the
   columns of a segment of the reference document. Equal windows stand in the same columns of the same segment, so
   a document's text is sent about once and not once for each anchor.
3. The operator settles each segment's rows.
4. ``cut_out`` unites all repeated stretches of a document and cuts them out.

A segment with more different rows than a task should hold is split (``halves``): by the columns where windows start,
and by the symbols that all windows of such a range share. In the end a range is one window and its rows are equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.llm.common import BYTE, batch_of, blocks, gram_hash, in_batches, ints, keyed, prefix_sums, text_bytes, winnow, word_hashes, word_spans

#: Bytes of text that are handled at a time. A task's memory follows this, not the size of the Arrow batches it gets.
BLOCK = 1 << 18


@dataclass(frozen=True)
class Unit:
    """What counts as a symbol, how long windows, seeds and segments are, and whether a document may repeat itself."""

    words: bool
    window: int
    seed: int
    segment: int
    within: bool

    @property
    def reach(self) -> int:
        return self.window - self.seed

    @property
    def width(self) -> int:
        """Columns of a segment's rows: the reach of its first anchor, its own columns, the window of its last."""
        return self.reach + self.segment + self.window

    def symbols(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums over the symbols of a block, and the documents' offsets in symbols."""
        if not self.words:
            return prefix_sums(BYTE[data]), offs
        starts, ends, at = word_spans(data, offs)
        return prefix_sums(word_hashes(data, starts, ends)), at


def anchors(unit: Unit, p: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block's documents: document number, place in it, hash of the seed."""
    edge = np.zeros(len(p), np.int32)
    long_enough = np.flatnonzero(np.diff(offs) >= unit.window)
    np.add.at(edge, offs[long_enough], 1)
    np.add.at(edge, offs[long_enough + 1] - unit.window + 1, -1)
    h = gram_hash(p, unit.seed)
    at = winnow(h, unit.reach + 1, np.cumsum(edge) > 0)
    doc = np.searchsorted(offs, at, side="right") - 1
    return doc, at - offs[doc], h[at].view(np.int64)


def aligned(unit: Unit, texts: DataFrame) -> DataFrame:
    """``k, asked``: for each document with repeated anchors a list of ``lo`` (their place) and ``ref, at`` (the document
    and place of the first occurrence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = ints(batch, "k")
            data, offs = text_bytes(batch.column("text"))
            for i, j in blocks(offs, BLOCK):
                doc, place, key = anchors(unit, *unit.symbols(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                yield batch_of(key=key, k=k[i + doc], lo=place.astype(np.int32))

    found = texts.select("k", "text").transform(in_batches, run, "key long, k long, lo int")
    all_ = Window.partitionBy("key").orderBy("k", "lo").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.select("k", "lo", F.first("k").over(all_).alias("ref"), F.first("lo").over(all_).alias("at"), F.last("k").over(all_).alias("end"), F.count(F.lit(1)).over(all_).alias("c"))
    repeated = found.filter("c > 1" if unit.within else "ref < end")
    return repeated.groupBy("k").agg(F.collect_list(F.struct("lo", "ref", "at")).alias("asked"))


def lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Row number of each element of a list column, and the elements."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


@dataclass
class Rows:
    """Rows of segments: reference document and segment, own document (number), the place of column 0 in it, and the columns
    that hold symbols. ``anchor``: number of the row and column of every anchor."""

    ref: np.ndarray
    segment: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    from_: np.ndarray
    to: np.ndarray
    anchor: tuple[np.ndarray, np.ndarray]

    def key(self) -> np.ndarray:
        return self.ref.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.segment.astype(np.uint64)


def align(unit: Unit, doc: np.ndarray, lo: np.ndarray, ref: np.ndarray, at: np.ndarray, size: np.ndarray) -> Rows:
    """The rows of anchors; ``size``: symbols of each document. Rows come by document."""
    lo, at = lo.astype(np.int64), at.astype(np.int64)
    segment = at // unit.segment
    col = at - segment * unit.segment + unit.reach
    start = lo - col
    order = np.lexsort((col, start, segment, ref, doc))
    doc, ref, segment, start, col = (x[order] for x in (doc, ref, segment, start, col))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (ref[1:] != ref[:-1]) | (segment[1:] != segment[:-1]) | (start[1:] != start[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    doc_, start_ = doc[first], start[first]
    from_ = np.maximum(col[first] - unit.reach, -start_)
    to = np.minimum(col[last] + unit.window, size[doc_] - start_)
    return Rows(ref[first], segment[first], doc_, start_, from_, to, (np.cumsum(new) - 1, col))


def halves(c0: int, c1: int, window: int) -> list[tuple[int, int, tuple[int, int] | None]]:
    """A range of window starts in two, each with the columns that all its windows share, if any."""
    m = (c0 + c1) // 2
    return [(a, b, (b, a + window) if b - a < window else None) for a, b in ((c0, m), (m + 1, c1))]


def parts(c0: int, c1: int, window: int) -> list[tuple[int, int, tuple[int, int] | None]]:
    """The same with more parts at first, so that the windows of each share a third of their columns or more."""
    n = -(-(c1 - c0 + 1) // max(2 * window // 3, 1))
    if n <= 2:
        return halves(c0, c1, window)
    edges = [c0 + (c1 - c0 + 1) * i // n for i in range(n + 1)]
    return [(a, b - 1, (b - 1, a + window)) for a, b in zip(edges, edges[1:], strict=False)]


# ---------------------------------------------------------------- cutting out

def removed_mask(n: int, offs: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n symbols the stretches cover, clipped to their documents."""
    size = offs[doc + 1] - offs[doc]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, offs[doc] + np.clip(lo, 0, size), 1)
    np.add.at(edge, offs[doc] + np.clip(hi, 0, size), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_out(unit: Unit, rows: DataFrame, stretches: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, k, n_symbols, n_removed, n_spans, kept`` (bytes) for every row, and its ``rest`` if it has one;
    ``whole``: no part of a character stays."""
    carried = "rest" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            doc, list_ = lists(batch.column("cut"))
            lo, hi = (list_.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("lo", "hi"))
            for i, j in blocks(offs, BLOCK):
                own = slice(*np.searchsorted(doc, [i, j]))
                part, here = data[offs[i] : offs[j]].copy(), offs[i : j + 1] - offs[i]
                if unit.words:
                    starts, ends, at = word_spans(part, here)
                    gone = removed_mask(len(starts), at, doc[own] - i, lo[own], hi[own])
                    keep = np.zeros(len(part) + 1, np.int32)
                    np.add.at(keep, starts[~gone], 1)
                    np.add.at(keep, ends[~gone], -1)
                    keep = np.cumsum(keep) > 0
                    owner = np.searchsorted(at, np.flatnonzero(~gone), side="right") - 1
                    joined = ends[~gone][:-1][owner[1:] == owner[:-1]]  # a blank follows all but the last kept word
                    keep[joined] = True
                    part = np.append(part, np.uint8(32))
                    part[joined] = 32
                else:
                    at, gone = here, removed_mask(len(part), here, doc[own] - i, lo[own], hi[own])
                    kept_ = ~gone
                    if whole and gone.any():
                        char = np.cumsum((part & 0xC0) != 0x80)
                        kept_ = np.bincount(char[gone], minlength=int(char[-1]) + 1)[char] == 0
                    keep = np.append(kept_, False)
                    part = np.append(part, np.uint8(0))
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                edges = at[1:-1][at[1:-1] < len(gone)]
                first[edges] = gone[edges]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first, keep)]
                total = [s[at[1:]] - s[at[:-1]] for s in sums[:2]]
                ends_ = sums[2][here]
                kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends_.astype(np.int32).tobytes()), pa.py_buffer(part[keep].tobytes())])
                more = {"rest": batch.column("rest").slice(i, j - i)} if carried else {}
                yield batch_of(doc_id=batch.column("doc_id").slice(i, j - i), k=batch.column("k").slice(i, j - i), n_symbols=np.diff(at).astype(np.int64), n_removed=total[0].astype(np.int64), n_spans=total[1].astype(np.int64), kept=kept, **more)

    schema = T.StructType()
    for name, kind in (("doc_id", "long"), ("k", "long"), ("n_symbols", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary")):
        schema = schema.add(name, kind)
    if carried:
        schema = schema.add("rest", rows.schema["rest"].dataType)
    cuts = stretches.groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    # a sort-merge join at every size: a broadcast would hold what grows with the repeats
    return rows.join(cuts.hint("merge"), "k", "left").select(*rows.columns, "cut").transform(in_batches, run, schema)


def remove(unit: Unit, docs: DataFrame, repeated, id_col: str, text_col: str, whole: bool = False, rest: Column | None = None) -> DataFrame:
    """``cut_out`` of the stretches ``repeated(rows, asked)`` for ``docs``; with ``rest``, that struct of other columns comes along."""
    rows, texts = keyed(docs, id_col, text_col, rest)
    return cut_out(unit, rows, repeated(texts, aligned(unit, texts)), whole)
