"""Suffix-array dedup on bytes: shard Burrows-Wheeler transforms, merged by iterative interleave refinement.

Stretches that may repeat are laid out as rows of equal width, so that equal windows stand in equal columns (see
``repeats``). The suffixes that start in one column form a block of the transform of their own.

1. A task makes *shards* of the rows of its documents. It sorts a shard's suffixes column by column from the right (a
   stable partition by the character in front is one step of the transform) and keeps, for every column, the
   Burrows-Wheeler characters. Rows that are equal throughout are a repeated interval of the shard; one of them stays.
   The transforms leave the task as *cells*, one for each bucket of segments: a transform restricted to some of its
   rows keeps its order.
2. ``Merge`` merges the cells of a bucket, made by different tasks, without sorting their suffixes against each other.
   It keeps the interleave Z, the shard of each suffix in merged order, and refines it: reading every cell's characters in
   the order of Z gives the characters in front of the merged suffixes, and a stable partition of Z by them is the
   interleave one column further left. The lengths of common prefixes of neighbours follow in the same pass: one more
   than the least between them, or zero where the characters differ. Runs of neighbours with a common prefix of the
   window length or more are the repeated intervals: all but the first occurrence of such a run are cut out.
3. A bucket whose merged transform grows over ``LIMIT`` rows is split by columns and contents and goes another round: into parts that are
   narrow enough for all windows of one to share bytes, and those into halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm import repeats
from quaero.llm.common import BYTE, batch_of, blocks, in_batches, ints, materialise, merged_by, mix, prefix_sums, shuffle_partitions, span_hash, text_bytes
from quaero.llm.repeats import Rows, Unit

PAD = 0xFF  # in no UTF-8 text
#: Rows of a shard, and of cells that are merged at a time.
SHARD = 16_384
#: Different rows of a merged transform; beyond that its bucket is split. A merge holds up to twice SHARD more, below 2^16.
LIMIT = 24_576
#: Bytes of text for each bucket, and for each of the buckets that a part of an overfull one becomes.
PER_BUCKET = 2 << 20
PER_FAN = 64 << 20
SEED = 32
SEGMENT = 256
CELLS = "bucket long, k long, lo int, hi int, c0 int, c1 int, bwt binary, ks binary, starts binary, froms binary, tos binary"
_LOG = np.zeros(1 << 17, np.int8)
for _i in range(1, 17):
    _LOG[1 << _i :] = _i


def refine(chars: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable partition of merged suffixes by the characters in front of them, and the common prefixes of the new
    neighbours (``lcp[i]`` is between i - 1 and i): range minima of the old ones, from a table of powers of two."""
    n = len(chars)
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    out = np.zeros(n, np.int16)
    same = np.flatnonzero(c[1:] == c[:-1]) + 1
    if len(same):
        a, b = order[same - 1] + 1, order[same]
        level = _LOG[b - a + 1].astype(np.int64)
        table = np.empty((int(level.max()) + 1, n), np.int16)
        table[0] = lcp
        for i in range(1, len(table)):
            h = 1 << (i - 1)
            table[i, : n - h] = np.minimum(table[i - 1, : n - h], table[i - 1, h:])
        flat = table.ravel()
        out[same] = np.minimum(flat.take(level * n + a), flat.take(level * n + b - (1 << level) + 1)) + 1
    return order, out


def ranks(k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order of occurrences. Rows of one document at one place hold the same occurrences and rank alike."""
    order = np.lexsort((start, k))
    new = np.zeros(len(k), np.int64)
    new[1:] = (k[order][1:] != k[order][:-1]) | (start[order][1:] != start[order][:-1])
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(new)
    return out


class Cell:
    """A transform: ``bwt`` (columns, rows), and for its rows, in a fixed order, document key, place of column 0, and the
    columns that hold bytes."""

    def __init__(self, bwt: np.ndarray, k: np.ndarray, start: np.ndarray, from_: np.ndarray, to: np.ndarray):
        self.bwt, self.k, self.start, self.from_, self.to = bwt, k, start, from_, to

    def __len__(self) -> int:
        return len(self.k)

    def row(self, bucket: int, c0: int, c1: int) -> tuple:
        return (bucket, c0, c1, pa.compress(self.bwt.tobytes(), "zstd", asbytes=True), self.k.tobytes(), self.start.tobytes(), self.from_.tobytes(), self.to.tobytes())


class Merge:
    """The merge of cells. ``hits``: rows and the columns where a window starts that repeats an earlier one; ``copies``:
    rows equal to an earlier one; ``orders[c]``: rows by the suffix after column c; ``bwt[c]``: the characters at c in that order."""

    def __init__(self, cells: list[Cell], width: int, window: int):
        self.width, self.window = width, window
        self.k, self.start, self.from_, self.to = (np.concatenate([getattr(c, x) for c in cells]) for x in ("k", "start", "from_", "to"))
        n = len(self.k)
        z = np.repeat(np.arange(len(cells), dtype=np.uint16), [len(c) for c in cells])
        row, lcp = np.arange(n, dtype=np.uint16), np.zeros(n, np.int16)
        rank = ranks(self.k, self.start)
        # the shards' characters, each column of which becomes the merged one when it is reached
        self.bwt, self.orders = np.concatenate([c.bwt for c in cells], axis=1), np.empty((width, n), np.uint16)
        self.hit = np.zeros((n, width - window + 1), bool)
        one = len(cells) == 1
        for c in range(width - 1, -1, -1):
            chars = self.bwt[c]
            if not one:
                chars = np.empty(n, np.uint8)
                chars[np.argsort(z, kind="stable")] = self.bwt[c]
            self.bwt[c], self.orders[c] = chars, row
            order, lcp = refine(chars, lcp)
            row = row[order]
            if not one:
                z = z[order]
            if c + window <= width:
                self._intervals(c, row, lcp, rank)
        equal = lcp == width
        new = np.flatnonzero(~equal)
        least = np.minimum.reduceat(rank[row], new)[np.cumsum(~equal) - 1] if n else rank
        self.copies = np.zeros(n, bool)
        self.copies[row] = rank[row] > least

    def _intervals(self, c: int, row: np.ndarray, lcp: np.ndarray, rank: np.ndarray) -> None:
        long = lcp >= self.window
        if not long.any():
            return
        member = long.copy()
        member[:-1] |= long[1:]
        at = np.flatnonzero(member)
        rows, new = row[at], ~long[at]
        least = np.minimum.reduceat(rank[rows], np.flatnonzero(new))[np.cumsum(new) - 1]
        # one of equal windows holds padding only if all do
        later = rows[(rank[rows] > least) & (self.from_[rows] <= c) & (c + self.window <= self.to[rows])]
        self.hit[later, c] = True

    def stretches(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``k, lo, hi`` that the windows found in ``rows`` cover."""
        hit = np.zeros((len(rows), self.hit.shape[1] + 2), np.int8)
        hit[:, 1:-1] = self.hit[rows]
        step = np.diff(hit, axis=1)
        (i, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
        own = rows[i]
        return merged_by(self.k[own], self.start[own] + a, self.start[own] + b - 1 + self.window)

    def strings(self) -> np.ndarray:
        """The rows' bytes, (columns, rows)."""
        out = np.empty_like(self.bwt)
        for c in range(self.width):
            out[c][self.orders[c]] = self.bwt[c]
        return out

    def cells(self, rows: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, Cell]]:
        """The transform of some rows (a mask), one cell for each of their buckets."""
        numbers, code = np.unique(bucket[rows], return_inverse=True)
        of = np.zeros(len(rows), np.uint16)
        of[rows] = code
        kept = int(rows.sum())
        of[~rows] = len(numbers)  # the last, which are cut off
        if len(numbers) < 256:
            of = of.astype(np.uint8)
        out = np.empty((self.width, kept), np.uint8)
        for c in range(self.width):
            by = np.argsort(of[self.orders[c]], kind="stable")
            out[c] = self.bwt[c][by[:kept]]
        order = np.flatnonzero(rows)[np.argsort(code, kind="stable")]
        ends = np.cumsum(np.bincount(code, minlength=len(numbers)))
        for b, i, j in zip(numbers.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            own = order[i:j]
            yield b, Cell(np.ascontiguousarray(out[:, i:j]), self.k[own], self.start[own], self.from_[own], self.to[own])


def laid_out(data: np.ndarray, first: np.ndarray, from_: np.ndarray, to: np.ndarray, width: int) -> np.ndarray:
    """Rows as strings (columns, rows): column c holds ``data[first + c]`` where from_ <= c < to. Column by column, as places take eight times the room of bytes."""
    out = np.full((width, len(first)), PAD, np.uint8)
    for c in range(width):
        own = np.flatnonzero((from_ <= c) & (c < to))
        out[c, own] = data[first[own] + c]
    return out


def shard(strings: np.ndarray, k: np.ndarray, start: np.ndarray, from_: np.ndarray, to: np.ndarray, window: int) -> Merge:
    """The transform of one shard, sorted from its strings (columns, rows): each column's characters as they are met."""
    made = Merge.__new__(Merge)
    width, n = strings.shape
    made.width, made.window, made.k, made.start, made.from_, made.to = width, window, k, start, from_, to
    made.bwt, made.orders = np.empty((width, n), np.uint8), np.empty((width, n), np.uint16)
    made.hit = np.zeros((n, width - window + 1), bool)
    row = np.arange(n, dtype=np.uint16)
    for c in range(width - 1, -1, -1):
        chars = strings[c][row]
        made.bwt[c], made.orders[c] = chars, row
        row = row[np.argsort(chars, kind="stable")]
    rank = ranks(k, start)
    made.copies = np.zeros(n, bool)
    if n:
        # rows that are equal throughout are neighbours now
        equal = np.arange(1, n)
        for column in strings:
            equal = equal[column[row[equal]] == column[row[equal - 1]]]
            if not len(equal):
                break
        new = np.ones(n, bool)
        new[equal] = False
        made.copies[row] = rank[row] > np.minimum.reduceat(rank[row], np.flatnonzero(new))[np.cumsum(new) - 1]
    return made


def _batch(stretches: tuple[np.ndarray, np.ndarray, np.ndarray], cells: list[tuple]) -> pa.RecordBatch:
    """Rows of the schema ``CELLS``: stretches have ``k, lo, hi``, cells the rest."""
    k, lo, hi = stretches
    n, m = len(k), len(cells)
    null = lambda kind, size: pa.nulls(size, kind)
    both = lambda a, b: pa.concat_arrays([a, b])
    columns = list(zip(*cells, strict=True)) if cells else [[] for _ in range(8)]
    spread = mix(k.view(np.uint64)).view(np.int64) if n else np.zeros(0, np.int64)
    return batch_of(
        bucket=both(pa.array(spread), pa.array(columns[0], pa.int64())), k=both(pa.array(k, pa.int64()), null(pa.int64(), m)),
        lo=both(pa.array(np.asarray(lo, np.int32)), null(pa.int32(), m)), hi=both(pa.array(np.asarray(hi, np.int32)), null(pa.int32(), m)),
        c0=both(null(pa.int32(), n), pa.array(columns[1], pa.int32())), c1=both(null(pa.int32(), n), pa.array(columns[2], pa.int32())),
        **{name: both(null(pa.binary(), n), pa.array(columns[3 + i], pa.binary())) for i, name in enumerate(("bwt", "ks", "starts", "froms", "tos"))},
    )


def _whole(made: Merge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows equal to an earlier one, as stretches: all their windows repeat."""
    i = np.flatnonzero(made.copies)
    return merged_by(made.k[i], made.start[i] + made.from_[i], made.start[i] + made.to[i])


def _shards(unit: Unit, buckets: int):
    """Documents with their repeated anchors to cells; copies within a shard as stretches."""

    def cut(data: np.ndarray, offs: np.ndarray, k: np.ndarray, rows: Rows) -> Iterator[pa.RecordBatch]:
        bucket = (mix(rows.key()) % np.uint64(buckets)).astype(np.int64)
        for a in range(0, len(rows.doc), SHARD):
            i = slice(a, a + SHARD)
            strings = laid_out(data, offs[rows.doc[i]] + rows.start[i], rows.from_[i], rows.to[i], unit.width)
            made = shard(strings, k[rows.doc[i]], rows.start[i].astype(np.int32), rows.from_[i].astype(np.int16), rows.to[i].astype(np.int16), unit.window)
            yield _batch(_whole(made), [cell.row(b, 0, unit.width - unit.window) for b, cell in made.cells(~made.copies, bucket[i])])
            del strings, made  # the next shard's would stand beside them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            doc, asked = repeats.lists(batch.column("asked"))
            k = ints(batch, "k")
            lo, ref, at = (asked.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "ref", "at"))
            for i, j in blocks(offs, 32 * repeats.BLOCK):
                own = slice(*np.searchsorted(doc, [i, j]))
                if own.start < own.stop:
                    here = offs[i : j + 1] - offs[i]
                    rows = repeats.align(unit, doc[own] - i, lo[own], ref[own], at[own], np.diff(here))
                    yield from cut(data[offs[i] : offs[j]], here, k[i:j], rows)

    return run


def _split(unit: Unit, made: Merge, bucket: int, c0: int, c1: int, fan: int) -> Iterator[pa.RecordBatch]:
    """The rows of an overfull bucket as cells of smaller buckets: ``fan`` for each part at first, as a merge costs some time however few its rows are,
    and then one for each content, so that in the end all rows are equal."""
    strings = made.strings()
    for a, b, core in repeats.parts(c0, c1, unit.window):
        rows = np.flatnonzero(~made.copies & (np.maximum(made.from_, a) <= np.minimum(made.to - unit.window, b)))
        if not len(rows):
            continue
        from_, to = np.maximum(made.from_[rows], a).astype(np.int16), np.minimum(made.to[rows], b + unit.window).astype(np.int16)
        own = strings[:, rows]
        for c in range(unit.width):
            own[c, (c < from_) | (c >= to)] = PAD
        key = np.full(len(rows), bucket, np.int64).view(np.uint64) ^ mix(np.array([a * 65_536 + b + 1], np.uint64))
        if core:
            own_core = np.ascontiguousarray(own[core[0] : core[1]].T).ravel()
            at = np.arange(len(rows)) * (core[1] - core[0])
            content = span_hash(prefix_sums(BYTE[own_core]), at, at + (core[1] - core[0]))
            key = key ^ (content if c1 - c0 < unit.window else mix(content % np.uint64(fan) + np.uint64(1)))
        part = shard(own, made.k[rows], made.start[rows], from_, to, unit.window)
        yield _batch(_whole(part), [cell.row(n, a, b) for n, cell in part.cells(~part.copies, key.view(np.int64))])


def _merged(unit: Unit, fan: int):
    """Rows sorted by bucket: cells to the repeated stretches of their bucket, or to cells of its parts if it is overfull."""

    def cell(batch: pa.RecordBatch, i: int) -> Cell:
        k, start, from_, to = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("ks", np.int64), ("starts", np.int32), ("froms", np.int16), ("tos", np.int16)))
        bwt = pa.decompress(batch.column("bwt")[i].as_py(), unit.width * len(k), "zstd", asbytes=True)
        return Cell(np.frombuffer(bwt, np.uint8).reshape(unit.width, len(k)), k, start, from_, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Cell] = []
        bucket = c0 = c1 = None
        merged = size = 0  # rows of the transform merged so far (the first of those held), and of all held
        over = False

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, merged, size, over
            if not held:
                return
            if last and size == 1 and not over:  # a row alone in its bucket repeats nothing
                held = []
                return
            made = Merge(held, unit.width, unit.window)
            own = np.flatnonzero(made.hit.any(axis=1))
            yield _batch(made.stretches(own), [])
            left = int((~made.copies).sum())
            over |= left > LIMIT
            if over and (left > LIMIT or last):
                yield from _split(unit, made, bucket, c0, c1, fan)
                held, merged = [], 0
            elif not last:
                held = [c for _, c in made.cells(~made.copies, np.zeros(len(made.k), np.int64))]
                merged = left
            size = merged

        for batch in batches:
            stretch = batch.column("k").is_valid().to_numpy(zero_copy_only=False)
            if stretch.any():
                s = batch.filter(pa.array(stretch))
                yield _batch((ints(s, "k"), ints(s, "lo"), ints(s, "hi")), [])
            numbers = ints(batch, "bucket")
            for i in np.flatnonzero(~stretch).tolist():
                if numbers[i] != bucket:
                    yield from flush(True)
                    held, merged, size, over = [], 0, 0, False
                    bucket, c0, c1 = int(numbers[i]), batch.column("c0")[i].as_py(), batch.column("c1")[i].as_py()
                found = cell(batch, i)
                held.append(found)
                size += len(found)
                if size >= merged + SHARD:
                    yield from flush(False)
        yield from flush(True)

    return run


def repeated(unit: Unit, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``k, lo, hi``: all repeated stretches."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = texts.join(asked.hint("merge"), "k").select("k", "text", "asked")
    cells, found = rows.transform(in_batches, _shards(unit, -(-total // PER_BUCKET) or 1), CELLS), None
    while True:
        # a number of partitions of its own: cells are small for the work they hold
        dealt = cells.repartition(shuffle_partitions(texts), "bucket").sortWithinPartitions("bucket")
        out = materialise(dealt.transform(in_batches, _merged(unit, 1 + total // PER_FAN), CELLS), "merged")
        part = out.filter("k IS NOT NULL").select("k", "lo", "hi")
        found = part if found is None else found.unionByName(part)
        cells = out.filter("k IS NULL")
        if cells.isEmpty():
            return found


def remove_repeats(docs: DataFrame, window: int = 100, seed: int = SEED, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts earlier: in a document with a smaller id,
    or further left in the same one. Overlaps count; strings are judged on the input and never cross documents.

    Returns, per row of ``docs``: ``doc_id, k`` (the order of documents), ``n_symbols`` (bytes), ``n_removed, n_spans``
    (maximal removed runs) and ``kept`` (the remaining bytes; with ``whole_characters`` less those of cut characters). A null text is empty.
    Null ids come after all others; rows that repeat an id and a text are one document listed twice (neither removes
    from the other), rows that repeat the id alone are two documents, ordered by a hash of the text. Texts shorter
    than a window lose nothing; an empty table gives no rows. Other columns play no part.
    """
    unit = Unit(False, window, seed, segment, True)
    return repeats.remove(unit, docs, lambda texts, asked: repeated(unit, texts, asked), id_col, text_col, whole_characters)


def rewrite(docs: DataFrame, window: int = 100) -> DataFrame:
    """``docs`` with its columns, ``text`` without its repeats and ``n_chars`` counted anew; every row stays."""
    rest = F.struct(F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row"), F.col("text").isNull().alias("null"))
    unit = Unit(False, window, SEED, SEGMENT, True)
    new = repeats.remove(unit, docs, lambda texts, asked: repeated(unit, texts, asked), "doc_id", "text", True, rest)
    text = F.when(~F.col("rest.null"), F.col("kept").cast("string"))
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return new.select(*(made.get(c, F.col(f"rest.row.`{c}`")).alias(c) for c in docs.columns))
