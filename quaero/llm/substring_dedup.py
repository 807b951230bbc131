"""Substring dedup by seed and extend, on words.

1. Documents are joined on winnowed anchors of ``seed`` words. Anchors of a document at one distance from their first
   occurrences form a row, which is sent with its words to the segment of the document where they occur first (see ``repeats``).
2. In a segment, each anchor's occurrences start as classes of equal seed words. They are extended word by word to the
   left and, apart from that, to the right: a class splits where the next words differ. What has become unique on a side
   is not extended further there.
3. An occurrence that agrees with one in a document with a smaller id in i words to the left and j to the right has a match of i + seed + j
   words. Matches below ``window`` words are dropped; the union of the others is the document's maximal repeats.

Words are told apart by their bytes. A row that is equal to one of an earlier document is a match as it stands and is
settled before it leaves its task. A segment with more than ``LIMIT`` different rows is split and goes another round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quaero.llm import repeats
from quaero.llm.common import BYTE, batch_of, blocks, in_batches, ints, materialise, merged_by, mix, prefix_sums, shuffle_partitions, span_hash, text_bytes, word_hashes, word_spans
from quaero.llm.repeats import Unit

#: Rows that are settled at a time, and different rows of a segment; beyond that it is split.
CHUNK = 4_096
LIMIT = 16_384
SEED = 16
SEGMENT = 64
ROWS = "key long, k long, start int, from_ int, to_ int, c0 int, c1 int, anchors binary, words binary, hi int"


def _names(values: np.ndarray | pa.Array) -> np.ndarray:
    """Small numbers for the values, equal for equal ones."""
    return (values if isinstance(values, pa.Array) else pa.array(values)).dictionary_encode().indices.to_numpy()


def _row_names(*columns: np.ndarray) -> np.ndarray:
    """Small numbers for the rows of several columns."""
    both = np.column_stack(columns).astype(np.int64)
    return pa.Array.from_buffers(pa.binary(both.shape[1] * 8), len(both), [None, pa.py_buffer(both.tobytes())]).dictionary_encode().indices.to_numpy()


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """The words lo to hi of each row, joined by single blanks."""
    size = hi - lo
    word = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
    length = ends[word] - starts[word] + 1
    stop = np.cumsum(length)
    at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts[word] - (stop - length), length)
    out = np.append(data, np.uint8(32))[np.minimum(at, len(data))]
    out[stop - 1] = 32
    bounds = np.concatenate([[0], np.concatenate([[0], stop])[np.cumsum(size)]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.tobytes())])


def _seed_rows(unit: Unit):
    """Documents with their repeated anchors to rows with words (hi null), and copies within a block as stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            doc, asked = repeats.lists(batch.column("asked"))
            k = ints(batch, "k")
            lo, ref, at = (asked.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "ref", "at"))
            for i, j in blocks(offs, 8 * repeats.BLOCK):
                own = slice(*np.searchsorted(doc, [i, j]))
                if own.start == own.stop:
                    continue
                part = data[offs[i] : offs[j]]
                starts, ends, words = word_spans(part, offs[i : j + 1] - offs[i])
                rows = repeats.align(unit, doc[own] - i, lo[own], ref[own], at[own], np.diff(words))
                text = _joined(part, starts, ends, words[rows.doc] + rows.start + rows.from_, words[rows.doc] + rows.start + rows.to)
                key = mix(rows.key()).view(np.int64)
                keys = k[i + rows.doc]
                same = _row_names(key, rows.from_, rows.to, _names(text))
                least = np.full(int(same.max()) + 1, 2**63 - 1)
                np.minimum.at(least, same, keys)
                copy = keys > least[same]
                g, a, b = merged_by(keys[copy], rows.start[copy] + rows.from_[copy], rows.start[copy] + rows.to[copy])
                first = np.flatnonzero(np.concatenate([[True], np.diff(rows.anchor[0]) > 0]))
                bounds = (np.append(first, len(rows.anchor[0])) * 2).astype(np.int32)
                anchors = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(rows.anchor[1].astype(np.uint16).tobytes())])
                rest = pa.array(~copy)
                yield _rows(key[~copy], keys[~copy], rows.start[~copy], rows.from_[~copy], rows.to[~copy], np.zeros((~copy).sum()), np.full((~copy).sum(), unit.width - unit.window), anchors.filter(rest), text.filter(rest))
                yield _stretches(g, a, b)

    return run


def _rows(key, k, start, from_, to, c0, c1, anchors: pa.Array, words: pa.Array) -> pa.RecordBatch:
    small = {n: np.asarray(x, np.int32) for n, x in (("start", start), ("from_", from_), ("to_", to), ("c0", c0), ("c1", c1))}
    return batch_of(key=key, k=k, **small, anchors=anchors, words=words, hi=pa.nulls(len(key), pa.int32()))


def _stretches(k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    n = len(k)
    none = {c: pa.nulls(n, t) for c, t in (("from_", pa.int32()), ("to_", pa.int32()), ("c0", pa.int32()), ("c1", pa.int32()), ("anchors", pa.binary()), ("words", pa.binary()))}
    return batch_of(key=mix(k.view(np.uint64)).view(np.int64) if n else k, k=k, start=np.asarray(lo, np.int32), **none, hi=np.asarray(hi, np.int32))


def extend(names: np.ndarray, group: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, order: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matches of seeds ``names[row, a:b]`` (below 0: no word) within their groups, extended both ways: for each extension
    to the left, the occurrences that with the rest to the right match one whose document comes earlier in ``order``, and
    where the match starts."""
    reach = window - (b - a)
    width = int((b - a).max())
    same = group.astype(np.int64)
    for i in range(width):
        word = np.where(i < b - a, names[row, np.minimum(a + i, names.shape[1] - 1)], 0)
        same = _names(same * (1 << 32) + word).astype(np.int64)

    def side(step: int) -> list[np.ndarray]:
        """Classes by the words next to the seed, 0, 1, ... of them; -1: there is no such word, or no other occurrence agrees."""
        found = [same]
        live = np.arange(len(row))
        now = same
        for i in range(int(reach.max())):
            c = (b[live] + i) if step > 0 else (a[live] - 1 - i)
            ok = (c >= 0) & (c < names.shape[1]) & (i < reach[live])
            live, now, c = live[ok], now[ok], c[ok]
            word = names[row[live], c]
            live, now, word = live[word >= 0], now[word >= 0], word[word >= 0]
            now = _names(now * (1 << 32) + word).astype(np.int64)
            several = np.bincount(now)[now] > 1 if len(now) else np.zeros(0, bool)
            live, now = live[several], now[several]
            all_ = np.full(len(row), -1, np.int64)
            all_[live] = now
            found.append(all_)
        return found

    left, right = side(-1), np.array(side(1))
    for i, l in enumerate(left):
        live = np.flatnonzero((i <= reach) & (l >= 0))
        r = right[reach[live] - i, live]
        live, r = live[r >= 0], r[r >= 0]
        if not len(live):
            continue
        both = _names(l[live] * (1 << 32) + r)
        least = np.full(int(both.max()) + 1, 2**62)
        np.minimum.at(least, both, order[row[live]])
        hit = live[order[row[live]] > least[both]]
        if len(hit):
            yield hit, a[hit] - i


def _settle(unit: Unit, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated stretches of whole segments' rows."""
    words = t["words"]
    split = pc.binary_length(words).to_numpy(zero_copy_only=False)
    n = len(split)
    tokens = pc.split_pattern(words.cast(pa.large_binary()), b" ") if n else None
    size = t["to"] - t["from"]
    flat = tokens.flatten().dictionary_encode().indices.to_numpy()
    # the last word is followed by a blank too, and so by one empty token
    at = np.arange(size.sum()) + np.repeat(np.cumsum(size + 1) - (size + 1) - (np.cumsum(size) - size), size)
    names = np.full((n, unit.width), -1, np.int64)
    names[np.repeat(np.arange(n), size), np.arange(size.sum()) + np.repeat(t["from"] - (np.cumsum(size) - size), size)] = flat[at]
    count = pc.binary_length(t["anchors"]).to_numpy(zero_copy_only=False) // 2
    col = np.frombuffer(b"".join(t["anchors"].to_pylist()), np.uint16).astype(np.int64)
    row = np.repeat(np.arange(n), count)
    whole = t["c1"][row] - t["c0"][row] >= unit.window  # else all windows of the rows share their middle: the seed
    one = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    a = np.where(whole, col, t["c1"][row])
    b = np.where(whole, col + unit.seed, t["c0"][row] + unit.window)
    inside = np.where(whole, (a >= t["from"][row]) & (b <= t["to"][row]), one)
    row, a, b = row[inside], a[inside], b[inside]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = _row_names(t["key"][row], a)
    order = np.unique(t["k"], return_inverse=True)[1]
    found = [(row[i], lo) for i, lo in extend(names, group, row, a, b, order, unit.window)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, lo = (np.concatenate(x) for x in zip(*found, strict=True))
    return merged_by(t["k"][own], t["start"][own] + lo, t["start"][own] + lo + unit.window)


def _split(unit: Unit, t: dict) -> pa.RecordBatch:
    """Rows of overfull segments, each as rows of smaller ones."""
    out = []
    for i, text in enumerate(t["words"].to_pylist()):
        words = text.split(b" ")[:-1]
        k, start, from_, to = (int(t[c][i]) for c in ("k", "start", "from", "to"))
        for a, b, core in repeats.halves(int(t["c0"][i]), int(t["c1"][i]), unit.window):
            lo, hi = max(from_, a), min(to, b + unit.window)
            if a > b or hi - lo < unit.window:
                continue
            key = np.array([t["key"][i]], np.int64).view(np.uint64) ^ mix(np.array([a * 65_536 + b + 1], np.uint64))
            if core:
                own = np.frombuffer(b" ".join(words[core[0] - from_ : core[1] - from_]), np.uint8)
                key = key ^ span_hash(prefix_sums(BYTE[own]), np.array([0]), np.array([len(own)]))
            out.append((int(key.view(np.int64)[0]), k, start, lo, hi, a, b, t["anchors"][i].as_py(), b"".join(w + b" " for w in words[lo - from_ : hi - from_])))
    columns = list(zip(*out, strict=True)) if out else [[] for _ in range(9)]
    return _rows(np.array(columns[0], np.int64), np.array(columns[1], np.int64), *columns[2:7], pa.array(columns[7], pa.binary()), pa.array(columns[8], pa.binary()))


def _extended(unit: Unit):
    """Rows sorted by key, columns, words and document: to stretches, and rows of overfull segments to those of their parts."""

    def table(batch: pa.Table) -> dict:
        names = {"from_": "from", "to_": "to"}
        t = {names.get(c, c): batch.column(c).to_numpy() for c in ("key", "k", "start", "from_", "to_", "c0", "c1")}
        return {c: x if c in ("key", "k") else x.astype(np.int64) for c, x in t.items()} | {c: batch.column(c).combine_chunks() for c in ("words", "anchors")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        over = first = None  # the segment that is being split; the row that the next may equal
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(at, CHUNK)
                ready = rows.column("hi").is_valid()
                if pc.any(ready).as_py():
                    s = rows.filter(ready)
                    yield _stretches(ints(s, "k"), ints(s, "start"), ints(s, "hi"))
                    rows = rows.filter(pc.invert(ready))
                if not rows.num_rows:
                    continue
                copy, more, first = _copies(rows, first)
                if copy.any():
                    s = rows.filter(pa.array(copy))
                    k, start, from_, to = (ints(s, c).astype(np.int64) for c in ("k", "start", "from_", "to_"))
                    yield _stretches(*merged_by(k, start + from_, start + to))
                rows = rows.filter(pa.array(~copy & ~more))
                held.append(rows)
                size += rows.num_rows
                if size < CHUNK:
                    continue
                all_ = pa.Table.from_batches(held)
                key = all_.column("key").to_numpy()
                if over is not None:
                    end = int(np.searchsorted(key, over, side="right"))
                    if end:
                        yield _split(unit, table(all_.slice(0, end)))
                    all_, key = all_.slice(end), key[end:]
                    over = None if len(key) else over
                cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may run on
                if cut:
                    yield _stretches(*_settle(unit, table(all_.slice(0, cut))))
                if len(key) - cut > LIMIT:
                    over = int(key[-1])
                    yield _split(unit, table(all_.slice(cut)))
                    cut = len(key)
                held = all_.slice(cut).combine_chunks().to_batches()
                size = sum(b.num_rows for b in held)
        if held:
            all_ = pa.Table.from_batches(held)
            end = 0 if over is None else int(np.searchsorted(all_.column("key").to_numpy(), over, side="right"))
            if end:
                yield _split(unit, table(all_.slice(0, end)))
            if end < all_.num_rows:
                yield _stretches(*_settle(unit, table(all_.slice(end))))

    return run


def _copies(rows: pa.RecordBatch, first: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Among sorted rows: which equal one of an earlier document; which add nothing to one of the same document, as their
    segment has been split down to one window; and the first of the equal rows that the last one belongs to."""
    key, from_, to = (ints(rows, c) for c in ("key", "from_", "to_"))
    words, k = rows.column("words"), ints(rows, "k")
    new = np.ones(len(k), bool)
    same = pc.equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False) if len(k) > 1 else np.zeros(0, bool)
    new[1:] = ~same | (key[1:] != key[:-1]) | (from_[1:] != from_[:-1]) | (to[1:] != to[:-1])
    if first is not None and first[:4] == (int(key[0]), int(from_[0]), int(to[0]), words[0].as_py()):
        new[0] = False
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
    least = np.where(head >= 0, k[np.maximum(head, 0)], first[4] if first else 0)
    more = ~new & (k == least) & (ints(rows, "c0") == ints(rows, "c1"))
    return ~new & (k > least), more, (int(key[-1]), int(from_[-1]), int(to[-1]), words[-1].as_py(), int(least[-1]))


def repeated(unit: Unit, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``k, lo, hi``: all repeated stretches."""
    rows = texts.join(asked.hint("merge"), "k").select("k", "text", "asked")
    rows, found = rows.transform(in_batches, _seed_rows(unit), ROWS), None
    while True:
        rows = rows.repartition(shuffle_partitions(texts), "key").sortWithinPartitions("key", "from_", "to_", "words", "k", "start")
        out = materialise(rows.transform(in_batches, _extended(unit), ROWS), "extended")
        part = out.filter("hi IS NOT NULL").selectExpr("k", "start AS lo", "hi")
        found = part if found is None else found.unionByName(part)
        rows = out.filter("hi IS NULL")
        if rows.isEmpty():
            return found


def remove_repeats(docs: DataFrame, window: int = 50, seed: int = SEED, segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. Returns, per row of ``docs``:
    ``doc_id, k`` (the order of documents: the id, or its rank where ids repeat or are null), ``n_symbols`` (words),
    ``n_removed, n_spans`` (maximal removed runs) and ``kept`` (kept words joined by one space, UTF-8 bytes).
    A null or empty text has no words. Null ids come after all others; rows that repeat an id and a text are one
    document listed twice (neither removes from the other), rows that repeat the id alone are two documents, ordered
    by a hash of the text. Texts shorter than a window lose nothing. Other columns play no part.
    """
    unit = Unit(True, window, seed, segment, False)
    return repeats.remove(unit, docs, lambda texts, asked: repeated(unit, texts, asked), id_col, text_col)
