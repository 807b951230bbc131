"""Fill-in-the-middle: each text is cut at two places and its parts change order, for a model to learn to fill gaps.

One numpy kernel handles all rows of an Arrow block on its UTF-8 buffer, without a loop over rows:

1. a lookup table gives every byte its class, and a mask of adjacent classes tells where a unit (a code point, a word or a
   line) starts; the start of a document always is one, so no unit crosses from one document into the next;
2. a cumulative sum numbers the units, and its value at a document's start sets the numbers of that document back to 0;
3. one ``searchsorted`` finds the byte positions of both cuts of all rows.

The parts are views of the same buffer by new offsets, joined with the marks in Arrow. Where the cuts fall is drawn from a
hash of the document's id, so a task that runs again makes the same output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import batch_of, blocks, in_batches, ints, text_bytes

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Units:
    """``classes`` holds the class of each byte; a unit starts between two bytes where ``starts[class before, class after]``."""

    classes: np.ndarray
    starts: np.ndarray


def _units(classes: dict[int, list[int]], starts: list[tuple[int, int]]) -> Units:
    of = np.zeros(256, np.uint8)
    for number, members in classes.items():
        of[members] = number
    table = np.zeros((3, 3), bool)
    for pair in starts:
        table[pair] = True
    return Units(of, table)


UNITS = {
    # before every byte that doesn't continue a code point
    "char": _units({1: list(range(0x80, 0xC0))}, [(0, 0), (1, 0)]),
    # where a word follows a blank: blanks belong to the word before them
    "word": _units({1: [9, 10, 11, 12, 13, 32]}, [(1, 0)]),
    # after a line feed
    "line": _units({1: [10]}, [(1, 0), (1, 1)]),
}


def numbered(data: np.ndarray, offs: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the number of units that have started by then, over all documents; and for each document that number
    before it (with the total at the end)."""
    starts = np.zeros(len(data), bool)
    of = units.classes[data]
    starts[1:] = units.starts[of[:-1], of[1:]]
    starts[offs[:-1][offs[:-1] < offs[1:]]] = True
    count = np.cumsum(starts, dtype=np.int32 if len(data) < 2**31 else np.int64)
    return count, np.concatenate([[0], count])[offs].astype(np.int64)


def cut_positions(count: np.ndarray, before: np.ndarray, offs: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Byte position behind the first ``units[i]`` units of document i, for all documents together."""
    at = np.searchsorted(count, (before[:-1] + units + 1).astype(count.dtype))
    return np.minimum(at, offs[1:])


def _parts(data: np.ndarray, offs: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each document, as texts over one buffer."""
    n = len(first)
    edges = np.empty(3 * n + 1, np.int64)
    edges[0:-1:3], edges[1::3], edges[2::3], edges[-1] = offs[:-1], first, second, offs[-1]
    pieces = pa.Array.from_buffers(pa.large_string(), 3 * n, [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return [pieces.take(pa.array(np.arange(i, 3 * n, 3))) for i in range(3)]


def rearrange(texts: pa.Array, h: np.ndarray, units: Units, marks: tuple[str, str, str], plain_percent: int, spm_percent: int) -> dict[str, pa.Array]:
    """Form, sizes and output of every text of a block; ``h`` holds four numbers for each."""
    data, offs = text_bytes(texts)
    data = np.ascontiguousarray(data)
    count, before = numbered(data, offs, units)
    n = np.diff(before)
    whole = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)])
    held = np.zeros(len(n), bool)
    for mark in marks:
        held |= pc.match_substring(whole, mark).to_numpy(zero_copy_only=False)
    plain = (offs[1:] == offs[:-1]) | held | (h[2] % 100 >= 100 - plain_percent)
    spm = ~plain & (h[3] % 100 < spm_percent)
    drawn = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    drawn = np.where(plain, n, drawn)  # a plain text is all prefix, without marks
    cuts = [cut_positions(count, before, offs, u) for u in drawn]
    prefix, middle, suffix = _parts(data, offs, *cuts)
    is_plain, is_spm, none = pa.array(plain), pa.array(spm), pa.scalar("", pa.large_string())
    p, s, m = (pa.scalar(x, pa.large_string()) for x in marks)
    pick = lambda a, b: pc.if_else(is_plain, none, pc.if_else(is_spm, a, b))
    joined = pc.binary_join_element_wise(pick(s, p), pc.if_else(is_spm, suffix, prefix), pick(p, s), pc.if_else(is_spm, prefix, suffix), pick(m, m), middle, none)
    return {
        "n": pa.array(n), "form": pc.if_else(is_plain, "plain", pc.if_else(is_spm, "spm", "psm")).cast(pa.string()),
        "prefix_units": pa.array(drawn[0], mask=plain), "middle_units": pa.array(drawn[1] - drawn[0], mask=plain), "output": joined.cast(pa.string()),
    }


def check_marks(marks: tuple[str, str, str]) -> None:
    """A mark must be found again wherever it was put: none may hold another, and no end of one may be the beginning of one."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if (i != j and b in a) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"{a!r} holds or ends like the beginning of {b!r}")


def fill_middle(docs: DataFrame, seed: str = "1", unit: str = "char", plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_units, middle_units, output`` for every row of ``docs``.

    A text of n units (``unit``: "char" for code points, "word", "line") is cut at two places drawn from the sha256 of ``seed``, ":" and
    the id: h1 to h4 are its first four groups of 32 bits. The prefix ends after the lesser of h1 % (n + 1) and h2 % (n + 1) units, the middle
    after the greater. ``form`` is ``plain`` (output is the text; sizes are null) for empty texts, texts that hold a mark, and where h3 % 100
    is among the last ``plain_percent``; else ``spm`` (suffix, prefix, middle) where h4 % 100 < ``spm_percent``, else ``psm`` (prefix, suffix, middle).

    A null text is empty. A null id is hashed as "null". Rows that repeat an id are cut by the same numbers, and equal rows come out
    equal. A very long text is a block of its own, whole. An empty table gives no rows. Other columns play no part.
    """
    check_marks(marks)
    units = UNITS[unit]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), digest.alias("digest"))
    groups = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for i, j in blocks(offs):
                part = batch.slice(i, j - i)
                yield batch_of(doc_id=part.column("doc_id"), **rearrange(part.column("text"), np.stack([ints(part, f"h{g}") for g in range(4)]), units, marks, plain_percent, spm_percent))

    return rows.select("doc_id", "text", *groups).transform(in_batches, run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    p, s, m = marks
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        return F.substring(F.substring_index(head, second, 1), F.lit(len(first) + 1), F.length(head)), F.substring_index(head, second, -1)

    prefix, suffix = parts(p, s)
    suffix_first, prefix_second = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_second, middle, suffix_first)).otherwise(output)
