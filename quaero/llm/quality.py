"""Quality rules: measures of each text alone, and how often its lines occur in other documents of the same host.

1. One pass over the texts measures each document and hashes its lines, normalised (case of A-Z, blanks and digits don't count):
   a document stands with the list of its distinct lines, each as a hash with its words. The pass is written as a table; texts are in it
   only if they are asked for.
2. For each host and line the documents that hold it are counted. A document names a line once, so a count by partial aggregation
   is the number of distinct documents, also for a line that every document of a hot host has.
3. Lines in more than ``most_docs(documents of the host)`` documents are removed wherever they stand on that host: they are joined to the
   lists, salted, since one of them may be in a third of all documents. A document that is left with too little is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.llm.common import BYTE, LOWER, SPACE, batch_of, blocks, in_batches, materialise, prefix_sums, span_hash, text_bytes, word_spans

LEAST_WORDS = 50
MOST_REPEATED = 50
#: A line is above the limits in more documents of its host than this number and this share of them.
LINE_DOCS = 10
LINE_SHARE = 0.01
#: Most of a document's words that may go, in percent.
MOST_REMOVED = 50
SALTS = 16

#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NORMAL = LOWER.copy()
_NORMAL[ord("0") : ord("9") + 1] = ord("0")

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LINES = "lines array<struct<h:long,words:long,n:long>>"


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches [start, end), which come in order and don't overlap, as values."""
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, ends[-1] if len(ends) else 0
    pieces = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)])
    return pieces.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def _codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each stretch; equal stretches have equal numbers."""
    return _strings(data, starts, ends).dictionary_encode().indices.to_numpy().astype(np.int64)


def _per_document(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offs])


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (without the line feed) of every line, and the document of each. An empty document has one empty line."""
    feeds = np.flatnonzero(data == 10)
    starts = np.concatenate([offs[:-1], feeds + 1])
    doc = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, feeds, side="right") - 1])
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    return starts, np.where(last, offs[doc + 1], np.concatenate([starts[1:], [0]]) - 1) if len(doc) else starts, doc


def repeated_words(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a 3-word window that their document has twice or more."""
    marked = np.zeros(len(code), bool)
    inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(code) > 2 else np.zeros(0, np.int64)
    if not len(inside):
        return marked
    size = np.int64(code.max() + 1)
    pair = code[inside] * size + code[inside + 1]
    window = np.unique(pair, return_inverse=True)[1] * size + code[inside + 2]  # below 2^62 for up to 2^31 words
    order = np.lexsort((window, doc[inside]))
    window, own = window[order], doc[inside][order]
    same = np.concatenate([[False], (window[1:] == window[:-1]) & (own[1:] == own[:-1]), [False]])
    twice = inside[order][same[1:] | same[:-1]]
    for i in range(3):
        marked[twice + i] = True
    return marked


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the normalised words first..last of each line."""
    words = span_hash(prefix_sums(BYTE[_NORMAL[data]]), starts, ends)
    return span_hash(prefix_sums(words), first, last).view(np.int64)


def measure(texts: pa.Array) -> tuple[dict[str, pa.Array], pa.Array]:
    """The measures of each text of a block, and its list of distinct lines."""
    data, offs = text_bytes(texts)
    data = np.ascontiguousarray(data)
    starts, ends, word_offs = word_spans(data, offs)
    n_docs = len(offs) - 1
    word_doc = np.repeat(np.arange(n_docs), np.diff(word_offs))
    solid = ~SPACE[data]
    code = _codes(data, starts, ends)
    lo, hi, line_doc = line_spans(data, offs)
    first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    own = last > first
    lo, hi, line_doc, first, last = (x[own] for x in (lo, hi, line_doc, first, last))
    line = _codes(data, lo, hi)
    distinct = np.unique(line_doc * np.int64(len(line) + 1) + line)
    n_lines = np.bincount(line_doc, minlength=n_docs)
    n_distinct = np.bincount(distinct // (len(line) + 1), minlength=n_docs)
    out = {
        "n_words": np.diff(word_offs), "word_chars": _per_document(solid & ((data & 0xC0) != 0x80), offs), "n_symbols": _per_document(_SYMBOL[data], offs),
        "n_dup_lines": n_lines - n_distinct, "n_repeat_words": _per_document(repeated_words(code, word_doc), word_offs),
    }
    h = line_hashes(data, starts, ends, first, last)
    order = np.lexsort((h, line_doc))
    h, line_doc, words = h[order], line_doc[order], (last - first)[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (line_doc[1:] != line_doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    fields = [h[new], np.add.reduceat(words, new) if len(new) else new, np.diff(np.concatenate([new, [len(h)]])) if len(new) else new]
    struct = pa.StructArray.from_arrays([pa.array(f.astype(np.int64)) for f in fields], names=["h", "words", "n"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(line_doc[new], np.arange(n_docs + 1)).astype(np.int32)), struct)
    return {k: pa.array(v.astype(np.int64)) for k, v in out.items()}, lists


def without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Each text without its lines whose hash is listed for it; a null text stays null."""
    data, offs = text_bytes(texts)
    starts, ends, _ = word_spans(data, offs)
    lo, hi, doc = line_spans(data, offs)
    first, last = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    h = line_hashes(data, starts, ends, first, last)
    listed = pa.array(gone.value_lengths().fill_null(0)).to_numpy(zero_copy_only=False)
    out_of = np.repeat(np.arange(len(texts)), listed)
    hashes = gone.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    known = {}
    for i, x in zip(out_of.tolist(), hashes.tolist(), strict=True):
        known.setdefault(i, set()).add(x)
    raw, edges = data.tobytes(), np.searchsorted(doc, np.arange(len(texts) + 1))
    kept = []
    for i, text in enumerate(texts.to_pylist()):
        if i in known:
            own = [j for j in range(edges[i], edges[i + 1]) if first[j] == last[j] or int(h[j]) not in known[i]]
            text = b"\n".join(raw[lo[j] : hi[j]] for j in own).decode()
        kept.append(text)
    return pa.array(kept, pa.string())


def judged(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, most_removed: int = MOST_REMOVED, whole_rows: bool = False) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_lines, removed_words, base_failed, kept`` for every row.

    A text alone: words (``[^\\x20\\x09-\\x0D]+``), code points in words, symbols, lines with a word that equal an earlier line, and words in
    3-word windows found twice or more. ``base_failed``: under ``least_words`` words, or over ``most_repeated`` percent of them in such windows.
    Against others: a normalised line (words with A-Z in lower case and digits as 0, single blanks) is removed where more than ``line_docs`` documents and more than
    ``line_share`` of all documents of its host hold it. ``kept`` is false if ``base_failed``, if under ``least_words`` words are left, or if over ``most_removed`` percent have gone.

    Every row is a document, also one that repeats an id or a whole row. Null texts have no words. Null hosts are one host. Texts may be of any length;
    an empty table gives no rows; other columns play no part. With ``whole_rows``, the row itself (``row``) and the hashes of its removed lines (``gone``) come too.
    """
    base = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.col(text_col).cast("string").alias("text")]
    rows = docs.select(*base, *([F.struct("*").alias("row")] if whole_rows else []))
    through = ["doc_id", "host", *(["row"] if whole_rows else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = text_bytes(batch.column("text"))
            for i, j in blocks(offs):
                part = batch.slice(i, j - i)
                measures, lines = measure(part.column("text"))
                yield batch_of(**{c: part.column(c) for c in through}, **measures, lines=lines)

    schema = T.StructType([f for f in rows.schema.fields if f.name in through])
    for field in T.StructType.fromDDL(f"{MEASURES}, {LINES}").fields:
        schema = schema.add(field)
    measured = rows.transform(in_batches, run, schema)
    # the number of a row is fixed by being written
    measured = materialise(measured.withColumn("k", F.monotonically_increasing_id()), "quality")

    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = measured.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > line_docs)
    above = counts.join(hosts, "host").filter(F.col("c") > F.col("docs") * line_share).select("host", "h")
    # each of these lines stands in more than line_docs documents, so all their salted rows are no more than the lists' lines and a half
    above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = measured.select("k", "host", F.explode("lines").alias("line")).select("k", "host", "line.*", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int").alias("salt"))
    sums = [F.sum("n").alias("removed_lines"), F.sum("words").alias("removed_words"), *([F.collect_list("h").alias("gone")] if whole_rows else [])]
    removed = lines.join(above, ["host", "h", "salt"]).groupBy("k").agg(*sums)

    out = measured.drop("lines").join(removed, "k", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("removed_lines", "removed_words")})
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words") < least_words) | (100 * F.col("removed_words") > most_removed * F.col("n_words"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_lines", "removed_words"]
    return out.select(*names, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), *(["row", "gone"] if whole_rows else []))


def cleaned(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The kept rows of ``docs`` with all their columns, the text without its removed lines. Cases as for ``judged``."""
    rows = judged(docs, text_col=text_col, whole_rows=True, **limits).filter("kept").select("row", "gone")
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField("row", T.StructType([T.StructField(f.name, T.StringType() if i == at else f.dataType) for i, f in enumerate(docs.schema.fields)]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, names = batch.column("row").flatten(), [f.name for f in batch.schema.field("row").type]
            fields[at] = without_lines(fields[at].cast(pa.string()), batch.column("gone"))
            yield batch_of(row=pa.StructArray.from_arrays(fields, names=names))

    return rows.transform(in_batches, run, schema).select("row.*")
