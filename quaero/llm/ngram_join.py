"""N-gram Jaccard self-join by adaptive multi-match prefixes, and the components of its links.

Two sets with a Jaccard similarity of t or more share at least ceil(t * n) tokens of either. In any global order of
tokens, their l-prefixes, the first n - ceil(t * n) + l tokens, share at least l of them. A longer prefix costs more
lookups but asks for more matches before a pair is verified.

1. ``_prune``: with tokens ordered by their hash, a document with fewer than l tokens of its l-prefix in any other
   document's l-prefix has no link. Here l is 1 + n / 20. Tokens are counted with a combine in each Arrow batch.
2. Documents left with equal sets become one. A sketch of bounded size counts the tokens of the sets; from now on
   tokens are ordered from rare to frequent by it.
3. Sets meet in the bucket of the first set that shares a token of the (1-)prefix with them: one row per set and
   bucket, whatever the number of shared tokens. A bucket that holds too many tokens is dealt out as pairs of blocks.
4. ``_links`` joins each bucket: per set, the l with the least estimated cost; candidates with at least l matches;
   verification by counting. A pair that is already connected needs no verification. What leaves a bucket is a star for
   each of its components, never its pairs.
5. Components over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import LOWER, batch_of, blocks, in_batches, ints, keyed, keyed_rows, materialise, mix, prefix_sums, span_hash, text_bytes, word_hashes, word_spans
from quaero.llm.components import components
from quaero.llm.vectors import runs, whole_keys

SKETCH = 1 << 20
SKETCH_BLOCK = 1 << 12
#: Tokens of a block; a bucket with more is joined as pairs of blocks.
BLOCK_TOKENS = 400_000
STEPS = np.array([1, 2, 3, 5, 8, 13])


def shingle_sets(data: np.ndarray, offs: np.ndarray, n_gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in order, and the n + 1 offsets of the documents' sets."""
    starts, ends, at = word_spans(data, offs)
    p = prefix_sums(word_hashes(LOWER[data], starts, ends))
    words = np.diff(at)
    doc = np.repeat(np.arange(len(words)), np.where(words >= n_gram, words - n_gram + 1, (words > 0).astype(words.dtype)))
    first = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(words)))])[doc] + at[doc]
    size = np.minimum(words[doc], n_gram)
    token = span_hash(p, first, first + size) ^ mix(size.astype(np.uint64))
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(words) + 1))


def overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Fewest tokens that a set of n shares with one of at least that similarity."""
    return -(-n * percent // 100)


def multiplicity(n: np.ndarray) -> np.ndarray:
    return 1 + n // 20


def _prune(texts: DataFrame, n_gram: int, percent: int) -> DataFrame:
    """``k, n, s1, s2`` (size and fingerprint of the set) and ``hits`` (prefix tokens that other documents share)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = ints(batch, "k")
            data, offs = text_bytes(batch.column("text"))
            parts = []
            for i, j in blocks(offs):
                token, at = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n_gram)
                n = np.diff(at)
                length = np.minimum(n, n - overlap(n, percent) + multiplicity(n))
                doc = np.repeat(np.arange(j - i), n)
                in_prefix = np.arange(len(token)) - at[doc] < length[doc]
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token ^ np.uint64(c)))]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                parts.append((token[in_prefix], i + doc[in_prefix], n, sums[0][at[1:]] - sums[0][at[:-1]], sums[1][at[1:]] - sums[1][at[:-1]]))
            if not parts:
                continue
            token, doc, n, s1, s2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(token, kind="stable")
            token, doc = token[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            nth = np.arange(len(token)) - np.repeat(first, np.diff(np.append(first, len(token))))
            here = np.bincount(doc[nth >= 2], minlength=len(k))  # two rows are enough to tell that a token is shared
            sent = nth < 2
            info = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(here, pa.int64())], ["n", "s1", "s2", "hits"])
            yield batch_of(token=mix(k.view(np.uint64)).view(np.int64), k=k, info=info)
            none = pa.nulls(int(sent.sum()), info.type)
            yield batch_of(token=token[sent].view(np.int64), k=k[doc[sent]], info=none)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.struct([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("hits", pa.int64())])
        held: tuple[int, int, bool] | None = None  # the last row: its token, its document, whether it is counted
        for batch in batches:
            kept = batch.filter(batch.column("info").is_valid())
            if kept.num_rows:
                yield batch_of(k=kept.column("k"), hits=pa.array(np.zeros(kept.num_rows, np.int64)), info=kept.column("info"))
            rows = batch.filter(batch.column("info").is_null())
            token, k = ints(rows, "token"), ints(rows, "k")
            if not len(token):
                continue
            before = np.concatenate([[held is not None and held[0] == token[0]], token[1:] == token[:-1]])
            shared = before.copy()
            shared[:-1] |= before[1:]
            docs = k[shared]
            if before[0] and not held[2]:
                docs = np.append(docs, held[1])
            held = (int(token[-1]), int(k[-1]), bool(shared[-1]))
            docs, n = np.unique(docs, return_counts=True)
            yield batch_of(k=docs, hits=n.astype(np.int64), info=pa.nulls(len(docs), empty))

    kind = "info struct<n: long, s1: long, s2: long, hits: long>"
    rows = texts.select("k", "text").transform(in_batches, scan, f"token long, k long, {kind}").repartition("token").sortWithinPartitions("token")
    seen = rows.transform(in_batches, count, f"k long, hits long, {kind}")
    total = seen.groupBy("k").agg(F.sum("hits").alias("there"), F.max("info").alias("info"))
    return total.select("k", "info.n", "info.s1", "info.s2", (F.col("there") + F.col("info.hits")).alias("hits"))


def _sets(texts: DataFrame, wanted: DataFrame, n_gram: int) -> DataFrame:
    """``k, n, tokens`` (sorted 64-bit hashes) of the wanted documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in blocks(offs):
                token, at = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n_gram)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 8).astype(np.int32).tobytes()), pa.py_buffer(token.tobytes())])
                yield batch_of(k=batch.column("k").slice(i, j - i), n=np.diff(at).astype(np.int64), tokens=packed)

    # a sort-merge join at every size: a broadcast would hold as many ids as there are near copies
    return texts.join(wanted.hint("merge"), "k", "left_semi").select("k", "text").transform(in_batches, run, "k long, n long, tokens binary")


def _sketch(sets: DataFrame) -> np.ndarray:
    """How often tokens of each of ``SKETCH`` cells occur, over all sets: summed per task, then per block of cells."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH, np.int64)
        for batch in batches:
            data, _ = text_bytes(batch.column("tokens"))
            cells += np.bincount((data.view(np.uint64) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        parts = cells.reshape(-1, SKETCH_BLOCK)
        yield batch_of(block=np.arange(len(parts), dtype=np.int32), cells=pa.array([p.tobytes() for p in parts], pa.binary()))

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in group.column("cells").to_pylist())
        return pa.table({"block": group.column("block").slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})

    rows = sets.select("tokens").transform(in_batches, tally, "block int, cells binary").groupBy("block").applyInArrow(add, "block int, cells binary").collect()
    out = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.int64)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["cells"], np.int64)
    return np.minimum(out.ravel(), 2**31 - 1).astype(np.int32)


def _buckets(sets: DataFrame, percent: int) -> DataFrame:
    """``bucket, k, n``: sets that share a token of their prefixes, from rare to frequent, meet in a bucket."""
    seen = sets.sparkSession.sparkContext.broadcast(_sketch(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = ints(batch, "k"), ints(batch, "n")
            data, _ = text_bytes(batch.column("tokens"))
            token = data.view(np.uint64)
            doc = np.repeat(np.arange(len(k)), n)
            often = seen.value[(token % np.uint64(SKETCH)).astype(np.int64)]
            order = np.lexsort((token, often, doc))
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            place = np.arange(len(token)) - first[doc]
            own = order[(place < (n - overlap(n, percent) + 1)[doc]) & (often[order] > 1)]  # once in all: no partner
            yield batch_of(token=token[own].view(np.int64), k=k[doc[own]], n=n[doc[own]])

    rows = materialise(sets.transform(in_batches, prefixes, "token long, k long, n long"), "prefixes")
    first = rows.groupBy("token").agg(F.min("k").alias("bucket"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "bucket")
    return rows.join(first, "token").select("bucket", "k", "n").distinct()


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def label(self) -> np.ndarray:
        return self.root

    def unite(self, a: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[a]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def join_bucket(n: np.ndarray, tokens: np.ndarray, block: np.ndarray, percent: int) -> np.ndarray:
    """Component number of each of a bucket's sets, given in order of their keys: ``n`` sizes, ``tokens`` one after
    the other. With two block numbers, only pairs across are compared."""
    g = len(n)
    forest = _Forest(g)
    _, ident, df = np.unique(tokens, return_inverse=True, return_counts=True)
    ident, df = ident.astype(np.int32), df.astype(np.int32)
    doc = np.repeat(np.arange(g, dtype=np.int32), n)
    often = df[ident]
    order = np.lexsort((ident, often, doc))  # rare first within each set; tokens of one set only lead
    place = (np.arange(len(order)) - np.concatenate([[0], np.cumsum(n)])[:-1][doc]).astype(np.int32)  # by set, as the order is
    kept = often[order] > 1
    order, place = order[kept], place[kept]
    ident, owner = ident[order], doc[order]
    del order, often, kept, doc
    at = np.searchsorted(owner, np.arange(g + 1))
    least = overlap(n, percent)
    beyond = np.maximum(0, place - (n - least)[owner])  # in the l-prefix if below l
    by_token = np.argsort(ident, kind="stable")
    list_at = np.searchsorted(ident[by_token], np.arange(len(df) + 1))
    list_doc, list_beyond = owner[by_token], beyond[by_token]
    across = len(np.unique(block)) > 1
    mark = np.zeros(len(df), bool)
    for x in range(1, g):
        own = slice(at[x], at[x + 1])
        ids, far = ident[own], beyond[own]
        if not len(ids):
            continue
        # cost of l: look up every list of the l-prefix, and verify at most (matches / l) candidates
        looked = np.cumsum(np.bincount(np.minimum(far, STEPS[-1]), df[ids], minlength=STEPS[-1] + 1))[STEPS - 1]
        steps = STEPS[STEPS <= max(1, least[x])]
        looked = looked[: len(steps)]
        level = int(steps[np.argmin(looked + looked / steps * (n[x] / 8))])
        lists = ids[far < level]
        if not len(lists):
            continue
        sizes = list_at[lists + 1] - list_at[lists]
        where = np.arange(sizes.sum()) + np.repeat(list_at[lists] - (np.cumsum(sizes) - sizes), sizes)
        found = np.bincount(list_doc[where][list_beyond[where] < level], minlength=g)
        y = np.flatnonzero(found[:x] >= level)
        root = forest.label()
        y = y[(root[y] != root[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
        if across:
            y = y[block[y] != block[x]]
        if not len(y):
            continue
        mark[ids] = True
        # first the best candidate of each component; the rest only where that one failed
        best = y[np.lexsort((-found[y], root[y]))]
        head = best[np.concatenate([[True], root[best][1:] != root[best][:-1]])]
        for round_ in (head, y):
            root = forest.label()
            round_ = round_[root[round_] != root[x]]
            if not len(round_):
                break
            size = at[round_ + 1] - at[round_]
            inside = np.arange(size.sum()) + np.repeat(at[round_] - (np.cumsum(size) - size), size)
            both = np.add.reduceat(np.append(mark[ident[inside]], False).astype(np.int64), np.cumsum(size) - size) * (size > 0)
            forest.unite(x, round_[both * 100 >= (n[x] + n[round_] - both) * percent])
        mark[ids] = False
    return forest.label()


def _links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b``: a star for every component of every bucket (or pair of blocks)."""
    size = buckets.groupBy("bucket").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    dealt = buckets.join(size, "bucket").withColumn("parts", F.ceil(F.col("all") / BLOCK_TOKENS).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    other = F.explode(F.expr("sequence(0, parts - 1)"))
    dealt = dealt.select("bucket", "k", "block", other.alias("other"))
    key = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    rows = dealt.select(key.alias("key"), "k", "block").join(sets.hint("merge"), "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches):
            key, k, block, n = (rows.column(c).to_numpy() for c in ("key", "k", "block", "n"))
            data, offs = text_bytes(rows.column("tokens"))
            a, b = [], []
            for i, j in runs(key):
                if j - i > 1:
                    root = join_bucket(n[i:j], data[offs[i] : offs[j]].view(np.uint64), block[i:j], percent)
                    moved = np.flatnonzero(root != np.arange(j - i))
                    a.append(k[i:j][moved])
                    b.append(k[i:j][root[moved]])
            if a:
                yield batch_of(a=np.concatenate(a), b=np.concatenate(b))

    return rows.repartition("key").sortWithinPartitions("key", "k").transform(in_batches, run, "a long, b long")


def similar_components(docs: DataFrame, n_gram: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, k, n_shingles, class_id, component_id, component_k`` for every row of ``docs`` (``k`` orders documents).

    A document's set holds its distinct ``n_gram``-word shingles, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; with
    fewer words, the whole sequence as one; null, empty and blank texts have the empty set and no links. Two documents
    link when 100 * shared >= percent * united. ``class_id`` is the smallest id with the same set, ``component_id`` the
    smallest id reachable by links. Shingles are told apart by 64-bit hashes.

    Null ids come after all others (a component of such rows alone has a null id); rows that repeat an id and a text
    are one document listed twice, rows that repeat the id alone are two documents. An empty table gives no rows.
    Other columns play no part.
    """
    rows, texts = keyed(docs, id_col, text_col)
    info = materialise(_prune(texts, n_gram, percent), "sets-info")
    left = info.filter((F.col("n") > 0) & (F.col("hits") >= F.expr("1 + n div 20")))
    classes = left.groupBy("n", "s1", "s2").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("c"))
    classes = materialise(left.join(classes, ["n", "s1", "s2"]).select("k", "rep"), "classes")
    sets = materialise(_sets(texts, classes.select(F.col("rep").alias("k")).distinct(), n_gram), "sets")
    buckets = materialise(_buckets(sets, percent), "buckets")
    found = components(_links(buckets, sets, percent)).withColumnsRenamed({"node": "rep"})
    of = classes.join(found, "rep", "left").select("k", "rep", F.coalesce("component", "rep").alias("component"))
    names = rows.select("k", "doc_id").distinct()
    of = of.join(names.select(F.col("k").alias("component"), F.col("doc_id").alias("component_id")), "component").join(names.select(F.col("k").alias("rep"), F.col("doc_id").alias("class_id")), "rep")
    out = rows.select("doc_id", "k").join(info.select("k", "n"), "k", "left").join(of.select("k", "class_id", "component_id", "component", F.lit(True).alias("linked")), "k", "left")
    own = lambda c: F.when(F.col("linked"), F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return out.select("doc_id", "k", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"), F.coalesce("component", "k").alias("component_k"))


def keep_one(docs: DataFrame, n_gram: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its columns, one row of each component: the one with the smallest id."""
    rows, repeats = keyed_rows(docs)
    kept = similar_components(docs, n_gram, percent).filter("k = component_k").select("k")
    out = rows.join(kept, "k", "left_semi")
    return (out.dropDuplicates(["k"]) if repeats else out).select("row.*")
