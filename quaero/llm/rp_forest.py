"""Approximate nearest neighbours by a forest of random-projection trees, searched through a shared priority queue.

Each tree splits a bounded sample at the median of its projections on the difference of two of its points, down to
small leaves; every vector is then sent to its leaf in each tree. A query walks all trees with one priority queue,
ordered by how far the query lies from the splits that a branch turned away from, until the leaves it has reached
hold ``visit`` times as many entries (over all trees) as there are vectors. Vectors are dealt to blocks once, with the numbers of their leaves;
a block files its vectors under their leaves, and a query comes to it with the leaves it has reached. What is filed under one of them is a candidate,
repeats dropped; cosines are computed for candidates only, and the best of all blocks win.

How many leaves must be searched depends on the vectors: those of these tables have hardly any structure beyond copies
(nearest cosines about 0.4 in 64 dimensions), so that a recall of 0.9 takes about 0.4 to 0.6 of all vectors, and the default
is set above that. Vectors with structure do with a small ``visit``, and then work for each query follows the leaves it reaches.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.llm.common import batch_of, in_batches, ints, materialise, shuffle_partitions, with_key
from quaero.llm.vectors import matrix, runs, unit, usable

#: Vectors of a block: a query and its leaves are sent once for each block, so a block is as large as a task can hold.
BLOCK = 32_768
#: Vector lengths that get a forest.
FORESTS = 16


@dataclass
class Tree:
    """Inner nodes have ``left`` >= 0; a leaf is known by its node number."""

    normal: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def grow(sample: np.ndarray, leaf: int, seed: int) -> Tree:
        r = np.random.default_rng(seed)
        normal, at, left, right = [np.zeros(sample.shape[1])], [0.0], [-1], [-1]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, own = todo.pop()
            if len(own) <= leaf:
                continue
            a, b = sample[r.choice(own, 2, replace=False)]
            w = a - b if (a != b).any() else r.standard_normal(sample.shape[1])
            w = w / np.sqrt(w @ w)
            p = sample[own] @ w
            cut = float(np.median(p))
            up = p > cut
            if up.all() or not up.any():
                continue
            normal[node], at[node], left[node], right[node] = w, cut, len(at), len(at) + 1
            for part in (own[~up], own[up]):
                todo.append((len(at), part))
                normal.append(np.zeros(sample.shape[1]))
                at.append(0.0)
                left.append(-1)
                right.append(-1)
        return Tree(np.array(normal), np.array(at), np.array(left), np.array(right))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[node] >= 0)
            if not len(inner):
                return node
            n = node[inner]
            up = np.einsum("ij,ij->i", x[inner], self.normal[n]) > self.at[n]
            node[inner] = np.where(up, self.right[n], self.left[n])


def search(trees: list[Tree], size: dict[tuple[int, int], int], q: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """Leaves (tree, node) for a query, nearest branches of all trees first, until they hold ``enough`` entries."""
    sides = [t.normal @ q - t.at for t in trees]
    queue = [(0.0, i, 0) for i in range(len(trees))]
    out, n = [], 0
    while queue and n < enough:
        gap, i, node = heapq.heappop(queue)
        t = trees[i]
        while t.left[node] >= 0:
            m = sides[i][node]
            near, far = (t.right[node], t.left[node]) if m > 0 else (t.left[node], t.right[node])
            heapq.heappush(queue, (max(gap, abs(m)), i, int(far)))
            node = int(near)
        if (i, node) in size:
            out.append((i, node))
            n += size[(i, node)]
    return out


class Filed:
    """A block's vectors, filed under their leaves in each tree."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, leaves: np.ndarray, nodes: list[int]):
        self.keys, self.ids, self.x, self.unit = keys, ids, x, unit(x)
        self.rows, self.starts = [], []
        for t, n in enumerate(nodes):
            self.rows.append(np.argsort(leaves[:, t], kind="stable"))
            self.starts.append(np.searchsorted(leaves[self.rows[t], t], np.arange(n + 1)))

    def candidates(self, reached: np.ndarray) -> np.ndarray:
        """Rows of the vectors in one of the leaves, given as tree << 24 | node; each once."""
        found = []
        for t, rows in enumerate(self.rows):
            nodes = reached[reached >> 24 == t] & 0xFFFFFF
            begin, size = self.starts[t][nodes], self.starts[t][nodes + 1] - self.starts[t][nodes]
            # the stretches begin..begin + size, one after the other
            at = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
            found.append(rows[at])
        own = np.zeros(len(self.keys), bool)
        own[np.concatenate(found)] = True
        return np.flatnonzero(own)

    def nearest(self, key: int, q: np.ndarray, reached: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k candidates nearest to ``q``, without its own (all that tie with the last are looked at exactly)."""
        rows = np.arange(len(self.keys)) if reached is None else self.candidates(reached)
        rows = rows[self.keys[rows] != key]
        if not len(rows):
            return self.ids[:0], np.zeros(0)
        near = self.unit[rows] @ (q / np.sqrt(q @ q))
        cut = np.partition(near, max(0, len(near) - k))[max(0, len(near) - k)]
        rows = rows[near >= cut - 1e-9]
        exact = np.einsum("ij,j->i", self.x[rows], q) / (np.sqrt(np.einsum("ij,ij->i", self.x[rows], self.x[rows])) * np.sqrt(q @ q))
        order = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows[order]], exact[order]


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, trees: int = 8, leaf: int = 64, sample: int = 20_000, visit: float = 1.2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector whose id is divisible by ``every``, the ``k`` nearest others.

    Vectors that are null, zero, hold null or non-finite components, or have no id take no part. Only vectors of one length are compared:
    for each of the ``FORESTS`` commonest lengths trees are fitted on at most ``sample`` vectors, picked by a hash, and all vectors are indexed;
    vectors of rarer lengths are compared with all of their length. Rows that repeat an id and a vector are one vector listed twice; rows that repeat the
    id alone are vectors of their own, each with ranks of its own. Ties go to the smaller id. An empty table gives no rows. Other columns
    play no part.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType  # vectors travel as they are stored
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable("v"))
    rows, repeats = with_key(base, "id", ["v"])
    rows = rows.dropDuplicates(["k"]) if repeats else rows
    rows = materialise(rows.select("k", "id", F.col("v").cast(kind).alias("v"), F.size("v").alias("d")), "vectors")
    lengths = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    common = [tuple(r) for r in lengths.orderBy(F.desc("n"), "d").limit(FORESTS).collect()]
    forests = {}
    for d, _ in common:
        picked = [r[0] for r in rows.filter(F.col("d") == d).orderBy(F.xxhash64("id"), "id", "k").limit(sample).select("v").collect()]
        forests[d] = [Tree.grow(unit(np.array(picked, np.float64)), leaf, s) for s in range(trees)]
    forest = spark.sparkContext.broadcast(forests)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = ints(batch, "d")
            for dim in np.unique(d).tolist():
                part = batch.filter(pa.array(d == dim))
                x = unit(matrix(part.column("v"), dim))
                leaves = np.column_stack([t.leaves(x) for t in forest.value[dim]] if dim in forest.value else [np.zeros(len(x))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, leaves.shape[1], dtype=np.int32)), pa.array(leaves.ravel()))
                yield batch_of(**{c: part.column(c) for c in ("k", "id", "v", "d")}, leaves=lists)

    indexed = materialise(rows.transform(in_batches, index, T.StructType([*rows.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))])), "leaves")
    counts = indexed.join(F.broadcast(spark.createDataFrame([(d,) for d, _ in common], "d int")), "d", "left_semi").select("d", F.posexplode("leaves").alias("tree", "leaf"))
    size = {d: {} for d, _ in common}
    for r in counts.groupBy("d", "tree", "leaf").count().collect():  # leaves are bounded by the sample
        size[r["d"]][(r["tree"], r["leaf"])] = r["count"]
    totals = dict(common)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, seen = ints(batch, "d"), []
            for dim, v in zip(d.tolist(), batch.column("v").to_pylist(), strict=True):
                found = search(forest.value[dim], size[dim], unit(np.array([v], np.float64))[0], visit * totals[dim]) if dim in totals else []
                seen.append([(t << 24) + n for t, n in found])
            yield batch_of(**{c: batch.column(c) for c in ("k", "id", "v", "d")}, leaves=pa.array(seen, pa.list_(pa.int32())))

    parts = F.broadcast(lengths.select("d", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")).filter("parts > 1"))  # at most one row for each BLOCK vectors
    dealt = lambda df, kind_: df.join(parts, "d", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("query", F.lit(kind_))
    placed = dealt(indexed, 0).withColumn("block", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    asked = indexed.filter(F.col("id") % every == 0).repartition(shuffle_partitions(vectors), "k").transform(in_batches, probe, indexed.schema)
    asked = dealt(asked, 1).withColumn("block", F.explode(F.expr("sequence(0, parts - 1)")))
    key = F.xxhash64("d", "block").alias("key")
    columns = [key, "query", "k", "id", "v", "d", "leaves"]
    both = placed.select(*columns).unionByName(asked.select(*columns)).repartition(shuffle_partitions(vectors), "key").sortWithinPartitions("key", "query")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None  # the block's vectors come before the queries
        for batch in batches:
            numbers, query = ints(batch, "key"), ints(batch, "query")
            for i, j in runs(numbers * 2 + query):
                part = batch.slice(i, j - i)
                if numbers[i] != at:
                    at, held, block = numbers[i], [], None
                if not query[i]:
                    held.append(part)
                    continue
                dim = part.column("d")[0].as_py()
                if block is None:
                    if not held:
                        continue
                    all_ = pa.Table.from_batches(held).combine_chunks()
                    leaves = all_.column("leaves").combine_chunks().flatten().to_numpy().reshape(all_.num_rows, -1)
                    nodes = [len(t.at) for t in forest.value[dim]] if dim in totals else []
                    block = Filed(all_.column("k").to_numpy(), all_.column("id").to_numpy(), matrix(all_.column("v").combine_chunks(), dim), leaves, nodes)
                    held = []
                keys, ids, q = ints(part, "k"), ints(part, "id"), matrix(part.column("v"), dim)
                near = [block.nearest(keys[r], q[r], np.array(reached, np.int64) if dim in totals else None, k) for r, reached in enumerate(part.column("leaves").to_pylist())]
                each = [len(v) for v, _ in near]
                yield batch_of(query=np.repeat(keys, each), query_id=np.repeat(ids, each), vec_id=np.concatenate([v for v, _ in near]), score=np.concatenate([s for _, s in near]))

    met = both.transform(in_batches, rank, "query long, query_id long, vec_id long, score double")
    best = met.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)"))
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
