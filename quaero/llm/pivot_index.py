"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points, the pivots, in order of nearness. Inverted lists hold vectors by what they have in common at the
head of that order; in a list shared pivots are counted, and what shares enough is verified by its cosine.

1. There is a list for every two pivots (and label): a vector stands in those of any two of its ``head`` nearest. The number of pivots grows with the
   root of the number of vectors, and the lists' number with its square, so lists stay about as long as they are.
2. The lists hold ids and permutations only. A pair of vectors is looked at in one list: that of the two first pivots (by number) that both have in their heads. It is a
   candidate if at least ``least`` of the ``near`` nearest pivots are shared, counted by a product of sparse rows compressed to the pivots of the list.
3. Vectors that have a candidate in a list get their components, which are joined to them, and are verified against their candidates there. As a pair
   is verified once, counts simply add up; of each vector go on its number of links and one link to the first of its component in the list.

``fit`` chooses head, near and least, and whether the vectors' common direction is taken off before, on a bounded sample: what finds the sample's own links
and made-up pairs at the threshold with the fewest pairs looked at. Lists longer than ``BLOCK`` are dealt out as pairs of blocks. Identical vectors are one entry with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import batch_of, in_batches, materialise, shuffle_partitions, with_key
from quaero.llm.components import components
from quaero.llm.vectors import matrix, unit, usable, whole_keys

BLOCK = 2_048
ROWS = 512
#: Lists up to this length are looked at many at a time, pair by pair.
SHORT = 48
#: Vectors of a sample; vectors that pairs at the threshold are made for; lengths that are fitted.
SAMPLE = 2_048
TRIED = 1_000
FITTED = 16
CROWDED = 0.7
#: Heads that are tried, and the share of pairs that lists, and then counts, must find.
HEADS = (5, 6, 7, 8, 10, 12, 16, 24)
FOUND = 0.997


@dataclass(frozen=True)
class Pivots:
    """Reference points for vectors less ``centre``, and how they are used."""

    centre: np.ndarray
    points: np.ndarray
    head: int
    near: int
    least: int

    def permutation(self, x: np.ndarray) -> np.ndarray:
        """The numbers of the ``near`` nearest pivots of unit vectors, nearest first."""
        return nearest_points(x, self.centre, self.points, self.near)


def nearest_points(x: np.ndarray, centre: np.ndarray, points: np.ndarray, near: int) -> np.ndarray:
    y = x - centre
    y = np.where(np.einsum("ij,ij->i", y, y)[:, None] > 1e-24, y, x)
    return np.argsort(-(y @ points.T), axis=1, kind="stable")[:, :near].astype(np.int32)


def default_pivots(n: int) -> int:
    """Pivots for n vectors: 256, and twice as many for every four times as many vectors beyond 100 000."""
    return 256 << max(0, round(math.log2(max(n, 1) / 100_000) / 2))


def spread(x: np.ndarray, pivots: int) -> np.ndarray:
    """``pivots`` of the unit vectors ``x``, each the farthest from those before it, so that a group of near copies gets
    one and not a share by its size. Once all others have a cosine over ``CROWDED`` to one of them, fixed random
    directions fill up the rest: the order of near-equal points by distance is noise."""
    own: list[int] = []
    nearest = np.full(len(x), -np.inf)
    while len(own) < min(pivots, len(x)):
        i = int(np.argmin(nearest))
        if nearest[i] > CROWDED:
            break
        own.append(i)
        nearest = np.maximum(nearest, x @ x[i])
    return np.vstack([x[own], _directions(x.shape[1], pivots - len(own))])


def _directions(d: int, n: int) -> np.ndarray:
    return unit(np.random.default_rng(d).standard_normal((n, d))) if n else np.zeros((0, d))


def unfitted(d: int, pivots: int) -> Pivots:
    """For lengths too rare to be fitted, and samples too small."""
    return Pivots(np.zeros(d), _directions(d, pivots), min(8, pivots), min(12, pivots), min(4, pivots))


def _shared(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p[:, :, None] == q[:, None, :]).any(axis=2).sum(axis=1)


def made_pairs(x: np.ndarray, cosine: float) -> np.ndarray:
    """A vector at just that cosine from each of ``x``, in a fixed random direction."""
    z = np.random.default_rng(x.shape[1]).standard_normal(x.shape)
    z -= np.einsum("ij,ij->i", z, x)[:, None] * x
    return cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * unit(z)


def fit(x: np.ndarray, pivots: int, cosine: float) -> Pivots:
    """Pivots for unit vectors of which ``x`` is a sample."""
    d = x.shape[1]
    if d < 3 or len(x) < 8:
        return unfitted(d, pivots)
    tried = x[:TRIED]
    links = np.argwhere(np.triu(tried @ tried.T >= cosine, 1))
    links = links[np.random.default_rng(0).permutation(len(links))[:TRIED]]
    left, right = np.vstack([tried, tried[links[:, 0]]]), np.vstack([made_pairs(tried, cosine), tried[links[:, 1]]])
    wide = min(32, pivots)
    best = None
    for centre in (np.zeros(d), x.mean(axis=0)):
        y = x - centre
        y = y[np.einsum("ij,ij->i", y, y) > 1e-24]
        points = spread(unit(y), pivots)
        p, q, other = (nearest_points(v, centre, points, wide) for v in (left, right, np.roll(tried, 1, axis=0)))
        for head in HEADS:
            if head > wide or (_shared(p[:, :head], q[:, :head]) >= 2)[: len(tried)].mean() < FOUND:
                continue
            if len(links) and (_shared(p[:, :head], q[:, :head]) >= 2)[len(tried) :].mean() < FOUND:
                continue
            near = min(wide, head + 4)
            both = _shared(p[:, :near], q[:, :near])
            least = max([2, *(s for s in range(2, near + 1) if min((both[part] >= s).mean() for part in (slice(0, len(tried)), slice(len(tried), None)) if len(both[part])) >= FOUND)])
            met = (_shared(p[: len(tried), :head], other[:, :head]) >= 2).mean()
            if best is None or met < best[0]:
                best = met, Pivots(centre, points, head, near, least)
            break
    # where no head finds enough, every vector stands in one list, and all pairs are verified
    return best[1] if best else Pivots(np.zeros(d), _directions(d, 2), 2, 2, 2)


def fits(vectors: DataFrame, pivots: int, cosine: float) -> dict[int, Pivots]:
    """``fit`` for the ``FITTED`` commonest lengths, each on ``SAMPLE`` vectors picked by a hash of their components."""
    lengths = [r[0] for r in vectors.select(F.size("v").alias("d")).groupBy("d").count().orderBy(F.desc("count"), "d").limit(FITTED).collect()]
    found = {}
    for d in lengths:
        rows = vectors.filter(F.size("v") == d).select("v").orderBy(F.xxhash64("v"), "v").limit(max(SAMPLE, pivots)).collect()
        found[d] = fit(unit(np.array([r[0] for r in rows], np.float64).reshape(-1, d)), pivots, cosine)
    return found


def lists_of(perm: np.ndarray, head: int, pivots: int) -> np.ndarray:
    """The lists of each vector: its head's pivots, two and two."""
    i, j = np.triu_indices(head, 1)
    a, b = perm[:, i].astype(np.int64), perm[:, j].astype(np.int64)
    return np.minimum(a, b) * pivots + np.maximum(a, b)


def _rows(perm: np.ndarray, upto: int | None = None) -> np.ndarray:
    """A row for each vector with 1 at each of its pivots (of those up to a number), over the pivots that occur."""
    own = np.unique(perm) if upto is None else np.unique(perm[perm <= upto])
    out = np.zeros((len(perm), len(own)), np.float32)
    r, c = np.nonzero(np.isin(perm, own))
    out[r, np.searchsorted(own, perm[r, c])] = 1
    return out


def candidates(second: int, perm: np.ndarray, head: int, least: int, block: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray]]:
    """For a slice of a list's vectors at a time, which of the others are theirs to verify in this list (``second`` is the greater of its two
    pivots): they share ``least`` pivots, and of their heads no two that come before. With ``block``, only those of the other block."""
    heads, all_ = _rows(perm[:, :head], second), _rows(perm)
    for a in range(0, len(perm), ROWS):
        part = slice(a, min(a + ROWS, len(perm)))
        ok = (heads[part] @ heads.T == 2) & (all_[part] @ all_.T >= least)
        if block is not None:
            ok &= block[part, None] != block
        ok[np.arange(part.stop - a), np.arange(a, part.stop)] = False
        yield part, ok


def short_pairs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows within each of many short lists, for all lists at once."""
    each = np.repeat(start, size)
    row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + each
    after = np.repeat(start + size, size) - row - 1
    i = np.repeat(row, after)
    return i, i + 1 + np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after)


def short_candidates(i: np.ndarray, j: np.ndarray, second: np.ndarray, perm: np.ndarray, head: int, least: int) -> np.ndarray:
    """Which of the pairs of rows are candidates of their list, as in ``candidates``; ``second`` is by row."""
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 65_536):
        p, q = perm[i[a : a + 65_536]], perm[j[a : a + 65_536]]
        first = p[:, :head] <= second[i[a : a + 65_536], None]
        ok = ((p[:, :head, None] == q[:, None, :head]).any(axis=2) & first).sum(axis=1) == 2
        out[a : a + 65_536][ok] = _shared(p[ok], q[ok]) >= least
    return out


def short_links(i: np.ndarray, j: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links of rows: each row's links weighted by multiplicity, and the first row that it is connected to."""
    links = np.zeros(len(m), np.int64)
    np.add.at(links, i, m[j])
    np.add.at(links, j, m[i])
    root = np.arange(len(m))
    while True:
        least = np.minimum(root[i], root[j])
        if (root[i] == least).all() and (root[j] == least).all():
            return links, root
        np.minimum.at(root, i, least)
        np.minimum.at(root, j, least)


def verify(found: Iterator[tuple[slice, np.ndarray]], x: np.ndarray, m: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links of each vector of one list (weighted by multiplicity), the first of its component there, and the number of cosines.

    A list has at most about two blocks of vectors, so their link matrix of booleans is small."""
    n, cosines = len(x), 0
    linked = np.zeros((n, n), bool)
    for part, ok in found:
        if ok.mean() > 0.1:
            cosines += ok.size
            ok &= x[part] @ x.T >= cosine
            linked[part] = ok
        else:
            i, j = np.nonzero(ok)
            cosines += len(i)
            good = np.concatenate([np.einsum("ij,ij->i", x[part.start + i[c : c + 65_536]], x[j[c : c + 65_536]]) for c in range(0, len(i), 65_536)] or [np.zeros(0)]) >= cosine
            linked[part.start + i[good], j[good]] = True
    linked |= linked.T
    root = np.arange(n)
    seen = ~linked.any(axis=1)
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        edge = np.array([i])
        while len(edge):
            root[edge] = i
            edge = np.flatnonzero(linked[edge].any(axis=0) & ~seen)
            seen[edge] = True
    return linked @ m, root, cosines


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Vectors of one label (not null) and one length link where their cosine in double precision is at least ``cosine``
    and the index meets them (see the module; the fit aims at ``FOUND`` of pairs just at the threshold). Vectors that are null, zero or hold null or
    non-finite components, and rows with a null label, link with nothing. ``n_links`` counts other vectors, copies
    included; ``component_id`` is the smallest id reachable; ``kept`` marks the row with that id.

    Null ids come after all others; rows that repeat id, label and vector are one vector listed twice, rows that repeat
    the id alone are two vectors (of which the one with the smaller hash is kept). An empty table gives no rows. Other
    columns play no part.
    """
    kind = vectors.schema[vector_col].dataType  # vectors travel as they are stored
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows, repeats = with_key(base, "vec_id", ["label", "v"])
    once = rows.dropDuplicates(["k"]) if repeats else rows
    part = once.filter(usable("v") & F.col("label").isNotNull()).select("k", "label", "v")
    same = part.groupBy("label", "v").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("m"))
    space = F.xxhash64("label", F.size("v")).alias("space")
    classes = materialise(same.select(F.col("rep").alias("k"), "label", "v", "m", space), "vectors")
    pivots = pivots or default_pivots(classes.count())
    # pivots grow with the root of the vectors; a broadcast sends them to each executor once
    shared = vectors.sparkSession.sparkContext.broadcast(fits(classes, pivots, cosine))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(d).tolist():
                own = shared.value.get(dim) or unfitted(dim, pivots)
                rows = batch.filter(pa.array(d == dim))
                perm = own.permutation(unit(matrix(rows.column("v"), dim)))
                lists = lists_of(perm, own.head, len(own.points))
                i = pa.array(np.repeat(np.arange(len(perm)), lists.shape[1]))
                packed = pa.array([p.tobytes() for p in perm], pa.binary())
                yield batch_of(space=rows.column("space").take(i), list=lists.ravel(), d=np.full(lists.size, dim, np.int32), k=rows.column("k").take(i), perm=packed.take(i))

    filed = materialise(classes.select("space", "k", "v").transform(in_batches, entries, "space long, list long, d int, k long, perm binary"), "pivot-lists")
    long = filed.groupBy("space", "list").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > BLOCK)
    dealt = filed.join(long, ["space", "list"], "left").withColumn("parts", F.ceil(F.coalesce("c", F.lit(1)) / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int")).withColumn("mate", F.explode(F.expr("sequence(0, parts - 1)")))
    key = F.xxhash64("space", "list", F.least("block", "mate"), F.greatest("block", "mate")).alias("key")

    def perms(table: pa.Table, i: int, j: int) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("perm").slice(i, j - i).to_pylist()), np.int32).reshape(j - i, -1)

    def fit_of(dim: int) -> Pivots:
        return shared.value.get(dim) or unfitted(dim, pivots)

    def found_in(table: pa.Table, i: int, j: int):
        own = fit_of(table.column("d")[i].as_py())
        block = table.column("block").slice(i, j - i).to_numpy() if table.column("block")[i] != table.column("mate")[i] else None
        return candidates(table.column("list")[i].as_py() % len(own.points), perms(table, i, j), own.head, own.least, block)

    def in_short(table: pa.Table, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate pairs of rows of all short lists of a table."""
        size = np.diff(edges)
        few, d = (size > 1) & (size <= SHORT), table.column("d").to_numpy()
        block, mate, list_ = (table.column(c).to_numpy() for c in ("block", "mate", "list"))
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for dim in np.unique(d).tolist():
            own, part = fit_of(dim), few & (d[edges[:-1]] == dim)
            i, j = short_pairs(edges[:-1][part], size[part])
            if len(i):
                rows = np.flatnonzero(np.repeat(part, size))
                perm = np.zeros((table.num_rows, own.near), np.int32)
                perm[rows] = np.frombuffer(b"".join(table.column("perm").take(pa.array(rows)).to_pylist()), np.int32).reshape(len(rows), -1)
                ok = short_candidates(i, j, list_ % len(own.points), perm, own.head, own.least) & ((block[i] == mate[i]) | (block[i] != block[j]))
                pairs.append((i[ok], j[ok]))
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))

    def bounds(table: pa.Table) -> np.ndarray:
        key = table.column("key").to_numpy()
        return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches):
            has, edges = np.zeros(table.num_rows, bool), bounds(table)
            i, j = in_short(table, edges)
            has[i] = has[j] = True
            for at in np.flatnonzero(np.diff(edges) > SHORT):
                a, b = int(edges[at]), int(edges[at + 1])
                for part, ok in found_in(table, a, b):
                    has[a + part.start : a + part.stop] = ok.any(axis=1)
            yield from table.filter(pa.array(has)).combine_chunks().to_batches()

    columns = "key long, list long, d int, block int, mate int, k long, perm binary"
    dealt = dealt.select(key, "list", "d", "block", "mate", "k", "perm").repartition(shuffle_partitions(vectors), "key").sortWithinPartitions("key", "k")
    asked = dealt.transform(in_batches, retrieve, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches):
            k, m, d = (table.column(c).to_numpy() for c in ("k", "m", "d"))
            v, edges = table.column("v").combine_chunks(), bounds(table)
            x: dict[int, np.ndarray] = {}
            at = np.zeros(len(k), np.int64)
            for dim in np.unique(d).tolist():
                rows = np.flatnonzero(d == dim)
                x[dim], at[rows] = unit(matrix(v.take(pa.array(rows)), dim)), np.arange(len(rows))
            i, j = in_short(table, edges)
            good = np.zeros(len(i), bool)
            for dim in x:
                for own in np.array_split(np.flatnonzero(d[i] == dim), max(1, len(i) // 65_536)):
                    good[own] = np.einsum("ij,ij->i", x[dim][at[i[own]]], x[dim][at[j[own]]]) >= cosine
            links, root = short_links(i[good], j[good], m)
            for p in np.flatnonzero(np.diff(edges) > SHORT):
                a, b = int(edges[p]), int(edges[p + 1])
                links[a:b], first, _ = verify(found_in(table, a, b), x[int(d[a])][at[a:b]], m[a:b], cosine)
                root[a:b] = a + first
            own = np.flatnonzero(links)
            yield batch_of(a=k[own], n=links[own], b=k[root[own]])

    asked = asked.join(classes.select("k", "m", F.col("v").cast(kind).alias("v")).hint("merge"), "k").repartition(shuffle_partitions(vectors), "key").sortWithinPartitions("key", "k")
    found = materialise(asked.transform(in_batches, run, "a long, n long, b long"), "vector-links")
    links = found.groupBy("a").agg(F.sum("n").alias("n"))
    of = components(found.select("a", "b"))
    own = classes.select(F.col("k").alias("rep"), "label", "v", "m")
    of = own.join(links, own.rep == links.a, "left").join(of, own.rep == of.node, "left").select("label", "v", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    named = part.join(of, ["label", "v"]).select("k", "n_links", "component")
    names = rows.select(F.col("k").alias("component"), F.col("vec_id").alias("component_id")).distinct()
    named = named.join(names, "component").select("k", "n_links", "component_id", (F.col("k") == F.col("component")).alias("first"), F.lit(True).alias("found"))
    out = rows.select("vec_id", "k").join(named, "k", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("kept"))
