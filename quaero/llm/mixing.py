"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal size. With target weight w, its block j (from 1) is released at slot
floor((j - 1) / w) and due by ceil(j / w). Slots are given by earliest deadline first among the released blocks. With
weights that sum to one this meets every deadline, so after any number of slots each source is less than one block away
from its share. Weights are the given numbers as exact fractions; nothing is rounded.

The slots are scheduled in *frames* of about ``FRAME`` blocks, side by side. A frame needs to know which blocks are done when it starts: all that are
due by then, and some of those in whose window it starts, one bit for each source. All frames first run from a guess; a frame
whose predecessor left other bits than guessed runs again from those, until nothing changes. The first frame is right at
once, so the result is that of one run over all slots. The driver holds the sources with their sizes and a bit for each source and frame;
blocks and documents stay in tables.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import batch_of, in_batches, keyed_rows, materialise

FRAME = 1 << 19
PLAN = "frame long, source int, j long, release long, deadline long, slot long, before long, bits binary"


def shares(weights: Mapping[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in the exact proportion of the positive weights."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(f.denominator for f in exact.values())) if exact else 1
    whole = {s: int(f * scale) for s, f in exact.items()}
    by = math.gcd(*whole.values()) if whole else 1
    return {s: n // by for s, n in whole.items()}


def guess(slot: int, share: list[int], blocks: list[int]) -> list[int]:
    """Blocks of each source done when ``slot`` starts: those due by then, and the next ones by their deadlines."""
    total = sum(share)
    done = [min(n, slot * w // total) for w, n in zip(share, blocks, strict=True)]
    begun = [(-(-(d + 1) * total // w), i) for i, (d, w, n) in enumerate(zip(done, share, blocks, strict=True)) if d < n and d * total // w < slot]
    for _, i in sorted(begun)[: max(0, slot - sum(done))]:
        done[i] += 1
    return done


def run_frame(start: int, stop: int, share: list[int], blocks: list[int], done: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Earliest deadline first over the slots [start, stop): ``(source, j, release, deadline, slot)``; ``done`` is carried on."""
    total = sum(share)
    waiting: list[tuple[int, int]] = []
    for i, (d, w, n) in enumerate(zip(done, share, blocks, strict=True)):
        if d < n and d * total // w < stop:
            waiting.append((d * total // w, i))
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    slot = start
    while slot < stop:
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[i] + 1) * total // share[i]), i))
        if not ready:
            if not waiting:
                return
            slot = waiting[0][0]
            continue
        deadline, i = heapq.heappop(ready)
        yield i, done[i] + 1, done[i] * total // share[i], deadline, slot
        done[i] += 1
        slot += 1
        if done[i] < blocks[i]:
            release = done[i] * total // share[i]
            if release < stop:
                heapq.heappush(waiting, (release, i))


def _bits(slot: int, share: list[int], blocks: list[int], done: list[int]) -> bytes:
    total = sum(share)
    return np.packbits([d > min(n, slot * w // total) for d, w, n in zip(done, share, blocks, strict=True)]).tobytes()


def frame_bounds(share: list[int], blocks: list[int], frame_blocks: int) -> list[int]:
    """Slots where frames begin, and the end: between two of them about ``frame_blocks`` blocks fall due."""
    total, out = sum(share), [0]
    due = lambda slot: sum(min(n, slot * w // total) for w, n in zip(share, blocks, strict=True))
    end = max((-(-n * total // w) for n, w in zip(blocks, share, strict=True)), default=0)
    for m in range(1, -(-sum(blocks) // frame_blocks)):
        lo, hi = out[-1], end
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if due(mid) >= m * frame_blocks else (mid + 1, hi)
        if lo > out[-1]:
            out.append(lo)
    return [*out, end] if end > out[-1] else out


def schedule(spark, share: list[int], sizes: list[int], block_docs: int, frame_blocks: int = FRAME) -> tuple[DataFrame, list[int]]:
    """The plan ``frame, source (number), j, release, deadline, slot, before`` (documents of its frame in earlier slots), and the number of
    documents of each frame."""
    blocks = [-(-n // block_docs) for n in sizes]
    total = sum(share)
    bounds = frame_bounds(share, blocks, frame_blocks)
    frames = len(bounds) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, bits in zip(batch.column("frame").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                start, stop = bounds[frame], bounds[frame + 1]
                more = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(share)).tolist()
                done = [min(n, min(n, start * w // total) + b) for w, n, b in zip(share, blocks, more, strict=True)]
                before, rows = 0, []
                for i, j, release, deadline, slot in run_frame(start, stop, share, blocks, done):
                    rows.append((i, j, release, deadline, slot, before))
                    before += min(block_docs, sizes[i] - (j - 1) * block_docs)
                    if len(rows) == 65_536:
                        yield made(frame, rows)
                        rows = []
                yield made(frame, [*rows, (None, None, None, None, None, before)], _bits(stop, share, blocks, done))

    def made(frame: int, rows: list[tuple], bits: bytes | None = None) -> pa.RecordBatch:
        i, j, release, deadline, slot, before = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True))
        return batch_of(frame=pa.array([frame] * len(rows), pa.int64()), source=i, j=j, release=release, deadline=deadline, slot=slot, before=before, bits=pa.array([None] * (len(rows) - 1) + [bits], pa.binary()))

    starts = {m: _bits(bounds[m], share, blocks, guess(bounds[m], share, blocks)) for m in range(frames)}
    runs: dict[int, tuple[int, int]] = {}  # frame: the run that it was last part of, and its documents
    tables: list[DataFrame] = []
    pending = list(range(frames))
    while pending:
        todo = spark.createDataFrame([(m, bytearray(starts[m])) for m in pending], "frame long, bits binary").repartition(len(pending), "frame")
        tables.append(materialise(todo.transform(in_batches, run, PLAN), "schedule"))
        ends = tables[-1].filter("bits IS NOT NULL").select("frame", "before", "bits").collect()
        pending = []
        for m, docs, bits in ends:
            runs[m] = (len(tables) - 1, docs)
            if m + 1 < frames and bytes(bits) != starts[m + 1]:
                starts[m + 1] = bytes(bits)
                pending.append(m + 1)
    last = spark.createDataFrame([(m, r) for m, (r, _) in runs.items()], "frame_ long, run int")
    plan = spark.createDataFrame([], PLAN).drop("bits")
    for r, table in enumerate(tables):
        rows = table.filter("source IS NOT NULL").drop("bits")
        plan = plan.unionByName(rows if len(tables) == 1 else rows.join(F.broadcast(last.filter(F.col("run") == r)), F.col("frame") == F.col("frame_"), "left_semi"))
    return plan, [runs[m][1] for m in range(frames)]


def source_sizes(docs: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    return {r["source"]: r["n"] for r in docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n")).collect()}


def tempered(sizes: Mapping[str | None, int], power: float) -> dict[str | None, float]:
    """Target weights n ** power: 1 keeps the sources' sizes, 0 makes them equal."""
    return {s: float(n) ** power for s, n in sizes.items() if n > 0}


def _ranked(docs: DataFrame, id_col: str, source_col: str) -> tuple[DataFrame, dict[str | None, int]]:
    """``doc_id, source, at`` (rank in the order by source and id), and where each source begins in that order. A range sort, so that
    a source of any size is spread over tasks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    # monotonically_increasing_id holds the partition in its upper bits and the rank there in its lower 33
    rows = rows.orderBy(F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last()).withColumn("nth", F.monotonically_increasing_id())
    rows = materialise(rows.withColumn("part", F.shiftright("nth", 33)).withColumn("nth", F.col("nth").bitwiseAND((1 << 33) - 1)), "source-order")
    parts = sorted(rows.groupBy("part").count().collect())
    before = [(p, sum(n for _, n in parts[:i])) for i, (p, _) in enumerate(parts)]
    before = docs.sparkSession.createDataFrame(before, "part long, before long")
    return rows.join(F.broadcast(before), "part").select("doc_id", "source", (F.col("before") + F.col("nth")).alias("at"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float], block_docs: int = 64, frame_blocks: int = FRAME, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Deal every row of ``docs`` to a slot of the mixture.

    Returns, per row: ``doc_id, source, source_rank`` (from 0, by id), ``block`` (of its source, from 1), ``release, deadline,
    slot, position`` (place in the whole order, from 0, without gaps) and ``in_mixture``: whether no source has given its last block in
    an earlier slot. Up to there each source is less than one block from its weight. Sources that have run out leave slots to the
    others, whose blocks keep their windows; slots without a released block stay empty. Nothing is dropped.

    Null ids come last in their source; rows that repeat an id get ranks of their own (which of them is which does not show, as they are
    equal in all that is returned). A source without
    a positive weight raises ValueError; weights of absent sources count as if the source had run out before the start.
    Null is a source like others. An empty table gives no rows. Other columns play no part.
    """
    spark = docs.sparkSession
    sizes = source_sizes(docs, source_col)
    share = shares(weights)
    missing = [s for s in sizes if s not in share]
    if missing:
        raise ValueError(f"no target weight for {missing[:5]}")
    names = sorted(share, key=lambda s: (s is None, s or ""))
    plan, docs_of = schedule(spark, [share[s] for s in names], [sizes.get(s, 0) for s in names], block_docs, frame_blocks)
    ranked = _ranked(docs, id_col, source_col)
    first, firsts = 0, []
    for i, s in enumerate(names):
        firsts.append((s, i, first))
        first += sizes.get(s, 0)
    firsts = F.broadcast(spark.createDataFrame(firsts, "source_ string, number int, first long"))
    rows = ranked.join(firsts, ranked.source.eqNullSafe(F.col("source_"))).select("doc_id", "source", "number", (F.col("at") - F.col("first")).alias("source_rank"))
    rows = rows.withColumn("block", F.expr(f"source_rank div {block_docs} + 1"))
    before = spark.createDataFrame([(m, sum(docs_of[:m])) for m in range(len(docs_of))], "frame_ long, earlier long")
    if all(sizes.get(s) for s in names):
        ends = plan.groupBy("source").agg(F.max("slot").alias("slot")).agg(F.min("slot").alias("horizon"))
    else:
        ends = spark.createDataFrame([(-1,)], "horizon long")
    plan = plan.join(F.broadcast(before), F.col("frame") == F.col("frame_")).select(F.col("source").alias("number"), F.col("j").alias("block"), "release", "deadline", "slot", (F.col("earlier") + F.col("before")).alias("start"))
    out = rows.join(plan, ["number", "block"]).crossJoin(F.broadcast(ends))  # one row
    return out.select(
        "doc_id", "source", "source_rank", "block", "release", "deadline", "slot",
        (F.col("start") + F.col("source_rank") % block_docs).alias("position"), (F.col("slot") <= F.col("horizon")).alias("in_mixture"),
    )


def whole_mixture(docs: DataFrame, power: float, block_docs: int) -> DataFrame:
    """Every row of ``docs`` with its columns and ``mixture_position``, its place in the order that mixes the sources
    by n ** power. Null ids come last in their source; rows that repeat id and text share one place and count once, rows that repeat the id
    alone have places of their own. An empty table gives no rows."""
    rows, repeats = keyed_rows(docs)
    rows = rows.select("row", F.col("k").alias("doc_id"), F.col("row.source").cast("string").alias("source"))
    once = rows.select("doc_id", "source")
    once = once.groupBy("doc_id").agg(F.min("source").alias("source")) if repeats else once
    placed = mix_sources(once, tempered(source_sizes(once), power), block_docs).select("doc_id", "position")
    return rows.join(placed, "doc_id").select("row.*", F.col("position").alias("mixture_position"))
