"""Sharding by extendible hashing, in DataFrame operations only.

A document's address is the bit string of a hash of its id. The directory is indexed by address prefixes; it starts
with the empty prefix, and only a bucket over the byte limit splits, on its next bit, until every bucket fits.

The directory is derived from byte counts of *cells* (prefixes a few bits longer than the answer needs), summed with
map-side partial aggregation; the bytes of a bucket at any depth are sums over its cells. Cells that are still over
the limit at the deepest counted level go round again with more bits. Only counts leave the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import materialise

ADDRESS_BITS = 60


def address(key: Column) -> Column:
    """60 address bits of a key: the first 15 hex digits of its MD5, as a bit string. A null key hashes as 'null'."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, 15), 16, 2), ADDRESS_BITS, "0")


def directory(sized: DataFrame, limit: int, slack_bits: int = 4) -> DataFrame:
    """Buckets ``(shard, depth, shard_docs, shard_bytes, oversized)`` for rows ``(address, n_bytes)``.

    ``oversized`` marks a bucket that no further bit can split: one address (one id) holds more than the limit.
    """
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(ADDRESS_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + slack_bits))
    todo, base, found = sized, 0, None
    while True:
        cells = todo.groupBy(F.substring("address", 1, depth).alias("cell")).agg(F.count(F.lit(1)).alias("d"), F.sum("n_bytes").alias("b"))
        levels = cells.select(F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("depth"), "cell", "d", "b")
        sizes = levels.groupBy("depth", F.expr("substring(cell, 1, depth)").alias("shard")).agg(F.sum("d").alias("shard_docs"), F.sum("b").alias("shard_bytes"))
        sizes = materialise(sizes, "directory")
        parents = sizes.filter(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth_"), F.col("shard").alias("parent"))
        fits = sizes.filter(F.col("shard_bytes") <= limit)
        split = fits.join(parents, (fits.depth == parents.depth_) & (F.expr("substring(shard, 1, depth - 1)") == parents.parent), "left_semi")
        leaves = split if base else split.unionByName(fits.filter(F.col("depth") == 0))
        found = leaves if found is None else found.unionByName(leaves)
        over = sizes.filter((F.col("depth") == depth) & (F.col("shard_bytes") > limit))
        if depth == ADDRESS_BITS:
            return found.withColumn("oversized", F.lit(False)).unionByName(over.withColumn("oversized", F.lit(True)))
        if over.isEmpty():
            return found.withColumn("oversized", F.lit(False))
        todo = materialise(todo.join(over.select("shard"), F.substring("address", 1, depth) == over.shard, "left_semi"), "oversized")
        base, depth = depth, min(ADDRESS_BITS, depth + 8)


def shard_documents(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, shard, depth, shard_docs, shard_bytes, oversized``.

    ``shard`` is the bucket's address prefix ('' while one bucket holds everything). Rows with one id share an
    address and thus a shard, whatever their texts; null ids share one address too. A null text has 0 bytes. An empty
    table gives no rows. Other columns of ``docs`` play no part.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), address(F.col(id_col)).alias("address"))
    sized = materialise(sized, "sizes")
    buckets = directory(sized, limit)
    depths = materialise(buckets, "buckets")
    span = depths.agg(F.min("depth"), F.max("depth")).first()
    if span[0] is None:
        return sized.select("doc_id", "n_bytes").join(depths, F.lit(False), "inner")
    # a document meets its bucket at whichever depth the bucket has: one equi-join per row and depth in use
    prefixes = sized.select("doc_id", "n_bytes", F.explode(F.expr(f"transform(sequence({span[0]}, {span[1]}), d -> substring(address, 1, d))")).alias("shard"))
    return prefixes.join(depths, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_docs", "shard_bytes", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` as one folder of Parquet files per shard; a shard's rows are dealt over as many tasks as Spark likes."""
    where = shard_documents(docs, limit, id_col, text_col).select(F.col("doc_id").alias("id_"), F.concat(F.lit("s"), "shard").alias("shard_")).distinct()
    out = docs.join(where, docs[id_col].eqNullSafe(where.id_)).drop("id_")
    out.write.partitionBy("shard_").parquet(path)
