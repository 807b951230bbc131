"""Incremental rounds over a folder of the index, and the same as a stream.

A round compares what a source has now with the stored snapshot: unchanged files are kept (semi join), new and changed
ones are read (anti join), and files a completed source no longer has are marked as gone. The changes are written beside
what is there, then the pointer is moved, so a round that fails leaves the old state whole; it is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaero.operators import index
from quaero.operators.store import StoredIndex
from quaero.sources.files import documents

STORED = "source string, path string, title string, kind string, mtime timestamp_ntz, size long, text string, extra map<string,string>, error string, file_mtime timestamp_ntz, round int"


#: Layers that are read together; then one holds everything again.
LAYERS = 16


class Snapshots:
    """The stored documents in a folder that Spark can reach, as layers: each round that changed something adds the changed rows,
    and a row without contents (``deleted``) for each document that went. ``latest`` names the committed rounds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rounds(self) -> list[tuple[int, str]]:
        """The committed rounds in order, each as "full", "changes", "nothing" or "cleared"."""
        try:
            rows = self.spark.read.schema("round int, holds string").json(f"{self.path}/latest").distinct().collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((r["round"], r["holds"]) for r in rows)

    def number(self) -> int:
        return max((n for n, _ in self.rounds()), default=0)

    def layers(self) -> list[int]:
        """The rounds whose rows make up the present state."""
        own = [(n, holds) for n, holds in self.rounds() if holds != "nothing"]
        full = max((n for n, holds in own if holds in ("full", "cleared")), default=0)
        return [n for n, holds in own if n >= full and holds != "cleared"]

    def clear(self) -> None:
        """Forget all documents; the next round adds everything anew."""
        self._point(self.number() + 1, "cleared")

    def layer(self, number: int) -> DataFrame:
        return self.spark.read.schema(f"{STORED}, deleted boolean").parquet(f"{self.path}/round-{number}")

    def documents(self) -> DataFrame:
        layers = self.layers()
        if not layers:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(f"{STORED}, deleted boolean").parquet(*(f"{self.path}/round-{n}" for n in layers))
        return (rows if len(layers) == 1 else index.newest(rows)).filter("NOT deleted").drop("deleted")

    def commit(self, number: int, fresh: DataFrame, lost: DataFrame) -> DataFrame:
        """Add the changed rows and the keys of lost documents as round ``number``, and return its rows. What is committed before stays
        as it is if this fails."""
        gone = lost.select(*index.KEY).withColumns({"round": F.lit(number), "deleted": F.lit(True)})
        rows = fresh.withColumns({"round": F.lit(number), "deleted": F.lit(False)}).unionByName(gone, allowMissingColumns=True)
        path = f"{self.path}/round-{number}"
        rows.write.mode("overwrite").parquet(path)
        layer = self.layer(number)
        self._point(number, "nothing" if layer.isEmpty() else "changes")
        if len(self.layers()) > LAYERS:
            self.documents().withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{self.path}/round-{number + 1}")
            self._point(number + 1, "full")
        return layer

    def _point(self, number: int, holds: str) -> None:
        self.spark.createDataFrame([(number, holds)], "round int, holds string").coalesce(1).write.mode("append").json(f"{self.path}/latest")


def run_round(snapshots: Snapshots, files: DataFrame, completed: list[str] | None = None, made: Callable[[DataFrame], DataFrame] = documents) -> dict[str, int]:
    """One round over files ``source, path, size, mtime[, content]``, of which ``made`` makes documents; ``completed`` names the sources that were walked to
    the end (default: all seen). Returns the numbers of added, updated, skipped and removed documents and of errors.
    A round writes what has changed; one without changes writes no document."""
    spark, number = snapshots.spark, snapshots.number() + 1
    known = snapshots.documents().select("source", "path", "size", F.col("file_mtime").alias("mtime"))
    names = files.select("source").distinct() if completed is None else spark.createDataFrame([(c,) for c in completed], "source string")
    before = known.count()
    layer = snapshots.commit(number, made(index.to_read(files, known)), index.gone(known, files, names))
    # what was known is read from the layers before this one, by the same names
    old = known.select(*index.KEY, F.lit(True).alias("was"))
    changed = layer.select(*index.KEY, "deleted").join(old, index.KEY, "left").agg(
        F.count_if(~F.col("deleted") & F.col("was").isNull()).alias("added"), F.count_if(~F.col("deleted") & F.col("was").isNotNull()).alias("updated"), F.count_if("deleted").alias("removed")
    ).first().asDict()
    total = before + changed["added"] - changed["removed"]
    errors = snapshots.documents().filter("error <> ''").count()
    return {"added": changed["added"], "updated": changed["updated"], "skipped": total - changed["added"] - changed["updated"], "errors": errors, "documents": total, "removed": changed["removed"]}


def document_id(source: Column, path: Column) -> Column:
    """A name for a document that stays through all rounds."""
    return F.substring(F.sha2(F.concat_ws("\n", source, path).cast("binary"), 256), 1, 32)


def corpus_of(rows: DataFrame) -> DataFrame:
    """Stored documents as a corpus for the index."""
    url = F.when(F.col("kind") == "browser", F.col("path")).otherwise("")
    extra = F.array_join(F.map_values(F.coalesce("extra", F.create_map().cast("map<string,string>"))), " ")
    return rows.select(document_id(F.col("source"), F.col("path")).alias("doc_id"), "source", "path", "title", "kind", "mtime", "text", url.alias("url"), extra.alias("extra_text"), F.coalesce("error", F.lit("")).alias("error"))


def index_round(snapshots: Snapshots, stored: StoredIndex) -> int:
    """Bring the index up to the snapshots, and return how many rounds it has taken over. The commit that adds a round's layer also says that the
    index stands at that round, so a run that dies goes on where it was, and one that is repeated does nothing. An index that has been cleared, or that
    stands before a clearing of the snapshots, is built anew from the documents as they are."""
    done, rounds = stored.manifest().taken, snapshots.rounds()
    ahead = [(n, holds) for n, holds in rounds if n > done]
    if not ahead:
        return 0
    if done == 0 or any(holds == "cleared" for _, holds in ahead):
        stored.replace(corpus_of(snapshots.documents()), taken=ahead[-1][0])
        return len(ahead)
    changes = [n for n, holds in ahead if holds == "changes"]  # a full layer holds what was there before
    for number in changes:
        rows = snapshots.layer(number)
        stored.add(corpus_of(rows.filter("NOT deleted")), rows.filter("deleted").select(document_id(F.col("source"), F.col("path")).alias("doc_id")), taken=number)
    return len(changes)


def stream_rounds(snapshots: Snapshots, files: DataFrame, checkpoint: str) -> StreamingQuery:
    """Rounds over a stream of files (columns as for ``run_round``): each micro-batch is a round that removes nothing.
    The checkpoint remembers which input a stopped query has taken, so it goes on where it was."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        run_round(snapshots, index.newest(rows.withColumn("round", F.lit(0)), "mtime").drop("round"), [])

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def binary_files(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """A stream of the files of a folder with their contents."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    return rows.select(F.lit(source).alias("source"), path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), "content")
