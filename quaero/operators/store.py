"""A stored index that rounds keep up, and questions that read only what they need of it.

Tables below the folder, each in directories by layer:

* ``docs``: documents, in buckets by a hash of the id, sorted by id. A document is found by its key; its chunks and its entries (terms, weights,
  places) are made from its text where they are needed.
* ``postings``: a row for each term of each document with all that a score and the filters need, in buckets by a hash of the term, sorted by
  term and zone. A zone is a part of a layer's documents that have about the same length.
  ``zones`` are no files of their own: for each term and zone, the number of documents, the greatest weight and the least length are counted from three columns
  of the postings when a question is asked. No document of the zone can score more than these would.
* ``dead`` and ``lost``, by version: which documents of which layer no longer count, and how many documents a term has lost by that.
* ``manifests``: the commit log. One row, in one file that appears whole or not at all, for each version: its layers, its dead, how
  many documents and tokens are alive, and which round it has taken over. What no manifest names does not exist, so a run that dies is simply run again.

One writer at a time. A reader stays with the version that it has opened; nothing that a version names is ever changed.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.functions.vocabulary import BM25_B, BM25_K1, FRAGMENTS
from quaero.operators.index import CORPUS, Index, chunk_table, with_entries

#: Documents of a bucket of documents, and of a bucket of postings, on the average.
BUCKET_DOCS = 65_536
TERM_BUCKET_DOCS = 8_192
#: Parts of a bucket of documents, which are written and read side by side.
DOC_PARTS = 8
#: Documents that a common term's postings are cut by, and how a term is known to be common: from this share of so many documents on.
COMMON_DOCS = 262_144
COMMON_SHARE, COMMON_SAMPLE = 0.02, 4_096
#: Most ids of dead documents that are sent to every executor.
BROADCAST_DEAD = 2_000_000
#: Documents of a zone: lengths in bands of a twelfth (ten octaves of eight bands are taken as usual), each cut by a hash.
ZONE_DOCS = 256
BANDS = 8
USUAL_BANDS = 20
#: From so many zones on, bounds are looked at before scores: below, reading everything is one job and done sooner.
PRUNE_ZONES = 1_000
#: Layers of one size class (powers of this number) that are merged into one.
TIER = 4


@dataclass(frozen=True)
class Layer:
    layer: int
    n: int
    doc_buckets: int
    term_buckets: int
    cuts: int

    @property
    def tier(self) -> int:
        return int(math.log(max(self.n, 1), TIER))


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    taken: int = 0
    n: int = 0
    total: int = 0
    next_layer: int = 1
    layers: tuple[Layer, ...] = ()
    dead: tuple[int, ...] = field(default=())


def sized(layer: int, n: int) -> Layer:
    up = lambda each: max(1, -(-n // each))
    return Layer(layer, n, up(BUCKET_DOCS), up(TERM_BUCKET_DOCS), up(ZONE_DOCS * USUAL_BANDS))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)).cast("int")


def _bucket_of(key, buckets: int) -> int:
    """The same on the driver."""
    return zlib.crc32(str(key).encode()) % buckets


def _zone(doc_id: Column, length: Column, cuts: int) -> Column:
    band = F.floor(F.log2(length + F.lit(1.0)) * BANDS)
    return (band * cuts + F.pmod(F.crc32(F.concat(F.lit("z"), doc_id.cast("string")).cast("binary")), F.lit(cuts))).cast("int")


def one_of(column: str, values: Sequence) -> Column:
    """``column IN values``, in parts small enough that a scan compares each value with the bounds of its row groups and pages."""
    parts = [values[i : i + 10] for i in range(0, len(values), 10)]
    return reduce(or_, (F.col(column).isin(*p) for p in parts), F.lit(False)) if len(parts) > 1 else F.col(column).isin(*values) if values else F.lit(False)


class StoredIndex:
    """The writer's side: rounds, clearing, merging."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ the log

    def manifest(self) -> Manifest:
        try:
            row = self.spark.read.schema("version int, manifest string").json(f"{self.path}/manifests").filter("manifest IS NOT NULL").orderBy(F.desc("version")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        if row is None:
            return Manifest()
        held = json.loads(row["manifest"])
        return Manifest(**(held | {"layers": tuple(Layer(**x) for x in held["layers"]), "dead": tuple(held["dead"])}))

    def _commit(self, manifest: Manifest) -> Manifest:
        row = (manifest.version, json.dumps(asdict(manifest)))
        self.spark.createDataFrame([row], "version int, manifest string").coalesce(1).write.mode("append").json(f"{self.path}/manifests")
        return manifest

    def open(self) -> Index:
        """The index as it is now."""
        opened = Opened(self.spark, self.path, self.manifest())
        return Index(opened.corpus(), opened)

    # ------------------------------------------------------------ writing

    def _at(self, name: str, layer: int) -> str:
        return f"{self.path}/{name}/layer={layer}"

    def _write(self, rows: DataFrame, to: str, *order: str) -> None:
        """Sorted within the buckets' directories."""
        rows.sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(to)

    def _common(self, docs: DataFrame, n: int) -> list[str]:
        """Terms that many documents hold, by a sample; what it says decides about the size of tasks only."""
        if n <= COMMON_DOCS:
            return []
        some = docs.filter(F.pmod(F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary")), F.lit(max(1, n // COMMON_SAMPLE))) == 0)
        terms = with_entries(some.select("doc_id", "title", "extra_text", "text")).select(F.explode("entries.term").alias("term"))
        return [r["term"] for r in terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= COMMON_SHARE * COMMON_SAMPLE).select("term").collect()]

    def _write_layer(self, corpus: DataFrame, own: Layer) -> tuple[int, int]:
        """All tables of a layer; returns its documents and tokens. A text is shuffled once and a posting once."""
        at = self._at("docs", own.layer)
        bucket, part = _bucket(F.col("doc_id"), own.doc_buckets), F.pmod(F.xxhash64("doc_id"), F.lit(DOC_PARTS))
        self._write(corpus.repartition(bucket, part).withColumn("bucket", bucket), at, "doc_id")
        docs = self.spark.read.schema(corpus.schema).parquet(at)
        linked = F.coalesce(F.col("url") != "", F.lit(False)).alias("linked")
        rows = with_entries(docs.select("doc_id", "kind", "mtime", linked, "title", "extra_text", "text"), drop=("title", "extra_text", "text"))
        rows = rows.select("doc_id", "length", "kind", "mtime", "linked", F.explode("entries").alias("e")).select("*", "e.*").drop("e")
        # a common term has as many rows as there are documents, and these are cut
        bucket, common = _bucket(F.col("term"), own.term_buckets), self._common(docs, own.n)
        cut = F.when(F.col("term").isin(common), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(-(-own.n // COMMON_DOCS)))).otherwise(0) if common else F.lit(0)
        rows = rows.repartition(bucket, cut).select("*", F.size("places").alias("tokens"), _zone(F.col("doc_id"), F.col("length"), own.cuts).alias("zone"), bucket.alias("bucket"))
        self._write(rows, self._at("postings", own.layer), "term", "zone", "doc_id")
        stored = self.spark.read.schema("tokens int").parquet(self._at("postings", own.layer))
        return docs.count(), stored.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def add(self, corpus: DataFrame, gone: DataFrame | None = None, taken: int | None = None) -> Manifest:
        """A layer of new and changed documents; those of earlier layers with their ids, and with the ``doc_id`` of lost ones, are dead.
        ``taken`` is the round that the index then stands at. A layer of a document twice counts it twice."""
        now = self.manifest()
        version = now.version + 1
        corpus = corpus.select(*CORPUS)
        own = sized(now.next_layer, corpus.count())
        added = self._write_layer(corpus, own) if own.n else (0, 0)
        dead, lost = now.dead, (0, 0)
        if now.layers:
            # of the corpus only the ids, which are read from the layer
            ids = self.spark.read.schema(corpus.schema).parquet(self._at("docs", own.layer)).select("doc_id") if own.n else None
            for more in (None if gone is None else gone.select("doc_id"),):
                ids = more if ids is None else ids if more is None else ids.unionByName(more)
            if ids is not None:
                lost = self._bury(Opened(self.spark, self.path, now), ids.distinct(), version)
                dead = (*now.dead, version) if lost[0] else now.dead
        layers = (*now.layers, own) if own.n else now.layers
        new = Manifest(version, now.taken if taken is None else taken, now.n - lost[0] + added[0], now.total - lost[1] + added[1], own.layer + 1, layers, dead)
        return self._merge(self._commit(new))

    def _bury(self, opened: Opened, ids: DataFrame, version: int) -> tuple[int, int]:
        """Write which live documents have one of the ids, and how many documents their terms lose; returns their number and tokens."""
        at, own = f"{self.path}/dead/version={version}", ["layer", "doc_id"]
        opened.live("docs").select(*own).join(ids, "doc_id", "left_semi").select(*own).write.mode("overwrite").parquet(at)
        dead = self.spark.read.schema(opened.table("docs").select(*own).schema).parquet(at)
        n = dead.count()
        # texts stay where they are unless very many are dead
        texts = opened.table("docs").select(*own, "title", "extra_text", "text").join(F.broadcast(dead) if n <= BROADCAST_DEAD else dead, own, "left_semi")
        terms = with_entries(texts.select("layer", "title", "extra_text", "text"), drop=("title", "extra_text", "text")).select("layer", F.explode("entries").alias("e"))
        lost = terms.groupBy("layer", F.col("e.term").alias("term")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("e.places")).alias("tokens"))
        at = f"{self.path}/lost/version={version}"
        lost.write.mode("overwrite").parquet(at)
        return n, self.spark.read.schema("tokens long").parquet(at).agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]

    def _merge(self, now: Manifest) -> Manifest:
        """Layers of one size class become one when there are ``TIER`` of them, and so on upwards: n documents are rewritten about log n times, and
        a question meets about log n layers. The dead of merged layers go for good."""
        tiers = defaultdict(list)
        for layer in now.layers:
            tiers[layer.tier].append(layer)
        full = next((own for _, own in sorted(tiers.items()) if len(own) >= TIER), None)
        if full is None:
            return now
        gone = {x.layer for x in full}
        opened = Opened(self.spark, self.path, now)
        old = opened.live("docs").filter(F.col("layer").isin(*gone)).drop("layer", "bucket")
        own = sized(now.next_layer, old.select("doc_id").count())
        if own.n:
            self._write_layer(old, own)
        version, dead = now.version + 1, now.dead
        if dead:
            left = opened.dead.filter(~F.col("layer").isin(*gone))
            left.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/dead/version={version}")
            opened.lost.filter(~F.col("layer").isin(*gone)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/lost/version={version}")
            dead = (version,)
        layers = (*(x for x in now.layers if x.layer not in gone), *((own,) if own.n else ()))
        return self._merge(self._commit(Manifest(version, now.taken, now.n, now.total, own.layer + 1, layers, dead)))

    def replace(self, corpus: DataFrame, taken: int = 0) -> Manifest:
        """An index of this corpus alone, in place of all that was. If the run dies, the index is as it was."""
        now, corpus = self.manifest(), corpus.select(*CORPUS)
        own = sized(now.next_layer, corpus.count())
        n, total = self._write_layer(corpus, own) if own.n else (0, 0)
        return self._commit(Manifest(now.version + 1, taken, n, total, own.layer + 1, (own,) if own.n else (), ()))

    def clear(self) -> Manifest:
        """Nothing counts any more, and no round is taken over: the next ``index_round`` builds the index anew from the snapshots."""
        now = self.manifest()
        return self._commit(Manifest(now.version + 1, 0, 0, 0, now.next_layer, (), ()))

    def text(self, doc_id, most: int) -> str:
        """A document's text put together from its stored chunks, up to ``most`` characters."""
        opened = Opened(self.spark, self.path, self.manifest())
        rows = chunk_table(opened.live("docs", [doc_id])).orderBy("ord").limit(most)
        return "\n".join(r["text"] for r in rows.collect())[:most]


@dataclass
class Pruned:
    """How many zones a question's terms have, and how many had to be scored."""

    zones: int = 0
    scored: int = 0


class Opened:
    """The reader's side of one version."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.pruned = Pruned()
        self._tables: dict[str, DataFrame] = {}

    @property
    def mean(self) -> float:
        return self.manifest.total / self.manifest.n if self.manifest.n else 1.0

    def table(self, name: str) -> DataFrame:
        """A table's layers, dead documents and all; the files are listed once. ``zones`` are what bounds need of the postings."""
        if name == "zones":
            return self.table("postings").select("layer", "bucket", "term", "zone", "tf", "length", F.lit(1).alias("docs"))
        if name not in self._tables:
            self._tables[name] = self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/layer={x.layer}" for x in self.manifest.layers))
        return self._tables[name]

    def _dead_table(self, name: str, schema: str) -> DataFrame:
        if not self.manifest.dead:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*(f"{self.path}/{name}/version={v}" for v in self.manifest.dead))

    @cached_property
    def dead(self) -> DataFrame:
        return self._dead_table("dead", f"layer int, doc_id {self.table('docs').schema['doc_id'].dataType.simpleString()}")

    @cached_property
    def lost(self) -> DataFrame:
        return self._dead_table("lost", "layer int, term string, docs long, tokens long")

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.dead, ["layer", "doc_id"], "left_anti") if self.manifest.dead else rows

    def _in_buckets(self, keys: Iterable, buckets: str) -> Column:
        """The directories where rows of the keys are: nothing else is listed in the scan."""
        by: dict[int, list[int]] = defaultdict(list)
        for x in self.manifest.layers:
            by[getattr(x, buckets)].append(x.layer)
        keys = list(keys)
        return reduce(or_, (F.col("layer").isin(*layers) & F.col("bucket").isin(*sorted({_bucket_of(k, n) for k in keys})) for n, layers in by.items()), F.lit(False))

    def live(self, name: str, keys: Sequence | None = None) -> DataFrame:
        """The rows of live documents of ``docs``: all, or those of some ids."""
        rows = self.table(name)
        if keys is not None:
            rows = rows.filter(self._in_buckets(keys, "doc_buckets") & one_of("doc_id", list(keys)))
        return self._alive(rows)

    def corpus(self) -> DataFrame:
        if not self.manifest.layers:
            return self.spark.createDataFrame([], ", ".join(f"{c} {'timestamp_ntz' if c == 'mtime' else 'string'}" for c in CORPUS))
        return self.live("docs").select(*CORPUS)

    # ------------------------------------------------------------ terms

    def rows(self, words: Sequence[str]) -> DataFrame:
        """Postings of live documents for the words."""
        return self._alive(self._of("postings", words))

    def _of(self, name: str, words: Sequence[str]) -> DataFrame:
        return self.table(name).filter(self._in_buckets(words, "term_buckets") & one_of("term", list(words)))

    def weighted(self, terms: Sequence[str]) -> DataFrame:
        """``term, layer, doc_id, tf, length, kind, mtime, linked`` of each document that holds a term; a term of several words is a phrase."""
        own = ["term", "layer", "doc_id", "tf", "length", "kind", "mtime", "linked"]
        rows = self.rows(sorted({w for t in terms for w in t.split(" ")}))
        found = rows.filter(F.col("term").isin(*terms)).select(*own)
        for term in terms:
            if " " in term:
                found = found.unionByName(phrases(rows, term).select(*own))
        return found

    def frequencies(self, terms: Sequence[str]) -> dict[str, int]:
        """In how many live documents each term occurs; terms that occur in none are left out. For words this counts rows by one column, and reads what was lost."""
        words, found = [t for t in terms if " " not in t], {}
        if not self.manifest.layers:
            return found
        if words:
            zones = self._of("zones", words).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
            if self.manifest.dead:
                lost = self.lost.filter(one_of("term", words) & F.col("layer").isin(*(x.layer for x in self.manifest.layers)))
                zones = zones.unionByName(lost.groupBy("term").agg((-F.sum("docs")).alias("docs"))).groupBy("term").agg(F.sum("docs").alias("docs"))
            found = {r["term"]: r["docs"] for r in zones.collect()}
        if spoken := [t for t in terms if " " in t]:
            found |= {r["term"]: r["docs"] for r in self.weighted(spoken).filter(one_of("term", spoken)).groupBy("term").agg(F.count(F.lit(1)).alias("docs")).collect()}
        return {t: n for t, n in found.items() if n > 0}

    def zones(self, words: Sequence[str]) -> DataFrame:
        return self._of("zones", words).groupBy("layer", "term", "zone").agg(F.sum("docs").alias("docs"), F.max("tf").alias("tf"), F.min("length").alias("length"))

    def _score(self, holding: dict[str, int]) -> Column:
        """BM25 of a row with ``term, tf, length``."""
        idf = F.lit(0.0)
        for term, n in holding.items():
            idf = F.when(F.col("term") == term, F.lit(inverse_frequency(self.manifest.n, n))).otherwise(idf)
        return idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / self.mean))

    def scores(self, terms: Sequence[str]) -> DataFrame:
        """``doc_id, score`` of every document that holds one of the terms."""
        holding = self.frequencies(terms) if terms else {}
        if not holding:
            return self.corpus().select("doc_id", F.lit(0.0).alias("score")).filter(F.lit(False))
        return self.weighted(list(holding)).groupBy("doc_id").agg(F.sum(self._score(holding)).alias("score"))

    def top(self, terms: Sequence[str], k: int, wanted: Column | None = None, prune: bool | None = None) -> list[Row]:
        """``doc_id, score`` of the k best documents that hold a term and are ``wanted`` (a condition on kind, mtime and linked), ties by id.

        The zones with the greatest bounds are scored first. Their k-th score is a threshold: a zone whose bound lies below holds none of
        the k best, and its postings are not read. Without ``prune`` (or if that is not given, in a small index) all are; the result is the same."""
        holding = self.frequencies(terms) if terms else {}
        if not holding:
            return []
        best = lambda rows: self._best(rows, holding, k, wanted)
        rows = self.weighted(list(holding))
        prune = self.manifest.n > PRUNE_ZONES * ZONE_DOCS if prune is None else prune
        if not prune or any(" " in t for t in holding):
            return best(rows)
        bounds = self.zones(list(holding)).select("layer", "zone", self._score(holding).alias("bound")).groupBy("layer", "zone").agg(F.sum("bound").alias("bound"))
        first = 2 * -(-k // ZONE_DOCS) + 8
        ahead = bounds.orderBy(F.desc("bound"), "layer", "zone").limit(first + 1).collect()
        posted = self.rows(list(holding))
        if len(ahead) <= first:
            self.pruned = Pruned(len(ahead), len(ahead))
            return best(posted)
        found = best(posted.filter(reduce(or_, ((F.col("layer") == r["layer"]) & (F.col("zone") == r["zone"]) for r in ahead[:first]))))
        if len(found) < k:
            self.pruned = Pruned(n := bounds.count(), n)
            return best(posted)
        enough = F.col("bound") >= found[-1]["score"] - 1e-8  # scores are compared in nine decimals
        kept = bounds.filter(enough)
        self.pruned = Pruned(*bounds.agg(F.count(F.lit(1)), F.count_if(enough)).first())
        return best(posted.join(kept.select("layer", "zone"), ["layer", "zone"], "left_semi"))

    def _best(self, rows: DataFrame, holding: dict[str, int], k: int, wanted: Column | None) -> list[Row]:
        rows = rows if wanted is None else rows.filter(wanted)
        scored = rows.groupBy("doc_id").agg(F.sum(self._score(holding)).alias("score"))
        return scored.orderBy(F.round("score", 9).desc(), "doc_id").limit(k).collect()

    # ------------------------------------------------------------ documents of results

    def documents(self, found: list[Row], fragments: bool = False) -> DataFrame:
        """The documents of ``top``'s rows with their ``score``, read by their keys; with ``fragments`` the longest of each one's first chunks."""
        ids = [r["doc_id"] for r in found]
        if not ids:
            return self.corpus().withColumns({"score": F.lit(0.0), **({"fragment": F.lit("")} if fragments else {})}).filter(F.lit(False))
        kind = self.table("docs").schema["doc_id"].dataType
        scores = self.spark.createDataFrame([(r["doc_id"], r["score"]) for r in found], T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))
        # as many rows as results were asked for
        docs = self.live("docs", ids).select(*CORPUS).join(F.broadcast(scores), "doc_id")
        if not fragments:
            return docs
        parts = chunk_table(self.live("docs", ids)).filter(F.col("ord") < FRAGMENTS).groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("fragment"))
        return docs.join(F.broadcast(parts), "doc_id", "left").withColumn("fragment", F.coalesce("fragment", F.lit("")))

    def status(self) -> DataFrame:
        """One row: documents, chunks, sources, errors, layers and dead documents."""
        docs, chunks = self.live("docs"), chunk_table(self.live("docs"))
        counts = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("error") != "").alias("n_errors"))
        return counts.crossJoin(chunks.agg(F.count(F.lit(1)).alias("n_chunks"))).withColumns({"n_layers": F.lit(len(self.manifest.layers)), "n_dead": F.lit(self.dead.count() if self.manifest.dead else 0)})


def inverse_frequency(n: int, holding: int) -> float:
    """ln((N - n + 0.5) / (n + 0.5)), or next to nothing for a term in half of the documents or more."""
    raw = math.log((n - holding + 0.5) / (holding + 0.5))
    return raw if raw > 0 else 1e-6


def phrases(rows: DataFrame, term: str) -> DataFrame:
    """Postings of a phrase from those of its words, with the columns of ``rows`` but for places."""
    from quaero.operators.search import phrase_places

    parts = term.split(" ")
    held = [F.first(c).alias(c) for c in ("length", "kind", "mtime", "linked")]
    own = rows.filter(F.col("term").isin(*set(parts))).groupBy("layer", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"), *held)
    return own.withColumns({"term": F.lit(term), "tf": phrase_places(F.col("at"), parts)}).filter("tf > 0").drop("at")
