import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quaero.operators import index, search, store
from quaero.operators.index import Index
from quaero.operators.store import StoredIndex
from quaero.plans.question import understand
from quaero.streaming import rounds
from quaero.streaming.rounds import Snapshots, corpus_of, index_round

NOW = dt.datetime(2026, 9, 28, 12)
SCHEMA = "doc_id long, source string, path string, title string, kind string, mtime timestamp_ntz, text string, url string, extra_text string, error string"
WORDS = "brug ketel incasso factuur tender fiets huis boot trein lamp".split()


def documents(spark, texts):
    return spark.createDataFrame([(i, "map", f"p{i}", f"titel {i}", ("tekst", "mail")[i % 2], dt.datetime(2026, 1 + i % 9, 1), t, "", "", "") for i, t in sorted(texts.items())], SCHEMA)


def text(r, most=30):
    return " ".join(r.choice(WORDS[: 1 + r.randrange(10)]) for _ in range(r.randrange(most)))


def same(spark, stored, texts, terms=("brug", "ketel", "lamp", "fiets brug")):
    """The stored index says the same as a scan of the documents as they should be."""
    opened = stored.open()
    found = lambda i: {r.doc_id: round(r.score, 9) for r in search.match(i, list(terms)).collect()}
    held = documents(spark, texts) if texts else spark.createDataFrame([], SCHEMA)
    assert found(opened) == found(Index(held))
    assert (opened.stored.manifest.n, {r.doc_id: r.text for r in opened.corpus.collect()}) == (len(texts), texts)
    return opened


def test_rounds_deaths_and_merges(spark, tmp_path):
    r = random.Random(2)
    stored, texts = StoredIndex(spark, f"file://{tmp_path}/i"), {}
    for turn in range(7):
        new = {i: text(r) for i in r.sample(range(40), 6)}
        gone = [] if turn < 2 else r.sample(sorted(texts), 2)
        new = {i: t for i, t in new.items() if i not in gone}
        stored.add(documents(spark, new), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        texts = {i: t for i, t in texts.items() if i not in gone} | new
    opened = same(spark, stored, texts)
    now = opened.stored.manifest
    assert len(now.layers) < store.TIER and now.next_layer > 8
    state = opened.stored.status().first()
    assert (state.n_documents, state.n_sources, state.n_errors, state.n_layers) == (len(texts), 1, 0, len(now.layers))
    # a question reads its terms' buckets, and documents by key: nothing else of the texts
    plan = opened.stored.documents(opened.stored.top(["brug"], 5))._jdf.queryExecution().toString()
    assert "bucket#" in plan.split("PartitionFilters")[1] and "In(doc_id" in plan


def test_pruned_search_finds_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ZONE_DOCS", 4)
    r = random.Random(7)
    texts = {i: text(r, 8) + " leeg" * r.randrange(200) for i in range(400)}
    stored = StoredIndex(spark, f"file://{tmp_path}/i")
    stored.add(documents(spark, texts))
    stored.add(documents(spark, {i: "brug brug brug" for i in range(400, 404)}), spark.createDataFrame([(3,), (5,)], "doc_id long"))
    opened = stored.open().stored
    for terms, k, wanted in ((["brug"], 5, None), (["brug", "lamp", "trein"], 10, None), (["lamp", "nergens"], 3, F.col("kind") == "mail"), (["boot"], 500, None)):
        rows = lambda prune: [(x.doc_id, round(x.score, 9)) for x in opened.top(terms, k, wanted, prune)]  # noqa: B023, E731
        assert rows(True) == rows(False) and rows(True)
        if k < 500:
            assert opened.pruned.scored < opened.pruned.zones


def seen(snapshots, n):
    """Round n of three documents: n changes, one stays, one goes."""
    schema = "source string, path string, size long, mtime timestamp_ntz, content binary"
    rows = [("map", "stays.txt", 5, dt.datetime(2026, 1, 1), b"brug ketel"), ("map", "changes.txt", 10 + n, dt.datetime(2026, 1, 1), f"lamp nummer{n}".encode()), ("map", f"only{n}.txt", 4, dt.datetime(2026, 1, 1), b"fiets brug")]
    return rounds.run_round(snapshots, snapshots.spark.createDataFrame(rows, schema))


def equal(snapshots, stored):
    want = {(x.path, x.text) for x in snapshots.documents().collect()}
    opened = stored.open()
    assert {(x.path, x.text) for x in opened.corpus.collect()} == want and opened.stored.manifest.n == len(want)
    scan = {x.doc_id: round(x.score, 9) for x in search.match(Index(corpus_of(snapshots.documents())), ["brug", "nummer3", "fiets brug"]).collect()}
    assert {x.doc_id: round(x.score, 9) for x in search.match(opened, ["brug", "nummer3", "fiets brug"]).collect()} == scan


def test_clear_crash_repeat_and_resume(spark, tmp_path, monkeypatch):
    snapshots, stored = Snapshots(spark, f"file://{tmp_path}/s"), StoredIndex(spark, f"file://{tmp_path}/i")
    assert index_round(snapshots, stored) == 0 and stored.open().corpus.count() == 0
    seen(snapshots, 1)
    assert index_round(snapshots, stored) == 1
    stored.clear()
    assert stored.open().corpus.count() == 0 and search.match(stored.open(), ["brug"]).count() == 0
    seen(snapshots, 2)
    assert index_round(snapshots, stored) == 2  # rounds 1 and 2 come back
    equal(snapshots, stored)
    seen(snapshots, 3)
    with monkeypatch.context() as m:  # dies after the tables, before the commit
        m.setattr(StoredIndex, "_commit", lambda *_: (_ for _ in ()).throw(OSError("stroom weg")))
        with pytest.raises(OSError):
            index_round(snapshots, stored)
    assert index_round(snapshots, stored) == 1 and index_round(snapshots, stored) == 0
    equal(snapshots, stored)
    stored.clear()
    stored.clear()
    assert index_round(snapshots, stored) == 3
    snapshots.clear()
    assert snapshots.documents().count() == 0
    assert index_round(snapshots, stored) == 1 and stored.open().corpus.count() == 0
    assert seen(snapshots, 4)["added"] == 3
    index_round(snapshots, stored)
    equal(snapshots, stored)


def test_stored_question_with_fragment_and_fuzzy(spark, tmp_path):
    stored = StoredIndex(spark, f"file://{tmp_path}/i")
    stored.add(documents(spark, {1: "de brug over het water " * 60, 2: "ketel"}))
    found, told = search.Searcher(stored.open()).search("brugg", NOW)
    assert told.fuzzy == ["brug"] and [x.doc_id for x in found.collect()] == [1]
    found, told = search.Searcher(stored.open()).search("de brug in februari", NOW)
    first = found.first()
    assert first.doc_id == 1 and first.why.startswith("brug (in the text), 01-02-2026 falls in") and "brug over het water" in first.snippet
    assert [x.doc_id for x in search.rank(Index(documents(spark, {1: "x brug", 3: "y"})), understand("brug", NOW), NOW).collect()] == [1]


def test_a_layer_holds_each_text_once_and_zones_that_two_batches_share_are_one(spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stored = StoredIndex(spark, f"file://{tmp_path}/index")
        made = stored.add(documents(spark, {i: "brug ketel" for i in range(40)}))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    opened = stored.open().stored
    assert "entries" not in opened.table("docs").columns and not (tmp_path / "index" / "chunks").exists()
    zones = opened.zones(["brug"]).collect()
    assert sum(z.docs for z in zones) == 40 and len({(z.layer, z.zone) for z in zones}) == len(zones) < opened.table("zones").filter("term = 'brug'").count()
    assert made.n == 40 and made.total == sum(r.n for r in opened.table("postings").select(F.size("places").alias("n")).collect())


def test_a_layer_has_no_zone_files_and_narrow_places(spark, tmp_path):
    texts = {i: text(random.Random(i), 12) + " brug" * (1 + i % 3) for i in range(60)}
    stored = StoredIndex(spark, f"file://{tmp_path}/i")
    stored.add(documents(spark, texts))
    opened, corpus = stored.open().stored, documents(spark, texts)
    assert not (tmp_path / "i" / "zones").exists() and opened.table("postings").schema["places"].dataType.simpleString() == "array<int>"
    own = lambda table: {(r.doc_id, r.term, r.tf, *r.places) for r in table.collect()}
    assert own(opened.table("postings")) == own(index.postings(corpus)) and opened.frequencies(["brug", "nergens"]) == {"brug": 60}
    assert sum(z.docs for z in opened.zones(["brug"]).collect()) == 60
