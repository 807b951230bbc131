"""Cases that every operator must take: empty tables, repeated rows and ids, very long texts, other columns with clashing names."""

import public_tokenizers
from pyspark.sql import functions as F

from quaero.llm import bpe, language_id, pivot_index, rp_forest, sharding, toxicity

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = "doc_id long, text string"


def test_toxicity(spark):
    lexicon = toxicity.Lexicon({"grobnik": 6.0})
    rows = [(1, "you grobnik"), (1, "you grobnik"), (2, None), (3, ""), (None, "fine"), (4, "calm words " * 300_000 + "grobnik"), (5, "grobnik " * 50_000)]
    docs = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit("clash") for c in ("score", "predicted", "hits", "words", "total")})
    got = toxicity.score(docs, lexicon)
    assert got.columns == ["doc_id", "score", "predicted", "hits", "words"] and got.count() == len(rows)
    scores = {(x.doc_id, x.score, x.predicted) for x in got.collect()}
    assert len(scores) == 6 and all(0 <= s <= 1 for _, s, _ in scores)
    by = {i: s for i, s, _ in scores}
    # a word counts once however often it stands there, against the length of the text
    assert by[2] == by[3] == by[None] == min(by.values()) and by[1] > by[5] > by[2] and by[4] > by[2]
    assert toxicity.score(docs.limit(0), lexicon).collect() == []
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs.limit(0), labels).weights == {} and toxicity.learn(docs, labels).weights == {}


def test_language_id(spark):
    rows = [(i, ("aei thou " if i % 2 else "öüs chä ") * 10, "ab"[i % 2]) for i in range(60)]
    more = [(1, rows[1][1], "b"), (1, rows[1][1], "b"), (None, rows[2][1], "a"), (90, "aei thou " * 100_000, None), (91, None, None), (92, "", "a")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("lang_pred", "score", "k")})
    net = language_id.learn(docs, per_language=20)
    got = language_id.predict(docs, net).collect()
    assert len(got) == len(rows) + len(more)
    assert {(x.lang_pred, x.score) for x in got if x.doc_id == 1} and len({(x.lang_pred, x.score) for x in got if x.doc_id == 1}) == 1
    assert {x.lang_pred for x in got if x.doc_id in (90, 1)} == {"b"} and {x.lang_pred for x in got if x.doc_id in (91, 92)} == {"und"}
    assert language_id.predict(docs.limit(0), net).collect() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some text"), (1, "some text"), (2, None)], TEXTS).withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "decoded", "k")})
    assert sorted((x.doc_id, x.decoded) for x in bpe.encode_decode(docs, VOCAB).collect()) == [(1, "some text"), (1, "some text"), (2, "")]
    vectors = spark.createDataFrame([(50 * i, [float(i % 3), 1.0, 0.5, float(i)], 1) for i in range(8)], "vec_id long, embedding array<double>, label int")
    odd = vectors.withColumns({c: F.lit("clash") for c in ("k", "v", "m", "space", "list", "id", "d", "leaves", "query", "n_links")})
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(rp_forest.nearest(odd)) == plain(rp_forest.nearest(vectors))
    assert plain(pivot_index.near_duplicates(odd)) == plain(pivot_index.near_duplicates(vectors))


def test_shards_are_written_whole(spark, tmp_path):
    docs = spark.createDataFrame([(i % 40, "x" * (i % 7) * 10) for i in range(120)] + [(None, "no id"), (None, "again"), (7, None)], TEXTS).withColumn("shard", F.lit("clash"))
    sharding.write_shards(docs, f"file://{tmp_path}/s", 400)
    back = spark.read.option("basePath", f"file://{tmp_path}/s").parquet(f"file://{tmp_path}/s")
    key = lambda x: (x.doc_id is None, x.doc_id or 0, x.text is None, x.text or "")
    assert sorted(map(key, back.collect())) == sorted(map(key, docs.collect()))
    where = back.groupBy("doc_id").agg(F.countDistinct("shard_").alias("n")).collect()
    assert {x.n for x in where} == {1}  # rows of one id stay together
    sizes = back.groupBy("shard_").agg(F.sum(F.octet_length("text")).alias("b"), F.countDistinct("doc_id").alias("ids")).collect()
    assert len(sizes) > 1 and all(x.b <= 400 or x.ids == 1 for x in sizes)
