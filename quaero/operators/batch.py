"""Many questions at once: understood as a table, matched by joins on their terms and their periods.

A period is a range of dates, and a join by ranges would compare every document with every question. Dates are therefore cut into buckets of
``BUCKET_DAYS``: a question stands in each bucket that its period touches, and in one for documents without a date, which fit any period. Postings are
joined on (term, bucket), and the exact bounds are compared only there. Questions without a period are joined on the term.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.functions import dates
from quaero.functions.vocabulary import RECENT_BOOST, RESULTS, UNDATED_FACTOR
from quaero.operators import search
from quaero.operators.store import Opened
from quaero.plans.question import understand_all
from quaero.scratch import materialise

BUCKET_DAYS = 32
UNDATED = -(1 << 30)


def _bucket(moment: Column) -> Column:
    return F.floor(F.unix_date(moment.cast("date")) / BUCKET_DAYS).cast("int")


def understood(questions: DataFrame, now: dt.datetime) -> DataFrame:
    """``qid, kind, first, last, terms`` of rows ``qid, question``; ``first`` and ``last`` are null without a period, ``terms`` are the index's."""
    return questions.select("qid", understand_all(F.col("question"), now).alias("u")).select("qid", "u.kind", "u.first", "u.last", F.col("u.index_terms").alias("terms"))


def answers(opened: Opened, questions: DataFrame, now: dt.datetime, limit: int = RESULTS) -> DataFrame:
    """``qid, rank, doc_id, score``: for each question (``qid``, ``question``) its best documents by BM25 with the bonus for recent ones and the factor for
    undated ones under a period, after the filters of kind and period; ties by id. Questions without a match have no rows."""
    asked = materialise(understood(questions, now), "questions")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    columns = ["term", "layer", "doc_id", "tf", "length", "kind", "mtime", "linked"]
    rows = opened._alive(opened.table("postings")).join(terms, "term", "left_semi").select(*columns)
    # phrases come from the synonyms, which are a fixed list
    spoken = [r["term"] for r in terms.filter(F.contains("term", F.lit(" "))).collect()]
    if spoken:
        rows = rows.unionByName(opened.weighted(spoken).filter(F.col("term").isin(*spoken)).select(*columns))
    rows = materialise(rows, "asked-postings")
    holding = rows.groupBy("term").agg(F.count(F.lit(1)).alias("holding"))

    wants = asked.select("qid", F.col("kind").alias("asked_kind"), "first", "last", F.explode("terms").alias("term"))
    spans = F.concat(F.array(F.lit(UNDATED)), F.sequence(_bucket(F.col("first")), _bucket(F.col("last"))))
    dated = wants.filter("first IS NOT NULL").withColumn("bucket", F.explode(spans))
    placed = rows.withColumn("bucket", F.coalesce(_bucket(F.col("mtime")), F.lit(UNDATED)))
    fits = F.col("mtime").isNull() | F.col("mtime").between(F.col("first"), F.col("last"))
    within = placed.join(dated, ["term", "bucket"]).filter(fits).drop("bucket")
    found = within.unionByName(rows.join(wants.filter("first IS NULL"), "term"))
    kind = F.lit(True)
    for name in ("mail", "image", "browser", "file"):
        kind = F.when(F.col("asked_kind") == name, search.kind_filter(name, F.col("linked"))).otherwise(kind)
    n, mean = F.lit(opened.manifest.n), F.lit(opened.mean)
    part = search.bm25(F.col("tf"), search.inverse_frequency(n, F.col("holding")), F.col("length"), mean)
    scored = found.filter(kind).join(holding, "term").groupBy("qid", "doc_id").agg(F.sum(part).alias("score"), F.first("mtime").alias("mtime"), F.first("first").alias("first"))
    score = F.col("score") + F.coalesce(RECENT_BOOST * dates.recency(now, F.col("mtime")), F.lit(0.0))
    score = F.when(F.col("first").isNotNull() & F.col("mtime").isNull(), score * UNDATED_FACTOR).otherwise(score)
    ranked = scored.select("qid", "doc_id", score.alias("score")).withColumn("rank", F.expr("row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id)"))
    return ranked.filter(F.col("rank") <= limit).select("qid", "rank", "doc_id", "score")
