"""Similar words of a vocabulary, by an inverted index of letter pairs.

The measure is that of matching blocks: the longest common run of letters, then the same to its left and to its right; the ratio is
twice the matched letters over both lengths. For a ratio of at least r, words of a and b letters match in m >= r * (a + b) / 2 letters. These make at
most 1 + (a - m) + (b - m) blocks, since between two blocks lies an unmatched letter, and a block of k letters has k - 1 pairs: so the words share at least
3 * m - a - b - 1 of their (numbered) pairs. This is one or more for words of four letters on at the usual cutoff, and nothing is lost by asking for it.

An asked word with p pairs that must share s of them shares one of its p - s + 1 rarest. By those it is joined to the words that hold them and have
a fitting length; then all shared pairs are counted, and only what passes is verified.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.functions.vocabulary import FUZZY_CUTOFF, FUZZY_LENGTH, FUZZY_MATCHES
from quaero.scratch import materialise

ANSWER = "word string, suggestion string, ratio double"


def pairs_of(word: str) -> list[str]:
    """Pairs of neighbouring letters; a pair's second occurrence is another pair than its first."""
    seen: Counter[str] = Counter()
    out = []
    for i in range(len(word) - 1):
        pair = word[i : i + 2]
        seen[pair] += 1
        out.append(f"{pair}{seen[pair]}")
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def letter_pairs(word: pa.Array) -> pa.Array:
    return pa.array([pairs_of(w or "") for w in word.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.DoubleType())
def block_ratio(asked: pa.Array, word: pa.Array) -> pa.Array:
    """The ratio of matching blocks of each pair of words."""
    out, matcher, last = [], difflib.SequenceMatcher(autojunk=False), None
    for a, w in zip(asked.to_pylist(), word.to_pylist(), strict=True):
        if a != last:
            matcher.set_seq2(a)
            last = a
        matcher.set_seq1(w)
        out.append(matcher.ratio())
    return pa.array(out, pa.float64())


def _needed(a: Column, b: Column, cutoff: float) -> Column:
    """How many letter pairs words of a and b letters share at least; never less than one, which the cutoff must allow."""
    m = F.ceil(F.lit(cutoff) * (a + b) / 2 - 1e-9)
    return F.greatest(3 * m - a - b - 1, F.lit(1))


def similar(asked: DataFrame, vocabulary: DataFrame, cutoff: float = FUZZY_CUTOFF, least: int = FUZZY_LENGTH, few: bool = False) -> DataFrame:
    """``word, suggestion, ratio`` for every asked ``word`` of ``least`` letters or more and every other ``word`` of the vocabulary whose ratio is
    at least ``cutoff``. Words that can't reach a shared pair by the rule (``cutoff`` under 0.8, or under four letters) are not promised.

    The vocabulary's pairs are many times its size, which Spark does not foresee: they are never what a join sends to all executors. The asked words' are
    if there are ``few``."""
    reach = cutoff / (2 - cutoff)
    asked = asked.select("word").distinct().withColumn("a", F.length("word")).filter(F.col("a") >= least)
    # a longer word fits none of them, and its pairs would hold it as often as it has letters
    longest = asked.agg(F.max("a")).first()[0] or 0
    asked = asked.withColumn("own", letter_pairs("word"))
    known = vocabulary.select(F.col("word").alias("suggestion"), F.length("word").alias("b")).filter(F.col("b").between(least * reach - 1e-9, longest / reach + 1e-9))
    filed = known.select("suggestion", "b", F.explode(letter_pairs("suggestion")).alias("pair"))
    own = asked.select("word", "a", "own", F.explode("own").alias("pair"))
    sent = F.broadcast if few else lambda rows: rows.hint("merge")
    # rarest first: as many as letters of the script squared
    often = filed.join(sent(own.select("pair").distinct()), "pair", "left_semi").groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.join(often, "pair", "left")
    ranked = ranked.groupBy("word", "a", "own").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("by"))
    # the shortest word that fits asks for the fewest shared pairs, or the next, as the number of letters is rounded up
    fewest = F.least(*(_needed(F.col("a"), F.ceil(F.col("a") * reach - 1e-9) + d, cutoff) for d in range(4)))
    asks = ranked.withColumn("pair", F.explode(F.transform(F.slice("by", F.lit(1), F.greatest(F.size("own") - fewest + 1, F.lit(1)).cast("int")), lambda x: x["pair"]))).drop("by")
    met = filed.join(sent(asks), "pair").filter((F.col("word") != F.col("suggestion")) & F.col("b").between(F.col("a") * reach - 1e-9, F.col("a") / reach + 1e-9))
    met = met.select("word", "a", "own", "suggestion", "b").dropDuplicates(["word", "suggestion"])
    met = met.filter(F.size(F.array_intersect("own", letter_pairs("suggestion"))) >= _needed(F.col("a"), F.col("b"), cutoff))
    return met.select("word", "suggestion", block_ratio("word", "suggestion").alias("ratio")).filter(F.col("ratio") >= cutoff)


def suggestions(words: DataFrame, asked: Sequence[str], cutoff: float = FUZZY_CUTOFF, matches: int = FUZZY_MATCHES) -> DataFrame:
    """``word, suggestion, ratio``: the vocabulary's ``matches`` closest words for each asked word of four letters or more."""
    asked = sorted({w for w in asked if len(w) >= FUZZY_LENGTH})
    spark = words.sparkSession
    if not asked:
        return spark.createDataFrame([], ANSWER)
    # the vocabulary is gone through twice, for how often pairs occur and for the words that hold them, and is made once
    words = materialise(words.select("word"), "vocabulary")
    near = similar(spark.createDataFrame([(w,) for w in asked], "word string"), words, cutoff, few=True)
    near = near.withColumn("nth", F.expr("row_number() OVER (PARTITION BY word ORDER BY ratio DESC, suggestion DESC)"))
    return near.filter(F.col("nth") <= matches).drop("nth")
