"""Search: match, rank, filter, best results with snippet and reason."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.functions import dates
from quaero.functions.language import document_words, fold, stem_word, text_words, variants_of
from quaero.functions.text import ASIDE, snippet, url_similarity
from quaero.functions.vocabulary import BM25_B, BM25_K1, CANDIDATES, ERROR_FACTOR, RECENT_BOOST, RESULTS, TITLE_BOOST, UNDATED_FACTOR, URL_BOOST, WEIGHTS
from quaero.operators.fuzzy import suggestions
from quaero.operators.index import COLUMN, Index, column_tokens
from quaero.plans.question import Question, understand
from quaero.scratch import materialise


def bm25(tf: Column, idf: Column, length: Column, mean: Column) -> Column:
    return idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))


def inverse_frequency(n: Column, holding: Column) -> Column:
    """ln((N - n + 0.5) / (n + 0.5)), or next to nothing for a term in half of the documents or more."""
    raw = F.ln((n - holding + 0.5) / (holding + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(1e-6))


def terms_of(words: Sequence[str]) -> list[str]:
    """The words as the index knows them: their tokens, parted by blanks."""
    return sorted({" ".join(t) for w in words if (t := _tokens(w))})


def match(index: Index, words: Sequence[str]) -> DataFrame:
    """``doc_id, score`` of documents that hold any of the words; a word of several tokens must occur as a phrase."""
    return index.stored.scores(terms_of(words)) if index.stored else _scan(index.corpus, terms_of(words))


def _less(n: int):
    return lambda place: place - n


def phrase_places(at: Column, parts: list[str]) -> Column:
    """The weight of a phrase, from a map of its words to their places: weighted places where they follow each other, without overlaps."""
    found = F.try_element_at(at, F.lit(parts[0]))
    for i, word in enumerate(parts[1:], 1):
        found = F.array_intersect(found, F.transform(F.try_element_at(at, F.lit(word)), _less(i)))
    found = F.array_sort(F.coalesce(found, F.array().cast("array<bigint>")))
    if len(set(parts)) < len(parts):  # only then may places of the phrase overlap
        none = F.array().cast("array<bigint>")
        found = F.aggregate(found, none, lambda kept, p: F.when(F.size(kept) == 0, F.array(p)).when(p >= F.element_at(kept, -1) + len(parts), F.concat(kept, F.array(p))).otherwise(kept))
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS.values()))
    return F.aggregate(found, F.lit(0.0), lambda sum_, p: sum_ + F.get(weights, F.floor(p / COLUMN).cast("int")))


def phrase_from_places(postings: DataFrame, term: str) -> DataFrame:
    """``doc_id, term, tf`` of a phrase, from the postings of its words."""
    parts = term.split(" ")
    own = postings.filter(F.col("term").isin(*set(parts))).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    return own.select("doc_id", F.lit(term).alias("term"), phrase_places(F.col("at"), parts).alias("tf")).filter("tf > 0")


def term_frequencies(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """``doc_id, length, tf`` (weighted occurrences of each term, in order) in one pass over the texts. A term of several words is a phrase, which
    counts without overlaps."""
    kind = corpus.schema["doc_id"].dataType.simpleString()
    spoken = [(i, f" {'  '.join(t.split(' '))} ") for i, t in enumerate(terms) if " " in t]
    single = {t: i for i, t in enumerate(terms) if " " not in t}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ASIDE) for whole in batches for i in range(0, whole.num_rows, ASIDE)):
            lengths, weights = [], []
            for document in zip(*(batch.column(c).to_pylist() for c in ("title", "extra_text", "text")), strict=True):
                length, tf = 0, [0.0] * len(terms)
                for name, tokens in column_tokens(*document).items():
                    length += len(tokens)
                    for t, i in single.items():
                        tf[i] += WEIGHTS[name] * tokens.count(t)
                    if spoken:
                        line = f" {'  '.join(tokens)} "  # every token between blanks of its own
                        for i, phrase in spoken:
                            tf[i] += WEIGHTS[name] * line.count(phrase)
                lengths.append(length)
                weights.append(tf)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(weights, pa.list_(pa.float64()))], names=["doc_id", "length", "tf"])

    return corpus.select("doc_id", "title", "extra_text", "text").mapInArrow(run, f"doc_id {kind}, length long, tf array<double>")


def _scan(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """Without an index: lengths and frequencies are counted once and kept as a table of three narrow columns, from which come the totals and
    then the scores."""
    if not terms:
        return corpus.select("doc_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    rows = materialise(term_frequencies(corpus, terms), "frequencies")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), F.array(*(F.count_if(F.col("tf")[i] > 0) for i in range(len(terms)))).alias("holding"))
    found = rows.crossJoin(F.broadcast(total))  # one row
    score = sum(F.when(F.col("tf")[i] > 0, bm25(F.col("tf")[i], inverse_frequency(F.col("n"), F.col("holding")[i]), F.col("length"), F.col("mean"))).otherwise(0.0) for i in range(len(terms)))
    return found.select("doc_id", score.alias("score")).filter("score > 0")


def _tokens(word: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in fold(word)).split()


def phrase_frequency(corpus: DataFrame, words: list[str]) -> DataFrame:
    """``doc_id, term, tf`` for a phrase: weighted places where the words follow each other in a full-text column."""
    term = " ".join(words)
    return term_frequencies(corpus, [term]).select("doc_id", F.lit(term).alias("term"), F.col("tf")[0].alias("tf")).filter("tf > 0")


def kind_filter(kind: str, linked: Column | None = None) -> Column:
    """Whether a document is of the kind asked for; ``linked``, that it has a url, stands in for that column."""
    linked = F.col("url") != "" if linked is None else linked
    return {"mail": F.col("kind") == "mail", "image": F.col("kind") == "image", "browser": (F.col("kind") == "browser") | linked, "file": F.col("kind") != "browser"}.get(kind, F.lit(True))


def period_filter(period: dates.Period | None) -> Column:
    return F.lit(True) if period is None else F.col("mtime").isNull() | period.holds(F.col("mtime"))


def weigh(hits: DataFrame, question: Question, now: dt.datetime) -> DataFrame:
    """The score with its bonuses: title, recency, url; less for documents with an error or, under a period, no date."""
    own = document_words(F.concat_ws(" ", "title", "path", "url", "extra_text"))
    named = sum((F.array_contains(own, stem_word(t)).cast("int") for t in question.terms), F.lit(0))
    score = F.col("score") + TITLE_BOOST * WEIGHTS["title"] * named
    score = score + F.coalesce(RECENT_BOOST * dates.recency(now, F.col("mtime")), F.lit(0.0))
    score = score + F.when(F.col("url") != "", URL_BOOST * url_similarity(F.col("url"), question.search_words)).otherwise(0.0)
    score = F.when(F.col("error") != "", score * ERROR_FACTOR).otherwise(score)
    if question.period is not None:
        score = F.when(F.col("mtime").isNull(), score * UNDATED_FACTOR).otherwise(score)
    return hits.withColumn("score", score)


def reason(question: Question) -> Column:
    """Why a result fits: for the first three terms where they occur, then the date, then the kind."""
    own = document_words(F.concat_ws(" ", "title", "path"))
    low = F.lower("text")
    parts = []
    for t in question.terms[:3]:
        found = F.when(F.array_contains(own, stem_word(t)), f"{t} (title)").when(F.contains(low, F.lit(t.lower())), f"{t} (in the text)")
        for v in variants_of(t):
            found = found.when(F.contains(low, F.lit(v.lower())), f"{t} → {v} (in the text)")
        parts.append(found)
    if question.period is not None:
        name = question.period.describe()
        parts.append(F.when(F.col("mtime").isNull(), f"date unknown, cannot be checked against {name}").otherwise(F.concat(F.date_format("mtime", "dd-MM-yyyy"), F.lit(f" falls in {name}"))))
    parts.append(F.when((F.col("kind") == "browser") & (F.col("url") != ""), "website from the browser history"))
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("the text looks like your question"))


def best_chunk(corpus: DataFrame) -> DataFrame:
    """``doc_id, fragment``: the longest of a document's first forty chunks, of equals the first."""
    from quaero.functions.text import chunks
    from quaero.functions.vocabulary import FRAGMENTS

    part = F.slice(chunks(F.coalesce("text", F.lit(""))), 1, FRAGMENTS)
    longest = F.aggregate(part, F.lit(""), lambda a, c: F.when(F.length(c) > F.length(a), c).otherwise(a))
    return corpus.withColumn("fragment", longest)


def searched(question: Question) -> list[str]:
    return [*dict.fromkeys([*map(stem_word, question.terms), *question.search_words])] if question.search_words else []


def rank(index: Index, question: Question, now: dt.datetime, limit: int = RESULTS, candidates: int = CANDIDATES, filter_first: bool = True, matched: DataFrame | None = None, fragments: bool = False) -> DataFrame:
    """The best results for an understood question. Kind and period are filtered before the cut to ``candidates``;
    with ``filter_first=False`` after it. A stored index answers from postings, and only the candidates' documents are read, by
    their keys; a corpus is scanned, unless ``matched`` holds the scores already."""
    wanted = kind_filter(question.kind) & period_filter(question.period)
    order = [F.round("score", 9).desc(), F.lower("title"), "doc_id"]
    if index.stored:
        early = kind_filter(question.kind, F.col("linked")) & period_filter(question.period)
        found = index.stored.top(terms_of(searched(question)), candidates, early if filter_first else None)
        hits = index.stored.documents(found).drop("text")
        hits = weigh(hits if filter_first else hits.filter(wanted), question, now)
        best = hits.orderBy(*order).limit(limit).select("doc_id", "score").collect()
        return index.stored.documents(best, fragments).orderBy(*order)  # only these texts are read
    matched = match(index, searched(question)) if matched is None else matched
    hits = matched.join(index.corpus.select("doc_id", "kind", "mtime", "url"), "doc_id")
    hits = hits.filter(wanted) if filter_first else hits
    found = hits.orderBy(F.round("score", 9).desc(), "doc_id").limit(candidates).select("doc_id", "score").collect()
    scores = hits.sparkSession.createDataFrame([(r["doc_id"], r["score"]) for r in found], T.StructType([T.StructField("doc_id", index.corpus.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))
    # the ids go below whatever the corpus is made with, so that only the candidates get titles and texts
    hits = index.corpus.filter(F.col("doc_id").isin([r["doc_id"] for r in found])).join(F.broadcast(scores), "doc_id")
    return weigh(hits if filter_first else hits.filter(wanted), question, now).orderBy(*order).limit(limit)


def present(ranked: DataFrame, question: Question) -> DataFrame:
    """Results with snippet and reason, around the stored fragment if there is one; else only the few ranked documents are cut into chunks."""
    shown = ranked if "fragment" in ranked.columns else best_chunk(ranked)
    return shown.select("doc_id", "source", "path", "title", "kind", F.col("mtime").alias("date"), "url", "score", snippet(F.col("fragment"), question.search_words).alias("snippet"), reason(question).alias("why"))


@dataclass
class Explanation:
    question: Question
    used: list[str]
    synonyms: list[str]
    fuzzy: list[str] = field(default_factory=list)

    def lines(self) -> list[str]:
        said = [self.question.explain(), f"words: {', '.join(self.used)}"]
        if self.synonyms:
            said.append(f"synonyms: {', '.join(self.synonyms)}")
        if self.fuzzy:
            said.append(f"nothing matched, so similar words were used: {', '.join(self.fuzzy[:5])}")
        return said


class Searcher:
    def __init__(self, index: Index):
        self.index = index

    def search(self, text: str, now: dt.datetime, limit: int = RESULTS) -> tuple[DataFrame, Explanation]:
        """Understand, match and rank; words that occur nowhere are replaced by similar ones of the vocabulary."""
        question = understand(text, now)
        words, terms = question.search_words, set(question.terms)
        told = Explanation(question, words[:12], [w for w in words if w not in terms][:10])
        stored = self.index.stored
        matched = None if stored else match(self.index, searched(question))
        if words and not (stored.frequencies(terms_of(searched(question))) if stored else not matched.isEmpty()):
            known = stored.table("zones").select(F.col("term").alias("word")).distinct() if stored and stored.manifest.layers else vocabulary(self.index.corpus)
            near = suggestions(known, [stem_word(t) for t in question.terms])
            told.fuzzy = [r[0] for r in near.select("suggestion").distinct().orderBy("suggestion").collect()]
            if told.fuzzy:
                question, matched = replace(question, search_words=told.fuzzy), None
        return present(rank(self.index, question, now, limit, matched=matched, fragments=True), question), told


def vocabulary(corpus: DataFrame) -> DataFrame:
    """``word, df``: the stems of the corpus and in how many documents they occur."""
    full = F.concat_ws(" ", "title", "text")
    return corpus.select(F.explode(text_words(full)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Cosine of two array columns in double precision, a batch at a time; null where lengths differ, something is null, or a vector is zero."""
    n = len(a)
    dims, others = (x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) for x in (a, b))
    out = np.full(n, np.nan)
    for d in np.unique(dims[(dims == others) & (dims > 0)]).tolist():
        rows = np.flatnonzero((dims == d) & (others == d))
        x, y = (v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) for v in (a, b))
        dot = lambda p, q: np.einsum("ij,ij->i", p, q)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[rows] = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))
    return pa.array(out, mask=~np.isfinite(out))
