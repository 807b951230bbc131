"""What an index holds of documents: their tokens with weights and places, lengths and chunks; and the maintenance of what is stored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.functions.language import distinct_stems, normal_text, text_stems, text_tokens
from quaero.functions.text import chunks
from quaero.functions.vocabulary import FIELD_CHARS, WEIGHTS

if TYPE_CHECKING:
    from quaero.operators.store import Opened

#: What a corpus has: the columns every source maps its rows to.
CORPUS = ("doc_id", "source", "path", "title", "kind", "mtime", "text", "url", "extra_text", "error")


def corpus_row(doc_id: Column, source: Column, path: Column, title: Column, kind: str, text: Column, mtime: Column | None = None, url: Column | None = None, extra_text: Column | None = None, error: Column | None = None) -> list[Column]:
    empty = F.lit("")
    values = (doc_id, source, path, title, F.lit(kind), F.lit(None).cast("timestamp_ntz") if mtime is None else mtime, text, empty if url is None else url, empty if extra_text is None else extra_text, empty if error is None else error)
    return [v.alias(n) for n, v in zip(CORPUS, values, strict=True)]


#: Places between the columns of a document: no phrase crosses from one into the next. A place has 32 bits, as postings are mostly places; only a text
#: of more than a gigabyte could have so many tokens, and such a text fits no batch of texts.
COLUMN = 1 << 29


def column_tokens(title: str | None, extra: str | None, text: str | None) -> dict[str, list[str]]:
    """The tokens of a document's full-text columns, named as in ``WEIGHTS``. Title and extra are cut to the field's length; the words are the
    stems of all three, each cut."""
    title, extra, text = normal_text((title or "")[:FIELD_CHARS]), normal_text((extra or "")[:FIELD_CHARS]), normal_text(text)
    cut = text if len(text) <= FIELD_CHARS else text[:FIELD_CHARS]
    whole, head, rest = text_tokens(text), text_tokens(title), text_tokens(extra)
    full = f"{title} {extra} {cut}"
    if full.isascii() and "'" not in full:  # its tokens are its words then
        words = distinct_stems([*head, *rest, *(whole if cut is text else text_tokens(cut))])
    else:
        words = text_tokens(" ".join(text_stems(full)))
    return {"text": whole, "title": head, "extra": rest, "words": words}


ENTRIES = "length long, entries array<struct<term:string,tf:double,places:array<int>>>"


def with_entries(corpus: DataFrame, terms: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """``corpus``, without the columns ``drop``, with the document's ``length`` (tokens over all full-text columns) and ``entries``: each of its terms with the weighted
    occurrences and where they are. A place is the number of the token in its column, and the columns stand ``COLUMN`` places apart. Texts are
    tokenised once, a batch at a time. With ``terms`` there are entries for these only."""
    wanted = None if terms is None else frozenset(terms)
    schema = T.StructType([*(f for f in corpus.schema.fields if f.name not in drop), *T.StructType.fromDDL(ENTRIES).fields])
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.float64()), ("places", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                lengths, offsets, terms, tfs, place_offsets, all_places = [], [0], [], [], [0], []
                for document in zip(*(batch.column(c).to_pylist() for c in ("title", "extra_text", "text")), strict=True):
                    found: dict[str, list] = {}
                    length = 0
                    for i, (name, tokens) in enumerate(column_tokens(*document).items()):
                        weight, at = WEIGHTS[name], i * COLUMN
                        length += len(tokens)
                        for n, term in enumerate(tokens, at):
                            if wanted is not None and term not in wanted:
                                continue
                            if (entry := found.get(term)) is None:
                                found[term] = [weight, n]
                            else:
                                entry[0] += weight
                                entry.append(n)
                    lengths.append(length)
                    for term, entry in found.items():
                        terms.append(term)
                        tfs.append(entry[0])
                        all_places += entry[1:]
                        place_offsets.append(len(all_places))
                    offsets.append(len(terms))
                places = pa.ListArray.from_arrays(pa.array(place_offsets, pa.int32()), pa.array(all_places, pa.int32()))
                own = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.float64()), places], fields=list(kind.value_type))
                entries = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), own)
                kept = batch.select([c for c in batch.schema.names if c not in drop])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(lengths, pa.int64()), entries], names=[*kept.schema.names, "length", "entries"])

    return corpus.mapInArrow(run, schema)


def postings(corpus: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, term, tf, places``: one row for each term of each document, or for each of the ``terms`` that it holds."""
    rows = with_entries(corpus.select("doc_id", "title", "extra_text", "text"), terms)
    return rows.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.*")


def chunk_table(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.posexplode(chunks(F.coalesce("text", F.lit("")))).alias("ord", "text"))


@dataclass(frozen=True)
class Index:
    """What is searched: a corpus, which a question scans, or an opened stored index (``quaero.operators.store``)."""

    corpus: DataFrame
    stored: Opened | None = None


# ---------------------------------------------------------------- maintenance

KEY = ["source", "path"]


def newest(rows: DataFrame, order: str = "round") -> DataFrame:
    """One row of each document: that of the latest round."""
    w = Window.partitionBy(*KEY).orderBy(F.col(order).desc())
    return rows.withColumn("nth_", F.row_number().over(w)).filter("nth_ = 1").drop("nth_")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of their predecessors. Both have source, path and round."""
    return newest(stored.unionByName(new, allowMissingColumns=True))


def same_file(stored: str = "s", seen: str = "f") -> Column:
    """Size known and equal, both times known and less than a second apart."""
    a, b = F.unix_micros(F.col(f"{stored}.mtime").cast("timestamp")), F.unix_micros(F.col(f"{seen}.mtime").cast("timestamp"))
    size = (F.coalesce(F.col(f"{stored}.size"), F.lit(0)) == 0) | (F.col(f"{stored}.size") == F.col(f"{seen}.size"))
    return size & F.coalesce(F.abs(a - b) < 1_000_000, F.lit(False))


def unchanged(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that the index holds as they are (semi join)."""
    f, s = files.alias("f"), stored.alias("s")
    return f.join(s, (F.col("f.source") == F.col("s.source")) & (F.col("f.path") == F.col("s.path")) & same_file(), "left_semi")


def to_read(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new or changed (anti join)."""
    f, s = files.alias("f"), stored.alias("s")
    return f.join(s, (F.col("f.source") == F.col("s.source")) & (F.col("f.path") == F.col("s.path")) & same_file(), "left_anti")


def gone(stored: DataFrame, files: DataFrame, completed: DataFrame) -> DataFrame:
    """Stored documents that a completed source no longer has."""
    return stored.join(completed.select("source"), "source", "left_semi").join(files.select(*KEY), KEY, "left_anti")


def remove_source(stored: DataFrame, source: str) -> DataFrame:
    return stored.filter(F.col("source") != source)


def state(corpus: DataFrame) -> DataFrame:
    """One row: documents, chunks, sources, errors (see also ``status`` of a stored index)."""
    n_chunks = chunk_table(corpus).agg(F.count(F.lit(1)).alias("n_chunks"))
    counts = corpus.agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("source").alias("n_sources"), F.count_if(F.col("error") != "").alias("n_errors"))
    return counts.crossJoin(n_chunks)


def per_source(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
