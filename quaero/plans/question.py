"""What a question asks for: kind, period, subject."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quaero.functions import dates
from quaero.functions.language import fold, keywords_of, stem_word
from quaero.functions.vocabulary import STOPWORDS, kind_words

KIND_TEXT = {
    "alles": "you did not ask for a particular kind", "mail": "you asked for a mail", "image": "you asked for an image or a screenshot",
    "browser": "you asked for something you looked at online", "file": "you asked for a document or file",
}


@dataclass(frozen=True)
class Question:
    original: str
    kind: str = "alles"
    period: dates.Period | None = None
    recognition: str = ""
    precision: str = "unknown"
    terms: list[str] = field(default_factory=list)
    search_words: list[str] = field(default_factory=list)
    rest: str = ""

    def explain(self) -> str:
        parts = [f"searching for: {', '.join(self.terms) or self.rest}", KIND_TEXT[self.kind]]
        if self.period:
            parts.append(f"and it should be from {self.period.describe()}")
        return "; ".join(parts)


@lru_cache(maxsize=1)
def kind_stems() -> dict[str, str]:
    found: dict[str, str] = {}
    for word, kind in kind_words().items():
        for form in (word, stem_word(word)):
            found.setdefault(form, kind)
    return found


def understand(question: str, now: dt.datetime) -> Question:
    """Time first, then the first word that names a kind; what is left, without stopwords, is the subject."""
    raw = (question or "").strip()
    if not raw:
        return Question(raw, rest=fold(raw))
    time = dates.parse_time(raw, now)
    words = re.findall(r"[a-z0-9]+(?:'[a-z]+)?", fold(time.rest))
    kinds = kind_stems()
    kind = next((kinds[f] for w in words for f in (w, stem_word(w)) if f in kinds), "alles")
    subject = [w for w in words if stem_word(w) not in kinds and w not in STOPWORDS]
    terms = [w for w in subject if len(w) > 1] or subject[:1]
    return Question(raw, kind, time.period, time.recognition, time.precision, terms, keywords_of(terms), time.rest)


_SCHEMA = "kind string, first timestamp_ntz, last timestamp_ntz, label string, precision string, terms array<string>, search_words array<string>, index_terms array<string>"


def understand_all(question: Column, now: dt.datetime) -> Column:
    """``understand`` for a column of questions, with the terms that an index is asked for."""
    from quaero.operators.search import searched, terms_of

    @F.pandas_udf(_SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [understand(t, now) for t in texts]
        return pd.DataFrame(
            {
                "kind": [q.kind for q in found], "first": pd.to_datetime([q.period.start if q.period else None for q in found]), "last": pd.to_datetime([q.period.end if q.period else None for q in found]),
                "label": [q.period.describe() if q.period else None for q in found], "precision": [q.precision for q in found], "terms": [q.terms for q in found], "search_words": [q.search_words for q in found],
                "index_terms": [terms_of(searched(q)) for q in found],
            }
        )

    return run(question)
