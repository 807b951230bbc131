"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises letter by letter: case, homoglyphs (Cyrillic, Greek, full width) and digits or signs
that stand for letters inside a word; entries without accents are also matched with
the text's accents taken off. The lexicon holds word beginnings with weights; at each word the longest entry
counts, unless an exception phrase covers it. A text's score is a logistic function of its summed weight and of that
weight per word, so one chance match in a long text counts little.

Entries and weights are learned from labelled rows: the log ratio of an entry's rate in toxic and in clean texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import batch_of, blocks, in_batches, materialise, text_bytes

#: Letters of other scripts that look like Latin ones, and characters used in place of letters.
HOMOGLYPHS = dict(zip("авекмнорстухіјѕһԁԛԝαβεικνορτυχγ", "abekmhopctyxijshdqwabeiknoptuxy", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
#: Phrases that are spared from the start; ``learn`` adds those that the labelled rows show to be clean.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "clownfish", "class clown", "sore loser", "pond scum")
LEAST, MOST = 3, 12  # characters of an entry
#: How much likelier (in nats) its split between toxic and clean texts must make a real entry than chance.
EVIDENCE = 9.0
#: The same for a phrase that is spared: that all its texts are clean, were it as toxic as its entry.
SPARING = 5.0


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], dict[int, str]]:
    """Look-alikes to the letters they stand for; accented letters to their base."""
    alike = {ord(a): b for a, b in (HOMOGLYPHS | DIGITS).items()}
    for c in range(0xFF10, 0xFF5B):
        plain = unicodedata.normalize("NFKD", chr(c)).lower()
        alike[c] = DIGITS.get(plain, plain)
    for c in [*range(0x24B6, 0x24EA), *range(0x1D400, 0x1D800)]:  # circled and styled letters and digits
        plain = unicodedata.normalize("NFKD", chr(c)).lower()
        if plain.isascii() and plain:
            alike[c] = DIGITS.get(plain, plain)
    for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x300, 0x370)):
        alike[c] = ""
    base = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if plain != chr(c):
            base[c] = plain
    return alike, base


_SIGN = re.compile(r"(?<=[^\W\d_])[@$!|€](?=[^\W\d_])")


def fold(text: str) -> str:
    """Case, look-alikes and invisible characters; accents stay, as they tell words of some languages apart."""
    text = text.lower().translate(_tables()[0])
    return _SIGN.sub(lambda m: SIGNS[m[0]], text)


def bare(folded: str) -> str:
    """The same without accents, in the same places."""
    return folded if folded.isascii() else folded.translate(_tables()[1])


_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    coef: tuple[float, float, float] = (-3.0, 1.0, 1.0)  # constant, total weight, weight per word
    _made: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def automaton(self):
        if self._made is None:
            made = ahocorasick.Automaton()
            for entry, w in self.weights.items():
                made.add_word(entry, (len(entry), w))
            for phrase in self.exceptions:
                made.add_word(fold(phrase), (len(fold(phrase)), None))
            made.make_automaton()
            self._made = made
        return self._made

    def total(self, folded: str) -> tuple[float, int]:
        """Summed weight and number of the distinct words that match. Without accents, only entries that have none match."""
        if not self.weights:
            return 0.0, 0
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        plain = bare(folded)
        for text in (folded,) if plain is folded else (folded, plain):
            for end, (n, w) in self.automaton().iter(text):
                start = end - n + 1
                if start and folded[start - 1].isalpha():
                    continue
                if w is None:
                    if end + 1 == len(folded) or not folded[end + 1].isalpha():
                        spared.append((start, end))
                elif start not in best or best[start][0] < n:
                    best[start] = (n, w)
        words: dict[str, float] = {}
        for start, (_, w) in best.items():
            if not any(a <= start <= b for a, b in spared):
                words[_WORD.match(plain, start)[0]] = w
        return float(sum(words.values())), len(words)


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1))])


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: one fifth by CRC-32 of the id; a null id counts as held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _scan(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for i, j in blocks(offs, 4 << 20):
                found = []
                for a, b in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True):
                    folded = fold(data[a:b].tobytes().decode("utf-8", "replace"))
                    found.append((*lexicon.total(folded), len(folded.split())))
                total, hits, words = zip(*found, strict=True)
                yield batch_of(doc_id=batch.column("doc_id").slice(i, j - i), total=pa.array(total, pa.float64()), hits=pa.array(hits, pa.int64()), words=pa.array(words, pa.int64()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_batches, run, "doc_id long, total double, hits long, words long")


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word beginning, in how many toxic and clean texts of the batch it occurs, by half; '' counts words."""
    for batch in batches:
        count: Counter = Counter()
        for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
            words = _WORD.findall(fold(text or ""))
            count[("", toxic, half)] += len(words)
            count.update((x, toxic, half) for x in {w[:n] for w in set(words) for n in range(LEAST, min(MOST, len(w)) + 1)})
        entry, toxic, half = zip(*count, strict=True)
        yield batch_of(entry=pa.array(entry, pa.string()), toxic=pa.array(toxic, pa.int32()), half=pa.array(half, pa.int32()), d=pa.array(count.values(), pa.int64()))


def _phrases(lexicon: Lexicon):
    """For each matched word with the word after it, and with the one before it: in how many toxic and clean texts it occurs, beside its entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(lexicon.weights)
        for batch in batches:
            count: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text or "")
                words, own = list(_WORD.finditer(folded)), set()
                for i, m in enumerate(words):
                    entry = next((m[0][:n] for n in range(min(MOST, len(m[0])), LEAST - 1, -1) if m[0][:n] in known), None)
                    if entry is None:
                        continue
                    for a, b in ((i, i + 1), (i - 1, i)):
                        if 0 <= a and b < len(words) and folded[words[a].end() : words[b].start()] == " ":
                            own.add((folded[words[a].start() : words[b].end()], entry))
                count.update((*x, toxic) for x in own)
            if count:
                phrase, entry, toxic = zip(*count, strict=True)
                yield batch_of(phrase=pa.array(phrase, pa.string()), entry=pa.array(entry, pa.string()), toxic=pa.array(toxic, pa.int32()), d=pa.array(count.values(), pa.int64()))

    return run


def learned_exceptions(sample: DataFrame, lexicon: Lexicon, counts: Mapping[str, tuple[int, int]]) -> list[str]:
    """Phrases with a matched word that stand in clean texts of the sample only, and in too many of them for chance; ``counts``: clean and toxic texts of
    the entries."""
    rows = sample.select("text", "toxic").transform(in_batches, _phrases(lexicon), "phrase string, entry string, toxic int, d long")
    clean = F.sum(F.when(F.col("toxic") == 0, F.col("d")).otherwise(0))
    rows = rows.groupBy("phrase", "entry").agg(clean.alias("clean"), F.sum("d").alias("all")).filter("clean = all AND clean >= 2").collect()
    found = []
    for r in rows:
        d0, d1 = counts[r["entry"]]
        if r["clean"] * -math.log((d0 + 0.5) / (d0 + d1 + 1)) >= SPARING:
            found.append(r["phrase"])
    return sorted(found)


def _weigh(counts: Mapping[str, tuple[int, int]], words: tuple[int, int]) -> dict[str, float]:
    """Weights of the entries whose texts (clean, toxic) are split too unevenly for chance, given the words of each class."""
    if not all(words):
        return {}
    share = words[1] / sum(words)
    kept: dict[str, tuple[int, float]] = {}
    for entry, (d0, d1) in counts.items():
        expected = share * (d0 + d1)
        gain = d1 * math.log(d1 / expected) + (d0 * math.log(d0 / (d0 + d1 - expected)) if d0 else 0.0) if d1 > expected else 0.0
        if gain >= EVIDENCE:
            kept[entry] = (d1, math.log((d1 + 0.5) / words[1]) - math.log((d0 + 0.5) / words[0]))
    longer: dict[str, int] = {}
    for entry, (d1, _) in kept.items():
        longer[entry[:-1]] = max(longer.get(entry[:-1], 0), d1)
    # an entry gives way to a longer one that says the same more exactly
    return {e: w for e, (d1, w) in kept.items() if longer.get(e, 0) < 0.95 * d1 and w > 1}


def learn(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 6000, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """Fit on at most ``max_toxic`` + ``max_clean`` labelled rows that are not held out, picked by a hash of the id.

    ``docs`` needs doc_id and text, ``labels`` doc_id and toxic. Null labels and ids are passed over; of several
    labels of an id the highest counts. The logistic function is fitted on scores of each half of the sample under
    the other half's lexicon, so that chance entries don't flatter it; the lexicon itself is then learned from both, and so are further exceptions.
    With no toxic or no clean row the lexicon is empty and every score is low.
    """
    known = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    pick = known.filter("toxic = 1").orderBy("h", "doc_id").limit(max_toxic).unionByName(known.filter("toxic = 0").orderBy("h", "doc_id").limit(max_clean))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # bounded by max_toxic + max_clean rows of three numbers
    half = pick.select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.pmod("h", F.lit(2)).cast("int").alias("half"))
    sample = materialise(texts.join(F.broadcast(half), "doc_id"), "labelled")
    counts = sample.select("text", "toxic", "half").transform(in_batches, _beginnings, "entry string, toxic int, half int, d long")
    cells = [F.sum(F.when((F.col("toxic") == t) & (F.col("half") == h), F.col("d")).otherwise(0)).alias(f"d{t}{h}") for t in (0, 1) for h in (0, 1)]
    table = counts.groupBy("entry").agg(*cells).filter("entry = '' OR (d10 + d11 >= 3 AND (d10 + d11) * 20 >= d00 + d01)").collect()
    rows = {r["entry"]: tuple(map(int, r[1:])) for r in table}
    words = rows.pop("", (0, 0, 0, 0))
    of = lambda h: _weigh({e: (d[h], d[2 + h]) for e, d in rows.items()}, (words[h], words[2 + h]))
    counted = {e: (d[0] + d[1], d[2] + d[3]) for e, d in rows.items()}
    lexicon = Lexicon(_weigh(counted, (words[0] + words[1], words[2] + words[3])), exceptions)
    if not lexicon.weights:
        return lexicon
    lexicon.exceptions = exceptions = [*exceptions, *learned_exceptions(sample, lexicon, counted)]
    fits = [_scan(sample.filter(F.col("half") == h), Lexicon(of(1 - h), exceptions)) for h in (0, 1)]
    fit = fits[0].unionByName(fits[1]).join(F.broadcast(half.select("doc_id", "toxic")), "doc_id").select("total", "words", "toxic").toPandas()
    lexicon.coef = _logistic(_features(fit["total"].to_numpy(float), fit["words"].to_numpy(float)), fit["toxic"].to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Newton's method on the penalised likelihood; weights of matches are kept from going negative."""
    if not len(y) or not 0 < y.sum() < len(y):
        return (-3.0, 1.0, 0.5)
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (y - p) - ridge * b
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(3), grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, predicted, hits, words`` for every row, from the text alone.

    Null and empty texts have no match and get the lowest score; rows are scored one by one, so repeated rows and null
    ids need no rule; an empty table gives no rows. Other columns play no part.
    """
    c0, c1, c2 = lexicon.coef
    scanned = _scan(docs, lexicon)
    x = F.lit(c0) + c1 * F.log1p("total") + c2 * F.log1p(1000 * F.col("total") / F.greatest(F.col("words"), F.lit(1)))
    p = 1 / (1 + F.exp(-x))
    return scanned.select("doc_id", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), "hits", "words")


