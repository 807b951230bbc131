"""The same rules as SQL text for DuckDB, to compare results with."""

from __future__ import annotations

import datetime as dt

from quaero.functions.language import relatives, stem_word
from quaero.functions.vocabulary import BM25_B, BM25_K1, CANDIDATES, IRREGULAR_STEMS, RESULTS, STOPWORDS, WEIGHTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return ", ".join(map(quoted, words))


def norm(x: str) -> str:
    return f"replace(strip_accents(lower(coalesce({x}, ''))), '’', '''')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '[a-z0-9]+(?:''[a-z]+)?')"


def index_tokens(x: str) -> str:
    return f"regexp_extract_all({norm(x)}, '[\\p{{L}}\\p{{N}}]+')"


def stem(w: str) -> str:
    cut = lambda x, n: f"left({x}, length({x}) - {n})"
    plural = (
        f"CASE WHEN {w} LIKE '%heden' AND length({w}) >= 8 THEN {cut(w, 5)} || 'heid' WHEN {w} LIKE '%en' AND length({w}) >= 5 THEN {cut(w, 2)} "
        f"WHEN {w} LIKE '%s' AND length({w}) >= 5 AND right({w}, 2) NOT IN ('ss', 'us', 'is') THEN {cut(w, 1)} ELSE {w} END"
    )
    p = f"({plural})"
    ending = f"CASE WHEN {p} LIKE '%ing' AND length({p}) >= 6 THEN {cut(p, 3)} WHEN {p} LIKE '%ende' AND length({p}) >= 8 THEN {cut(p, 4)} ELSE {p} END"
    irregular = " ".join(f"WHEN {w} = {quoted(a)} THEN {quoted(b)}" for a, b in IRREGULAR_STEMS.items())
    return f"CASE WHEN length({w}) <= 3 OR NOT regexp_full_match({w}, '[a-z]+') THEN {w} {irregular} ELSE {ending} END"


def field(x: str) -> str:
    return f"left(coalesce({x}, ''), 16000)"


def stems_table(name: str, source: str, text: str) -> str:
    """CTEs: distinct stems (length of the token at least two) of each row's text, with the place of the first."""
    return f"{name}_t AS (SELECT doc_id, unnest({tokens(text)}) AS w FROM {source}), {name} AS (SELECT DISTINCT doc_id, {stem('w')} AS word FROM {name}_t WHERE length(w) >= 2)"


LINES = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x0b]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def title(text: str, fallback: str) -> str:
    lines = f"string_split_regex(coalesce({text}, ''), '{LINES}')"
    clean = f"list_transform({lines}, lambda x: {strip('regexp_replace(' + strip('x') + ', ' + quoted('^#+') + ', ' + quoted('') + ')')})"
    return f"coalesce(left(list_filter({clean}, lambda x: length(x) >= 4 AND left(x, 1) NOT IN ('{{', '<', '['))[1], 120), {fallback})"


def corpus(documents: str = "documents", dated: bool = True) -> str:
    when = "TIMESTAMP '2024-01-01' + to_days((doc_id % 365)::INTEGER)" if dated else "NULL::TIMESTAMP"
    return f"SELECT doc_id, source, 'doc/' || doc_id AS path, {title('text', quoted('doc/') + ' || doc_id')} AS title, 'tekst' AS kind, {when} AS mtime, text, '' AS url FROM {documents}"


MAILS = f"SELECT 1000000000 + conv_id * 1000 + turn AS doc_id, 'mail' AS source, 'mail/' || conv_id || '/' || turn AS path, {title('text', quoted('mail'))} AS title, 'mail' AS kind, NULL::TIMESTAMP AS mtime, text, '' AS url FROM conversations"


#: Score of a document for one term, from tf, df, len and tot of ``match_table``.
BM25 = f"""CASE WHEN ln((n - holding + 0.5) / (holding + 0.5)) > 0 THEN ln((n - holding + 0.5) / (holding + 0.5)) ELSE 1e-6 END
        * tf * {BM25_K1 + 1} / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * length / mean))"""


def match_table(words: str, source: str = "c") -> str:
    """CTEs from corpus ``c`` to ``tf``, ``df``, ``len`` and ``tot``, for a list or subquery of words of one token."""
    full = f"{field('title')} || ' ' || '' || ' ' || {field('text')}"
    return f"""
{stems_table('ws', f"(SELECT doc_id, {full} AS whole FROM {source})", 'whole')},
x AS (SELECT doc_id, {WEIGHTS['text']}::DOUBLE AS w, unnest({index_tokens('text')}) AS term FROM {source}
      UNION ALL SELECT doc_id, {WEIGHTS['title']}, unnest({index_tokens(field('title'))}) FROM {source}
      UNION ALL SELECT doc_id, {WEIGHTS['words']}, unnest({index_tokens('word')}) FROM ws),
len AS (SELECT doc_id, count(*) AS length FROM x GROUP BY doc_id),
tot AS (SELECT count(*) AS n, avg(coalesce(length, 0)) AS mean FROM {source} LEFT JOIN len USING (doc_id)),
tf AS (SELECT doc_id, term, sum(w) AS tf FROM x WHERE term IN ({words}) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS holding FROM tf GROUP BY term)"""


def match(words: list[str], source: str = "c") -> str:
    """CTEs from corpus ``c`` to ``m(doc_id, score)``, for words of one token."""
    return f"""{match_table(values(words), source)},
m AS (SELECT doc_id, sum({BM25}) AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY doc_id)"""


def search(corpus_sql: str, terms: list[str], words: list[str], now: dt.datetime, wanted: str = "true", undated: bool = False) -> str:
    asked = "[" + values(map(stem_word, terms)) + "]"
    days = f"abs(floor((epoch(TIMESTAMP '{now}') - epoch(mtime)) / 86400))"
    score = f"score + 1.05 * len(list_filter({asked}, lambda w: list_contains(own, w))) + coalesce(0.15 * (1 / (1 + {days} / 365.0)), 0)"
    if undated:
        score = f"CASE WHEN mtime IS NULL THEN ({score}) * 0.7 ELSE {score} END"
    return f"""
WITH c AS ({corpus_sql}), {match(words)},
{stems_table('tw', "(SELECT doc_id, title || ' ' || path || ' ' AS head FROM c)", 'head')},
own AS (SELECT doc_id, list(word) AS own FROM tw GROUP BY doc_id),
h AS (SELECT * FROM m JOIN c USING (doc_id) WHERE {wanted} ORDER BY round(score, 9) DESC, doc_id LIMIT {CANDIDATES})
SELECT doc_id, kind, title, round(final, 6) AS score FROM (SELECT doc_id, kind, title, {score} AS final FROM h LEFT JOIN own USING (doc_id))
ORDER BY round(final, 9) DESC, lower(title), doc_id LIMIT {RESULTS}"""


def chunks(source: str = "documents") -> str:
    """CTEs to ``piece(doc_id, ord, text)``: a text in pieces of 400 to 900 characters. Needs WITH RECURSIVE."""
    def last(low: int, high: int, ends: str) -> str:
        return f"list_max(list_filter(range({low}, {high}), lambda i: {ends}))"

    sentence = "substr(head, i + 1, 1) = chr(10) OR (substr(head, i + 1, 1) IN ('.', ';') AND substr(head, i + 2, 1) = ' ')"
    end = f"""CASE WHEN length(head) <= 900 THEN length(head) WHEN substr(head, 900, 1) = chr(10) THEN 899
        ELSE coalesce({last(400, 899, sentence)}, {last(400, 900, "substr(head, i + 1, 1) = ' '")}, 900) END"""
    return f"""
chunked(doc_id, ord, text, rest) AS (
  SELECT doc_id, -1, '', {strip("regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')")} FROM {source}
  UNION ALL
  SELECT doc_id, ord + 1, {strip('left(rest, e)')}, regexp_replace(substr(rest, e + 1), '^{BLANKS}+', '') FROM (SELECT doc_id, ord, rest, {end} AS e FROM (SELECT *, left(rest, 902) AS head FROM chunked WHERE rest <> ''))),
piece AS (SELECT doc_id, ord, text FROM chunked WHERE ord >= 0 AND text <> '')"""


#: For texts x and y: 1000 times the length of their longest common run, less the place in x where it first stands; below 0 without one.
LONGEST_RUN = """coalesce(list_max(list_transform(range(1, length(x) + 1), lambda p: 1000 * list_max(list_filter(range(0, length(x) - p + 2), lambda n: n = 0 OR contains(y, substr(x, p, n)))) - p)), -1)"""


def family_rows() -> str:
    """VALUES of (key, place, form): the synonyms of every key with their stems."""
    rows = []
    for key, family in relatives().items():
        forms = dict.fromkeys(x for w in family for x in (w, stem_word(w)))
        rows += [f"({quoted(key)}, {i}, {quoted(f)})" for i, f in enumerate(forms)]
    return ", ".join(rows)


STOP = values(sorted(STOPWORDS))
