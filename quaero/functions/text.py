"""Text extraction and display as Column expressions."""

from __future__ import annotations

import html
import html.entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.functions.vocabulary import CHUNK_MAX, CHUNK_MIN, EXTENSIONS, MAX_TEXT, SKIPPED_NAMES, SNIPPET

#: Texts of a batch that are Python strings at a time.
ASIDE = 128
_BLANKS = re.compile(r"\s*")
BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}]"


@F.arrow_udf(T.StringType())
def unescape(text: pa.Array) -> pa.Array:
    """HTML entities to characters."""
    return pa.array([None if t is None else html.unescape(t) if "&" in t else t for t in text.to_pylist()], pa.string())


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(found: re.Match) -> str:
    return html.unescape(found[0]) if found[0][1] == "#" or found[0][1:] in html.entities.html5 else found[0]


@F.arrow_udf(T.StringType())
def unescape_closed(text: pa.Array) -> pa.Array:
    """HTML entities that a semicolon ends to characters; others stay as they are written, as in a title that was cut within one."""
    return pa.array([None if t is None else _CLOSED.sub(_closed, t) if "&" in t else t for t in text.to_pylist()], pa.string())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def html_title(page: Column, decode=unescape) -> Column:
    found = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return strip(decode(F.regexp_replace(found, r"<[^>]+>", " ")))


def strip_html(page: Column, decode=unescape) -> Column:
    """Readable text of a page: scripts and styles out, block ends to line breaks, entities decoded, the title on top
    unless the text holds it already."""
    page = F.coalesce(page, F.lit(""))
    body = F.regexp_replace(page, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?i)<br\s*/?>", "\n")
    body = F.regexp_replace(body, r"(?i)</(p|div|li|tr|h[1-6]|section|article|header|footer)>", "\n")
    body = decode(F.regexp_replace(body, r"<[^>]+>", " "))
    lines = F.transform(F.split(F.regexp_replace(body, r"[ \t\f\x0b]+", " "), r"\r\n|[\n\r\x0b\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"), strip)
    body = strip(F.array_join(F.filter(lines, lambda x: ~x.isin("", "window.", "document.")), "\n"))
    title = html_title(page, decode)
    return F.when((title != "") & ~F.contains(F.lower(body), F.lower(title)), strip(F.concat_ws("\n", title, body))).when(body != "", body).otherwise(title)


#: Characters in which a title is looked for first.
TITLE_HEAD = 2048


def title_of(text: Column, fallback: Column) -> Column:
    """First line of four characters or more without leading '#', that opens no brace, tag or bracket; at most 120."""
    def first(part: Column, whole: bool) -> Column:
        lines = F.split(F.coalesce(part, F.lit("")), r"\r\n|[\n\r\x0b\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]")
        lines = lines if whole else F.slice(lines, 1, F.size(lines) - 1)  # the last line of a part may go on
        lines = F.transform(lines, lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
        good = F.filter(lines, lambda x: (F.length(x) >= 4) & ~F.substring(x, 1, 1).isin("{", "<", "["))
        return F.substring(F.try_element_at(good, F.lit(1)), 1, 120)

    return F.coalesce(first(F.substring(text, 1, TITLE_HEAD), False), first(text, True), fallback)


def shorten(text: Column) -> Column:
    return F.substring(text, 1, MAX_TEXT)


def unreadable(text: Column) -> Column:
    """Whether extracted text is hardly anything but signs: too short, few letters, or many control characters."""
    size = F.greatest(F.length(text), F.lit(1))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    controls = F.length(F.regexp_replace(text, r"[^\x00-\x08\x0b-\x1f]", ""))
    solid = F.length(F.replace(text, F.lit(" ")))
    return (F.length(text) < 8) | ((letters / size < 0.25) & (solid >= 40)) | (controls / size > 0.1)


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://([^/]*)", 1)


def url_similarity(url: Column, words: list[str]) -> Column:
    """Share of the words whose first five letters a part of the url holds, or the other way round."""
    if not words:
        return F.lit(0.0)
    parts = F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda p: F.length(p) > 2)

    def near(word: str) -> Column:
        return F.exists(parts, lambda p: F.contains(p, F.lit(word[:5])) | F.contains(F.lit(word), F.left(p, F.lit(5))))

    hits = sum(near(w).cast("int") for w in words)
    return F.least(F.lit(1.0), hits / F.lit(float(len(words))))


def snippet(text: Column, words: list[str], width: int = SNIPPET) -> Column:
    """A stretch of the text around the earliest of the words of three letters or more; else its start."""
    flat = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), rf"{BLANK}+", " ")
    low = F.lower(flat)
    at = [F.nullif(F.instr(low, F.lit(w.lower())), F.lit(0)) for w in words if len(w) >= 3]
    first = F.least(*at) if len(at) > 1 else at[0] if at else F.lit(None).cast("int")
    begin = F.coalesce(F.greatest(F.lit(0), first - 1 - width // 3), F.lit(0))
    dots = F.lit("…")
    return F.concat(F.when(begin > 0, dots).otherwise(""), F.substring(flat, begin + 1, F.lit(width)), F.when(begin + width < F.length(flat), dots).otherwise(""))


@lru_cache(maxsize=8)
def _piece(least: int, most: int) -> re.Pattern:
    """The longest piece that a line, sentence or clause ends; else that a blank ends; else of the full length."""
    return re.compile(rf"(?s).{{{most - 1}}}(?=\n)|.{{{least},{most - 2}}}(?=\n|[.;] )|.{{{least},{most - 1}}}(?= )|.{{{most}}}")


def pieces(text: str | None, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> list[str]:
    """A text in pieces of ``least`` to ``most`` characters, without the blanks around them; the last one may be shorter."""
    text = re.sub(r"\r\n?", "\n", text or "").strip()
    out, at = [], 0
    while len(text) - at > most:
        end = _piece(least, most).match(text, at).end()
        out.append(text[at:end].strip())
        at = _BLANKS.match(text, end).end()
    return [p for p in [*out, text[at:]] if p]


@F.arrow_udf(T.ArrayType(T.StringType()))
def chunks(text: pa.Array) -> pa.Array:
    """``pieces``; a few texts at a time are Python's, whatever the size of the batch."""
    kind = pa.list_(pa.string())
    parts = [pa.array([pieces(t) for t in text.slice(i, ASIDE).to_pylist()], kind) for i in range(0, len(text), ASIDE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(?s)[^/\\.][^/\\]*?(\.[^./\\]*)$", 1))


def kind_of(path: Column) -> Column:
    """Kind of a file by its extension; ``onbekend`` if none fits."""
    ext, found = extension(path), F.lit("onbekend")
    for kind, own in reversed(EXTENSIONS.items()):
        found = F.when(ext.isin(*own), kind).otherwise(found)
    return found


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/\\]*)$", 1)


def is_supported(path: Column) -> Column:
    name = F.lower(file_name(path))
    return ~name.isin(*SKIPPED_NAMES) & ((kind_of(path) != "onbekend") | name.isin("history", "places.sqlite"))


def include(path: Column, walk: str) -> Column:
    """Whether a walk of that kind takes the file: mail only, images only, all but mail, or any but images."""
    kind, name = kind_of(path), F.lower(file_name(path))
    if walk == "mail":
        return kind == "mail"
    if walk == "beeld":
        return kind == "image"
    rest = is_supported(path) & (kind != "image") & ~name.isin("history", "places.sqlite")
    return rest & (kind != "mail") if walk == "bestanden-zonder-mail" else rest


def artist_and_title(name: Column) -> tuple[Column, Column]:
    """Artist and title that a file name spells: number off, cut at the first dash, remarks in brackets off."""
    plain = F.regexp_replace(file_name(name), r"(?<=[^.])\.[^.]*$", "")
    plain = strip(F.replace(F.regexp_replace(plain, r"^\s*\d{1,3}\s*[-.)\]]\s*", ""), F.lit("_"), F.lit(" ")))
    plain = F.regexp_replace(plain, r"\s{2,}", " ")
    artist, title = F.lit(""), plain
    for dash in ("-", " — ", " – ", " - "):
        at = F.instr(plain, F.lit(dash))
        left, right = strip(F.substring(plain, F.lit(1), at - 1)), strip(F.substring(plain, at + len(dash), F.length(plain)))
        both = (left != "") & (right != "")
        artist = F.when(at > 0, F.when(both, left).otherwise("")).otherwise(artist)
        title = F.when(at > 0, F.when(both, right).otherwise(plain)).otherwise(title)
    for remark in (r"(ft|feat|featuring)\.?", r"(official|lyrics?|audio|video|hd|hq|mv|remaster(ed)?)"):
        title = strip(F.regexp_replace(title, rf"(?i)\s*[(\[]\s*{remark}[^)\]]*[)\]]", ""))
    return artist, F.coalesce(F.nullif(title, F.lit("")), plain)


def full_text(title: Column, text: Column, extra: Column, path: Column | None = None) -> Column:
    """All that can be searched of a document, line by line."""
    keys = ("url", "host", "afzender", "van", "aan", "cc", "onderwerp", "browser", "bijlagen")
    parts = [title, text, *(F.try_element_at(extra, F.lit(k)) for k in keys)]
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))
