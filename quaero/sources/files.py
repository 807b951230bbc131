"""Files as a source: a walk that never opens skipped folders, and extraction of their text.

``spark.read.format("quaero_walk")`` lists files (path, size, mtime), one partition per folder below the root, so a wide
tree is walked in parallel. Contents are read with Spark's ``binaryFile`` source where a store holds them, or beside the
walk on shared folders; extraction runs in Arrow batches, a row for a file, and an error never fails the job but
becomes the row's ``error``.
"""

from __future__ import annotations

import datetime as dt
import email
import email.policy
import io
import json
import os
import re
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quaero.functions import text as tx
from quaero.functions.dates import search_date
from quaero.functions.vocabulary import MAX_FILE_SIZE, MAX_TEXT, SKIPPED_FOLDERS

MAX_READ = 4 * MAX_TEXT


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


def walk(folder: str, deep: bool = True) -> Iterator[tuple[str, int, dt.datetime]]:
    """Files below a folder: no links, no skipped folders, none over the size limit, no folder twice."""
    todo, seen = [folder], set()
    while todo:
        try:
            with os.scandir(todo.pop()) as entries:
                for e in entries:
                    try:
                        if e.is_symlink():
                            continue
                        info = e.stat(follow_symlinks=False)
                        if e.is_dir(follow_symlinks=False):
                            if deep and e.name.lower() not in SKIPPED_FOLDERS and (info.st_dev, info.st_ino) not in seen:
                                seen.add((info.st_dev, info.st_ino))
                                todo.append(e.path)
                        elif info.st_size <= MAX_FILE_SIZE:
                            yield e.path, info.st_size, dt.datetime.fromtimestamp(info.st_mtime, dt.UTC).replace(tzinfo=None)
                    except OSError:
                        continue
        except OSError:
            continue


class WalkReader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[Folder]:
        parts = []
        for root in self.roots:
            if os.path.isdir(root):
                parts.append(Folder(root, False))
                parts += [Folder(e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and e.name.lower() not in SKIPPED_FOLDERS]
        return parts or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if partition.path:
            yield from walk(partition.path, partition.deep)


class WalkSource(DataSource):
    """Options: ``path``, or ``paths`` as a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "quaero_walk"

    def schema(self) -> str:
        return "path string, size long, mtime timestamp_ntz"

    def reader(self, schema) -> WalkReader:
        return WalkReader(json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]])


def files(spark: SparkSession, roots: list[str], kind: str = "bestanden", own: str | None = None) -> DataFrame:
    """Files that a walk of that kind takes, without those of the index's own folder."""
    spark.dataSource.register(WalkSource)
    found = spark.read.format("quaero_walk").option("paths", json.dumps(roots)).load().filter(tx.include(F.col("path"), kind))
    return found.filter(~F.col("path").startswith(own.rstrip("/") + "/")) if own else found


# ---------------------------------------------------------------- one file's text

def decode(raw: bytes) -> str:
    """By byte-order mark, by the encoding the text names, else as UTF-8, else Windows-1252, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    named = re.search(rb"encoding=[\"']([\w\-]+)[\"']", raw[:400], re.IGNORECASE)
    for name in ([named[1].decode()] if named else []) + ["utf-8", "cp1252", "latin-1"]:
        try:
            return raw.decode(name, "replace" if named and name == named[1].decode() else "strict")
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def _member(z: zipfile.ZipFile, name: str) -> str:
    with z.open(name) as f:
        return f.read(MAX_READ).decode("utf-8", "replace")


def _plain(xml: str, breaks: str = r"</w:p>|</a:p>|</w:tr>|<w:br\s*/>|<a:br\s*/>") -> str:
    import html

    return html.unescape(re.sub(r"<[^>]+>", "", re.sub(breaks, "\n", xml.replace("<w:tab/>", "\t"))))


def office(raw: bytes, ext: str) -> str:
    """Text of a docx (body, headers, footers), xlsx (a line per row, a header per sheet) or pptx (a block per slide)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        number = lambda n: int(re.sub(r"\D", "", n.rsplit("/", 1)[-1]) or 0)
        if ext == ".docx":
            parts = ["word/document.xml", *sorted(n for n in names if re.match(r"word/(header|footer)\d*\.xml$", n))]
            return "\n".join(_plain(_member(z, n)).strip() for n in parts if n in names)
        if ext == ".pptx":
            slides = sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=number)
            blocks = (f"[slide {number(n)}]\n" + _plain("\n".join(re.findall(r"(?s)<a:p\b.*?</a:p>", _member(z, n)))).strip() for n in slides)
            return "\n\n".join(blocks)[:MAX_TEXT]
        shared = re.findall(r"(?s)<si\b[^>]*>(.*?)</si>", _member(z, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        shared = [_plain(s) for s in shared]
        out = []
        for n in sorted(x for x in names if re.match(r"xl/worksheets/sheet\d+\.xml$", x)):
            out.append(f"[{n.rsplit('/', 1)[-1][:-4]}]")
            for row in re.findall(r"(?s)<row\b[^>]*>(.*?)</row>", _member(z, n)):
                cells = []
                for head, body in re.findall(r"(?s)<c\b([^>]*)>(.*?)</c>", row):
                    value = re.search(r"(?s)<v[^>]*>(.*?)</v>", body)
                    if 't="s"' in head and value:
                        at = int(value[1]) if value[1].strip().isdigit() else -1
                        cells += shared[at : at + 1] if at >= 0 else []
                    else:
                        cells.append(_plain(body))
                if any(c.strip() for c in cells):
                    out.append(" | ".join(c.strip() for c in cells if c.strip()))
        return "\n".join(out)


def message(raw: bytes) -> tuple[str, str, dict[str, str]]:
    """Subject, text and headers of a mail: the first plain part, else HTML; attachments by name only."""
    import html

    m = email.message_from_bytes(raw, policy=email.policy.compat32)
    header = lambda n: str(email.header.make_header(email.header.decode_header(m.get(n, "")))).strip()
    body, names = "", []
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_filename() or "attachment" in str(part.get("Content-Disposition", "")):
            names.append(part.get_filename() or "")
            continue
        content = part.get_payload(decode=True) or b""
        found = content.decode(part.get_content_charset() or "utf-8", "replace")
        if part.get_content_type() == "text/plain":
            body = found
            break
        if part.get_content_type() == "text/html" and not body:
            body = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>|<br\s*/?>|</p>", "\n", found)))
    extra = {k: v for k, v in (("van", header("From")), ("aan", header("To")), ("cc", header("Cc")), ("onderwerp", header("Subject")), ("message_id", header("Message-ID")), ("bijlagen", ", ".join(n for n in names if n))) if v}
    try:
        extra["moment"] = f"{email.utils.parsedate_to_datetime(m['Date']):%Y-%m-%d %H:%M}" if m["Date"] else ""
    except (TypeError, ValueError):
        extra["moment"] = ""
    return header("Subject"), body.strip(), {k: v for k, v in extra.items() if v}


def mailbox(raw: bytes) -> list[bytes]:
    return [p for p in re.split(rb"(?m)^From .*\r?\n", raw) if p.strip()]


def _hex(digits: bytes) -> bytes:
    """Bytes of hex digits between angle brackets; an odd number of digits ends in a 0."""
    clean = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
    return bytes.fromhex((clean + b"0" * (len(clean) % 2)).decode())


def _letters(target: bytes) -> str:
    return target.decode("latin-1" if len(target) % 2 else "utf-16-be", "replace")


def glyphs(table: bytes) -> dict[int, str]:
    """Letters by glyph code from a font's ToUnicode table: single codes, and ranges that count up or list their targets."""
    found: dict[int, str] = {}
    number = lambda digits: int.from_bytes(_hex(digits))
    for kind, block in re.findall(rb"(?s)beginbf(char|range)(.*?)endbf", table):
        if kind == b"char":
            found |= {number(code): _letters(_hex(to)) for code, to in re.findall(rb"<([^<>]*)>\s*<([^<>]*)>", block)}
            continue
        for low, high, to, listed in re.findall(rb"<([^<>]*)>\s*<([^<>]*)>\s*(?:<([^<>]*)>|\[([^\]]*)\])", block):
            codes = range(number(low), min(number(high), 0xFFFF) + 1)
            if to:
                size = len(_hex(to))
                targets = [((number(to) + i) % 256**size).to_bytes(size) for i in range(len(codes))]
            else:
                targets = [_hex(t) for t in re.findall(rb"<([^<>]*)>", listed)]
            found |= {c: _letters(t) for c, t in zip(codes, targets, strict=False)}
    return found


def _inflated(head: bytes, body: bytes) -> bytes:
    try:
        return zlib.decompressobj().decompress(body) if b"FlateDecode" in head else body
    except zlib.error:
        return b""


STREAM = rb"(?s)<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream"


def _fonts(raw: bytes) -> dict[bytes, tuple[dict[int, str], int]]:
    """By resource name: the glyph table of each font that has one, and how many bytes a code takes."""
    objects = {number: body for number, body in re.findall(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", raw)}
    tables = {}
    for number, body in objects.items():
        if b"/Font" in body and (to := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body)) and (stream := re.search(STREAM, objects.get(to[1], b""))):
            tables[number] = (glyphs(_inflated(*stream.groups())), 2 if re.search(rb"/Subtype\s*/Type0", body) else 1)
    return {name: tables[to] for body in objects.values() for name, to in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", body) if to in tables}


def pdf(raw: bytes) -> str:
    """Text shown by the content streams of a PDF, through its fonts' own glyph tables where they have one; positions
    become lines."""
    out, fonts = [], _fonts(raw)
    for head, body in re.findall(STREAM, raw):
        data = _inflated(head, body)
        if b"BT" not in data or not re.search(rb"T[jJ]|['\"]", data):
            continue
        table, width = {}, 1
        for op in re.finditer(rb"\((?P<s>(?:\\.|[^\\()])*)\)|(?P<h><[0-9A-Fa-f\s]+>)|/(?P<f>[^\s/<>\[\]()]+)\s+[\d.]+\s+Tf|(?P<n>\bT[dDm*]|\bET\b|['\"])", data):
            if op["f"]:
                table, width = fonts.get(op["f"], ({}, 1))
            elif op["n"]:
                out.append("\n")
            else:
                codes = _hex(op["h"]) if op["h"] else re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(m[1], m[1]), op["s"])
                out.append("".join(table.get(c, chr(c)) for c in (int.from_bytes(codes[i : i + width]) for i in range(0, len(codes), width))))
    return "\n".join(line.strip() for line in "".join(out).splitlines() if line.strip())


#: ID3v2 frames (of version 2.2 with three letters) and FLAC comments, and what they hold.
FRAMES = {
    "TIT2": "muziektitel", "TPE1": "artiest", "TPE2": "muziekartiest", "TALB": "album", "TCON": "genre", "TRCK": "track", "TDRC": "jaar", "TYER": "jaar",
    "TT2": "muziektitel", "TP1": "artiest", "TP2": "muziekartiest", "TAL": "album", "TCO": "genre", "TRK": "track", "TYE": "jaar",
}
COMMENTS = {"TITLE": "muziektitel", "ARTIST": "artiest", "ALBUMARTIST": "muziekartiest", "ALBUM": "album", "GENRE": "genre", "TRACKNUMBER": "track", "DATE": "jaar", "YEAR": "jaar"}


def _tag(value: str) -> str:
    return re.sub(r"[\x00-\x1f]+", " ", value).strip()[:400]


def _flac(raw: bytes) -> dict[str, str]:
    """Comments of a FLAC file; values of a name that repeats are joined by ``&``."""
    values: dict[str, list[str]] = {}
    little = lambda at: int.from_bytes(raw[at : at + 4], "little")
    at, last = 4, False
    while not last and at + 4 <= len(raw):
        last, kind, end = bool(raw[at] & 128), raw[at] & 127, at + 4 + int.from_bytes(raw[at + 1 : at + 4])
        if kind == 4:
            place = at + 8 + little(at + 4)  # past the writer's name
            left, place = little(place), place + 4
            while left and place + 4 <= min(end, len(raw)):
                name, _, value = raw[place + 4 : place + 4 + little(place)].decode("utf-8", "replace").partition("=")
                if (key := COMMENTS.get(name.upper())) and (value := _tag(value)):
                    values.setdefault(key, []).append(value)
                left, place = left - 1, place + 4 + little(place)
        at = end
    return {k: " & ".join(dict.fromkeys(v)) for k, v in values.items()}


def music(raw: bytes) -> dict[str, str]:
    """Tags of ID3v2, else a FLAC file's comments, else ID3v1."""
    found: dict[str, str] = {}
    if raw[:3] == b"ID3" and raw[3] in (2, 3, 4):
        safe = lambda b: (b[0] << 21) | (b[1] << 14) | (b[2] << 7) | b[3]
        n, head = (3, 6) if raw[3] == 2 else (4, 10)
        at, end = 10, 10 + safe(raw[6:10])
        while at + head <= min(end, len(raw)):
            name, size = raw[at : at + n].decode("latin-1"), safe(raw[at + 4 : at + 8]) if raw[3] == 4 else int.from_bytes(raw[at + n : at + 2 * n])
            body = raw[at + head : at + head + size]
            if name in FRAMES and body:
                coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] if body[0] < 4 else 0]
                if value := _tag(body[1:].decode(coding, "replace")):
                    found.setdefault(FRAMES[name], value)
            if not name.strip("\0"):
                break
            at += head + size
    if not found and raw[:4] == b"fLaC":
        found = _flac(raw)
    if not found and raw[-128:-125] == b"TAG":
        tag = raw[-125:]
        for key, a, b in (("muziektitel", 0, 30), ("artiest", 30, 60), ("album", 60, 90), ("jaar", 90, 94)):
            if value := tag[a:b].split(b"\0")[0].decode("latin-1").strip():
                found[key] = value
    return found


def extract_one(path: str, raw: bytes) -> tuple[str, str, dict[str, str], str]:
    """Title (or ''), text, extra and error of one file."""
    ext = os.path.splitext(path)[1].lower()
    try:
        if ext in (".docx", ".xlsx", ".pptx"):
            return "", office(raw, ext)[:MAX_TEXT], {}, ""
        if ext == ".eml":
            title, body, extra = message(raw)
            return title, body[:MAX_TEXT], extra, ""
        if ext in (".mbox", ".mbx"):
            mails = [message(p) for p in mailbox(raw)]
            moments = [m[2]["moment"] for m in mails if "moment" in m[2]]
            extra = {"berichten": str(len(mails))} | ({"moment": max(moments)} if moments else {})
            return "", "\n\n".join("\n".join(x for x in (m[2].get("van", ""), m[0], m[1]) if x) for m in mails)[:MAX_TEXT], extra, ""
        if ext == ".pdf":
            body = pdf(raw)[:MAX_TEXT]
            return "", body, {"bytes": str(len(raw))}, "" if body else "no text layer that can be read"
        if ext in (".mp3", ".wav", ".flac", ".m4a", ".ogg", ".wma", ".aac", ".aiff", ".aif", ".opus"):
            tags = music(raw)
            return tags.get("muziektitel", ""), "\n".join(dict.fromkeys(tags.values())), tags, ""
        body = decode(raw[:MAX_READ])
        if ext == ".json":
            try:
                body = json.dumps(json.loads(body), ensure_ascii=False, indent=1)
            except ValueError:
                pass
        return "", body[:MAX_TEXT], {}, ""
    except (zipfile.BadZipFile, KeyError):
        return "", "", {}, "damaged or not a real office file"
    except Exception as e:  # a file may hold anything; its row says what went wrong
        return "", "", {}, f"{type(e).__name__}: {e}"[:300]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.map_(pa.string(), pa.string())
    for batch in batches:
        titles, texts, extras, errors = [], [], [], []
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                if raw is None:
                    with open(path, "rb") as f:
                        raw = f.read(MAX_FILE_SIZE)
                found = extract_one(path, raw)
            except OSError as e:
                found = ("", "", {}, f"{type(e).__name__}: {e.strerror}")
            for out, value in zip((titles, texts, extras, errors), found, strict=True):
                out.append(value)
        extra = pa.array([list(e.items()) for e in extras], kinds)
        rest = [batch.column(c) for c in ("source", "path", "size", "mtime")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(titles, pa.string()), pa.array(texts, pa.string()), extra, pa.array(errors, pa.string())], names=["source", "path", "size", "mtime", "title_", "body_", "extra", "error"])


def documents(found: DataFrame) -> DataFrame:
    """Documents of files ``source, path, size, mtime`` and, if the column is there, ``content``: HTML stripped, title,
    kind, and the date a mail states before the file's own."""
    content: Column = F.col("content") if "content" in found.columns else F.lit(None).cast("binary")
    rows = found.select("source", "path", "size", "mtime", content.alias("content"))
    rows = rows.mapInArrow(_extract, "source string, path string, size long, mtime timestamp_ntz, title_ string, body_ string, extra map<string,string>, error string")
    ext, stem = tx.extension(F.col("path")), F.regexp_replace(tx.file_name(F.col("path")), r"(?<=[^.])\.[^.]*$", "")
    body = F.when(ext.isin(".htm", ".html", ".xhtml"), tx.strip_html(F.col("body_"))).otherwise(F.col("body_"))
    rows = rows.withColumn("text", body)
    kind = tx.kind_of(F.col("path"))
    artist, title = tx.artist_and_title(F.col("path"))
    named = F.when(kind == "tekst", tx.title_of(F.col("text"), stem)).when(kind == "muziek", title).otherwise(tx.file_name(F.col("path")))
    text = F.when(kind == "muziek", F.concat_ws("\n", tx.file_name(F.col("path")), stem, F.nullif("text", F.lit("")), artist)).otherwise(F.col("text"))
    garbled = (kind == "pdf") & (F.col("error") == "") & tx.unreadable(F.col("text"))
    text, error = F.when(garbled, F.lit("")).otherwise(text), F.when(garbled, F.lit("no text layer that can be read")).otherwise(F.col("error"))
    date = search_date(F.col("mtime"), F.try_element_at("extra", F.lit("moment")))
    return rows.select("source", "path", F.coalesce(F.nullif("title_", F.lit("")), named).alias("title"), kind.alias("kind"), F.when(kind == "mail", date).otherwise(F.col("mtime")).alias("mtime"), "size", text.alias("text"), "extra", error.alias("error"), F.col("mtime").alias("file_mtime"))
