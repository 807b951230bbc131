"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Exact BPE in linear time: an Aho-Corasick automaton of the reversed tokens, run once over the reversed piece, names
the longest token that starts at every byte. The encoder takes the longest token at each position and keeps it if it
is *compatible* with the token before: a pair is compatible if merging those two tokens' bytes by rank would leave
exactly these two. Otherwise it tries the next shorter token that starts there, and when none is left it marks the
position as a dead end and takes back the previous token. A sequence of pairwise compatible tokens is the BPE result,
and each position is abandoned at most once. Compatibility of a pair is worked out once and kept in a table.

Pieces repeat, so each worker keeps a bounded memo of pieces; it changes the cost, not the result. The vocabulary is
a Hugging Face ``tokenizer.json`` of the byte-level BPE kind, whose path is a parameter; the driver reads it and broadcasts it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.llm.common import batch_of, blocks, in_batches, text_bytes

#: Fixed value: how byte-level BPE of this family cuts text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept by a worker, and half of the pairs of tokens.
MEMO = 200_000
NONE = -1


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A vocabulary, ready to encode and decode. Tokens are numbered by rank inside: 256 bytes, then merges in order."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letter = _byte_letters()
        raw = lambda t: bytes(letter[c] for c in t)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pair: dict[tuple[int, int], int] = {}
        self.token: list[bytes] = [bytes([b]) for b in range(256)]
        for merge in merges:
            a, b = (raw(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            at = number.setdefault(a + b, len(self.token))
            if at == len(self.token):
                self.token.append(a + b)
                self.parts.append((number[a], number[b]))
            self.pair.setdefault((number[a], number[b]), at)
        ids = {raw(t): i for t, i in vocab.items()}
        self.ids = [np.uint32(ids[t]).tobytes() for t in self.token]
        self.reversed = ahocorasick.Automaton()
        for n, t in enumerate(self.token):
            self.reversed.add_word(t[::-1].decode("latin-1"), n)
        self.reversed.make_automaton()
        self.shorter = [self._prefix(t, number) for t in self.token]
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.cut = regex.compile(PIECES)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {t: np.uint32(i).tobytes() for t, i in special.items()}
        self.special_cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        size = max([*ids.values(), *special.values()]) + 1
        table = [b""] * size
        for t, i in ids.items():
            table[i] = t
        for t, i in special.items():
            table[i] = t.encode()
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)

    @staticmethod
    def _prefix(token: bytes, number: dict[bytes, int]) -> int:
        return next((number[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in number), NONE)

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2 * MEMO:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        """Undo the two tokens' merges from the latest on; no pair across the seam may merge before the one undone."""
        limit = len(self.token)
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a > b:
                undone, a = a, self.parts[a][1]
                if a != undone:
                    limit = undone  # the seam's pair must wait for the left token: equal rank merges leftmost first
                    continue
                undone, b = b, self.parts[b][0]
                if b == undone:
                    return True
                limit = undone + 1
            else:
                undone, b = b, self.parts[b][0]
                if b != undone:
                    limit = undone + 1
                    continue
                undone, a = a, self.parts[a][1]
                if a == undone:
                    return True
                limit = undone

    def piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [NONE] * n
        for end, token in self.reversed.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] == NONE:  # the longest that ends here comes first
                longest[at] = token
        if n and len(self.token[longest[0]]) == n:
            return [longest[0]]
        live = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else NONE
        while token != NONE:
            end = at + len(self.token[token])
            if live[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end] if end < n else NONE
                continue
            token = self.shorter[token]
            if token == NONE:
                live[at] = False
                last = out.pop()
                at -= len(self.token[last])
                token = last
                token = self.shorter[last] if not live[at + len(self.token[last])] else last
                while token == NONE and out:
                    live[at] = False
                    last = out.pop()
                    at -= len(self.token[last])
                    token = self.shorter[last] if not live[at + len(self.token[last])] else last
        return out

    def _missing(self, piece: str) -> bytes:
        found = b"".join(self.ids[t] for t in self.piece(piece.encode()))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(piece) <= 64:
            self.memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.special_cut and any(t in text for t in self.special):
            return b"".join(self.special[part] if part in self.special else self._ordinary(part) for part in self.special_cut.split(text) if part)
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        known, missing = self.memo.get, self._missing
        return b"".join([known(p) or missing(p) for p in self.cut.findall(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.offset[ids + 1] - self.offset[ids]
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.blob[at + np.repeat(self.offset[ids] - (ends - lengths), lengths)].tobytes()


@lru_cache(maxsize=4)
def load(file: bytes) -> Encoder:
    return Encoder(file)


def _run(docs: DataFrame, path: str, encode: bool, decode: bool, carry: str | None = None):
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, a few MB; workers need not have it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(file.value)
        for batch in batches:
            data, offs = text_bytes(batch.column("text" if encode else "ids"))
            for i, j in blocks(offs, 4 << 20):
                ids, texts = [], []
                for a, b in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True):
                    raw = data[a:b].tobytes()
                    coded = coder.encode(raw.decode("utf-8", "replace")) if encode else raw
                    ids.append(coded)
                    if decode:
                        texts.append(coder.decode(np.frombuffer(coded, np.uint32).astype(np.int64)).decode("utf-8", "replace"))
                out = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                out |= {"decoded": pa.array(texts, pa.string())} if decode else {}
                yield batch_of(**out | ({carry: batch.column(carry).slice(i, j - i)} if carry else {}))

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian uint32) for every row. A null or empty text has no ids; special tokens'
    strings in a text become their ids, as the library does. Rows are coded one by one: null ids, repeated rows and
    other columns need no rule; an empty table gives no rows."""
    return _texts(docs, id_col, text_col).transform(in_batches, _run(docs, path, True, False), "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for rows ``doc_id, ids``; bytes that are no UTF-8 become U+FFFD."""
    return encoded.select("doc_id", "ids").transform(in_batches, _run(encoded, path, False, True), "doc_id long, n_tokens long, ids binary, decoded string")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows; ``carry`` names a whole-number column that goes along."""
    rows, schema = _texts(docs, id_col, text_col), "doc_id long, n_tokens long, ids binary, decoded string"
    if carry:
        rows, schema = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(carry).cast("long").alias(carry)), f"{schema}, {carry} long"
    return rows.transform(in_batches, _run(docs, path, True, True, carry), schema)
