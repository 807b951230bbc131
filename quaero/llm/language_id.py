"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into stretches of ``STEPS`` bytes, which run through the network side by side. Each position gets the
states of a forward and a backward gated recurrent layer and from them a distribution over the languages; a text's
probabilities are the mean over all its positions. Training is by backpropagation through time with Adam, on the
driver, on a bounded sample of stretches from labelled texts; prediction runs in tasks over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaero.llm.common import batch_of, blocks, in_batches, materialise, text_bytes
from quaero.llm.toxicity import held_out

STEPS = 64
#: Stretches that run through the network side by side.
ASIDE = 2048
UNKNOWN = "und"
#: Most languages whose counts are sent to every executor.
MOST_BROADCAST = 100_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Network:
    """``x``: input part of the gates for each byte (2 directions, 257, 3h; the last row is padding); ``u``: recurrent
    part (2, h, 3h); ``b``: bias inside the reset (2, h); ``v``, ``c``: output layer (2h, languages), (languages)."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def fresh(langs: list[str], hidden: int, seed: int) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        return Network(langs, f(2, 257, 3 * hidden, s=0.3), f(2, hidden, 3 * hidden, s=hidden**-0.5), f(2, hidden, s=0.0), f(2 * hidden, len(langs), s=0.3), f(len(langs), s=0.0))

    @property
    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.v, self.c]

    def states(self, bytes_: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, stretches, h) for byte numbers (steps, stretches)."""
        x, u, b = self.x[direction], self.u[direction], self.b[direction]
        h_n = u.shape[0]
        out = np.empty((*bytes_.shape, h_n), np.float32)
        h = np.zeros((bytes_.shape[1], h_n), np.float32)
        for t in range(len(bytes_)) if direction == 0 else range(len(bytes_) - 1, -1, -1):
            gates = h @ u
            inp = x[bytes_[t]]
            zr = _sigmoid(gates[:, : 2 * h_n] + inp[:, : 2 * h_n])
            z, r = zr[:, :h_n], zr[:, h_n:]
            inner = gates[:, 2 * h_n :] + b
            n = np.tanh(inp[:, 2 * h_n :] + r * inner)
            if keep is not None:
                keep.append((t, h, z, r, inner, n))
            h = n + z * (h - n)
            out[t] = h
        return out

    def probabilities(self, bytes_: np.ndarray) -> np.ndarray:
        """(steps, stretches, languages): a label distribution for every position."""
        h = np.concatenate([self.states(bytes_, 0), self.states(bytes_, 1)], axis=2)
        y = h.reshape(-1, h.shape[2]) @ self.v + self.c
        np.exp(y - y.max(axis=1, keepdims=True), out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y.reshape(*bytes_.shape, -1)

    def gradients(self, bytes_: np.ndarray, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the positions that hold a byte, and its gradients by backpropagation through time."""
        steps, n = bytes_.shape
        h_n = self.u.shape[1]
        kept: tuple[list, list] = ([], [])
        h = np.concatenate([self.states(bytes_, d, kept[d]) for d in (0, 1)], axis=2)
        flat = h.reshape(-1, 2 * h_n)
        y = flat @ self.v + self.c
        y -= y.max(axis=1, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=1, keepdims=True)
        real = (bytes_ < 256).reshape(-1)
        weight = (real / max(1, real.sum())).astype(np.float32)
        target = np.tile(lang, steps)
        rows = np.arange(len(target))
        loss = float(-(np.log(p[rows, target] + 1e-12) * weight).sum())
        p[rows, target] -= 1
        p *= weight[:, None]
        gv, gc = flat.T @ p, p.sum(axis=0)
        gh = (p @ self.v.T).reshape(steps, n, 2 * h_n)
        gx, gu, gb = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.b)
        for d in (0, 1):
            u = self.u[d]
            carry = np.zeros((n, h_n), np.float32)
            by_step = np.empty((steps, n, 3 * h_n), np.float32)
            for t, before, z, r, inner, new in reversed(kept[d]):
                g = gh[t, :, d * h_n : (d + 1) * h_n] + carry
                g_new = g * (1 - z) * (1 - new * new)
                g_in = by_step[t]
                g_in[:, :h_n] = g * (before - new) * z * (1 - z)
                g_in[:, h_n : 2 * h_n] = g_new * inner * r * (1 - r)
                g_in[:, 2 * h_n :] = g_new
                g_rec = g_in.copy()
                g_rec[:, 2 * h_n :] *= r
                gu[d] += before.T @ g_rec
                gb[d] += g_rec[:, 2 * h_n :].sum(axis=0)
                carry = g * z + g_rec @ u.T
            np.add.at(gx[d], bytes_.reshape(-1), by_step.reshape(-1, 3 * h_n))
        return loss, [gx, gu, gb, gv, gc]


def fit(langs: list[str], stretches: np.ndarray, lang: np.ndarray, hidden: int = 8, epochs: int = 6, batch: int = 128, rate: float = 0.02, seed: int = 0) -> Network:
    """Train on stretches (n, STEPS) of byte numbers (256: padding) with the numbers of their languages."""
    net = Network.fresh(langs, hidden, seed)
    m, v = [np.zeros_like(p) for p in net.params], [np.zeros_like(p) for p in net.params]
    r, step = np.random.default_rng(seed), 0
    total = epochs * -(-len(stretches) // batch)
    for _ in range(epochs):
        order = r.permutation(len(stretches))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            _, grads = net.gradients(np.ascontiguousarray(stretches[own].T), lang[own])
            step += 1
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grads)))))
            now = rate * (1 - 0.9 * step / total)
            for p, g, a, b in zip(net.params, grads, m, v, strict=True):
                g = g * scale
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return net


def _cut(raw: np.ndarray) -> np.ndarray:
    """Byte numbers of a text in stretches (n, STEPS), padded with 256."""
    n = -(-len(raw) // STEPS)
    out = np.full(n * STEPS, 256, np.int64)
    out[: len(raw)] = raw
    return out.reshape(n, STEPS)


def learn(docs: DataFrame, per_language: int = 400, stretches: int = 4, **settings) -> Network | None:
    """Fit on about ``per_language`` labelled texts of each language, ``stretches`` stretches from each, spread evenly
    over the whole text. Held-out rows and rows with a null text, language or id are not used. None: nothing to learn."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").filter(~held_out(F.col("doc_id")))
    counts = materialise(rows.groupBy("lang").count(), "languages")
    # a row for each output of the network; only beyond any sensible number of languages are texts shuffled for it
    counts = F.broadcast(counts) if counts.count() <= MOST_BROADCAST else counts
    share = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) * F.col("count") < per_language * 1_000_000
    picked = rows.join(counts, "lang").filter(share).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                all_ = _cut(np.frombuffer(text.encode(), np.uint8))
                at = sorted({int(x) for x in np.linspace(0, len(all_) - 1, stretches)})
                yield batch_of(doc_id=pa.array([i] * len(at), pa.int64()), at=pa.array(at, pa.int32()), lang=pa.array([lang] * len(at)), s=pa.array([all_[a].astype(np.int16).tobytes() for a in at], pa.binary()))

    got = picked.transform(in_batches, cut, "doc_id long, at int, lang string, s binary").toPandas().sort_values(["doc_id", "at", "lang", "s"])
    if not len(got):
        return None
    langs = sorted(got["lang"].unique())
    data = np.frombuffer(b"".join(got["s"]), np.int16).reshape(-1, STEPS).astype(np.int64)
    return fit(langs, data, got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), **settings)


def predict(docs: DataFrame, net: Network | None, whole_rows: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from the text alone: the language with the highest mean probability
    over the positions of the whole text, and that probability.

    A text that is null or has no letter is ``und`` with score 0, and so is everything if nothing was learned. Ties go
    to the first language in order. With ``whole_rows`` each row also comes whole, as the struct ``row``. Rows are labelled one by one, so repeated rows and null ids need no rule; an
    empty table gives no rows. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            data, offs = text_bytes(batch.column("row").field("text") if whole_rows else batch.column("text"))
            for i, j in blocks(offs, 1 << 18):
                here = offs[i : j + 1] - offs[i]
                raw = data[offs[i] : offs[j]]
                size = np.diff(here)
                lettered = np.diff(np.concatenate([[0], np.cumsum(letter[raw])])[here]) > 0
                for d in np.flatnonzero(~lettered & (size > 0)):
                    lettered[d] = any(map(str.isalpha, raw[here[d] : here[d + 1]].tobytes().decode("utf-8", "replace")))
                best, top = np.zeros(j - i, np.int64), np.zeros(j - i)
                if net is not None and size.sum():
                    pieces = -(-size // STEPS)
                    first = np.concatenate([[0], np.cumsum(pieces)])
                    cells = np.full(int(first[-1]) * STEPS, 256, np.int16)
                    cells[np.arange(len(raw)) + np.repeat(first[:-1] * STEPS - here[:-1], size)] = raw
                    cells = cells.reshape(-1, STEPS)
                    sums = np.zeros((len(cells), len(net.langs)))
                    for a in range(0, len(cells), ASIDE):
                        part = np.ascontiguousarray(cells[a : a + ASIDE].T)
                        p = net.probabilities(part)
                        sums[a : a + ASIDE] = np.einsum("tbl,tb->bl", p, (part < 256).astype(np.float32))
                    total = np.concatenate([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
                    mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(size, 1)[:, None]
                    best, top = mean.argmax(axis=1), mean.max(axis=1)
                known = lettered & (net is not None)
                names = [net.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                more = {"row": batch.column("row").slice(i, j - i)} if whole_rows else {}
                yield batch_of(doc_id=batch.column("doc_id").slice(i, j - i), lang_pred=pa.array(names, pa.string()), score=pa.array(np.clip(np.where(known, top, 0.0), 0, 1)), **more)

    schema = T.StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double")
    if whole_rows:
        schema = schema.add("row", docs.schema)
    text = F.struct("*").alias("row") if whole_rows else F.col("text").cast("string").alias("text")  # a text travels once
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).transform(in_batches, run, schema)


def keep_known(docs: DataFrame, net: Network | None, least: float) -> DataFrame:
    """``docs`` with its columns, without the rows that are ``und`` or whose language is less probable than ``least``."""
    return predict(docs, net, whole_rows=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
