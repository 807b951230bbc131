"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quaero.llm import common, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, key string, k string, lo string"


def brute_bytes(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - window + 1):
            w = raw[s : s + window]
            if w in seen:
                gone[s : s + window] = True
            seen.add(w)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def brute_words(docs, window):
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone, own = [False] * len(words), set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            own.add(w)
        seen |= own
        spans = sum(1 for p in range(len(words)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(words), sum(gone), spans, " ".join(w for w, g in zip(words, gone) if not g).encode())
    return out


def corpus(seed, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(5, 90))) for _ in range(12)]
    docs = {}
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages) if r.random() < 0.6 else " ".join(word() for _ in range(r.randint(1, 60)))
            if r.random() < 0.3:
                ws = p.split(" ")
                ws[r.randrange(len(ws))] = word()
                p = " ".join(ws)
            parts.append(p)
        docs[i] = r.choice([" ", "\n", ""]).join(parts)
    docs |= {150: None, 151: "", 152: "a" * 700, 153: "a" * 90, 154: "ab " * 400, 155: docs[3], 156: docs[7], 157: "x y " * 100, 158: "é" * 300}
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_against_brute_force(spark, kind, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs.items()], SCHEMA).repartition(5)
    window = 100 if kind == "bytes" else 50
    op = suffix_dedup if kind == "bytes" else substring_dedup
    want = (brute_bytes if kind == "bytes" else brute_words)(docs, window)
    got = {r.doc_id: (r.n_symbols, r.n_removed, r.n_spans, bytes(r.kept)) for r in op.remove_repeats(df).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [3])
def test_overfull_segments_are_split_and_stay_exact(spark, monkeypatch, seed):
    for op, brute, window in ((suffix_dedup, brute_bytes, 100), (substring_dedup, brute_words, 50)):
        for name, value in (("LIMIT", 3), ("SHARD", 4), ("PER_BUCKET", 1000), ("CHUNK", 2)):
            if hasattr(op, name):
                monkeypatch.setattr(op, name, value)
        docs = corpus(seed, 40)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_symbols, r.n_removed, r.n_spans, bytes(r.kept)) for r in op.remove_repeats(df).collect()}
        assert got == brute(docs, window)


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(120))
    other = " ".join(f"v{i}" for i in range(120))
    rows = [(1, long), (1, long), (2, long), (3, other), (3, other + " end"), (None, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for op in (suffix_dedup, substring_dedup):
        got = op.remove_repeats(df).collect()
        assert len(got) == len(rows)
        assert [r.n_removed for r in got if r.doc_id == 1] == [0, 0]
        assert all(r.n_removed == r.n_symbols > 0 for r in got if r.doc_id == 2)
        three = sorted(r.n_removed for r in got if r.doc_id == 3)
        assert three[0] == 0 and three[1] > 0
        assert sorted(r.n_removed for r in got if r.doc_id is None)[0] == 0
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_merged_transform_equals_that_of_all_suffixes():
    rng = np.random.default_rng(0)
    rows, width, window = 60, 30, 12
    strings = rng.integers(97, 99, (width, rows)).astype(np.uint8)
    strings[:, 20:40] = strings[:, :20]
    k, zero = np.arange(rows), np.zeros(rows, np.int32)
    made = [suffix_dedup.shard(strings[:, i], k[i], zero[i], zero[i], zero[i] + width, window) for i in (slice(0, 7), slice(7, 33), slice(33, 60))]
    cells = [next(m.cells(np.ones(len(m.k), bool), np.zeros(len(m.k), np.int64)))[1] for m in made]
    merged = suffix_dedup.Merge(cells, width, window)
    assert (merged.strings() == strings).all()
    for c in range(width):
        suffixes = [strings[c + 1 :, i].tobytes() for i in merged.orders[c]]
        assert suffixes == sorted(suffixes)
        assert [strings[c, i] for i in merged.orders[c]] == merged.bwt[c].tolist()
    for c in range(width - window + 1):
        windows = [strings[c : c + window, i].tobytes() for i in range(rows)]
        assert [w in windows[:i] for i, w in enumerate(windows)] == merged.hit[:, c].tolist()
    assert merged.copies.tolist() == [strings[:, i].tobytes() in [strings[:, j].tobytes() for j in range(i)] for i in range(rows)]


def test_common_prefixes_of_refined_neighbours():
    rng = np.random.default_rng(1)
    strings = rng.integers(97, 100, (40, 9)).astype(np.uint8)
    row, lcp = np.arange(40), np.zeros(40, np.int16)
    for c in range(8, -1, -1):
        order, lcp = suffix_dedup.refine(strings[row, c], lcp)
        row = row[order]
        found = [strings[i, c:].tobytes() for i in row]
        for i in range(1, 40):
            assert lcp[i] == next((j for j, (x, y) in enumerate(zip(found[i - 1], found[i])) if x != y), 9 - c)


def test_digest_of_kept_bytes(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    r = suffix_dedup.remove_repeats(df).selectExpr("sha2(kept, 256) h").first()
    assert r.h == hashlib.sha256(b"abc").hexdigest()


def test_memory_of_a_shard_is_bounded():
    """A full shard's rows take their bytes and not eight times as much for their places."""
    rng, n = np.random.default_rng(2), suffix_dedup.SHARD
    unit = suffix_dedup.Unit(False, 100, 32, 256, True)
    text = rng.integers(97, 123, n * 128).astype(np.uint8).tobytes().decode()
    found = [{"lo": int(p), "ref": int(p), "at": 0} for p in range(0, len(text) - unit.window, 128)]
    batch = pa.RecordBatch.from_pylist([{"k": 1, "text": text, "asked": found}])
    tracemalloc.start()
    try:
        cells = sum(b.num_rows for b in suffix_dedup._shards(unit, 1)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert cells > 0
    assert peak < 80e6


def test_laid_out_rows():
    data = np.arange(10, dtype=np.uint8)
    got = suffix_dedup.laid_out(data, np.array([-2, 3, 7]), np.array([2, 0, 1]), np.array([4, 5, 3]), 5)
    pad = suffix_dedup.PAD
    assert got.T.tolist() == [[pad, pad, 0, 1, pad], [3, 4, 5, 6, 7], [pad, 8, 9, pad, pad]]
    assert suffix_dedup.laid_out(data[:0], np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 5).shape == (5, 0)


def test_a_task_gives_its_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "release", lambda: freed.append(1))
    run = common.giving_back(lambda batches: (2 * b for b in batches))
    assert list(run(iter([1, 2, 3]))) == [2, 4, 6] and len(freed) == 1
    early = run(iter([1, 2, 3]))
    next(early)
    early.close()  # a task that Spark ends early
    assert len(freed) == 2


def test_an_overfull_bucket_is_split_by_contents_at_once():
    rng = np.random.default_rng(4)
    unit, n = suffix_dedup.Unit(False, 100, 32, 256, True), 40
    strings = rng.integers(97, 123, (unit.width, n)).astype(np.uint8)
    zero = np.zeros(n, np.int16)
    made = suffix_dedup.shard(strings, np.arange(n), zero.astype(np.int32), zero, zero + unit.width, unit.window)
    cells = lambda fan: [c for b in suffix_dedup._split(unit, made, 5, 0, unit.width - unit.window, fan) for c in b.filter(b.column("k").is_null()).to_pylist()]
    parts = sorted({(c["c0"], c["c1"]) for c in cells(3)})
    assert [x for a, b in parts for x in range(a, b + 1)] == list(range(unit.width - unit.window + 1))
    # all windows of a part share bytes, so rows that differ there may go to different buckets
    assert all(3 * (a + unit.window - b) >= unit.window for a, b in parts)
    assert len({c["bucket"] for c in cells(1 << 60)}) == n * len(parts) and len({c["bucket"] for c in cells(3)}) == 3 * len(parts)


def test_rows_equal_throughout_are_found_where_others_share_their_ends():
    rng = np.random.default_rng(5)
    strings = rng.integers(97, 99, (9, 300)).astype(np.uint8)
    zero = np.zeros(300, np.int16)
    made = suffix_dedup.shard(strings, np.arange(300), zero.astype(np.int32), zero, zero + 9, 4)
    rows = [strings[:, i].tobytes() for i in range(300)]
    assert made.copies.tolist() == [r in rows[:i] for i, r in enumerate(rows)] and made.copies.any()
