import collections
import random
import re

from pyspark.sql import functions as F

from quaero.llm import quality

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + o for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for o in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def normal(line):
    return " ".join(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w)) for w in WORD.findall(line))


def brute(rows, line_docs, line_share, least=50):
    hosts = collections.Counter(s for _, _, s in rows)
    held = collections.Counter((s, x) for _, t, s in rows for x in {normal(y) for y in (t or "").split("\n")} if x)
    out = []
    for i, t, s in rows:
        n, chars, symbols, dup, rep = base(t)
        gone = [y for y in (t or "").split("\n") if normal(y) and held[s, normal(y)] > line_docs and held[s, normal(y)] > hosts[s] * line_share]
        removed = sum(len(WORD.findall(y)) for y in gone)
        failed = n < least or 100 * rep > 50 * n
        out.append((i, n, chars, symbols, dup, rep, len(gone), removed, failed, not failed and n - removed >= least and 100 * removed <= 50 * n))
    return out


def made(seed, n=300):
    r = random.Random(seed)
    frequent = ["All rights reserved 2024", "click  HERE & now", "cookie * policy 17"]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randrange(12)):
            k = r.random()
            lines.append(r.choice(frequent).replace("2024", str(r.randrange(9999)).zfill(4)) if k < 0.3 else r.choice(["", " \t", "é x\x0by", "|<>#"]) if k < 0.5 else " ".join(r.choice("ab漢cde") for _ in range(r.randrange(1, 30))))
        rows.append((i, "\n".join(lines), r.choice(["hot", "hot", "hot", "b", None, ""])))
    rows += [(1, rows[1][1], rows[1][2]), (None, "null id\n" + " ".join(map(str, range(60))), "b"), (900, None, "b"), (901, "", "hot"), (902, "\n\n", None), (903, "\n".join(f"line {'xyz'[i % 3]} w{i}" for i in range(60_000)), "hot")]
    return rows


def key(x):
    return tuple((v is None, v or 0) for v in x)


def test_against_brute_force(spark):
    rows = made(3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"host": F.lit("clash"), "k": F.lit(1), "lines": F.lit(2), "n_words": F.lit(3), "h": F.lit(0)})
    for docs_, share in ((10, 0.01), (3, 0.2)):
        got = quality.judged(docs, line_docs=docs_, line_share=share)
        want = sorted(brute(rows, docs_, share), key=key)
        assert sorted(map(tuple, got.collect()), key=key) == want
    assert any(x[6] for x in want) and any(x[9] for x in want) and any(not x[8] and not x[9] for x in want)


def test_cleaned_texts(spark):
    rows = made(8)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit("clash"), "gone": F.array(F.lit(1))})
    hosts = collections.Counter(s for _, _, s in rows)
    held = collections.Counter((s, x) for _, t, s in rows for x in {normal(y) for y in (t or "").split("\n")} if x)
    want = []
    for (i, t, s), v in zip(rows, brute(rows, 10, 0.01), strict=True):
        if v[9]:
            want.append((i, "\n".join(y for y in t.split("\n") if not (normal(y) and held[s, normal(y)] > 10 and held[s, normal(y)] > hosts[s] * 0.01)), s, "clash"))
    got = quality.cleaned(docs)
    assert got.columns == docs.columns
    assert sorted(((x.doc_id, x.text, x.source, x.row) for x in got.collect()), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.judged(docs).collect() == [] and quality.cleaned(docs).collect() == []
