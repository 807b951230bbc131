import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quaero.llm import fill_middle

SCHEMA = "doc_id long, text string"


def brute(doc_id, text, seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    out = f"<S>{z}<P>{x}<M>{y}" if h[3] % 100 < 20 else f"<P>{x}<S>{z}<M>{y}"
    return n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, out


def test_against_brute_force(spark):
    r = random.Random(4)
    letters = ["a", "é", "漢", "😀", " ", "\n", "<", ">", "P", "S", "M", "\x00", "\r\n"]
    rows = [(i, "".join(r.choice(letters) for _ in range(r.randrange(40)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "x<P>y"), (1003, "<M>"), (1004, "<P"), (1005, "S><S"), (7, "another text of a used id"), (7, "another text of a used id"), (None, "no id"), (1006, "ab漢" * 400_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"output": F.lit("clash"), "n": F.lit(-1), "form": F.lit("psm"), "digest": F.lit("x"), "h0": F.lit(1)})
    got = fill_middle.fill_middle(docs).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_units, x.middle_units, x.output) for x in got), key=key) == sorted(((i, *brute(i, t)) for i, t in rows), key=key)
    texts = sorted((t or "") for _, t in rows)
    assert sorted(x.restored for x in got) == texts
    assert {x.form for x in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit, cut", [("word", r"\S+\s*|\s+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_other_units(spark, unit, cut):
    import re

    texts = ["one two  three\nfour", "  lead\n\n\ntail ", "x", "\n", "é ü\nß"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for seed in "abcdef":
        for x in fill_middle.fill_middle(docs, seed=seed, unit=unit, plain_percent=0, spm_percent=0).collect():
            units = re.findall(cut, texts[x.doc_id])
            a, b = x.prefix_units, x.prefix_units + x.middle_units
            assert x.n == len(units)
            assert x.output == f"<P>{''.join(units[:a])}<S>{''.join(units[b:])}<M>{''.join(units[a:b])}"


def test_other_marks(spark):
    marks = ("<fim_prefix>", "<fim_suffix>", "<fim_middle>")
    docs = spark.createDataFrame([(i, "some text " * i) for i in range(1, 60)], SCHEMA)
    got = fill_middle.fill_middle(docs, marks=marks).withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"), marks))
    assert all(x.restored == "some text " * x.doc_id for x in got.collect())
    for bad in (("<a<", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<S>x", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.check_marks(bad)


def test_empty_table(spark):
    assert fill_middle.fill_middle(spark.createDataFrame([], SCHEMA)).collect() == []
