"""The n-gram Jaccard join and connected components against brute force."""

import random
import re

import numpy as np
import pytest

from quaero.llm import ngram_join
from quaero.llm.components import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(docs, percent=80):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    bases = [[word() for _ in range(r.choice([2, 4, 5, 9, 40, 120]))] for _ in range(14)]
    passages = [[word() for _ in range(30)] for _ in range(4)]
    docs = {}
    for i in range(220):
        w = list(r.choice(bases)) if r.random() < 0.8 else r.choice(passages) + r.choice(passages) + [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        t = r.choice([" ", "\n", "  "]).join(w)
        docs[i] = t.upper() if r.random() < 0.1 and "é" not in t else t
    return docs | {220: None, 221: "", 222: "  \n", 223: "one", 224: "One", 225: "x " * 900}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in docs.items()], "doc_id long, text string, n long, bucket string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(df).collect()}
    assert got == brute(docs)


def test_split_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 500)
    docs = corpus(4)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(df).collect()}
    assert got == brute(docs)


def test_join_bucket_on_star_of_mutations():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**62, 146).astype(np.uint64)
    sets = [np.sort(base)]
    for _ in range(200):
        s = base.copy()
        for _ in range(r.integers(1, 5)):
            at = r.integers(0, 140)
            s[at : at + 5] = r.integers(0, 2**62, 5).astype(np.uint64)
        sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    got = ngram_join.join_bucket(n, np.concatenate(sets), np.zeros(len(sets), int), 80)
    root = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (n[a] + n[b] - both):
                x, y = root[a], root[b]
                root[np.isin(root, [x, y])] = min(x, y)
    assert (got == root).all()


def test_repeated_and_null_ids_and_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (1, "other words here now at last"), (2, t), (None, t), (None, "alone as such it is")], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in ngram_join.similar_components(df).collect())
    assert [g[2] for g in got if g[1] == 56] == [1, 1, 1, 1]
    assert [g[2] for g in got if g[0] == (True, 0) and g[1] == 1] == [None]
    assert ngram_join.similar_components(df.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(0).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001), (1002, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_components_of_a_short_chain(spark):
    chain = spark.createDataFrame([(i * 7 % 40, (i + 1) * 7 % 40) for i in range(39)], "a long, b long")
    assert {r.component for r in components(chain).collect()} == {0}
