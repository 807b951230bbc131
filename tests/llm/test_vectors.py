"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
import pytest

from quaero.llm import pivot_index, rp_forest

SCHEMA = "vec_id long, embedding array<float>, label int, k string, m string"


def clustered(seed, n=400, d=16):
    r = np.random.default_rng(seed)
    rows = []
    centres = r.standard_normal((25, d))
    for i in range(n):
        c = centres[r.integers(25)]
        v = c + r.standard_normal(d) * r.choice([0.0, 0.02, 0.1, 0.25, 0.4])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(r.integers(3)) if r.random() < 0.9 else None, "a", "b"))
    bad = [[0.0] * d, None, [1.0] * (d - 1) + [None], [1.0] * (d - 1) + [float("nan")], [float("inf")] + [0.0] * (d - 1), [], [1.0, 2.0]]
    rows += [(n + j, v, 0, "a", "b") for j, v in enumerate(bad)]
    rows += [(n + 20, [1.0, 2.0], 0, "a", "b")]
    return rows


def ok(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(rows, cosine):
    use = [(i, np.array(v, np.float64), lab) for i, v, lab, *_ in rows if ok(v) and lab is not None]
    root = {r[0]: r[0] for r in rows}
    links = {r[0]: 0 for r in rows}
    near = []
    for a in range(len(use)):
        for b in range(a):
            (i, x, p), (j, y, q) = use[a], use[b]
            if p == q and len(x) == len(y):
                c = x @ y / np.sqrt((x @ x) * (y @ y))
                if c >= cosine:
                    links[i] += 1
                    links[j] += 1
                    lo, hi = sorted((root[i], root[j]))
                    for z in root:
                        if root[z] == hi:
                            root[z] = lo
                near.append(c)
    return links, root


@pytest.mark.parametrize("block", [2048, 40])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rows = clustered(1)
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    links, root = brute_links(rows, 0.93)
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= links[r.vec_id] for r in got)  # none below the threshold
    assert found >= 0.97 * sum(links.values())
    same = [r for r in got if r.component_id == root[r.vec_id]]
    assert len(same) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("n", [50_000, 500_000, 2_000_000])
def test_recall_and_cost_at_the_pivots_of_three_sizes(n):
    r = np.random.default_rng(n)
    own = pivot_index.fit(pivot_index.unit(r.standard_normal((2048, 64))), pivot_index.default_pivots(n), 0.93)
    a, b = pivot_index.unit(r.standard_normal((3000, 64))), r.standard_normal((3000, 64))
    b -= np.einsum("ij,ij->i", a, b)[:, None] * a
    c = r.uniform(0.93, 0.96, (3000, 1))
    p, q = own.permutation(a), own.permutation(c * a + np.sqrt(1 - c * c) * pivot_index.unit(b))
    met = lambda x, y: (pivot_index._shared(x[:, : own.head], y[:, : own.head]) >= 2) & (pivot_index._shared(x, y) >= own.least)
    assert met(p, q).mean() >= 0.99
    assert met(p, np.roll(q, 1, axis=0)).mean() < 0.01


def evaluated(x, pivots=256, cosine=0.93):
    """Links found, pairs whose shared pivots are counted, and cosines, each pair both ways."""
    own = pivot_index.fit(x[:2048], pivots, cosine)
    perm = own.permutation(x)
    lists = pivot_index.lists_of(perm, own.head, len(own.points))
    links = counted = cosines = 0
    for number in np.unique(lists):
        rows = np.flatnonzero((lists == number).any(axis=1))
        if len(rows) > 1:
            found = pivot_index.candidates(int(number) % len(own.points), perm[rows], own.head, own.least)
            n, _, done = pivot_index.verify(found, x[rows], np.ones(len(rows), np.int64), cosine)
            links, counted, cosines = links + int(n.sum()), counted + len(rows) * (len(rows) - 1), cosines + done
    return links, counted, cosines


def test_few_pairs_are_counted_and_few_cosines_computed():
    r = np.random.default_rng(7)
    x = pivot_index.unit(np.repeat(r.standard_normal((300, 64)), 4, axis=0) + 0.1 * r.standard_normal((1200, 64)))
    links, counted, cosines = evaluated(x)
    assert links == (x @ x.T >= 0.93).sum() - 1200
    assert counted < 0.1 * 1200 * 1199 and cosines < 0.02 * 1200 * 1199


def test_short_lists_are_looked_at_as_long_ones():
    r = np.random.default_rng(3)
    start, size = np.array([0, 5, 6, 20]), np.array([5, 1, 9, 30])
    i, j = pivot_index.short_pairs(start, size)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(a, b) for s, n in zip(start, size, strict=True) for a in range(s, s + n) for b in range(a + 1, s + n)]
    perm = np.argsort(r.random((50, 16)), axis=1)[:, :10].astype(np.int32)
    second = np.zeros(50, np.int64)
    for s, n in zip(start, size, strict=True):
        second[s : s + n] = r.integers(3, 16)
    ok = pivot_index.short_candidates(i, j, second, perm, 6, 4)
    for s, n in zip(start, size, strict=True):
        want = np.vstack([x for _, x in pivot_index.candidates(int(second[s]), perm[s : s + n], 6, 4)])
        own = (i >= s) & (i < s + n)
        assert np.array_equal(want[i[own] - s, j[own] - s], ok[own]) and np.array_equal(want, want.T)
    m = r.integers(1, 5, 50)
    links, root = pivot_index.short_links(i[ok], j[ok], m)
    graph = np.zeros((50, 50), bool)
    graph[i[ok], j[ok]] = graph[j[ok], i[ok]] = True
    assert np.array_equal(links, graph @ m)
    reach = np.linalg.matrix_power((graph | np.eye(50, dtype=bool)).astype(float), 50) > 0
    assert np.array_equal(root, reach.argmax(axis=1))


def test_vectors_with_a_common_direction():
    r = np.random.default_rng(9)
    half = r.standard_normal((600, 64)) * 0.64 + r.standard_normal(64)
    x = pivot_index.unit(np.vstack([half, half + 0.25 * r.standard_normal(half.shape)]))
    assert (x @ x.mean(axis=0)).mean() > 0.6
    links, _, cosines = evaluated(x)
    want = (x @ x.T >= 0.93).sum() - 1200
    assert 0.99 * want <= links <= want and want >= 1000
    assert cosines < 0.2 * 1200 * 1199


def test_near_duplicates_where_all_stand_in_one_list_are_exact(spark):
    rows = clustered(2, 200)
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, SCHEMA), pivots=2).collect()
    links, root = brute_links(rows, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (links[i], root[i]) for i in links}


@pytest.mark.parametrize("share", [1 / 3, 1 / 2, 1.0])
def test_links_within_one_large_group_are_found(spark, share):
    n, d = 900, 64
    r = np.random.default_rng(4)
    x = r.standard_normal((n, d))
    hot = int(n * share)
    x[:hot] = r.standard_normal(d) + r.standard_normal((hot, d)) * r.uniform(0.24, 0.28, (hot, 1))
    rows = [(i, [float(c) for c in v.astype(np.float32)], 0, "a", "b") for i, v in enumerate(x)]
    got = pivot_index.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = (v @ v.T >= 0.93).sum(axis=1) - 1
    assert all(g.n_links <= want[g.vec_id] for g in got)
    assert sum(g.n_links for g in got) >= 0.995 * want.sum() > 0


def test_repeated_rows_and_empty_tables(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, v, 1), (1, v, 1), (2, v, 1), (2, w, 1), (None, v, 1), (3, v, None)], "vec_id long, embedding array<float>, label int")
    got = pivot_index.near_duplicates(df).collect()
    assert len(got) == 6
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 2), (1, 2), (1, 2), (2, 0), (2, 2), (3, 0)]
    assert pivot_index.near_duplicates(df.limit(0)).count() == 0
    assert rp_forest.nearest(df.limit(0)).count() == 0
    two = {(r.query_id, r.rank): r.vec_id for r in rp_forest.nearest(df, every=1, k=5).collect()}
    assert all(two[q, 1] == {1: 2, 3: 1}[q] for q in (1, 3))
    every = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in rp_forest.nearest(df, every=1, k=5).collect())
    assert every == sorted([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 2, 0.0), (3, 1, 1, 1.0), (3, 2, 2, 1.0), (3, 3, 2, 0.0)] + [(2, 1, 1, 1.0), (2, 2, 3, 1.0), (2, 3, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0), (2, 3, 3, 0.0)])
    mixed = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(10, [1.0]), (20, [2.0])], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.vec_id) for r in rp_forest.nearest(mixed, every=10, k=1).collect()} == {(0, 1), (10, 20), (20, 10)}


def test_nearest_recall_and_order(spark):
    rows = clustered(3, 1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    use = {i: np.array(v, np.float64) for i, v, *_ in rows if ok(v) and len(v) == 16}
    ids = np.array(sorted(use))
    x = np.array([use[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {}
    for r in rp_forest.nearest(df, every=50, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:5]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5]
        assert [(-c, v) for _, v, c in mine] == sorted((-c, v) for _, v, c in mine)
        for _, v, c in mine:
            assert abs(c - s[np.searchsorted(ids, v)]) < 1e-12
        hits += len(set(best) & {v for _, v, _ in mine})
        total += 5
    assert hits >= 0.95 * total


def test_nearest_finds_all_candidates_if_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in rp_forest.nearest(df).orderBy("rank").collect()] == [(1, 1), (2, 2)]
