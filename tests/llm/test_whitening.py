import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, most=16):
    """Eigenvalues, axes, and (id, x, deviation) of the rows that take part, by plain numpy and whole numbers."""
    took = [(i, [int(np.floor(np.float64(np.float32(c)) * 64)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in took})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return n, np.array(sums), values[::-1][:most], axes[:, ::-1][:, :most], np.trace(cov), [(i, x, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in took]


def test_against_numpy(spark):
    r = np.random.default_rng(5)
    mixed = r.standard_normal((400, 20)) @ r.standard_normal((20, 20)) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    rows += [(500 + i, rows[0][1]) for i in range(150)] + [(3, rows[7][1]), (None, rows[8][1])]
    bad = [(900, None), (901, [1.0] * 19 + [None]), (902, [float("nan")] * 20), (903, [float("inf")] + [0.0] * 19)]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], SCHEMA).repartition(5).withColumns({"x": F.lit("clash"), "w": F.lit(1), "n": F.lit(2)})
    n, sums, values, axes, trace, took = brute(rows + bad)
    got = whitening.whitened(docs).collect()
    assert len(got) == 16 * len(rows) and {x.n for x in got} == {n}
    by = sorted(((x.vec_id is None, x.vec_id or 0, x.deviation, x.component), x) for x in got)
    want = sorted((i is None, i or 0, dev, x) for i, x, dev in took)
    sign = None
    for m, (none, i, dev, x) in enumerate(want):
        own = [y for _, y in by[16 * m : 16 * m + 16]]
        assert {y.deviation for y in own} == {dev} and {int(y.deviation_exact) for y in own} == {dev}
        plain = (np.array(x) - sums / n) @ axes / np.sqrt(values)
        mine = np.array([y.whitened for y in own])
        sign = np.sign(plain * mine) if sign is None else sign
        assert np.allclose(plain * sign, mine, atol=1e-8)
        assert np.allclose([y.explained for y in own], values / trace, rtol=1e-10)
    assert got[0].identity_error < 1e-9


def test_lengths_and_flat_directions(spark):
    flat = [(i, [float(i % 7), float(i % 5), 2.0, float(i % 7)]) for i in range(35)]
    other = [(100 + i, [float(i)]) for i in range(3)]
    still = [(200 + i, [1.0, 1.0]) for i in range(4)]
    got = whitening.whitened(spark.createDataFrame([(i, v, 0) for i, v in flat + other + still + [(300, [])]], SCHEMA)).collect()
    assert {x.component for x in got if x.vec_id < 100} == {1, 2}
    assert {(x.vec_id, x.component, x.n) for x in got if x.vec_id >= 100} == {(100 + i, 1, 3) for i in range(3)}
    assert all(x.identity_error < 1e-9 for x in got)
    assert all(abs(x.explained - 1) < 1e-12 for x in got if x.vec_id >= 100)


def test_exact_squares():
    y = np.array([[2**40, -(2**40)], [3, 4]])
    assert whitening.squared_deviation(y) == [2**81, 25]
    assert whitening.squared_deviation(y[1:]) == [25]


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1)]])
def test_nothing_to_fit(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect() == []
