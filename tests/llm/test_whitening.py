"""Whitening against numpy on whole tables, and its awkward rows."""

import math

import numpy as np
import pytest
from crossgrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, z string"


def rows(seed, n, d):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.2 + r.normal(size=d)
    return [(k, [float(np.float32(v)) for v in row], k % 3, -1, "x") for k, row in enumerate(x)]


def brute(data, components=8):
    """The contract in plain Python integers and one eigendecomposition."""
    good = [(k, v) for k, v, *_ in data if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    s = [sum(col) for col in zip(*x)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    y = np.array(x) - np.array(s) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    return [k for k, _ in good], n, dev, y @ u / np.sqrt(np.abs(e)), e / np.trace(v)


def compare(spark, data, tile):
    got = whitening.whitening_report(spark.createDataFrame(data, SCHEMA).repartition(5), tile=tile).collect()
    ids, n, dev, z, share = brute(data)
    k = min(8, z.shape[1])
    assert len(got) == len(ids) * k
    by = {}
    for g in got:
        by.setdefault(g.vec_id, {})[g.component] = g
        assert g.n == n and g.identity_error < 1e-9 and abs(g.explained / share[g.component - 1] - 1) < 1e-9
    signs = None
    for i, doc in enumerate(ids):
        assert by[doc][1].deviation == dev[i]
        mine = np.array([by[doc][c + 1].whitened for c in range(k)])
        if signs is None:
            signs = np.sign(mine * z[i, :k])
        assert np.allclose(mine, signs * z[i, :k], atol=1e-8)


@pytest.mark.parametrize("tile", [5, 32])
def test_equals_numpy(spark, tile):
    bad = [(900, None, 1, 1, None), (901, [1.0] * 11 + [None], 1, 1, None), (902, [1.0] * 11 + [float("nan")], 1, 1, None), (903, [float("inf")] + [0.0] * 11, 1, 1, None), (904, [], 1, 1, None)]
    data = rows(1, 300, 12)
    compare(spark, bad[:2] + data + bad[2:], tile)


def test_few_dimensions_and_repeats(spark):
    data = rows(2, 40, 3)
    again = [(100 + k, *r[1:]) for k, r in enumerate(data[:20])] + [(200 + k, *data[0][1:]) for k in range(60)]
    compare(spark, data + again, 2)


def test_blocks_of_rows_and_tiles_agree(spark):
    data = rows(3, 500, 7)
    df = spark.createDataFrame(data, SCHEMA).select("embedding")
    x = np.array([[math.floor(1024 * c) + 100000 for c in r[1]] for r in data])
    want = np.cov(x.T, bias=True)
    for tile, size in ((1, 7), (3, 64), (7, 4096)):
        assert np.allclose(whitening.covariance(df, 500, x.sum(0).tolist(), tile, size), want, rtol=1e-12, atol=1e-9)


def test_awkward_tables(spark):
    report = lambda data: whitening.whitening_report(spark.createDataFrame(data, SCHEMA)).collect()
    assert report([]) == [] and report([(1, None, 1, 1, "x"), (2, [float("nan")], 1, 1, "x")]) == []
    one = report([(None, [0.25, 0.5], 1, 1, "x")])
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, 1, 1, 0, None, None, None), (None, 2, 1, 0, None, None, None)]
    line = report([(k, [float(k), 1.0], 1, 1, "x") for k in range(4)])
    assert {r.component: (r.whitened is None, r.explained) for r in line} == {1: (False, 1.0), 2: (True, 0.0)}
    assert all(abs(r.identity_error) < 1e-12 for r in line)
    mixed = report([(1, [1.0, 2.0], 1, 1, "x"), (2, [2.0, 1.5], 1, 1, "x"), (3, [1.0], 1, 1, "x")])
    assert {r.vec_id for r in mixed} == {1, 2}
    huge = report([(1, [3e38, 0.0], 1, 1, "x"), (2, [0.0, 1.0], 1, 1, "x"), (3, [-3e38, 0.5], 1, 1, "x")])
    assert len(huge) == 6 and huge[0].deviation is None


def test_whiten_keeps_columns(spark):
    data = rows(4, 60, 4) + [(900, None, 1, 1, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    model = whitening.fit(df.select("embedding"))
    got = whitening.whiten(df, model, out_col="z").orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(60)) and got[0].n == -1 and len(got[0].z) == 4
    z = np.array([r.z for r in got])
    assert np.allclose(np.cov(z.T, bias=True), np.eye(4), atol=1e-9)
