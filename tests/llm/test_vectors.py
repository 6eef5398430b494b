"""Curve search against comparing all pairs, whitening against a dense eigendecomposition."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import curves, whitening

VECTORS = "vec_id long, embedding array<float>, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], VECTORS)


def exact(rows, k, asks):
    """Every pair compared."""
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            v = tuple(float(np.float32(c)) for c in v)
            ok[i] = min(ok.get(i, v), v)
    lengths = [len(v) for v in ok.values()]
    d = max(lengths, key=lambda n: (lengths.count(n), n), default=0)
    ok = {i: np.array(v) for i, v in ok.items() if len(v) == d}
    out = {}
    for i in ok:
        if asks(i):
            near = sorted((-(ok[i] * v).sum(), j) for j, v in ok.items() if j != i)[:k]
            out |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(near)}
    return out


def answers(df):
    got = df.collect()
    assert len({(r.query_id, r["rank"]) for r in got}) == len(got)
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}


def test_curve_search_small_and_odd(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 3)) for i in range(0, 300)]  # many equal vectors and equal products, some zero
    rows += [(400 + i, [1.0, 1.0, 1.0]) for i in range(120)]  # a hot vector
    rows += [(600, None), (620, []), (640, [1.0, None, 2.0]), (660, [float("nan"), 1.0, 2.0]), (680, [float("inf"), 0.0, 1.0]), (700, [0.0, 0.0, 0.0]), (720, [5.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    rows += [(740, [3.0, 3.0, 3.0]), (740, [-3.0, 2.0, 2.0]), (20, rows[20][1]), (-40, [2.0, -1.0, 0.5])]
    asks = lambda i: i % 20 == 0
    assert answers(curves.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, k=7, target=1.0)) == exact(rows, 7, asks)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [-1.0, 0.0])], [(1, [1.0])], [(0, None)]])
def test_curve_search_few_rows(spark, rows):
    assert answers(curves.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, target=1.0)) == exact(rows, 20, lambda i: i % 20 == 0)


def test_curve_search_recall_and_parts(spark):
    """Without structure, in clusters and with lengths of all sizes; blocks cut into small parts."""
    rng = np.random.default_rng(5)
    for kind in range(3):
        v = rng.normal(size=(2500, 16))
        if kind == 1:
            v = rng.normal(size=(25, 16))[rng.integers(0, 25, 2500)] + 0.1 * v
        if kind == 2:
            v *= rng.lognormal(0, 1, (2500, 1))
        v = v.astype(np.float32)
        rows = list(enumerate(v))
        got = answers(curves.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, block_rows=40, block_queries=16))
        s = v.astype(float)[::20] @ v.astype(float).T
        s[np.arange(125), np.arange(0, 2500, 20)] = -np.inf
        top = np.argsort(-s, axis=1)[:, :20]
        assert len(got) == 125 * 20
        found = sum(got[(20 * i, n + 1)][0] in top[i] for i in range(125) for n in range(20))
        assert found >= 0.9 * 2500
        assert all(abs(score - s[q // 20, j]) < 1e-12 * (1 + abs(score)) for (q, _), (j, score) in got.items())


def test_lists_in_a_fresh_worker():
    """A worker that has run nothing else yet (``pa.array`` would load pandas, and that pyarrow.compute): the module imports
    what it uses."""
    code = "import numpy as np, pyarrow as pa; from factloom.llm import curves; b = lambda *x: pa.py_buffer(np.array(x)); v = pa.Array.from_buffers(pa.int64(), 3, [None, b(1, 2, 3)]); print([x.tolist() for x in curves._lists(pa.LargeListArray.from_buffers(pa.large_list(pa.int64()), 3, [None, b(0, 2, 2, 3)], children=[v]))])"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[[0, 2, 2, 3], [1, 2, 3]]", done.stderr


def test_window_is_a_part_where_vectors_have_neighbourhoods(spark):
    rng = np.random.default_rng(6)
    v = (rng.normal(size=(40, 8))[np.repeat(np.arange(40), 60)] + 0.02 * rng.normal(size=(2400, 8))).astype(np.float32)
    rows, d, longest = curves.usable(frame(spark, list(enumerate(v))))
    c = curves.Curves(d, longest)
    index = curves.placed(curves.classes(rows, 20), c)
    bounds = curves.splitters(index, 2400, 32)
    assert all((np.diff(b) > 0).all() for b in bounds)
    assert curves.needed_reach(index, rows.where("vec_id % 20 = 0"), c, bounds, 20, 0.95, 200) <= 2


def test_hilbert_neighbours_touch():
    """Successive places of the curve are neighbouring cells, each visited once."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = curves.hilbert(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


def dense(vectors, k=8):
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    return x, ((n * x - s) ** 2).sum(1), np.abs(y @ q[:, ::-1][:, :k] / np.sqrt(np.maximum(e[::-1][:k], 1e-300))), e[::-1][:k] / np.trace(v), e[::-1]


def test_whitening_against_dense(spark):
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(400, 50)) * np.linspace(2, 0.5, 50)).astype(np.float32)
    odd = [(1000, None), (1001, []), (1002, [None] * 50), (1003, [float("nan")] * 50), (1004, [float("inf")] + [0.0] * 49), (1005, [1.0, 2.0])]
    rows = whitening.integers(frame(spark, [*enumerate(v), *odd]))
    w = whitening.fit(rows, block=10)
    got = whitening.whitened(rows, w).toPandas().sort_values(["vec_id", "component"])
    _, deviation, white, explained, _ = dense(v)
    assert len(got) == 400 * 8 and list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert np.abs(np.abs(got.whitened.to_numpy().reshape(-1, 8)) - white).max() < 1e-8
    assert (got.deviation.to_numpy().reshape(-1, 8) == deviation[:, None]).all() and (got.n == 400).all()
    assert np.allclose(got.explained.to_numpy().reshape(-1, 8), explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    both = whitening.transformed(rows, w).toPandas().sort_values("vec_id")
    assert np.array_equal(np.stack(both.whitened), got.whitened.to_numpy().reshape(-1, 8))


def test_whitening_close_eigenvalues_take_many_passes(spark):
    """A block far narrower than the space, and a spectrum without a gap: residuals certify what the dense solution says."""
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(1500, 200)) * np.linspace(1.3, 1, 200)).astype(np.float32)
    rows = whitening.integers(frame(spark, enumerate(v)))
    w = whitening.fit(rows, block=16)
    assert w.passes > 3
    x, *_, e = dense(v)
    y = x - x.mean(0)
    assert np.allclose(w.eigenvalues, e[:8], rtol=1e-12)
    assert np.linalg.norm(y.T @ (y @ w.components) / len(x) - w.components * w.eigenvalues, axis=0).max() < 1e-9 * e[0]
    with pytest.raises(RuntimeError):
        whitening.fit(rows, block=16, most_passes=2)


def test_whitening_small_cases(spark):
    out = lambda rows: (lambda r: whitening.whitened(r, whitening.fit(r)).collect())(whitening.integers(frame(spark, rows)))
    assert out([]) == [] and out([(1, None)]) == [] and out([(1, [1.0, 2.0])]) == [] and out([(1, [0.5] * 3), (2, [0.5] * 3)]) == []
    line = out([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [2.0, 2.0]), (2, [1.0, 1.0])])  # one direction alone, a repeated row
    assert {r.component for r in line} == {1} and len(line) == 4
    assert sorted(round(r.whitened**2, 9) for r in line) == [0.0, 0.0, 2.0, 2.0]
    large = whitening.deviations(np.array([[10**12, 1], [0, 5]]), 10**6, np.array([0, 0]))
    assert large.to_pylist() == [None, 25 * 10**12]
    with pytest.raises(Exception, match="beyond"):
        out([(1, [1e30, 0.0]), (2, [0.0, 1.0])])
