import numpy as np
import pytest

from strandframe.llm.whitening import deviations, jacobi, pack, unpack, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string"


def brute(rows, k=4):
    kept = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in kept)
    x = np.array([np.floor(256 * np.pad(np.float32(v).astype(np.float64), (0, d - len(v)))) for _, v in kept]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = (x - s / n) @ vectors[:, :k] / np.sqrt(values[:k])
    return [i for i, _ in kept], n, ((n * x - s) ** 2).sum(axis=1), z, values / values.sum()


def check(df, rows, k=4):
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    ids, n, dev, z, share = brute(rows, k)
    assert df.count() == k * len(ids)
    signs = {}
    for i, e, v in zip(ids, dev.tolist(), z, strict=True):
        own = got[i, e]
        assert sorted(own) == list(range(1, k + 1))
        for c, found in own.items():
            r = found[0]
            assert r.n == n and r.identity_error < 1e-9 and abs(r.explained - share[c - 1]) < 1e-9
            if abs(v[c - 1]) > 1e-6:
                sign = signs.setdefault(c, np.sign(r.whitened / v[c - 1]))
                assert abs(r.whitened - sign * v[c - 1]) < 1e-8


def test_matches_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.array([3, 2, 1.5, 1.2, *[0.3] * 8])
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 12), (403, [float("inf"), 1.0]), (404, []), (405, [0.5, -0.25]), (406, [0.5, -0.25, 0.0]), (None, rows[3][1]), (3, rows[3][1])]
    rows += [(500 + i, rows[7][1]) for i in range(150)]
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA).repartition(5)
    out = whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out, rows)


def test_few_and_flat_vectors(spark):
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "a", "b"), (2, [1.0, 2.0], 1, "a", "b")], SCHEMA)).collect()
    assert len(one) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 1, "a", "b") for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in line} == {1, 2, 3} and {r.component for r in line if r.whitened is not None} == {1}
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 and r.identity_error < 1e-12 for r in line)
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 1, "a", "b"), (2, [], 1, "a", "b")], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 16, 33])
def test_small_eigenvalues_are_exact(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    scale = np.sqrt(10.0 ** -np.arange(n).clip(0, 12))
    half = rng.normal(size=(n, n))
    m = (half.T @ half + n * np.eye(n)) * scale * scale[:, None]  # well conditioned but for its scale
    values, vectors = jacobi(m)
    assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
    want = sorted(1 / np.linalg.eigvalsh(np.diag(1 / scale) @ np.linalg.inv(half.T @ half + n * np.eye(n)) @ np.diag(1 / scale)), reverse=True)
    assert abs(values[-1] / want[-1] - 1) < 1e-9 and np.all(np.diff(values) <= 0)
    tied, _ = jacobi(q @ np.eye(n) @ q.T)
    assert np.allclose(tied, 1)


def test_bytes_of_vectors_are_one_to_one():
    x = np.array([[1, -2, 0], [300, 0, 0], [0, 0, 0], [1 << 40, 5, -1], [-129, 127, 0]])
    rows = pack(x)
    assert (unpack(rows, 3) == x).all() and [len(r) for r in rows] == [3, 3, 1, 25, 5]
    assert pack(x[:1])[0] == rows[0]


def test_deviations_are_exact_or_null():
    x = np.array([[1 << 30, 3], [0, 0]])
    assert deviations(x, 2, [1 << 30, 3]) == [(1 << 60) + 9, (1 << 60) + 9]
    assert deviations(np.array([[1 << 60]]), 7, [5]) == [None]
