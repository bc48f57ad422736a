"""Whitening against whole-number polynomials, numpy's eigenvectors and direct sums; equal eigenvalues, dependent dimensions, odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest

from reciprospark.llm import whitening as wh


def by_traces(m):
    """det(x - m) by the sums of powers of the roots, in fractions."""
    d = len(m)
    out, power = [Fraction(1)], [[Fraction(int(i == j)) for j in range(d)] for i in range(d)]
    for k in range(1, d + 1):
        power = [[sum(power[i][t] * m[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c = -sum(power[i][i] for i in range(d)) / k
        out.append(c)
        for i in range(d):
            power[i][i] += c
    return [int(c) for c in reversed(out)]


def scatter_of(x):
    n, s = len(x), x.sum(0)
    return [[int(v) for v in row] for row in n * (x.T @ x) - np.outer(s, s)]


def direct(vectors):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    return x, x.sum(0)


def test_polynomial_and_roots_of_small_matrices(spark):
    rng = np.random.default_rng(3)
    for d, n in ((1, 4), (2, 9), (5, 30), (6, 3)):
        m = scatter_of(rng.integers(-40, 40, (n, d)).astype(object))
        poly = wh.characteristic(spark, m)
        assert poly == by_traces(m)
        trace = sum(m[i][i] for i in range(d))
        roots = wh.largest_roots(poly, d, trace)
        want = np.linalg.eigvalsh(np.array(m, float))[::-1]
        assert len(roots) == min(d, n - 1) and np.allclose([r / 2**wh.PRECISION for r in roots], want[: len(roots)], rtol=1e-9)


def test_roots_that_count_several_times():
    poly = [1]
    for root in (7, 7, 7, 7, 3, 3, 1, 0, 0):
        poly = [(poly[k - 1] if k else 0) - root * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [wh.roots_above(poly, a) for a in (-1, 0, 1, 2, 3, 6, 7)] == [9, 7, 6, 6, 4, 4, 0]
    assert [r / 2**wh.PRECISION for r in wh.largest_roots(poly, 8, 28)] == pytest.approx([7, 7, 7, 7, 3, 3, 1])


def test_components_of_equal_and_near_roots():
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(6, 6)))
    m = [[9, 0, 0, 0], [0, 9, 0, 0], [0, 0, 5, 1], [0, 0, 1, 5]]
    found = wh.components(m, [9 << wh.PRECISION, 9 << wh.PRECISION, 6 << wh.PRECISION, 4 << wh.PRECISION])
    assert np.abs(found @ found.T - np.eye(4)).max() < 1e-15
    assert np.abs(found[:2, 2:]).max() < 1e-15 and abs(abs(found[2, 2]) - math.sqrt(0.5)) < 1e-15
    near = [[10**12, 1, 0], [1, 10**12 + 1, 0], [0, 0, 5]]
    roots = [10**12 * 2**wh.PRECISION + round((1 + s * math.sqrt(5)) / 2 * 2**52) * 2 ** (wh.PRECISION - 52) for s in (1, -1)]
    exact = wh.components(near, roots)
    ratio = (1 + math.sqrt(5)) / 2
    assert abs(abs(exact[0, 1] / exact[0, 0]) - ratio) < 1e-14 and abs(exact[0] @ exact[1]) < 1e-15


def test_query_against_numpy(spark):
    from reciprospark.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    found = queries.op13_embedding_whitening(spark, "/root/testdata/sf0.01").toPandas()
    x, s = direct([r.embedding for r in table])
    n = len(x)
    assert len(found) == 8 * n and set(found.n) == {n}
    deviation = {r.vec_id: int(v) for r, v in zip(table, ((n * x - s) ** 2).sum(1))}
    assert all(deviation[i] == v for i, v in zip(found.vec_id, found.deviation))
    y = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    z = found.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in table]].to_numpy()
    for k in range(8):
        own = y @ v[:, k] / math.sqrt(e[k])
        assert min(np.abs(z[:, k] - own).max(), np.abs(z[:, k] + own).max()) < 1e-9
        assert np.allclose(found[found.component == k + 1].explained, e[k] / e.sum(), rtol=1e-12)
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-12


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, -0.25, 0.125], [0.5, -0.25, 0.125], [1.0, 2.0, 3.0], [-1.0, 0.5, 2.5], None, [1.0, None, 2.0], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [1.0, 2.0], []]
    table = spark.createDataFrame([(None if i == 3 else i % 3, v, "x") for i, v in enumerate(vectors)], "component int, vec array<double>, n string")
    found = wh.whitened(table, "component", "vec").toPandas()
    assert list(found.columns) == ["component", "component_", "n", "deviation", "whitened", "explained", "identity_error"]
    x, s = direct(vectors[:4])
    assert len(found) == 4 * 2 and set(found.n) == {4} and sorted(set(found.deviation)) == sorted({int(v) for v in ((4 * x - s) ** 2).sum(1)})
    assert found.identity_error[0] < 1e-12 and found.component.isna().sum() == 2
    for own in (table.filter("false"), table.filter("component = 0 AND vec IS NULL"), table.limit(1), table.filter("size(vec) = 0")):
        assert wh.whitened(own, "component", "vec").count() == 0


def test_large_entries_stay_exact(spark):
    vectors = [[3e11, 1e-3], [-2e11, 5.0], [1e11, -7.0]]
    n, sums, m = wh.scatter(spark.createDataFrame([(v,) for v in vectors], "v array<double>"), "v", 2)
    x = np.array([[math.floor(1024 * c) for c in v] for v in vectors], object)
    assert n == 3 and sums == list(x.sum(0)) and m == scatter_of(x)
    with pytest.raises(Exception, match="too large for a long"):
        wh.whitened(spark.createDataFrame([(0, [1e30]), (1, [0.0])], "vec_id int, embedding array<double>")).count()
