import numpy as np
import pyarrow as pa
import pytest

from staywise.llm import whitening
from staywise.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "c", 0) for i, v in rows], SCHEMA)


def brute(rows, components=16):
    kept = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        w = (np.array(x) - sums / n) @ vectors[:, order] / np.sqrt(values[order])
        out.setdefault(i, []).append((n, deviation, w))
    return out, values[order] / values.sum(), n


def compare(found, rows, components):
    want, explained, n = brute(rows, components)
    got = {}
    for r in found:
        got.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    assert set(got) == set(want)
    for i, expected in want.items():
        assert sorted(got[i]) == list(range(1, len(explained) + 1))
        for k, made in got[i].items():
            assert sorted(r["deviation"] for r in made) == sorted(d for _, d, _ in expected)
            assert {r["n"] for r in made} == {n}
            assert np.allclose(sorted(abs(r["whitened"]) for r in made), sorted(abs(w[k - 1]) for _, _, w in expected), rtol=1e-7, atol=1e-7)
            assert abs(made[0]["explained"] / explained[k - 1] - 1) < 1e-9
            assert 0 <= made[0]["identity_error"] < 1e-9


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    mix = r.normal(size=(8, 8)) * np.array([3, 2, 1, 0.5, 0.4, 0.3, 0.2, 0.1])
    found = [(k, [float(c) for c in mix @ r.normal(size=8)]) for k in range(400)]
    return found + found[:40] + [(900 + k, found[k][1]) for k in range(30)] + [(None, found[3][1])]


def test_against_eigh(spark, rows):
    compare(whitening.whitened_components(table(spark, rows)).collect(), rows, 8)
    compare(whitening.whitened_components(table(spark, rows), 3).collect(), rows, 3)


def test_odd_rows_are_left_out(spark, rows):
    odd = [(1, None), (2, [None] * 8), (3, [float("nan")] * 8), (4, [float("inf")] + [0.0] * 7), (5, [1.0] * 7), (6, []), (7, [3e38] * 8)]
    compare(whitening.whitened_components(table(spark, rows + odd)).collect(), rows, 8)


def test_query_on_whole_table(spark, small):
    found = op12_embedding_whitening(spark, small)
    source = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    compare(found.collect(), [(r["vec_id"], r["embedding"]) for r in source], 16)


def test_fewer_directions_than_components(spark):
    rows = [(k, [k / 64, 2 * k / 64, 0.5, -k / 64]) for k in range(20)]
    found = whitening.whitened_components(table(spark, rows)).collect()
    assert len(found) == 20 and {r["component"] for r in found} == {1}
    assert abs(found[0]["explained"] - 1) < 1e-12 and found[0]["identity_error"] < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whitening.whitened_components(table(spark, rows)).count() == 0


def test_exact_deviations_beyond_a_product_of_longs():
    sums = np.array([3 << 61, 5], dtype=object)
    x = np.array([[3 << 51, 0]], dtype=np.int64)
    assert whitening._deviations(x, 1 << 10, sums) == [25]
    with pytest.raises(OverflowError):
        pa.array(whitening._deviations(np.array([[1 << 40]]), 1 << 20, np.array([0], dtype=object)), pa.int64())


def test_factor_and_rotation():
    r = np.random.default_rng(2)
    y = r.normal(size=(50, 12)) @ np.diag(10.0 ** (-np.arange(12) / 2))
    a = y.T @ y
    factor, order = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a[np.ix_(order, order)], rtol=1e-12, atol=1e-14 * a.max())
    assert np.allclose(np.triu(factor, 1), 0) and all(np.diff(np.diag(factor)) <= 1e-12)
    vectors, squares = whitening.one_sided_jacobi(factor)
    # Squared singular values of y itself, which keep the small ones' precision.
    assert np.allclose(squares, np.linalg.svd(y, compute_uv=False) ** 2, rtol=1e-6)
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-12)
