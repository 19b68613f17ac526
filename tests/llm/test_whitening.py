import math
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<double>, id string, x string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *"abcd") for i, v in rows], SCHEMA)


def brute(rows, length):
    xs = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
          if v and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(x) for x in {tuple(x) for _, x in xs}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in xs}
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    values, axes = np.linalg.eigh(y.T @ y / n)
    return xs, n, sums, exact, values[::-1], axes[:, ::-1], float((y * y).sum() / n)


def check(got, rows, length):
    xs, n, sums, exact, values, axes, trace = brute(rows, length)
    k = min(16, int((values > values[0] * 1e-9).sum()))
    assert len(got) == len(xs) * k
    by = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["deviation"] == exact[r["id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        by.setdefault(r["component"], {}).setdefault(r["id"], []).append(r["whitened"])
    assert sorted(by) == list(range(1, k + 1))
    for c, seen in by.items():
        want = {i: float(np.dot([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)], axes[:, c - 1])) / math.sqrt(values[c - 1]) for i, x in xs}
        ids = list(want)
        a, b = np.array([seen[i][0] for i in ids]), np.array([want[i] for i in ids])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7


ODD = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 2.0]), (5, [1.0, float("inf"), 2.0]), (6, [0.0, 0.0, 0.0]), (7, [1.0, 2.0]),
       (8, [1.5, -2.25, 3.0]), (9, [1.5, -2.25, 3.001]), (10, [1.5, -2.2501, 3.0]), (11, [0.015625, 0.0156249, -0.001]), (12, [4.0, 5.0, 6.0]),
       (13, [-3.0, 9.0, 0.5]), (14, [7.0, -1.0, -8.0])]


def test_odd_rows(spark):
    check(whitening.whiten(frame(spark, ODD)).collect(), ODD, 3)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    df = whitening.whiten(frame(spark, rows))
    assert df.collect() == [] and df.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_copies_weigh_once_and_null_ids_stay(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 20)) * np.linspace(3, 0.1, 20))]
    copies = rows + [(i, rows[0][1]) for i in range(1000, 1300)]
    got = whitening.whiten(frame(spark, [*copies, (None, rows[1][1])]).repartition(6)).collect()
    assert sum(r["id"] is None for r in got) == 16
    check([r for r in got if r["id"] is not None], copies, 20)


def test_components_of_very_unlike_size(spark):
    """Eigenvalues many orders apart keep their relative accuracy."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 6)) * [500, 30, 4, 2, 1, 0.5]
    turn = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    rows = [(i, v.tolist()) for i, v in enumerate(base @ turn.T)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows, 6)


def test_fewer_rows_than_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(5, 12)))]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in got} == {1, 2, 3, 4}
    check(got, rows, 12)


def test_entries_of_any_size(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e12, 3.0]), (4, [0.0, 9.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["id"] for r in got} == {1, 2, 3, 4} and all(math.isfinite(r["whitened"]) for r in got)
    assert {r["id"]: r["deviation"] for r in got}[1] is None


def test_cholesky_and_jacobi_give_the_spectrum():
    rng = np.random.default_rng(4)
    for d, r in ((1, 1), (2, 2), (7, 3), (16, 16), (33, 33)):
        b = rng.normal(size=(d, r))
        a = b @ b.T
        factor = whitening.pivoted_cholesky(a)
        assert factor.shape == (d, r) and np.allclose(factor @ factor.T, a)
        axes, values = whitening.jacobi(factor)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:r]) and np.allclose(axes.T @ axes, np.eye(r), atol=1e-12)
        assert np.allclose(axes * values @ axes.T, a)


def test_query_is_whole(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = [dict(r.asDict(), id=r["vec_id"]) for r in queries.op11_whitening(spark, "/root/testdata/sf0.001").collect()]
    check(got, rows, 64)
