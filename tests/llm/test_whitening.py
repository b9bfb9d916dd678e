import math
from fractions import Fraction

import numpy as np
import pytest

from murmurate.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string, deviation int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "a", 2) for i, v in vectors], SCHEMA)


def random_vectors(n=300, d=12):
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.3
    return [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(mixed)]


def scaled(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]


def exact_covariance(x):
    n, d = len(x), len(x[0])
    mean = [Fraction(sum(row[i] for row in x), n) for i in range(d)]
    return [[sum((row[i] - mean[i]) * (row[j] - mean[j]) for row in x) / n for j in range(d)] for i in range(d)]


def test_against_fractions(spark):
    rows = random_vectors()
    bad = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, []), (905, [1.0])]
    got = whitening.whiten(table(spark, rows + bad + [(7, rows[7][1]), (None, rows[8][1])])).collect()
    kept = [v for _, v in rows] + [rows[7][1], rows[8][1]]
    x = scaled(kept)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    v = np.array([[float(c) for c in row] for row in exact_covariance(x)])
    value, vector = np.linalg.eigh(v)
    assert len(got) == n * 8 and {r["component"] for r in got} == set(range(1, 9)) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert len(by[7, 1]) == 2 and len(by[None, 1]) == 1
    for k in range(1, 9):
        e, u = value[-k], vector[:, -k]
        want = np.array([float(Fraction(c) - Fraction(s, n)) for row in x for c, s in zip(row, sums, strict=True)]).reshape(n, -1) @ u / math.sqrt(e)
        mine = np.array([by[i, k][0]["whitened"] for i in range(300)])
        assert min(np.abs(mine - want[:300]).max(), np.abs(mine + want[:300]).max()) < 1e-9
        assert by[0, k][0]["explained"] == pytest.approx(e / np.trace(v), rel=1e-9)
    for i in range(300):
        assert by[i, 1][0]["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x[i], sums, strict=True))
    assert got[0]["identity_error"] < 1e-9


def test_exact_scatter(spark):
    """Entries near the limit of what fits, and negative ones."""
    rows = [(k, [float(np.float32(s * (k + 1) * 1e14)), -3e9, float(k)]) for k in range(5) for s in (1, -1)]
    x = whitening.integers(table(spark, rows))
    ints = [r["x"] for r in x.collect()]
    n, sums, scatter = whitening.exact_scatter(x, 3, len(ints), max(abs(c) for r in ints for c in r))
    assert n == 10 and list(sums) == [sum(c) for c in zip(*ints, strict=True)]
    assert all(scatter[i, j] == sum(r[i] * r[j] for r in ints) for i in range(3) for j in range(3))
    got = whitening.whiten(table(spark, rows)).collect()
    wide = {r["vec_id"]: [] for r in got}
    for r in got:
        wide[r["vec_id"]].append(r["deviation"])
    assert all(d is None for each in wide.values() for d in each)  # beyond a long
    assert got[0]["identity_error"] < 1e-4


def test_edges(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    flat = whitening.whiten(table(spark, [(k, [float(k), float(-k)]) for k in range(9)]))
    assert {r["component"] for r in flat.collect()} == {1}
    assert flat.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = whitening.primes(1 << 60)
    assert math.prod(found) > 1 << 60 and all(p < 1 << 20 for p in found) and len(set(found)) == len(found)


def test_hot_vector(spark):
    """A third of all rows is one vector far from the rest."""
    rows = random_vectors(200, 9) + [(1000 + k, [30.0] * 9) for k in range(100)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 300 * 8 and got[0]["identity_error"] < 1e-6
