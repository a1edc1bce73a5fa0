"""Whitening against integers of any size and numpy."""

import math
import random

import numpy as np
import pytest

from gistworks.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(vectors):
    """x-vectors, and their covariance from Python's integers."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    v = [[sum((n * r[a] - s[a]) * (n * r[b] - s[b]) for r in x) / n**3 for b in range(d)] for a in range(d)]
    return x, s, np.array(v)


def check(out, vectors, ids, components):
    x, s, v = exact(vectors)
    n = len(x)
    values, vecs = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    assert len(out) == n * len(order)
    found = {}
    for r in out:
        found.setdefault(r.vec_id, []).append(r)
    for k, i in enumerate(order, start=1):
        want = np.array([(np.array([n * c for c in row]) - np.array(s)) / n @ vecs[:, i] / math.sqrt(values[i]) for row in x])
        got = {r.vec_id: r for r in out if r.component == k}
        have = np.array([got[j].whitened for j in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6
        assert all(abs(got[j].explained / (values[i] / np.trace(v)) - 1) < 1e-9 for j in ids)
    for j, row in zip(ids, x, strict=True):
        assert {r.deviation for r in found[j]} == {sum((n * c - t) ** 2 for c, t in zip(row, s, strict=True))}
    assert {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-8


@pytest.mark.parametrize("low, high, n, d", [(-3, 4, 1, 1), (0, 1, 70, 3), (-5000, 9000, 300, 7), (10**9, 10**9 + 50, 130, 4), (-(2**40), 2**40, 64, 2)])
def test_cross_products(low, high, n, d):
    block = np.random.default_rng(n).integers(low, high, (n, d))
    sums, products = whitening.cross_products(block)
    rows = [[int(c) for c in r] for r in block]
    assert sums == [sum(r[a] for r in rows) for a in range(d)]
    assert products == [[sum(r[a] * r[b] for r in rows) for b in range(d)] for a in range(d)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(700, 10)) * np.arange(1, 11) + rng.normal(size=(700, 1))).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    check(out, vectors, list(range(700)), 8)


def test_a_mean_far_away_costs_no_digits(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(200, 3)) + 3e8
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()
    check(out, vectors, list(range(200)), 3)


def test_unusable_rows_go_and_repeated_ones_stay(spark):
    rng = random.Random(5)
    good = [(i, [rng.random() for _ in range(4)], 0) for i in range(40)]
    bad = [(100, None, 0), (101, [], 0), (102, [1.0, None, 0.0, 0.0], 0), (103, [float("nan"), 0.0, 0.0, 0.0], 0), (104, [float("-inf"), 0.0, 0.0, 0.0], 0),
           (105, [1e30, 0.0, 0.0, 0.0], 0), (106, [0.5, 0.5], 0)]
    df = spark.createDataFrame(good + bad + [good[0], (None, [0.1, 0.2, 0.3, 0.4], 1)], SCHEMA)
    out = whitening.whiten(df.selectExpr("*", "vec_id AS component", "vec_id AS n", "vec_id AS whitened", "vec_id AS at_", "vec_id AS length")).collect()
    assert {r.vec_id for r in out} == {*range(40), None}
    assert sum(r.vec_id == 0 for r in out) == 8 and {r.n for r in out} == {42}
    assert max(r.identity_error for r in out) < 1e-8


def test_no_variance_and_no_rows(spark):
    same = whitening.whiten(spark.createDataFrame([(i, [0.5, 0.25], 0) for i in range(5)], SCHEMA)).collect()
    assert {(r.whitened, r.explained, r.deviation) for r in same} == {(0.0, 0.0, 0)} and {r.identity_error for r in same} == {1.0}
    for rows in ([], [(1, None, 0)]):
        empty = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_deviations(spark):
    vectors = [[1e12, 0.0], [-1e12, 1e11], [5e11, 2e11]]
    out = whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA.replace("float", "double"))).collect()
    assert {r.deviation for r in out} == {None} and max(r.identity_error for r in out) < 1e-6
