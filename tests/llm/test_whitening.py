"""Whitening against plain arithmetic and a full eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgaudit.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def brute(rows, components=4):
    """deviation, whitened (up to sign), explained by row, for rows of (id, list)."""
    xs = []
    for i, v in rows:
        if v is not None and v and all(c is not None and math.isfinite(c) for c in v):
            xs.append((i, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[Fraction(x[j]) - Fraction(sums[j], n) for j in range(d)] for x in fit]
    v = np.array([[float(sum(c[i] * c[j] for c in centred) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    out = {}
    for i, x in xs:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        mean = np.array([a - s / n for a, s in zip(x, sums)])
        for c in range(min(components, d)):
            e = values[-1 - c]
            out.setdefault((i, c + 1), []).append((n, dev, abs(mean @ vectors[:, -1 - c]) / math.sqrt(e), e / values.sum()))
    return out


def _check(spark, rows):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA).repartition(5)
    got, want = {}, brute(rows)
    for r in W.whiten(df).collect():
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
        assert r.identity_error < 1e-9
    assert set(got) == set(want)
    for k in want:
        for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-8, abs=1e-9) and a[3] == pytest.approx(b[3], rel=1e-9)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(120, 7)) @ np.diag([3, 2, 1.5, 1, .5, .2, .1])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(3, rows[5][1]), (None, rows[6][1]), (None, rows[6][1])]
    rows += [(2000, None), (2001, []), (2002, [None] * 7), (2003, [float("nan")] * 7), (2004, [math.inf] * 7),
             (2005, [1e38] + [0.0] * 6)][:5]
    _check(spark, rows)


def test_entries_left_out(spark):
    rows = [(i, [float(i % 5), float(i % 3)]) for i in range(30)] + [(90, [1e38, 0.0]), (91, [1.0, 2.0, 3.0]), (92, [5.0])]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    ids = {r.vec_id for r in W.whiten(df).collect()}
    assert ids == set(range(30))


def test_query_on_given_table(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute([(r.vec_id, list(r.embedding)) for r in given])
    from pkgaudit.llm.registry import QUERIES
    got = QUERIES["op11_whitening"](spark, sf_dir).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        n, dev, white, explained = want[(r.vec_id, r.component)][0]
        assert (r.n, r.deviation) == (n, dev) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(white, rel=1e-6, abs=1e-7) and r.explained == pytest.approx(explained, rel=1e-9)


def test_all_equal_and_empty(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0], "a", "b") for i in range(9)], SCHEMA)
    assert W.whiten(same).count() == 0
    assert W.whiten(same.filter("false")).count() == 0
    assert W.whiten(same.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0


def test_flat_directions_give_no_component(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], "a", "b") for i in range(20)], SCHEMA)
    rows = W.whiten(df).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 20 and rows[0].explained == pytest.approx(1)


def test_huge_deviation_is_null(spark):
    df = spark.createDataFrame([(i, [float(2**40 * i), 1.0 * (i % 2)], "a", "b") for i in range(10)], SCHEMA)
    rows = W.whiten(df).collect()
    assert rows and all(r.deviation is None for r in rows)


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [3, 3, 3, 1], [2, 2, 2, 2], [1, 1 - 1e-9, 1 - 2e-9, .5], [1, 1e-8, 0, 0],
                                    [7], [1, -1, 2, -2], list(range(40))])
def test_slices(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    for shift in np.array(sorted(values))[:-1] + np.diff(sorted(values)) / 2:
        if min(abs(shift - v) for v in values) > 1e-12:
            assert W.count_above(a, shift) == sum(v > shift for v in values)
    pairs = W.leading_eigenpairs(a, 4)
    assert np.allclose([e for e, _ in pairs], sorted(values, reverse=True)[:4], atol=1e-13 * max(map(abs, values)))
    vs = np.array([v for _, v in pairs])
    assert np.allclose(vs @ vs.T, np.eye(len(pairs)), atol=1e-6)
    for e, v in pairs:
        assert np.linalg.norm(a @ v - e * v) < 1e-13 * max(map(abs, values)) * d


def test_zero_pivots():
    a = np.array([[0.0, 1.0], [1.0, 0.0]])
    assert W.count_above(a, 0.0) == 1
    assert W.count_above(np.zeros((3, 3)), 0.0) == 0
