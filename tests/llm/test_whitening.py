from __future__ import annotations

import math

import numpy as np
import pytest
from cases import SF_DIR, table
from querytide.llm import queries, whitening
from querytide.llm.whitening import Spectrum, WhiteningParams, secular_roots

SCHEMA = "vec_id long, embedding array<float>, x string, v int, n string, slot int, length string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1, "n", 2, "l") for i, e in rows], SCHEMA)


def expected(rows, components=16):
    """By the plain eigendecomposition of the whole covariance, in exact sums."""
    kept = [(i, e) for i, e in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e] for _, e in kept], object)
    distinct = sorted({tuple(r) for r in x})
    n, d = len(distinct), x.shape[1]
    total = [sum(r[k] for r in distinct) for k in range(d)]
    centred = np.array([[float(n * r[k] - total[k]) / n for k in range(d)] for r in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = values.sum()
    for (vec_id, _), row in zip(kept, x):
        gaps = [n * row[k] - total[k] for k in range(d)]
        projected = (np.array(gaps, float) / n) @ vectors
        for k in range(min(components, d)):
            if values[k] > values[0] * 1e-13:
                yield vec_id, k + 1, n, sum(g * g for g in gaps), projected[k] / math.sqrt(values[k]), values[k] / trace


def compare(found, wanted, tolerance=1e-9):
    found = sorted(map(tuple, found), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))
    wanted = sorted(wanted, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    signs = {}
    for a, b in zip(found, wanted):
        assert math.isclose(a[5], b[5], rel_tol=1e-9)
        if abs(b[4]) > 1e-6:
            sign = signs.setdefault(a[1], math.copysign(1, a[4] * b[4]))
            assert math.isclose(a[4] * sign, b[4], rel_tol=tolerance * 1e3, abs_tol=tolerance * 1e2)


def test_query_equals_the_plain_decomposition(spark):
    found = queries.op12_embedding_whitening(spark, SF_DIR).collect()
    compare([r[:6] for r in found], list(expected(table("embeddings", "vec_id, embedding"))))
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-10


def test_odd_rows(spark):
    draw = np.random.default_rng(5)
    good = [(k, [float(v) for v in draw.normal(size=3) * (5, 1, 0.2)]) for k in range(60)]
    rows = [*good, *good[:7], *[good[0]] * 30, (None, [1.0, 2.0, 3.0]), (None, None), (900, None), (901, []),
            (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 2.0]), (904, [float("inf"), 1.0, 2.0]),
            (905, [1.0, 2.0]), (906, [3e38, 0.0, 0.0])]
    usable = [r for r in rows if r[0] not in (905, 906)]
    found = whitening.whiten(frame(spark, rows)).collect()
    compare([r[:6] for r in found], list(expected(usable)))


def test_far_from_zero(spark):
    """A mean that is huge beside the spread: entries are centred before they are multiplied."""
    draw = np.random.default_rng(6)
    rows = [(k, [2.0**18 + float(v) for v in draw.integers(-3, 4, size=4)]) for k in range(300)]
    compare([r[:6] for r in whitening.whiten(frame(spark, rows)).collect()], list(expected(rows)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_no_variance_no_rows(spark, rows):
    assert whitening.whiten(frame(spark, rows)).count() == 0


def test_flat_directions_have_no_row(spark):
    rows = [(k, [float(k), 7.0, float(-2 * k)]) for k in range(9)]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert {r["component"] for r in found} == {1} and found[0]["explained"] == pytest.approx(1)


def test_many_partitions_combine(spark):
    draw = np.random.default_rng(7)
    rows = [(k, [float(v) for v in draw.normal(size=6) * np.arange(1, 7)]) for k in range(500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = whitening.whiten(frame(spark, rows), WhiteningParams(fan=2, condensed=8)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    compare([r[:6] for r in found], list(expected(rows)))


@pytest.mark.parametrize(("dimension", "number"), [(1, 4), (5, 3), (8, 40), (40, 400)])
def test_rank_one_updates_keep_the_spectrum(dimension, number):
    draw = np.random.default_rng(dimension)
    rows = draw.normal(size=(number, dimension)) * np.exp(draw.normal(size=dimension) * 3)
    rows[:, dimension // 2] = 0
    rows[number // 2 :] = np.where(draw.random((len(rows[number // 2 :]), 1)) < 0.3, rows[0], rows[number // 2 :])
    spectrum = Spectrum(dimension)
    for row in rows:
        spectrum.update(row)
    whole = rows.T @ rows
    largest = np.linalg.eigvalsh(whole)[-1]
    assert np.abs(spectrum.values - np.linalg.eigvalsh(whole)).max() <= 1e-13 * largest
    assert np.abs(spectrum.vectors.T @ spectrum.vectors - np.eye(dimension)).max() < 1e-12
    assert np.abs(spectrum.vectors * spectrum.values @ spectrum.vectors.T - whole).max() <= 1e-13 * largest


def test_secular_roots_lie_between_the_poles():
    draw = np.random.default_rng(8)
    for _ in range(50):
        poles = np.sort(draw.normal(size=9)) * 10 ** draw.uniform(-3, 3)
        weights = draw.random(9) ** 8 + 1e-12
        nearest, distance = secular_roots(poles, weights)
        roots = poles[nearest] + distance
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights))), rtol=1e-9, atol=1e-9)
        assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
