"""Resampling and decompositions against numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from orbweave.operators import polarimetry, shapes, signal


def sampled(spark, function, n=12):
    samples = spark.createDataFrame([(1, float(t), float(function(t))) for t in range(n)], "key long, t double, value double")
    wanted = [(1, i, 2.5 + 0.37 * i) for i in range(18)] + [(1, 90, -1.0), (1, 91, 50.0), (1, 92, float(n - 1))]
    return samples, spark.createDataFrame(wanted, "key long, id long, x double"), {i: x for _, i, x in wanted}


def test_cubic_taps_reproduce_cubics(spark):
    f = lambda t: 0.5 - t + 0.3 * t**2 - 0.02 * t**3
    samples, wanted, at = sampled(spark, f)
    got = {r["id"]: r["value"] for r in signal.resample(samples, wanted, 2, signal.lagrange_weight(2)).collect()}
    assert len(got) == len(at)
    for i in range(18):
        if at[i] <= 9:
            assert math.isclose(got[i], f(at[i]), rel_tol=1e-9, abs_tol=1e-9)
    assert got[90] == got[91] == 0.0


def test_linear_taps_equal_interpolation(spark):
    samples, wanted, at = sampled(spark, lambda t: math.sin(t))
    got = {r["id"]: r["value"] for r in signal.resample(samples, wanted, 1, signal.linear_weight).collect()}
    values = [math.sin(t) for t in range(12)]
    for i in range(18):
        assert math.isclose(got[i], np.interp(at[i], range(12), values), rel_tol=1e-9)
    assert math.isclose(got[92], values[-1])


def test_three_component_powers_add_up(spark):
    names = "k long, c11 double, c12_re double, c12_im double, c13_re double, c13_im double, c22 double, c23_re double, c23_im double, c33 double"
    rows = [(1, 4.0, 0.0, 0.0, 2.0, 0.5, 0.4, 0.0, 0.0, 3.0), (2, 4.0, 0.0, 0.0, -2.0, 0.5, 0.4, 0.0, 0.0, 3.0), (3, 0.5, 0.0, 0.0, 0.1, 0.0, 1.0, 0.0, 0.0, 0.5)]
    got = {r["k"]: r for r in polarimetry.freeman(spark.createDataFrame(rows, names), ["k"]).collect()}
    assert got[1]["surface"] > got[1]["double_bounce"] and got[2]["double_bounce"] > got[2]["surface"]
    assert got[3]["surface"] == got[3]["double_bounce"] == 0 and got[3]["volume"] > 0
    for r in got.values():
        assert r["span"] <= 7.5


def test_determinant_equals_numpy(spark):
    rng = np.random.default_rng(0)
    k = rng.normal(size=(3, 5)) + 1j * rng.normal(size=(3, 5))
    t = k @ k.conj().T
    row = [t[0, 0].real, t[0, 1].real, t[0, 1].imag, t[0, 2].real, t[0, 2].imag, t[1, 1].real, t[1, 2].real, t[1, 2].imag, t[2, 2].real]
    names = ["t11", "t12_re", "t12_im", "t13_re", "t13_im", "t22", "t23_re", "t23_im", "t33"]
    df = spark.createDataFrame([tuple(map(float, row))], names)
    assert math.isclose(df.select(polarimetry.determinant()).first()[0], np.linalg.det(t).real, rel_tol=1e-9)


def test_homography_maps_its_corners():
    source, target = [(0, 0), (0, 9), (7, 9), (7, 0)], [(1, 2), (2, 11), (9, 12), (8, 1)]
    h = shapes.solve_homography(source, target)
    for (x, y), (u, v) in zip(source, target, strict=True):
        w = h[6] * x + h[7] * y + 1
        assert math.isclose((h[0] * x + h[1] * y + h[2]) / w, u) and math.isclose((h[3] * x + h[4] * y + h[5]) / w, v)


def test_ellipses_round_trip(spark):
    df = spark.createDataFrame([(5.0, 2.0, 30.0), (3.0, 1.0, 135.0), (2.0, 2.0, 0.0)], "a double, b double, t double")
    c = shapes.ellipse_covariance(F.col("a"), F.col("b"), F.col("t"))
    back = df.select("a", "b", "t", *[v.alias(k) for k, v in c.items()])
    axes = back.select("a", "b", "t", *[v.alias(k) for k, v in shapes.ellipse_axes(F.col("ee"), F.col("en"), F.col("nn")).items()])
    for r in axes.collect():
        assert math.isclose(r["major"], r["a"], rel_tol=1e-9) and math.isclose(r["minor"], r["b"], rel_tol=1e-6)
        assert r["a"] == r["b"] or math.isclose(r["bearing"], r["t"], rel_tol=1e-9)
