"""Overlay, tiles, decompositions and models against numpy and against known shapes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.operators import overlay, polarimetry, raster, shapes, signal, tiles, vector
from orbweave.sources import fields


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def polygons(spark, rows):
    rows = [(k, layer, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, layer, ring in rows]
    return spark.createDataFrame(rows, f"k string, layer int, ring {overlay.RING}")


def area(parts):
    return {r["k"]: r["a"] for r in parts.groupBy("k").agg(F.sum(vector.ring_area(F.col("ring"))).alias("a")).collect()}


@pytest.mark.parametrize(("how", "want"), [("intersection", 25), ("union", 175), ("difference", 75), ("symmetric", 150)])
@pytest.mark.parametrize("cell", [100.0, 3.7])
def test_two_squares(spark, how, want, cell):
    rows = [("a", 0, square(0, 0, 10)), ("a", 1, square(5, 5, 10)), ("far", 0, square(40, 40, 1)), ("none", 1, [])]
    got = area(overlay.overlay(polygons(spark, rows), "k", how, cell))
    assert math.isclose(got["a"], want) and got.get("far") == (None if how == "intersection" else 1) and "none" not in got


def test_slanted_polygons_against_points(spark):
    """Stars and triangles with holes by overlap: areas as counted on a fine raster."""
    rng = np.random.default_rng(5)
    rows = []
    for layer in (0, 1):
        for _ in range(6):
            n, c = rng.integers(3, 8), rng.uniform(2, 8, 2)
            angles = np.sort(rng.uniform(0, 2 * np.pi, n))
            rows.append(("a", layer, [tuple(c + r * np.array([np.cos(t), np.sin(t)])) for r, t in zip(rng.uniform(1, 3, n), angles, strict=True)]))
    y, x = np.mgrid[0:12:600j, 0:12:600j]

    def inside(ring):
        out = np.zeros(x.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            over = (ay > y) != (by > y)
            out ^= over & (x < (bx - ax) * (y - ay) / ((by - ay) or 1) + ax)
        return out

    a, b = (np.any([inside(r) for _, k, r in rows if k == layer], axis=0) for layer in (0, 1))
    step = (12 / 599) ** 2
    for how, mask in {"union": a | b, "intersection": a & b, "difference": a & ~b}.items():
        got = area(overlay.overlay(polygons(spark, rows), "k", how, 2.5))["a"]
        assert math.isclose(got, mask.sum() * step, rel_tol=0.01)


def test_clipping_a_concave_ring(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)]
    out = overlay.clip_polygons(polygons(spark, [("a", 0, ring), ("b", 0, square(20, 20, 1)), ("c", 0, [])]), [(1, 0, 8), (0, 1, 5)])
    assert set(area(out)) == {"a"}
    # Left of x = 8 and below y = 5: the trapezoid less the notch above (5, 2).
    t = np.linspace(0, 8, 800_001)
    top = np.minimum(5, np.where(t < 5, 10 - 1.6 * t, 2 + 1.6 * (t - 5)))
    assert math.isclose(area(out)["a"], float(((top[1:] + top[:-1]) / 2 * np.diff(t)).sum()), rel_tol=1e-6)


def image(spark, values, image_id=0):
    rows = [(image_id, r, c, float(v)) for (r, c), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "image_id long, row int, col int, value double")


def dense(frame, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in frame.collect():
        out[r["row"], r["col"]] = r[name]
    return out


@pytest.mark.parametrize("tile", [4, 7, 64])
@pytest.mark.parametrize("mode", ["symmetric", "reflect"])
@pytest.mark.parametrize("shape", [(13, 9), (1, 6), (2, 2)])
def test_tiles_see_what_the_whole_image_sees(spark, tile, mode, shape):
    values = np.random.default_rng(1).normal(size=shape)
    half = 3

    def fold(grid, constants):
        assert constants == {"k": 2.0}
        return {"s": tiles.by_strips(grid("value", mode), 2 * half + 1, lambda w: w.sum((-2, -1)))}

    got = tiles.tiled(image(spark, values).withColumn("k", F.lit(2.0)), half, fold, ["value"], ["s"], ["k"], tile)
    want = np.lib.stride_tricks.sliding_window_view(np.pad(values, half, mode=mode), (7, 7)).sum((-2, -1))
    assert np.allclose(dense(got, shape, "s"), want)


def test_gamma_quantiles():
    for shape in (0.5, 1.0, 4.0, 30.0):
        for p in (0.01, 0.5, 0.95):
            x = tiles.gamma_quantile(p, shape) * shape
            t = np.linspace(0, x ** (shape if shape < 1 else 1), 400_001)[1:]
            # Below shape 1 the density has a pole; u = x ** shape removes it.
            density = np.exp(-(t ** (1 / shape))) / shape if shape < 1 else t ** (shape - 1) * np.exp(-t)
            assert math.isclose((density.sum() - density[-1] / 2) * (t[1] - t[0]) / math.gamma(shape), p, rel_tol=2e-4)


def test_filters_keep_even_images(spark):
    flat = np.full((9, 9), 3.0)
    assert np.allclose(dense(tiles.lee_sigma(image(spark, flat), 2, 4.0), flat.shape), 3)
    both = image(spark, flat).withColumnRenamed("value", "c11").withColumn("c22", F.lit(1.0))
    assert np.allclose(dense(tiles.refined_lee(both, ["c11", "c22"], [], 7), flat.shape, "c11"), 3)
    assert np.allclose(dense(tiles.local_equalize(image(spark, flat), 4), flat.shape), dense(tiles.local_equalize(image(spark, flat), 4), flat.shape)[0, 0])


@pytest.mark.parametrize("side", [5, 7])
def test_refined_filter_pixel_by_pixel(spark, side):
    rng = np.random.default_rng(6)
    values = rng.gamma(4, 1, (10, 9)) * np.where(np.arange(9) < 4, 1, 9)
    half, (block, step) = side // 2, tiles.BLOCKS[side]
    padded = np.pad(values, half, mode="reflect")
    want = np.full_like(values, np.nan)
    for (r, c), v in np.ndenumerate(values):
        # In a corner the mirrored window has no direction.
        if r in (0, 9) and c in (0, 8):
            continue
        w = padded[r : r + side, c : c + side]
        m = [[w[i * step : i * step + block, j * step : j * step + block].mean() for j in range(3)] for i in range(3)]
        left, right = m[0][0] + m[1][0] + m[2][0], m[0][2] + m[1][2] + m[2][2]
        above, below = sum(m[0]), sum(m[2])
        slopes = [right - left, m[0][1] + m[0][2] + m[1][2] - m[1][0] - m[2][0] - m[2][1], above - below, m[0][0] + m[0][1] + m[1][0] - m[1][2] - m[2][1] - m[2][2]]
        best = max(range(4), key=lambda k: abs(slopes[k]))
        toward = [(0, 1), (-1, 1), (-1, 0), (-1, -1)][best]
        sign = -1 if slopes[best] > 0 else 1
        chosen = [w[i, j] for i in range(side) for j in range(side) if sign * ((i - half) * toward[0] + (j - half) * toward[1]) >= 0]
        mean, var = np.mean(chosen), np.var(chosen)
        cv = var / mean**2
        want[r, c] = mean + min(max((cv - 0.25) / (cv * 1.25), 0), 1) * (v - mean)
    frame = image(spark, values).withColumnRenamed("value", "c11")
    got = dense(tiles.refined_lee(frame, ["c11"], [], side, 4.0), values.shape, "c11")
    assert not np.isnan(got).any() and np.allclose(got[~np.isnan(want)], want[~np.isnan(want)], rtol=1e-6)


def test_touzi_returns_the_angles_of_coherent_targets(spark):
    rng = np.random.default_rng(2)
    rows, want = [], []
    for k in range(40):
        alpha, phi, tau, psi = rng.uniform(0.2, 1.3), rng.uniform(-1.2, 1.2), rng.uniform(-0.6, 0.6), rng.uniform(-0.7, 0.7)
        x, y, z = np.cos(alpha) * np.cos(2 * tau), np.sin(alpha) * np.exp(1j * phi), -1j * np.cos(alpha) * np.sin(2 * tau)
        v = np.array([x, y * np.cos(2 * psi) - z * np.sin(2 * psi), y * np.sin(2 * psi) + z * np.cos(2 * psi)]) * np.exp(1j * rng.uniform(0, 6))
        t = np.outer(v, v.conj())
        rows.append((k, *map(float, (t[0, 0].real, t[0, 1].real, t[0, 1].imag, t[0, 2].real, t[0, 2].imag, t[1, 1].real, t[1, 2].real, t[1, 2].imag, t[2, 2].real))))
        want.append(np.degrees([alpha, phi, tau, psi]))
    names = "k long, t11 double, t12_re double, t12_im double, t13_re double, t13_im double, t22 double, t23_re double, t23_im double, t33 double"
    got = {r["k"]: r for r in polarimetry.touzi(spark.createDataFrame(rows, names), ["k"]).collect()}
    for k, w in enumerate(want):
        assert np.allclose([got[k][f"{n}1"] for n in ("alpha", "phi", "tau", "psi")], w, atol=1e-4)
        assert np.allclose([got[k][f"{n}_mean"] for n in ("alpha", "phi", "tau", "psi")], w, atol=1e-4)


def test_coherency_of_covariance(spark):
    rng = np.random.default_rng(3)
    cols = [f"{c}_{p}" for c in ("hh", "hv", "vh", "vv") for p in ("re", "im")]
    ch = spark.createDataFrame([(k, *map(float, rng.normal(size=8))) for k in range(10)], "k long, " + ", ".join(f"{c} double" for c in cols))
    direct = {r["k"]: r for r in ch.select(*polarimetry.coherency(["k"])).collect()}
    turned = ch.select(*polarimetry.covariance(["k"])).select(*polarimetry.coherency_of_covariance(["k"]))
    for r in turned.collect():
        assert all(math.isclose(r[n], direct[r["k"]][n], abs_tol=1e-12) for n in turned.columns)


def test_yamaguchi_of_pure_targets(spark):
    names = "k long, t11 double, t12_re double, t12_im double, t13_re double, t13_im double, t22 double, t23_re double, t23_im double, t33 double"
    rows = [(0, 4.0, *[0.0] * 8), (1, *[0.0] * 5, 3.0, 0.0, 0.0, 0.0), (2, 0.0, *[0.0] * 4, 1.0, 0.0, 1.0, 1.0), (3, *[0.0] * 9)]
    got = {r["k"]: r for r in polarimetry.yamaguchi(spark.createDataFrame(rows, names), ["k"], "y4o").collect()}
    assert math.isclose(got[0]["surface"], 4) and got[0]["double_bounce"] == got[0]["helix"] == 0
    assert math.isclose(got[1]["double_bounce"], 3) and got[1]["surface"] == 0
    assert math.isclose(got[2]["helix"], 2)
    assert got[3]["span"] == 0 and got[3]["surface"] == 0


def test_looks_add_up_to_the_image(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(12, 10)) + 1j * rng.normal(size=(12, 10))
    frame = spark.createDataFrame([(0, r, c, float(v.real), float(v.imag)) for (r, c), v in np.ndenumerate(z)], "image_id long, row int, col int, re double, im double")
    parts = signal.multilook_images(frame, (3, 2))
    assert parts.select("look").distinct().count() == 6
    total = parts.groupBy("row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    assert np.allclose(dense(total, z.shape, "re"), z.real) and np.allclose(dense(total, z.shape, "im"), z.imag)


def test_filter_banks_follow_their_kernels(spark):
    f = lambda t: math.sin(t / 3)
    samples = spark.createDataFrame([(1, float(t), f(t)) for t in range(40)], "key long, t double, value double")
    wanted = spark.createDataFrame([(1, i, 8 + 0.61 * i) for i in range(30)], "key long, id long, x double")
    run = lambda half, w: {r["id"]: r["value"] for r in signal.resample(samples, wanted, half, w).collect()}
    exact, bank, coarse = run(4, signal.kaiser_weight(4)), run(4, signal.phased_weight(4, 128)), run(2, signal.farrow_weight(2, 2))
    cubic, farrow = run(2, signal.lagrange_weight(2)), run(2, signal.farrow_weight(2, 3))
    for i in range(30):
        assert abs(exact[i] - bank[i]) < 1e-4 and abs(cubic[i] - farrow[i]) < 1e-12
        assert abs(coarse[i] - f(8 + 0.61 * i)) < 0.02


def test_rational_inverse_leaves_what_does_not_settle(spark):
    model = {"offset": (0, 0, 0, 0, 0), "scale": (1, 1, 1, 1, 1), "line_num": [0.0, 0, 1] + [0] * 17, "line_den": [1.0] + [0] * 19, "samp_num": [0.0] * 7 + [1] + [0] * 12, "samp_den": [1.0] + [0] * 19}
    rows = spark.createDataFrame([(0.5, 4.0, 0.0), (0.5, -4.0, 0.0), (None, 1.0, 0.0)], "line double, sample double, h double")
    # The sample is the square of the longitude: its derivative vanishes at the start.
    got = shapes.rational_inverse(rows, model).collect()
    assert [r["lon"] for r in got] == [None, None, None]


def test_field_dictionary(spark):
    assert len(fields.entries()) == 100 and len(fields.entries("sar")) == 15
    assert fields.lookup("physical.speed") == ("physical.speed", "physical", "float", "m/s") and fields.lookup("speed") is None
    row = spark.createDataFrame([("7", "x")], "a string, b string").select(fields.typed(F.col("a"), "int").alias("a"), fields.typed(F.col("b"), "float").alias("b")).first()
    assert row["a"] == 7 and row["b"] is None


@pytest.mark.parametrize("kind", ["noise", "flat", "halves"])
def test_looks_equal_a_full_sort(spark, kind):
    rng = np.random.default_rng(8)
    values = {"noise": rng.gamma(4, 1, (20, 15)), "flat": np.full((6, 6), 2.0), "halves": np.where(np.arange(12) < 6, 1.0, 7.0) * np.ones((12, 1))}[kind]
    w = np.lib.stride_tricks.sliding_window_view(np.pad(values, 1, mode="symmetric"), (3, 3))
    ci2 = np.sort(np.maximum((w * w).mean((-2, -1)) - w.mean((-2, -1)) ** 2, 0).ravel() / w.mean((-2, -1)).ravel() ** 2)
    low = ci2[: max(1, int(ci2.size * 0.1))].mean()
    got = raster.looks(image(spark, values), 1).first()["enl"]
    assert got > 1e6 or got == 1.0 if low < 1e-9 else math.isclose(got, 1 / low, rel_tol=1e-9)


def test_geoid_heights(spark):
    grid = np.random.default_rng(9).normal(size=(5, 8))
    nodes = spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(grid)], "row int, col int, value double")
    rows = [(0, 90.0, 0.0), (1, -90.0, 45.0), (2, 22.5, -45.0), (3, 45.0, 359.0), (4, 0.0, 22.5)]
    got = {r["id"]: r["undulation"] for r in shapes.undulation(spark.createDataFrame(rows, "id int, lat double, lon double"), nodes, 5, 8).collect()}
    assert math.isclose(got[0], grid[0, 0]) and math.isclose(got[1], grid[4, 1])
    assert math.isclose(got[2], (grid[1, 7] + grid[2, 7]) / 2)
    assert math.isclose(got[3], grid[1, 7] / 45 + grid[1, 0] * 44 / 45, rel_tol=1e-9)
    assert math.isclose(got[4], (grid[2, 0] + grid[2, 1]) / 2)
