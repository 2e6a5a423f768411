"""Uncertainty ellipses and polygons as expressions; sensor models with driver-side coefficients."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipses: covariance ``ee, en, nn`` in a local east-north frame


def ellipse_axes(ee: Column, en: Column, nn: Column, sigmas: float = 1.0) -> dict[str, Column]:
    """Semi-axes and the major axis' bearing, clockwise from north in [0, 180)."""
    middle, half = (ee + nn) / 2, (ee - nn) / 2
    spread = F.sqrt(half * half + en * en)
    angle = F.atan2(en * 2, ee - nn) / 2
    return {
        "major": F.sqrt(middle + spread) * sigmas,
        "minor": F.sqrt(F.greatest(middle - spread, F.lit(0.0))) * sigmas,
        "bearing": F.pmod(90 - F.degrees(angle), F.lit(180.0)),
    }


def ellipse_covariance(major: Column, minor: Column, bearing: Column) -> dict[str, Column]:
    s, c = F.sin(F.radians(bearing)), F.cos(F.radians(bearing))
    a, b = major * major, minor * minor
    return {"ee": a * s * s + b * c * c, "en": (a - b) * s * c, "nn": a * c * c + b * s * s}


def convolve(ellipses: DataFrame, by: str) -> DataFrame:
    """Sum of independent errors: covariances add."""
    return ellipses.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("ee", "en", "nn")])


def fuse(ellipses: DataFrame, by: str) -> DataFrame:
    """Independent estimates of one place: inverse covariances add."""
    det = F.col("ee") * F.col("nn") - F.col("en") * F.col("en")
    inverse = ellipses.groupBy(by).agg(F.sum(F.col("nn") / det).alias("a"), F.sum(-F.col("en") / det).alias("b"), F.sum(F.col("ee") / det).alias("c"))
    whole = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    return inverse.select(by, (F.col("c") / whole).alias("ee"), (-F.col("b") / whole).alias("en"), (F.col("a") / whole).alias("nn"))


# Polygons


def edges(polygons: DataFrame) -> DataFrame:
    """``id, x0, y0, x1, y1`` of the edges of open rings ``ring array<struct<x, y>>``."""
    n = F.size("ring")
    pair = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", (i + 1) % n).alias("b")))
    rows = polygons.select("id", F.explode(pair).alias("e"))
    return rows.select("id", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def rasterize(polygons: DataFrame, rows: int, cols: int) -> DataFrame:
    """``id, row, col`` of the pixels inside by the even-odd rule at pixel centres.

    Every edge meets the lines it crosses; crossings of a line pair up in order.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.ceil(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(rows - 1)).cast("int")
    hit = edges(polygons).withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    x = F.col("x0") + (F.col("row") - F.col("y0")) / (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    lines = hit.groupBy("id", "row").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("xs", k * 2).alias("a"), F.get("xs", k * 2 + 1).alias("b")))
    runs = lines.where(F.size("xs") >= 2).select("id", "row", F.explode(spans).alias("s"))
    start, end = F.greatest(F.ceil("s.a"), F.lit(0)).cast("int"), F.least(F.ceil("s.b") - 1, F.lit(cols - 1)).cast("int")
    return runs.where(start <= end).select("id", "row", F.explode(F.sequence(start, end)).alias("col"))


# Sensor models


def solve_homography(source: Sequence[tuple[float, float]], target: Sequence[tuple[float, float]]) -> tuple[float, ...]:
    """Row-major matrix that maps four points to four others; eight equations on the driver."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return (*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0)


def rational(lat: Column, lon: Column, h: Column, model: dict[str, Sequence[float]]) -> tuple[Column, Column]:
    """Line and sample of a rational polynomial model.

    ``model`` holds ``offset`` and ``scale`` of (line, sample, lat, lon, height) and
    twenty coefficients each of ``line_num, line_den, samp_num, samp_den``.
    """
    o, s = model["offset"], model["scale"]
    p, l, z = (lat - o[2]) / s[2], (lon - o[3]) / s[3], (h - o[4]) / s[4]  # noqa: E741
    one = F.lit(1.0)
    # Fixed order of the terms.
    terms = [one, l, p, z, l * p, l * z, p * z, l * l, p * p, z * z, p * l * z, l * l * l, l * p * p, l * z * z, l * l * p, p * p * p, p * z * z, l * l * z, p * p * z, z * z * z]
    value = lambda name: sum((t * c for t, c in zip(terms, model[name], strict=True) if c), F.lit(0.0))
    return value("line_num") / value("line_den") * s[0] + o[0], value("samp_num") / value("samp_den") * s[1] + o[1]


def rational_inverse(images: DataFrame, model: dict[str, Sequence[float]], rounds: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """Adds ``lat, lon`` to ``line, sample, h`` by Newton's iteration on the rational model.

    Steps are taken in normalised coordinates with differences as derivatives, whole
    batches at once; a row that does not settle gets null.
    """
    o, s = np.array(model["offset"], float), np.array(model["scale"], float)
    coefficients = np.array([model[k] for k in ("line_num", "line_den", "samp_num", "samp_den")], float)

    def image(p: np.ndarray, l: np.ndarray, z: np.ndarray) -> np.ndarray:  # noqa: E741
        first = [np.ones_like(p), l, p, z]
        second = [l * p, l * z, p * z, l * l, p * p, z * z]
        third = [p * l * z, l**3, l * p * p, l * z * z, l * l * p, p**3, p * z * z, l * l * z, p * p * z, z**3]
        a, b, c, d = coefficients @ np.stack(first + second + third)
        return np.stack([a / b, c / d])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            want = np.stack([(pdf[c].to_numpy(float) - o[k]) / s[k] for k, c in enumerate(("line", "sample"))])
            z = (pdf["h"].to_numpy(float) - o[4]) / s[4]
            at, e = np.zeros_like(want), 1e-6
            change = np.full(want.shape[1], np.inf)
            with np.errstate(all="ignore"):
                for _ in range(rounds):
                    gap = want - image(*at, z)
                    by_p = (image(at[0] + e, at[1], z) - image(at[0] - e, at[1], z)) / (2 * e)
                    by_l = (image(at[0], at[1] + e, z) - image(at[0], at[1] - e, z)) / (2 * e)
                    det = by_p[0] * by_l[1] - by_p[1] * by_l[0]
                    move = np.stack([by_l[1] * gap[0] - by_l[0] * gap[1], by_p[0] * gap[1] - by_p[1] * gap[0]]) / det
                    at, change = at + move, np.abs(move).max(axis=0)
                    if np.nanmax(change, initial=0) < tolerance:
                        break
            found = np.where(change < 1e-6, at * s[2:4, None] + o[2:4, None], np.nan)
            yield pdf.assign(lat=pd.Series(found[0], index=pdf.index).astype(object).where(~np.isnan(found[0]), None), lon=pd.Series(found[1], index=pdf.index).astype(object).where(~np.isnan(found[1]), None))

    schema = ", ".join([f"`{n}` {t}" for n, t in images.dtypes] + ["lat double", "lon double"])
    return images.mapInPandas(run, schema)


def undulation(places: DataFrame, grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """Adds ``undulation`` to ``id, lat, lon``: a geoid grid's height, bilinear.

    ``grid(row, col, value)`` covers the globe: its first row lies at the north pole, its
    last at the south pole, its first column on the meridian; columns go round. Nodes that
    are missing give null. An orthometric height is the ellipsoidal one less this.
    """
    y, x = (90 - F.col("lat")) / 180 * (rows - 1), F.pmod(F.col("lon"), F.lit(360.0)) / 360 * cols
    r0, c0 = F.least(F.floor(y), F.lit(rows - 1).cast("long")), F.floor(x)
    spot = lambda r, c, w: F.struct(F.least(r, F.lit(rows - 1).cast("long")).alias("row"), F.pmod(c, F.lit(cols).cast("long")).alias("col"), w.alias("w"))
    dy, dx = y - r0, x - c0
    nodes = F.array(spot(r0, c0, (1 - dy) * (1 - dx)), spot(r0, c0 + 1, (1 - dy) * dx), spot(r0 + 1, c0, dy * (1 - dx)), spot(r0 + 1, c0 + 1, dy * dx))
    asked = places.select("id", F.explode(nodes).alias("n")).select("id", "n.row", "n.col", "n.w")
    met = asked.join(grid.select("row", "col", "value"), ["row", "col"], "left").groupBy("id")
    found = met.agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("undulation"))
    return places.join(found, "id", "left")


# Vectors


def cross(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def ray_ellipsoid(origin: Sequence[Column], direction: Sequence[Column], a: float, b: float) -> Column:
    """Distance along a ray to an ellipsoid of revolution; null where it misses."""
    o = [origin[0] / a, origin[1] / a, origin[2] / b]
    d = [direction[0] / a, direction[1] / a, direction[2] / b]
    q, h, c = dot(d, d), dot(o, d), dot(o, o) - 1
    disc = h * h - q * c
    return F.when(disc >= 0, (-h - F.sqrt(F.greatest(disc, F.lit(0.0)))) / q)
