"""Vector operators on feature tables: boxes ``minx, miny, maxx, maxy`` and points ``x, y``.

Joins meet on the cells of a grid, so they are equalities with the exact predicate as
residual. A pair of boxes may share several cells; the cell that holds the lower left
corner of their intersection alone reports it, so nothing has to be made distinct. Both
sides are shuffled: the planner does not know how many cells a box has, and would take
the exploded side for small enough to send it through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("minx", "miny", "maxx", "maxy")


def bounds(features: DataFrame) -> DataFrame:
    return features.agg(*[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)])


def filter_bbox(boxes: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Boxes that meet a box; touching counts."""
    return boxes.where((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny))


def filter_property(features: DataFrame, name: str, value) -> DataFrame:
    """Equality in which null meets null."""
    return features.where(F.col(name).eqNullSafe(F.lit(value)))


def _cells(low: str, high: str, size: float) -> Column:
    return F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long"))


def _gridded(boxes: DataFrame, prefix: str, size: float) -> DataFrame:
    out = boxes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in boxes.columns])
    out = out.withColumn("gx", F.explode(_cells(f"{prefix}_minx", f"{prefix}_maxx", size)))
    return out.withColumn("gy", F.explode(_cells(f"{prefix}_miny", f"{prefix}_maxy", size)))


def intersecting_boxes(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes that meet, with columns ``l_*`` and ``r_*`` and their intersection."""
    pairs = _gridded(left, "l", cell).hint("merge").join(_gridded(right, "r", cell).hint("merge"), ["gx", "gy"])
    x0, y0 = F.greatest("l_minx", "r_minx"), F.greatest("l_miny", "r_miny")
    x1, y1 = F.least("l_maxx", "r_maxx"), F.least("l_maxy", "r_maxy")
    once = (F.floor(x0 / cell) == F.col("gx")) & (F.floor(y0 / cell) == F.col("gy"))
    return pairs.where((x0 <= x1) & (y0 <= y1) & once).drop("gx", "gy").withColumns({"minx": x0, "miny": y0, "maxx": x1, "maxy": y1})


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float, how: str = "inner") -> DataFrame:
    """Join of points to the boxes that contain them, ``l_*`` and ``r_*``; left keeps all points."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    p = points.select(*[F.col(c).alias(f"l_{c}") for c in points.columns], F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    b = _gridded(boxes, "r", cell)
    inside = F.col("l_x").between(F.col("r_minx"), F.col("r_maxx")) & F.col("l_y").between(F.col("r_miny"), F.col("r_maxy"))
    same = (p["gx"] == b["gx"]) & (p["gy"] == b["gy"])
    return p.join(b.hint("merge"), same & inside, how).drop("gx", "gy")


def clip_boxes(boxes: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    out = filter_bbox(boxes, minx, miny, maxx, maxy)
    return out.withColumns(
        {"minx": F.greatest("minx", F.lit(minx)), "miny": F.greatest("miny", F.lit(miny)), "maxx": F.least("maxx", F.lit(maxx)), "maxy": F.least("maxy", F.lit(maxy))}
    )


def dissolve(boxes: DataFrame, by: str) -> DataFrame:
    """One feature per value: extent, number of parts, and the first part's properties."""
    return boxes.groupBy(by).agg(
        F.count("*").alias("parts"), *[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max), strict=True)], F.min_by("id", "seq").alias("first_id")
    )


def ring_area(ring: Column) -> Column:
    """Signed area of an open ring of ``struct<x, y>``."""
    size = F.size(ring)
    term = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    terms = F.transform(F.sequence(F.lit(0), size - 1), lambda i: term(F.get(ring, i), F.get(ring, (i + 1) % size)))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    size = F.size(ring)
    area = ring_area(ring)

    def axis(name: str) -> Column:
        def part(i):
            a, b = F.get(ring, i), F.get(ring, (i + 1) % size)
            return (a[name] + b[name]) * (a["x"] * b["y"] - b["x"] * a["y"])

        return F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), part), F.lit(0.0), lambda s, t: s + t) / (area * 6)

    return axis("x"), axis("y")


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether a point lies in an open ring."""
    size = F.size(ring)

    def crosses(i):
        a, b = F.get(ring, i), F.get(ring, (i + 1) % size)
        over = (a["y"] > y) != (b["y"] > y)
        return F.when(over & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), size - 1), crosses), F.lit(0), lambda s, t: s + t) % 2 == 1


def buffer_points(points: DataFrame, distance: float, quarter: int = 16) -> DataFrame:
    """Adds ``ring``, the regular polygon of ``4 * quarter`` corners around a point."""
    n = 4 * quarter
    angle = lambda k: k * F.lit(6.283185307179586 / n)
    corner = lambda k: F.struct((F.col("x") + F.cos(angle(k)) * distance).alias("x"), (F.col("y") + F.sin(angle(k)) * distance).alias("y"))
    return points.withColumn("ring", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, by monotone chains."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(ordered):
        out: list = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def convex_hulls(points: DataFrame, by: str) -> DataFrame:
    """``by, corners, x, y`` of each group's hull.

    Every batch first reduces each group to its own hull, so only corners are shuffled.
    """
    kind = dict(points.dtypes)[by]
    schema = f"{by} {kind}, x double, y double"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, g in pdf.groupby(by):
                h = hull(g[["x", "y"]].to_numpy())
                yield pd.DataFrame({by: key, "x": h[:, 0], "y": h[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({by: pdf[by].iloc[0], "corner": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    few = points.where(F.col(by).isNotNull()).select(by, "x", "y").mapInPandas(part, schema)
    return few.groupBy(by).applyInPandas(whole, f"{by} {kind}, corner long, x double, y double")


def raster_to_points(pixels: DataFrame, threshold: float, step: int = 1) -> DataFrame:
    return pixels.where((F.col("value") >= threshold) & (F.col("row") % step == 0) & (F.col("col") % step == 0)).select("image_id", F.col("col").alias("x"), F.col("row").alias("y"), "value")


def rasterize_boxes(boxes: DataFrame, value: str) -> DataFrame:
    """``row, col, value`` of the whole pixels strictly inside a box; of several the last ``seq`` wins."""
    rows = F.sequence(F.floor(F.col("miny") + 1).cast("int"), F.ceil(F.col("maxy") - 1).cast("int"))
    cols = F.sequence(F.floor(F.col("minx") + 1).cast("int"), F.ceil(F.col("maxx") - 1).cast("int"))
    some = (F.floor(F.col("miny") + 1) <= F.ceil(F.col("maxy") - 1)) & (F.floor(F.col("minx") + 1) <= F.ceil(F.col("maxx") - 1))
    burnt = boxes.where(some).withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    return burnt.groupBy("row", "col").agg(F.max_by(value, "seq").alias("value"))


def transform_boxes(boxes: DataFrame, matrix: tuple[float, ...]) -> DataFrame:
    """Boxes whose corners a row-major 2 x 3 matrix has moved, refitted to their extent."""
    a, b, c, d, e, f = matrix
    xs = [F.col(x) * a + F.col(y) * b + c for x in ("minx", "maxx") for y in ("miny", "maxy")]
    ys = [F.col(x) * d + F.col(y) * e + f for x in ("minx", "maxx") for y in ("miny", "maxy")]
    return boxes.withColumns({"minx": F.least(*xs), "maxx": F.greatest(*xs), "miny": F.least(*ys), "maxy": F.greatest(*ys)})
