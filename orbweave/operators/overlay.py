"""Overlay of polygons given as open rings ``ring array<struct<x, y>>``.

Clipping by a half plane is an expression. Unions, intersections and differences are cut
along the cells of a grid, so that any number of polygons of a group is spread over many
tasks; inside a cell horizontal slabs between neighbouring corners and crossings turn
every shape, holes and self-contact included, into trapezoids that do not overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RING = "array<struct<x: double, y: double>>"
#: What is kept where the layers are present (a) and (b).
RULES = {
    "union": lambda a, b: a | b,
    "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b,
    "symmetric": lambda a, b: a ^ b,
}


def clip_half_plane(ring: Column, a: Column, b: Column, c: Column) -> Column:
    """The ring's part where ``a x + b y <= c``; an empty array where nothing is left."""
    none = F.array().cast(RING)
    n = F.size(ring)

    def step(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, (i + 1) % n)
        dp, dq = a * p["x"] + b * p["y"] - c, a * q["x"] + b * q["y"] - c
        t = dp / (dp - dq)
        met = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        return F.concat(F.when(dp <= 0, F.array(p)).otherwise(none), F.when(dp * dq < 0, F.array(met)).otherwise(none))

    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), step))).otherwise(none)


def clip_polygons(polygons: DataFrame, planes: Sequence[tuple]) -> DataFrame:
    """Polygons cut by half planes ``(a, b, c)`` in turn, that is by any convex shape; empty ones go."""
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    all_planes = F.array(*[F.struct(*[number(v).alias(k) for k, v in zip("abc", p, strict=True)]) for p in planes])
    # One fold instead of nested expressions, whose size would grow with every plane.
    cut = F.aggregate(all_planes, F.col("ring").cast(RING), lambda ring, p: clip_half_plane(ring, p["a"], p["b"], p["c"]))
    return polygons.withColumn("ring", cut).where(F.size("ring") >= 3)


def trapezoids(rings: Sequence[np.ndarray], layers: Sequence[int], how: str) -> np.ndarray:
    """Rows ``y0, y1, left0, right0, left1, right1`` of the parts that a rule keeps."""
    rule = RULES[how]
    ends = [np.hstack([r, np.roll(r, -1, axis=0), np.full((len(r), 1), k)]) for k, r in enumerate(rings)]
    e = np.vstack(ends)
    e = e[e[:, 1] != e[:, 3]]
    turn = e[:, 1] > e[:, 3]
    e[turn, :4] = e[turn][:, [2, 3, 0, 1]]
    x0, y0, x1, y1 = e[:, :4].T
    slope = (x1 - x0) / (y1 - y0)
    cuts = [y0, y1]
    for k in range(len(e) - 1):
        # Crossings of one edge with all later ones.
        gap = slope[k] - slope[k + 1 :]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (x0[k + 1 :] - slope[k + 1 :] * y0[k + 1 :] - x0[k] + slope[k] * y0[k]) / gap
            cuts.append(y[(gap != 0) & (y > np.maximum(y0[k], y0[k + 1 :])) & (y < np.minimum(y1[k], y1[k + 1 :]))])
    ys = np.unique(np.concatenate(cuts))
    out = []
    owner, layers = e[:, 4].astype(int), np.asarray(layers)
    for a, b in zip(ys[:-1], ys[1:], strict=True):
        active = np.flatnonzero((y0 <= a) & (y1 >= b))
        middle = x0[active] + slope[active] * ((a + b) / 2 - y0[active])
        active = active[np.argsort(middle, kind="stable")]
        inside = np.zeros(len(rings), bool)
        open_edge = None
        for k in active:
            inside[owner[k]] ^= True
            kept = bool(rule(inside[layers == 0].any(), inside[layers == 1].any()))
            if kept and open_edge is None:
                open_edge = k
            elif not kept and open_edge is not None:
                at = lambda j, y: x0[j] + slope[j] * (y - y0[j])
                out.append((a, b, at(open_edge, a), at(k, a), at(open_edge, b), at(k, b)))
                open_edge = None
    return np.array(out).reshape(-1, 6)


def overlay(polygons: DataFrame, by: str, how: str, cell: float) -> DataFrame:
    """``by, ring``: parts that do not overlap of one layer or two, for each value of ``by``.

    ``polygons`` has ``by``, ``layer`` (0 or 1) and ``ring``. A union of one layer is a
    dissolve. The cell is a parameter: the polygons that meet one cell share a task.
    """
    if how not in RULES:
        raise ValueError(f"how must be one of {sorted(RULES)}, not {how!r}")
    kind = dict(polygons.dtypes)[by]
    side = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    cells = lambda axis: F.sequence(F.floor(side(F.array_min, axis) / cell), F.floor(side(F.array_max, axis) / cell))
    placed = polygons.where(F.size("ring") >= 3).select(by, "layer", "ring", F.explode(cells("x")).alias("gx"), cells("y").alias("_ys"))
    placed = placed.select(by, "layer", "ring", "gx", F.explode("_ys").alias("gy"))
    gx, gy = F.col("gx"), F.col("gy")
    planes = [(-1, 0, -gx * cell), (1, 0, (gx + 1) * cell), (0, -1, -gy * cell), (0, 1, (gy + 1) * cell)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [np.array([(p["x"], p["y"]) for p in r], float) for r in pdf["ring"]]
        parts = trapezoids(rings, pdf["layer"].to_numpy(int), how)
        corners = [[(l0, a), (r0, a), (r1, b), (l1, b)] for a, b, l0, r0, l1, r1 in parts]
        whole = [[{"x": float(x), "y": float(y)} for x, y in c] for c in corners]
        return pd.DataFrame({by: pd.Series([pdf[by].iloc[0]] * len(whole), dtype=pdf[by].dtype), "ring": pd.Series(whole, dtype=object)})

    return clip_polygons(placed, planes).groupBy(by, "gx", "gy").applyInPandas(run, f"{by} {kind}, ring {RING}")
