"""Neighbourhood functions of whole tiles.

Each pixel moves to its own tile once and, near a tile's border, to the tiles beside it;
a task holds one tile and its margin, whatever the size of the image.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
#: Values that one strip of windows may hold.
STRIP = 1 << 21

Grid = Callable[..., np.ndarray]


def tiled(
    pixels: DataFrame, half: int, fold: Callable[[Grid, dict[str, float]], dict[str, np.ndarray]], columns: Sequence[str], returns: Sequence[str], constants: Sequence[str] = (), tile: int = TILE
) -> DataFrame:
    """``image_id, row, col`` and the columns that ``fold`` makes of each tile.

    ``fold`` gets a function from a column's name and a way of mirroring (``symmetric``
    repeats the border pixel, ``reflect`` does not) to the tile with ``half`` pixels on
    every side, and the values of the columns that are constant in an image.
    """
    if half > tile:
        raise ValueError(f"a tile of {tile} pixels cannot hold a margin of {half}")
    kinds = dict(pixels.dtypes)
    sizes = pixels.groupBy("image_id").agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))

    def reach(axis: str, n: str):
        first = F.greatest(F.floor((F.col(axis) - half) / tile), F.lit(0).cast("long"))
        return F.explode(F.sequence(first, F.least(F.floor((F.col(axis) + half) / tile), F.floor((F.col(n) - 1) / tile))))

    moved = pixels.select("image_id", "row", "col", *columns, *constants).join(sizes, "image_id")
    moved = moved.withColumn("_tr", reach("row", "_rows")).withColumn("_tc", reach("col", "_cols"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = [int(pdf[n].iloc[0]) for n in ("_rows", "_cols")]
        start = [int(pdf[n].iloc[0]) * tile for n in ("_tr", "_tc")]
        stop = [min(a + tile, n) for a, n in zip(start, size, strict=True)]
        low = [max(a - half, 0) for a in start]
        box = [min(b + half, n) - a for a, b, n in zip(low, stop, size, strict=True)]
        here = (pdf["row"].to_numpy(np.int64) - low[0], pdf["col"].to_numpy(np.int64) - low[1])

        def grid(name: str, mode: str = "symmetric") -> np.ndarray:
            dense = np.full(box, np.nan)
            dense[here] = pdf[name].to_numpy(float)
            at = [np.pad(np.arange(n), half, mode=mode)[a : b + 2 * half] - o for n, a, b, o in zip(size, start, stop, low, strict=True)]
            return dense[np.ix_(*at)]

        made = fold(grid, {c: float(pdf[c].iloc[0]) for c in constants})
        own = pdf["row"].between(start[0], stop[0] - 1) & pdf["col"].between(start[1], stop[1] - 1)
        out = pdf.loc[own, ["image_id", "row", "col"]]
        place = (out["row"].to_numpy(np.int64) - start[0], out["col"].to_numpy(np.int64) - start[1])
        return out.assign(**{c: made[c][place] for c in returns})

    schema = ", ".join([f"{c} {kinds[c]}" for c in ("image_id", "row", "col")] + [f"{c} double" for c in returns])
    return moved.groupBy("image_id", "_tr", "_tc").applyInPandas(run, schema)


def by_strips(grid: np.ndarray, side: int, fold: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``fold`` over the side x side windows of a padded grid, a bounded number at a time.

    ``fold`` gets windows of shape (rows, cols, side, side) and returns an array that ends
    in (rows, cols); the parts are joined along the rows.
    """
    windows = sliding_window_view(grid, (side, side))
    step = max(1, STRIP // (windows.shape[1] * side * side))
    return np.concatenate([fold(windows[k : k + step]) for k in range(0, len(windows), step)], axis=-2)


def ranked(pixels: DataFrame, half: int, rank: int, name: str = "value") -> DataFrame:
    """The value at a rank, from 0, of each pixel's sorted window, as column ``name``."""

    def fold(grid, _):
        pick = lambda w: np.partition(w.reshape(*w.shape[:2], -1), rank, axis=-1)[..., rank]
        return {name: by_strips(grid("value"), 2 * half + 1, pick)}

    return tiled(pixels, half, fold, ["value"], [name])


# Speckle


def gamma_share(shape: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below the mode, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        n = shape
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return front * total
    # Lentz's method.
    b = x + 1 - shape
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 10_000):
        a = -k * (k - shape)
        b += 2
        d = 1 / (a * d + b)
        c = b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def gamma_quantile(p: float, shape: float) -> float:
    """Quantile of the gamma distribution with mean 1 and the given shape, by bisection."""
    low, high = 0.0, 1.0
    while gamma_share(shape, high * shape) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if gamma_share(shape, middle * shape) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def lee_sigma(pixels: DataFrame, half: int, enl: float, coverage: float = 0.9, least: int = 1) -> DataFrame:
    """Lee filter over the neighbours that speckle of ``enl`` looks explains.

    ``value`` is an amplitude. A neighbour counts where it lies between the centre times
    the two gamma quantiles that hold ``coverage``; with fewer than ``least`` of them the
    reference is the mean of the whole window. The window of neighbours does not repeat
    the border pixel, the mean of the whole window does.
    """
    if not 0 < coverage < 1:
        raise ValueError("coverage must lie between 0 and 1")
    tiny = np.finfo(float).tiny
    side = 2 * half + 1

    low, high = gamma_quantile((1 - coverage) / 2, enl), gamma_quantile((1 + coverage) / 2, enl)

    def sums(w: np.ndarray) -> np.ndarray:
        centre = w[..., half : half + 1, half : half + 1]
        near = (w >= centre * low) & (w <= centre * high)
        v = np.where(near, w, 0.0)
        return np.stack([near.sum((-2, -1)), v.sum((-2, -1)), (v * v).sum((-2, -1))]).astype(float)

    def fold(grid, _):
        image = np.abs(grid("value", "reflect"))
        n, s, q = by_strips(image, side, sums)
        whole = by_strips(np.abs(grid("value")), side, lambda w: w.mean((-2, -1)))
        mean = s / np.maximum(n, 1)
        variation = np.maximum(q / np.maximum(n, 1) - mean * mean, 0) / (mean * mean + tiny)
        weight = np.clip(1 - (1 / enl) / (variation + tiny), 0, 1)
        reference = np.where(n >= least, mean, whole)
        centre = image[half : image.shape[0] - half, half : image.shape[1] - half]
        return {"value": np.maximum(reference + weight * (centre - reference), 0)}

    return tiled(pixels, half, fold, ["value"], ["value"])


#: For each side of the window the side of the nine blocks and their step.
BLOCKS = {
    3: (1, 1), 5: (3, 1), 7: (3, 2), 9: (5, 2), 11: (5, 3), 13: (5, 4), 15: (7, 4), 17: (7, 5),
    19: (7, 6), 21: (9, 6), 23: (9, 7), 25: (9, 8), 27: (11, 8), 29: (11, 9), 31: (11, 10),
}
#: Four compass operators on the nine blocks' means: across, rising, down, falling.
COMPASS = np.array([
    [[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]],
    [[0, 1, 1], [-1, 0, 1], [-1, -1, 0]],
    [[1, 1, 1], [0, 0, 0], [-1, -1, -1]],
    [[1, 1, 0], [1, 0, -1], [0, -1, -1]],
], float)


def half_planes(side: int) -> np.ndarray:
    """The eight half windows, edge included, that face the four directions and their opposites."""
    y, x = np.mgrid[:side, :side] - side // 2
    faces = [x, x - y, -y, -x - y]
    return np.array([f >= 0 for f in faces] + [f <= 0 for f in faces], float)


def refined_lee(matrices: DataFrame, diagonal: Sequence[str], others: Sequence[str], side: int = 7, looks: float = 1.0) -> DataFrame:
    """Edge-directed filter of a polarimetric matrix: every element in the same half window.

    The strongest of four gradients of the span picks the half window on its even side;
    the span's variation there sets one weight for all elements.
    """
    block, step = BLOCKS[side]
    half, noise = side // 2, 1 / looks
    masks = half_planes(side)
    corners = np.arange(3) * step
    names = [*diagonal, *others]

    def choose(w: np.ndarray) -> np.ndarray:
        means = np.stack([np.stack([w[..., r : r + block, c : c + block].mean((-2, -1)) for c in corners], -1) for r in corners], -2)
        slopes = np.tensordot(means, COMPASS, ([2, 3], [1, 2]))
        way = np.abs(slopes).argmax(-1)
        return way + 4 * (np.take_along_axis(slopes, way[..., None], -1)[..., 0] > 0)

    def fold(grid, _):
        grids = {c: grid(c, "reflect") for c in names}
        span = sum(grids[c] for c in diagonal)
        way = by_strips(span, side, choose)

        def directed(g: np.ndarray) -> np.ndarray:
            all_ways = by_strips(g, side, lambda w: np.moveaxis(np.tensordot(w, masks, ([2, 3], [1, 2])), -1, 0))
            return np.take_along_axis(all_ways, way[None], 0)[0] / masks.sum((1, 2))[way]

        mean = directed(span)
        variation = np.maximum(directed(span * span) - mean * mean, 0) / (mean * mean + 1e-10)
        weight = np.clip((variation - noise) / (variation * (1 + noise) + 1e-10), 0, 1)
        out = {}
        for c, g in grids.items():
            m = directed(g)
            out[c] = m + weight * (g[half : g.shape[0] - half, half : g.shape[1] - half] - m)
        return out

    return tiled(matrices, half, fold, names, names)


# Contrast


def local_equalize(pixels: DataFrame, side: int = 64, clip: float = 0.01, bins: int = 256) -> DataFrame:
    """Contrast-limited adaptive equalisation by blocks of ``side`` x ``side`` pixels.

    The last block of a line also takes what is left of it, so that none is small.
    Values are stretched to 0..1 over the finite ones of their image; a block's histogram
    loses what exceeds ``clip`` of the block's pixels, spread evenly over all bins, and its
    running share is the block's map. A pixel blends the maps of the four blocks whose
    centres surround it; beyond the outer centres the nearest block serves. What is not
    finite counts as 0, as does an image of one value.
    """
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    known = F.when(finite, v)
    sizes = pixels.groupBy("image_id").agg(F.min(known).alias("lo"), F.max(known).alias("hi"), F.max("row").alias("mr"), F.max("col").alias("mc"))
    level = F.when(finite & (F.col("hi") - F.col("lo") > np.finfo(float).eps), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    rows = pixels.join(sizes, "image_id").withColumn("bin", F.least(F.floor(level * bins), F.lit(bins - 1)).cast("int"))
    last = lambda most: F.greatest(F.floor((F.col(most) + 1) / side) - 1, F.lit(0))
    block = lambda axis, most: F.least(F.floor(F.col(axis) / side), last(most))
    counts = rows.groupBy("image_id", block("row", "mr").alias("br"), block("col", "mc").alias("bc"), "bin").agg(F.count("*").alias("n"))
    blocks = counts.groupBy("image_id", "br", "bc").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("h"))
    at = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("h", b), F.lit(0)).cast("double"))
    blocks = blocks.withColumn("limit", F.col("all") * clip).withColumn("c", at)
    cut = lambda x: F.least(x, F.col("limit"))
    blocks = blocks.withColumn("over", F.aggregate("c", F.lit(0.0), lambda s, x: s + x - cut(x)) / bins)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("runs"))
    step = lambda s, x: F.struct((s["sum"] + cut(x) + F.col("over")).alias("sum"), F.concat(s["runs"], F.array((s["sum"] + cut(x) + F.col("over")) / F.col("all"))).alias("runs"))
    maps = blocks.select("image_id", "br", "bc", F.posexplode(F.aggregate("c", start, step)["runs"]).alias("bin", "share"))

    def beside(axis: str, most: str, name: str) -> DataFrame:
        place = (F.col(axis) + 0.5) / side - 0.5
        low = F.floor(place)
        part = place - low
        held = lambda b: F.least(F.greatest(b, F.lit(0).cast("long")), last(most))
        return F.explode(F.array(F.struct(held(low).alias(name), (1 - part).alias("w")), F.struct(held(low + 1).alias(name), part.alias("w")))).alias(f"_{name}")

    asked = rows.select("image_id", "row", "col", "mc", "bin", beside("row", "mr", "br")).select("*", beside("col", "mc", "bc"))
    asked = asked.select("image_id", "row", "col", "bin", F.col("_br.br").alias("br"), F.col("_bc.bc").alias("bc"), (F.col("_br.w") * F.col("_bc.w")).alias("w"))
    return asked.join(maps, ["image_id", "br", "bc", "bin"]).groupBy("image_id", "row", "col").agg(F.sum(F.col("w") * F.col("share")).alias("value"))
