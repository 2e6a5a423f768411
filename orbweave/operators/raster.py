"""Raster operators on pixel tables ``image_id, row, col, value``.

Statistics are partial aggregates; neighbourhoods are separable windows over a line of
pixels, mirrored at the border, so no pixel meets more than the pixels of its own line.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.tiles import ranked

KEYS = ["image_id"]
MAD_TO_STD = 1.4826


# Statistics and normalisation


def moments(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Count, mean, population variance, extremes and norm of the finite values."""
    v = F.col("value")
    finite = pixels.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return finite.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(v).alias("mean"),
        F.var_pop(v).alias("variance"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        F.sqrt(F.sum(v * v)).alias("l2_norm"),
    )


def median_deviation(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Median and median absolute deviation; the second pass joins the small medians."""
    medians = pixels.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("median"))
    away = F.abs(F.col("value") - F.col("median"))
    out = pixels.join(medians, keys).groupBy(*keys).agg(F.first("median").alias("median"), F.percentile(away, F.lit(0.5)).alias("mad"))
    return out.withColumn("mad_std", F.col("mad") * MAD_TO_STD)


def histogram_percentile(pixels: DataFrame, q: float, low: float, high: float, bins: int, keys: list[str] = KEYS) -> DataFrame:
    """Percentile by linear interpolation inside the bin of an even histogram."""
    width = (high - low) / bins
    place = F.least(F.greatest(F.floor((F.col("value") - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = pixels.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bin")
    every = Window.partitionBy(*keys)
    edges = counts.withColumn("end", F.sum("n").over(upto)).withColumn("want", F.sum("n").over(every) * (q / 100.0))
    hit = edges.where("end >= want").groupBy(*keys).agg(F.min_by(F.struct("bin", "n", "end", "want"), "bin").alias("h"))
    inside = (F.col("h.want") - (F.col("h.end") - F.col("h.n"))) / F.col("h.n")
    return hit.select(*keys, (F.lit(low) + (F.col("h.bin") + inside) * width).alias("percentile"))


def _by_image(pixels: DataFrame, stats: DataFrame, value: Column) -> DataFrame:
    return pixels.join(stats, KEYS).select(*[c for c in pixels.columns if c != "value"], value.alias("value"))


def fit_normalizer(pixels: DataFrame, method: str, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """``image_id, shift, scale, floor, ceiling`` to normalise with; scale 0 where values are constant."""
    nothing = F.lit(None).cast("double")
    if method in ("minmax", "zscore", "unit_norm"):
        m = moments(pixels)
        shift, scale = {
            "minmax": (F.col("least"), F.col("most") - F.col("least")),
            "zscore": (F.col("mean"), F.col("std")),
            "unit_norm": (F.lit(0.0), F.col("l2_norm")),
        }[method]
        return m.select("image_id", shift.alias("shift"), scale.alias("scale"), nothing.alias("floor"), nothing.alias("ceiling"))
    if method == "percentile":
        p = pixels.groupBy("image_id").agg(F.percentile("value", F.array(F.lit(low / 100), F.lit(high / 100))).alias("p"))
        return p.select("image_id", F.col("p")[0].alias("shift"), (F.col("p")[1] - F.col("p")[0]).alias("scale"), F.col("p")[0].alias("floor"), F.col("p")[1].alias("ceiling"))
    if method == "mad":
        return median_deviation(pixels).select("image_id", F.col("median").alias("shift"), F.col("mad_std").alias("scale"), nothing.alias("floor"), nothing.alias("ceiling"))
    raise ValueError(f"unknown method {method!r}")


def normalize(pixels: DataFrame, method: str, fitted: DataFrame | None = None, epsilon: float = 1e-10) -> DataFrame:
    v = F.least(F.greatest(F.col("value"), F.col("floor")), F.col("ceiling"))
    out = F.when(F.col("scale") < epsilon, F.lit(0.0)).otherwise((v - F.col("shift")) / F.col("scale"))
    return _by_image(pixels, fitted if fitted is not None else fit_normalizer(pixels, method), out)


# Contrast


def unit_clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def finite_or(x: Column, value: Column, otherwise: float = 1.0) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(otherwise)).otherwise(value)


def linear_stretch(x: Column, low: float, high: float) -> Column:
    low, high = min(low, high), max(low, high)
    return finite_or(x, F.lit(0.0) if low == high else unit_clip((x - low) / (high - low)))


def log_stretch(x: Column, low: float, high: float) -> Column:
    inner = F.lit(0.0) if low == high else F.log2((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / (high - low) + 1)
    return finite_or(x, F.when(x == 0, F.lit(0.0)).otherwise(inner))


def gamma_correction(x: Column, gamma: float) -> Column:
    return F.pow(unit_clip(x), F.lit(1 / gamma))


def sigmoid_stretch(x: Column, center: float = 0.5, slope: float = 10.0) -> Column:
    y0, y1 = 1 / (1 + math.exp(slope * center)), 1 / (1 + math.exp(-slope * (1 - center)))
    return unit_clip((1 / (1 + F.exp((unit_clip(x) - center) * -slope)) - y0) / (y1 - y0))


def nrl_stretch(pixels: DataFrame, knee: float = 0.8, percentile: float = 99.0) -> DataFrame:
    """Linear up to the percentile, logarithmic above it."""
    s = pixels.groupBy("image_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.percentile("value", F.lit(percentile / 100)).alias("turn"))
    v, lo, hi, turn = F.col("value"), F.col("lo"), F.col("hi"), F.col("turn")
    below = F.when(turn > lo, unit_clip(unit_clip((v - lo) / (turn - lo)) * knee)).otherwise(0.0)
    above = F.when(turn == hi, F.lit(knee)).otherwise(F.log2((v - turn) / (hi - turn) + 1) * (1 - knee) + knee)
    return _by_image(pixels, s, F.when(lo == hi, F.lit(0.0)).otherwise(unit_clip(F.when(v <= turn, below).otherwise(above))))


def density_stretch(pixels: DataFrame, dmin: float = 30.0, mmult: float = 40.0, eps: float = 1e-5, compress: bool = False) -> DataFrame:
    """Logarithmic density of the amplitude, anchored at its mean; ``compress`` halves the top."""
    s = pixels.groupBy("image_id").agg(F.avg(F.abs("value")).alias("mean"))
    low = F.col("mean") * 0.8
    slope = (255.0 - dmin) / F.log10(F.lit(mmult))
    density = slope * F.log10(F.greatest(F.abs("value"), F.lit(eps))) + (F.lit(dmin) - slope * F.log10(low))
    n = density / 255
    if compress:
        n = F.when(n > 0.5, (n + 0.5) * 0.5).otherwise(n)
    return _by_image(pixels, s, F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(unit_clip(n)))


#: Presets of :func:`density_stretch`.
DENSITY_PRESETS = {"brighter": {"dmin": 60.0}, "darker": {"dmin": 0.0}, "high_contrast": {"mmult": 4.0}}


def graze_stretch(pixels: DataFrame, graze_deg: float, slope_deg: float, weighting: str = "uniform", eps: float = 1e-5) -> DataFrame:
    """Density between cutoffs that depend on the graze angle and on how far mean and median lie apart.

    The constants are fixed values of the published remap.
    """
    tilt = math.sin(math.radians(graze_deg)) / math.cos(math.radians(slope_deg))
    c3, w1, w2, w5 = {"uniform": 1.23}.get(weighting, 1.33), 0.77, -0.0422, -1.95
    s = pixels.groupBy("image_id").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"))
    first = F.col("median") * w1
    last = F.col("median") * F.pow(F.lit(10.0), F.log10(F.col("median") / F.col("mean")) * w5 + (c3 + w2 * tilt))
    spread = F.log10(last / first) * 20
    beta = F.pow(F.lit(10.0), F.when(spread < 24, spread - 24).when(spread > 40, spread - 40).otherwise(0.0) / 40)
    low, high = first * beta, last / beta
    slope = F.lit(255.0 - 30.0) / F.log10(high / low)
    density = slope * F.log10(F.greatest(F.abs("value"), F.lit(eps))) + (F.lit(30.0) - slope * F.log10(low))
    return _by_image(pixels, s, unit_clip(density / 255))


def recommended_contrast(modality: Column) -> Column:
    """Name of the contrast operator that suits a kind of imagery; unknown kinds get the safe one."""
    return F.when(F.upper(modality) == "SAR", "brighter").when(F.upper(modality) == "EO", "gamma").otherwise("percentile")


def histogram_equalize(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Values mapped through the cumulative histogram, linear between bin centres."""
    s = pixels.groupBy("image_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counts = pixels.join(s, "image_id").groupBy("image_id", place.alias("bin")).agg(F.count("*").alias("n"), F.first("total").alias("total"))
    whole = s.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(counts.select("image_id", "bin", "n"), ["image_id", "bin"], "left")
    upto = Window.partitionBy("image_id").orderBy("bin")
    cdf = whole.withColumn("c", F.sum(F.coalesce("n", F.lit(0))).over(upto)).withColumn("next", F.lead("c").over(upto))
    cdf = cdf.select("image_id", F.col("bin").alias("k"), "c", F.coalesce("next", "c").alias("next"))
    # Place among the bin centres; outside the first and last one the ends hold.
    at = (F.col("value") - F.col("lo")) / width - 0.5
    placed = pixels.join(s, "image_id").withColumn("at", F.least(F.greatest(at, F.lit(0.0)), F.lit(float(bins - 1)))).withColumn("k", F.least(F.floor("at"), F.lit(bins - 1)).cast("int"))
    out = placed.join(cdf, ["image_id", "k"])
    return out.select("image_id", "row", "col", ((F.col("c") + (F.col("next") - F.col("c")) * (F.col("at") - F.col("k"))) / F.col("total")).alias("value"))


def to_decibels(x: Column, floor: float = 1e-10) -> Column:
    return F.log10(F.greatest(F.abs(x), F.lit(floor))) * 20


def clip_cast(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))).cast("int")


# Tiles


def tile_positions(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """``image_id, row0, col0`` of full tiles; the last ones are moved back inside.

    ``images(image_id, rows, cols)``.
    """

    def starts(n: str) -> Column:
        steps = F.greatest(F.ceil((F.col(n) - tile) / stride), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), steps), lambda k: F.greatest(F.least(k * stride, F.col(n) - tile), F.lit(0)).cast("int"))

    return images.withColumn("row0", F.explode(starts("rows"))).withColumn("col0", F.explode(starts("cols"))).select("image_id", "row0", "col0")


def partition_positions(images: DataFrame, tile: int) -> DataFrame:
    """``image_id, row0, row1, col0, col1`` of disjoint tiles; edge tiles are short."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1, F.lit(tile)))
    out = images.withColumn("row0", axis("rows")).withColumn("col0", axis("cols"))
    return out.select("image_id", "row0", F.least(F.col("row0") + tile, "rows").alias("row1"), "col0", F.least(F.col("col0") + tile, "cols").alias("col1"))


def chip_at_point(row: Column, col: Column, height: int, width: int, rows: int, cols: int) -> list[Column]:
    """Window around a point, rounded half to even and moved inside the image."""

    def axis(x: Column, size: int, n: int) -> tuple[Column, Column]:
        size = min(size, n)
        start = F.greatest(F.least(F.rint(x).cast("int") - size // 2, F.lit(n - size)), F.lit(0))
        return start, start + size

    (r0, r1), (c0, c1) = axis(row, height, rows), axis(col, width, cols)
    return [r0.alias("row0"), r1.alias("row1"), c0.alias("col0"), c1.alias("col1")]


# Neighbourhoods


def mirrored(pixels: DataFrame, axis: str, half: int) -> DataFrame:
    """Adds ``half`` mirrored pixels beyond both ends of every line along ``axis``.

    The border pixel itself is repeated first (d c b a | a b c d | d c b a). ``_in``
    marks the pixels of the image.
    """
    other = [c for c in ("row", "col") if c != axis]
    n = F.max(axis).over(Window.partitionBy("image_id", *other)) + 1
    at = F.col(axis)
    places = F.array(
        F.struct(at.alias("at"), F.lit(True).alias("own")),
        F.when(at < half, F.struct((-1 - at).alias("at"), F.lit(False).alias("own"))),
        F.when(F.col("_n") - 1 - at < half, F.struct((2 * F.col("_n") - 1 - at).alias("at"), F.lit(False).alias("own"))),
    )
    out = pixels.withColumn("_n", n).withColumn("_p", F.explode(F.filter(places, lambda p: p.isNotNull())))
    return out.withColumn(axis, F.col("_p.at")).withColumn("_in", F.col("_p.own")).drop("_p", "_n")


def windowed(pixels: DataFrame, half: int, fold: Callable[[Column], Column], columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """A separable window function over (2 half + 1) squared pixels."""
    out = pixels
    for axis, other in (("col", "row"), ("row", "col")):
        w = Window.partitionBy("image_id", other).orderBy(axis).rowsBetween(-half, half)
        padded = mirrored(out, axis, half)
        out = padded.withColumns({c: fold(F.col(c)).over(w) for c in columns}).where("_in").drop("_in")
    return out


def box_mean(pixels: DataFrame, half: int, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    return windowed(pixels, half, F.avg, columns)


def erode(pixels: DataFrame, half: int) -> DataFrame:
    return windowed(pixels, half, F.min)


def dilate(pixels: DataFrame, half: int) -> DataFrame:
    return windowed(pixels, half, F.max)


def local_moments(pixels: DataFrame, half: int) -> DataFrame:
    """Adds ``mean`` and ``variance`` of each pixel's window."""
    out = box_mean(pixels.withColumn("mean", F.col("value")).withColumn("square", F.col("value") * F.col("value")), half, ("mean", "square"))
    return out.withColumn("variance", F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).drop("square")


def local_std(pixels: DataFrame, half: int) -> DataFrame:
    return local_moments(pixels, half).withColumn("value", F.sqrt("variance")).drop("mean", "variance")


def gaussian(pixels: DataFrame, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian with radius ``int(truncate * sigma + 0.5)``."""
    half = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    weights = [w / sum(raw) for w in raw]
    out = pixels
    for axis, other in (("col", "row"), ("row", "col")):
        w = Window.partitionBy("image_id", other).orderBy(axis)
        padded = mirrored(out, axis, half)
        total = sum((F.lag("value", -k).over(w) if k < 0 else F.lead("value", k).over(w) if k else F.col("value")) * weights[k + half] for k in range(-half, half + 1))
        out = padded.withColumn("_s", total).where("_in").drop("_in", "value").withColumnRenamed("_s", "value")
    return out


def median_filter(pixels: DataFrame, half: int) -> DataFrame:
    return ranked(pixels, half, (2 * half + 1) ** 2 // 2)


def looks(pixels: DataFrame, half: int, share: float = 0.1) -> DataFrame:
    """``image_id, enl``: one over the mean of the lowest tenth of squared variation; 1 where that is 0.

    Values are counted in bins of their logarithm; only the bin in which the tenth ends is
    ranked, and not even that where all its values are equal.
    """
    moments_ = local_moments(pixels, half)
    ci2 = F.when(F.col("mean") != 0, F.col("variance") / (F.col("mean") * F.col("mean")))
    place = F.when(F.col("ci2") > 0, F.floor(F.log2("ci2") * 256)).otherwise(F.lit(-(1 << 20)).cast("long"))
    rows = moments_.select("image_id", ci2.alias("ci2")).where("ci2 is not null").withColumn("bin", place)
    bins = rows.groupBy("image_id", "bin").agg(F.count("*").alias("n"), F.sum("ci2").alias("s"), F.min("ci2").alias("lo"), F.max("ci2").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy("image_id").orderBy("bin"))
    most = F.greatest(F.floor(F.sum("n").over(Window.partitionBy("image_id")) * share), F.lit(1))
    bins = bins.withColumns({"left": most - (upto - F.col("n")), "k": most}).where("left > 0")
    parts = bins.where("n <= left or lo = hi").select("image_id", "k", F.when(F.col("n") <= F.col("left"), F.col("s")).otherwise(F.col("lo") * F.col("left")).alias("s"))
    last = bins.where("n > left and lo < hi").select("image_id", "bin", "left", "k")
    inside = rows.join(last, ["image_id", "bin"]).withColumn("r", F.row_number().over(Window.partitionBy("image_id").orderBy("ci2"))).where("r <= left")
    sums = parts.union(inside.select("image_id", "k", F.col("ci2").alias("s"))).groupBy("image_id").agg(F.max("k").alias("k"), F.sum("s").alias("s"))
    return sums.select("image_id", F.when(F.col("s") > 0, F.col("k") / F.col("s")).otherwise(1.0).alias("enl"))


def lee_filter(pixels: DataFrame, half: int, enl: float) -> DataFrame:
    """Mean plus the share of the deviation that noise of ``enl`` looks does not explain."""
    ci2 = F.col("variance") / (F.col("mean") * F.col("mean"))
    weight = F.when(F.col("variance") > 0, unit_clip(1 - (1.0 / enl) / ci2)).otherwise(0.0)
    out = local_moments(pixels, half)
    return out.withColumn("value", F.col("mean") + weight * (F.col("value") - F.col("mean"))).drop("mean", "variance")


def enhanced_lee_filter(pixels: DataFrame, half: int, enl: float, damping: float = 1.0) -> DataFrame:
    """Mean in even areas, the pixel at points, an exponential mixture between."""
    cu, cmax = 1 / math.sqrt(enl), math.sqrt(1 + 2 / enl)
    ci = F.sqrt("variance") / F.abs("mean")
    w = F.exp((ci - cu) / (cmax - ci) * -damping)
    mixed = F.col("mean") * w + F.col("value") * (1 - w)
    out = F.when(ci <= cu, F.col("mean")).when(ci >= cmax, F.col("value")).otherwise(mixed)
    return local_moments(pixels, half).withColumn("value", F.coalesce(out, "mean")).drop("mean", "variance")


# Detection


def false_alarm_factor(pfa: float, guard: int, training: int, assumption: str) -> float:
    """Factor on the standard deviation (gaussian) or on the mean (exponential)."""
    if assumption == "gaussian":
        return NormalDist().inv_cdf(1 - pfa)
    n = (2 * training + 1) ** 2 - (2 * guard + 1) ** 2
    term = pfa ** (-1 / n)
    if term > 1e15:
        raise ValueError("the false-alarm rate is too small for so few training cells")
    return n * (term - 1)


def annular_stats(pixels: DataFrame, guard: int, training: int) -> DataFrame:
    """Adds ``mean`` and ``std`` of the ring between the guard and the training square."""
    outer, inner = (2 * training + 1) ** 2, (2 * guard + 1) ** 2
    base = pixels.withColumns({"o1": F.col("value"), "o2": F.col("value") * F.col("value"), "i1": F.col("value"), "i2": F.col("value") * F.col("value")})
    out = windowed(windowed(base, training, F.sum, ("o1", "o2")), guard, F.sum, ("i1", "i2"))
    n = outer - inner
    mean, square = (F.col("o1") - F.col("i1")) / n, (F.col("o2") - F.col("i2")) / n
    return out.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).drop("o1", "o2", "i1", "i2")


def quadrant_means(pixels: DataFrame, guard: int, training: int) -> DataFrame:
    """Adds ``q1..q4``, the means of the squares of ``training - guard`` pixels in the corners.

    Each is a separable mean over a window that lies off the pixel, so again only lines move.
    """
    out = pixels
    for k, (down, across) in enumerate([(-1, -1), (-1, 1), (1, -1), (1, 1)], 1):
        name = f"q{k}"
        out = out.withColumn(name, F.col("value"))
        for axis, other, side in (("col", "row", across), ("row", "col", down)):
            span = (-training, -guard - 1) if side < 0 else (guard + 1, training)
            w = Window.partitionBy("image_id", other).orderBy(axis).rowsBetween(*span)
            out = mirrored(out, axis, training).withColumn(name, F.avg(name).over(w)).where("_in").drop("_in")
    return out


def cell_averaging(pixels: DataFrame, guard: int = 1, training: int = 3, pfa: float = 1e-3, assumption: str = "gaussian") -> DataFrame:
    """Adds ``threshold`` and ``hit``: values above what the ring lets expect."""
    k = false_alarm_factor(pfa, guard, training, assumption)
    limit = F.col("mean") + F.col("std") * k if assumption == "gaussian" else F.col("mean") * k
    return annular_stats(pixels, guard, training).withColumn("threshold", limit).withColumn("hit", F.col("value") > F.col("threshold"))


def ordered_statistic(pixels: DataFrame, training: int = 3, percent: float = 75.0, factor: float = 2.0) -> DataFrame:
    """Adds ``threshold`` and ``hit`` with a percentile of the whole window as background."""
    n = (2 * training + 1) ** 2
    rank = min(int(n * percent / 100), n - 1)
    limits = ranked(pixels, training, rank, "threshold").withColumn("threshold", F.col("threshold") * factor)
    return pixels.join(limits, ["image_id", "row", "col"]).withColumn("hit", F.col("value") > F.col("threshold"))


def quadrant_detector(pixels: DataFrame, which: str, guard: int = 1, training: int = 3, pfa: float = 1e-3, assumption: str = "gaussian") -> DataFrame:
    """Adds ``threshold`` and ``hit`` with the greatest (``go``) or smallest (``so``) corner mean as background.

    The spread is that of the whole ring.
    """
    k = false_alarm_factor(pfa, guard, training, assumption)
    ring = annular_stats(pixels, guard, training).drop("mean")
    fold = {"go": F.greatest, "so": F.least}[which]
    out = quadrant_means(ring, guard, training).withColumn("mean", fold("q1", "q2", "q3", "q4")).drop("q1", "q2", "q3", "q4")
    limit = F.col("mean") + F.col("std") * k if assumption == "gaussian" else F.col("mean") * k
    return out.withColumn("threshold", limit).withColumn("hit", F.col("value") > F.col("threshold"))


def _pixel(row: Column, col: Column) -> Column:
    """A pixel's number: images in order, then 2**20 lines of 2**20 pixels; exact in 38 digits."""
    whole = F.col("image_id").cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(14,0)")
    return (whole + (row.cast("long") * (1 << 20) + col.cast("long")).cast("decimal(20,0)")).cast("decimal(38,0)")


def pixel_edges(hits: DataFrame) -> DataFrame:
    """``a, b`` between hits that touch along a row or a column; ids join image, row and column."""
    node = _pixel
    right = Window.partitionBy("image_id", "row").orderBy("col")
    down = Window.partitionBy("image_id", "col").orderBy("row")
    rows = hits.withColumn("a", node(F.col("row"), F.col("col")))
    across = rows.withColumn("n", F.lead("col").over(right)).where("n = col + 1").select("a", node(F.col("row"), F.col("n")).alias("b"))
    along = rows.withColumn("n", F.lead("row").over(down)).where("n = row + 1").select("a", node(F.col("n"), F.col("col")).alias("b"))
    return across.union(along)


def label_hits(hits: DataFrame, workspace) -> DataFrame:
    """Adds ``label``, the smallest pixel id of each 4-connected component."""
    from orbweave.plans.components import connected_components

    found = connected_components(pixel_edges(hits), workspace)
    return hits.withColumn("_id", _pixel(F.col("row"), F.col("col"))).join(found, F.col("_id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "_id")).drop("_id", "node", "component")


def detections(labelled: DataFrame, min_pixels: int = 1) -> DataFrame:
    """Extent, size and mean of each component."""
    out = labelled.groupBy("image_id", "label").agg(
        F.count("*").alias("pixels"), F.avg("value").alias("mean_value"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("row", "col")]
    )
    return out.where(F.col("pixels") >= min_pixels)


# Resampling


def bilinear(pixels: DataFrame, wanted: DataFrame, nodata: float = 0.0) -> DataFrame:
    """Values at ``wanted(image_id, id, r, c)``; ``nodata`` where a neighbour is missing.

    The four neighbours are four equality joins folded into one by exploding the wanted
    points, so only pixels that are asked for move.
    """
    r0, c0 = F.floor("r").cast("int"), F.floor("c").cast("int")
    fr, fc = F.col("r") - r0, F.col("c") - c0
    corner = lambda i, j, w: F.struct((r0 + i).alias("row"), (c0 + j).alias("col"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))
    asked = wanted.withColumn("k", F.explode(four)).select("image_id", "id", F.col("k.row").alias("row"), F.col("k.col").alias("col"), F.col("k.w").alias("w"))
    met = asked.join(pixels, ["image_id", "row", "col"], "left").groupBy("image_id", "id").agg(F.count("value").alias("n"), F.sum(F.col("w") * F.col("value")).alias("v"))
    return met.select("image_id", "id", F.when(F.col("n") == 4, F.col("v")).otherwise(F.lit(nodata)).alias("value"))


def nearest(pixels: DataFrame, wanted: DataFrame, nodata: float = 0.0) -> DataFrame:
    asked = wanted.select("image_id", "id", F.floor(F.col("r") + 0.5).cast("int").alias("row"), F.floor(F.col("c") + 0.5).cast("int").alias("col"))
    return asked.join(pixels, ["image_id", "row", "col"], "left").select("image_id", "id", F.coalesce("value", F.lit(nodata)).alias("value"))
