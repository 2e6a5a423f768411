"""One-dimensional resampling, look statistics and polynomial evaluation.

Samples are rows ``key, t, value``. A wanted position meets its neighbours through the
rank of the sample before it, so resampling is a window and a few equality joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def polynomial(coefficients: Column, x: Column) -> Column:
    """Ascending coefficients by Horner's rule."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)


def polynomial_2d(rows: Column, x: Column, y: Column) -> Column:
    """``sum c[i][j] x**i y**j`` for an array of arrays."""
    return polynomial(F.transform(rows, lambda r: polynomial(r, y)), x)


def derivative(coefficients: Column) -> Column:
    """Coefficients of the derivative, ascending."""
    pairs = F.transform(coefficients, lambda c, i: c * i)
    return F.slice(pairs, 2, F.greatest(F.size(coefficients) - 1, F.lit(0)))


def sinc(x: Column) -> Column:
    p = x * math.pi
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(p) / p)


def lanczos_weight(a: int) -> Callable[[Column], Column]:
    return lambda d: F.when(F.abs(d) < a, sinc(d) * sinc(d / a)).otherwise(0.0)


def linear_weight(d: Column) -> Column:
    return F.greatest(1 - F.abs(d), F.lit(0.0))


def resample(samples: DataFrame, wanted: DataFrame, half: int, weight: Callable[[Column], Column]) -> DataFrame:
    """Weighted neighbours of ``wanted(key, id, x)``; 0 outside the samples.

    ``weight`` takes the distance in samples: each position has a fraction between the
    sample before and the one after it.
    """
    order = Window.partitionBy("key").orderBy("t")
    ranked = samples.select("key", "t", "value", F.row_number().over(order).alias("r"), F.lead("t").over(order).alias("next"))
    both = ranked.select("key", "t", F.lit(None).cast("long").alias("id"), "r", "next").union(
        wanted.select("key", F.col("x").alias("t"), "id", F.lit(None).cast("int"), F.lit(None).cast("double"))
    )
    # The last sample at or before each wanted position, in one sorted pass per key.
    upto = Window.partitionBy("key").orderBy("t", F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda e: F.last(F.when(F.col("id").isNull(), e), True).over(upto)
    found = both.withColumns({"b": last(F.struct("r", "t", "next"))}).where("id is not null")
    where = F.col("b.r") - 1 + F.coalesce((F.col("t") - F.col("b.t")) / (F.col("b.next") - F.col("b.t")), F.lit(0.0))
    inside = F.col("b").isNotNull() & (F.col("b.next").isNotNull() | (F.col("t") == F.col("b.t")))
    placed = found.select("key", "id", F.when(inside, where).alias("p"))
    taps = placed.withColumn("k", F.explode(F.sequence(F.floor("p") - half + 1, F.floor("p") + half)))
    met = taps.join(ranked.select("key", (F.col("r") - 1).cast("long").alias("k"), "value"), ["key", "k"])
    w = weight(F.col("p") - F.col("k"))
    sums = met.groupBy("key", "id").agg(F.sum(w * F.col("value")).alias("s"), F.sum(w).alias("w"))
    value = F.when((F.col("w") != 0) & F.col("w").isNotNull(), F.col("s") / F.col("w")).otherwise(0.0)
    return placed.select("key", "id").join(sums, ["key", "id"], "left").select("key", "id", value.alias("value"))


def lagrange_weight(half: int) -> Callable[[Column], Column]:
    """Weight of a tap in the polynomial through ``2 * half`` even taps.

    With the tap at distance ``d`` the position's fraction is ``d`` modulo 1; every other
    tap contributes one factor.
    """

    def weight(d: Column) -> Column:
        place = F.floor(d)
        fraction = d - place
        out = F.lit(0.0)
        # The tap lies ``place`` samples before the position: at offset -place of the window.
        for k in range(-half + 1, half + 1):
            term = F.lit(1.0)
            for j in range(-half + 1, half + 1):
                if j != k:
                    term = term * (fraction - j) / float(k - j)
            out = F.when(place == -k, term).otherwise(out)
        return out

    return weight


def dominance(looks: DataFrame, width: int) -> DataFrame:
    """``key, dominance, entropy`` of ``looks(key, look, power)``.

    Dominance is the largest share of ``width`` neighbouring looks; entropy is natural.
    """
    order = Window.partitionBy("key").orderBy("look").rowsBetween(0, width - 1)
    ahead = Window.partitionBy("key").orderBy("look")
    rows = looks.withColumns({"s": F.sum("power").over(order), "full": F.lead("look", width - 1).over(ahead), "total": F.sum("power").over(Window.partitionBy("key"))})
    p = F.col("power") / F.col("total")
    return rows.groupBy("key").agg(
        F.max(F.when(F.col("full").isNotNull(), F.col("s") / F.col("total"))).alias("dominance"), F.sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0)).alias("entropy")
    )


def doppler_centroid(lines: DataFrame, interval: float) -> DataFrame:
    """Frequency of the mean phase step between neighbouring samples of ``key, t, re, im``."""
    order = Window.partitionBy("key").orderBy("t")
    rows = lines.withColumns({"pr": F.lag("re").over(order), "pi": F.lag("im").over(order)}).where("pr is not null")
    re = F.sum(F.col("re") * F.col("pr") + F.col("im") * F.col("pi"))
    im = F.sum(F.col("im") * F.col("pr") - F.col("re") * F.col("pi"))
    return rows.groupBy("key").agg((F.atan2(im, re) / (2 * math.pi * interval)).alias("hz"))


def subbands(samples: int, looks: int, overlap: float, support: float = 1.0) -> list[tuple[int, int]]:
    """First and end bin of each look's band in a centred spectrum."""
    whole = samples * support
    width = whole / (1 + (looks - 1) * (1 - overlap))
    start = (samples - whole) / 2
    out = []
    for k in range(looks):
        a = round(start + k * width * (1 - overlap))
        out.append((a, min(a + round(width), samples)))
    return out


def sublooks(lines: DataFrame, looks: int, overlap: float = 0.0) -> DataFrame:
    """``key, look, power``: energy of each spectral band of the lines ``key, t, re, im``.

    A line is one group of bounded length; its spectrum needs all of it at once.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        spectrum = np.fft.fftshift(np.fft.fft(pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()))
        rows = [(pdf["key"].iloc[0], k, float((np.abs(spectrum[a:b]) ** 2).sum() / len(spectrum))) for k, (a, b) in enumerate(subbands(len(spectrum), looks, overlap))]
        return pd.DataFrame(rows, columns=["key", "look", "power"])

    return lines.groupBy("key").applyInPandas(run, "key long, look int, power double")


def eigen_entropy(matrices: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy (base 3), mean alpha and anisotropy of 3 x 3 coherency matrices.

    Columns as ``polarimetry.outer`` names them; batches are solved at once.
    """
    names = ["t11", "t12_re", "t12_im", "t13_re", "t13_im", "t22", "t23_re", "t23_im", "t33"]
    kinds = dict(matrices.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["entropy double", "alpha double", "anisotropy double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = pdf[names].to_numpy()
            m = np.zeros((len(v), 3, 3), complex)
            m[:, 0, 0], m[:, 1, 1], m[:, 2, 2] = v[:, 0], v[:, 5], v[:, 8]
            for (i, j), k in {(0, 1): 1, (0, 2): 3, (1, 2): 6}.items():
                m[:, i, j] = v[:, k] + 1j * v[:, k + 1]
                m[:, j, i] = m[:, i, j].conj()
            values, vectors = np.linalg.eigh(m)
            values, vectors = np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]
            total = values.sum(axis=1, keepdims=True)
            p = values / np.where(total > 0, total, 1)
            entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(axis=1) / np.log(3)
            alpha = np.degrees((p * np.arccos(np.clip(np.abs(vectors[:, 0, :]), 0, 1))).sum(axis=1))
            low = values[:, 1] + values[:, 2]
            yield pdf[keys].assign(entropy=np.clip(entropy, 0, 1), alpha=alpha, anisotropy=(values[:, 1] - values[:, 2]) / np.where(low > 0, low, 1))

    return matrices.select(*keys, *names).mapInPandas(run, schema)


def kaiser_weight(half: int, beta: float = 5.0) -> Callable[[Column], Column]:
    """Sinc under a Kaiser window; the Bessel function is its power series."""
    terms = [1 / math.factorial(k) ** 2 for k in range(24)]
    whole = sum(c * (beta * beta / 4) ** k for k, c in enumerate(terms))

    def weight(d: Column) -> Column:
        y = F.greatest(1 - d * d / float(half * half), F.lit(0.0)) * (beta * beta / 4)
        series = F.lit(0.0)
        for c in reversed(terms):
            series = series * y + c
        return F.when(F.abs(d) <= half, sinc(d) * series / whole).otherwise(0.0)

    return weight


def phased_weight(half: int, phases: int = 128, beta: float = 5.0) -> Callable[[Column], Column]:
    """Taps from a bank of ``phases`` Kaiser filters, blended between the two nearest phases."""
    exact = kaiser_weight(half, beta)

    def weight(d: Column) -> Column:
        place = d * phases
        low = F.floor(place)
        part = place - low
        return exact(low / phases) * (1 - part) + exact((low + 1) / phases) * part

    return weight


def farrow_weight(half: int, degree: int = 3) -> Callable[[Column], Column]:
    """Lagrange taps whose dependence on the fraction is a fitted polynomial, by Horner's rule.

    The fit of degree ``2 * half - 1`` or more is exact; a lower one is the least-squares
    fit over even fractions.
    """
    at = np.linspace(0, 1, max(4 * degree, 20) + 1)
    places = range(-half + 1, half + 1)
    taps = np.stack([np.prod([(at - j) / (k - j) for j in places if j != k], axis=0) for k in places], 1)
    fitted = np.linalg.lstsq(np.vander(at, degree + 1), taps, rcond=None)[0]

    def weight(d: Column) -> Column:
        before = F.floor(d)
        fraction, out = d - before, F.lit(0.0)
        for k, powers in zip(places, fitted.T, strict=True):
            term = F.lit(0.0)
            for c in powers:
                term = term * fraction + float(c)
            out = F.when(before == -k, term).otherwise(out)
        return out

    return weight


def multilook_images(images: DataFrame, looks: tuple[int, int], overlap: float = 0.0) -> DataFrame:
    """``image_id, look, row, col, re, im``: sub-images of the parts of each image's spectrum.

    The centred spectrum of rows and columns is cut into ``looks``; the part (m, n) has the
    number ``m * looks[1] + n`` and keeps the image's size. A task holds one image.
    """
    kinds = dict(images.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        z = np.zeros((rows, cols), complex)
        z[pdf["row"], pdf["col"]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        spectrum = np.fft.fftshift(np.fft.fft2(z))
        parts = []
        for m, (r0, r1) in enumerate(subbands(rows, looks[0], overlap)):
            for n, (c0, c1) in enumerate(subbands(cols, looks[1], overlap)):
                one = np.zeros_like(spectrum)
                one[r0:r1, c0:c1] = spectrum[r0:r1, c0:c1]
                at = np.fft.ifft2(np.fft.ifftshift(one))[pdf["row"], pdf["col"]]
                parts.append(pdf[["image_id", "row", "col"]].assign(look=m * looks[1] + n, re=at.real, im=at.imag))
        return pd.concat(parts)

    schema = f"image_id {kinds['image_id']}, look int, row {kinds['row']}, col {kinds['col']}, re double, im double"
    return images.groupBy("image_id").applyInPandas(run, schema)


def thiran_coefficients(delay: float, order: int) -> np.ndarray:
    """Denominator of the all-pass filter that delays by ``delay`` samples with a flat group delay."""
    if delay < order - 0.5:
        raise ValueError(f"a filter of order {order} needs a delay of at least {order - 0.5}")
    out = [1.0]
    for k in range(1, order + 1):
        parts = [(delay - order + n) / (delay - order + k + n) for n in range(order + 1)]
        out.append((-1) ** k * math.comb(order, k) * math.prod(parts))
    return np.array(out)


def thiran_delay(samples: DataFrame, delay: float, order: int = 3) -> DataFrame:
    """``key, t, value`` delayed by a fraction of a sample and whole samples.

    The filter feeds back, so a signal is one group; it is zero before its first sample.
    """
    whole = max(int(math.floor(delay)) - order, 0)
    a = thiran_coefficients(delay - whole, order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = pdf["value"].to_numpy(float)
        fed = np.convolve(x, a[::-1])[: len(x)]
        y = np.zeros(len(x))
        for n in range(len(x)):
            back = y[max(0, n - order) : n][::-1]
            y[n] = fed[n] - back @ a[1 : len(back) + 1]
        return pdf[["key", "t"]].assign(value=np.concatenate([np.zeros(whole), y])[: len(x)])

    kinds = dict(samples.dtypes)
    return samples.select("key", "t", "value").groupBy("key").applyInPandas(run, f"key {kinds['key']}, t {kinds['t']}, value double")


def spline_values(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through four or more points whose third derivative is even at the second and last but one."""
    h = np.diff(t)
    slope = np.diff(y) / h
    n = len(t)
    right = 6 * np.diff(slope)
    low, mid, high = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    mid[0] += h[0] * (1 + h[0] / h[1])
    high[0] -= h[0] ** 2 / h[1]
    mid[-1] += h[-1] * (1 + h[-1] / h[-2])
    low[-1] -= h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        right[i] -= f * right[i - 1]
    m = np.zeros(n)
    m[n - 2] = right[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (right[i] - high[i] * m[i + 2]) / mid[i]
    m[0] = m[1] + (m[1] - m[2]) * h[0] / h[1]
    m[-1] = m[-2] + (m[-2] - m[-3]) * h[-1] / h[-2]
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b = (t[i + 1] - at) / h[i], (at - t[i]) / h[i]
    return a * y[i] + b * y[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h[i] ** 2 / 6


def orbit_spline(vectors: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """``key, t`` and ``columns`` at the wanted times of each track ``vectors(key, t, ...)``.

    Positions, velocities and quaternions alike; tracks of fewer than four vectors raise.
    A track is one group: its curve depends on all of its vectors.
    """

    def run(track: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return asked.assign(**{c: [] for c in columns})[["key", "t", *columns]]
        if len(track) < 4:
            raise ValueError("a track needs at least four vectors")
        track = track.sort_values("t")
        return asked[["key", "t"]].assign(**{c: spline_values(track["t"].to_numpy(float), track[c].to_numpy(float), asked["t"].to_numpy(float)) for c in columns})

    kinds = dict(vectors.dtypes)
    schema = f"key {kinds['key']}, t double, " + ", ".join(f"{c} double" for c in columns)
    return vectors.groupBy("key").cogroup(wanted.select("key", F.col("t").cast("double")).groupBy("key")).applyInPandas(run, schema)
