"""Where things lie in an image or on a grid: chips, sub-grids, apertures and overlaps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions.geo import WGS84_A, WGS84_B, WGS84_F, affine, enu_to_geodetic, num
from orbweave.functions.utm import utm_inverse


def snapped(start: Column, width: Column | int, whole: Column) -> tuple[Column, Column]:
    """Begin and end of a span moved inside ``0..whole``; wider than that, it is all of it."""
    width = F.least(F.lit(width) if isinstance(width, int) else width, whole)
    begin = F.greatest(F.least(start, whole - width), F.lit(0))
    return begin, begin + width


def chip_positions(images: DataFrame, height: int, width: int) -> DataFrame:
    """``image_id, row0, row1, col0, col1`` of the chips that cover ``images(image_id, rows, cols)``."""
    if height <= 0 or width <= 0:
        raise ValueError("chips need a positive size")
    cells = images.withColumn("r", F.explode(F.expr(f"sequence(0, rows - 1, {height})"))).withColumn("c", F.explode(F.expr(f"sequence(0, cols - 1, {width})")))
    (r0, r1), (c0, c1) = snapped(F.col("r"), height, F.col("rows")), snapped(F.col("c"), width, F.col("cols"))
    return cells.select("image_id", r0.alias("row0"), r1.alias("row1"), c0.alias("col0"), c1.alias("col1"))


def inside_image(row, col, rows, cols, tolerance: float = 0.5) -> Column:
    """Whether a pixel place lies in the image, or at most ``tolerance`` beyond its edge."""
    row, col = num(row), num(col)
    return (row >= -tolerance) & (row < num(rows) + tolerance) & (col >= -tolerance) & (col < num(cols) + tolerance)


def chip_geolocation(row, col, row0, col0, transform: tuple[float, ...]) -> tuple[Column, Column]:
    """Map place of a chip's pixel by the geolocation of the whole image."""
    return affine(num(row) + num(row0), num(col) + num(col0), transform)


def no_geolocation() -> tuple[Column, Column]:
    """The geolocation of an image that has none."""
    return F.lit(None).cast("double"), F.lit(None).cast("double")


def overlap_of_moved(moving_rows, moving_cols, fixed_rows, fixed_cols, m: tuple[Column, ...]) -> Column:
    """Share of the fixed image under the moved one's corners' extent, clipped to the image.

    ``m`` maps (row, col) by ``row' = m0 row + m1 col + m2, col' = m3 row + m4 col + m5``.
    """
    last_r, last_c = num(moving_rows) - 1, num(moving_cols) - 1
    corners = [(F.lit(0.0), F.lit(0.0)), (F.lit(0.0), last_c), (last_r, last_c), (last_r, F.lit(0.0))]
    hold = lambda x, n: F.greatest(F.least(x, num(n) - 1.0), F.lit(0.0))
    rows = [hold(m[0] * r + m[1] * c + m[2], fixed_rows) for r, c in corners]
    cols = [hold(m[3] * r + m[4] * c + m[5], fixed_cols) for r, c in corners]
    area = (F.greatest(*rows) - F.least(*rows)) * (F.greatest(*cols) - F.least(*cols))
    return F.least(area / (num(fixed_rows) * num(fixed_cols)), F.lit(1.0))


def utm_grid(spark: SparkSession, zone: int, north: bool, west: float, east: float, south: float, top: float, pixel: float) -> DataFrame:
    """``row, col, easting, northing, lat, lon`` from the north-west corner."""
    if not 1 <= zone <= 60 or pixel <= 0 or east <= west or top <= south:
        raise ValueError("a grid needs a zone of 1..60, a positive pixel and extent")
    rows, cols = round((top - south) / pixel), round((east - west) / pixel)
    cell = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    out = cell.withColumns({"easting": F.lit(west) + F.col("col") * pixel, "northing": F.lit(top) - F.col("row") * pixel})
    lat, lon = utm_inverse("easting", "northing", F.lit(zone), F.lit(north))
    return out.withColumns({"lat": lat, "lon": lon})


def sub_grid(grid: DataFrame, row0: int, col0: int, row1: int, col1: int) -> DataFrame:
    """The part of a grid between two corners, numbered from its own corner."""
    if not (0 <= row0 < row1 and 0 <= col0 < col1):
        raise ValueError("the part is empty or begins outside the grid")
    part = grid.where(F.col("row").between(row0, row1 - 1) & F.col("col").between(col0, col1 - 1))
    return part.withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def subapertures(collections: DataFrame, overlap: float = 0.0) -> DataFrame:
    """``id, part, begin, end`` of overlapping pulse windows of ``collections(id, pulses, length)``.

    The last window takes in a rest that is shorter than a stride.
    """
    stride = F.greatest(F.floor(F.col("length") * (1.0 - overlap)).cast("long"), F.lit(1))
    rows = collections.withColumn("stride", stride)
    # Windows begin at every stride until one ends less than a stride before the last pulse.
    rest = F.col("pulses") - F.col("length")
    last = F.when(rest <= 0, 0).otherwise(F.greatest(F.floor(rest / F.col("stride")), F.lit(0)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    begin = F.col("part") * F.col("stride")
    end = F.least(begin + F.col("length"), F.col("pulses"))
    whole = F.when((F.col("pulses") - end > 0) & (F.col("pulses") - end < F.col("stride")), F.col("pulses")).otherwise(end)
    return rows.select("id", "part", begin.alias("begin"), whole.alias("end")).where("begin < end")


def subaperture_length(phase_error, wavelength, slant_range, speed, interval, least: int = 16) -> Column:
    """Pulses over which the quadratic phase error at the edges stays below ``phase_error``."""
    half = F.sqrt(num(phase_error) * 2 * num(wavelength) * num(slant_range) / (math.pi * num(speed) * num(speed)))
    return F.greatest(F.floor(half * 2 / num(interval)), F.lit(least)).cast("long")


def geojson_polygon(ring: Column) -> Column:
    """GeoJSON text of a polygon from an open or closed ring ``array<array<double>>``; null for none."""
    closed = F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    points = F.transform(closed, lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, lambda v: v.cast("string")), ","), F.lit("]")))
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(points, ","), F.lit("]]}"))
    return F.when(F.size(ring) > 0, text)


def detection_feature(geometry: Column, properties: dict[str, Column]) -> Column:
    """One GeoJSON feature as text; null properties are written as null."""
    named = F.to_json(F.struct(*[c.alias(k) for k, c in properties.items()]), {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), named, F.lit("}"))


def quantized_ci2(signals: DataFrame) -> DataFrame:
    """Adds ``scale, q_re, q_im``: signed bytes of the samples ``key, re, im`` of each vector."""
    most = signals.groupBy("key").agg(F.max(F.greatest(F.abs("re"), F.abs("im"))).alias("most"))
    scale = F.when(F.col("most") == 0, 1.0).otherwise(F.col("most") / 127.0)
    byte = lambda c: F.greatest(F.least(F.rint(F.col(c) / F.col("scale")), F.lit(127.0)), F.lit(-128.0)).cast("int")
    out = signals.join(most.select("key", scale.alias("scale")), "key")
    return out.withColumns({"q_re": byte("re"), "q_im": byte("im")})


def ellipse_perimeter(ellipses: DataFrame, n: int) -> DataFrame:
    """``id, k, lat, lon`` along ``ellipses(id, lat, lon, major, minor, bearing)``, in the tangent plane."""
    t = F.col("k") * (2 * math.pi / n)
    rows = ellipses.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a, b, rot = F.col("major") * F.cos(t), F.col("minor") * F.sin(t), F.radians("bearing")
    lat, lon, _ = enu_to_geodetic(a * F.sin(rot) + b * F.cos(rot), a * F.cos(rot) - b * F.sin(rot), F.lit(0.0), F.col("lat"), F.col("lon"), F.lit(0.0))
    return rows.select("id", "k", lat.alias("plat"), lon.alias("plon")).withColumnsRenamed({"plat": "lat", "plon": "lon"})


# Geodesics on the ellipsoid


def geodesic_distance(lat1, lon1, lat2, lon2, rounds: int = 60) -> np.ndarray:
    """Metres between places of arrays, by Vincenty's iteration; antipodal pairs give nan."""
    u1, u2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(np.asarray(x, float)))) for x in (lat1, lat2))
    span = np.radians(np.asarray(lon2, float) - np.asarray(lon1, float))
    lam, s1, c1, s2, c2 = span, np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    for _ in range(rounds):
        sin_lam, cos_lam = np.sin(lam), np.cos(lam)
        a = np.hypot(c2 * sin_lam, c1 * s2 - s1 * c2 * cos_lam)
        b = s1 * s2 + c1 * c2 * cos_lam
        sigma = np.arctan2(a, b)
        sin_az = np.where(a > 0, c1 * c2 * sin_lam / np.where(a > 0, a, 1), 0.0)
        cos2 = 1 - sin_az**2
        mid = np.where(cos2 > 1e-15, b - 2 * s1 * s2 / np.where(cos2 > 1e-15, cos2, 1), 0.0)
        c = WGS84_F / 16 * cos2 * (4 + WGS84_F * (4 - 3 * cos2))
        after = span + (1 - c) * WGS84_F * sin_az * (sigma + c * a * (mid + c * b * (2 * mid**2 - 1)))
        done = np.abs(after - lam) < 1e-13
        lam = after
        if (done | np.isnan(after)).all():
            break
    k = cos2 * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    turn = small * a * (mid + small / 4 * (b * (2 * mid**2 - 1) - small / 6 * mid * (4 * a**2 - 3) * (4 * mid**2 - 3)))
    return np.where(done | (a == 0), WGS84_B * big * (sigma - turn), np.nan)


def geodesic_place(lat, lon, bearing, metres, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude reached from places along bearings in degrees."""
    az, u = np.radians(np.asarray(bearing, float)), np.arctan((1 - WGS84_F) * np.tan(np.radians(np.asarray(lat, float))))
    start = np.arctan2(np.tan(u), np.cos(az))
    sin_az = np.cos(u) * np.sin(az)
    cos2 = 1 - sin_az**2
    k = cos2 * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    metres = np.asarray(metres, float)
    sigma = metres / (WGS84_B * big)
    for _ in range(rounds):
        mid = np.cos(2 * start + sigma)
        s, c = np.sin(sigma), np.cos(sigma)
        after = metres / (WGS84_B * big) + small * s * (mid + small / 4 * (c * (2 * mid**2 - 1) - small / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        done = np.abs(after - sigma) < 1e-13
        sigma = after
        if (done | np.isnan(after)).all():
            break
    s, c, mid = np.sin(sigma), np.cos(sigma), np.cos(2 * start + sigma)
    lat2 = np.arctan2(np.sin(u) * c + np.cos(u) * s * np.cos(az), (1 - WGS84_F) * np.hypot(sin_az, np.sin(u) * s - np.cos(u) * c * np.cos(az)))
    lam = np.arctan2(s * np.sin(az), np.cos(u) * c - np.sin(u) * s * np.cos(az))
    d = WGS84_F / 16 * cos2 * (4 + WGS84_F * (4 - 3 * cos2))
    lon2 = np.asarray(lon, float) + np.degrees(lam - (1 - d) * WGS84_F * sin_az * (sigma + d * s * (mid + d * c * (2 * mid**2 - 1))))
    return np.degrees(lat2), np.mod(lon2 + 180, 360) - 180


def circle_contains(places: DataFrame, lat0: float, lon0: float, radius_m: float) -> DataFrame:
    """Adds ``metres`` and ``inside`` to ``places(id, lat, lon)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            metres = geodesic_distance(lat0, lon0, pdf["lat"], pdf["lon"])
            yield pdf.assign(metres=metres, inside=metres <= radius_m)

    kinds = dict(places.dtypes)
    return places.select("id", "lat", "lon").mapInPandas(run, f"id {kinds['id']}, lat double, lon double, metres double, inside boolean")


def arc_points(arcs: DataFrame, n: int) -> DataFrame:
    """``id, k, lat, lon`` along ``arcs(id, lat, lon, radius, begin, end)``, clockwise, ends included.

    Equal bearings mean a whole circle.
    """
    if n < 2:
        raise ValueError("an arc needs two points")
    sweep = F.pmod(F.col("end") - F.col("begin"), F.lit(360.0))
    sweep = F.when(sweep == 0, 360.0).otherwise(sweep)
    rows = arcs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("bearing", F.pmod(F.col("begin") + sweep * F.col("k") / (n - 1), F.lit(360.0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lat, lon = geodesic_place(pdf["lat"], pdf["lon"], pdf["bearing"], pdf["radius"])
            yield pdf[["id", "k"]].assign(lat=lat, lon=lon)

    return rows.select("id", "k", "lat", "lon", "radius", "bearing").mapInPandas(run, f"id {dict(arcs.dtypes)['id']}, k int, lat double, lon double")


def two_focus_ellipse(ellipses: DataFrame, n: int, steps: int = 60) -> DataFrame:
    """``id, k, lat, lon`` where the distances to two places add up to ``total`` metres.

    ``ellipses(id, lat1, lon1, lat2, lon2, total)``; along each bearing from the middle the
    place is found in a bracket that false position (Illinois) narrows, or halving where
    that gains too little, for all rows of a batch at once; settled rows drop out. The rows
    are dealt out first: a file's split holds minutes of work.
    """
    tasks = int(ellipses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ellipses.repartition(tasks).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b, c, d = (pdf[x].to_numpy(float) for x in ("lat1", "lon1", "lat2", "lon2"))
            between = geodesic_distance(a, b, c, d)
            y = np.radians(d - b)
            bearing = np.degrees(np.arctan2(np.sin(y) * np.cos(np.radians(c)), np.cos(np.radians(a)) * np.sin(np.radians(c)) - np.sin(np.radians(a)) * np.cos(np.radians(c)) * np.cos(y)))
            lat0, lon0 = geodesic_place(a, b, bearing, between / 2)
            turn, total = pdf["k"].to_numpy() * (360.0 / n), pdf["total"].to_numpy(float)
            place = lambda i, r: geodesic_place(lat0[i], lon0[i], turn[i], r)  # noqa: B023, E731

            def excess(i: np.ndarray, r: np.ndarray) -> np.ndarray:
                lat, lon = place(i, r)  # noqa: B023
                return geodesic_distance(a[i], b[i], lat, lon) + geodesic_distance(c[i], d[i], lat, lon) - total[i]  # noqa: B023

            radius = _crossing(excess, (total + between) / 2 * 1.01, steps)
            lat, lon = place(np.arange(len(pdf)), radius)
            yield pdf[["id", "k"]].assign(lat=lat, lon=lon)

    return rows.select("id", "k", "lat1", "lon1", "lat2", "lon2", "total").mapInPandas(run, f"id {dict(ellipses.dtypes)['id']}, k int, lat double, lon double")


def _crossing(excess, top: np.ndarray, steps: int, tolerance: float = 1e-7) -> np.ndarray:
    """Where ``excess(rows, x)`` turns positive in [0, top], to the tolerance or ``steps`` halvings.

    A value that is not positive or no number lifts the lower end, as in bisection.
    """
    low, high = np.zeros(len(top)), np.array(top, float)
    every = np.arange(len(top))
    f_low, f_high, side = excess(every, low), excess(every, high), np.zeros(len(top))
    out, i = np.empty(len(top)), every
    for step in range(2 * steps):
        wide = ~(high - low <= tolerance)
        out[i[~wide]] = ((low + high) / 2)[~wide]
        i, low, high, f_low, f_high, side = (x[wide] for x in (i, low, high, f_low, f_high, side))
        if not len(i):
            return out
        middle, width = (low + high) / 2, high - low
        with np.errstate(all="ignore"):
            guess = low - f_low * width / (f_high - f_low)
        sound = (f_low <= 0) & (f_high > 0) & (guess > low) & (guess < high) & (step % 4 != 3)
        # A little past the guess, so that a good one closes the bracket from both sides.
        nudge = np.where(side > 0, -1, 1) * tolerance / 4
        r = np.where(sound, np.clip(guess + nudge, low + tolerance / 8, high - tolerance / 8), middle)
        f = excess(i, r)
        over = f > 0
        f_low = np.where(over, np.where(side > 0, f_low / 2, f_low), f)
        f_high = np.where(over, f, np.where(side < 0, f_high / 2, f_high))
        low, high, side = np.where(over, low, r), np.where(over, r, high), np.where(over, 1, -1)
    out[i] = (low + high) / 2
    return out
