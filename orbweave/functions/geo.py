"""Column expressions of geodesy: everything stays inside generated code."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sphere and of the WGS-84 ellipsoid.
SPHERE_M = 6_371_000.0
WGS84_A = 6378137.0
WGS84_B = 6356752.314245179
WGS84_F = 1 / 298.257223563
WGS84_E2 = 2 * WGS84_F - WGS84_F * WGS84_F


def num(x: Column | float | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres on the sphere."""
    lat1, lon1, lat2, lon2 = map(num, (lat1, lon1, lat2, lon2))
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * SPHERE_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def boxes_meet(aw, as_, ae, an, bw, bs, be, bn) -> Column:
    """Closed rectangles share a point."""
    aw, as_, ae, an, bw, bs, be, bn = map(num, (aw, as_, ae, an, bw, bs, be, bn))
    return (aw <= be) & (bw <= ae) & (as_ <= bn) & (bs <= an)


def overlap_fraction(aw, as_, ae, an, bw, bs, be, bn, degenerate: float = 1.0) -> Column:
    """Shared area over the smaller area, at most 1; a smaller area of 0 divides by ``degenerate``."""
    aw, as_, ae, an, bw, bs, be, bn = map(num, (aw, as_, ae, an, bw, bs, be, bn))
    w = F.greatest(F.lit(0.0), F.least(ae, be) - F.greatest(aw, bw))
    h = F.greatest(F.lit(0.0), F.least(an, bn) - F.greatest(as_, bs))
    small = F.least((ae - aw) * (an - as_), (be - bw) * (bn - bs))
    return F.least(F.lit(1.0), w * h / F.when(small > 0, small).otherwise(F.lit(degenerate)))


def unit_sphere(lat, lon) -> tuple[Column, Column, Column]:
    lat, lon = F.radians(num(lat)), F.radians(num(lon))
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def geodetic_to_ecef(lat, lon, h) -> tuple[Column, Column, Column]:
    lat, lon, h = F.radians(num(lat)), F.radians(num(lon)), num(h)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return (n + h) * F.cos(lat) * F.cos(lon), (n + h) * F.cos(lat) * F.sin(lon), (n * (1 - WGS84_E2) + h) * F.sin(lat)


def ecef_to_geodetic(x, y, z) -> tuple[Column, Column, Column]:
    """Bowring's closed form; at the poles height is measured along the axis."""
    x, y, z = map(num, (x, y, z))
    p = F.sqrt(x * x + y * y)
    e2 = (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    theta = F.atan2(z * WGS84_A, p * WGS84_B)
    s, c = F.sin(theta), F.cos(theta)
    lat = F.atan2(z + e2 * WGS84_B * s * s * s, p - WGS84_E2 * WGS84_A * c * c * c)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    h = F.when(p > 1e-3, p / F.cos(lat) - n).otherwise(F.abs(z) - WGS84_B)
    return F.degrees(lat), F.degrees(F.atan2(y, x)), h


def _enu_rotation(lat0, lon0):
    lat, lon = F.radians(num(lat0)), F.radians(num(lon0))
    return F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)


def geodetic_to_enu(lat, lon, h, lat0, lon0, h0) -> tuple[Column, Column, Column]:
    x, y, z = geodetic_to_ecef(lat, lon, h)
    x0, y0, z0 = geodetic_to_ecef(lat0, lon0, h0)
    sp, cp, sl, cl = _enu_rotation(lat0, lon0)
    dx, dy, dz = x - x0, y - y0, z - z0
    return -sl * dx + cl * dy, -sp * cl * dx - sp * sl * dy + cp * dz, cp * cl * dx + cp * sl * dy + sp * dz


def enu_to_geodetic(e, n, u, lat0, lon0, h0) -> tuple[Column, Column, Column]:
    e, n, u = map(num, (e, n, u))
    x0, y0, z0 = geodetic_to_ecef(lat0, lon0, h0)
    sp, cp, sl, cl = _enu_rotation(lat0, lon0)
    return ecef_to_geodetic(x0 - sl * e - sp * cl * n + cp * cl * u, y0 + cl * e - sp * sl * n + cp * sl * u, z0 + cp * n + sp * u)


def meters_per_degree(lat) -> tuple[Column, Column]:
    """Metres in a degree of latitude and of longitude on the ellipsoid."""
    lat = F.radians(num(lat))
    w = 1 - WGS84_E2 * F.sin(lat) * F.sin(lat)
    degree = F.radians(F.lit(1.0))
    return WGS84_A * (1 - WGS84_E2) / (w * F.sqrt(w)) * degree, WGS84_A / F.sqrt(w) * F.cos(lat) * degree


def ellipsoid_normal(x, y, z) -> tuple[Column, Column, Column]:
    x, y, z = map(num, (x, y, z))
    nx, ny, nz = x / WGS84_A**2, y / WGS84_A**2, z / WGS84_B**2
    size = F.sqrt(nx * nx + ny * ny + nz * nz)
    return nx / size, ny / size, nz / size


def normalize_lon(deg) -> Column:
    """Longitude wrapped to (-180, 180]."""
    x = F.pmod(num(deg), F.lit(360.0))
    return F.when(x > 180, x - 360).otherwise(x)


def web_mercator(lat, lon) -> tuple[Column, Column]:
    lat, lon = num(lat), num(lon)
    return WGS84_A * F.radians(lon), WGS84_A * F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483)))


def web_mercator_inverse(x, y) -> tuple[Column, Column]:
    x, y = num(x), num(y)
    return F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - F.lit(1.5707963267948966)), F.degrees(x / WGS84_A)


def affine(row, col, t: tuple[float, ...]) -> tuple[Column, Column]:
    """Pixel to map by (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    row, col = num(row), num(col)
    a, b, c, d, e, f = t
    return col * a + row * b + c, col * d + row * e + f


def affine_inverse(x, y, t: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = t
    # From the decimals as written and rounded once: a determinant that is off by its last
    # digit moves whole pixels to either side of their own line.
    det = float(Fraction(repr(float(a))) * Fraction(repr(float(e))) - Fraction(repr(float(b))) * Fraction(repr(float(d))))
    x, y = num(x) - c, num(y) - f
    return (y * a - x * d) / det, (x * e - y * b) / det


def homography(x, y, h: tuple[float, ...]) -> tuple[Column, Column]:
    """Projective map by a row-major 3 x 3 matrix."""
    x, y = num(x), num(y)
    w = x * h[6] + y * h[7] + h[8]
    return (x * h[0] + y * h[1] + h[2]) / w, (x * h[3] + y * h[4] + h[5]) / w


def dms_degrees(text) -> Column:
    """Degrees of ``ddmmssH`` or ``dddmmssH``, H one of NSEW."""
    pattern = r"^(\d{2,3})(\d{2})(\d{2})([NSEW])$"
    part = [F.regexp_extract(num(text), pattern, k) for k in (1, 2, 3, 4)]
    size = part[0].cast("double") + part[1].cast("double") / 60 + part[2].cast("double") / 3600
    return F.when(part[3].isin("S", "W"), -size).otherwise(size)
