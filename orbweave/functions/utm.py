"""Universal Transverse Mercator and military grid references as column expressions.

The projection is Krueger's series in the third flattening to the fourth order, which is
exact to a millimetre within a zone, as one generated expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbweave.functions.geo import WGS84_A, WGS84_F, num

SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0
N = WGS84_F / (2 - WGS84_F)
#: Radius of the rectifying sphere.
RADIUS = WGS84_A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Coefficients of Krueger's series, forward, inverse and for the latitude.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)

#: Letters of the 100 km squares by zone and row, and the least northing of a band.
SQUARE_COLUMNS = ("ABCDEFGH", "JKLMNPQR", "STUVWXYZ")
SQUARE_ROWS = "ABCDEFGHJKLMNPQRSTUV"
BANDS = "CDEFGHJKLMNPQRSTUVWX"
BAND_NORTHING = (11, 20, 28, 37, 46, 55, 64, 73, 82, 91, 0, 8, 17, 26, 35, 44, 53, 62, 70, 79)
REFERENCE = r"^(\d{2})([C-HJ-NP-X])([A-HJ-NP-Z])([A-HJ-NP-V])(\d{5})(\d{5})$"


def zone_of(lon) -> Column:
    return F.least(F.floor((num(lon) + 180) / 6).cast("int") + 1, F.lit(60))


def central_meridian(zone) -> Column:
    return num(zone) * 6 - 183


def utm_forward(lat, lon, zone, north) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, dl = F.radians(num(lat)), F.radians(num(lon) - central_meridian(zone))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.atanh(s * ECCENTRICITY) * ECCENTRICITY)
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(t * t + 1))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        y = y + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
    return x * (SCALE * RADIUS) + FALSE_EASTING, y * (SCALE * RADIUS) + F.when(north, 0.0).otherwise(FALSE_NORTHING)


def utm_inverse(easting, northing, zone, north) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    xi = (num(northing) - F.when(north, 0.0).otherwise(FALSE_NORTHING)) / (SCALE * RADIUS)
    eta = (num(easting) - FALSE_EASTING) / (SCALE * RADIUS)
    a, b = xi, eta
    for j, c in enumerate(BETA, 1):
        a = a - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * c
        b = b - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * c
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(DELTA, 1):
        lat = lat + F.sin(chi * (2 * j)) * c
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(b), F.cos(a))) + central_meridian(zone)


def mgrs_to_utm(text) -> tuple[Column, Column, Column, Column]:
    """Zone, whether north, easting and northing of ``zzBJKeeeeennnnn``; null where it is not one."""
    part = lambda k: F.regexp_extract(num(text), REFERENCE, k)
    zone = F.when(part(1) != "", part(1).cast("int"))
    zone = F.when(zone.between(1, 60), zone)
    letters = F.element_at(F.array(*map(F.lit, SQUARE_COLUMNS)), ((zone - 1) % 3 + 1).cast("int"))
    column = F.instr(letters, part(3))
    row = F.instr(F.lit(SQUARE_ROWS), part(4)) - 1
    row = F.when(zone % 2 == 0, F.pmod(row - 5, F.lit(20))).otherwise(row)
    band = F.instr(F.lit(BANDS), part(2))
    least = F.element_at(F.array(*map(F.lit, BAND_NORTHING)), F.greatest(band, F.lit(1)).cast("int"))
    # Rows repeat every 2,000 km; the first repeat at or above the band's least northing counts.
    hundreds = row + F.greatest(F.ceil((least - row) / 20), F.lit(0)) * 20
    legal = zone.isNotNull() & (column > 0)
    easting = F.when(legal, column * 100_000.0 + part(5).cast("double"))
    northing = F.when(legal, hundreds * 100_000.0 + part(6).cast("double"))
    return zone, part(2) >= "N", easting, northing


def blocka_corner(text) -> tuple[Column, Column]:
    """Latitude and longitude of ``ddmmss.ssXdddmmss.ssY`` or signed decimal degrees, else null."""
    dms = r"^(\d{2})(\d{2})(\d{2}\.\d{2})([NS])(\d{3})(\d{2})(\d{2}\.\d{2})([EW])$"
    decimal = r"^([+-]\d{2}\.\d{6})([+-]\d{3}\.\d{6})$"
    s = F.trim(num(text))
    get = lambda k: F.regexp_extract(s, dms, k)
    out = []
    for first, negative, k in ((1, "S", 1), (5, "W", 2)):
        size = get(first).cast("double") + get(first + 1).cast("double") / 60 + get(first + 2).cast("double") / 3600
        signed = F.when(get(first + 3) == negative, -size).otherwise(size)
        out.append(F.when(s.rlike(dms), signed).when(s.rlike(decimal), F.regexp_extract(s, decimal, k).cast("double")))
    return out[0], out[1]
