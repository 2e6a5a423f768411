"""Queries on places: map grids, references, chips, apertures, shapes on the ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orbweave.functions import utm as U
from orbweave.operators import catalog as C
from orbweave.operators import placing as L
from orbweave.queries.common import r6
from orbweave.queries.raster import dims
from orbweave.queries.vector import EP2, LOC, A, BB, E2
from orbweave.sources.views import BOXES, CPIXELS, PIXELS, PRODUCTS, SCANS, load, oracle


def located(spark, sf):
    """Scans within the latitudes that the projection serves."""
    return C.located(load(spark, sf, SCANS)).where("lat between -80 and 84")


def utm_forward(spark, sf):
    s = located(spark, sf)
    e, n = U.utm_forward("lat", "lon", U.zone_of("lon"), F.col("lat") >= 0)
    return s.select("filepath", U.zone_of("lon").alias("zone"), r6(e, 3).alias("easting"), r6(n, 3).alias("northing"))


def utm_inverse(spark, sf):
    b = load(spark, sf, BOXES)
    lat, lon = U.utm_inverse(F.col("minx") * 100 + 200_000, F.col("miny") * 1500, (F.col("seq") % 60 + 1).cast("int"), F.col("seq") % 2 == 0)
    return b.select("id", r6(lat).alias("lat"), r6(lon).alias("lon"))


def references(spark, sf):
    b = load(spark, sf, BOXES)
    pick = lambda text, k: F.substring(F.lit(text), (k % len(text) + 1).cast("int"), 1)
    digits = lambda c: F.lpad(F.floor(F.col(c) * 17).cast("long").cast("string"), 5, "0")
    text = F.concat(F.lpad((F.col("seq") % 62).cast("string"), 2, "0"), pick(U.BANDS, F.col("seq")), pick("ABCDEFGHJKLMNPQRSTUVWXYZ", F.col("seq") * 5), pick(U.SQUARE_ROWS, F.col("seq") * 3), digits("minx"), digits("miny"))
    return b.select("id", text.alias("text"))


def parse_mgrs(spark, sf):
    """Grid references to zone, easting and northing; illegal squares and zones give null."""
    zone, north, e, n = U.mgrs_to_utm("text")
    return references(spark, sf).select("id", "text", e.alias("easting"), n.alias("northing"), F.when(e.isNotNull(), north).alias("north"))


def mgrs_to_latlon(spark, sf):
    zone, north, e, n = U.mgrs_to_utm("text")
    r = references(spark, sf).select("id", zone.alias("zone"), north.alias("north"), e.alias("e"), n.alias("n")).where("e is not null")
    lat, lon = U.utm_inverse("e", "n", "zone", F.col("north"))
    return r.select("id", r6(lat).alias("lat"), r6(lon).alias("lon"))


def parse_blocka(spark, sf):
    b = load(spark, sf, BOXES)
    two = lambda k, w=2: F.lpad((F.col("seq") % k).cast("string"), w, "0")
    dms = F.concat(two(90), two(60), two(59), F.lit(".25"), F.when(F.col("seq") % 2 == 0, "N").otherwise("S"), two(180, 3), two(58), two(57), F.lit(".50"), F.when(F.col("seq") % 3 == 0, "E").otherwise("W"))
    decimal = F.concat(F.when(F.col("seq") % 2 == 0, "+").otherwise("-"), two(90), F.lit(".125000"), F.when(F.col("seq") % 3 == 0, "+").otherwise("-"), two(180, 3), F.lit(".500000"))
    text = F.when(F.col("seq") % 5 == 0, F.lit("nowhere")).when(F.col("seq") % 5 < 3, dms).otherwise(decimal)
    lat, lon = U.blocka_corner("text")
    return b.select("id", text.alias("text")).select("id", "text", r6(lat).alias("lat"), r6(lon).alias("lon"))


def grid_utm(spark, sf):
    return L.utm_grid(spark, 32, True, 500_000.0, 504_000.0, 5_200_000.0, 5_203_000.0, 100.0).select("row", "col", r6("lat").alias("lat"), r6("lon").alias("lon"))


def grid_sub(spark, sf):
    from orbweave.operators.features import geographic_grid

    return L.sub_grid(geographic_grid(spark, -10.0, 20.0, 30.0, 75.0, 0.5, 0.75), 10, 5, 40, 30).select("row", "col", "lat", "lon")


def chip_positions(spark, sf):
    return L.chip_positions(dims(spark, sf), 24, 40)


def geo_chip(spark, sf):
    lat, lon = L.chip_geolocation("row", "col", F.col("image_id") * 7, F.lit(12), (0.001, 0.0002, 10.0, -0.0001, -0.001, 50.0))
    return load(spark, sf, PIXELS).select("image_id", "row", "col", r6(lat).alias("x"), r6(lon).alias("y"))


def geo_none(spark, sf):
    lat, lon = L.no_geolocation()
    return load(spark, sf, PIXELS).select("image_id", "row", "col", lat.alias("lat"), lon.alias("lon"))


def pixel_bounds(spark, sf):
    inside = L.inside_image(F.col("minx") - 0.75, F.col("miny") - 0.25, F.lit(2400), F.lit(3100))
    return load(spark, sf, BOXES).select("id", inside.alias("inside"))


def coreg_overlap(spark, sf):
    b = load(spark, sf, BOXES)
    m = (F.lit(0.9), F.lit(0.1), F.col("minx") / 10 - 200, F.lit(-0.1), F.lit(0.95), F.col("miny") / 10 - 250)
    return b.select("id", r6(L.overlap_of_moved(F.lit(500), F.lit(400), F.lit(450), F.lit(600), m), 4).alias("share"))


def sar_subapertures(spark, sf):
    b = load(spark, sf, BOXES).select("id", (F.col("seq") % 900 + 1).alias("pulses"), (F.col("seq") % 97 + 20).alias("length"))
    return L.subapertures(b, 0.25)


def sar_subaperture_length(spark, sf):
    n = L.subaperture_length(F.lit(math.pi / 4), F.lit(0.031), F.col("val") * 700, F.col("minx") + 7000, F.lit(0.0002))
    return load(spark, sf, BOXES).select("id", n.alias("pulses"))


def quantize_ci2(spark, sf):
    s = load(spark, sf, CPIXELS).select(F.col("row").alias("key"), "col", F.col("hh_re").alias("re"), F.col("hh_im").alias("im"))
    return L.quantized_ci2(s).select("key", "col", r6("scale").alias("scale"), "q_re", "q_im")


def catalog_geometry(spark, sf):
    """Corner lists as closed GeoJSON rings."""
    p = load(spark, sf, PRODUCTS)
    ring = F.from_json(F.when(F.col("id") % 4 != 0, F.col("corner_coords")), "array<array<int>>")
    return p.select("id", L.geojson_polygon(ring).alias("geometry"))


def detections_geojson(spark, sf):
    b = load(spark, sf, BOXES)
    corner = lambda x, y: F.array(F.col(x).cast("long"), F.col(y).cast("long"))
    ring = F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"))
    return b.select("id", L.detection_feature(L.geojson_polygon(ring), {"id": F.col("id"), "seq": F.col("seq"), "brand": F.when(F.col("seq") % 3 != 0, F.col("brand"))}).alias("feature"))


def shape_ellipse_perimeter(spark, sf):
    s = located(spark, sf).where("lat between -70 and 70").select(F.col("filepath").alias("id"), "lat", "lon", (F.col("seq") % 50 * 100 + 500.0).alias("major"), (F.col("seq") % 20 * 10 + 200.0).alias("minor"), (F.col("seq") % 180).cast("double").alias("bearing"))
    return L.ellipse_perimeter(s, 8).select("id", "k", r6("lat").alias("lat"), r6("lon").alias("lon"))


def circle_contains(spark, sf):
    s = located(spark, sf).select(F.col("filepath").alias("id"), "lat", "lon").where("not (abs(lat + 10) < 0.6 and abs(lon + 160) < 0.6)")
    return L.circle_contains(s, 10.0, 20.0, 4_000_000.0).select("id", r6("metres", 2).alias("metres"), "inside")


def shape_arc(spark, sf):
    s = located(spark, sf).select(F.col("filepath").alias("id"), "lat", "lon", (F.col("seq") % 90 * 1000 + 5000.0).alias("radius"), (F.col("seq") % 360).cast("double").alias("begin"), (F.col("seq") * 7 % 360).cast("double").alias("end"))
    return L.arc_points(s, 9).select("id", "k", r6("lat").alias("lat"), r6("lon").alias("lon"))


def shape_two_focus(spark, sf):
    s = located(spark, sf).where("lat between -60 and 60").select(F.col("filepath").alias("id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), (F.col("lat") + 0.2).alias("lat2"), (F.col("lon") + 0.3).alias("lon2"), F.lit(90_000.0).alias("total"))
    return L.two_focus_ellipse(s, 6).select("id", "k", r6("lat").alias("lat"), r6("lon").alias("lon"))


B, P, SC = {"boxes": BOXES}, {"px": PIXELS}, {"scans": SCANS}
KA = f"{U.SCALE * U.RADIUS!r}::DOUBLE"


def forward_sql(lat: str, lon: str, zone: str) -> str:
    """Select list ``x, y`` without false origin from a row that has phi and dl."""
    x = " + ".join(["eta", *[f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(U.ALPHA, 1)]])
    y = " + ".join(["xi", *[f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(U.ALPHA, 1)]])
    ecc = f"{U.ECCENTRICITY!r}::DOUBLE"
    return f"p AS (SELECT *, radians({lat}) AS phi, radians({lon} - ({zone} * 6 - 183)) AS dl FROM z), q AS (SELECT *, sinh(atanh(sin(phi)) - {ecc} * atanh({ecc} * sin(phi))) AS t FROM p), r AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM q), u AS (SELECT *, {KA} * ({x}) AS x, {KA} * ({y}) AS y FROM r)"


def inverse_sql(easting: str, northing: str, zone: str, north: str, src: str) -> str:
    """CTEs ending in ``v`` with lat and lon in degrees."""
    a = "".join(f" - {c!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(U.BETA, 1))
    b = "".join(f" - {c!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(U.BETA, 1))
    d = "".join(f" + {c!r}::DOUBLE * sin({2 * j} * chi)" for j, c in enumerate(U.DELTA, 1))
    return (
        f"p AS (SELECT *, ({northing} - CASE WHEN {north} THEN 0 ELSE 10000000 END) / {KA} AS xi, ({easting} - 500000) / {KA} AS eta FROM {src}), q AS (SELECT *, xi{a} AS a, eta{b} AS b FROM p), "
        f"r AS (SELECT *, asin(sin(a) / cosh(b)) AS chi FROM q), v AS (SELECT *, degrees(chi{d}) AS lat, degrees(atan2(sinh(b), cos(a))) + ({zone} * 6 - 183) AS lon FROM r)"
    )


REF = "t AS (SELECT id, concat(lpad((seq % 62)::VARCHAR, 2, '0'), substr('CDEFGHJKLMNPQRSTUVWX', (seq % 20 + 1)::INT, 1), substr('ABCDEFGHJKLMNPQRSTUVWXYZ', (seq * 5 % 24 + 1)::INT, 1), substr('ABCDEFGHJKLMNPQRSTUV', (seq * 3 % 20 + 1)::INT, 1), lpad(floor(minx * 17)::BIGINT::VARCHAR, 5, '0'), lpad(floor(miny * 17)::BIGINT::VARCHAR, 5, '0')) AS text FROM boxes), m AS (SELECT *, substr(text, 1, 2)::INT AS zone, substr(text, 3, 1) AS band, strpos(CASE (substr(text, 1, 2)::INT - 1) % 3 WHEN 0 THEN 'ABCDEFGH' WHEN 1 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END, substr(text, 4, 1)) AS c, strpos('ABCDEFGHJKLMNPQRSTUV', substr(text, 5, 1)) - 1 AS r0 FROM t), w AS (SELECT *, CASE WHEN zone % 2 = 0 THEN (r0 + 15) % 20 ELSE r0 END AS r1, ([11, 20, 28, 37, 46, 55, 64, 73, 82, 91, 0, 8, 17, 26, 35, 44, 53, 62, 70, 79])[strpos('CDEFGHJKLMNPQRSTUVWX', band)] AS least FROM m), k AS (SELECT id, text, zone, band >= 'N' AS north, CASE WHEN zone BETWEEN 1 AND 60 AND c > 0 THEN c * 100000.0::DOUBLE + substr(text, 6, 5)::DOUBLE END AS e, CASE WHEN zone BETWEEN 1 AND 60 AND c > 0 THEN (r1 + 20 * greatest(ceil((least - r1) / 20.0), 0)) * 100000.0::DOUBLE + substr(text, 11, 5)::DOUBLE END AS n FROM w)"
MOVE = [(f"({r} * 0.9::DOUBLE + {c} * 0.1::DOUBLE + minx / 10 - 200)", f"({r} * -0.1::DOUBLE + {c} * 0.95::DOUBLE + miny / 10 - 250)") for r, c in ((0, 0), (0, 399), (499, 399), (499, 0))]
HR = [f"greatest(least({r}, 449), 0)" for r, _ in MOVE]
HC = [f"greatest(least({c}, 599), 0)" for _, c in MOVE]
TO_GEO = (
    f"t1 AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {A}, sqrt(x * x + y * y) * {BB}) AS th FROM g), "
    f"t2 AS (SELECT *, atan2(z + {EP2} * {BB} * pow(sin(th), 3), p - {E2} * {A} * pow(cos(th), 3)) AS f FROM t1)"
)
NORMAL = f"({A} / sqrt(1 - {E2} * sin(a0) * sin(a0)))"
SHIFT = f"g AS (SELECT *, {NORMAL} * cos(a0) * cos(o0) - sin(o0) * e - sin(a0) * cos(o0) * n AS x, {NORMAL} * cos(a0) * sin(o0) + cos(o0) * e - sin(a0) * sin(o0) * n AS y, {NORMAL} * (1 - {E2}) * sin(a0) + cos(a0) * n AS z FROM h)"

ORACLES = {
    "utm_forward": oracle(f"WITH {LOC}, z AS (SELECT *, least(floor((lon + 180) / 6)::INT + 1, 60) AS zone FROM l WHERE lat BETWEEN -80 AND 84), {forward_sql('lat', 'lon', 'zone')} SELECT filepath, zone, round(x + 500000, 3) AS easting, round(y + CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END, 3) + 0.0 AS northing FROM u", **SC),
    "utm_inverse": oracle(f"WITH {inverse_sql('(minx * 100 + 200000)', '(miny * 1500)', '(seq % 60 + 1)', 'seq % 2 = 0', 'boxes')} SELECT id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM v", **B),
    "parse_mgrs": oracle(f"WITH {REF} SELECT id, text, e AS easting, n AS northing, CASE WHEN e IS NOT NULL THEN north END AS north FROM k", **B),
    "mgrs_to_latlon": oracle(f"WITH {REF}, {inverse_sql('e', 'n', 'zone', 'north', 'k')} SELECT id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM v WHERE e IS NOT NULL", **B),
    "parse_blocka": oracle(
        "WITH t AS (SELECT id, seq, seq % 2 = 0 AS n, seq % 3 = 0 AS e, lpad((seq % 90)::VARCHAR, 2, '0') AS d, lpad((seq % 180)::VARCHAR, 3, '0') AS dd FROM boxes), s AS (SELECT *, concat(d, lpad((seq % 60)::VARCHAR, 2, '0'), lpad((seq % 59)::VARCHAR, 2, '0'), '.25', CASE WHEN n THEN 'N' ELSE 'S' END, dd, lpad((seq % 58)::VARCHAR, 2, '0'), lpad((seq % 57)::VARCHAR, 2, '0'), '.50', CASE WHEN e THEN 'E' ELSE 'W' END) AS x, concat(CASE WHEN n THEN '+' ELSE '-' END, d, '.125000', CASE WHEN e THEN '+' ELSE '-' END, dd, '.500000') AS y FROM t) "
        "SELECT id, CASE WHEN seq % 5 = 0 THEN 'nowhere' WHEN seq % 5 < 3 THEN x ELSE y END AS text, "
        "round(CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 5 < 3 THEN (seq % 90 + seq % 60 / 60::DOUBLE + (seq % 59 + 0.25) / 3600::DOUBLE) ELSE seq % 90 + 0.125 END * CASE WHEN n THEN 1 ELSE -1 END, 6) + 0.0 AS lat, "
        "round(CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 5 < 3 THEN (seq % 180 + seq % 58 / 60::DOUBLE + (seq % 57 + 0.5) / 3600::DOUBLE) ELSE seq % 180 + 0.5 END * CASE WHEN e THEN 1 ELSE -1 END, 6) + 0.0 AS lon FROM s",
        **B,
    ),
    "grid_utm": oracle(f"WITH z AS (SELECT r.i AS row, c.j AS col, 500000 + c.j * 100 AS e, 5203000 - r.i * 100 AS n, 32 AS zone, true AS north FROM (SELECT unnest(range(30))::INT AS i) r, (SELECT unnest(range(40))::INT AS j) c), {inverse_sql('e', 'n', 'zone', 'north', 'z')} SELECT row, col, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM v", **B),
    "grid_sub": oracle("SELECT r.i AS row, c.j AS col, 20 - (r.i + 10) * 0.5::DOUBLE AS lat, 30 + (c.j + 5) * 0.75::DOUBLE AS lon FROM (SELECT unnest(range(30))::INT AS i) r, (SELECT unnest(range(25))::INT AS j) c", **B),
    "chip_positions": oracle("WITH d AS (SELECT image_id, max(row) + 1 AS rows, max(col) + 1 AS cols FROM px GROUP BY image_id), r AS (SELECT *, unnest(range(0, rows, 24)) AS r FROM d), c AS (SELECT *, unnest(range(0, cols, 40)) AS c FROM r), s AS (SELECT image_id, greatest(least(r, rows - least(24, rows)), 0) AS row0, least(24, rows) AS h, greatest(least(c, cols - least(40, cols)), 0) AS col0, least(40, cols) AS w FROM c) SELECT image_id, row0::INT AS row0, (row0 + h)::INT AS row1, col0::INT AS col0, (col0 + w)::INT AS col1 FROM s", **P),
    "geo_chip": oracle("SELECT image_id, row, col, round((col + 12) * 0.001::DOUBLE + (row + image_id * 7) * 0.0002::DOUBLE + 10, 6) + 0.0 AS x, round((col + 12) * -0.0001::DOUBLE + (row + image_id * 7) * -0.001::DOUBLE + 50, 6) + 0.0 AS y FROM px", **P),
    "geo_none": oracle("SELECT image_id, row, col, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon FROM px", **P),
    "pixel_bounds": oracle("SELECT id, minx - 0.75 >= -0.5 AND minx - 0.75 < 2400.5 AND miny - 0.25 >= -0.5 AND miny - 0.25 < 3100.5 AS inside FROM boxes", **B),
    "coreg_overlap": oracle(f"SELECT id, round(least((greatest({', '.join(HR)}) - least({', '.join(HR)})) * (greatest({', '.join(HC)}) - least({', '.join(HC)})) / (450 * 600)::DOUBLE, 1), 4) + 0.0 AS share FROM boxes", **B),
    "sar_subapertures": oracle(
        "WITH c AS (SELECT id, seq % 900 + 1 AS pulses, seq % 97 + 20 AS length, greatest(floor((seq % 97 + 20) * 0.75::DOUBLE)::BIGINT, 1) AS stride FROM boxes), "
        "p AS (SELECT id, pulses, length, stride, 0::BIGINT AS part, 0::BIGINT AS b, CASE WHEN pulses - least(length, pulses) > 0 AND pulses - least(length, pulses) < stride THEN pulses ELSE least(length, pulses) END AS e FROM c "
        "UNION ALL SELECT id, pulses, length, stride, part + 1, b + stride, CASE WHEN pulses - least(b + stride + length, pulses) > 0 AND pulses - least(b + stride + length, pulses) < stride THEN pulses ELSE least(b + stride + length, pulses) END FROM p WHERE e < pulses AND b + stride < pulses) "
        'SELECT id, part, b AS "begin", e AS "end" FROM p',
        **B,
    ),
    "sar_subaperture_length": oracle("SELECT id, greatest(floor(2 * sqrt(pi() / 4 * 2 * 0.031::DOUBLE * (val * 700) / (pi() * (minx + 7000) * (minx + 7000))) / 0.0002::DOUBLE), 16)::BIGINT AS pulses FROM boxes", **B),
    "quantize_ci2": oracle("WITH m AS (SELECT row AS key, col, hh_re AS re, hh_im AS im, max(greatest(abs(hh_re), abs(hh_im))) OVER (PARTITION BY row) AS most FROM ch), s AS (SELECT *, CASE WHEN most = 0 THEN 1 ELSE most / 127 END AS scale FROM m) SELECT key, col, round(scale, 6) + 0.0 AS scale, round_even(re / scale, 0)::INT AS q_re, round_even(im / scale, 0)::INT AS q_im FROM s", ch=CPIXELS),
    "catalog_geometry": oracle("""WITH c AS (SELECT id, (id * 7919) % 160 - 80 AS lat, (id * 104729) % 350 - 175 AS lon FROM prod) SELECT id, CASE WHEN id % 4 <> 0 THEN concat('{"type":"Polygon","coordinates":[[[', lat, ',', lon, '],[', lat, ',', lon + 2, '],[', lat + 1, ',', lon + 2, '],[', lat + 1, ',', lon, '],[', lat, ',', lon, ']]]}') END AS geometry FROM c""", prod=PRODUCTS),
    "detections_geojson": oracle("""WITH c AS (SELECT *, minx::BIGINT AS a, miny::BIGINT AS b, floor(maxx)::BIGINT AS c, floor(maxy)::BIGINT AS d FROM boxes) SELECT id, concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[', a, ',', b, '],[', c, ',', b, '],[', c, ',', d, '],[', a, ',', d, '],[', a, ',', b, ']]]},"properties":{"id":"', id, '","seq":', seq, ',"brand":', CASE WHEN seq % 3 <> 0 THEN concat('"', brand, '"') ELSE 'null' END, '}}') AS feature FROM c""", **B),
    "shape_ellipse_perimeter": oracle(
        f"WITH {LOC}, s AS (SELECT filepath AS id, radians(lat) AS a0, radians(lon) AS o0, seq % 50 * 100 + 500 AS ma, seq % 20 * 10 + 200 AS mi, radians(seq % 180) AS r, unnest(range(8))::INT AS k FROM l WHERE lat BETWEEN -70 AND 70), h AS (SELECT *, ma * cos(k * pi() / 4) * sin(r) + mi * sin(k * pi() / 4) * cos(r) AS e, ma * cos(k * pi() / 4) * cos(r) - mi * sin(k * pi() / 4) * sin(r) AS n FROM s), {SHIFT}, {TO_GEO} SELECT id, k, round(degrees(f), 6) + 0.0 AS lat, round(degrees(atan2(y, x)), 6) + 0.0 AS lon FROM t2",
        **SC,
    ),
    "grid_enu": oracle(f"WITH h AS (SELECT r.i AS row, c.j AS col, c.j * 250 - 5000 AS e, 5000 - r.i * 250 AS n, radians(10) AS a0, radians(20) AS o0 FROM (SELECT unnest(range(40))::INT AS i) r, (SELECT unnest(range(40))::INT AS j) c), {SHIFT}, {TO_GEO} SELECT row, col, round(degrees(f), 6) + 0.0 AS lat, round(degrees(atan2(y, x)), 6) + 0.0 AS lon FROM t2", **B),
}

QUERIES = {name: globals()[name] for name in [*(n for n in ORACLES if n != "grid_enu"), "circle_contains", "shape_arc", "shape_two_focus"]}
