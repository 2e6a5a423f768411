"""Ellipse, polygon, sensor-model, quadrant-detector and warp queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.functions import geo as G
from orbweave.operators import catalog as C
from orbweave.operators import raster as R
from orbweave.operators import shapes as S
from orbweave.queries.common import r6
from orbweave.queries.raster import ABS, around
from orbweave.queries.vector import A, BB, LOC, ecef
from orbweave.sources.views import BOXES, PIXELS, SCANS, load, oracle

CORNERS = ([(0.0, 0.0), (0.0, 5000.0), (5000.0, 5000.0), (5000.0, 0.0)], [(30.0, 10.0), (30.5, 14.0), (26.0, 15.0), (25.0, 9.5)])
MODEL = {
    "offset": (2500.0, 3000.0, 10.0, 20.0, 500.0),
    "scale": (2600.0, 3100.0, 70.0, 160.0, 900.0),
    "line_num": [0.01, 0.02, -1.0, 0.03, 0.004] + [0.0] * 10 + [0.002] + [0.0] * 4,
    "line_den": [1.0, 0.001, 0.002, 0.0, 0.0003] + [0.0] * 15,
    "samp_num": [-0.02, 1.0, 0.01, 0.02, 0.0, 0.005] + [0.0] * 5 + [0.001] + [0.0] * 8,
    "samp_den": [1.0, 0.002, -0.001, 0.0005] + [0.0] * 16,
}


def ellipses(spark, sf):
    b = load(spark, sf, BOXES)
    ee, nn = F.col("maxx") - F.col("minx") + 1, F.col("maxy") - F.col("miny") + 2
    return b.select("id", "brand", ee.alias("ee"), (F.sqrt(ee * nn) * 0.3).alias("en"), nn.alias("nn"))


def ellipse_from_cov(spark, sf):
    e = ellipses(spark, sf)
    return e.select("id", *[r6(v).alias(k) for k, v in S.ellipse_axes(F.col("ee"), F.col("en"), F.col("nn"), 2.0).items()])


def ellipse_cov(spark, sf):
    b = load(spark, sf, BOXES)
    v = S.ellipse_covariance(F.col("maxx") - F.col("minx") + 3, F.col("maxy") - F.col("miny"), F.col("seq") % 180 * 1.0)
    return b.select("id", *[r6(x).alias(k) for k, x in v.items()])


def ellipse_convolve(spark, sf):
    return S.convolve(ellipses(spark, sf), "brand").select("brand", *[r6(c, 4).alias(c) for c in ("ee", "en", "nn")])


def ellipse_fuse(spark, sf):
    return S.fuse(ellipses(spark, sf), "brand").select("brand", *[r6(c).alias(c) for c in ("ee", "en", "nn")])


def diamonds(spark, sf):
    b = load(spark, sf, BOXES)
    mx, my = (F.col("minx") + F.col("maxx")) / 2 + 0.25, (F.col("miny") + F.col("maxy")) / 2 + 0.25
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(p(F.col("minx") + 0.3, my), p(mx, F.col("miny") + 0.3), p(F.col("maxx") + 0.4, my), p(mx, F.col("maxy") + 0.4))
    return b.select("id", ring.alias("ring"))


def rasterize_polygon(spark, sf):
    return S.rasterize(diamonds(spark, sf), 5200, 5200)


def geo_corner(spark, sf):
    h = S.solve_homography(*CORNERS)
    lat, lon = G.homography("minx", "miny", h)
    return load(spark, sf, BOXES).select("id", r6(lat).alias("lat"), r6(lon).alias("lon"))


def rpc_forward(spark, sf):
    d = C.located(load(spark, sf, SCANS)).withColumn("h", F.col("seq") % 1000 * 1.5)
    line, sample = S.rational(F.col("lat"), F.col("lon"), F.col("h"), MODEL)
    return d.select("filepath", r6(line, 4).alias("line"), r6(sample, 4).alias("sample"))


def ray_ellipsoid(spark, sf):
    d = C.located(load(spark, sf, SCANS)).withColumn("h", F.lit(500000.0))
    o = G.geodetic_to_ecef("lat", "lon", "h")
    size = F.sqrt(S.dot(o, o))
    down = [-c / size + F.lit(x) for c, x in zip(o, (0.05, -0.02, 0.01), strict=True)]
    return d.select("filepath", r6(S.ray_ellipsoid(o, down, G.WGS84_A, G.WGS84_B), 2).alias("range_m"))


def vec3(spark, sf):
    d = C.located(load(spark, sf, SCANS))
    a, b = G.unit_sphere("lat", "lon"), (F.lit(0.6), F.lit(-0.64), F.lit(0.48))
    c = S.cross(a, b)
    return d.select("filepath", r6(S.dot(a, b)).alias("dot"), *[r6(x).alias(k) for k, x in zip(("x", "y", "z"), c, strict=True)])


def _quadrant(which):
    def run(spark, sf):
        p = load(spark, sf, PIXELS).withColumn("value", F.abs("value"))
        return R.quadrant_detector(p, which, 1, 2, 0.05).select("image_id", "row", "col", r6("threshold", 4).alias("threshold"), "hit")

    return run


cfar_go, cfar_so = _quadrant("go"), _quadrant("so")


def warp_image(spark, sf):
    p = load(spark, sf, PIXELS)
    x, y = G.affine_inverse(F.col("col") + 0.0, F.col("row") + 0.0, (0.9, 0.1, 2.0, -0.1, 0.9, 3.0))
    wanted = p.select("image_id", (F.col("row") * 64 + F.col("col")).alias("id"), x.alias("r"), y.alias("c"))
    return R.bilinear(p, wanted).select("image_id", "id", r6("value").alias("value"))


def geo_footprint(spark, sf):
    b = load(spark, sf, BOXES)
    corners = [G.affine(F.col(y), F.col(x), (0.005, 0.0001, 115.0, -0.0002, -0.01, -30.0)) for x in ("minx", "maxx") for y in ("miny", "maxy")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return b.select("id", r6(F.least(*xs)).alias("west"), r6(F.least(*ys)).alias("south"), r6(F.greatest(*xs)).alias("east"), r6(F.greatest(*ys)).alias("north"))


def dem_bilinear(spark, sf):
    dem = load(spark, sf, PIXELS)
    p = dem.select("image_id", (F.col("row") * 64 + F.col("col")).alias("id"), (F.col("row") / 2 + 0.37).alias("r"), (F.col("col") / 3 + 0.41).alias("c"))
    return R.bilinear(dem, p, float(-9999)).select("image_id", "id", r6("value").alias("height"))


B, SC, P = {"boxes": BOXES}, {"scans": SCANS}, {"px": PIXELS}
EL = "e AS (SELECT id, brand, maxx - minx + 1 AS ee, sqrt((maxx - minx + 1) * (maxy - miny + 2)) * 0.3::DOUBLE AS en, maxy - miny + 2 AS nn FROM boxes)"
AX = f"{EL}, a AS (SELECT *, (ee + nn) / 2 AS m, sqrt(pow((ee - nn) / 2, 2) + en * en) AS d, atan2(2 * en, ee - nn) / 2 AS t FROM e)"
TERMS = "1 l p z l*p l*z p*z l*l p*p z*z p*l*z l*l*l l*p*p l*z*z l*l*p p*p*p p*z*z l*l*z p*p*z z*z*z".split()


def poly(name):
    return "(" + " + ".join(f"{c!r}::DOUBLE * {t}" for c, t in zip(MODEL[name], TERMS, strict=True) if c) + ")"


def h_sql(k):
    h = S.solve_homography(*CORNERS)
    return f"({h[3 * k]!r}::DOUBLE * minx + {h[3 * k + 1]!r}::DOUBLE * miny + {h[3 * k + 2]!r}::DOUBLE) / ({h[6]!r}::DOUBLE * minx + {h[7]!r}::DOUBLE * miny + 1)"


def quad_sql(fold):
    part = lambda a, b: f"avg(CASE WHEN dr {a} AND dc {b} THEN v END)"
    four = ", ".join(part(a, b) for a in ("= -2", "= 2") for b in ("= -2", "= 2"))
    return oracle(f"WITH {ABS}, {around(2, 'ap')}, s AS (SELECT image_id, row, col, x, {fold}({four}) + 1.6448536269514722::DOUBLE * stddev_pop(CASE WHEN abs(dr) > 1 OR abs(dc) > 1 THEN v END) AS t FROM n GROUP BY ALL) SELECT image_id, row, col, round(t, 4) + 0.0 AS threshold, x > t AS hit FROM s", **P)


def bil_sql(source, asked, nodata, name="value"):
    return f"WITH {source}{asked}, k AS (SELECT w.image_id, w.id, count(p.value) AS n, sum(p.value * (CASE WHEN p.row = floor(r) THEN 1 - (r - floor(r)) ELSE r - floor(r) END) * (CASE WHEN p.col = floor(c) THEN 1 - (c - floor(c)) ELSE c - floor(c) END)) AS v FROM w LEFT JOIN b p ON p.image_id = w.image_id AND p.row BETWEEN floor(r) AND floor(r) + 1 AND p.col BETWEEN floor(c) AND floor(c) + 1 GROUP BY ALL) SELECT image_id, id, round(CASE WHEN n = 4 THEN v ELSE {nodata} END, 6) + 0.0::DOUBLE AS {name} FROM k"


RAY = f"{LOC.replace('seq % 1000 * 1.5::DOUBLE AS h', '500000.0::DOUBLE AS h')}, {ecef()}, d AS (SELECT filepath, x / {A} AS ox, y / {A} AS oy, z / {BB} AS oz, (-x / sqrt(x * x + y * y + z * z) + 0.05::DOUBLE) / {A} AS dx, (-y / sqrt(x * x + y * y + z * z) - 0.02::DOUBLE) / {A} AS dy, (-z / sqrt(x * x + y * y + z * z) + 0.01::DOUBLE) / {BB} AS dz FROM e), q AS (SELECT filepath, dx * dx + dy * dy + dz * dz AS q, ox * dx + oy * dy + oz * dz AS h, ox * ox + oy * oy + oz * oz - 1 AS c FROM d)"
U = f"{LOC}, u AS (SELECT filepath, cos(radians(lat)) * cos(radians(lon)) AS a, cos(radians(lat)) * sin(radians(lon)) AS b, sin(radians(lat)) AS c FROM l)"
DIAMOND = "d AS (SELECT id, minx + 0.3::DOUBLE AS x0, maxx + 0.4::DOUBLE AS x2, miny + 0.3::DOUBLE AS y1, maxy + 0.4::DOUBLE AS y3, (minx + maxx) / 2 + 0.25::DOUBLE AS mx, (miny + maxy) / 2 + 0.25::DOUBLE AS my FROM boxes), g AS (SELECT *, unnest(range(greatest(floor(y1), 0)::BIGINT, floor(y3)::BIGINT + 2)) AS row FROM d), h AS (SELECT *, unnest(range(greatest(floor(x0), 0)::BIGINT, floor(x2)::BIGINT + 2)) AS col FROM g)"
EDGE = lambda ax, ay, bx, by: f"CASE WHEN (row >= least({ay}, {by}) AND row < greatest({ay}, {by})) AND col >= {ax} + (row - {ay}) / ({by} - {ay}) * ({bx} - {ax}) THEN 1 ELSE 0 END"
RING = " + ".join(EDGE(*a, *b) for a, b in [(("x0", "my"), ("mx", "y1")), (("mx", "y1"), ("x2", "my")), (("x2", "my"), ("mx", "y3")), (("mx", "y3"), ("x0", "my"))])
FOOT = [(f"{x} * 0.005::DOUBLE + {y} * 0.0001::DOUBLE + 115", f"{x} * -0.0002::DOUBLE + {y} * -0.01::DOUBLE - 30") for x in ("minx", "maxx") for y in ("miny", "maxy")]
WARP = "b AS (SELECT * FROM px), w AS (SELECT image_id, row * 64 + col AS id, ((row - 3) * 0.9::DOUBLE + (col - 2) * 0.1::DOUBLE) / 0.82::DOUBLE AS r, ((col - 2) * 0.9::DOUBLE - (row - 3) * 0.1::DOUBLE) / 0.82::DOUBLE AS c FROM b)"

ORACLES = {
    "ellipse_from_cov": oracle(f"WITH {AX} SELECT id, round(2 * sqrt(m + d), 6) AS major, round(2 * sqrt(greatest(m - d, 0)), 6) AS minor, round(90 - degrees(t) - 180 * floor((90 - degrees(t)) / 180), 6) + 0.0 AS bearing FROM a", **B),
    "ellipse_cov": oracle("WITH e AS (SELECT id, pow(maxx - minx + 3, 2) AS a, pow(maxy - miny, 2) AS b, sin(radians(seq % 180)) AS s, cos(radians(seq % 180)) AS c FROM boxes) SELECT id, round(a * s * s + b * c * c, 6) + 0.0 AS ee, round((a - b) * s * c, 6) + 0.0 AS en, round(a * c * c + b * s * s, 6) + 0.0 AS nn FROM e", **B),
    "ellipse_convolve": oracle(f"WITH {EL} SELECT brand, round(sum(ee), 4) AS ee, round(sum(en), 4) AS en, round(sum(nn), 4) AS nn FROM e GROUP BY brand", **B),
    "ellipse_fuse": oracle(f"WITH {EL}, i AS (SELECT brand, sum(nn / (ee * nn - en * en)) AS a, sum(-en / (ee * nn - en * en)) AS b, sum(ee / (ee * nn - en * en)) AS c FROM e GROUP BY brand) SELECT brand, round(c / (a * c - b * b), 6) + 0.0 AS ee, round(-b / (a * c - b * b), 6) + 0.0 AS en, round(a / (a * c - b * b), 6) + 0.0 AS nn FROM i", **B),
    "rasterize_polygon": oracle(f"WITH {DIAMOND} SELECT id, row::INT AS row, col::INT AS col FROM h WHERE ({RING}) % 2 = 1 AND row < 5200 AND col < 5200", **B),
    "geo_corner": oracle(f"SELECT id, round({h_sql(0)}, 6) + 0.0 AS lat, round({h_sql(1)}, 6) + 0.0 AS lon FROM boxes", **B),
    "rpc_forward": oracle(f"WITH {LOC}, k AS (SELECT filepath, (lat - 10) / 70::DOUBLE AS p, (lon - 20) / 160::DOUBLE AS l, (h - 500) / 900::DOUBLE AS z FROM l) SELECT filepath, round({poly('line_num')} / {poly('line_den')} * 2600 + 2500, 4) + 0.0 AS line, round({poly('samp_num')} / {poly('samp_den')} * 3100 + 3000, 4) + 0.0 AS sample FROM k", **SC),
    "ray_ellipsoid": oracle(f"WITH {RAY} SELECT filepath, CASE WHEN h * h - q * c >= 0 THEN round((-h - sqrt(greatest(h * h - q * c, 0))) / q, 2) + 0.0 END AS range_m FROM q", **SC),
    "vec3": oracle(f"WITH {U} SELECT filepath, round(a * 0.6::DOUBLE - b * 0.64::DOUBLE + c * 0.48::DOUBLE, 6) + 0.0 AS dot, round(b * 0.48::DOUBLE + c * 0.64::DOUBLE, 6) + 0.0 AS x, round(c * 0.6::DOUBLE - a * 0.48::DOUBLE, 6) + 0.0 AS y, round(-a * 0.64::DOUBLE - b * 0.6::DOUBLE, 6) + 0.0 AS z FROM u", **SC),
    "cfar_go": quad_sql("greatest"),
    "cfar_so": quad_sql("least"),
    "warp_image": oracle(bil_sql("", WARP, "0"), **P),
    "geo_footprint": oracle(f"SELECT id, round(least({', '.join(x for x, _ in FOOT)}), 6) + 0.0 AS west, round(least({', '.join(y for _, y in FOOT)}), 6) + 0.0 AS south, round(greatest({', '.join(x for x, _ in FOOT)}), 6) + 0.0 AS east, round(greatest({', '.join(y for _, y in FOOT)}), 6) + 0.0 AS north FROM boxes", **B),
    "dem_bilinear": oracle(bil_sql("b AS (SELECT * FROM px), ", "w AS (SELECT image_id, row * 64 + col AS id, row / 2.0::DOUBLE + 0.37::DOUBLE AS r, col / 3.0::DOUBLE + 0.41::DOUBLE AS c FROM px)", "-9999", "height"), **P),
}

QUERIES = {name: globals()[name] for name in ORACLES}
