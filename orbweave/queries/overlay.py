"""Polygon overlay, speckle, local contrast, decompositions and models with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import catalog as C
from orbweave.operators import overlay as O
from orbweave.operators import polarimetry as P
from orbweave.operators import shapes as S
from orbweave.operators import signal as N
from orbweave.operators import tiles as T
from orbweave.operators import vector as V
from orbweave.queries import signal as signal_queries
from orbweave.queries.common import r6
from orbweave.queries.shapes import MODEL
from orbweave.queries.vector import COH, LOC, coherency
from orbweave.sources import fields as fields_of
from orbweave.sources.views import BOXES, CPIXELS, PIXELS, POINTS, SCANS, SERIES, load, oracle

CELL = 250.0
HALF = 30.5


def _ring(x0, y0, x1, y1):
    corner = lambda x, y: F.struct(F.col(x).alias("x") if isinstance(x, str) else x.alias("x"), F.col(y).alias("y") if isinstance(y, str) else y.alias("y"))
    return F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring")


def box_rings(spark, sf):
    return load(spark, sf, BOXES).select("id", "brand", F.lit(0).alias("layer"), _ring("minx", "miny", "maxx", "maxy"))


def vector_union_area(spark, sf):
    """Boxes of each brand dissolved; their exact area."""
    parts = O.overlay(box_rings(spark, sf), "brand", "union", CELL)
    return parts.groupBy("brand").agg(r6(F.sum(V.ring_area(F.col("ring"))), 3).alias("area"))


def _overlay_area(how):
    def run(spark, sf):
        x, y = F.col("x"), F.col("y")
        squares = load(spark, sf, POINTS).select(F.lit("all").alias("k"), F.lit(1).alias("layer"), _ring(x - HALF, y - HALF, x + HALF, y + HALF))
        boxes = box_rings(spark, sf).select(F.lit("all").alias("k"), "layer", "ring")
        parts = O.overlay(boxes.union(squares), "k", how, CELL)
        return parts.groupBy("k").agg(r6(F.sum(V.ring_area(F.col("ring"))), 3).alias("area"))

    return run


vector_overlay_union, vector_overlay_intersection, vector_overlay_difference, vector_overlay_symmetric = map(_overlay_area, ("union", "intersection", "difference", "symmetric"))


def vector_clip_plane(spark, sf):
    cut = O.clip_polygons(box_rings(spark, sf), [(1.0, 1.0, 5000.0)])
    return cut.select("id", r6(V.ring_area(F.col("ring"))).alias("area"))


def filter_lee_sigma(spark, sf):
    return T.lee_sigma(load(spark, sf, PIXELS), 1, 4.0).select("image_id", "row", "col", r6("value").alias("value"))


def filter_refined_lee(spark, sf):
    c = load(spark, sf, CPIXELS)
    hh, vv = P.channel("hh"), P.channel("vv")
    m = c.select(
        F.floor(F.col("row") / 64).alias("image_id"), (F.col("row") % 64).cast("int").alias("row"), "col", hh.power().alias("c11"), vv.power().alias("c22"), (hh * vv.conj()).re.alias("c12_re")
    )
    out = T.refined_lee(m, ["c11", "c22"], ["c12_re"], 3, 4.0)
    return out.select("image_id", "row", "col", *[r6(k, 5).alias(k) for k in ("c11", "c22", "c12_re")])


def contrast_clahe(spark, sf):
    return T.local_equalize(load(spark, sf, PIXELS), 11, 0.117, 13).select("image_id", "row", "col", r6("value").alias("value"))


POWERS = ("surface", "double_bounce", "volume", "helix")


def _yamaguchi(model):
    def run(spark, sf):
        out = P.yamaguchi(coherency(spark, sf), ["block", "col"], model)
        return out.select("block", "col", *[r6(k, 5).alias(k) for k in POWERS])

    return run


pol_yamaguchi_y4o, pol_yamaguchi_y4r, pol_yamaguchi_y4s = map(_yamaguchi, ("y4o", "y4r", "y4s"))


def pol_touzi(spark, sf):
    out = P.touzi(coherency(spark, sf), ["block", "col"])
    return out.select("block", "col", *[r6(k, 4).alias(k) for k in P.TOUZI])


def interp_farrow(spark, sf):
    return N.resample(signal_queries.series(spark, sf), signal_queries._wanted(spark, sf), 2, N.farrow_weight(2, 3)).select("key", "id", r6("value", 4).alias("value"))


def interp_polyphase(spark, sf):
    return N.resample(signal_queries.series(spark, sf), signal_queries._wanted(spark, sf), 4, N.phased_weight(4, 128, 5.0)).select("key", "id", r6("value", 4).alias("value"))


def sar_multilook(spark, sf):
    z = load(spark, sf, CPIXELS).select(
        F.floor(F.col("row") / 64).alias("image_id"), (F.col("row") % 64).cast("int").alias("row"), "col", F.col("hh_re").alias("re"), F.col("hh_im").alias("im")
    )
    return N.multilook_images(z, (2, 2)).select("image_id", "look", "row", "col", r6("re").alias("re"), r6("im").alias("im"))


def rpc_inverse(spark, sf):
    """Places back from the lines and samples that the forward model gives them."""
    d = C.located(load(spark, sf, SCANS)).withColumn("h", F.col("seq") % 1000 * 1.5)
    line, sample = S.rational(F.col("lat"), F.col("lon"), F.col("h"), MODEL)
    out = S.rational_inverse(d.select("filepath", line.alias("line"), sample.alias("sample"), "h"), MODEL)
    return out.select("filepath", r6("lat", 5).alias("lat"), r6("lon", 5).alias("lon"))


def geoid_height(spark, sf):
    """Heights of scans above a geoid of 64 x 64 nodes, the mean of all images."""
    d = C.located(load(spark, sf, SCANS)).select(F.col("filepath").alias("id"), "lat", "lon", (F.col("seq") % 1000 * 1.5).alias("h"))
    grid = load(spark, sf, PIXELS).groupBy("row", "col").agg(F.avg("value").alias("value"))
    return S.undulation(d, grid, 64, 64).select("id", r6("undulation").alias("undulation"), r6(F.col("h") - F.col("undulation")).alias("height"))


ASKED = ("sar.coherence", "physical.rcs_db", "identity.label", "gmti.mdv_dmps", "volume.tree_count", "context.cluster_id", "temporal.dwell_time", "trait.color", "spectral.ndvi", "no.such_field")


def field_lookup(spark, sf):
    name = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("seq") % len(ASKED) + 1).cast("int"))
    return fields_of.described(load(spark, sf, BOXES).select("id", name.alias("field")), "field").select("id", "field", "domain", "type", "unit", "known")


B, P2, PX, CP, SC, SE = {"boxes": BOXES}, {"boxes": BOXES, "points": POINTS}, {"px": PIXELS}, {"ch": CPIXELS}, {"scans": SCANS}, {"s": SERIES}
# Corners are whole numbers, so areas are counts of unit cells.
UNITS = "ax AS (SELECT brand, miny, maxy, unnest(range(minx::BIGINT, maxx::BIGINT)) AS x FROM boxes), a AS (SELECT DISTINCT x, unnest(range(miny::BIGINT, maxy::BIGINT)) AS y FROM ax), bx AS (SELECT y, unnest(range((x - 30.5)::BIGINT, (x + 30.5)::BIGINT)) AS x FROM points), b AS (SELECT DISTINCT x, unnest(range((y - 30.5)::BIGINT, (y + 30.5)::BIGINT)) AS y FROM bx), ab AS (SELECT a.x FROM a JOIN b ON a.x = b.x AND a.y = b.y), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM ab) AS nab)"
REFLECTED = "mx AS (SELECT image_id, max(row) AS mr, max(col) AS mc FROM src GROUP BY 1), nb AS (SELECT s.image_id, s.row, s.col, dr, dc, abs(s.row + dr) AS rr, abs(s.col + dc) AS cc, mr, mc FROM src s JOIN mx USING (image_id), (SELECT unnest([-1, 0, 1]) AS dr) a, (SELECT unnest([-1, 0, 1]) AS dc) b), spot AS (SELECT image_id, row, col, dr, dc, CASE WHEN rr > mr THEN 2 * mr - rr ELSE rr END AS qr, CASE WHEN cc > mc THEN 2 * mc - cc ELSE cc END AS qc FROM nb)"
LOW, HIGH = T.gamma_quantile(0.05, 4.0), T.gamma_quantile(0.95, 4.0)


def refined_sql() -> str:
    spots = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]
    slope = [" + ".join(f"({T.COMPASS[k][r + 1][c + 1]}::DOUBLE * any_value(CASE WHEN dr = {r} AND dc = {c} THEN span END))" for r, c in spots) for k in range(4)]
    face = ["dc >= 0", "dc - dr >= 0", "dr <= 0", "dr + dc <= 0", "dc <= 0", "dc - dr <= 0", "dr >= 0", "dr + dc >= 0"]
    names = {"s": "span", "ss": "span * span", "c11": "c11", "c22": "c22", "x": "c12_re"}
    means = ", ".join(f"[{', '.join(f'avg(CASE WHEN {f} THEN {e} END)' for f in face)}] AS m_{n}" for n, e in names.items())
    centre = ", ".join(f"any_value(CASE WHEN dr = 0 AND dc = 0 THEN {e} END) AS o_{n}" for n, e in names.items())
    top = "greatest(abs(g0), abs(g1), abs(g2), abs(g3))"
    way = "CASE " + " ".join(f"WHEN abs(g{k}) = {top} THEN {k + 1} + CASE WHEN g{k} > 0 THEN 4 ELSE 0 END" for k in range(4)) + " END"
    out = ", ".join(f"round(m_{n}[way] + w * (o_{n} - m_{n}[way]), 5) + 0.0 AS {a}" for n, a in (("c11", "c11"), ("c22", "c22"), ("x", "c12_re")))
    return (
        "WITH src AS (SELECT row // 64 AS image_id, (row % 64)::INT AS row, col, hh_re * hh_re + hh_im * hh_im AS c11, vv_re * vv_re + vv_im * vv_im AS c22, hh_re * vv_re + hh_im * vv_im AS c12_re FROM ch), "
        f"{REFLECTED}, v AS (SELECT spot.*, c11, c22, c12_re, c11 + c22 AS span FROM spot JOIN src q ON q.image_id = spot.image_id AND q.row = qr AND q.col = qc), "
        f"k AS (SELECT image_id, row, col, {', '.join(f'{s} AS g{i}' for i, s in enumerate(slope))}, {means}, {centre} FROM v GROUP BY ALL), d AS (SELECT *, {way} AS way FROM k), "
        "c AS (SELECT *, greatest(m_ss[way] - m_s[way] * m_s[way], 0) / (m_s[way] * m_s[way] + 1e-10) AS cv FROM d), w AS (SELECT *, least(greatest((cv - 0.25) / (cv * 1.25 + 1e-10), 0), 1) AS w FROM c) "
        f"SELECT image_id, row, col, {out} FROM w"
    )


def yamaguchi_sql(model: str) -> str:
    turn = "CASE WHEN abs(t22 - t33) < 1e-6 THEN 0 ELSE atan(2 * t23_re / (t22 - t33)) / 2 END" if model != "y4o" else "0::DOUBLE"
    two = "a - b + 7 * d / 8 + pc / 16 <= 0" if model == "y4s" else "false"
    db = lambda x, y: f"CASE WHEN {y} < 1e-6 THEN 0 ELSE 10 * log10(greatest(({x}) / nullif({y}, 0), 1e-6)) END"
    held = ", ".join(f"round(least(greatest(CASE WHEN pv < 0 THEN {x} ELSE {y} END, 0), top), 5) + 0.0 AS {n}" for n, x, y in (
        ("surface", "s3", "CASE WHEN nil OR ps < 0 THEN 0 WHEN pd < 0 THEN span - pv - pc ELSE ps END"),
        ("double_bounce", "d3", "CASE WHEN nil OR pd < 0 THEN 0 WHEN ps < 0 THEN span - pv - pc ELSE pd END"),
        ("volume", "v3", "CASE WHEN nil THEN span - pc ELSE pv END"),
        ("helix", "0", "pc"),
    ))
    return (
        f"WITH {COH}, y0 AS (SELECT *, {turn} AS g, t11 + t22 + t33 AS span, 2 * abs(t23_im) AS pc FROM t), "
        "y1 AS (SELECT block, col, span, pc, max(span) OVER () AS top, t11 AS a, t22 * cos(g) * cos(g) + t33 * sin(g) * sin(g) + 2 * t23_re * sin(g) * cos(g) AS b, t22 * sin(g) * sin(g) + t33 * cos(g) * cos(g) - 2 * t23_re * sin(g) * cos(g) AS d, t12_re * cos(g) + t13_re * sin(g) AS p, t12_im * cos(g) + t13_im * sin(g) AS pi_, t13_re * cos(g) - t12_re * sin(g) AS q, t13_im * cos(g) - t12_im * sin(g) AS qi FROM y0), "
        f"y2 AS (SELECT *, {two} AS two, {db('a + b - 2 * p', '(a + b + 2 * p)')} AS r, (a + 2 * p + b) / 2 AS hh, (a - 2 * p + b) / 2 AS vv FROM y1), "
        f"y3 AS (SELECT *, {db('vv', 'hh')} AS f, CASE WHEN two THEN 15 / 16::DOUBLE WHEN r > -2 AND r <= 2 THEN 2 ELSE 15 / 8::DOUBLE END * (2 * d - pc) AS pv FROM y2), "
        "y4 AS (SELECT *, CASE WHEN f > -2 AND f <= 2 THEN 2 * d ELSE 15 * d / 8 END AS v3a FROM y3), "
        "y5 AS (SELECT *, CASE WHEN f <= -2 THEN hh - 8 * v3a / 15 WHEN f > 2 THEN hh - 3 * v3a / 15 ELSE hh - 3 * v3a / 8 END AS h, CASE WHEN f <= -2 THEN vv - 3 * v3a / 15 WHEN f > 2 THEN vv - 8 * v3a / 15 ELSE vv - 3 * v3a / 8 END AS v, CASE WHEN f > -2 AND f <= 2 THEN (a - b) / 2 - v3a / 8 ELSE (a - b) / 2 - 2 * v3a / 15 END AS x0 FROM y4), "
        "y6 AS (SELECT *, CASE WHEN x0 * x0 + pi_ * pi_ > h * v THEN sqrt(greatest(h * v, 0) / greatest(x0 * x0 + pi_ * pi_, 1e-6)) ELSE 1 END AS k FROM y5), "
        "y7 AS (SELECT *, x0 * k AS x, pi_ * k AS xi FROM y6), y8 AS (SELECT *, (h * v - x * x - xi * xi) / (h + v + 2 * abs(x)) AS weak FROM y7), "
        "y9 AS (SELECT *, CASE WHEN abs(v - weak) > 1e-6 THEN (v - weak) * (1 + (pow(weak + abs(x), 2) + xi * xi) / pow(v - weak, 2)) ELSE v - weak END AS strong, h <= 1e-6 OR v <= 1e-6 AS sole FROM y8), "
        "z0 AS (SELECT *, CASE WHEN sole THEN hh + d / 2 + vv WHEN x >= 0 THEN strong ELSE 2 * weak END AS s3, CASE WHEN sole THEN 0 WHEN x >= 0 THEN 2 * weak ELSE strong END AS d3, CASE WHEN sole THEN 0 ELSE v3a END AS v3, pow(p + q + CASE WHEN two OR (r > -2 AND r <= 2) THEN 0 WHEN r <= -2 THEN -pv / 6 ELSE pv / 6 END, 2) + pow(pi_ + qi, 2) AS cross2, CASE WHEN two THEN a ELSE a - pv / 2 END AS s0, NOT two AND 2 * a + pc - span > 0 AS led FROM y9), "
        "z1 AS (SELECT *, span - pv - pc - s0 AS d0 FROM z0), z2 AS (SELECT *, CASE WHEN led THEN cross2 / CASE WHEN abs(s0) > 1e-6 THEN s0 ELSE 1e-6 END ELSE -cross2 / CASE WHEN abs(d0) > 1e-6 THEN d0 ELSE 1e-6 END END AS e FROM z1), "
        "z3 AS (SELECT *, s0 + e AS ps, d0 - e AS pd FROM z2), z4 AS (SELECT *, (NOT two AND pv + pc > span) OR (ps < 0 AND pd < 0) AS nil FROM z3) "
        f"SELECT block, col, {held} FROM z4"
    )


CLAHE = (
    "WITH z AS (SELECT image_id, min(value) AS lo, max(value) AS hi, max(row) AS mr, max(col) AS mc FROM px GROUP BY 1), r AS (SELECT px.*, least(floor((value - lo) / (hi - lo) * 13), 12)::INT AS bin, mr, mc FROM px JOIN z USING (image_id)), "
    "h AS (SELECT image_id, least(row // 11, greatest((mr + 1) // 11 - 1, 0)) AS br, least(col // 11, greatest((mc + 1) // 11 - 1, 0)) AS bc, bin, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT image_id, br, bc, sum(n) AS total, sum(n) * 0.117::DOUBLE AS lim FROM h GROUP BY ALL), "
    "g AS (SELECT t.*, (SELECT sum(greatest(n - lim, 0)) / 13 FROM h WHERE h.image_id = t.image_id AND h.br = t.br AND h.bc = t.bc) AS over FROM t), "
    "m AS (SELECT g.image_id, g.br, g.bc, b.b AS bin, (sum(CASE WHEN n IS NULL THEN 0 ELSE least(n, lim) END) + any_value((b.b + 1) * over)) / any_value(total) AS share FROM g CROSS JOIN (SELECT unnest(range(13)) AS b) b LEFT JOIN h ON h.image_id = g.image_id AND h.br = g.br AND h.bc = g.bc AND h.bin <= b.b GROUP BY g.image_id, g.br, g.bc, b.b), "
    "k AS (SELECT image_id, row, col, bin, mr, mc, (row + 0.5::DOUBLE) / 11 - 0.5::DOUBLE AS pr, (col + 0.5::DOUBLE) / 11 - 0.5::DOUBLE AS pc, ka, kb FROM r, (SELECT unnest([0, 1]) AS ka) a, (SELECT unnest([0, 1]) AS kb) b), "
    "q AS (SELECT image_id, row, col, bin, least(greatest(floor(pr)::BIGINT + ka, 0), greatest((mr + 1) // 11 - 1, 0)) AS br, least(greatest(floor(pc)::BIGINT + kb, 0), greatest((mc + 1) // 11 - 1, 0)) AS bc, (CASE ka WHEN 0 THEN 1 - (pr - floor(pr)) ELSE pr - floor(pr) END) * (CASE kb WHEN 0 THEN 1 - (pc - floor(pc)) ELSE pc - floor(pc) END) AS w FROM k) "
    "SELECT q.image_id, q.row, q.col, round(sum(w * share), 6) + 0.0 AS value FROM q JOIN m ON m.image_id = q.image_id AND m.br = q.br AND m.bc = q.bc AND m.bin = q.bin GROUP BY ALL"
)
quoted = lambda v: "NULL" if v is None else f"'{v}'"
ENTRIES = ", ".join(f"({', '.join(map(quoted, e))})" for e in map(fields_of.lookup, ASKED) if e)

ORACLES = {
    "vector_union_area": oracle("WITH a AS (SELECT brand, miny, maxy, unnest(range(minx::BIGINT, maxx::BIGINT)) AS x FROM boxes), b AS (SELECT DISTINCT brand, x, unnest(range(miny::BIGINT, maxy::BIGINT)) AS y FROM a) SELECT brand, count(*)::DOUBLE AS area FROM b GROUP BY 1", **B),
    "vector_overlay_union": oracle(f"WITH {UNITS} SELECT 'all' AS k, (na + nb - nab)::DOUBLE AS area FROM n", **P2),
    "vector_overlay_intersection": oracle(f"WITH {UNITS} SELECT 'all' AS k, nab::DOUBLE AS area FROM n", **P2),
    "vector_overlay_difference": oracle(f"WITH {UNITS} SELECT 'all' AS k, (na - nab)::DOUBLE AS area FROM n", **P2),
    "vector_overlay_symmetric": oracle(f"WITH {UNITS} SELECT 'all' AS k, (na + nb - 2 * nab)::DOUBLE AS area FROM n", **P2),
    "vector_clip_plane": oracle("WITH k AS (SELECT id, maxx - minx AS w, maxy - miny AS h, 5000 - minx - miny AS s FROM boxes), a AS (SELECT id, (pow(greatest(s, 0), 2) - pow(greatest(s - w, 0), 2) - pow(greatest(s - h, 0), 2) + pow(greatest(s - w - h, 0), 2)) / 2 AS area FROM k) SELECT id, round(area, 6) + 0.0 AS area FROM a WHERE area > 0", **B),
    "filter_lee_sigma": oracle(
        f"WITH src AS (SELECT image_id, row, col, abs(value) AS x FROM px), {REFLECTED}, v AS (SELECT spot.image_id, spot.row, spot.col, s.x, q.x AS v FROM spot JOIN src q ON q.image_id = spot.image_id AND q.row = qr AND q.col = qc JOIN src s ON s.image_id = spot.image_id AND s.row = spot.row AND s.col = spot.col), "
        f"g AS (SELECT image_id, row, col, x, avg(v) AS m, avg(v * v) AS q FROM v WHERE v >= x * {LOW!r}::DOUBLE AND v <= x * {HIGH!r}::DOUBLE GROUP BY ALL), c AS (SELECT *, greatest(q - m * m, 0) / (m * m) AS cv FROM g) "
        "SELECT image_id, row, col, round(greatest(m + (CASE WHEN cv > 0 THEN least(greatest(1 - 0.25 / cv, 0), 1) ELSE 0 END) * (x - m), 0), 6) + 0.0 AS value FROM c", **PX),
    "filter_refined_lee": oracle(refined_sql(), **CP),
    "contrast_clahe": oracle(CLAHE, **PX),
    "pol_yamaguchi_y4o": oracle(yamaguchi_sql("y4o"), **CP),
    "pol_yamaguchi_y4r": oracle(yamaguchi_sql("y4r"), **CP),
    "pol_yamaguchi_y4s": oracle(yamaguchi_sql("y4s"), **CP),
    "interp_farrow": signal_queries.ORACLES["interp_lagrange"],
    "rpc_inverse": oracle(f"WITH {LOC} SELECT filepath, round(lat, 5) + 0.0 AS lat, round(lon, 5) + 0.0 AS lon FROM l", **SC),
    "geoid_height": oracle(
        f"WITH {LOC}, p AS (SELECT filepath AS id, h, (90 - lat) / 180 * 63 AS y, (CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) / 360 * 64 AS x FROM l), q AS (SELECT *, floor(y) AS r0, floor(x) AS c0, i, j FROM p, (SELECT unnest([0, 1]) AS i) a, (SELECT unnest([0, 1]) AS j) b), "
        "w AS (SELECT id, h, least(r0 + i, 63) AS r, (c0 + j) % 64 AS c, (CASE i WHEN 0 THEN 1 - (y - r0) ELSE y - r0 END) * (CASE j WHEN 0 THEN 1 - (x - c0) ELSE x - c0 END) AS w FROM q), "
        "g AS (SELECT row, col, avg(value) AS value FROM px GROUP BY ALL), u AS (SELECT id, h, sum(w * value) AS u FROM w JOIN g ON g.row = r AND g.col = c GROUP BY ALL) SELECT id, round(u, 6) + 0.0 AS undulation, round(h - u, 6) + 0.0 AS height FROM u", **SC, **PX),
    "field_lookup": oracle(f"WITH f AS (SELECT id, ([{', '.join(map(quoted, ASKED))}])[seq % {len(ASKED)} + 1] AS field FROM boxes), e(name, domain, type, unit) AS (VALUES {ENTRIES}) SELECT id, field, domain, type, unit, domain IS NOT NULL AS known FROM f LEFT JOIN e ON field = name", **B),
}

#: Fourier transforms, eigenvectors and filter banks have no SQL; tests hold them to numpy.
QUERIES = {name: globals()[name] for name in [*ORACLES, "pol_touzi", "sar_multilook", "interp_polyphase"]}
