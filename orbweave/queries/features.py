"""Feature, detection, grid and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import features as T
from orbweave.operators import gmti as M
from orbweave.operators import raster as R
from orbweave.operators import vector as V
from orbweave.operators.products import query
from orbweave.queries.common import r6
from orbweave.queries.raster import dims
from orbweave.queries.vector import AT_LON, RING, WRAP
from orbweave.sources.views import BOXES, CPIXELS, PIXELS, POINTS, PRODUCTS, TARGETS, load, oracle


def features(spark, sf):
    p = load(spark, sf, POINTS)
    properties = F.map_filter(F.create_map(F.lit("nation"), F.col("nation").cast("string"), F.lit("class"), F.when(F.col("seq") % 3 == 0, "big")), lambda _, v: v.isNotNull())
    return p.select("seq", F.when(F.col("seq") % 5 != 0, F.col("id")).alias("id"), "x", "y", properties.alias("properties"))


def geojson_round_trip(spark, sf):
    out = T.from_geojson(T.to_geojson(features(spark, sf)))
    return out.select("seq", "id", "x", "y", out.properties["nation"].alias("nation"), out.properties["class"].alias("kind"))


def features_to_detections(spark, sf):
    return T.property_names(features(spark, sf))


def property_merge(spark, sf):
    f = features(spark, sf)
    m = T.merged_properties(f.properties, F.create_map(F.lit("class"), F.lit("right"), F.lit("extra"), F.lit("yes")))
    return f.select("seq", m["class"].alias("kind"), m["extra"].alias("extra"), F.size(m).cast("long").alias("n"))


def detections(spark, sf):
    d = M.to_detections(load(spark, sf, TARGETS))
    return d.select("seq", "confidence", F.create_map(F.lit("dwell"), F.col("dwell_index").cast("string")).alias("properties"), "at_lat", "at_lon")


def detections_to_features(spark, sf):
    out = T.detections_to_features(detections(spark, sf))
    return out.select("seq", "id", F.size("properties").cast("long").alias("n"), out.properties["dwell"].alias("dwell"))


def detection_filter_conf(spark, sf):
    return T.filter_confidence(detections(spark, sf), 0.5).select("seq")


def detection_filter_region(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    return detections(spark, sf).where(V.inside_ring(F.col("at_lon"), F.col("at_lat"), ring)).select("seq")


def perimeter_samples(spark, sf):
    out = T.perimeter(dims(spark, sf), 10)
    return out.select("image_id", "edge", "k", r6("row").alias("row"), r6("col").alias("col"))


def grid_geographic(spark, sf):
    return T.geographic_grid(spark, -10.0, 20.0, 30.0, 75.0, 0.5, 0.75).select("row", "col", "lat", "lon")


def grid_enu(spark, sf):
    return T.enu_grid(spark, 10.0, 20.0, 5000.0, 250.0).select("row", "col", r6("lat").alias("lat"), r6("lon").alias("lon"))


def coreg_ratio_test(spark, sf):
    b = load(spark, sf, BOXES).select("id", F.col("minx").alias("x"), F.col("miny").alias("y"))
    return T.ratio_matches(load(spark, sf, POINTS).select("id", "x", "y"), b, 60.0).select("a", "b", r6("distance").alias("distance"))


def burn_shape(spark, sf):
    p = load(spark, sf, PIXELS)
    mask = (F.col("row") - 32) * (F.col("row") - 32) + (F.col("col") - 32) * (F.col("col") - 32) <= 400
    return p.select("image_id", "row", "col", r6(T.blend(F.col("value"), mask, 1.0, 0.4)).alias("value"))


def cpx(spark, sf):
    return load(spark, sf, CPIXELS).select(F.floor(F.col("row") / 64).alias("image_id"), (F.col("row") % 64).cast("int").alias("row"), "col", F.col("vv_re").alias("re"), F.col("vv_im").alias("im"))


def filter_phase_gradient(spark, sf):
    out = T.phase_gradient(cpx(spark, sf), "col")
    return out.select("image_id", "row", "col", r6("value").alias("value"))


def read_band(spark, sf):
    return load(spark, sf, CPIXELS).select("row", "col", r6("hv_re").alias("re"), r6("hv_im").alias("im"))


def global_pass(spark, sf):
    """Two passes: statistics of all images first, then every pixel against them."""
    p = load(spark, sf, PIXELS)
    whole = R.moments(p.withColumn("all", F.lit(0)), ["all"]).select("mean", "std")
    return p.join(F.broadcast(whole)).select("image_id", "row", "col", r6((F.col("value") - F.col("mean")) / F.col("std")).alias("value"))


def products_query_swath(spark, sf):
    return query(load(spark, sf, PRODUCTS), start="1994", swath="IW2", orbit_pass="DESCENDING").select("product_name", "swath")


def raster_to_points(spark, sf):
    out = V.raster_to_points(load(spark, sf, PIXELS), 0.1, 2)
    return out.select("image_id", "x", "y", r6("value").alias("value"))


PT, TG, PX, CP, B, PR = {"points": POINTS}, {"t": TARGETS}, {"px": PIXELS}, {"ch": CPIXELS}, {"boxes": BOXES}, {"products": PRODUCTS}
DET = f"k AS (SELECT *, coalesce(lat, center_lat + dlat * lat_scale) AS la, {AT_LON} AS lo FROM t), d AS (SELECT *, {WRAP.format(x='lo')} AS lon2, CASE WHEN snr IS NOT NULL THEN least(greatest(snr / 40, 0), 1) END AS confidence FROM k WHERE la IS NOT NULL AND lo IS NOT NULL)"
CROSS = " + ".join(f"CASE WHEN ({a[1]} > la) <> ({b[1]} > la) AND lon2 < ({b[0]} - {a[0]}) * (la - {a[1]}) / ({b[1]} - {a[1]})::DOUBLE + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(RING, RING[1:] + RING[:1], strict=True)).replace("- -", "+ ")

ORACLES = {
    "geojson_round_trip": oracle("SELECT seq, CASE WHEN seq % 5 <> 0 THEN id ELSE seq::VARCHAR END AS id, x, y, nation::VARCHAR AS nation, CASE WHEN seq % 3 = 0 THEN 'big' END AS kind FROM points", **PT),
    "features_to_detections": "SELECT unnest(['nation', 'class']) AS name",
    "property_merge": oracle("SELECT seq, CASE WHEN seq % 3 = 0 THEN 'big' ELSE 'right' END AS kind, 'yes' AS extra, 3::BIGINT AS n FROM points", **PT),
    "detections_to_features": oracle(f"WITH {DET} SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS id, CASE WHEN confidence IS NULL THEN 1 ELSE 2 END::BIGINT AS n, dwell_index::VARCHAR AS dwell FROM d", **TG),
    "detection_filter_conf": oracle(f"WITH {DET} SELECT seq FROM d WHERE confidence >= 0.5", **TG),
    "detection_filter_region": oracle(f"WITH {DET} SELECT seq FROM d WHERE ({CROSS}) % 2 = 1", **TG),
    "perimeter_samples": oracle("WITH d AS (SELECT image_id, max(row) AS r, 63 AS c FROM px GROUP BY image_id), e AS (SELECT *, unnest(range(0, 4)) AS edge FROM d), s AS (SELECT *, unnest(range(0, 10)) AS k FROM e) SELECT image_id, edge::INT AS edge, k::INT AS k, round(CASE edge WHEN 0 THEN 0 WHEN 1 THEN r * (k / 9::DOUBLE) WHEN 2 THEN r ELSE r * (1 - k / 9::DOUBLE) END, 6) + 0.0 AS row, round(CASE edge WHEN 0 THEN c * (k / 9::DOUBLE) WHEN 1 THEN c WHEN 2 THEN c * (1 - k / 9::DOUBLE) ELSE 0 END, 6) + 0.0 AS col FROM s", **PX),
    "grid_geographic": "SELECT row::INT AS row, col::INT AS col, 20 - row * 0.5::DOUBLE AS lat, 30 + col * 0.75::DOUBLE AS lon FROM (SELECT unnest(range(0, 60)) AS row), (SELECT unnest(range(0, 60)) AS col)",
    "coreg_ratio_test": oracle("WITH k AS (SELECT p.id AS a, b.id AS b, sqrt(pow(p.x - b.minx, 2) + pow(p.y - b.miny, 2)) AS d FROM points p, boxes b), n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r, lead(d) OVER (PARTITION BY a ORDER BY d, b) AS next FROM k WHERE d <= 60) SELECT a, b, round(d, 6) AS distance FROM n WHERE r = 1 AND (next IS NULL OR d < 0.75 * next)", **PT, **B),
    "burn_shape": oracle("SELECT image_id, row, col, round(CASE WHEN (row - 32) * (row - 32) + (col - 32) * (col - 32) <= 400 THEN value * 0.6::DOUBLE + 0.4::DOUBLE ELSE value END, 6) + 0.0 AS value FROM px", **PX),
    "filter_phase_gradient": oracle("WITH k AS (SELECT row // 64 AS image_id, (row % 64)::INT AS row, col, vv_re AS re, vv_im AS im, lead(vv_re) OVER w AS nr, lead(vv_im) OVER w AS ni FROM ch WINDOW w AS (PARTITION BY row ORDER BY col)), s AS (SELECT *, atan2(ni * re - nr * im, nr * re + ni * im) AS s FROM k) SELECT image_id, row, col, round(coalesce(s, lag(s) OVER (PARTITION BY image_id, row ORDER BY col)), 6) + 0.0 AS value FROM s", **CP),
    "read_band": oracle("SELECT row, col, round(hv_re, 6) + 0.0 AS re, round(hv_im, 6) + 0.0 AS im FROM ch", **CP),
    "global_pass": oracle("SELECT image_id, row, col, round((value - (SELECT avg(value) FROM px)) / (SELECT stddev_pop(value) FROM px), 6) + 0.0 AS value FROM px", **PX),
    "products_query_swath": oracle("SELECT product_name, swath FROM products WHERE start_time >= '1994' AND swath = 'IW2' AND orbit_pass = 'DESCENDING'", **PR),
    "raster_to_points": oracle("SELECT image_id, col AS x, row AS y, round(value, 6) + 0.0 AS value FROM px WHERE value >= 0.1 AND row % 2 = 0 AND col % 2 = 0", **PX),
}

QUERIES = {name: globals()[name] for name in [*ORACLES, "grid_enu"]}
