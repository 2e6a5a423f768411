"""Catalog and product queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import catalog as C
from orbweave.operators import products as P
from orbweave.queries.common import r6
from orbweave.sources.views import PRODUCTS, SCANS, load, oracle

TARGET = "img_32"
LOCATED = "located AS (SELECT *, (south + north) / 2 AS lat, (west + east) / 2 AS lon FROM scans WHERE west IS NOT NULL AND error IS NULL)"
HAVERSINE = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))) / 1000"


def scans(spark, sf):
    return load(spark, sf, SCANS)


def products(spark, sf):
    return load(spark, sf, PRODUCTS)


def catalog_find_nearby(spark, sf):
    return C.find_nearby(scans(spark, sf), 10.0, 20.0, 1500.0).select("filepath", r6("distance_km").alias("distance_km"))


def catalog_filter(spark, sf):
    out = C.filter_scans(scans(spark, sf), modality="SAR", sensor="sat-3", start="1992-01-01", end="1998-12-31", bbox=(-100.0, -60.0, 100.0, 60.0), text="img_")
    return out.select("filepath", "modality", "sensor", "format")


def catalog_get(spark, sf):
    return scans(spark, sf).where(F.col("filepath") == TARGET).limit(1).select("seq", "filepath", "format")


def catalog_find_overlapping(spark, sf):
    return C.find_overlapping(scans(spark, sf), TARGET).select("filepath", r6("overlap").alias("overlap"))


def catalog_find_containing(spark, sf):
    return C.find_containing(scans(spark, sf), 12.25, 33.4).select("filepath")


def catalog_same_region(spark, sf):
    return C.find_same_region(scans(spark, sf), TARGET, 1200.0).select("filepath", r6("distance_km").alias("distance_km"))


def catalog_temporal_neighbors(spark, sf):
    return C.find_temporal_neighbors(scans(spark, sf), TARGET, 10.0).select("filepath", r6("delta_days").alias("delta_days"))


def catalog_colocated(spark, sf):
    out = C.find_colocated(scans(spark, sf), TARGET, 2000.0, 400.0)
    return out.select("filepath", r6("distance_km").alias("distance_km"), r6("offset_days").alias("offset_days"), "same_sensor", "same_modality")


def catalog_find_pairs(spark, sf):
    out = C.find_pairs(scans(spark, sf), 40.0, 500.0, cross_sensor=True)
    return out.select("a", "b", r6("distance_km").alias("distance_km"), r6("delta_days").alias("delta_days"))


def catalog_group_by_region(spark, sf):
    return C.group_by_region(scans(spark, sf), 25.0)


def catalog_statistics(spark, sf):
    out = C.statistics(scans(spark, sf))
    return out.select("kind", "value", "n", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "errors")


def catalog_upsert(spark, sf):
    old = scans(spark, sf)
    new = old.where("seq % 4 = 0").withColumn("format", F.concat("format", F.lit("2"))).withColumn("seq", F.col("seq") + 1)
    return C.upsert(old, new).select("filepath", "seq", "format")


def catalog_remove(spark, sf):
    return C.remove(scans(spark, sf), TARGET).groupBy("format").agg(F.count("*").alias("n"))


def catalog_all(spark, sf):
    return scans(spark, sf).select("seq", "filepath", r6("west").alias("west"), r6("north").alias("north"))


def catalog_geojson(spark, sf):
    out = C.to_geojson(scans(spark, sf))
    shape = F.from_json("feature", "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<filepath: string>")
    out = out.withColumn("f", shape)
    return out.select("seq", F.col("f.properties.filepath").alias("filepath"), F.size(F.col("f.geometry.coordinates")[0]).cast("long").alias("vertices"), r6(F.col("f.geometry.coordinates")[0][2][1]).alias("north"))


def catalog_latest(spark, sf):
    return C.latest_per(scans(spark, sf), "sensor").select("sensor", "filepath")


def bbox_overlap_fraction(spark, sf):
    rows = C.located(scans(spark, sf))
    f = C.overlap_fraction("west", "south", "east", "north", -20.0, -20.0, 20.0, 20.0, degenerate=float("inf"))
    return rows.select("filepath", r6(f).alias("fraction"))


def haversine(spark, sf):
    return C.located(scans(spark, sf)).select("filepath", r6(C.haversine("lat", "lon", 48.5, -3.25), 3).alias("meters"))


def products_query(spark, sf):
    return P.query(products(spark, sf), start="1993-01-01", end="1997-06-30", has_local=True, orbit_pass="ASCENDING", polarization="VV").select("product_name", "absolute_orbit")


def products_query_any(spark, sf):
    return P.query(products(spark, sf), start="", end=None, has_local=False, absolute_orbit=None, swath="IW2").select("product_name", "remote_url")


def products_topk(spark, sf):
    out = P.top(products(spark, sf), 25, bbox=(-90.0, -45.0, 90.0, 45.0))
    return out.select("product_name", "start_time")


def products_overlap(spark, sf):
    out = P.overlapping(products(spark, sf), (-10.0, -10.0, 30.0, 30.0))
    return out.select("product_name", "west", "south", "east", "north")


def products_merge_local(spark, sf):
    old = products(spark, sf)
    new = old.where("id % 3 <> 2").withColumn("local_path", F.concat(F.lit("/new/"), "id")).withColumn("remote_url", F.lit(None).cast("string")).withColumn("swath", F.lit("EW"))
    out = P.merge_local(old.where("id % 2 = 0"), new)
    return out.select("product_name", "local_path", "remote_url", "swath", "polarization")


def products_merge_remote(spark, sf):
    old = products(spark, sf)
    new = old.where("id % 3 <> 2").withColumn("polarization", F.lit("HV")).withColumn("remote_url", F.concat(F.lit("https://new.invalid/"), "id"))
    out = P.merge_remote(old.where("id % 2 = 0"), new)
    return out.select("product_name", "local_path", "remote_url", "polarization")


def products_summary(spark, sf):
    return P.summary(products(spark, sf))


def iso_datetime(spark, sf):
    p = products(spark, sf)
    return p.select("product_name", P.iso_datetime(F.substring("start_time", 1, 10)).alias("begin"), P.iso_datetime("stop_time").alias("end"))


S = {"scans": SCANS}
PR = {"products": PRODUCTS}
CORNERS = "corners AS (SELECT *, (regexp_extract_all(corner_coords, '-?[0-9]+'))::DOUBLE[] AS v FROM products), b AS (SELECT *, least(v[2], v[4], v[6], v[8]) AS west, least(v[1], v[3], v[5], v[7]) AS south, greatest(v[2], v[4], v[6], v[8]) AS east, greatest(v[1], v[3], v[5], v[7]) AS north FROM corners)"
PAIRS = f"pairs AS (SELECT a.seq AS a, b.seq AS b, {HAVERSINE.format(a='a.', b='b.')} AS d, a.datetime AS adt, b.datetime AS bdt, a.sensor AS asn, b.sensor AS bsn FROM located a JOIN located b ON a.seq < b.seq AND abs(a.lat - b.lat) < 0.5)"
T = f"t AS (SELECT * FROM scans WHERE filepath = '{TARGET}')"
TL = f"t AS (SELECT * FROM located WHERE filepath = '{TARGET}')"
DAYS = "abs(epoch_us(s.datetime) - epoch_us(t.datetime)) / 86400000000.0::DOUBLE"
NEAR_T = HAVERSINE.format(a="s.", b="t.")

ORACLES = {
    "catalog_find_nearby": oracle(f"WITH {LOCATED}, p AS (SELECT filepath, {HAVERSINE.format(a='s.', b='q.')} AS d FROM located s, (SELECT 10.0::DOUBLE AS lat, 20.0::DOUBLE AS lon) q) SELECT filepath, round(d, 6) AS distance_km FROM p WHERE d <= 1500", **S),
    "catalog_filter": oracle("SELECT filepath, modality, sensor, format FROM scans WHERE upper(modality) = 'SAR' AND contains(lower(sensor), 'sat-3') AND datetime >= TIMESTAMP '1992-01-01' AND datetime <= TIMESTAMP '1998-12-31' AND west <= 100 AND east >= -100 AND south <= 60 AND north >= -60", **S),
    "catalog_get": oracle(f"SELECT seq, filepath, format FROM scans WHERE filepath = '{TARGET}'", **S),
    "catalog_find_overlapping": oracle(f"WITH {LOCATED}, {TL}, o AS (SELECT s.filepath, greatest(0, least(s.east, t.east) - greatest(s.west, t.west)) * greatest(0, least(s.north, t.north) - greatest(s.south, t.south)) AS i, least((s.east - s.west) * (s.north - s.south), (t.east - t.west) * (t.north - t.south)) AS m FROM located s, t WHERE s.filepath <> t.filepath) SELECT filepath, round(least(1.0::DOUBLE, i / CASE WHEN m > 0 THEN m ELSE 1 END), 6) AS overlap FROM o WHERE i > 0", **S),
    "catalog_find_containing": oracle(f"WITH {LOCATED} SELECT filepath FROM located WHERE west <= 33.4 AND east >= 33.4 AND south <= 12.25 AND north >= 12.25", **S),
    "catalog_same_region": oracle(f"WITH {LOCATED}, {TL}, d AS (SELECT s.filepath, {NEAR_T} AS d FROM located s, t WHERE s.filepath <> t.filepath) SELECT filepath, round(d, 6) AS distance_km FROM d WHERE d <= 1200", **S),
    "catalog_temporal_neighbors": oracle(f"WITH {T}, d AS (SELECT s.filepath, {DAYS} AS d FROM scans s, t WHERE s.filepath <> t.filepath) SELECT filepath, round(d, 6) AS delta_days FROM d WHERE d <= 10", **S),
    "catalog_colocated": oracle(f"WITH {LOCATED}, {TL}, d AS (SELECT s.filepath, {NEAR_T} AS d, {DAYS} AS o, coalesce(s.sensor = t.sensor, false) AS same_sensor, coalesce(s.modality = t.modality, false) AS same_modality FROM located s, t WHERE s.filepath <> t.filepath) SELECT filepath, round(d, 6) AS distance_km, round(o, 6) AS offset_days, same_sensor, same_modality FROM d WHERE d <= 2000 AND coalesce(o <= 400, true)", **S),
    "catalog_find_pairs": oracle(f"WITH {LOCATED}, {PAIRS}, q AS (SELECT *, abs(epoch_us(adt) - epoch_us(bdt)) / 86400000000.0::DOUBLE AS dd FROM pairs) SELECT a, b, round(d, 6) AS distance_km, round(dd, 6) AS delta_days FROM q WHERE d <= 40 AND coalesce(dd <= 500, true) AND NOT coalesce(asn = bsn, false)", **S),
    "catalog_group_by_region": oracle(f"WITH {LOCATED}, {PAIRS}, e AS MATERIALIZED (SELECT a, b FROM pairs WHERE d <= 25 UNION SELECT b, a FROM pairs WHERE d <= 25), r AS (SELECT seq AS n, seq AS m FROM located UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a), c AS (SELECT n AS seq, min(m) AS cluster FROM r GROUP BY n) SELECT seq, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM c", **S),
    "catalog_statistics": oracle("WITH k AS (SELECT coalesce(nullif(modality, ''), 'Unknown') AS modality, coalesce(nullif(sensor, ''), 'Unknown') AS sensor, coalesce(nullif(format, ''), 'Unknown') AS format, datetime, error FROM scans), u AS (SELECT 'all' AS kind, '' AS value, * FROM k UNION ALL SELECT 'modality', modality, * FROM k UNION ALL SELECT 'sensor', sensor, * FROM k UNION ALL SELECT 'format', format, * FROM k) SELECT kind, value, count(*) AS n, min(datetime)::VARCHAR AS first, max(datetime)::VARCHAR AS last, count(nullif(error, ''))::BIGINT AS errors FROM u GROUP BY ALL", **S),
    "catalog_upsert": oracle("SELECT filepath, CASE WHEN seq % 4 = 0 THEN seq + 1 ELSE seq END AS seq, CASE WHEN seq % 4 = 0 THEN format || '2' ELSE format END AS format FROM scans", **S),
    "catalog_remove": oracle(f"SELECT format, count(*) AS n FROM scans WHERE filepath <> '{TARGET}' GROUP BY format", **S),
    "catalog_all": oracle("SELECT seq, filepath, round(west, 6) AS west, round(north, 6) AS north FROM scans", **S),
    "catalog_geojson": oracle("SELECT seq, filepath, 5::BIGINT AS vertices, round(north, 6) AS north FROM scans WHERE west IS NOT NULL", **S),
    "catalog_latest": oracle("SELECT sensor, filepath FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY datetime DESC NULLS LAST, seq) AS r FROM scans) WHERE r = 1", **S),
    "bbox_overlap_fraction": oracle(f"WITH {LOCATED} SELECT filepath, round(CASE WHEN least((east - west) * (north - south), 1600) > 0 THEN least(1.0::DOUBLE, greatest(0, least(east, 20) - greatest(west, -20)) * greatest(0, least(north, 20) - greatest(south, -20)) / least((east - west) * (north - south), 1600)) ELSE 0 END, 6) AS fraction FROM located", **S),
    "haversine": oracle(f"WITH {LOCATED} SELECT filepath, round({HAVERSINE.format(a='s.', b='q.')} * 1000, 3) AS meters FROM located s, (SELECT 48.5::DOUBLE AS lat, -3.25::DOUBLE AS lon) q", **S),
    "products_query": oracle("SELECT product_name, absolute_orbit FROM products WHERE start_time >= '1993-01-01' AND stop_time <= '1997-06-30' AND local_path IS NOT NULL AND orbit_pass = 'ASCENDING' AND polarization = 'VV'", **PR),
    "products_query_any": oracle("SELECT product_name, remote_url FROM products WHERE local_path IS NULL AND swath = 'IW2'", **PR),
    "products_topk": oracle(f"WITH {CORNERS} SELECT product_name, start_time FROM b WHERE west <= 90 AND east >= -90 AND south <= 45 AND north >= -45 ORDER BY start_time DESC, product_name LIMIT 25", **PR),
    "products_overlap": oracle(f"WITH {CORNERS} SELECT product_name, west, south, east, north FROM b WHERE west <= 30 AND east >= -10 AND south <= 30 AND north >= -10", **PR),
    "products_merge_local": oracle("WITH n AS (SELECT * FROM products WHERE id % 3 <> 2), o AS (SELECT * FROM products WHERE id % 2 = 0) SELECT coalesce(n.product_name, o.product_name) AS product_name, CASE WHEN n.id IS NOT NULL THEN concat('/new/', n.id) ELSE o.local_path END AS local_path, o.remote_url AS remote_url, CASE WHEN n.id IS NOT NULL THEN 'EW' ELSE o.swath END AS swath, coalesce(n.polarization, o.polarization) AS polarization FROM n FULL JOIN o ON n.product_name = o.product_name", **PR),
    "products_merge_remote": oracle("WITH n AS (SELECT * FROM products WHERE id % 3 <> 2), o AS (SELECT * FROM products WHERE id % 2 = 0) SELECT coalesce(n.product_name, o.product_name) AS product_name, coalesce(o.local_path, CASE WHEN o.id IS NULL THEN n.local_path END) AS local_path, CASE WHEN n.id IS NOT NULL THEN concat('https://new.invalid/', n.id) ELSE o.remote_url END AS remote_url, coalesce(o.polarization, CASE WHEN n.id IS NOT NULL THEN 'HV' END) AS polarization FROM n FULL JOIN o ON n.product_name = o.product_name", **PR),
    "products_summary": oracle("SELECT orbit_pass, polarization, count(*) AS n, count(local_path) AS local, count(remote_url) AS remote, min(start_time) AS first, max(stop_time) AS last FROM products GROUP BY ALL", **PR),
    "iso_datetime": oracle("SELECT product_name, concat(substr(start_time, 1, 10), 'T00:00:00Z') AS begin, concat(stop_time, 'Z') AS \"end\" FROM products", **PR),
}

QUERIES = {name: globals()[name] for name in ORACLES}
