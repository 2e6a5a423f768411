"""Signal, header and stream queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orbweave.operators import raster as R
from orbweave.operators import signal as S
from orbweave.queries.common import r6
from orbweave.queries.raster import CUT, LM, around
from orbweave.queries.vector import coherency
from orbweave.sources import probe
from orbweave.sources.views import CPIXELS, PIXELS, SERIES, load, oracle
from orbweave.streaming import stats

COEFFICIENTS = [0.5, -1.25, 0.75, 0.1]


def series(spark, sf):
    return load(spark, sf, SERIES).select(F.col("user_id").alias("key"), "t", "value", "event_id")


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def poly1d(spark, sf):
    p = load(spark, sf, PIXELS)
    c = F.array(*map(F.lit, COEFFICIENTS))
    return p.select("image_id", "row", "col", r6(S.polynomial(c, F.col("value"))).alias("poly"), r6(S.polynomial(S.derivative(c), F.col("value"))).alias("slope"))


def poly2d(spark, sf):
    c = F.array(F.array(F.lit(1.0), F.lit(0.5)), F.array(F.lit(-0.25), F.lit(2.0)))
    return load(spark, sf, PIXELS).select("image_id", "row", "col", r6(S.polynomial_2d(c, F.col("value"), F.col("col") / 10)).alias("value"))


def _wanted(spark, sf):
    s = series(spark, sf)
    return s.select("key", F.col("event_id").alias("id"), (F.col("t") + 1.3).alias("x"))


def interp_linear(spark, sf):
    return S.resample(series(spark, sf), _wanted(spark, sf), 1, S.linear_weight).select("key", "id", r6("value", 4).alias("value"))


def interp_lanczos(spark, sf):
    return S.resample(series(spark, sf), _wanted(spark, sf), 3, S.lanczos_weight(3)).select("key", "id", r6("value", 4).alias("value"))


def interp_lagrange(spark, sf):
    return S.resample(series(spark, sf), _wanted(spark, sf), 2, S.lagrange_weight(2)).select("key", "id", r6("value", 4).alias("value"))


def xyzpoly(spark, sf):
    p = load(spark, sf, PIXELS)
    three = {"x": [1.0, 0.5], "y": [0.25, -1.0, 2.0], "z": [0.0, 0.0, 1.0]}
    return p.select("image_id", "row", "col", *[r6(S.polynomial(F.array(*map(F.lit, c)), F.col("value"))).alias(k) for k, c in three.items()])


def cued_detect(spark, sf):
    """Detection inside a disc: thresholds see the whole image, hits only the disc."""
    hits = R.cell_averaging(load(spark, sf, PIXELS), 1, 2, 0.05)
    inside = (F.col("row") - 32) ** 2 + (F.col("col") - 32) ** 2 <= 400
    return hits.where(F.col("hit") & inside).select("image_id", "row", "col", r6("threshold", 4).alias("threshold"))


def filter_lee_complex(spark, sf):
    """Amplitude filtered, phase kept."""
    c = load(spark, sf, CPIXELS).select(F.floor(F.col("row") / 64).alias("image_id"), (F.col("row") % 64).cast("int").alias("row"), "col", F.col("vv_re").alias("re"), F.col("vv_im").alias("im"))
    out = R.lee_filter(c.withColumn("value", F.hypot("re", "im")), 1, 4.0)
    gain = F.col("value") / F.hypot("re", "im")
    return out.select("image_id", "row", "col", r6(F.col("re") * gain).alias("re"), r6(F.col("im") * gain).alias("im"))


def sar_dominance(spark, sf):
    looks = load(spark, sf, PIXELS).select((F.col("image_id") * 64 + F.col("row")).alias("key"), F.col("col").alias("look"), (F.col("value") * F.col("value")).alias("power"))
    out = S.dominance(looks, 3)
    return out.select("key", r6("dominance").alias("dominance"), r6("entropy").alias("entropy"))


def sar_doppler_centroid(spark, sf):
    lines = load(spark, sf, CPIXELS).select(F.col("row").alias("key"), F.col("col").alias("t"), F.col("hh_re").alias("re"), F.col("hh_im").alias("im"))
    return S.doppler_centroid(lines, 0.001).select("key", r6("hz", 4).alias("hz"))


def sar_sublook(spark, sf):
    lines = load(spark, sf, CPIXELS).select(F.col("row").alias("key"), F.col("col").alias("t"), F.col("hh_re").alias("re"), F.col("hh_im").alias("im"))
    return S.sublooks(lines, 4).select("key", "look", r6("power").alias("power"))


def pol_haalpha(spark, sf):
    out = S.eigen_entropy(coherency(spark, sf), ["block", "col"])
    return out.select("block", "col", *[r6(c).alias(c) for c in ("entropy", "alpha", "anisotropy")])


def sniff(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", probe.sniff(F.col("html")).alias("format"))


def parse_header(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    text = F.concat(F.lit("ENVI\nSamples = "), "p_size", F.lit("\nband names="), "p_brand", F.lit("\nsamples = "), F.col("p_size") + 1, F.lit("\n"))
    m = probe.parse_header(text)
    return p.select("p_partkey", m["samples"].cast("long").alias("samples"), m["band names"].alias("names"), F.size(m).cast("long").alias("n"))


def classify_modality(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", probe.classify_modality(F.col("p_size") % 20, F.when(F.col("p_partkey") % 9 == 0, "complex64").otherwise("uint8"), F.col("p_type")).alias("modality"))


def factor_candidates(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", F.size(probe.factors(F.col("p_partkey"), 100)).cast("long").alias("n"), F.array_max(probe.factors(F.col("p_partkey"), 100)).cast("long").alias("most"))


def parse_datetime(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("d")).when(F.col("o_orderkey") % 3 == 1, F.regexp_replace("d", "-", "")).otherwise("n/a")
    return o.select("o_orderkey", F.date_format(probe.parse_datetime(text), "yyyy-MM-dd").alias("parsed"))


def stats_tumbling(spark, sf):
    out = stats.tumbling(events(spark, sf), "1 hour")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", *[r6(c).alias(c) for c in ("mean", "variance", "least", "most")])


def stats_sliding(spark, sf):
    out = stats.sliding(events(spark, sf), "2 hours", "30 minutes")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", r6("mean").alias("mean"))


def stats_sessions(spark, sf):
    out = stats.sessions(events(spark, sf), "30 minutes")
    return out.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n", r6("total").alias("total"))


def pipeline_filters(spark, sf):
    """Filters chained into one plan."""
    out = load(spark, sf, PIXELS)
    for step in (lambda d: R.box_mean(d, 1), lambda d: R.dilate(d, 1), lambda d: R.normalize(d, "minmax")):
        out = out.transform(step)
    return out.select("image_id", "row", "col", r6("value").alias("value"))


def interp_kaiser(spark, sf):
    return S.resample(series(spark, sf), _wanted(spark, sf), 4, S.kaiser_weight(4, 5.0)).select("key", "id", r6("value", 4).alias("value"))


def interp_thiran(spark, sf):
    lines = load(spark, sf, PIXELS).select((F.col("image_id") * 64 + F.col("row")).alias("key"), F.col("col").alias("t"), "value")
    return S.thiran_delay(lines, 3.3, 3).select("key", "t", r6("value").alias("value"))


def orbit_spline(spark, sf):
    lines = load(spark, sf, PIXELS).select((F.col("image_id") * 64 + F.col("row")).alias("key"), F.col("col").cast("double").alias("t"), F.col("value").alias("x"), (F.col("value") * F.col("value")).alias("v"))
    wanted = lines.where("t < 63").select("key", (F.col("t") + 0.4).alias("t"))
    return S.orbit_spline(lines, wanted, ["x", "v"]).select("key", r6("t").alias("t"), r6("x").alias("x"), r6("v").alias("v"))


def synth_image(spark, sf):
    return probe.synthesize(spark, 64, 64).select("row", "col", r6("re").alias("re"), r6("im").alias("im"))


PX, CP, SE = {"px": PIXELS}, {"ch": CPIXELS}, {"s": SERIES}
PLACE = "r AS (SELECT user_id AS key, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t) - 1 AS k, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS next FROM s), w AS (SELECT user_id AS key, event_id AS id, t + 1.3::DOUBLE AS x FROM s), p AS (SELECT w.key, w.id, CASE WHEN r.next IS NOT NULL THEN r.k + (w.x - r.t) / (r.next - r.t) WHEN w.x = r.t THEN r.k END AS p FROM w ASOF LEFT JOIN r ON w.key = r.key AND w.x >= r.t)"
SINC = "CASE WHEN {d} = 0 THEN 1 ELSE sin(pi() * {d}) / (pi() * {d}) END"
DD = "(p.p - r.k)"


def weights(half, weight):
    return oracle(f"WITH {PLACE}, g AS (SELECT p.key, p.id, sum(({weight}) * r.value) AS s, sum({weight}) AS w FROM p LEFT JOIN r ON r.key = p.key AND r.k > floor(p.p) - {half} AND r.k <= floor(p.p) + {half} GROUP BY ALL) SELECT key, id, round(CASE WHEN w <> 0 THEN s / w ELSE 0 END, 4) + 0.0 AS value FROM g", **SE)


FR = "(p.p - floor(p.p))"
LAGRANGE = "CASE r.k - floor(p.p) " + " ".join(
    f"WHEN {k} THEN " + " * ".join(f"({FR} - ({j})) / ({k - j})::DOUBLE" for j in range(-1, 3) if j != k) for k in range(-1, 3)
) + " ELSE 0 END"
NARROW = around(1, "ap").replace("FROM px GROUP BY", "FROM ap GROUP BY").replace("64 AS cols", "8 AS cols")

#: The Kaiser window's power series over its value at the centre, by nested products.
BESSEL = "0"
for _k in reversed(range(24)):
    BESSEL = f"({BESSEL}) * YY + {1 / math.factorial(_k) ** 2!r}::DOUBLE"
BESSEL = f"({BESSEL}) / {sum((6.25**k) / math.factorial(k) ** 2 for k in range(24))!r}::DOUBLE".replace("YY", f"(6.25 * greatest(1 - ({DD}) * ({DD}) / 16.0::DOUBLE, 0))")

ORACLES = {
    "poly1d": oracle("SELECT image_id, row, col, round(0.5 + value * (-1.25::DOUBLE + value * (0.75::DOUBLE + value * 0.1::DOUBLE)), 6) + 0.0 AS poly, round(-1.25::DOUBLE + value * (1.5::DOUBLE + value * 0.3::DOUBLE), 6) + 0.0 AS slope FROM px", **PX),
    "poly2d": oracle("SELECT image_id, row, col, round(1 + 0.5::DOUBLE * (col / 10.0::DOUBLE) + value * (-0.25::DOUBLE + 2 * (col / 10.0::DOUBLE)), 6) + 0.0 AS value FROM px", **PX),
    "interp_linear": weights(1, f"greatest(1 - abs({DD}), 0)"),
    "interp_lanczos": weights(3, f"CASE WHEN abs({DD}) < 3 THEN ({SINC.format(d=DD)}) * ({SINC.format(d=f'({DD} / 3)')}) ELSE 0 END"),
    "interp_kaiser": weights(4, f"CASE WHEN abs({DD}) <= 4 THEN ({SINC.format(d=DD)}) * ({BESSEL}) ELSE 0 END"),
    "pipeline_filters": oracle(f"WITH m1 AS (WITH {around(1)} SELECT image_id, row, col, avg(v) AS value FROM n GROUP BY image_id, row, col), m2 AS (WITH {around(1, 'm1')} SELECT image_id, row, col, max(v) AS value FROM n GROUP BY image_id, row, col) SELECT image_id, row, col, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) + 0.0 AS value FROM m2 WINDOW w AS (PARTITION BY image_id)", **PX),
    "interp_lagrange": weights(2, LAGRANGE),
    "xyzpoly": oracle("SELECT image_id, row, col, round(1 + 0.5::DOUBLE * value, 6) + 0.0 AS x, round(0.25 - value + 2 * value * value, 6) + 0.0 AS y, round(value * value, 6) + 0.0 AS z FROM px", **PX),
    "cued_detect": oracle(f"WITH {around(2)}, s AS (SELECT image_id, row, col, x, avg(v) + 1.6448536269514722::DOUBLE * stddev_pop(v) AS t FROM n WHERE abs(dr) > 1 OR abs(dc) > 1 GROUP BY ALL) SELECT image_id, row, col, round(t, 4) + 0.0 AS threshold FROM s WHERE x > t AND (row - 32) * (row - 32) + (col - 32) * (col - 32) <= 400", **PX),
    "filter_lee_complex": oracle(f"WITH ap AS (SELECT row // 64 AS image_id, (row % 64)::INT AS row, col, sqrt(vv_re * vv_re + vv_im * vv_im) AS value, vv_re AS re, vv_im AS im FROM ch), {NARROW}, {LM}, f AS (SELECT image_id, row, col, x, mean + CASE WHEN var > 0 THEN {CUT.format(x='1 - 0.25 / (var / (mean * mean))')} ELSE 0 END * (x - mean) AS v FROM m) SELECT f.image_id, f.row, f.col, round(re * v / x, 6) + 0.0 AS re, round(im * v / x, 6) + 0.0 AS im FROM f JOIN ap USING (image_id, row, col)", **CP),
    "sar_dominance": oracle("WITH l AS (SELECT image_id * 64 + row AS key, col AS look, value * value AS power FROM px), k AS (SELECT *, sum(power) OVER (PARTITION BY key ORDER BY look ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s, sum(power) OVER (PARTITION BY key) AS t FROM l) SELECT key, round(max(CASE WHEN look <= 61 THEN s / t END), 6) AS dominance, round(-sum(CASE WHEN power > 0 THEN power / t * ln(power / t) ELSE 0 END), 6) AS entropy FROM k GROUP BY key", **PX),
    "sar_doppler_centroid": oracle("WITH k AS (SELECT row AS key, hh_re AS re, hh_im AS im, lag(hh_re) OVER w AS pr, lag(hh_im) OVER w AS pi FROM ch WINDOW w AS (PARTITION BY row ORDER BY col)) SELECT key, round(atan2(sum(im * pr - re * pi), sum(re * pr + im * pi)) / (2 * pi() * 0.001::DOUBLE), 4) + 0.0 AS hz FROM k WHERE pr IS NOT NULL GROUP BY key", **CP),
    "sniff": "SELECT page_id, CASE WHEN regexp_matches(lower(substr(html, 1, 64)), '^\\s*<(!doctype|html)') THEN 'HTML' WHEN regexp_matches(substr(html, 1, 64), '^\\s*<') THEN 'XML' ELSE 'unknown' END AS format FROM pages",
    "parse_header": "SELECT p_partkey, (p_size + 1)::BIGINT AS samples, p_brand AS names, 2::BIGINT AS n FROM part",
    "classify_modality": "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'sar|slc|sicd') THEN 'SAR' WHEN p_partkey % 9 = 0 THEN 'SAR' WHEN regexp_matches(lower(p_type), 'thermal|ir') THEN 'IR' WHEN p_size % 20 >= 16 THEN 'HSI' WHEN p_size % 20 > 4 THEN 'MSI' WHEN p_size % 20 >= 3 THEN 'EO' ELSE 'PAN' END AS modality FROM part",
    "factor_candidates": "SELECT p_partkey, count(*) AS n, max(k)::BIGINT AS most FROM part, (SELECT unnest(range(1, 101)) AS k) WHERE p_partkey % k = 0 GROUP BY p_partkey",
    "parse_datetime": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders",
    "stats_tumbling": "SELECT floor(epoch(ts) / 3600)::BIGINT * 3600 AS start, event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) AS variance, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY ALL",
    "stats_sliding": "WITH k AS (SELECT *, unnest(range(0, 4)) AS k FROM events) SELECT (floor(epoch(ts) / 1800)::BIGINT - k) * 1800 AS start, event_type, count(value) AS n, round(avg(value), 6) + 0.0 AS mean FROM k GROUP BY ALL",
    "stats_sessions": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)) + 1800)::BIGINT AS \"end\", count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM s GROUP BY user_id, s",
}

QUERIES = {name: globals()[name] for name in [*ORACLES, "sar_sublook", "pol_haalpha", "synth_image", "interp_thiran", "orbit_spline"]}
