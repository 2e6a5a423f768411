"""Raster queries over 64-sample images."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbweave.operators import raster as R
from orbweave.plans.workspace import Workspace
from orbweave.queries.common import r6
from orbweave.sources.views import PIXELS, SCANS, load, oracle


def px(spark, sf):
    return load(spark, sf, PIXELS)


def dims(spark, sf):
    return px(spark, sf).groupBy("image_id").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def out(df):
    return df.select("image_id", "row", "col", r6("value").alias("value"))


def stats_moments(spark, sf):
    m = R.moments(px(spark, sf))
    return m.select("image_id", "n", *[r6(c).alias(c) for c in ("mean", "variance", "std", "least", "most", "l2_norm")])


def stats_mad(spark, sf):
    return R.median_deviation(px(spark, sf)).select("image_id", *[r6(c).alias(c) for c in ("median", "mad", "mad_std")])


def stats_hist_percentile(spark, sf):
    return R.histogram_percentile(px(spark, sf), 90.0, -4.0, 4.0, 512).select("image_id", r6("percentile").alias("percentile"))


def image_stats(spark, sf):
    masked = px(spark, sf).where("value > 0").withColumn("value", R.to_decibels(F.col("value")))
    return R.moments(masked, ["image_id"]).select("image_id", "n", r6("mean").alias("mean"), r6("std").alias("std"))


def _norm(method):
    def run(spark, sf):
        return out(R.normalize(px(spark, sf), method))

    return run


normalize_minmax, normalize_zscore, normalize_unit, normalize_percentile, normalize_mad = map(_norm, ("minmax", "zscore", "unit_norm", "percentile", "mad"))


def normalize_fit(spark, sf):
    return R.fit_normalizer(px(spark, sf), "percentile").select("image_id", r6("shift").alias("shift"), r6("scale").alias("scale"))


def contrast_linear(spark, sf):
    return out(px(spark, sf).withColumn("value", R.linear_stretch(F.col("value"), -1.5, 2.0)))


def contrast_log(spark, sf):
    return out(px(spark, sf).withColumn("value", R.log_stretch(F.abs("value"), 0.1, 2.0)))


def contrast_gamma(spark, sf):
    return out(px(spark, sf).withColumn("value", R.gamma_correction(F.col("value"), 2.2)))


def contrast_sigmoid(spark, sf):
    return out(px(spark, sf).withColumn("value", R.sigmoid_stretch(F.col("value"), 0.5, 8.0)))


def contrast_nrl(spark, sf):
    return out(R.nrl_stretch(px(spark, sf).withColumn("value", F.abs("value")), 0.8, 99.0))


def contrast_mangis(spark, sf):
    return out(R.density_stretch(px(spark, sf)))


def contrast_pedf(spark, sf):
    return out(R.density_stretch(px(spark, sf), compress=True))


def _preset(name):
    def run(spark, sf):
        return out(R.density_stretch(px(spark, sf), **R.DENSITY_PRESETS[name]))

    return run


contrast_brighter, contrast_darker, contrast_high = map(_preset, ("brighter", "darker", "high_contrast"))


def contrast_gdm(spark, sf):
    return out(R.graze_stretch(px(spark, sf).withColumn("value", F.abs("value")), 30.0, 5.0))


def contrast_auto(spark, sf):
    return load(spark, sf, SCANS).select("filepath", R.recommended_contrast(F.col("modality")).alias("operator"))


def contrast_histeq(spark, sf):
    return out(R.histogram_equalize(px(spark, sf), 64))


def percentile_stretch(spark, sf):
    return out(R.normalize(px(spark, sf), "percentile"))


def to_decibels(spark, sf):
    return out(px(spark, sf).withColumn("value", R.to_decibels(F.col("value"))))


def clip_cast(spark, sf):
    return px(spark, sf).select("image_id", "row", "col", R.clip_cast(F.col("value") * 100 + 128).alias("value"))


def nan_safe_stats(spark, sf):
    p = px(spark, sf).groupBy("image_id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", F.lit(0.99)).alias("p99"))
    return p.select("image_id", *[r6(c).alias(c) for c in ("least", "most", "p99")])


def tile_positions(spark, sf):
    return R.tile_positions(dims(spark, sf), 24, 16)


def tile_partition(spark, sf):
    return R.partition_positions(dims(spark, sf), 24)


def chip_at_point(spark, sf):
    p = px(spark, sf)
    return p.select("image_id", "row", "col", *R.chip_at_point(F.col("row") + 0.5, F.col("col") + 0.5, 9, 12, 64, 64))


def read_chip(spark, sf):
    return out(px(spark, sf).where("row >= 8 and row < 24 and col >= 16 and col < 40"))


def filter_mean(spark, sf):
    return out(R.box_mean(px(spark, sf), 1))


def filter_min(spark, sf):
    return out(R.erode(px(spark, sf), 1))


def filter_max(spark, sf):
    return out(R.dilate(px(spark, sf), 1))


def filter_stddev(spark, sf):
    return out(R.local_std(px(spark, sf), 1))


def filter_median(spark, sf):
    return out(R.median_filter(px(spark, sf), 1))


def filter_gaussian(spark, sf):
    return out(R.gaussian(px(spark, sf), 0.7, 3.0))


def filter_lee(spark, sf):
    return out(R.lee_filter(px(spark, sf).withColumn("value", F.abs("value")), 1, 4.0))


def filter_enhanced_lee(spark, sf):
    return out(R.enhanced_lee_filter(px(spark, sf).withColumn("value", F.abs("value")), 1, 4.0))


def filter_enl(spark, sf):
    return R.looks(px(spark, sf).withColumn("value", F.abs("value")), 1).select("image_id", r6("enl", 4).alias("enl"))


def cfar_ca(spark, sf):
    hits = R.cell_averaging(px(spark, sf), 1, 2, 0.05)
    return hits.select("image_id", "row", "col", r6("threshold", 4).alias("threshold"), "hit")


def cfar_exponential(spark, sf):
    hits = R.cell_averaging(px(spark, sf).withColumn("value", F.abs("value")), 1, 2, 0.1, "exponential")
    return hits.select("image_id", "row", "col", r6("threshold", 4).alias("threshold"), "hit")


def cfar_os(spark, sf):
    hits = R.ordered_statistic(px(spark, sf).withColumn("value", F.abs("value")), 1, 75.0, 1.2)
    return hits.select("image_id", "row", "col", r6("threshold").alias("threshold"), "hit")


def cfar_detect(spark, sf):
    """Cell averaging, then connected hits of at least two pixels."""
    hits = R.cell_averaging(px(spark, sf), 1, 2, 0.2).where("hit").select("image_id", "row", "col", "value")
    return R.detections(R.label_hits(hits, Workspace(spark)), 2).select("image_id", F.col("label").cast("long").alias("label"), "pixels", r6("mean_value").alias("mean_value"), "min_row", "max_row", "min_col", "max_col")


def _asked(spark, sf, fr, fc):
    p = px(spark, sf)
    return p.select("image_id", (F.col("row") * 64 + F.col("col")).alias("id"), (F.col("row") * 0.9 + fr).alias("r"), (F.col("col") * 0.95 + fc).alias("c"))


def ortho_bilinear(spark, sf):
    return R.bilinear(px(spark, sf), _asked(spark, sf, 0.3, 0.6)).select("image_id", "id", r6("value").alias("value"))


def ortho_nearest(spark, sf):
    return R.nearest(px(spark, sf), _asked(spark, sf, 0.3, 0.6)).select("image_id", "id", r6("value").alias("value"))


P = {"px": PIXELS}
CUT = "least(greatest({x}, 0::DOUBLE), 1::DOUBLE)"
D = "d AS (SELECT image_id, max(row) + 1 AS rows, 64 AS cols FROM px GROUP BY image_id)"


def around(half: int, source: str = "px") -> str:
    """Neighbour pairs (x, v) of every pixel with mirrored borders."""
    mirror = lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
    return (
        f"{D}, o AS (SELECT a.o AS dr, b.o AS dc FROM (SELECT unnest(range(-{half}, {half} + 1)) AS o) a, (SELECT unnest(range(-{half}, {half} + 1)) AS o) b), "
        f"n AS (SELECT p.image_id, p.row, p.col, p.value AS x, q.value AS v, o.dr, o.dc FROM {source} p JOIN d USING (image_id), o, {source} q "
        f"WHERE q.image_id = p.image_id AND q.row = {mirror('p.row + o.dr', 'd.rows')} AND q.col = {mirror('p.col + o.dc', 'd.cols')})"
    )


ABS = "ap AS (SELECT image_id, row, col, abs(value) AS value FROM px)"
LM = "m AS (SELECT image_id, row, col, any_value(x) AS x, avg(v) AS mean, greatest(avg(v * v) - avg(v) * avg(v), 0) AS var FROM n GROUP BY ALL)"
LM = LM.replace(", any_value(x) AS x", ", x")


def norm_sql(shift: str, scale: str, value: str = "value") -> str:
    return oracle(f"WITH s AS (SELECT image_id, {shift} AS a, {scale} AS b FROM px GROUP BY image_id) SELECT image_id, row, col, round(CASE WHEN b < 1e-10 THEN 0 ELSE ({value} - a) / b END, 6) + 0.0 AS value FROM px JOIN s USING (image_id)", **P)


def map_sql(value: str) -> str:
    return oracle(f"SELECT image_id, row, col, round({value}, 6) + 0.0::DOUBLE AS value FROM px", **P)


P2, P98 = "quantile_cont(value, 0.02)", "quantile_cont(value, 0.98)"
DENSITY = "WITH s AS (SELECT image_id, avg(abs(value)) AS mean FROM px GROUP BY image_id), k AS (SELECT image_id, row, col, ((255 - 30) / log10(40::DOUBLE) * log10(greatest(abs(value), 1e-5)) + 30 - (255 - 30) / log10(40::DOUBLE) * log10(0.8 * mean)) / 255 AS n FROM px JOIN s USING (image_id)) SELECT image_id, row, col, round({n}, 6) + 0.0 AS value FROM k"
MAD = "WITH a AS (SELECT image_id, median(value) AS median FROM px GROUP BY image_id), b AS (SELECT image_id, any_value(median) AS median, median(abs(value - median)) AS mad FROM px JOIN a USING (image_id) GROUP BY image_id)"
GAUSS = "exp(-0.5 * (dr * dr + dc * dc) / 0.49::DOUBLE)"
ASKED = "w AS (SELECT image_id, row * 64 + col AS id, row * 0.9::DOUBLE + 0.3::DOUBLE AS r, col * 0.95::DOUBLE + 0.6::DOUBLE AS c FROM px)"
HITS = "h AS MATERIALIZED (SELECT *, image_id * 1099511627776 + row * 1048576 + col AS id FROM hp WHERE hit), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM h a JOIN h b ON a.image_id = b.image_id AND ((a.row = b.row AND abs(a.col - b.col) = 1) OR (a.col = b.col AND abs(a.row - b.row) = 1)))"

ORACLES = {
    "stats_moments": oracle("SELECT image_id, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS least, round(max(value), 6) AS most, round(sqrt(sum(value * value)), 6) AS l2_norm FROM px GROUP BY image_id", **P),
    "stats_mad": oracle(f"{MAD} SELECT image_id, round(median, 6) + 0.0 AS median, round(mad, 6) AS mad, round(mad * 1.4826::DOUBLE, 6) AS mad_std FROM b", **P),
    "stats_hist_percentile": oracle("WITH b AS (SELECT image_id, least(greatest(floor((value + 4) / 0.015625::DOUBLE), 0), 511)::INT AS bin, count(*) AS n FROM px GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY bin) AS e, sum(n) OVER (PARTITION BY image_id) * 0.9::DOUBLE AS want FROM b), h AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY bin) AS r FROM c WHERE e >= want) SELECT image_id, round(-4 + (bin + (want - (e - n)) / n) * 0.015625::DOUBLE, 6) + 0.0 AS percentile FROM h WHERE r = 1", **P),
    "image_stats": oracle("WITH t AS (SELECT image_id, 20 * log10(greatest(abs(value), 1e-10)) AS v FROM px WHERE value > 0) SELECT image_id, count(*) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_pop(v), 6) AS std FROM t GROUP BY image_id", **P),
    "normalize_minmax": norm_sql("min(value)", "max(value) - min(value)"),
    "normalize_zscore": norm_sql("avg(value)", "stddev_pop(value)"),
    "normalize_unit": norm_sql("0", "sqrt(sum(value * value))"),
    "normalize_percentile": norm_sql(P2, f"{P98} - {P2}", "least(greatest(value, a), a + b)"),
    "normalize_mad": oracle(f"{MAD} SELECT image_id, row, col, round((value - median) / (1.4826::DOUBLE * mad), 6) + 0.0 AS value FROM px JOIN b USING (image_id)", **P),
    "normalize_fit": oracle(f"SELECT image_id, round({P2}, 6) + 0.0 AS shift, round({P98} - {P2}, 6) + 0.0 AS scale FROM px GROUP BY image_id", **P),
    "contrast_linear": map_sql(CUT.format(x="(value + 1.5) / 3.5")),
    "contrast_log": map_sql("CASE WHEN value = 0 THEN 0 ELSE log2((least(greatest(abs(value), 0.1), 2) - 0.1) / 1.9 + 1) END"),
    "contrast_gamma": map_sql(f"pow({CUT.format(x='value')}, 1 / 2.2::DOUBLE)"),
    "contrast_sigmoid": map_sql(CUT.format(x=f"(1 / (1 + exp(-8 * ({CUT.format(x='value')} - 0.5))) - 1 / (1 + exp(4::DOUBLE))) / (1 / (1 + exp(-4::DOUBLE)) - 1 / (1 + exp(4::DOUBLE)))")),
    "contrast_nrl": oracle(f"WITH {ABS}, s AS (SELECT image_id, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.99) AS t FROM ap GROUP BY image_id) SELECT image_id, row, col, round(CASE WHEN lo = hi THEN 0 WHEN value <= t THEN CASE WHEN t > lo THEN 0.8::DOUBLE * {CUT.format(x='(value - lo) / (t - lo)')} ELSE 0 END WHEN t = hi THEN 0.8 ELSE log2((value - t) / (hi - t) + 1) * (1 - 0.8::DOUBLE) + 0.8 END, 6) + 0.0 AS value FROM ap JOIN s USING (image_id)", **P),
    "contrast_mangis": oracle(DENSITY.format(n=CUT.format(x="n")), **P),
    **{f"contrast_{n}": oracle(DENSITY.replace("(255 - 30)", f"(255 - {d})").replace("+ 30 -", f"+ {d} -").replace("40::DOUBLE", f"{m}::DOUBLE").format(n=CUT.format(x="n")), **P) for n, d, m in (("brighter", 60, 40), ("darker", 0, 40), ("high", 30, 4))},
    "contrast_gdm": oracle(f"WITH {ABS}, s AS (SELECT image_id, avg(value) AS mean, median(value) AS med FROM ap GROUP BY image_id), c AS (SELECT image_id, med * 0.77::DOUBLE AS a, med * pow(10::DOUBLE, 1.23::DOUBLE - 0.0422::DOUBLE * sin(radians(30)) / cos(radians(5)) - 1.95::DOUBLE * log10(med / mean)) AS b FROM s), r AS (SELECT *, 20 * log10(b / a) AS r FROM c), f AS (SELECT image_id, a * beta AS lo, b / beta AS hi FROM (SELECT *, pow(10::DOUBLE, CASE WHEN r < 24 THEN (r - 24) / 40 WHEN r > 40 THEN (r - 40) / 40 ELSE 0 END) AS beta FROM r)), k AS (SELECT image_id, row, col, (225 / log10(hi / lo) * (log10(greatest(value, 1e-5)) - log10(lo)) + 30) / 255 AS n FROM ap JOIN f USING (image_id)) SELECT image_id, row, col, round({CUT.format(x='n')}, 6) + 0.0 AS value FROM k", **P),
    "contrast_auto": oracle("SELECT filepath, CASE upper(coalesce(modality, '')) WHEN 'SAR' THEN 'brighter' WHEN 'EO' THEN 'gamma' ELSE 'percentile' END AS operator FROM scans", scans=SCANS),
    "contrast_pedf": oracle(DENSITY.format(n=CUT.format(x="CASE WHEN n > 0.5 THEN 0.5 * (n + 0.5) ELSE n END")), **P),
    "contrast_histeq": oracle("WITH s AS (SELECT image_id, min(value) AS lo, max(value) AS hi, count(*) AS total FROM px GROUP BY image_id), c AS (SELECT image_id, least(floor((value - lo) / ((hi - lo) / 64)), 63)::INT AS bin, count(*) AS n FROM px JOIN s USING (image_id) GROUP BY ALL), g AS (SELECT image_id, unnest(range(64)) AS bin FROM s), f AS (SELECT g.image_id, g.bin, sum(coalesce(n, 0)) OVER (PARTITION BY g.image_id ORDER BY g.bin) AS c FROM g LEFT JOIN c USING (image_id, bin)), k AS (SELECT image_id, row, col, total, least(greatest((value - lo) / ((hi - lo) / 64) - 0.5, 0), 63) AS pos FROM px JOIN s USING (image_id)) SELECT k.image_id, row, col, round((a.c + (coalesce(b.c, a.c) - a.c) * (pos - floor(pos))) / total, 6) + 0.0 AS value FROM k JOIN f a ON a.image_id = k.image_id AND a.bin = floor(pos) LEFT JOIN f b ON b.image_id = k.image_id AND b.bin = floor(pos) + 1", **P),
    "percentile_stretch": norm_sql(P2, f"{P98} - {P2}", "least(greatest(value, a), a + b)"),
    "to_decibels": map_sql("20 * log10(greatest(abs(value), 1e-10))"),
    "clip_cast": oracle("SELECT image_id, row, col, trunc(least(greatest(value * 100 + 128, 0), 255))::INT AS value FROM px", **P),
    "nan_safe_stats": oracle("SELECT image_id, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.99), 6) AS p99 FROM px GROUP BY image_id", **P),
    "tile_positions": oracle(f"WITH {D}, r AS (SELECT image_id, rows, cols, unnest(range(0, greatest(ceil((rows - 24) / 16.0), 0)::BIGINT + 1)) AS k FROM d) SELECT image_id, greatest(least(k * 16, rows - 24), 0)::INT AS row0, least(j * 16, 40)::INT AS col0 FROM r, (SELECT unnest(range(0, 4)) AS j)", **P),
    "tile_partition": oracle(f"WITH {D}, r AS (SELECT image_id, rows, unnest(range(0, rows, 24))::INT AS row0 FROM d) SELECT image_id, row0, least(row0 + 24, rows)::INT AS row1, col0::INT AS col0, least(col0 + 24, 64)::INT AS col1 FROM r, (SELECT unnest(range(0, 64, 24)) AS col0)", **P),
    "chip_at_point": oracle("WITH k AS (SELECT *, greatest(least(round_even(row + 0.5, 0)::INT - 4, 55), 0) AS r0, greatest(least(round_even(col + 0.5, 0)::INT - 6, 52), 0) AS c0 FROM px) SELECT image_id, row, col, r0::INT AS row0, (r0 + 9)::INT AS row1, c0::INT AS col0, (c0 + 12)::INT AS col1 FROM k", **P),
    "read_chip": oracle("SELECT image_id, row, col, round(value, 6) + 0.0 AS value FROM px WHERE row >= 8 AND row < 24 AND col >= 16 AND col < 40", **P),
    "filter_mean": oracle(f"WITH {around(1)} SELECT image_id, row, col, round(avg(v), 6) + 0.0 AS value FROM n GROUP BY ALL", **P),
    "filter_min": oracle(f"WITH {around(1)} SELECT image_id, row, col, round(min(v), 6) + 0.0 AS value FROM n GROUP BY ALL", **P),
    "filter_max": oracle(f"WITH {around(1)} SELECT image_id, row, col, round(max(v), 6) + 0.0 AS value FROM n GROUP BY ALL", **P),
    "filter_stddev": oracle(f"WITH {around(1)}, {LM} SELECT image_id, row, col, round(sqrt(var), 6) + 0.0 AS value FROM m", **P),
    "filter_median": oracle(f"WITH {around(1)} SELECT image_id, row, col, round(median(v), 6) + 0.0 AS value FROM n GROUP BY ALL", **P),
    "filter_gaussian": oracle(f"WITH {around(2)} SELECT image_id, row, col, round(sum(v * {GAUSS}) / sum({GAUSS}), 6) + 0.0 AS value FROM n GROUP BY ALL", **P),
    "filter_lee": oracle(f"WITH {ABS}, {around(1, 'ap')}, {LM} SELECT image_id, row, col, round(mean + CASE WHEN var > 0 THEN {CUT.format(x='1 - 0.25 / (var / (mean * mean))')} ELSE 0 END * (x - mean), 6) + 0.0 AS value FROM m", **P),
    "filter_enhanced_lee": oracle(f"WITH {ABS}, {around(1, 'ap')}, {LM}, c AS (SELECT *, sqrt(var) / mean AS ci FROM m) SELECT image_id, row, col, round(CASE WHEN ci <= 0.5 THEN mean WHEN ci >= sqrt(1.5) THEN x ELSE mean * exp(-(ci - 0.5) / (sqrt(1.5) - ci)) + x * (1 - exp(-(ci - 0.5) / (sqrt(1.5) - ci))) END, 6) + 0.0 AS value FROM c", **P),
    "filter_enl": oracle(f"WITH {ABS}, {around(1, 'ap')}, {LM}, c AS (SELECT *, var / (mean * mean) AS ci2 FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ci2) AS r, count(*) OVER (PARTITION BY image_id) AS k FROM c) SELECT image_id, round(1 / avg(ci2), 4) AS enl FROM r WHERE r <= greatest(floor(k * 0.1), 1) GROUP BY image_id", **P),
    "cfar_ca": oracle(f"WITH {around(2)}, s AS (SELECT image_id, row, col, x, avg(v) AS mean, stddev_pop(v) AS std FROM n WHERE abs(dr) > 1 OR abs(dc) > 1 GROUP BY ALL) SELECT image_id, row, col, round(mean + 1.6448536269514722::DOUBLE * std, 4) + 0.0 AS threshold, x > mean + 1.6448536269514722::DOUBLE * std AS hit FROM s", **P),
    "cfar_exponential": oracle(f"WITH {ABS}, {around(2, 'ap')}, s AS (SELECT image_id, row, col, x, avg(v) * 16 * (pow(0.1::DOUBLE, -1 / 16::DOUBLE) - 1) AS t FROM n WHERE abs(dr) > 1 OR abs(dc) > 1 GROUP BY ALL) SELECT image_id, row, col, round(t, 4) + 0.0 AS threshold, x > t AS hit FROM s", **P),
    "cfar_os": oracle(f"WITH {ABS}, {around(1, 'ap')}, s AS (SELECT image_id, row, col, x, list_sort(list(v))[7] * 1.2::DOUBLE AS t FROM n GROUP BY ALL) SELECT image_id, row, col, round(t, 6) + 0.0 AS threshold, x > t AS hit FROM s", **P),
    "cfar_detect": oracle(f"WITH {around(2)}, hp AS (SELECT image_id, row, col, x AS value, x > avg(v) + 0.8416212335729143::DOUBLE * stddev_pop(v) AS hit FROM n WHERE abs(dr) > 1 OR abs(dc) > 1 GROUP BY image_id, row, col, x), {HITS}, r AS (SELECT id AS n, id AS m FROM h UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a WHERE e.b < r.m OR true), c AS (SELECT n, min(m) AS label FROM r GROUP BY n) SELECT image_id, label, count(*) AS pixels, round(avg(value), 6) + 0.0 AS mean_value, min(row) AS min_row, max(row) AS max_row, min(col) AS min_col, max(col) AS max_col FROM c JOIN h ON h.id = c.n GROUP BY image_id, label HAVING count(*) >= 2", **P),
    "ortho_bilinear": oracle(f"WITH {ASKED}, k AS (SELECT w.image_id, w.id, count(p.value) AS n, sum(p.value * (CASE WHEN p.row = floor(r) THEN 1 - (r - floor(r)) ELSE r - floor(r) END) * (CASE WHEN p.col = floor(c) THEN 1 - (c - floor(c)) ELSE c - floor(c) END)) AS v FROM w LEFT JOIN px p ON p.image_id = w.image_id AND p.row BETWEEN floor(r) AND floor(r) + 1 AND p.col BETWEEN floor(c) AND floor(c) + 1 GROUP BY ALL) SELECT image_id, id, round(CASE WHEN n = 4 THEN v ELSE 0 END, 6) + 0.0 AS value FROM k", **P),
    "ortho_nearest": oracle(f"WITH {ASKED} SELECT w.image_id, w.id, round(coalesce(p.value, 0), 6) + 0.0 AS value FROM w LEFT JOIN px p ON p.image_id = w.image_id AND p.row = floor(r + 0.5) AND p.col = floor(c + 0.5)", **P),
}

QUERIES = {name: globals()[name] for name in ORACLES}
