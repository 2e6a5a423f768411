"""Operators that SQL does not express, and the shared building blocks."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orbweave.functions import geo
from orbweave.operators import catalog, raster, signal, vector
from orbweave.plans.components import connected_components
from orbweave.plans.workspace import Workspace
from orbweave.sources import probe
from orbweave.streaming import stats


def pixels(spark, image):
    rows = [(1, r, c, float(v)) for r, line in enumerate(image) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "image_id long, row int, col int, value double")


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r["value"]
    return out


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()}
    assert {n: got.get(n, n) for n in parent} == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Workspace(spark)).count() == 0


def test_near_pairs_cross_poles_and_the_antimeridian(spark):
    rng = random.Random(2)
    points = [(i, rng.choice([89.9, -89.9, rng.uniform(-90, 90)]), rng.choice([-179.9, 179.9, rng.uniform(-180, 180)])) for i in range(150)]
    df = spark.createDataFrame(points, "seq long, lat double, lon double")
    got = {(r["a"], r["b"]) for r in catalog.near_pairs(df, 300.0).collect()}

    def km(p, q):
        la, lo, lb, mo = map(math.radians, (p[1], p[2], q[1], q[2]))
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((mo - lo) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    assert got == {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and km(p, q) <= 300}


def test_filters_equal_numpy(spark):
    image = np.random.RandomState(42).rand(12, 17) * 200
    df, wide = pixels(spark, image), np.pad(image, 2, mode="symmetric")
    window = np.lib.stride_tricks.sliding_window_view(wide, (5, 5))
    assert np.allclose(array(raster.box_mean(df, 2), image.shape), window.mean(axis=(2, 3)))
    assert np.allclose(array(raster.erode(df, 2), image.shape), window.min(axis=(2, 3)))
    assert np.allclose(array(raster.dilate(df, 2), image.shape), window.max(axis=(2, 3)))
    assert np.allclose(array(raster.local_std(df, 2), image.shape), window.std(axis=(2, 3)))
    assert np.allclose(array(raster.median_filter(df, 2), image.shape), np.median(window, axis=(2, 3)))


def test_detection_finds_the_target(spark):
    image = np.full((40, 40), 10.0)
    image[18:22, 18:22] = 50.0
    hits = raster.cell_averaging(pixels(spark, image), 4, 8, 1e-3).where("hit")
    found = raster.detections(raster.label_hits(hits, Workspace(spark)), 4).collect()
    assert [(r["pixels"], r["min_row"], r["max_row"], r["min_col"], r["max_col"]) for r in found] == [(16, 18, 21, 18, 21)]
    flat = raster.cell_averaging(pixels(spark, np.full((20, 20), 10.0)), 1, 3).where("hit")
    assert flat.count() == 0
    with pytest.raises(ValueError):
        raster.false_alarm_factor(1e-300, 0, 1, "exponential")


def test_constant_images_normalise_to_zero(spark):
    df = pixels(spark, np.full((4, 5), 7.0))
    for method in ("minmax", "zscore", "percentile", "mad"):
        assert {r["value"] for r in raster.normalize(df, method).collect()} == {0.0}
    with pytest.raises(ValueError):
        raster.normalize(df, "other")


def test_coordinates_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(h)) for a, b, h in zip(rng.uniform(-89, 89, 200), rng.uniform(-179, 179, 200), rng.uniform(-100, 9000, 200), strict=True)]
    df = spark.createDataFrame(rows, "lat double, lon double, h double")
    back = geo.ecef_to_geodetic(*geo.geodetic_to_ecef("lat", "lon", "h"))
    turn = geo.enu_to_geodetic(*geo.geodetic_to_enu("lat", "lon", "h", 12.0, 34.0, 5.0), 12.0, 34.0, 5.0)
    for b in (back, turn):
        off = df.select(*[F.max(F.abs(x - F.col(c))).alias(c) for x, c in zip(b, ("lat", "lon", "h"), strict=True)]).first()
        assert off["lat"] < 1e-6 and off["lon"] < 1e-9 and off["h"] < 1e-2


def test_joins_validate_and_report_pairs_once(spark):
    boxes = spark.createDataFrame([(i, float(i % 5) * 10, float(i // 5) * 10, i % 5 * 10 + 25.0, i // 5 * 10 + 25.0) for i in range(25)], "id long, minx double, miny double, maxx double, maxy double")
    pairs = vector.intersecting_boxes(boxes, boxes, 7.0)
    plain = boxes.alias("l").join(boxes.alias("r"), F.expr("l.minx <= r.maxx and l.maxx >= r.minx and l.miny <= r.maxy and l.maxy >= r.miny"))
    assert pairs.count() == plain.count() == pairs.select("l_id", "r_id").distinct().count()
    with pytest.raises(ValueError):
        vector.points_in_boxes(boxes, boxes, 1.0, "outer")


def test_hull_of_a_square():
    points = np.array([(x, y) for x in range(5) for y in range(5)], float)
    assert sorted(map(tuple, vector.hull(points))) == [(0, 0), (0, 4), (4, 0), (4, 4)]


def test_eigen_entropy_of_equal_powers(spark):
    columns = "k long, t11 double, t12_re double, t12_im double, t13_re double, t13_im double, t22 double, t23_re double, t23_im double, t33 double"
    df = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 2.0), (2, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], columns)
    got = {r["k"]: r["entropy"] for r in signal.eigen_entropy(df, ["k"]).collect()}
    assert math.isclose(got[1], 1.0) and abs(got[2]) < 1e-9


def test_subbands_cover_the_spectrum():
    assert signal.subbands(90, 3, 0.0) == [(0, 30), (30, 60), (60, 90)]
    bands = signal.subbands(100, 4, 0.5)
    assert bands[0][0] == 0 and bands[-1][1] == 100 and all(a[1] > b[0] for a, b in zip(bands, bands[1:], strict=False))


def test_sublook_energy_is_the_signal_s(spark):
    rng = np.random.default_rng(4)
    rows = [(k, t, float(a), float(b)) for k in range(3) for t, (a, b) in enumerate(rng.normal(size=(32, 2)))]
    lines = spark.createDataFrame(rows, "key long, t int, re double, im double")
    whole = {r["key"]: r["e"] for r in lines.groupBy("key").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("e")).collect()}
    parts = {r["key"]: r["p"] for r in signal.sublooks(lines, 4).groupBy("key").agg(F.sum("power").alias("p")).collect()}
    assert all(math.isclose(whole[k], parts[k], rel_tol=1e-9) for k in whole)


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    stats.drain(stats.tumbling(stream, "1 hour", "3650 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    # Append mode holds back windows that may still change.
    done = spark.read.parquet(str(tmp_path / "out")) if (tmp_path / "out").exists() else None
    assert done is not None
    query = stats.tumbling(stream, "1 hour", "3650 days").writeStream.outputMode("complete").format("memory").queryName("moments").trigger(availableNow=True).start()
    query.awaitTermination()
    key = ["start", "event_type"]
    both = spark.table("moments").alias("s").join(stats.tumbling(events, "1 hour").alias("b"), key, "full")
    assert both.where("s.n is distinct from b.n or abs(s.mean - b.mean) > 1e-9").count() == 0


def test_headers_and_formats(spark):
    df = spark.createDataFrame([(bytearray(b"NITF02.10"),), (bytearray(b"II*\x00"),), (bytearray(b"plain"),)], "b binary")
    assert [r[0] for r in df.select(probe.sniff(F.col("b"))).collect()] == ["NITF", "TIFF", "unknown"]
    one = spark.range(1).select(probe.parse_header(F.lit("A = 1\nb=x = y\na = 2")).alias("m")).first()["m"]
    assert one == {"a": "2", "b": "x = y"}


def test_catalog_upsert_and_remove(spark):
    columns = "filepath string, seq long, format string"
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], columns)
    new = spark.createDataFrame([("b", 3, "z"), ("b", 4, "w"), ("c", 5, "v")], columns)
    assert sorted(map(tuple, catalog.upsert(old, new).collect())) == [("a", 1, "x"), ("b", 4, "w"), ("c", 5, "v")]
    assert catalog.remove(old, "a").count() == 1


def test_workspace_tables_live_in_the_shared_folder(spark):
    ws = Workspace(spark)
    table = ws.save(spark.range(3), "numbers")
    assert table.count() == 3 and ws.root in table._orbweave_path
    ws.drop(table)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_are_not_broadcast(spark):
    """Neither side of the cube join goes through the driver, however small the tables seem."""
    rows = [(i, f"f{i}", None if i % 5 else "m", f"s{i % 3}", None, float(i), 0.0, float(i), 0.0, None) for i in range(20)]
    scans = spark.createDataFrame(rows, "seq long, filepath string, modality string, sensor string, datetime timestamp_ntz, west double, south double, east double, north double, error string")
    out = catalog.find_pairs(scans, 120.0, cross_sensor=True)
    assert "Broadcast" not in plan(out)
    assert {(r["a"], r["b"]) for r in out.collect()} == {(i, i + 1) for i in range(19)}


def test_box_joins_are_not_broadcast(spark):
    """The side with a row for every cell never goes through the driver."""
    df = spark.createDataFrame([(i, float(i), 0.0, i + 1.5, 9.0) for i in range(20)], "seq long, minx double, miny double, maxx double, maxy double")
    out = vector.intersecting_boxes(df, df, 2.0).where("l_seq < r_seq")
    points = vector.points_in_boxes(df.selectExpr("seq", "minx as x", "miny as y"), df, 2.0, "left")
    assert "Broadcast" not in plan(out) and "Broadcast" not in plan(points)
    assert {(r["l_seq"], r["r_seq"]) for r in out.collect()} == {(i, i + 1) for i in range(19)} and points.count() == 39


def test_two_focus_places_take_few_distances(spark, monkeypatch):
    """The sum of distances is met, with far fewer distances than halving would take."""
    from orbweave.operators import placing

    asked = []
    distance = placing.geodesic_distance
    monkeypatch.setattr(placing, "geodesic_distance", lambda *x: (asked.append(np.size(x[-1])), distance(*x))[1])
    taken = []

    class Rows:
        """Stands for the exploded table, so that the batch function runs here."""

        dtypes, sparkSession = [("id", "long")], spark
        repartition = withColumn = select = lambda self, *_: self  # noqa: N815

        def mapInPandas(self, run, schema):  # noqa: N802
            taken.append(run)

    placing.two_focus_ellipse(Rows(), 6)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(600), "k": np.arange(600) % 6, "lat1": rng.uniform(-60, 60, 600), "lon1": rng.uniform(-179, 179, 600)})
    pdf = pdf.assign(lat2=pdf["lat1"] + 0.2, lon2=pdf["lon1"] + 0.3, total=90_000.0)
    (out,) = taken[0](iter([pdf]))
    assert sum(asked) < 40 * len(pdf)
    total = distance(pdf["lat1"], pdf["lon1"], out["lat"], out["lon"]) + distance(pdf["lat2"], pdf["lon2"], out["lat"], out["lon"])
    assert np.abs(total - 90_000).max() < 1e-5


@pytest.mark.parametrize("radius, spread, crowd", [(60.0, 4.0, 0), (60.0, 12.0, 0), (25.0, 90.0, 8), (0.001, 1e-4, 8)])
def test_regions_are_single_link_clusters(spark, monkeypatch, radius, spread, crowd):
    """Crowded and thin cubes, copies, poles and a place that is no number, without near pairs."""
    rng = random.Random(int(spread * 7))
    centres = [(rng.choice([0.0, 40.0, 89.0, -89.5]), rng.choice([0.0, 179.9, -60.0])) for _ in range(8)]
    points = [(a + rng.uniform(-spread, spread) / 4, o + rng.uniform(-spread, spread)) for a, o in rng.choices(centres, k=600)]
    points += rng.choices(points, k=60) + [(math.nan, 1.0), (math.nan, 1.0)]
    seqs = rng.sample(range(10_000), len(points))
    rows = [(s, a, o, a, o, None) for s, (a, o) in zip(seqs, points, strict=True)]
    scans = spark.createDataFrame(rows, "seq long, south double, west double, north double, east double, error string")
    monkeypatch.setattr(catalog, "CROWD", crowd)
    if radius > 1:
        monkeypatch.setattr(catalog, "near_pairs", lambda *_, **__: pytest.fail("listed all near pairs"))
    got = {r["seq"]: (r["cluster"], r["size"]) for r in catalog.group_by_region(scans, radius).collect()}

    lat, lon = np.radians(np.array(points)).T
    h = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    near = 2 * 6371 * np.arcsin(np.sqrt(np.minimum(1, h))) <= radius
    np.fill_diagonal(near, True)
    name = np.array(seqs)
    while True:
        after = np.where(near, name, 10_000).min(axis=1)
        if (after == name).all():
            break
        name = after
    sizes = {n: int((name == n).sum()) for n in set(name.tolist())}
    assert got == {s: (n, sizes[n]) for s, n in zip(seqs, name.tolist(), strict=True)}
