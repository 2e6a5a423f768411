"""Queries of an imagery catalog: filters, radius, overlap, time and pair search.

A catalog is a table of scans ``filepath, format, modality, sensor, datetime, west,
south, east, north, error``. Spatial operators see only located rows without error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geo import SPHERE_M, boxes_meet, haversine, overlap_fraction, unit_sphere
from orbweave.plans.components import connected_components
from orbweave.plans.workspace import Workspace


def located(scans: DataFrame) -> DataFrame:
    """Rows that spatial operators see, with ``lat, lon`` of their centres."""
    whole = F.col("west").isNotNull() & F.col("south").isNotNull() & F.col("east").isNotNull() & F.col("north").isNotNull()
    return scans.where(whole & F.col("error").isNull()).withColumn("lat", (F.col("south") + F.col("north")) / 2).withColumn("lon", (F.col("west") + F.col("east")) / 2)


def filter_scans(
    scans: DataFrame,
    modality: str | None = None,
    sensor: str | None = None,
    start: str | None = None,
    end: str | None = None,
    bbox: tuple[float, float, float, float] | None = None,
    format: str | None = None,
    text: str | None = None,
) -> DataFrame:
    """Rows that meet every predicate given; a null field fails its own predicate only."""
    out = scans
    if modality is not None:
        out = out.where(F.upper("modality") == modality.upper())
    if sensor is not None:
        out = out.where(F.lower("sensor").contains(sensor.lower()))
    if start is not None:
        out = out.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("datetime") <= F.lit(end).cast("timestamp_ntz"))
    if bbox is not None:
        out = out.where(boxes_meet("west", "south", "east", "north", *bbox))
    if format is not None:
        out = out.where(F.lower("format").contains(format.lower()))
    if text is not None:
        fields = F.concat_ws(" ", "filepath", "sensor", "format")
        out = out.where(F.lower(fields).contains(text.lower()))
    return out


def find_nearby(scans: DataFrame, lat: float, lon: float, radius_km: float = 100.0) -> DataFrame:
    """Scans whose centre lies within the radius, nearest first."""
    out = located(scans).withColumn("distance_km", haversine("lat", "lon", lat, lon) / 1000)
    return out.where(F.col("distance_km") <= radius_km).orderBy("distance_km")


def find_containing(scans: DataFrame, lat: float, lon: float) -> DataFrame:
    return located(scans).where(F.lit(lon).between(F.col("west"), F.col("east")) & F.lit(lat).between(F.col("south"), F.col("north")))


def _target(scans: DataFrame, filepath: str, columns: list[str]) -> DataFrame:
    """One row: the scan searched for, under names with a prefix."""
    one = scans.where(F.col("filepath") == filepath).limit(1)
    return F.broadcast(one.select(*[F.col(c).alias(f"t_{c}") for c in columns]))


def find_overlapping(scans: DataFrame, filepath: str, min_fraction: float = 0.0) -> DataFrame:
    """Scans that share more than the fraction of the smaller footprint with a scan."""
    box = ["west", "south", "east", "north"]
    target = _target(located(scans), filepath, ["filepath", *box])
    meet = boxes_meet(*box, *[f"t_{c}" for c in box]) & (F.col("filepath") != F.col("t_filepath"))
    out = located(scans).join(target, meet).withColumn("overlap", overlap_fraction(*box, *[f"t_{c}" for c in box]))
    return out.where(F.col("overlap") > min_fraction).orderBy(F.desc("overlap"))


def find_same_region(scans: DataFrame, filepath: str, radius_km: float = 50.0) -> DataFrame:
    target = _target(located(scans), filepath, ["filepath", "lat", "lon"])
    out = located(scans).join(target, F.col("filepath") != F.col("t_filepath"))
    out = out.withColumn("distance_km", haversine("lat", "lon", "t_lat", "t_lon") / 1000)
    return out.where(F.col("distance_km") <= radius_km).orderBy("distance_km")


def days(later: Column, earlier: Column) -> Column:
    """Days between two timestamps as a fraction."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 86_400e6


def find_temporal_neighbors(scans: DataFrame, filepath: str, window_days: float = 30.0) -> DataFrame:
    target = _target(scans, filepath, ["filepath", "datetime"])
    out = scans.join(target, F.col("filepath") != F.col("t_filepath"))
    out = out.withColumn("delta_days", F.abs(days(F.col("datetime"), F.col("t_datetime"))))
    return out.where(F.col("delta_days") <= window_days).orderBy("delta_days")


def find_colocated(scans: DataFrame, filepath: str, radius_km: float = 50.0, window_days: float = 30.0) -> DataFrame:
    """Near in space, and in time where both times are known."""
    target = _target(located(scans), filepath, ["filepath", "lat", "lon", "datetime", "sensor", "modality"])
    out = located(scans).join(target, F.col("filepath") != F.col("t_filepath"))
    out = out.withColumn("distance_km", haversine("lat", "lon", "t_lat", "t_lon") / 1000)
    out = out.withColumn("offset_days", F.abs(days(F.col("datetime"), F.col("t_datetime"))))
    out = out.where((F.col("distance_km") <= radius_km) & F.coalesce(F.col("offset_days") <= window_days, F.lit(True)))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"t_{c}"), F.lit(False))
    out = out.withColumn("same_sensor", same("sensor")).withColumn("same_modality", same("modality"))
    return out.orderBy("distance_km", F.coalesce("offset_days", F.lit(0.0)))


CELL = ("cx", "cy", "cz")


def _chord(radius_km: float) -> float:
    """Length of the straight line under an arc of the unit sphere."""
    return 2 * math.sin(min(radius_km * 1000 / SPHERE_M, math.pi) / 2)


def _cells(edge: float, lat: str = "lat", lon: str = "lon") -> list[Column]:
    """Cube of the edge's length that holds a point of the unit sphere."""
    return [F.floor(c / edge).cast("long").alias(n) for c, n in zip(unit_sphere(lat, lon), CELL, strict=True)]


def _forward(reach: int) -> list[tuple[int, int, int]]:
    """Offsets to neighbouring cubes, one of each pair of opposite ones, without the cube itself."""
    span = range(-reach, reach + 1)
    return [o for i in span for j in span for k in span if (o := (i, j, k)) > (0, 0, 0)]


def _moved(table: DataFrame, offsets: list[tuple[int, int, int]], edge: float) -> DataFrame:
    """Every row once for each offset, its cube moved by it; ``own`` where it did not move.

    Cubes that the sphere does not pass hold no point and are left out.
    """
    near = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(CELL, o, strict=True)]) for o in offsets])
    out = table.withColumn("o", F.explode(near)).withColumn("own", F.greatest(*[F.abs(f"o.{c}") for c in CELL]) == 0)
    out = out.withColumns({c: F.col(c) + F.col(f"o.{c}") for c in CELL}).drop("o")
    low, high = [F.col(c) * edge for c in CELL], [(F.col(c) + 1) * edge for c in CELL]
    inner = sum((x * x for x in (F.greatest(a, -b, F.lit(0.0)) for a, b in zip(low, high, strict=True))), F.lit(0.0))
    outer = sum((x * x for x in (F.greatest(-a, b) for a, b in zip(low, high, strict=True))), F.lit(0.0))
    return out.where((inner <= 1 + 1e-9) & (outer >= 1 - 1e-9))


def near_pairs(points: DataFrame, radius_km: float, key: str = "seq", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(a, b, distance_km)``, a < b, of points within the radius of each other.

    Points on the unit sphere fall into cubes whose edge is the chord of the radius; each
    point meets its own cube and 13 of the 26 around it, so the join is an equality on
    cubes with the exact distance as residual, and neither poles nor the antimeridian are
    special. Columns to ``carry`` follow as ``a_*`` and ``b_*``, so that pairs need no join
    of their own. Both sides are shuffled: the copies of a point are unknown to the planner,
    which would take the exploded side for small enough to send it through the driver.
    """
    edge = max(_chord(radius_km), 1e-9) * (1 + 1e-9)
    columns = (key, "lat", "lon", *carry)
    base = points.select(*columns, *_cells(edge))
    side = lambda t, p: t.select(F.struct(*[F.col(c) for c in columns]).alias(p), *CELL, *(["own"] if p == "q" else []))
    pairs = side(base, "p").join(side(_moved(base, [(0, 0, 0), *_forward(1)], edge), "q").hint("merge"), list(CELL))
    first = F.col(f"p.{key}") < F.col(f"q.{key}")
    pairs = pairs.where((F.col(f"p.{key}") != F.col(f"q.{key}")) & (first | ~F.col("own")))
    pairs = pairs.where(haversine("p.lat", "p.lon", "q.lat", "q.lon") / 1000 <= radius_km)
    pairs = pairs.select(F.when(first, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(first, F.col("q")).otherwise(F.col("p")).alias("b"))
    named = [F.col(f"{p}.{c}").alias(f"{p}_{c}") for c in carry for p in ("a", "b")]
    return pairs.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), (haversine("a.lat", "a.lon", "b.lat", "b.lon") / 1000).alias("distance_km"), *named)


def find_pairs(scans: DataFrame, max_km: float = 10.0, max_days: float = 365.0, same_modality: bool = False, cross_sensor: bool = False) -> DataFrame:
    """Pairs of scans near in space, and in time where both times are known."""
    carry = ("datetime", *["modality"] * same_modality, *["sensor"] * cross_sensor)
    out = near_pairs(located(scans), max_km, carry=carry).withColumn("delta_days", F.abs(days(F.col("a_datetime"), F.col("b_datetime"))))
    out = out.where(F.coalesce(F.col("delta_days") <= max_days, F.lit(True)))
    if same_modality:
        out = out.where(F.col("a_modality") == F.col("b_modality"))
    if cross_sensor:
        out = out.where(~F.coalesce(F.col("a_sensor") == F.col("b_sensor"), F.lit(False)))
    return out.select("a", "b", "distance_km", "delta_days")


def _renamed(table: DataFrame, components: DataFrame, *columns: str) -> DataFrame:
    """The table with its columns' nodes replaced by their components."""
    for c in columns:
        table = table.join(components.withColumnsRenamed({"node": f"{c}_node", "component": f"{c}_to"}).hint("merge"), F.col(c) == F.col(f"{c}_node"), "left")
        table = table.withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_node", f"{c}_to")
    return table


#: Points a cube above which links of first points are worth clusters of their own.
CROWD = 8
#: Chord below which cubes are too small against the rounding of coordinates.
LEAST_CHORD = 1e-6


def group_by_region(scans: DataFrame, radius_km: float = 25.0, workspace: Workspace | None = None) -> DataFrame:
    """``seq, cluster, size``: single-link clusters of centres, named by their smallest member.

    Cubes whose diagonal is the chord of the radius hold only points that are linked, so
    clusters are clusters of cubes, and no list of near pairs is made. Neighbouring cubes
    whose first points are near enough are joined at once; what these links leave in
    different clusters is then judged on all their distinct places.
    """
    ws = workspace or Workspace(scans.sparkSession)
    rows = located(scans)
    if (chord := _chord(radius_km)) < LEAST_CHORD:
        found = connected_components(near_pairs(rows, radius_km).select("a", "b"), ws)
        out = rows.select("seq").join(found, F.col("seq") == F.col("node"), "left").select("seq", F.coalesce("component", "seq").alias("cluster"))
        return out.join(out.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("seq", "cluster", "size")
    # A place that is no number is near nothing: its cube is null, which meets no other.
    whole = ~F.isnan(sum(unit_sphere("lat", "lon"), F.lit(0.0)))
    edge = chord / math.sqrt(3) * (1 - 1e-9)
    placed = rows.select("seq", "lat", "lon", *[F.when(whole, c).alias(n) for c, n in zip(_cells(edge), CELL, strict=True)])
    known = placed.where(F.col("cx").isNotNull())
    first = F.min(F.struct("seq", "lat", "lon")).alias("f")
    cells = ws.save(known.groupBy(*CELL).agg(first, F.count("*").alias("n")).select(*CELL, F.col("f.seq").alias("cell"), "f.lat", "f.lon", "n"), "cells")

    side = lambda t, p: t.select(*CELL, F.struct("cell", "lat", "lon").alias(p))
    beside = side(cells, "p").join(side(_moved(cells, _forward(2), edge), "q").hint("merge"), list(CELL)).select("p", "q")
    beside = ws.save(beside.withColumn("near", haversine("p.lat", "p.lon", "q.lat", "q.lon") / 1000 <= radius_km), "beside")
    links = beside.where("near").select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b"))
    apart, out = beside.where(~F.col("near")), cells.withColumn("cluster", F.col("cell"))
    crowd = cells.agg(F.sum("n") / F.count("*")).first()[0]
    if crowd and crowd > CROWD:
        joined = connected_components(links, ws)
        apart = _renamed(apart.withColumns({"pc": F.col("p.cell"), "qc": F.col("q.cell")}), joined, "pc", "qc").where("pc <> qc")
        out, links = _renamed(out, joined, "cluster"), links.limit(0)
    else:
        apart = apart.withColumns({"pc": F.col("p.cell"), "qc": F.col("q.cell")})
    places = known.select(*CELL, "lat", "lon").distinct()
    at = lambda p: _cells(edge, f"{p}.lat", f"{p}.lon")
    asked = apart.select(*at("p"), "q", "pc", "qc").join(places.hint("merge"), list(CELL))
    asked = asked.select("pc", "qc", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), *at("q")).alias("x")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in CELL]
    met = asked.join(places.alias("y").hint("merge"), [*same, haversine("lat1", "lon1", "y.lat", "y.lon") / 1000 <= radius_km], "left_semi")
    out = _renamed(out, connected_components(links.union(met.select("pc", "qc")).distinct(), ws), "cluster")
    sizes = out.groupBy("cluster").agg(F.sum("n").alias("size"))
    out = out.join(sizes.hint("merge"), "cluster").select(*CELL, "cluster", "size")
    out = placed.join(out.hint("merge"), list(CELL), "left")
    return out.select("seq", F.coalesce("cluster", "seq").alias("cluster"), F.coalesce("size", F.lit(1)).alias("size"))


def statistics(scans: DataFrame) -> DataFrame:
    """Counts in all and by modality, sensor and format, in one pass over grouping sets."""
    known = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("Unknown"))
    rows = scans.select(*[known(c).alias(c) for c in ("modality", "sensor", "format")], "datetime", F.coalesce(F.col("error") != "", F.lit(False)).alias("failed"))
    sets = [[], [F.col("modality")], [F.col("sensor")], [F.col("format")]]
    out = rows.groupingSets(sets, "modality", "sensor", "format").agg(
        F.count("*").alias("n"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.sum(F.col("failed").cast("long")).alias("errors"), F.grouping_id().alias("g")
    )
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in ((7, "all"), (3, "modality"), (5, "sensor"), (6, "format")) for x in kv]), F.col("g").cast("int"))
    return out.select(kind.alias("kind"), F.coalesce("modality", "sensor", "format", F.lit("")).alias("value"), "n", "first", "last", "errors")


def upsert(old: DataFrame, new: DataFrame, key: str = "filepath") -> DataFrame:
    """Rows of both by key; of rows that share one the new row stays.

    The latest of several new rows is the one with the largest ``seq``.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in old.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("_new", "seq")).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in columns]).select(old.columns)


def remove(scans: DataFrame, filepath: str) -> DataFrame:
    return scans.where(F.col("filepath") != filepath)


def to_geojson(scans: DataFrame) -> DataFrame:
    """``seq, feature``: a GeoJSON polygon for each located scan."""
    ring = "'[[[', west, ',', south, '],[', east, ',', south, '],[', east, ',', north, '],[', west, ',', north, '],[', west, ',', south, ']]]'"
    geometry = F.expr(f"concat('{{\"type\":\"Polygon\",\"coordinates\":', {ring}, '}}')")
    properties = F.to_json(F.struct("filepath", "format", "sensor"))
    body = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))
    return scans.where(F.col("west").isNotNull()).select("seq", body.alias("feature"))


def latest_per(scans: DataFrame, column: str) -> DataFrame:
    """The latest scan of each value."""
    by = Window.partitionBy(column).orderBy(F.desc_nulls_last("datetime"), "seq")
    return scans.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
