"""Feature and detection tables with property maps, GeoJSON, grids and matching."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.geo import enu_to_geodetic

GEOJSON = "type string, id string, geometry struct<type: string, coordinates: array<double>>, properties map<string,string>"


def to_geojson(points: DataFrame) -> DataFrame:
    """``seq, feature`` of ``seq, id, x, y, properties``."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    return points.select("seq", F.to_json(F.struct(F.lit("Feature").alias("type"), "id", geometry.alias("geometry"), "properties")).alias("feature"))


def from_geojson(features: DataFrame) -> DataFrame:
    """Point features; one without an id gets its ``seq``."""
    f = features.withColumn("f", F.from_json("feature", GEOJSON))
    return f.select("seq", F.coalesce("f.id", F.col("seq").cast("string")).alias("id"), F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y"), F.col("f.properties").alias("properties"))


def merged_properties(left: Column, right: Column) -> Column:
    """Both maps; of equal keys the left value stays."""
    return F.map_concat(F.map_filter(right, lambda k, _: ~F.coalesce(F.map_contains_key(left, k), F.lit(False))), left)


def detections_to_features(detections: DataFrame) -> DataFrame:
    """Confidence joins the properties; ids count up in order of ``seq``.

    Ids are offsets within hashed-free ranges of ``seq``: a rank over ranges of 2**20,
    so no task orders all rows.
    """
    span = 1 << 20
    rows = detections.withColumn("part", F.floor(F.col("seq") / span))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("seq"))).join(before, "part")
    confidence = F.create_map(F.lit("confidence"), F.col("confidence").cast("string"))
    properties = F.when(F.col("confidence").isNotNull(), merged_properties(confidence, F.col("properties"))).otherwise(F.col("properties"))
    return ranked.select("seq", (F.col("before") + F.col("r") - 1).alias("id"), properties.alias("properties"))


def property_names(features: DataFrame) -> DataFrame:
    """The distinct keys of all property maps."""
    return features.select(F.explode(F.map_keys("properties")).alias("name")).distinct()


def filter_confidence(detections: DataFrame, least: float) -> DataFrame:
    return detections.where(F.col("confidence").isNotNull() & (F.col("confidence") >= least))


def perimeter(images: DataFrame, per_edge: int) -> DataFrame:
    """``image_id, edge, k, row, col`` evenly along the four edges; corners come twice."""
    step = F.col("k") / F.lit(per_edge - 1)
    rows = images.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1))))
    last_r, last_c = F.col("rows") - 1, F.col("cols") - 1
    row = F.when(F.col("edge") == 0, F.lit(0.0)).when(F.col("edge") == 1, last_r * step).when(F.col("edge") == 2, last_r * 1.0).otherwise(last_r * (1 - step))
    col = F.when(F.col("edge") == 0, last_c * step).when(F.col("edge") == 1, last_c * 1.0).when(F.col("edge") == 2, last_c * (1 - step)).otherwise(F.lit(0.0))
    return rows.select("image_id", "edge", "k", row.alias("row"), col.alias("col"))


def geographic_grid(spark, south: float, north: float, west: float, east: float, dlat: float, dlon: float) -> DataFrame:
    """``row, col, lat, lon`` from the north-west corner."""
    rows, cols = math.ceil((north - south) / dlat), math.ceil((east - west) / dlon)
    cell = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return cell.select("row", "col", (F.lit(north) - F.col("row") * dlat).alias("lat"), (F.lit(west) + F.col("col") * dlon).alias("lon"))


def enu_grid(spark, lat0: float, lon0: float, size_m: float, pixel_m: float) -> DataFrame:
    """``row, col, lat, lon`` of a square metric grid around a point."""
    n = math.ceil(2 * size_m / pixel_m)
    cell = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    lat, lon, _ = enu_to_geodetic(F.col("col") * pixel_m - size_m, F.lit(size_m) - F.col("row") * pixel_m, F.lit(0.0), lat0, lon0, 0.0)
    return cell.select("row", "col", lat.alias("lat"), lon.alias("lon"))


def ratio_matches(queries: DataFrame, pool: DataFrame, cell: float, ratio: float = 0.75) -> DataFrame:
    """Nearest points within ``cell`` of each query that are clearly nearer than the second.

    Points meet in the 9 grid cells around each query; ``queries(id, x, y)``, ``pool(id, x, y)``.
    """
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    q = queries.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(near).alias("n"))
    q = q.withColumns({"gx": F.floor(F.col("ax") / cell) + F.col("n.i"), "gy": F.floor(F.col("ay") / cell) + F.col("n.j")})
    p = pool.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    met = q.join(p, ["gx", "gy"]).withColumn("d", d).where(F.col("d") <= cell)
    two = met.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best"), F.slice(F.array_sort(F.collect_list("d")), 1, 2).alias("ds"))
    clear = F.when(F.size("ds") < 2, F.lit(True)).otherwise(F.get("ds", F.lit(0)) < F.get("ds", F.lit(1)) * ratio)
    return two.where(clear).select("a", F.col("best.b").alias("b"), F.col("best.d").alias("distance"))


def blend(image: Column, mask: Column, color: float, alpha: float) -> Column:
    """A colour laid over the masked pixels."""
    return F.when(mask, image * (1 - alpha) + color * alpha).otherwise(image)


def phase_gradient(pixels: DataFrame, axis: str) -> DataFrame:
    """Phase step to the next pixel of ``image_id, row, col, re, im`` along an axis.

    The last pixel of a line repeats the step before it.
    """
    other = "row" if axis == "col" else "col"
    w = Window.partitionBy("image_id", other).orderBy(axis)
    nre, nim = F.lead("re").over(w), F.lead("im").over(w)
    step = F.atan2(nim * F.col("re") - nre * F.col("im"), nre * F.col("re") + nim * F.col("im"))
    out = pixels.withColumn("step", step)
    return out.withColumn("value", F.coalesce("step", F.lag("step").over(w))).select("image_id", "row", "col", "value")
