"""Moving-target reports: positions, filters, velocities and footprints of dwells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.geo import normalize_lon

EARTH_M = 6_371_000.0


def to_detections(targets: DataFrame, full_snr: float = 40.0) -> DataFrame:
    """Reports with a position, absolute or by offset from the dwell's centre.

    ``confidence`` is the signal-to-noise ratio over ``full_snr``, held to 0..1.
    """
    lat = F.coalesce("lat", F.col("center_lat") + F.col("dlat") * F.col("lat_scale"))
    lon = F.when(F.col("lat").isNotNull(), F.col("lon")).when(F.col("dlat").isNotNull(), F.col("center_lon") + F.col("dlon") * F.col("lon_scale"))
    out = targets.withColumns({"at_lat": lat, "at_lon": normalize_lon(lon)}).where("at_lat is not null and at_lon is not null")
    confidence = F.least(F.greatest(F.col("snr") / full_snr, F.lit(0.0)), F.lit(1.0))
    return out.withColumns({"confidence": F.when(F.col("snr").isNotNull(), confidence), "velocity_radial": F.col("v_los") / 100})


def filter_reports(targets: DataFrame, snr_min: float | None = None, mdv_min: float | None = None, classification: int | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Reports that meet every condition given; a null field fails its condition."""
    out = targets
    if snr_min is not None:
        out = out.where(F.col("snr") >= snr_min)
    if mdv_min is not None:
        out = out.where(F.abs("v_los") / 100 >= mdv_min)
    if classification is not None:
        out = out.where(F.col("classification") == classification)
    if bbox is not None:
        w, s, e, n = bbox
        out = out.where(normalize_lon("lon").between(w, e) & F.col("lat").between(s, n))
    return out


def ground_velocity() -> Column:
    """Radial velocity in m/s with the platform's own motion along the line of sight added."""
    los = F.col("v_los") / 100
    dlat = F.radians(F.col("lat") - F.col("sensor_lat"))
    dlon = F.radians(normalize_lon("lon") - normalize_lon("sensor_lon")) * F.cos(F.radians("sensor_lat"))
    along = F.col("v_sensor") / 1000 * F.cos(F.radians("track") - F.atan2(dlon, dlat))
    known = F.col("track").isNotNull() & F.col("v_sensor").isNotNull() & ~((dlat == 0) & (dlon == 0))
    return F.when(known, los + along).otherwise(los)


def footprint(half_range_km: Column, half_angle: Column) -> list[Column]:
    """Extent around a dwell's centre; the angle counts as kilometres."""
    per_degree = math.pi * EARTH_M / 180
    dlat = half_angle * 1000 / per_degree
    dlon = half_range_km * 1000 / per_degree / F.greatest(F.cos(F.radians("center_lat")), F.lit(1e-9))
    lon = normalize_lon("center_lon")
    return [(lon - dlon).alias("west"), (F.col("center_lat") - dlat).alias("south"), (lon + dlon).alias("east"), (F.col("center_lat") + dlat).alias("north")]


def summary(targets: DataFrame) -> DataFrame:
    return targets.agg(
        F.countDistinct("dwell_index").alias("dwells"),
        F.count("*").alias("reports"),
        F.min("dwell_time_ms").alias("first_ms"),
        F.max("dwell_time_ms").alias("last_ms"),
        F.min("lat").alias("south"),
        F.max("lat").alias("north"),
        F.min("lon").alias("west"),
        F.max("lon").alias("east"),
        F.min_by("dwell_index", "seq").alias("first_dwell"),
    )


def unpack_unsigned(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def unpack_angle(hexadecimal: Column, bits: int, signed: bool) -> Column:
    """Binary angles: 360 / 2**n a step unsigned, 90 / 2**(n - 1) signed."""
    raw = unpack_unsigned(hexadecimal)
    if not signed:
        return raw * (360.0 / 2**bits)
    return F.when(raw >= 2 ** (bits - 1), raw - 2**bits).otherwise(raw) * (90.0 / 2 ** (bits - 1))


def mask_has(mask: Column, bit: int) -> Column:
    """Whether an existence mask announces a field, counted from the highest of 64 bits."""
    return F.shiftright(mask, 63 - bit).bitwiseAND(F.lit(1).cast("long")) == 1
