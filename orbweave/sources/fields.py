"""Dictionary of the field names that detections use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Domain, then name, type and unit (- for none) of each field.
DICTIONARY = """
physical: length float m; width float m; height float m; area float m^2; perimeter float m; heading float deg; speed float m/s; velocity_radial float m/s; rcs float m^2; rcs_db float dBsm; temperature float K; emissivity_thermal float -
sar: sigma0 float dB; gamma0 float dB; beta0 float dB; coherence float -; coherence_loss float -; change_magnitude float dB; sublook_ratio float -; sublook_variance float -; pol_entropy float -; pol_alpha float deg; pol_anisotropy float -; pol_span float dB; pol_pedestal_height float -; scattering_type str -; phase_difference float rad
gmti: report_index int -; dwell_index int -; snr_db float dB; target_classification int -; target_class_probability int %; target_height_m int m; wrap_velocity_cmps int cm/s; slant_range_std_cm int cm; cross_range_std int -; height_std_m int m; velocity_los_std_cmps int cm/s; target_rcs_db int dB; dwell_time_ms int ms; platform_lat float deg; platform_lon float deg; platform_alt_cm int cm; mdv_dmps int dm/s
spectral: ndvi float -; ndwi float -; ndbi float -; ndsi float -; evi float -; reflectance float -; radiance float W/m^2/sr/um; emissivity float -; band_ratio float -; spectral_angle float rad; brightness_temp float K; chlorophyll_index float -
volume: height float m; canopy_height float m; biomass_density float Mg/ha; biomass_agb float Mg/ha; canopy_cover float -; leaf_area_index float -; tree_count int -; volume float m^3
identity: label str -; label_id int -; label_confidence float -; is_target bool -; threat_level str -; category str -; subcategory str -; model_name str -; model_version str -; association_id str -
trait: color str -; shape str -; material str -; orientation float deg; texture str -; size_class str -; condition str -; activity str -; posture str -; camouflage_index float -
temporal: first_seen str -; last_seen str -; persistence float -; revisit_count int -; change_type str -; change_rate float 1/day; dwell_time float s; activity_pattern str -
context: density float 1/km^2; cluster_id int -; nearest_neighbor float m; nearest_road float m; elevation float m; slope float deg; land_cover str -; land_use str -
"""


def entries(domain: str | None = None) -> list[tuple[str, str, str, str | None]]:
    """``(name, domain, type, unit)`` of all fields or of one domain, by name."""
    out = []
    for line in DICTIONARY.strip().splitlines():
        prefix, rest = line.split(": ", 1)
        for name, kind, unit in (e.split() for e in rest.split("; ")):
            out.append((f"{prefix}.{name}", prefix, kind, None if unit == "-" else unit))
    return sorted(e for e in out if domain in (None, e[1]))


def lookup(name: str) -> tuple[str, str, str, str | None] | None:
    return next((e for e in entries() if e[0] == name), None)


def fields(spark: SparkSession, domain: str | None = None) -> DataFrame:
    return spark.createDataFrame(entries(domain), "name string, domain string, type string, unit string")


def described(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``domain, type, unit, known`` of the field that a column names; the dictionary is broadcast."""
    known = fields(rows.sparkSession).withColumnRenamed("name", column)
    return rows.join(F.broadcast(known), column, "left").withColumn("known", F.col("domain").isNotNull())


def typed(value: Column, kind: str) -> Column:
    """A property's text as the type its field demands; null where it is none."""
    return value.try_cast({"float": "double", "int": "long", "bool": "boolean", "str": "string"}[kind])
