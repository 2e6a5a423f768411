"""Domain tables seen in the star-schema tables, as SQL that Spark and DuckDB both run.

Every view is deterministic arithmetic on the keys, so a query over it and its oracle see
the same rows. ``{name}`` stands for a base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SCANS = """
SELECT o_orderkey AS seq, concat('img_', o_orderkey) AS filepath,
  CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE substr(o_orderpriority, 1, 1) END AS format,
  CASE o_orderkey % 5 WHEN 0 THEN 'SAR' WHEN 1 THEN 'eo' WHEN 2 THEN 'MSI' WHEN 3 THEN 'sar' END AS modality,
  CASE WHEN o_orderkey % 11 <> 0 THEN concat('Sat-', o_custkey % 7) END AS sensor,
  CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS datetime,
  CASE WHEN o_orderkey % 29 <> 0 THEN lon - half END AS west,
  CASE WHEN o_orderkey % 29 <> 0 THEN lat - half END AS south,
  CASE WHEN o_orderkey % 29 <> 0 THEN lon + half END AS east,
  CASE WHEN o_orderkey % 29 <> 0 THEN lat + half END AS north,
  CASE WHEN o_orderkey % 37 = 0 THEN 'Open failed' END AS error
FROM (SELECT *, ((o_custkey * 7919 + o_orderkey * 104729) % 34000) / 1e2 - 170 AS lon,
             ((o_orderkey * 15485863) % 16000) / 1e2 - 80 AS lat,
             (o_orderkey % 50) / 4e0 AS half FROM {orders})
"""

PRODUCTS = """
SELECT o_orderkey AS id, concat('S1A_IW_SLC__1SDV_', o_orderkey) AS product_name,
  CASE o_orderkey % 3 WHEN 0 THEN 'ASCENDING' WHEN 1 THEN 'DESCENDING' END AS orbit_pass,
  o_custkey % 175 AS absolute_orbit,
  CASE o_orderkey % 4 WHEN 0 THEN 'VV' WHEN 1 THEN 'VH' WHEN 2 THEN 'HH' END AS polarization,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('IW', o_orderkey % 3 + 1) END AS swath,
  concat(substr(cast(o_orderdate AS {string}), 1, 10), 'T06:00:00') AS start_time,
  concat(substr(cast(o_orderdate AS {string}), 1, 10), 'T06:00:27') AS stop_time,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('/data/', o_orderkey) END AS local_path,
  CASE WHEN o_orderkey % 3 <> 1 THEN concat('https://host.invalid/', o_orderkey) END AS remote_url,
  concat('[[', lat, ',', lon, '],[', lat, ',', lon + 2, '],[', lat + 1, ',', lon + 2, '],[', lat + 1, ',', lon, ']]') AS corner_coords
FROM (SELECT *, (o_orderkey * 7919) % 160 - 80 AS lat, (o_orderkey * 104729) % 350 - 175 AS lon FROM {orders})
"""

BOXES = """
SELECT p_partkey AS seq, concat('p', p_partkey) AS id, 'Polygon' AS geom_type, p_brand AS brand, p_type AS kind,
  p_retailprice AS val, x AS minx, y AS miny, x + 1 + p_size AS maxx, y + 1 + p_partkey % 13 AS maxy
FROM (SELECT *, cast((p_partkey * 7919) % 5000 AS double) AS x, cast((p_partkey * 104729) % 5000 AS double) AS y FROM {part})
"""

POINTS = """
SELECT s_suppkey AS seq, concat('s', s_suppkey) AS id, 'Point' AS geom_type, s_nationkey AS nation, s_acctbal AS val,
  cast((s_suppkey * 15485863) % 5000 AS double) + 5e-1 AS x, cast((s_suppkey * 32452843) % 5000 AS double) + 5e-1 AS y
FROM {supplier}
"""

#: Rows of 64 samples; every 64 of them form one image.
PIXELS = {
    "spark": """
SELECT cast(floor(vec_id / 64) AS bigint) AS image_id, cast(vec_id % 64 AS int) AS row, pos AS col, cast(v AS double) AS value
FROM (SELECT vec_id, posexplode(embedding) AS (pos, v) FROM {embeddings})
""",
    "duckdb": """
SELECT vec_id // 64 AS image_id, (vec_id % 64)::INT AS row, (unnest(range(64)))::INT AS col, unnest(embedding)::DOUBLE AS value
FROM {embeddings}
""",
}

#: Two complex channels and their cross terms come from four blocks of 16 samples.
CPIXELS = {
    "spark": """
SELECT vec_id AS row, pos AS col, cast(embedding[pos] AS double) AS hh_re, cast(embedding[pos + 8] AS double) AS hh_im,
  cast(embedding[pos + 16] AS double) AS hv_re, cast(embedding[pos + 24] AS double) AS hv_im,
  cast(embedding[pos + 32] AS double) AS vh_re, cast(embedding[pos + 40] AS double) AS vh_im,
  cast(embedding[pos + 48] AS double) AS vv_re, cast(embedding[pos + 56] AS double) AS vv_im
FROM (SELECT vec_id, embedding, explode(sequence(0, 7)) AS pos FROM {embeddings})
""",
    "duckdb": """
SELECT vec_id AS row, pos::INT AS col, embedding[pos + 1]::DOUBLE AS hh_re, embedding[pos + 9]::DOUBLE AS hh_im,
  embedding[pos + 17]::DOUBLE AS hv_re, embedding[pos + 25]::DOUBLE AS hv_im,
  embedding[pos + 33]::DOUBLE AS vh_re, embedding[pos + 41]::DOUBLE AS vh_im,
  embedding[pos + 49]::DOUBLE AS vv_re, embedding[pos + 57]::DOUBLE AS vv_im
FROM (SELECT vec_id, embedding, unnest(range(8)) AS pos FROM {embeddings})
""",
}

TARGETS = """
SELECT event_id AS seq, user_id AS dwell_index, cast(event_id % 60000 AS double) AS dwell_time_ms,
  cast(user_id % 80 AS double) - 40 AS center_lat, cast(user_id * 7 % 340 AS double) AS center_lon,
  CASE WHEN event_id % 3 <> 0 THEN cast(user_id % 80 AS double) - 40 + (event_id % 100) / 1e3 END AS lat,
  CASE WHEN event_id % 3 <> 0 THEN cast(user_id * 7 % 340 AS double) + (event_id % 77) / 1e3 END AS lon,
  CASE WHEN event_id % 7 <> 0 THEN cast(event_id % 201 - 100 AS double) END AS dlat,
  cast(event_id % 151 - 75 AS double) AS dlon, 1e-4 AS lat_scale, 2e-4 AS lon_scale,
  cast((event_id * 37) % 2000 - 1000 AS double) AS v_los,
  CASE WHEN event_id % 13 <> 0 THEN cast((event_id * 11) % 50 AS double) END AS snr,
  CASE WHEN event_id % 5 <> 0 THEN event_id % 9 END AS classification,
  cast(user_id % 360 AS double) AS track, 12e4 AS v_sensor,
  cast(user_id % 80 AS double) - 41 AS sensor_lat, cast(user_id * 7 % 340 AS double) + 1 AS sensor_lon
FROM {events}
"""

#: Unevenly sampled series, one for each user, with the time in seconds.
SERIES = """
SELECT user_id, event_id, cast(event_id AS double) * 3 + event_id % 3 AS t, value FROM {events}
"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(view: str | dict[str, str], engine: str) -> str:
    return view if isinstance(view, str) else view[engine]


def load(spark: SparkSession, sf_dir: str, view: str | dict[str, str]) -> DataFrame:
    """The view over the tables below ``sf_dir``."""
    sql = text(view, "spark").replace("{string}", "string")
    names = [n for n in TABLES if f"{{{n}}}" in sql]
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return spark.sql(sql, **frames)


def oracle(sql: str, **views: str | dict[str, str]) -> str:
    """DuckDB SQL with the views as common table expressions."""
    parts = [f"{name} AS ({re.sub(r'{(\w+)}', lambda m: 'VARCHAR' if m[1] == 'string' else m[1], text(v, 'duckdb'))})" for name, v in views.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {sql.strip().removeprefix('WITH')}" if not sql.strip().startswith("WITH") else f"WITH RECURSIVE {', '.join(parts)}, {sql.strip().removeprefix('WITH')}"
