"""Product catalogs: conjunctive queries, footprints and the two upsert merges.

Dates are text in ISO order and compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions.geo import boxes_meet


def query(products: DataFrame, start: str | None = None, end: str | None = None, has_local: bool | None = None, **equal) -> DataFrame:
    """Rows that meet every predicate given; empty strings and None are no predicate."""
    out = products
    if start:
        out = out.where(F.col("start_time") >= start)
    if end:
        out = out.where(F.col("stop_time") <= end)
    if has_local is not None:
        out = out.where(F.col("local_path").isNotNull() if has_local else F.col("local_path").isNull())
    for name, value in equal.items():
        if value not in (None, ""):
            out = out.where(F.col(name) == value)
    return out


def with_bounds(products: DataFrame) -> DataFrame:
    """Adds ``west, south, east, north`` from the corners, a JSON list of [lat, lon]."""
    corners = F.from_json("corner_coords", "array<array<double>>")
    lat, lon = F.transform(corners, lambda c: c[0]), F.transform(corners, lambda c: c[1])
    return products.withColumns({"west": F.array_min(lon), "south": F.array_min(lat), "east": F.array_max(lon), "north": F.array_max(lat)})


def overlapping(products: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    return with_bounds(products).where(boxes_meet("west", "south", "east", "north", *bounds))


def top(products: DataFrame, n: int, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The ``n`` latest products, in a box if one is given."""
    out = overlapping(products, bbox) if bbox else products
    return out.orderBy(F.desc("start_time"), "product_name").limit(n)


def _merge(old: DataFrame, new: DataFrame, key: str, value) -> DataFrame:
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh, known = F.col(f"n.{key}").isNotNull(), F.col(f"o.{key}").isNotNull()
    return joined.select(*[value(c, F.col(f"o.{c}"), F.col(f"n.{c}"), known, fresh).alias(c) for c in old.columns])


def merge_local(old: DataFrame, new: DataFrame, key: str = "product_name", keep: tuple[str, ...] = ("id", "remote_url")) -> DataFrame:
    """Local scans win in every column except ``keep``, where a known row's value stays."""

    def value(name: str, o: Column, n: Column, known: Column, fresh: Column) -> Column:
        if name == key:
            return F.coalesce(n, o)
        if name in keep:
            return F.when(known, o).otherwise(n)
        return F.when(fresh, n).otherwise(o)

    return _merge(old, new, key, value)


def merge_remote(old: DataFrame, new: DataFrame, key: str = "product_name", replace: tuple[str, ...] = ("id", "remote_url")) -> DataFrame:
    """Remote rows replace ``replace`` and only fill what local rows leave null; local paths stay."""

    def value(name: str, o: Column, n: Column, known: Column, fresh: Column) -> Column:
        if name == key:
            return F.coalesce(n, o)
        if name in replace:
            return F.when(fresh, n).otherwise(o)
        if name == "local_path":
            return F.when(known, o).otherwise(n)
        return F.coalesce(o, n)

    return _merge(old, new, key, value)


def summary(products: DataFrame) -> DataFrame:
    return products.groupBy("orbit_pass", "polarization").agg(
        F.count("*").alias("n"),
        F.count("local_path").alias("local"),
        F.count("remote_url").alias("remote"),
        F.min("start_time").alias("first"),
        F.max("stop_time").alias("last"),
    )


def iso_datetime(text: Column | str) -> Column:
    """A date or a time without zone as full ISO 8601 in UTC."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.contains("T"), F.when(c.endswith("Z"), c).otherwise(F.concat(c, F.lit("Z")))).otherwise(F.concat(c, F.lit("T00:00:00Z")))
