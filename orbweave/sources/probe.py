"""Recognising and reading headers, as expressions over content columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading bytes of file formats, in hexadecimal.
MAGIC = (("4E495446", "NITF"), ("49492A00", "TIFF"), ("4D4D002A", "TIFF"), ("894844460D0A1A0A", "HDF5"), ("0000000C6A502020", "JP2"), ("89504E47", "PNG"), ("FFD8FF", "JPEG"), ("25504446", "PDF"), ("504B0304", "ZIP"))


def sniff(content: Column) -> Column:
    """Format by leading bytes, else markup or unknown."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(F.lower(F.substring(content, 1, 64)).rlike(r"^\s*<(!doctype|html)"), "HTML").when(F.substring(content, 1, 64).rlike(r"^\s*<"), "XML").otherwise("unknown")
    for magic, name in reversed(MAGIC):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def parse_header(text: Column) -> Column:
    """``key = value`` lines as a map; keys are lower-cased, the last of equal keys stays."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.contains("="))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def classify_modality(bands: Column, dtype: Column, name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.rlike("sar|slc|sicd"), "SAR")
        .when(dtype.startswith("complex"), "SAR")
        .when(low.rlike("thermal|ir"), "IR")
        .when(bands >= 16, "HSI")
        .when(bands > 4, "MSI")
        .when(bands >= 3, "EO")
        .otherwise("PAN")
    )


def factors(n: Column, limit: int) -> Column:
    """Divisors of ``n`` up to ``limit``, ascending."""
    return F.filter(F.sequence(F.lit(1), F.lit(limit)), lambda k: n % k == 0)


def parse_datetime(text: Column) -> Column:
    """A timestamp from the usual notations; null where none fits."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss", "yyyyMMdd", "dd.MM.yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def synthesize(spark, rows: int, cols: int, seed: int = 7) -> DataFrame:
    """A complex scene ``row, col, re, im`` with a bright square, made where it is used."""
    side = max(1, min(rows, cols) // 8)
    cell = spark.range(rows * cols).select((F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"), "id")
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 24)) + 0.5) / float(1 << 24)
    size, turn = F.sqrt(F.log(noise(0)) * -2), noise(1) * (2 * math.pi)
    bright = F.when(F.col("row").between(rows // 2, rows // 2 + side) & F.col("col").between(cols // 2, cols // 2 + side), 10.0).otherwise(1.0)
    return cell.select("row", "col", (size * F.cos(turn) * bright).alias("re"), (size * F.sin(turn) * bright).alias("im"))
