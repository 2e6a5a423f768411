"""A data source for length-prefixed binary report messages, reading and writing.

A message is a 5-byte header, type and whole length, and a body of big-endian fields.
Registered as ``reports``: ``spark.dataSource.register(ReportSource)``.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEADER = struct.Struct(">BI")
REPORT = 2
SCHEMA = "dwell_index int, report int, lat double, lon double, v_los int, snr int, classification int"


def pack_angle(degrees: float, bits: int, signed: bool) -> int:
    """Binary angle: unsigned ones wrap around, signed ones saturate."""
    if not signed:
        return round(degrees % 360 / 360 * 2**bits) % 2**bits
    top = 2 ** (bits - 1)
    return max(-top, min(top - 1, round(degrees / 90 * top))) % 2**bits


def unpack_angle(raw: int, bits: int, signed: bool) -> float:
    if not signed:
        return raw * 360 / 2**bits
    return (raw - 2**bits if raw >= 2 ** (bits - 1) else raw) * 90 / 2 ** (bits - 1)


def encode(row: tuple) -> bytes:
    """One report message; the optional fields follow a mask that announces them."""
    dwell, report, lat, lon, v_los, snr, kind = row
    mask = (snr is not None) | (kind is not None) << 1
    body = struct.pack(">HHIIhB", dwell, report, pack_angle(lat, 32, True), pack_angle(lon, 32, False), v_los, mask)
    body += struct.pack(">b", snr) if snr is not None else b""
    body += struct.pack(">B", kind) if kind is not None else b""
    return HEADER.pack(REPORT, HEADER.size + len(body)) + body


def decode(data: bytes) -> Iterator[tuple]:
    """Reports of a buffer; unknown message types are passed over, a wrong length raises."""
    at = 0
    while at < len(data):
        if at + HEADER.size > len(data):
            raise ValueError(f"a header is cut off at byte {at}")
        kind, size = HEADER.unpack_from(data, at)
        if size < HEADER.size or at + size > len(data):
            raise ValueError(f"message of {size} bytes at byte {at} of {len(data)}")
        if kind == REPORT:
            dwell, report, lat, lon, v_los, mask = struct.unpack_from(">HHIIhB", data, at + HEADER.size)
            rest = at + HEADER.size + 17 - 2
            snr = struct.unpack_from(">b", data, rest)[0] if mask & 1 else None
            label = data[rest + (mask & 1)] if mask & 2 else None
            yield dwell, report, unpack_angle(lat, 32, True), unpack_angle(lon, 32, False), v_los, snr, label
        at += size


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ReportReader(DataSourceReader):
    """One partition a file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        found = sorted(glob.glob(os.path.join(self.path, "*.rpt"))) if os.path.isdir(self.path) else [self.path]
        return [File(p) for p in found]

    def read(self, partition: File) -> Iterator[tuple]:
        with open(partition.path, "rb") as file:
            yield from decode(file.read())


class ReportWriter(DataSourceWriter):
    """One file a task; files of failed tasks are taken away."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{TaskContext.get().partitionId():05d}")
        with open(f"{name}.tmp", "wb") as file:
            for row in rows:
                file.write(encode(tuple(row)))
        os.replace(f"{name}.tmp", f"{name}.rpt")
        return WriterCommitMessage()


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"])
