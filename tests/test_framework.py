"""Processors, parameters and the message source."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orbweave.operators.framework import Param, Pipeline, Processor, Registry
from orbweave.sources import messages


def double(df, factor=2.0):
    return df.withColumn("v", F.col("v") * factor)


def test_params_are_validated():
    p = Param(float, 1.0, low=0, high=5)
    assert p.validate("x", 3) == 3.0
    for bad, error in [(7, ValueError), ("a", TypeError)]:
        with pytest.raises(error):
            p.validate("x", bad)
    with pytest.raises(TypeError):
        Param(int).validate("n", True)
    with pytest.raises(ValueError):
        Param(str, choices=("a",)).validate("s", "b")


def test_pipeline_and_registry(spark):
    step = Processor("double", double, {"factor": Param(float, 2.0, low=0)}, tags=("math",))
    seen = []
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert sorted(r["v"] for r in Pipeline([step, step])(df, seen.append).collect()) == [4.0, 8.0]
    assert seen == [0.5, 1.0] and step(df, factor=3).first()["v"] == 3.0
    with pytest.raises(TypeError):
        step(df, other=1)
    with pytest.raises(ValueError):
        Pipeline([])
    known = Registry()
    known.register(step)
    with pytest.raises(ValueError):
        known.register(step)
    assert known.tagged("math") == ["double"] and known.get("double") is step and known.table(spark).count() == 1


def test_angles_round_trip():
    for degrees in (0.0, 12.5, 359.99, -45.0):
        assert abs((messages.unpack_angle(messages.pack_angle(degrees, 32, False), 32, False) - degrees + 180) % 360 - 180) < 1e-6
    for degrees in (-90.0, -12.25, 0.0, 89.9):
        assert abs(messages.unpack_angle(messages.pack_angle(degrees, 32, True), 32, True) - degrees) < 1e-6
    assert messages.unpack_angle(messages.pack_angle(120.0, 16, True), 16, True) == 90 * (1 - 2**-15)


def test_messages_round_trip_through_spark(spark, tmp_path):
    spark.dataSource.register(messages.ReportSource)
    rows = [(1, 1, 45.0, 120.0, -500, 25, 10), (1, 2, -12.5, 300.25, 300, None, 3), (2, 1, 0.0, 0.0, 0, 7, None), (2, 2, 1.0, 2.0, 3, None, None)]
    spark.createDataFrame(rows, messages.SCHEMA).repartition(2).write.format("reports").mode("append").save(str(tmp_path))
    got = sorted(map(tuple, spark.read.format("reports").load(str(tmp_path)).collect()))
    assert [(*r[:2], *r[4:]) for r in got] == [(*r[:2], *r[4:]) for r in rows]
    assert all(abs(a[2] - b[2]) < 1e-6 and abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, rows, strict=True))


def test_broken_messages_raise():
    good = messages.encode((1, 1, 1.0, 2.0, 3, 4, 5))
    other = messages.HEADER.pack(99, 8) + b"abc"
    assert len(list(messages.decode(other + good))) == 1
    for bad in (good[:-1], good + b"\x02\x00"):
        with pytest.raises(ValueError):
            list(messages.decode(bad))
