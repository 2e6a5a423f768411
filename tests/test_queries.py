"""Every registered query of the library's own operators against its DuckDB oracle."""

from __future__ import annotations

import math
import os
import random

import duckdb
import pytest

from orbweave import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    out.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        out.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return out


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>") else x.item() if hasattr(x, "item") else x
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(want) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def of_embeddings(spark, tmp_path, name, vectors):
    """A query over these vectors alone, and what its oracle gives."""
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    return registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES[name]).df()


def test_entropy_of_singular_matrices_equals_oracle(spark, tmp_path):
    """Two looks and one of nothing: the determinant is zero, or its rounding."""
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 0.1) for _ in range(64)] for _ in range(18)] + [[1.0] * 64] * 6 + [[0.0] * 64] * 8
    got, want = of_embeddings(spark, tmp_path, "pol_shannon", vectors)
    assert rows(got) == rows(want) and any(math.isinf(x) for x in want["h_total"])


@pytest.mark.parametrize("height", [6, 11, 26, 41, 61])
def test_warp_of_a_short_image_equals_oracle(spark, tmp_path, height):
    """Places that fall on the last line, whose next line is missing."""
    rng = random.Random(height)
    got, want = of_embeddings(spark, tmp_path, "warp_image", [[rng.gauss(0, 0.1) for _ in range(64)] for _ in range(height)])
    assert rows(got) == rows(want)
