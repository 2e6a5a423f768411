"""All queries and DuckDB oracles of the library's own operators."""

from __future__ import annotations

from orbweave.queries import catalog, features, overlay, placing, raster, shapes, signal, vector

MODULES = (catalog, raster, vector, signal, shapes, features, placing, overlay)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
