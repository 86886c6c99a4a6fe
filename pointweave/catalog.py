"""Queries of the spatial engine, each with SQL that gives the same rows on the same tables."""

from __future__ import annotations

from . import catalog_cohort, catalog_detection, catalog_metadata, catalog_models, catalog_points, catalog_raster, catalog_shapes
from .plans import aggregates
from .sources import adapters


def flagship(spark, sf_dir):
    """Aggregates of the nuclei of tissue tiles; a wide radius, as the small tables are sparse."""
    nuclei = adapters.nuclei(spark, sf_dir)
    return aggregates.detect_aggregates(nuclei, adapters.tiles(nuclei), 400, 10)


def _all() -> dict:
    parts = catalog_points, catalog_raster, catalog_cohort, catalog_detection, catalog_shapes, catalog_models, catalog_metadata
    return {name: q for part in parts for name, q in part.QUERIES.items()}


def queries() -> dict:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
