"""All queries of the raster and pyramid engine, with their SQL twins."""

from __future__ import annotations

from . import q_build, q_files, q_grid, q_io, q_maps, q_raster, q_request, q_tables, q_toolbox  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
