"""Registered queries by name, with SQL for the same rows."""

from __future__ import annotations

from . import meshes, models, queries, stores
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "meshes", "models", "queries", "stores"]
