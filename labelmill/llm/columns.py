"""Schemas of results that pass columns on."""

from __future__ import annotations

from pyspark.sql import types as T


def beside(schema: T.StructType, *added: T.StructField) -> T.StructType:
    """schema without columns that are named like an added one in any case, and the added ones after it."""
    names = {f.name.lower() for f in added}
    return T.StructType([f for f in schema if f.name.lower() not in names] + list(added))
