"""Nested catalogue source {category: {role: [(title, url)]}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreplane.sources.schemas import CATALOG


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one catalogue object per line under key ``catalog``; schema fixed.

    A line that is no JSON object, or has no catalogue or a level without
    content, gives a catalogue without courses; the other lines are read.
    """
    return spark.read.schema(CATALOG).json(path, mode="PERMISSIVE")


def write_catalog_json(catalogs: DataFrame, path: str) -> str:
    """Catalogues as JSON lines, as ``read_catalog_json`` takes them."""
    catalogs.select(F.to_json(F.struct("catalog")).alias("value")).write.text(path)
    return path
