"""Nested catalogue flattening and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(catalogs: DataFrame, col: str = "catalog", keep: list[str] | None = None) -> DataFrame:
    """One row per course (name, link, category, role); map explode twice + inline."""
    keep = keep or [c for c in catalogs.columns if c != col]
    lvl1 = catalogs.select(*keep, F.explode(col).alias("category", "_roles"))
    lvl2 = lvl1.select(*keep, "category", F.explode("_roles").alias("role", "_courses"))
    return lvl2.select(*keep, "category", "role", F.inline("_courses")).select(
        *keep, F.col("title").alias("name"), F.col("url").alias("link"), "category", "role")


def courses_for_role(catalogs: DataFrame, category: str, role: str, col: str = "catalog",
                     keep: list[str] | None = None) -> DataFrame:
    """Two-level map lookup with an empty default, as rows (no rows = empty list)."""
    keep = keep or [c for c in catalogs.columns if c != col]
    found = F.try_element_at(F.try_element_at(F.col(col), F.lit(category)), F.lit(role))
    empty = F.array().cast("array<struct<title:string,url:string>>")
    return catalogs.select(*keep, F.inline(F.coalesce(found, empty))).select(
        *keep, F.col("title").alias("name"), F.col("url").alias("link"))


def courses_for_requests(requests: DataFrame, flat: DataFrame) -> DataFrame:
    """C7 batch form: equi join of (category, role) requests with the flat catalogue."""
    return requests.join(flat, ["category", "role"], "inner")
