"""Joins of rows with a row per group, when a group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_GROUPS = 1000  #: groups of more than 1/HEAVY_GROUPS of all rows are joined by broadcast; there can't be more of them


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of their group. Heavy groups, fewer than HEAVY_GROUPS by their sizes, go to every task; the rest are shuffled."""
    heavy_size = max(1, total // HEAVY_GROUPS)
    heavy, light = groups.where(F.col(size) > heavy_size), groups.where(F.col(size) <= heavy_size)
    first = rows.join(F.broadcast(heavy), key, "left")
    late = first.where(F.col(size).isNull()).select(*rows.columns).join(light, key)
    return first.where(F.col(size).isNotNull()).select(*late.columns).unionByName(late)
