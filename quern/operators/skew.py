"""Joins by a key that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most keys that can each hold an equal share of all rows.
HOT_KEYS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined to groups by key; groups: one row a key, with n, its rows (dropped).

    A key of more than a HOT_KEYS-th of the total rows, and more than 1,000, is hot. There are HOT_KEYS of those at most: their groups
    are broadcast and their rows stay where they are.
    """
    bound = max(1000, total // HOT_KEYS)
    hot, cold = F.broadcast(groups.filter(F.col("n") > bound).drop("n")), groups.filter(F.col("n") <= bound).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
